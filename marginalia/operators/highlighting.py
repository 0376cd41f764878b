"""Technical terms, signs and scripts of a manuscript's paragraphs, and the colours they are marked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import onepass

# Pattern groups by name, a pattern a line; the words and signs they are made of.
UNIT_PER = "dL µ µL mL ml L g mg kg min h hr hour day week month".split()
METRIC = "micro micron liter liters mcg mcm mcl mmHg cc cm mL gram meter feet inch pound ounce mile yard".split()
MEDICAL = "DSM COVID-19 ventilation perfusion V/Q VQ V-Q".split()
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety"
).split()
ENDED = "-one -two -three -four -five -six -seven -eight -nine".split()
BEGUN = "twenty- thirty- forty- fifty- sixty- seventy- eighty- ninety-".split()
SPANS = "year years month months week weeks day days hour hours minute minutes second seconds".split()
SPANS_SHORT = "y mo wk wks d h hr hrs min s sec".split()
CHAPTERS = "chapter chapters chap section sect".split()
CHAPTERS_SHORT = ["chap.", "ch.", "sec."]
ABBREVIATIONS = [["e.g", "eg", "i.e", "ie", "vs", "etc", "et al"], ["Dr", "Drs", "Mr", "Mrs", "Ms", "Prof"], ["M.D", "MD", "M.A", "MA", "M.S", "MS", "Bsc", "MSc"], ["Blvd", "St", "Ste"]]
LATIN = [
    "in vitro", "in vivo", "in situ", "ex situ", "per se", "ad hoc", "de novo", "a priori", "de facto", "status quo", "a posteriori", "ad libitum", "ad lib",
    "supra", "verbatim", "cf.", "ibid", "id.",
]
SUPERSCRIPTS = "Paco2 Pco2 Sao2 o2max Cao2 Spo2 Pvo2 o2 Fio2 PIO2 Vo2 Pao2 Pio2 PAo2 Po2".split()
BLOOD_GAS = "Paco2 Pco2 Sao2 Spo2 Fio2 Pao2 Po2".split()
GREEK_NAMES = "alpha beta gamma delta epsilon zeta theta eta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
GREEK_SIGNS = "αβγδεζηθικλμνξοπρσςτυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩµ"
COMPARED = ["less than", "greater than", "equal to", "approximately"]
PERIODS = ["times", "century", "centuries", "decade", "fold"]


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def whole(words: list[str]) -> str:
    return rf"\b{any_of(words)}\b"


PATTERNS = [
    ("units", rf"\b[0-9]+\sper\s{any_of(UNIT_PER)}\b"),
    ("metric", any_of(METRIC)),
    ("time_abbr", r"\b(?:a\.?m\.?|p\.?m\.?|a\.?d\.?|b\.?c\.?e?\.?|c\.?e\.?)\b"),
    ("pressure", r"p\s[=><-]+\s[0-9]+(?:\.[0-9]+)?"),
    ("pressure", r"p\s≤"),
    ("pressure", r"p[=><]|[=><]p"),
    ("pressure", r"p\s[=><]"),
    ("pressure", r"p\s≤\s\?\s\d+(?:\.\d+)?"),
    ("pressure", r"p≥\s\?\s\d+(?:\.\d+)?"),
    ("pressure", r"p\s≥\s\?\s\d+(?:\.\d+)?"),
    ("pressure", r"p\s[-=><]\s\?\s\d+(?:\.\d+)?"),
    ("pressure", r"p\s[-=><]\s\?\s\d+"),
    ("medical", whole(MEDICAL)),
    ("percent", r"percent|per cent|percentage|%"),
    ("numbers_1000", r"\b\d{4,}\b"),
    ("numbers_0_99", r"\b\d{1,2}\b"),
    ("number_words", whole(["zero", *NUMBERS, *BEGUN, *ENDED])),
    ("duration", rf"\b\d+[- ]?{any_of(SPANS)}\b"),
    ("duration", rf"\b\d+[- ]?{any_of(SPANS_SHORT)}\b"),
    ("duration", rf"\b{any_of(NUMBERS)}[- ]?{any_of(SPANS)}\b"),
    ("duration", rf"\b{any_of(NUMBERS)}[- ]?{any_of(SPANS_SHORT)}\b"),
    ("chapter", whole(CHAPTERS)),
    ("chapter", rf"\b{any_of(CHAPTERS_SHORT)}"),
    *[("abbreviations", whole(words)) for words in ABBREVIATIONS],
    ("latin", whole(LATIN)),
    ("superscript", whole(SUPERSCRIPTS)),
    ("greek", whole(GREEK_NAMES)),
    ("greek", f"[{GREEK_SIGNS}]"),
    ("ranges", r"[0-9]+\.[0-9]+-[0-9]+\.[0-9]+"),
    ("ranges", r"[0-9]+-[0-9]+"),
    ("ranges", r"[0-9]+\s*-\s*[0-9]+"),
    ("ranges", r"[0-9]+--[0-9]+"),
    ("ranges", r"[0-9]+\s–\s[0-9]+"),
    ("ranges", r"[0-9]+–[0-9]+"),
    ("ranges", r"[0-9]+\s—\s[0-9]+"),
    ("ranges", r"[0-9]+—[0-9]+"),
    ("ranges", r"[0-9]+\s+to\s+[0-9]+"),
    ("degrees", r"\b\d{1,3}-degree angle\b"),
    ("degrees", r"\b\d{1,3}\sdegree angle\b"),
    ("degrees", r"\b\d{1,3}\s?°\s?angle\b"),
    ("degrees", r"\b\d{1,3}\s?°\b"),
    ("degrees", r"\b\d+\s?°F\b"),
    ("degrees", r"\b\d+\s?°C\b"),
    ("degrees", r"°F"),
    ("degrees", r"°C"),
    ("degrees", r"\b\d+\sdegree\b"),
    ("xray", r"\bx-?ray\b"),
    ("blood_gas", whole(BLOOD_GAS)),
    ("trademark", r"[™®©]"),
    ("versus", r"\b(?:vs\.?|versus|v\.?)\b"),
    ("special", r"[§¶†‡]"),
    ("figure_table", r"\b(?:Figure|Table)\s*\d+"),
]
SIGNS = [
    ("comparison", r"[<>=≥≤≈]"),
    *[("comparison", whole([w])) for w in COMPARED],
    ("math", r"[-+×÷]"),
    *[("time_period", whole([w])) for w in PERIODS],
    ("time_period", r"\b\d+-fold\b"),
]

#: What a match of a pattern holds or begins near, found in one search: digits with what may tie them to the next ones, signs, words.
DIGITS = r"\d+(?:\s*[-–—]+\s*|\s+to\s+)?"
TRIGGERS = onepass.Triggers(
    words=(
        *MEDICAL, "zero", *NUMBERS, *CHAPTERS, *CHAPTERS_SHORT, *[w for words in ABBREVIATIONS for w in words], *LATIN, *SUPERSCRIPTS, *GREEK_NAMES,
        "am", "a.m", "pm", "p.m", "ad", "a.d", "bc", "b.c", "ce", "c.e", "xray", "x-ray", "vs", "versus", "v",
        *[n + s for n in NUMBERS for s in (*SPANS, *SPANS_SHORT)],
    ),
    inside=(*METRIC, "percent", "per cent"),
    shapes=(DIGITS, f"[=><≤≥%°™®©§¶†‡{GREEK_SIGNS}]"),
    forms=(r"(?=[FfTt])\b(?i:figure|table)\s*(?=\d)",),
)
SIGN_TRIGGERS = onepass.Triggers(words=(*COMPARED, *PERIODS), shapes=(r"\d+-fold", r"[-<>=≥≤≈+×÷]"))
SCRIPTS = [
    ("Chinese", "一", "鿿", "cyan"), ("Greek", "Ͱ", "Ͽ", "cyan"), ("Cyrillic", "Ѐ", "ӿ", "magenta"), ("Hebrew", "֐", "׿", "green"),
    ("Arabic", "؀", "ۿ", "blue"), ("Arabic", "ݐ", "ݿ", "blue"), ("Devanagari", "ऀ", "ॿ", "red"),
    ("Japanese", "぀", "ゟ", "darkMagenta"), ("Japanese", "゠", "ヿ", "darkMagenta"), ("Korean", "가", "힯", "darkMagenta"),
    ("Thai", "฀", "๿", "darkRed"), ("Currency", "₠", "⃏", "darkBlue"),
]
#: Names of colours and what Word calls them; no highlight is none, any other name yellow.
WORD_COLOURS = {
    "nohighlight": None, "black": "black", "blue": "blue", "turquoise": "cyan", "brightgreen": "green", "pink": "magenta", "red": "red", "yellow": "yellow",
    "white": "white", "darkBlue": "darkBlue", "teal": "darkCyan", "darkGreen": "darkGreen", "darkMagenta": "darkMagenta", "darkRed": "darkRed",
    "darkYellow": "darkYellow", "lightGray": "lightGray", "darkGray": "darkGray", "cyan": "cyan", "green": "green", "magenta": "magenta",
}
SKIPPED_STYLES = ["REF-N", "REF-U"]
INSTRUCTIONS = ["Refer", "Insert", "Pick-up", "pickup", "See", "COMP", "AU", "AQ", "SPU", "Compositor", "Ph", "Photo", "video", "images"]
INSTRUCTION = rf"(?i)\b(?:{'|'.join(INSTRUCTIONS)})\b\s+(?:\S+)"


def word_colour(name: Column) -> Column:
    """Word's name of a colour; null for no highlight, yellow for names that are not known."""
    names = F.create_map(*[F.lit(x) for k, v in WORD_COLOURS.items() if v for x in (k, v)])
    return F.when(name == "nohighlight", F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(names, name), F.lit("yellow")))


def group_counts(docs: DataFrame, patterns: list[tuple[str, str]], triggers: onepass.Triggers) -> DataFrame:
    """(pattern_group, n): matches of each group's patterns over all documents, summed before the shuffle."""
    places = onepass.pattern_places(docs, [], "text", patterns, triggers)
    return places.groupBy("pattern_group").agg(F.count("*").alias("n"))


def not_skipped(paras: DataFrame) -> DataFrame:
    """Paragraphs but for those of reference styles; one without a style stays."""
    return paras.where(F.col("style").isNull() | ~F.col("style").isin(SKIPPED_STYLES))


def marked_places(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, colour, why, start, end): every place that is marked and what for, in code points of the paragraph from 0.

    Terms and signs are cyan where the paragraph's style is not a reference's; scripts have their own colours everywhere.
    """
    keys, plain = ["doc_id", "para_no"], not_skipped(paras)
    terms = onepass.pattern_places(plain, keys, "text", PATTERNS, TRIGGERS).unionByName(onepass.pattern_places(plain, keys, "text", SIGNS, SIGN_TRIGGERS))
    ranges = "".join(f"{a}-{z}" for _, a, z, _ in SCRIPTS)
    scripts = onepass.pattern_places(paras, keys, "text", [(f"{k} {c}", f"[{a}-{z}]+") for k, a, z, c in SCRIPTS], onepass.Triggers(shapes=(f"[{ranges}]+",), gated=False))
    colour, why = F.split_part("pattern_group", F.lit(" "), F.lit(2)), F.split_part("pattern_group", F.lit(" "), F.lit(1))
    return terms.select(*keys, F.lit("cyan").alias("colour"), F.col("pattern_group").alias("why"), "start", "end").unionByName(scripts.select(*keys, colour.alias("colour"), why.alias("why"), "start", "end"))


def highlights(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, colour, groups): what is marked in each paragraph and why; text without matches gives no row."""
    return marked_places(paras).groupBy("doc_id", "para_no", "colour").agg(F.array_join(F.sort_array(F.collect_set("why")), ",").alias("groups"))


def highlight_spans(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, colour, start, end): the marked places, overlapping ones of a colour joined."""
    return T.merged_spans(marked_places(paras), ["doc_id", "para_no", "colour"])


def instructions(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, instruction): each keyword of an instruction with the word after it."""
    return paras.select("doc_id", "para_no", F.explode(F.regexp_extract_all("text", F.lit(INSTRUCTION), F.lit(0))).alias("instruction"))


def around(text: Column, start: Column, end: Column, words: int = 5) -> Column:
    """A place of a text with the words around it: to the `words`-th word start before and word end after (0-based code points)."""
    before, after = F.substring(text, F.lit(1), start), F.substr(text, end + 1)
    lead = F.regexp_extract(before, rf"(?:\S+\s+){{0,{words - 1}}}\S*$", 0)
    return F.concat(lead, F.substr(text, start + 1, end - start), F.regexp_extract(after, rf"^\S*(?:\s+\S+){{0,{words - 1}}}\s?", 0))


def free_runs(runs: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The runs (keys, run_no, ...) outside every range of comments or changes, whose marks (keys, run_no, step) open by 1 and close by -1."""
    steps = marks.groupBy(*keys, "run_no").agg(F.sum("step").alias("step"), F.max((F.col("step") > 0).cast("int")).alias("opens"))
    order = W.partitionBy(*keys).orderBy("run_no").rowsBetween(W.unboundedPreceding, 0)
    both = runs.join(steps, [*keys, "run_no"], "left").withColumn("open", F.sum(F.coalesce("step", F.lit(0))).over(order))
    return both.where((F.col("open") <= 0) & (F.coalesce("opens", F.lit(0)) == 0)).drop("open", "step", "opens")


def italic_segments(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run_no, part_no, text, colour): italic runs cut at points, commas, colons and semicolons, which are cyan.

    Runs that are all one sign or have none are left as they are and give no rows.
    """
    parts = F.regexp_extract_all("text", F.lit("[.,:;]|[^.,:;]+"), F.lit(0))
    cut = runs.where("italic").select(*keys, "run_no", parts.alias("parts")).where(F.size("parts") > 1)
    each = cut.select(*keys, "run_no", F.posexplode("parts").alias("part_no", "text"))
    return each.withColumn("colour", F.when(F.col("text").rlike("^[.,:;]$"), "cyan"))
