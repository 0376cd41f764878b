"""Language-model scores of documents by context mixing, in total bits per byte.

A document is its kind (its language, by the function words it holds most, or none), its words (A-Z in lower case) and
one end. Mixers of hashed-context bit predictors (mixing.py) code it:

- The flow codes for each word, and for the end, a class: words by how frequent they are in the kind (by powers of 4),
  down to 1 / 65536 of all words, or rare. Its contexts run across words: the place in the text, the classes of the one
  and two words before, the word before itself.
- Which frequent word of its class comes is coded by a third mixer (`mixed_words`): a Huffman path for each class of a kind, under the class and
  under the word before. Without it the words' frequencies tell.
- Rare words fall into smaller classes by how often the kind has them, never being one (the escape). A word that no
  training document has is spelt byte by byte, by contexts of up to 5 bytes within the word and its kind. What the
  spelling would give to words that are known is taken out, so that nothing is lost on them.

Each step is a distribution. Classes' shares are learnt with each word itself taken out once (a word seen once stands
for those never seen), and mixers likewise. Words, their frequencies and the events of the flow are counted over every
training document by Spark and joined back; they grow with the input. Only words of over 1 / 65536 of all, which are
65536 at most, go to every task. Slots follow the number of distinct words up to a bound, as tables go to every task.

Edge cases: null and empty texts are a kind and an end. With nothing to learn from, every bit costs one bit.
A null id counts as the empty text when held-out documents are chosen. Equal rows each keep their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, written
from .mixing import ODD, PASS, U32, Code, Events, Mixer, learn_model, stirred
from .words import by_word, slices, split_words, sum_over_words, with_kinds, word_counts

# Frequent function words of each language, those of several in the first.
LANGUAGES = [
    "the of and in to that is was for on with as it at by be this from or an are".split(),
    "la le les et des une du est dans pour il ne sur par pas qui ou".split(),
    "der die das und ist von zu den mit sich ein nicht auf für".split(),
    "el los de que en un por con para las del se una no".split(),
]
KINDS = len(LANGUAGES) + 1

#: A word is frequent from this share of all words on; classes of frequent words are powers of 4 below 1.
SHARE_BITS = 16
END, RARE, BEGIN = 0, SHARE_BITS // 2 + 2, SHARE_BITS // 2 + 3
SYMBOLS = RARE + 1
#: Classes of rare words in a kind: never seen anywhere, seen in other kinds only, then by powers of 2.
NOVEL, ELSEWHERE, RARE_CLASSES = 0, 1, 64
#: Rare words that a kind's shares count as when a document's own are added.
URN = 4.0

SPELL_ORDERS = (2, 3, 4, 5)
FLOW_PREDICTORS, WORD_PREDICTORS = 5, 2
#: Events that a task holds before it passes them on.
HELD_EVENTS = 1 << 21
#: Bounds of the slots that go to tasks for each predictor.
SPELL_BITS, FLOW_BITS, WORD_BITS = (12, 20), (12, 19), (12, 20)


def kinds(offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> np.ndarray:
    """The language of each text whose words it holds most of, ties to the first; KINDS - 1 if it holds none."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    votes = np.zeros((KINDS, n), np.int64)
    for k, own in enumerate(LANGUAGES):
        is_own = pc.is_in(words, value_set=pa.array(own)).to_numpy(zero_copy_only=False)
        votes[k] = np.bincount(text[is_own[codes]], minlength=n)
    return np.where(votes.max(0) > 0, votes.argmax(0), KINDS - 1)


def slot_bits(rows: int, bounds: tuple[int, int]) -> int:
    """Bits of as many slots as rows, within bounds."""
    return min(max(int(rows).bit_length(), bounds[0]), bounds[1])


# --- spelling ---------------------------------------------------------------------------------------


def lettered(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the kind's digit and the bytes of each word, with a blank after each."""
    raw = words.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    starts = at - at[0] + np.arange(len(at))
    flat = np.full(starts[-1], 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(len(raw)), np.diff(at))] = data
    return flat, starts


def spelled(words: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, contexts, bytes, word of each byte, number that only bytes in equal contexts share) for runs of words of about PASS bytes."""
    at = 0
    while at < len(words):
        to = at + 1 + int(np.searchsorted(np.cumsum(pc.binary_length(words[at : at + PASS]).to_numpy()), PASS))
        to = min(to, at + PASS, len(words))
        flat, starts = lettered(words[at:to])
        place = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
        h, contexts = flat[np.repeat(starts[:-1], np.diff(starts))].astype(U32), []
        # In 59 bits the place, as far as contexts reach, the kind, the byte and the bytes before it.
        alike = np.minimum(place, max(SPELL_ORDERS) + 1) << 16 | h.astype(np.int64) << 8 | flat
        for k in range(1, max(SPELL_ORDERS) + 1):
            prior = np.zeros(len(flat), U32)
            prior[k:] = flat[:-k]
            alike = alike << 8 | np.where(place > k, prior, 0)
            prior[place <= k] = 256
            h = stirred((h ^ (prior + U32(1))) * ODD)
            if k in SPELL_ORDERS:
                contexts.append(h + U32(k))
        said = place > 0  # the kind itself is given
        yield slice(at, to), np.stack(contexts)[:, said], flat[said].astype(np.int64), np.repeat(np.arange(to - at), np.diff(starts))[said], alike[said]
        at = to


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where one of each of the different values stands, which of these each value is)."""
    same = pa.array(values).dictionary_encode().indices.to_numpy()
    first = np.empty(int(same.max(initial=-1)) + 1, np.int64)
    first[same] = np.arange(len(same))
    return first, same


def spelled_events(b: pa.RecordBatch) -> Iterator[Events]:
    for _, contexts, symbols, _, alike in spelled(b.column("word")):
        first, same = distinct(alike)
        yield contexts[:, first], symbols[first], np.bincount(same, minlength=len(first))


def spell_log10(words: pa.Array, mixer: Mixer) -> np.ndarray:
    """The log10 probability that each word is spelt so, after its kind."""
    out = np.zeros(len(words))
    for run, contexts, symbols, word, alike in spelled(words):
        first, same = distinct(alike)
        out[run] = np.bincount(word, mixer.log10(contexts[:, first], symbols[first])[same], run.stop - run.start)
    return out


def byte_code(words: DataFrame) -> Code:
    """The code of bytes, by how often distinct words have them."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.bincount(lettered(b.column("word"))[0], minlength=256)
            yield pa.record_batch({"symbol": np.arange(256), "n": n})

    total = np.ones(256, np.int64)
    for r in words.mapInArrow(tally, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        total[r["symbol"]] += r["n"]
    return Code(total)


def spelling(known: DataFrame) -> Mixer:
    """The mixer learnt from distinct words, as a new word shares its letters with words and not with how often they occur."""
    rows = known.select("word", F.xxhash64("word").alias("key"))
    size = known.count()
    return learn_model(rows, spelled_events, byte_code(known), len(SPELL_ORDERS), slot_bits(size, SPELL_BITS), size)


# --- the flow of classes ------------------------------------------------------------------------------

# A token's surroundings in 32 bits: the word before (17), the classes of the one and two before (4, 4), the place (4), the kind (3).
PREV, CLASS_1, CLASS_2, PLACE, KIND = U32(0x1FFFF), U32(0xF << 17), U32(0xF << 21), U32(0xF << 25), U32(0x7 << 29)
VIEWS = [KIND | PLACE, KIND | CLASS_1, KIND | CLASS_1 | CLASS_2, KIND | CLASS_1 | PREV, KIND | CLASS_1 | CLASS_2 | PREV]


class Frequent:
    """The frequent words with their classes, at most 2**SHARE_BITS of them."""

    def __init__(self, words: pa.Array, classes: np.ndarray, apart: np.ndarray):
        self.words = words
        self.classes = np.append(classes, RARE)
        self.apart = np.append(apart, RARE)  # the class with an occurrence taken out

    def flow(self, kind: np.ndarray, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, surroundings, class, class with this occurrence taken out, place from 1 on among the frequent words or 0) of each word and end."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), len(self.words)).to_numpy().astype(np.int64)[codes]
        n = np.diff(offsets) + 1
        stops = np.cumsum(n)
        text = np.repeat(np.arange(len(kind)), n)
        place = np.arange(len(text)) - np.repeat(stops - n, n)
        is_word = np.ones(len(text), bool)
        is_word[stops - 1] = False
        own, apart, index = np.full(len(text), END), np.full(len(text), END), np.zeros(len(text), np.int64)
        own[is_word], apart[is_word] = self.classes[at], self.apart[at]
        index[is_word] = np.where(at < len(self.words), at + 1, 0)
        packed = np.minimum(np.log2(place + 1).astype(np.int64), 15) << 25 | kind.astype(np.int64)[text] << 29
        for back, shift in ((1, 17), (2, 21)):
            prior = np.full(len(text), BEGIN)
            prior[back:] = own[:-back]
            packed |= np.where(place >= back, prior, BEGIN) << shift
        packed[1:] |= np.where(place[1:] > 0, index[:-1], 0)
        return text, packed.astype(U32), own, apart, index


def views(packed: np.ndarray) -> np.ndarray:
    """The contexts of surroundings: a hash for each predictor."""
    return np.stack([stirred(stirred(((packed & v) + U32(k)) * ODD)) for k, v in enumerate(VIEWS)])


def each_once(event: np.ndarray, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The value of each event, worked out once for equal ones."""
    coded = pa.array(event).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    runs = (distinct[at : at + PASS] for at in range(0, len(distinct), PASS))
    return np.concatenate([np.zeros(0), *map(value, runs)])[coded.indices.to_numpy()]


def flow_events(b: pa.RecordBatch) -> Iterator[Events]:
    event, times = b.column("event").to_numpy(), b.column("n").to_numpy()
    for at in range(0, len(event), PASS):
        own = event[at : at + PASS]
        yield views((own & 0xFFFFFFFF).astype(U32)), own >> 32, times[at : at + PASS].astype(np.int64)


def flow_counts(docs: DataFrame, train: str, frequent: Frequent, mixed_words: bool = False) -> DataFrame:
    """(event, n): how often each class follows each surroundings in training documents; an event is class << 32 | surroundings.

    With `mixed_words` those of frequent words too (word_events), from WORD on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def hold(event: np.ndarray) -> None:
            event, n = np.unique(event, return_counts=True)
            held.append((event, n.astype(np.int32)))

        def together() -> pa.RecordBatch:
            event, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(event, kind="stable")
            event, n = event[order], n[order]
            first = np.flatnonzero(np.diff(event, prepend=-1))
            return pa.record_batch({"event": event[first], "n": np.add.reduceat(n, first, dtype=np.int64)})

        for b in (part for whole in batches for part in slices(whole)):
            offsets, codes, words = split_words(b.column("text"), lower=True)
            kind = kinds(offsets, codes, words)
            codes, words = with_kinds(kind, offsets, codes, words)
            _, packed, _, apart, index = shared.value.flow(kind, offsets, codes, words)
            hold(apart << 32 | packed.astype(np.int64))
            if mixed_words:
                hold(WORD + followed(packed, index)[1])
            if sum(len(e) for e, _ in held) > HELD_EVENTS:
                yield together()
        if held:
            yield together()

    return docs.where(F.expr(train)).select("text").mapInArrow(tally, "event long, n long").groupBy("event").agg(F.sum("n").alias("n"))


def flow_model(events: DataFrame) -> Mixer:
    """The mixer of classes; events and their contexts are as bounded as the frequent words are."""
    total, size = np.ones(SYMBOLS, np.int64), 0
    for r in events.groupBy(F.shiftright("event", 32).alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("events")).collect():
        total[r["symbol"]] += r["n"]
        size += r["events"]
    rows = events.select("event", "n", F.xxhash64("event").alias("key"))
    return learn_model(rows, flow_events, Code(total), FLOW_PREDICTORS, slot_bits(size, FLOW_BITS), size)


# --- frequent words within their classes --------------------------------------------------------------------

#: What is added to events of words, to tell them from those of classes.
WORD = 1 << 62


def followed(packed: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, event) for each frequent word: its place from 0 on (17 bits) and that of the word before from 1 on (17)."""
    token = np.flatnonzero(index)
    return token, (index[token] - 1) << 17 | (packed[token] & PREV).astype(np.int64)


def word_contexts(event: np.ndarray) -> np.ndarray:
    """A hash for each predictor: none but the class (which the nodes of its tree tell), and the word before."""
    prior = (event & int(PREV)).astype(U32)
    return np.stack([stirred(stirred((x + U32(k)) * ODD)) for k, x in enumerate((np.zeros_like(prior), prior))])


def word_events(b: pa.RecordBatch) -> Iterator[Events]:
    event, times = b.column("event").to_numpy(), b.column("n").to_numpy()
    for at in range(0, len(event), PASS):
        own = event[at : at + PASS] - WORD
        yield word_contexts(own), own >> 17, times[at : at + PASS].astype(np.int64)


def word_model(events: DataFrame, counts: np.ndarray, groups: np.ndarray) -> Mixer:
    """The mixer of frequent words, each told within its group (its kind and class)."""
    rows = events.select("event", "n", F.xxhash64("event").alias("key"))
    size = events.count()
    return learn_model(rows, word_events, Code(counts, groups), WORD_PREDICTORS, slot_bits(size, WORD_BITS), size)


# --- documents -------------------------------------------------------------------------------------------


def kind_of() -> Column:
    """The kind that a word begins with."""
    return F.substring("word", 1, 1).cast("int")


def _class(c: Column, in_all: Column, least: float, total: int) -> Column:
    """The class of a kind's word that occurs c times in it and in_all times in all kinds: frequent ones from 65 on."""
    frequent = F.lit(65) + F.least(F.floor(F.log2(F.lit(float(max(total, 1))) / c) / 2), F.lit(SHARE_BITS // 2))
    rare = F.lit(ELSEWHERE + 1) + F.floor(F.log2(c))
    return F.when(c >= least, frequent).when(c > 0, rare).when(in_all > 0, ELSEWHERE).otherwise(NOVEL).cast("int")


class Shares:
    """What each class of words weighs, from the few sums (kind, cls, apart, n, weight, in_all, spelt)."""

    def __init__(self, rows: list, total: int):
        mass, apart = np.zeros((KINDS, 80)), np.zeros((KINDS, 80))
        others, unspelt = np.full(KINDS, float(total)), np.ones(KINDS)
        for r in rows:
            mass[r["kind"], r["cls"]] += r["weight"]
            apart[r["kind"], r["apart"]] += r["n"]
            others[r["kind"]] -= r["in_all"]
            unspelt[r["kind"]] -= r["spelt"]
        rare = apart[:, :RARE_CLASSES] + 0.5
        rare[:, ELSEWHERE] *= others > 0
        rare[:, ELSEWHERE + 1 :] *= mass[:, ELSEWHERE + 1 : RARE_CLASSES] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            #: log10 of a class's share over its words' weight, by which a word's own weight is multiplied.
            self.scale = -np.log10(mass)
            self.scale[:, ELSEWHERE], self.scale[:, NOVEL] = -np.log10(others), -np.log10(np.maximum(unspelt, 1e-6))
            seldom = rare[:, ELSEWHERE + 1 :].sum(1, keepdims=True)
            self.scale[:, ELSEWHERE + 1 : RARE_CLASSES] += np.log10(rare[:, ELSEWHERE + 1 :] / seldom)
        #: Shares of rare words that are new, of other kinds and seldom.
        self.urn = np.column_stack([rare[:, NOVEL], rare[:, ELSEWHERE], seldom]) / rare.sum(1, keepdims=True)
        self.scale[~np.isfinite(self.scale)] = 0.0  # classes without words

    def log10(self, cls: Column, weight: Column, in_all: Column, spelt: Column) -> Column:
        """The log10 probability of a word after its class in the flow."""
        scale = F.element_at(F.array(*map(F.lit, self.scale.ravel().tolist())), kind_of() * self.scale.shape[1] + cls + 1)
        return scale + F.when(cls == NOVEL, spelt).when(cls == ELSEWHERE, F.log10(in_all)).otherwise(F.log10(weight))


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers, by Stirling's series eight places up."""
    y = x + 8
    up = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - up


def urn_log10(counts: list[Column], shares: np.ndarray, kind: Column) -> Column:
    """The log10 probability of a row of draws, with these counts of each sort, from the urn of its kind."""
    of_kind = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), kind.cast("int") + 1)
    drawn = sum(counts[1:], counts[0])
    out = _log_gamma(F.lit(URN)) - _log_gamma(drawn + F.lit(URN))
    for k, n in enumerate(counts):
        first = of_kind(np.maximum(URN * shares[:, k], 1e-9))
        out += F.when(n > 0, _log_gamma(first + n) - _log_gamma(first)).otherwise(0.0)
    return out / F.lit(float(np.log(10)))


def score(docs: DataFrame, mixed_words: bool = False) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each document.

    Documents with crc32(doc_id as text) mod 10 = 0 are held out; the others are learnt from. base_score is
    the smoothed frequency model's log10 probability, score the mixers'. `mixed_words`: which frequent word of its class
    comes is coded by a mixer too, not told by frequencies.
    """
    sc = docs.sparkSession.sparkContext
    held = "crc32(coalesce(cast(doc_id as string), '')) % 10 = 0"
    counts = written(word_counts(docs, lower=True, train=f"NOT {held}", kinds=kinds), "words")
    bare, is_end = F.substring("word", 2, 1 << 30), F.col("word").endswith("\n")

    # The base: tokens of all kinds, an end for each text.
    n = F.col("n_train")
    of_kinds = counts.groupBy(kind_of().alias("kind")).agg(F.sum(F.when(is_end, n)).alias("texts"), F.count_if(~is_end & (n == 1)).alias("once"), F.sum(n).alias("all"))
    found = {r["kind"]: (r["texts"] or 0, r["once"], r["all"]) for r in of_kinds.collect()}
    learnt, once, tokens = (np.array([found.get(k, (0, 0, 0))[i] for k in range(KINDS)]) for i in range(3))
    all_n, texts_n = int(tokens.sum()), int(learnt.sum())
    n_words = all_n - texts_n

    # Words, with what all kinds have of them, and their spellings.
    words = counts.where(~is_end)
    mixer = sc.broadcast(spelling(words.where("n_train > 0")))
    of_bare = W.partitionBy("bare")
    joined = words.withColumn("bare", bare).withColumn("in_all", F.sum("n_train").over(of_bare)).withColumn("first", F.row_number().over(of_bare.orderBy("word")) == 1).drop("bare")
    least = max(1.0, n_words / (1 << SHARE_BITS))
    spelt = by_word(joined, lambda own: {"spelt": spell_log10(own, mixer.value)}, "spelt double")
    cls, apart = (_class(F.col("n_train") - k, F.col("in_all") - k, least, n_words) for k in (0, 1))
    valued = written(spelt.withColumn("cls", cls).withColumn("apart", apart), "spelt")
    mixer.destroy()
    # A word weighs its occurrences and what its spelling would get of as many as words seen once.
    chance = F.pow(F.lit(10.0), "spelt")
    weight = F.col("n_train") + F.element_at(F.array(*map(F.lit, once.tolist())), kind_of() + 1) * (F.col("in_all") / F.lit(float(max(n_words, 1))) + chance) / 2
    seen = valued.where("n_train > 0")
    sums = seen.groupBy(kind_of().alias("kind"), "cls", "apart").agg(
        F.sum("n_train").alias("n"), F.sum(weight).alias("weight"), F.sum("in_all").alias("in_all"), F.sum(chance).alias("spelt")
    )
    shares = Shares(sums.collect(), n_words)
    v = valued.where("first AND in_all > 0").count() + int(texts_n > 0)

    # The flow.
    head = seen.where("cls > 64").select("word", "cls", "apart", "n_train").orderBy("word").toArrow().combine_chunks()
    symbol = lambda c: (lambda x: np.where(x > 64, x - 64, RARE))(head.column(c).to_numpy().astype(np.int64))
    frequent = Frequent(head.column("word").combine_chunks(), symbol("cls"), symbol("apart"))
    events, words_model = written(flow_counts(docs, f"NOT {held}", frequent, mixed_words), "flow"), None
    if mixed_words:
        own_kind = pc.cast(pc.utf8_slice_codeunits(frequent.words, 0, 1), pa.int64()).to_numpy()
        words_model = word_model(events.where(F.col("event") >= WORD), head.column("n_train").to_numpy(), own_kind * SYMBOLS + frequent.classes[:-1])
    flow = sc.broadcast((frequent, flow_model(events.where(F.col("event") < WORD)), words_model))

    def flow_log10(kind: np.ndarray, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> np.ndarray:
        frequent, model, words_model = flow.value
        text, packed, own, _, index = frequent.flow(kind, offsets, codes, words)
        out = np.bincount(text, each_once(own << 32 | packed.astype(np.int64), lambda e: model.log10(views((e & 0xFFFFFFFF).astype(U32)), e >> 32)), len(kind))
        if words_model is not None:
            token, event = followed(packed, index)
            out += np.bincount(text[token], each_once(event, lambda e: words_model.log10(word_contexts(e), e >> 17)), len(kind))
        return out

    share = lambda c: F.log10((c + F.lit(0.1)) / F.lit(all_n + 0.1 * (v + 1)))
    lm = shares.log10(F.col("cls"), weight, F.col("in_all"), F.col("spelt"))
    if mixed_words:
        lm = F.when(F.col("cls") > 64, 0.0).otherwise(lm)
    values = {
        "known": (F.col("in_all") > 0).cast("double"),
        "elsewhere": (F.col("cls") == ELSEWHERE).cast("double"),
        "seldom": F.col("cls").between(ELSEWHERE + 1, RARE_CLASSES - 1).cast("double"),
        "base": share(F.col("in_all")),
        "lm": lm,
    }
    each_word = written(valued.select("word", "n", *[c.alias(name) for name, c in values.items()]), "valued")
    each = sum_over_words(docs, each_word, list(values), lower=True, kinds=kinds, of_text=flow_log10)
    kind_log10 = np.log10((learnt + 1) / (texts_n + KINDS))
    sorts = [F.greatest(F.round(c), F.lit(0.0)) for c in (F.col("n_words") - F.col("known"), F.col("elsewhere"), F.col("seldom"))]
    urn = urn_log10(sorts, shares.urn, F.col("kind"))
    total = F.col("lm") + F.col("of_text") + urn + F.element_at(F.array(*map(F.lit, kind_log10.tolist())), F.col("kind").cast("int") + 1)
    return each.select(
        "doc_id",
        F.expr(held).alias("held_out"),
        "n_bytes",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.round("known").cast("long") + F.lit(int(texts_n > 0))).alias("n_known"),
        F.lit(all_n).cast("long").alias("train_tokens"),
        (F.col("base") + share(F.lit(texts_n))).alias("base_score"),
        total.alias("score"),
        (-total * F.lit(float(np.log2(10))) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
