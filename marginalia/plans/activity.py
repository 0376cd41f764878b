"""The activity store: users, files, validation results and macro jobs, and the dashboards over them.

customer stands for users, orders for files, lineitem for validation results, events for macro jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import store
from marginalia.plans.sqlquery import query, run_sql, twin

USERS = "users AS (SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role, c_nationkey AS nation FROM {customer})"
FILES = "files AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS upload_date, concat('report_', cast(o_orderkey AS string), '.docx') AS report_filename FROM {orders})"
RESULTS = "validation_results AS (SELECT l_orderkey AS file_id, count(*) AS total_references, cast(sum(l_linenumber) AS bigint) AS total_citations FROM {lineitem} GROUP BY l_orderkey)"
JOBS = "macro_processing AS (SELECT event_id AS id, user_id, ts AS processing_date, event_type AS route_type, props AS selected_tasks FROM {events})"

HISTORY = f"""
WITH {USERS}, {FILES}, {RESULTS}, {JOBS},
history AS (
  SELECT f.id, f.upload_date AS date, f.report_filename, v.total_references, v.total_citations, u.username,
         'validation' AS type, '' AS route_type, '' AS selected_tasks, f.user_id
  FROM files f LEFT JOIN validation_results v ON f.id = v.file_id JOIN users u ON f.user_id = u.id
  UNION ALL
  SELECT m.id, m.processing_date, '', 0, 0, u.username, 'macro', m.route_type, m.selected_tasks, m.user_id
  FROM macro_processing m JOIN users u ON m.user_id = u.id)"""
ALL_ACTIVITY = "activity AS (SELECT id, user_id, upload_date AS date, 'validation' AS type, '' AS route_type FROM files UNION ALL SELECT id, user_id, processing_date, 'macro', route_type FROM macro_processing)"

#: The routes that the dashboards know; of each, zeros are shown too.
ROUTES = "routes AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('error'), ('technical'), ('credit')) AS r(route_type))"
#: Who may use a route, roles in upper case.
ACL = "acl AS (SELECT * FROM (VALUES ('click', 'BUILDING'), ('click', 'MACHINERY'), ('view', 'AUTOMOBILE'), ('purchase', 'HOUSEHOLD'), ('error', 'FURNITURE')) AS a(route_type, role))"

SQL = {
    "src01_table_lookup": f"WITH {USERS} SELECT * FROM users WHERE id = 42",
    "prj01_equality_filter": f"WITH {USERS}, {JOBS} SELECT m.id, m.user_id, m.route_type FROM macro_processing m WHERE m.route_type = 'click' AND m.user_id = 7",
    "prj03_tagged_projection": f"WITH {FILES} SELECT id, user_id, 'validation' AS type, '' AS token, '' AS route_type, 0 AS total_citations FROM files",
    "prj04_month_range": f"WITH {FILES} SELECT id, user_id, upload_date AS date FROM files WHERE upload_date >= TIMESTAMP '1996-01-01 00:00:00' AND upload_date < TIMESTAMP '1996-07-01 00:00:00'",
    "prj05_owned_report_exists": f"WITH {USERS}, {FILES} SELECT u.id, u.username FROM users u WHERE EXISTS (SELECT 1 FROM files f WHERE f.user_id = u.id AND f.report_filename LIKE 'report_1%')",
    "prj06_role_acl": f"WITH {USERS}, {ACL} SELECT u.id, a.route_type FROM users u JOIN acl a ON upper(u.role) = a.role OR u.id % 500 = 0",
    "prj07_null_fallback": f"WITH {USERS} SELECT id, coalesce(nullif(CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN NULL ELSE role END, ''), 'USER') AS role FROM users",
    "prj08_token_expiry": f"WITH {JOBS} SELECT id, CASE WHEN id % 5 = 0 THEN TRUE ELSE processing_date + INTERVAL 1 HOUR < TIMESTAMP '2024-01-02 00:00:00' END AS expired FROM macro_processing",
    "prj16_unique_username": f"WITH {USERS} SELECT id, username, role FROM users WHERE username = 'Customer#000000042'",
    "jn01_file_user": f"WITH {USERS}, {FILES} SELECT f.id, u.username, f.upload_date AS date FROM files f JOIN users u ON f.user_id = u.id",
    "jn02_file_result_user": f"WITH {USERS}, {FILES}, {RESULTS} SELECT f.id, u.username, v.total_references, v.total_citations FROM files f LEFT JOIN validation_results v ON f.id = v.file_id JOIN users u ON f.user_id = u.id",
    "jn03_user_totals": f"WITH {USERS}, {FILES}, {JOBS} SELECT u.username, (SELECT count(*) FROM files f WHERE f.user_id = u.id) + (SELECT count(*) FROM macro_processing m WHERE m.user_id = u.id) AS total_count FROM users u",
    "agg01_table_counts": f"WITH {USERS}, {FILES}, {RESULTS}, {JOBS} SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM validation_results) AS total_validations, (SELECT count(*) FROM macro_processing) AS total_macro",
    "agg02_known_route_counts": f"WITH {JOBS}, {ROUTES} SELECT r.route_type, count(m.id) AS n FROM routes r LEFT JOIN macro_processing m ON m.route_type = r.route_type GROUP BY r.route_type",
    "agg03_user_route_counts": f"WITH {JOBS}, {ROUTES}, own AS (SELECT * FROM macro_processing WHERE user_id = 7) SELECT r.route_type, count(m.id) AS n FROM routes r LEFT JOIN own m ON m.route_type = r.route_type GROUP BY r.route_type",
    "agg04_role_counts": f"WITH {USERS} SELECT role, count(*) AS n FROM users GROUP BY role",
    "agg07_route_counts": f"WITH {JOBS} SELECT coalesce(nullif(route_type, ''), 'unknown') AS route_type, count(*) AS n FROM macro_processing GROUP BY coalesce(nullif(route_type, ''), 'unknown')",
    "agg09_daily_routes": f"WITH {JOBS} SELECT cast(processing_date AS date) AS day, route_type, count(*) AS n FROM macro_processing GROUP BY cast(processing_date AS date), route_type",
    "agg13_user_stats": f"WITH {FILES}, {RESULTS} SELECT f.user_id, cast(sum(total_references) AS bigint) AS total_references, cast(sum(total_citations) AS bigint) AS total_citations, bool_and(total_references = total_citations) AS is_perfect FROM files f JOIN validation_results v ON v.file_id = f.id GROUP BY f.user_id",
    "srt01_recent_five": f"WITH {FILES} SELECT id, user_id, upload_date AS date FROM files ORDER BY upload_date DESC, id DESC LIMIT 5",
    "srt02_recent_activity": HISTORY + " SELECT id, date, username, type, route_type FROM history ORDER BY date DESC, type, id DESC LIMIT 20",
    "srt03_history_page": HISTORY + " SELECT id, date, username, type, total_references FROM history ORDER BY date DESC, type, id DESC LIMIT 10 OFFSET 20",
    "srt04_page_count": f"WITH {FILES} SELECT user_id, count(*) AS n, cast(ceil(count(*) / 10.0) AS bigint) AS pages FROM files GROUP BY user_id",
    "srt05_users_by_total": f"WITH {USERS}, {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT u.id AS user_id, count(a.id) AS total FROM users u LEFT JOIN activity a ON a.user_id = u.id GROUP BY u.id ORDER BY total DESC, user_id",
    "srt09_user_listing": f"WITH {USERS} SELECT id, username, role FROM users ORDER BY id DESC",
    "set01_history": HISTORY + " SELECT * FROM history",
    "set02_history_count": f"WITH {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT count(*) AS total_records FROM activity WHERE type = 'macro' AND route_type = 'click'",
    "set03_recent_union": f"WITH {USERS}, {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT a.id, a.date, u.username, a.type, a.route_type FROM activity a JOIN users u ON a.user_id = u.id",
    "set04_activity_dates": f"WITH {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT user_id, date FROM activity",
    "snk03_role_update": f"WITH {USERS} SELECT id, username, CASE WHEN id % 10 = 3 THEN 'ADMIN' ELSE role END AS role FROM users",
    "snk04_user_delete": f"WITH {USERS}, {FILES} SELECT f.id, f.user_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = f.user_id AND u.role = 'MACHINERY')",
    "snk15_new_users": f"WITH {USERS} SELECT s_suppkey AS id, s_name AS username FROM {{supplier}} s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.username = replace(s.s_name, 'Supplier', 'Customer') AND u.id % 2 = 0)",
    "snk17_admin_upsert": f"WITH {USERS} SELECT id, username, role FROM users WHERE username <> 'admin' UNION ALL SELECT cast(0 AS bigint), 'admin', 'ADMIN'",
}

#: Filters of the history as a request gives them; empty ones are left out.
REQUESTS = [{"type": "macro", "route_type": "view", "user_id": 12, "is_admin": True}, {"type": "", "route_type": "", "user_id": None, "is_admin": False, "owner": 7}, {"type": "validation", "user_id": 3, "is_admin": True}]


def filtered_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history under each request's filters, composed of those it has; all conditions reach both sides of the union."""
    out = None
    for i, request in enumerate(REQUESTS):
        rows = store.composed_filter(run_sql(spark, sf_dir, HISTORY + " SELECT id, type, route_type, user_id FROM history"), **request)
        own = rows.withColumn("request", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def results_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose file is not deleted: an anti join on the file's id."""
    results = run_sql(spark, sf_dir, f"WITH {RESULTS} SELECT file_id, total_references FROM validation_results")
    gone = run_sql(spark, sf_dir, f"WITH {FILES} SELECT id AS file_id FROM files WHERE user_id % 3 = 0")
    return results.join(gone, "file_id", "left_anti")


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"WITH {USERS}, {JOBS} SELECT m.id, m.processing_date, u.username, m.route_type, m.selected_tasks FROM macro_processing m JOIN users u ON u.id = m.user_id")
    return rows.select("id", store.audit_line(*map(F.col, ("processing_date", "username", "route_type", "selected_tasks"))).alias("line"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of allowed kinds under safe names: paths, blanks and odd signs in them."""
    rows = run_sql(spark, sf_dir, """SELECT p_partkey AS id, concat(CASE p_size % 4 WHEN 0 THEN '../' WHEN 1 THEN 'C:\\\\x\\\\' ELSE ' ' END, p_name, CASE p_size % 3 WHEN 0 THEN '.docx' WHEN 1 THEN ' (1).DOC' ELSE '.exe' END) AS name FROM {part}""")
    return rows.where(store.is_allowed(F.col("name"))).select("id", store.safe_name(F.col("name")).alias("stored_filename"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey AS id, concat('f', o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '_processed.docx' WHEN 2 THEN '.tmp' ELSE '.DOCX' END) AS name FROM {orders}")
    return rows.where(store.is_download(F.col("name")))


MONTHS = ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05", "2024-06"]


def month_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each user in each of six months; the months are a range, which reaches the scans."""
    rows = run_sql(spark, sf_dir, f"WITH {USERS}, {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT u.username, a.date FROM activity a JOIN users u ON a.user_id = u.id")
    inside = rows.where((F.col("date") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("date") < F.lit("2024-07-01").cast("timestamp_ntz")))
    return inside.select("username", F.date_format("date", "yyyy-MM").alias("month"))


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_activity(spark, sf_dir).groupBy("username", "month").agg(F.count("*").alias("n"))


def month_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user, a column for each month, zeros where nothing happened."""
    wide = month_activity(spark, sf_dir).groupBy("username").pivot("month", MONTHS).count()
    users = run_sql(spark, sf_dir, f"WITH {USERS} SELECT username FROM users")
    return users.join(wide, "username", "left").select("username", *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias("m" + m.replace("-", "_")) for m in MONTHS])


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in each route's JSON error arrays; what is no array counts nothing."""
    errors = "CASE WHEN event_id % 5 = 0 THEN 'oops' WHEN event_id % 7 = 0 THEN props ELSE concat('[', cast(event_id AS string), ',2]') END"
    rows = run_sql(spark, sf_dir, f"SELECT event_type AS route_type, {errors} AS errors FROM {{events}}")
    return rows.groupBy("route_type").agg(F.sum(F.coalesce(F.json_array_length("errors"), F.lit(0))).cast("long").alias("n_errors"))


def job_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task object of each job, read from JSON."""
    rows = run_sql(spark, sf_dir, "SELECT event_id AS id, props FROM {events}")
    return rows.select("id", F.from_json("props", "k bigint")["k"].alias("k"))


def formatted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT event_id AS id, ts FROM {events}")
    return rows.select("id", F.date_format("ts", "MMM dd, yyyy hh:mm a").alias("shown"))


ACTIVITY = f"WITH {USERS}, {FILES}, {JOBS}, {ALL_ACTIVITY} SELECT u.username, strftime(a.date, '%Y-%m') AS month FROM activity a JOIN users u ON a.user_id = u.id WHERE a.date >= TIMESTAMP '2024-01-01' AND a.date < TIMESTAMP '2024-07-01'"
QUERIES = {k: query(v) for k, v in SQL.items()} | {
    "prj02_dynamic_filter": filtered_history,
    "jn04_results_left_after_delete": results_left,
    "snk14_audit_line": audit_lines,
    "src20_upload_intake": uploads,
    "prj17_download_filter": downloads,
    "agg05_month_activity": month_counts,
    "agg06_month_pivot": month_pivot,
    "agg08_error_counts": error_counts,
    "fn15_format_date": formatted_dates,
    "fn15_job_tasks": job_tasks,
}
ORACLES = {k: twin(v).replace("AS string)", "AS varchar)") for k, v in SQL.items()} | {
    "prj02_dynamic_filter": """WITH h AS (SELECT o_orderkey AS id, 'validation' AS type, '' AS route_type, o_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT event_id, 'macro', event_type, user_id FROM events JOIN customer ON c_custkey = user_id)
SELECT *, 0 AS request FROM h WHERE type = 'macro' AND route_type = 'view' AND user_id = 12 UNION ALL SELECT *, 1 FROM h WHERE user_id = 7 UNION ALL SELECT *, 2 FROM h WHERE type = 'validation' AND user_id = 3""",
    "jn04_results_left_after_delete": "SELECT l_orderkey AS file_id, count(*) AS total_references FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 3 = 0) GROUP BY l_orderkey",
    "snk14_audit_line": "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - ' || c_name || ' - ' || event_type || ' - ' || props AS line FROM events JOIN customer ON c_custkey = user_id",
    "src20_upload_intake": "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 'C_x_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '.docx' ELSE '_1.DOC' END AS stored_filename FROM part WHERE p_size % 3 < 2",
    "prj17_download_filter": "SELECT o_orderkey AS id, 'f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '_processed.docx' ELSE '.DOCX' END AS name FROM orders WHERE o_orderkey % 4 <> 2",
    "agg05_month_activity": twin(f"SELECT username, month, count(*) AS n FROM ({ACTIVITY}) GROUP BY username, month"),
    "agg06_month_pivot": twin("SELECT c_name AS username, " + ", ".join(f"count(*) FILTER (WHERE month = '{m}') AS m{m.replace('-', '_')}" for m in MONTHS) + f" FROM customer LEFT JOIN ({ACTIVITY}) a ON a.username = c_name GROUP BY c_name"),
    "agg08_error_counts": "SELECT event_type AS route_type, cast(sum(CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE 2 END) AS bigint) AS n_errors FROM events GROUP BY event_type",
    "fn15_format_date": "SELECT event_id AS id, strftime(ts, '%b %d, %Y %I:%M %p') AS shown FROM events",
    "fn15_job_tasks": "SELECT event_id AS id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events",
}
