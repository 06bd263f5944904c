"""Registered queries of the test analytics and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import sql
from verdigris.functions import scalars
from verdigris.operators import clusters, compare, durations, flaky, health, payload, retention, tables
from verdigris.plans import adapters, render
from verdigris.plans.adapters import WITH, WITH_COVERAGE, WITH_LINES
from verdigris.sources import coverage as coverage_readers
from verdigris.sources import ignore, json_tests, xml_tests
from verdigris.sources.registry import DEFAULT_PATTERNS, with_defaults
from verdigris.sources.reports import with_percentages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    """Register a query by its function's name, with the SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapters.executions(spark, sf_dir), adapters.runs(spark, sf_dir)


LAST = "(SELECT id FROM tr WHERE status = 'finished' ORDER BY started_at DESC, id DESC LIMIT 20)"
HISTORY = f"SELECT te.*, tr.started_at FROM te JOIN tr ON te.run_id = tr.id WHERE tr.id IN {LAST}"
FLAKY = f"""{WITH}, h AS ({HISTORY}), s AS (SELECT *, lag(status) OVER (PARTITION BY name ORDER BY started_at, id) AS before FROM h WHERE status IN ('passed', 'failed')),
g AS (SELECT name, coalesce(arg_max(file_path, concat(started_at, lpad(CAST(id AS VARCHAR), 12, '0'))) FILTER (file_path <> ''), '') AS file_path, count(*) FILTER (status <> before) AS flip_count, count(*) AS total_runs, count(*) FILTER (status = 'failed') AS failures, max(started_at) FILTER (status <> before) AS last_flipped_at FROM s GROUP BY name)"""
FLAKY_ROWS = "SELECT name AS test_name, file_path, flip_count / (total_runs - 1) AS flip_rate, flip_count, total_runs, round(least(1.0, 0.4 * (flip_count / (total_runs - 1)) + 0.4 * (failures / total_runs)) * 100) / 100 AS composite_score, last_flipped_at FROM g WHERE total_runs >= 5 AND flip_count / (total_runs - 1) >= 0.1"


@query(f"{FLAKY} {FLAKY_ROWS}")
def flaky_tests(spark, sf_dir):
    return flaky.flaky_tests(*_both(spark, sf_dir))


@query(f"{WITH}, h AS ({HISTORY}) SELECT id, run_id, name, status, duration_ms, coalesce(file_path, '') AS file_path, coalesce(error_message, '') AS error_message, started_at FROM h")
def history_window(spark, sf_dir):
    return tables.ordered_history(*_both(spark, sf_dir)).select("id", "run_id", "name", "status", "duration_ms", "file_path", "error_message", "started_at")


def _percentile(p: int) -> str:
    at = f"(CAST({p / 100} AS DOUBLE) * (len(l) - 1))"
    low, high = (f"l[CAST({f}({at}) AS INT) + 1]" for f in ("floor", "ceil"))
    return f"round(({low} + ({high} - {low}) * ({at} - floor({at}))) * 100) / 100 AS p{p}"


@query(f"{WITH} SELECT run_id, {', '.join(map(_percentile, durations.PERCENTILES))}, round(mean * 100) / 100 AS mean FROM (SELECT run_id, list(duration_ms ORDER BY duration_ms) AS l, avg(duration_ms) AS mean FROM te GROUP BY run_id) x")
def duration_percentiles_by_run(spark, sf_dir):
    return durations.percentiles(adapters.executions(spark, sf_dir))


@query(f"{WITH}, r AS (SELECT *, round(cume_dist() OVER (PARTITION BY run_id ORDER BY duration_ms) * 100 * 100) / 100 AS percentile, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, name, id) AS rank FROM te) SELECT run_id, CAST(rank AS INT) AS rank, name AS test_name, file_path, round(duration_ms * 100) / 100 AS duration_ms, percentile FROM r WHERE rank <= 10")
def slowest_tests_by_run(spark, sf_dir):
    return durations.slowest(adapters.executions(spark, sf_dir))


@query(f"{WITH} SELECT run_id, id, round(cume_dist() OVER (PARTITION BY run_id ORDER BY duration_ms) * 100 * 100) / 100 AS percentile FROM te")
def percentile_rank(spark, sf_dir):
    return durations.ranked(adapters.executions(spark, sf_dir)).select("run_id", "id", "percentile")


PREVIOUS = "SELECT id, total, passed, lag(CASE WHEN total > 0 THEN greatest(0.0, least(100.0, passed / total * 100 * 0.6 + 100 * 0.3 + 0.1 * 50)) END) OVER (ORDER BY started_at, id) AS previous_score FROM tr WHERE status = 'finished'"
HEALTH = f"""{FLAKY}, f AS (SELECT count(*) AS n FROM g WHERE total_runs >= 5 AND flip_count / (total_runs - 1) >= 0.1), p AS ({PREVIOUS}),
b AS (SELECT p.*, 0.6 * (passed / total * 100) + 0.3 * (100 - n / total * 100) AS base FROM p, f WHERE total > 0),
t AS (SELECT *, round(greatest(0.0, least(100.0, base + 5.0))) AS neutral FROM b),
u AS (SELECT *, CASE WHEN neutral - previous_score > 2 THEN 'improving' WHEN neutral - previous_score < -2 THEN 'declining' ELSE 'stable' END AS trend FROM t),
v AS (SELECT id, trend, previous_score, round(greatest(0.0, least(100.0, base + CASE trend WHEN 'improving' THEN 10.0 WHEN 'declining' THEN 0.0 ELSE 5.0 END))) AS score FROM u)
SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS label, trend, round(previous_score * 1000000) / 1000000 AS previous_score FROM v"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) * 1000000) / 1000000 for n in names})


@query(HEALTH)
def health_by_run(spark, sf_dir):
    return _rounded(health.by_run(*_both(spark, sf_dir)), "previous_score")


@query(f"{HEALTH} WHERE id = (SELECT id FROM tr WHERE status = 'finished' ORDER BY started_at DESC, id DESC LIMIT 1)")
def health_latest(spark, sf_dir):
    return _rounded(health.latest(*_both(spark, sf_dir)), "previous_score")


@query(f"{WITH} SELECT id, round(previous_score * 1000000) / 1000000 AS previous_score FROM ({PREVIOUS}) p")
def previous_health_by_run(spark, sf_dir):
    return _rounded(health.previous_scores(adapters.runs(spark, sf_dir)), "previous_score")


@query(f"{WITH} SELECT id, branch, commit_sha, framework, started_at, coalesce(finished_at, started_at) AS finished_at, total, passed, failed, skipped, duration_ms FROM tr WHERE status = 'finished' ORDER BY started_at DESC, id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return tables.recent_runs(adapters.runs(spark, sf_dir))


HISTORY_ROWS = "SELECT te.id, run_id, name, te.status, te.duration_ms, error_message, branch, commit_sha, started_at FROM te JOIN tr ON run_id = tr.id"
FAILURE_ROWS = "SELECT te.id, run_id, name, file_path, error_message, te.duration_ms, branch, started_at FROM te JOIN tr ON run_id = tr.id"


@query(f"{WITH} {HISTORY_ROWS} WHERE lower(name) LIKE '%user-1%' ORDER BY started_at DESC, te.id DESC LIMIT 50")
def test_history_search(spark, sf_dir):
    return tables.test_history(*_both(spark, sf_dir), "User-1")


@query(f"{WITH} {FAILURE_ROWS} WHERE te.status = 'failed' AND (lower(name) LIKE '%timeout%' OR lower(error_message) LIKE '%timeout%') ORDER BY started_at DESC, te.id DESC LIMIT 50")
def failure_search(spark, sf_dir):
    return tables.search_failures(*_both(spark, sf_dir), "TIMEOUT")


#: Names with an underscore, a percent sign or neither, so that a wildcard would find more than the sign itself.
WITH_SIGNED = WITH.replace("concat('user-', user_id) AS name", "concat('user', CASE event_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '%' ELSE '-' END, user_id) AS name")


@query(f"{WITH_SIGNED} {HISTORY_ROWS} WHERE contains(lower(name), 'user_1') ORDER BY started_at DESC, te.id DESC LIMIT 50")
def search_literal_wildcards(spark, sf_dir):
    te, tr = _both(spark, sf_dir)
    signed = F.when(F.col("id") % 3 == 0, F.replace("name", F.lit("-"), F.lit("_"))).when(F.col("id") % 3 == 1, F.replace("name", F.lit("-"), F.lit("%"))).otherwise(F.col("name"))
    return tables.test_history(te.withColumn("name", signed), tr, "User_1")


@query(f"{WITH} SELECT run_id, status, count(*) AS n FROM te GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return tables.status_counts(adapters.executions(spark, sf_dir))


@query(f"{WITH} SELECT run_id, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) - count(*) FILTER (status IN ('passed', 'failed')) AS skipped, round(sum(duration_ms)) AS duration_ms FROM te GROUP BY run_id")
def run_summary(spark, sf_dir):
    return tables.run_summary(adapters.executions(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms"))


@query(f"{WITH} SELECT branch, id, started_at, total, passed, failed, skipped, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY started_at DESC, id DESC) AS k FROM tr WHERE status = 'finished' AND total IS NOT NULL) x WHERE k = 1")
def latest_run_per_branch(spark, sf_dir):
    return tables.latest_per_branch(adapters.runs(spark, sf_dir))


PAIRS = "p AS (SELECT * FROM (SELECT c.id AS run_id, b.id AS baseline_run_id, c.total, c.passed, c.duration_ms, b.total AS base_total, b.passed AS base_passed, b.duration_ms AS base_duration, row_number() OVER (PARTITION BY c.id ORDER BY b.started_at DESC, b.id DESC) AS k FROM tr c JOIN tr b ON c.id <> b.id WHERE c.status = 'finished' AND b.status = 'finished' AND b.branch = 'main' AND b.total IS NOT NULL) x WHERE k = 1)"
STATUS = "st AS (SELECT run_id, name, arg_max(status, id) AS status FROM te GROUP BY 1, 2)"


@query(f"""{WITH}, {PAIRS}, {STATUS} SELECT * FROM (SELECT p.run_id, p.baseline_run_id, n.name, CASE WHEN n.status = 'failed' AND o.status = 'failed' THEN 'pre_existing' WHEN n.status = 'failed' THEN 'new' WHEN o.status = 'failed' THEN 'fixed' END AS kind
FROM p JOIN st n ON n.run_id = p.run_id LEFT JOIN st o ON o.run_id = p.baseline_run_id AND o.name = n.name) x WHERE kind IS NOT NULL""")
def compare_to_baseline(spark, sf_dir):
    te, tr = _both(spark, sf_dir)
    return compare.changes(te, compare.baselines(tr, "main"))


@query(f"{WITH}, {PAIRS} SELECT run_id, baseline_run_id, round((passed / total * 100 - base_passed / base_total * 100) * 1000000) / 1000000 AS pass_rate_delta, round((duration_ms - base_duration) * 10000) / 10000 AS duration_delta, total - base_total AS total_delta FROM p")
def comparison_deltas(spark, sf_dir):
    found = compare.deltas(compare.baselines(adapters.runs(spark, sf_dir), "main"))
    return found.withColumns({"pass_rate_delta": F.round(F.col("pass_rate_delta") * 1000000) / 1000000, "duration_delta": F.round(F.col("duration_delta") * 10000) / 10000})


@query(f"""{WITH}, {PAIRS}, {STATUS}, k AS (SELECT p.run_id, n.name, n.status = 'failed' AS now, coalesce(o.status = 'failed', FALSE) AS old FROM p JOIN st n ON n.run_id = p.run_id LEFT JOIN st o ON o.run_id = p.baseline_run_id AND o.name = n.name)
SELECT run_id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (now AND NOT old), '') AS new_failures, coalesce(string_agg(name, '|' ORDER BY name) FILTER (old AND NOT now), '') AS fixed, coalesce(string_agg(name, '|' ORDER BY name) FILTER (old AND now), '') AS pre_existing_failures FROM k GROUP BY run_id""")
def comparison_lists(spark, sf_dir):
    found = compare.compare(*_both(spark, sf_dir), "main")
    return found.select("run_id", *[F.array_join(c, "|").alias(c) for c in ("new_failures", "fixed", "pre_existing_failures")])


@query(f"{WITH} SELECT run_id, id, name, coalesce(file_path, '') AS file_path, coalesce(error_message, '') AS error_message, duration_ms FROM te WHERE status = 'failed'")
def failed_tests_for_run(spark, sf_dir):
    return tables.failed_tests(adapters.executions(spark, sf_dir))


@query(f"{WITH} SELECT run_id, name, arg_max(status, id) AS status FROM te GROUP BY 1, 2")
def last_status_per_test(spark, sf_dir):
    return tables.last_status(adapters.executions(spark, sf_dir))


#: The rewrites of error messages written anew for the SQL, so that a slip in the engine's patterns shows.
_REWRITES_BY_HAND = (
    (r"[ \t\n\v\f\r]+", " "),
    ("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "<uuid>"),
    ("[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z?", "<timestamp>"),
    ("/.+/([^/]+[.](js|jsx|ts|tsx)):[0-9]+(:[0-9]+)?", r"\1:<line>"),
    (r"\b[iI][dD][:=][ \t\n\v\f\r]*[0-9]+", "id=<id>"),
    (r"\b[0-9]{4}[0-9]*\b", "<id>"),
    ("0[xX][0-9A-Fa-f]+", "<address>"),
    ("  +", " "),
)


def _rewritten(text: str) -> str:
    for pattern, to in _REWRITES_BY_HAND:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim({text})"


@query(f"{WITH} SELECT id, {_rewritten('error_message')} AS normalized FROM te WHERE error_message IS NOT NULL")
def normalize_errors(spark, sf_dir):
    te = adapters.executions(spark, sf_dir).filter("error_message is not null")
    return te.select("id", scalars.normalize_error(F.col("error_message")).alias("normalized"))


@query(f"SELECT doc_id, {_rewritten('text')} AS normalized FROM documents")
def normalize_documents(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", scalars.normalize_error(F.col("text")).alias("normalized"))


@query(f"{WITH}, e AS (SELECT run_id, id, {_rewritten('error_message')} AS t, lag({_rewritten('error_message')}) OVER (PARTITION BY run_id ORDER BY id) AS u FROM te WHERE status = 'failed') SELECT run_id, id, levenshtein(t, u) AS distance, (t = u) OR (t <> '' AND u <> '' AND 10 * levenshtein(t, u) <= 3 * greatest(strlen(t), strlen(u))) AS similar FROM e WHERE u IS NOT NULL")
def error_similarity(spark, sf_dir):
    from pyspark.sql import Window

    te = adapters.executions(spark, sf_dir).filter("status = 'failed'").select("run_id", "id", scalars.normalize_error(F.col("error_message")).alias("t"))
    both = te.withColumn("u", F.lag("t").over(Window.partitionBy("run_id").orderBy("id"))).filter("u is not null")
    return both.select("run_id", "id", scalars.edit_distance(F.col("t"), F.col("u")).cast("bigint").alias("distance"), scalars.similar(F.col("t"), F.col("u")).alias("similar"))


LEADERS = f"""{WITH}, f AS (SELECT run_id, id, name, coalesce(file_path, '') AS file_path, {_rewritten('error_message')} AS t FROM te WHERE status = 'failed' AND trim(coalesce(error_message, '')) <> ''),
d AS (SELECT run_id, t, min(id) AS first, count(*) AS n FROM f GROUP BY 1, 2),
l AS (SELECT run_id, list_reduce(list(t ORDER BY first), lambda got, x: CASE WHEN len(list_filter(got, lambda y: y = x OR 10 * levenshtein(y, x) <= 3 * greatest(strlen(y), strlen(x)))) > 0 THEN got ELSE list_append(got, x) END, CAST([] AS VARCHAR[])) AS leaders FROM d GROUP BY run_id),
a AS (SELECT d.*, list_filter(leaders, lambda y: y = t OR 10 * levenshtein(y, t) <= 3 * greatest(strlen(y), strlen(t)))[1] AS leader FROM d JOIN l USING (run_id))
SELECT a.run_id, leader AS pattern, CAST(count(*) AS INT) AS count, min(f.id) AS first, string_agg(name, '|' ORDER BY f.id) AS test_names,
coalesce(array_to_string(list_sort(list(DISTINCT file_path) FILTER (file_path <> '')), '|'), '') AS file_paths FROM a JOIN f ON f.run_id = a.run_id AND f.t = a.t GROUP BY 1, 2"""


def _clustered(spark, sf_dir):
    return clusters.clusters(adapters.executions(spark, sf_dir).filter("status = 'failed'"))


@query(LEADERS)
def failure_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).filter("silent = 0").select("run_id", "pattern", "count", "first", *[F.array_join(c, "|").alias(c) for c in ("test_names", "file_paths")])


@query(f"{WITH}, f AS (SELECT run_id, id, name, CASE WHEN file_path = '' THEN '(unknown file)' ELSE file_path END AS file FROM te WHERE status = 'failed' AND trim(coalesce(error_message, '')) = '') SELECT run_id, concat('Failed tests in ', file, ' (no error message captured)') AS pattern, CAST(count(*) AS INT) AS count, string_agg(name, '|' ORDER BY id) AS test_names, 0.7 AS similarity FROM f GROUP BY run_id, file")
def blank_error_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).filter("silent = 1").select("run_id", "pattern", "count", F.array_join("test_names", "|").alias("test_names"), "similarity")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 500 THEN text ELSE (SELECT max(left(text, n)) FROM (SELECT unnest(generate_series(120, 500)) AS n) s WHERE strlen(left(text, n)) <= 500) END AS head FROM documents")
def truncate_documents(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", scalars.truncate_bytes(F.col("text"), 500).alias("head"))


SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("lines_covered", "lines_total", "branches_covered", "branches_total", "functions_covered", "functions_total"))


@query(f"{WITH_COVERAGE} SELECT run_id, {SUMS} FROM cov GROUP BY run_id")
def coverage_summary(spark, sf_dir):
    rows = adapters.coverage(spark, sf_dir)
    return rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c.endswith(("_covered", "_total"))])


@query(f"{WITH_COVERAGE} SELECT id, {', '.join(f'CASE WHEN {k}_total = 0 THEN 0.0 ELSE round({k}_covered / {k}_total * 100) END AS {k}_percent' for k in ('lines', 'branches', 'functions'))} FROM cov")
def coverage_percentage(spark, sf_dir):
    return with_percentages(adapters.coverage(spark, sf_dir)).select("id", "lines_percent", "branches_percent", "functions_percent")


@query(f"{WITH_COVERAGE} SELECT run_id, id, created_at, lines_covered, lines_total FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, id DESC) AS k FROM cov) x WHERE k = 1")
def coverage_latest(spark, sf_dir):
    return tables.latest_coverage(adapters.coverage(spark, sf_dir)).select("run_id", "id", "created_at", "lines_covered", "lines_total")


EXPIRED = "(SELECT id FROM tr WHERE id NOT IN (SELECT id FROM tr ORDER BY started_at DESC, id DESC LIMIT 10) AND started_at < (SELECT started_at FROM tr ORDER BY started_at DESC LIMIT 1 OFFSET 15))"


def _kept(spark, sf_dir):
    tr = adapters.runs(spark, sf_dir)
    cut = retention.ranked(tr).filter("age_rank = 16").select("started_at").first()
    return retention.survivors(tr, 10, cut["started_at"] if cut else "")


@query(f"{WITH} SELECT id, branch, started_at FROM tr WHERE id NOT IN {EXPIRED}")
def retention_survivors(spark, sf_dir):
    return _kept(spark, sf_dir).select("id", "branch", "started_at")


@query(f"{WITH} SELECT id, run_id FROM te WHERE run_id NOT IN {EXPIRED}")
def retention_cascade(spark, sf_dir):
    return retention.cascade(adapters.executions(spark, sf_dir), _kept(spark, sf_dir)).select("id", "run_id")


UPLOADS = "up AS (SELECT CAST(substr(id, 9, 2) AS BIGINT) AS id, id AS run_id, started_at AS created_at, CAST(CAST(substr(id, 9, 2) AS INT) % 7 AS INT) AS attempts FROM tr)"


def _uploads(spark, sf_dir):
    tr = adapters.runs(spark, sf_dir)
    day = F.substring("id", 9, 2).cast("bigint")
    return tr.select(day.alias("id"), F.col("id").alias("run_id"), F.lit("{}").alias("payload"), F.col("started_at").alias("created_at"), (day % 7).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"))


@query(f"{WITH}, {UPLOADS} SELECT id, run_id, attempts FROM up WHERE attempts < 5")
def pending_uploads(spark, sf_dir):
    return tables.pending(_uploads(spark, sf_dir)).select("id", "run_id", "attempts")


@query(f"{WITH}, {UPLOADS} SELECT id, CAST(attempts + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS attempts, CASE WHEN id % 3 = 0 THEN 'HTTP 500' END AS last_error FROM up")
def sync_failure_attempts(spark, sf_dir):
    up = _uploads(spark, sf_dir)
    failed = up.filter("id % 3 = 0").select("id", F.lit("HTTP 500").alias("error"))
    return payload.attempted(up, failed.union(failed)).select("id", "attempts", "last_error")


@query(f"{WITH}, {UPLOADS} SELECT tr.id, CASE WHEN up.id % 2 = 0 THEN 'now' END AS synced_at FROM tr JOIN up ON up.run_id = tr.id")
def sync_marked(spark, sf_dir):
    up = _uploads(spark, sf_dir)
    return payload.synced(up, adapters.runs(spark, sf_dir), up.filter("id % 2 = 0"), "now")[1].select("id", "synced_at")


#: Two coverage reports of each run, of which the later one counts; it has two files.
COVERED = """cov AS (SELECT CAST(10 * total + k AS BIGINT) AS id, id AS run_id, CASE k WHEN 2 THEN concat('[{"path":"b-', id, '","lines":{"covered":1,"total":2},"branches":{"covered":0,"total":0},"functions":{"covered":0,"total":0}},{"path":"a","lines":{"covered":3,"total":4},"branches":{"covered":1,"total":2},"functions":{"covered":0,"total":1}}]') END AS data,
CASE k WHEN 2 THEN 'lcov' ELSE 'jacoco' END AS format, CAST(passed * k AS INT) AS lines_covered, CAST(total * k AS INT) AS lines_total, 0 AS branches_covered, k AS branches_total, 0 AS functions_covered, 0 AS functions_total, concat(id, 'T0', k) AS created_at FROM tr CROSS JOIN (VALUES (1), (2)) AS ks(k))"""


@query(f"""{WITH}, {COVERED} SELECT tr.id AS run_id, tr.branch, tr.finished_at, tr.total, count(te.id) AS tests, md5(string_agg(te.name || ' ' || te.status || ' ' || coalesce(te.file_path, '') || ' ' || coalesce(te.error_message, '') || ' ' || te.retry_count, '|' ORDER BY te.id)) AS listed,
cov.format AS coverage_format, cov.lines_covered, cov.branches_total, CAST(2 AS BIGINT) AS covered_files, 'a' AS first_path, 'b-' || tr.id AS last_path, 3 AS first_covered
FROM tr JOIN te ON te.run_id = tr.id JOIN cov ON cov.run_id = tr.id AND cov.format = 'lcov' WHERE tr.finished_at IS NOT NULL GROUP BY ALL""")
def ingest_payload(spark, sf_dir):
    te, tr = _both(spark, sf_dir)
    rows = COVERED.replace("{", "{{").replace("}", "}}").replace("FROM tr", "FROM {tr}")
    covered = spark.sql(f"WITH {rows} SELECT * FROM cov", tr=tr)
    metric = "struct<covered: int, total: int>"
    kind = f"struct<branch: string, finishedAt: string, summary: struct<total: int>, tests: array<struct<name: string, status: string, filePath: string, error: string, retryCount: int>>, coverage: struct<format: string, lines: {metric}, branches: {metric}, files: array<struct<path: string, lines: {metric}>>>>"
    got = payload.ingest_payload(tr, te, covered).withColumn("p", F.from_json("payload", kind))
    line = F.transform("p.tests", lambda t: F.concat_ws(" ", t["name"], t["status"], F.coalesce(t["filePath"], F.lit("")), F.coalesce(t["error"], F.lit("")), t["retryCount"].cast("string")))
    files = F.col("p.coverage.files")
    return got.select(
        "run_id", F.col("p.branch").alias("branch"), F.col("p.finishedAt").alias("finished_at"), F.col("p.summary.total").alias("total"), F.size("p.tests").cast("bigint").alias("tests"), F.md5(F.array_join(line, "|")).alias("listed"),
        F.col("p.coverage.format").alias("coverage_format"), F.col("p.coverage.lines.covered").alias("lines_covered"), F.col("p.coverage.branches.total").alias("branches_total"), F.size(files).cast("bigint").alias("covered_files"),
        F.get(files, F.lit(0))["path"].alias("first_path"), F.element_at(files, -1)["path"].alias("last_path"), F.get(files, F.lit(0))["lines"]["covered"].alias("first_covered"),
    )


def _rendered(spark, sf_dir):
    """Each order's lines in one of five formats, with a file name that may or may not tell it."""
    lines = adapters.lines(spark, sf_dir)
    kinds = ((render.junit, ".xml"), (render.jest, ".json"), (render.ctrf, ".json"), (render.lcov, ".txt"), (render.cobertura, ".xml"))
    out = None
    for i, (write, suffix) in enumerate(kinds):
        files = write(lines.filter(F.col("doc") % 5 == i)).withColumn("filename", F.concat(F.lit("out/"), "doc", F.lit(suffix)))
        out = files if out is None else out.unionByName(files)
    return out


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc, CASE l_orderkey % 5 WHEN 0 THEN 'junit' WHEN 1 THEN 'jest-vitest-json' WHEN 2 THEN 'ctrf' WHEN 3 THEN 'lcov' ELSE 'cobertura' END AS id, CASE l_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 90 ELSE 95 END AS score, CASE WHEN l_orderkey % 5 < 3 THEN 'testReport' ELSE 'coverage' END AS result_type FROM lineitem")
def detect_formats(spark, sf_dir):
    return with_defaults().detect(_rendered(spark, sf_dir)).select("doc", "format.id", "format.score", "format.result_type")


def _attached(spark, sf_dir) -> None:
    sql.register(spark)
    sql.attach(spark, _rendered(spark, sf_dir), prefix="rendered_")


@query(f"""{WITH_LINES} SELECT CAST(doc AS VARCHAR) AS doc, CASE doc % 5 WHEN 0 THEN 'junit' WHEN 1 THEN 'jest-vitest-json' ELSE 'ctrf' END AS format, count(*) AS cases, count(*) FILTER (status = 'failed') AS failed,
round(count(*) FILTER (status = 'passed') / count(*) * 10000) / 100 AS rate, count(DISTINCT CASE WHEN status = 'failed' THEN message END) AS errors FROM ln WHERE doc % 5 < 3 GROUP BY doc""")
def sql_test_reports(spark, sf_dir):
    _attached(spark, sf_dir)
    return spark.sql("""
        SELECT c.doc, f.id AS format, count(*) AS cases, count_if(status = 'failed') AS failed, round2(pass_rate(count_if(status = 'passed'), count(*))) AS rate, count(DISTINCT normalize_error(error_message)) AS errors
        FROM rendered_test_cases c JOIN rendered_report_formats f ON f.doc = c.doc WHERE f.result_type = 'testReport' GROUP BY c.doc, f.id""")


@query(f"""{WITH_LINES} SELECT CASE doc % 5 WHEN 3 THEN 'lcov' ELSE 'cobertura' END AS format, path, CAST(sum(least(hit, total)) AS BIGINT) AS lines_covered, CAST(sum(total) AS BIGINT) AS lines_total,
round(sum(least(hit, total)) / sum(total) * 100) AS percent FROM ln WHERE doc % 5 > 2 GROUP BY 1, 2""")
def sql_covered_paths(spark, sf_dir):
    _attached(spark, sf_dir)
    return spark.sql("SELECT format, path, sum(lines_covered) AS lines_covered, sum(lines_total) AS lines_total, coverage_percentage(sum(lines_covered), sum(lines_total)) AS percent FROM rendered_coverage_files GROUP BY format, path")


def _cases(reports, *extra: str) -> DataFrame:
    return reports.cases.select("doc", "pos", "full_name", "status", "duration_ms", "error_message", *extra)


_DOC = "CAST(doc AS VARCHAR) AS doc"
_FAILED = "CASE WHEN status = 'failed' THEN message END AS error_message"


@query(f"{WITH_LINES} SELECT {_DOC}, n AS pos, concat(owner, ' > ', name) AS full_name, status, CAST(ms AS BIGINT) AS duration_ms, {_FAILED}, 'src/lines.test.ts' AS file_path FROM ln")
def parse_junit(spark, sf_dir):
    return _cases(xml_tests.junit(render.junit(adapters.lines(spark, sf_dir))), "file_path")


@query(f"{WITH_LINES} SELECT {_DOC}, 'junit' AS framework, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total, CAST(sum(ms) AS BIGINT) AS duration_ms FROM ln GROUP BY doc")
def junit_reports(spark, sf_dir):
    return xml_tests.junit(render.junit(adapters.lines(spark, sf_dir))).reports.select("doc", "framework", "passed", "failed", "skipped", "total", "duration_ms")


@query(f"{WITH_LINES} SELECT {_DOC}, n AS pos, concat('Shop.', owner, ' > ', name, '(1)') AS full_name, status, CAST(ms AS BIGINT) AS duration_ms, {_FAILED} FROM ln")
def parse_trx(spark, sf_dir):
    return _cases(xml_tests.trx(render.trx(adapters.lines(spark, sf_dir))))


@query(f"{WITH_LINES} SELECT {_DOC}, n - 1 AS pos, concat(owner, ' ', name) AS full_name, status, CAST(ms AS BIGINT) AS duration_ms, {_FAILED}, 'src/lines.test.ts' AS file_path FROM ln")
def parse_jest(spark, sf_dir):
    return _cases(json_tests.jest(render.jest(adapters.lines(spark, sf_dir))), "file_path")


@query(f"{WITH_LINES} SELECT {_DOC}, n AS pos, concat('lines.spec.ts > all > ', owner, CASE WHEN n % 3 = 0 THEN ' > deep' ELSE '' END, ' > ', name, CASE WHEN doc % 2 = 1 THEN ' [one]' ELSE '' END) AS full_name, status, CAST(ms AS BIGINT) AS duration_ms, {_FAILED}, CAST(n AS BIGINT) AS line, CAST(CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS INT) AS retry_attempt FROM ln")
def parse_playwright(spark, sf_dir):
    return _cases(json_tests.playwright(render.playwright(adapters.lines(spark, sf_dir))), "line", "retry_attempt")


@query(f"{WITH_LINES} SELECT {_DOC}, n - 1 AS pos, concat('all > ', owner, ' > ', name) AS full_name, status, CAST(ms AS BIGINT) AS duration_ms, {_FAILED} FROM ln")
def parse_ctrf(spark, sf_dir):
    return _cases(json_tests.ctrf(render.ctrf(adapters.lines(spark, sf_dir))))


def _files(reports, *names: str) -> DataFrame:
    return reports.files.select("doc", "path", *names)


_LINE_COUNTS = "CAST(least(hit, total) AS BIGINT) AS lines_covered, CAST(total AS BIGINT) AS lines_total"


@query(f"{WITH_LINES} SELECT {_DOC}, n + CASE WHEN doc % 4 = 0 THEN 1 ELSE 0 END AS pos, path, {_LINE_COUNTS}, CAST(1 AS BIGINT) AS branches_covered, CAST(2 AS BIGINT) AS branches_total FROM ln")
def parse_lcov(spark, sf_dir):
    return _files(coverage_readers.lcov(render.lcov(adapters.lines(spark, sf_dir))), "pos", "lines_covered", "lines_total", "branches_covered", "branches_total")


@query(f"{WITH_LINES} SELECT {_DOC}, path, CAST(sum(least(hit, total)) AS BIGINT) AS lines_covered, CAST(sum(total) AS BIGINT) AS lines_total, CAST(sum(total - least(hit, total)) AS BIGINT) AS branches_covered, CAST(sum(2 * (total - least(hit, total))) AS BIGINT) AS branches_total, count(*) FILTER (least(hit, total) > 1) AS functions_covered, count(*) AS functions_total FROM ln GROUP BY doc, path")
def parse_cobertura(spark, sf_dir):
    return _files(coverage_readers.cobertura(render.cobertura(adapters.lines(spark, sf_dir))), "lines_covered", "lines_total", "branches_covered", "branches_total", "functions_covered", "functions_total")


@query(f"{WITH_LINES}, f AS (SELECT *, CASE WHEN doc % 3 = 0 THEN 0 ELSE n END AS alone FROM ln) SELECT {_DOC}, path, CAST(sum(least(hit, total)) AS BIGINT) AS lines_covered, CAST(sum(total) AS BIGINT) AS lines_total, CAST(sum(least(hit, total)) AS BIGINT) AS functions_covered, CAST(sum(least(hit, total) + 1) AS BIGINT) AS functions_total FROM f GROUP BY doc, path, alone")
def parse_jacoco(spark, sf_dir):
    return _files(coverage_readers.jacoco(render.jacoco(adapters.lines(spark, sf_dir))), "lines_covered", "lines_total", "functions_covered", "functions_total")


@query(f"{WITH_LINES} SELECT {_DOC}, path, CAST(least(hit, total) + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lines_covered, CAST(total + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS lines_total, CAST(1 AS BIGINT) AS branches_covered, CAST(2 AS BIGINT) AS branches_total, CAST(0 AS BIGINT) AS functions_covered, CAST(1 AS BIGINT) AS functions_total FROM ln")
def parse_clover(spark, sf_dir):
    return _files(coverage_readers.clover(render.clover(adapters.lines(spark, sf_dir))), "lines_covered", "lines_total", "branches_covered", "branches_total", "functions_covered", "functions_total")


@query(f"""{WITH_LINES} SELECT {_DOC}, CAST(CASE WHEN doc % 2 = 0 THEN 1 ELSE sum(least(hit, total)) END AS BIGINT) AS lines_covered, CAST(CASE WHEN doc % 2 = 0 THEN doc ELSE sum(total) END AS BIGINT) AS lines_total,
CAST(CASE WHEN doc % 2 = 0 THEN 7 ELSE sum(2 * (total - least(hit, total))) END AS BIGINT) AS branches_total, CAST(CASE WHEN doc % 2 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS functions_total FROM ln GROUP BY doc""")
def cobertura_reports(spark, sf_dir):
    return coverage_readers.cobertura(render.cobertura(adapters.lines(spark, sf_dir))).reports.select("doc", *[F.col(c).cast("bigint").alias(c) for c in ("lines_covered", "lines_total", "branches_total", "functions_total")])


#: A path for each line of an order: a package with a folder of one kind or another.
PATHS = """
SELECT concat('pkg', l_suppkey % 7, '/', CASE l_partkey % 5 WHEN 0 THEN 'build' WHEN 1 THEN 'test-results' WHEN 2 THEN 'build/keep' WHEN 3 THEN 'src' ELSE 'out/deep' END, '/', CASE l_linenumber % 3 WHEN 0 THEN 'junit-' WHEN 1 THEN 'note-' ELSE 'result-' END, l_orderkey, CASE l_quantity % 2 WHEN 0 THEN '.xml' ELSE '.tmp' END) AS path
FROM {lineitem}
"""
RULES = {"": "# built\nbuild/\n!build/keep/\n*.tmp", "pkg3": "/out\n!*.tmp\nnote-*"}
_WITH_PATHS = f"WITH p AS (SELECT DISTINCT path, split_part(path, '/', 1) AS pkg, split_part(path, '/', 2) AS kind, string_split(path, '/')[-1] AS file FROM ({adapters._other(PATHS)}) x)"


def _ruled(spark, sf_dir):
    files = spark.createDataFrame(list(RULES.items()), "folder string, content string")
    return spark.sql(PATHS, lineitem=adapters.table(spark, sf_dir, "lineitem")), ignore.rules(files)


@query(f"{_WITH_PATHS} SELECT path FROM p WHERE kind = 'build' OR (pkg <> 'pkg3' AND file LIKE '%.tmp') OR (pkg = 'pkg3' AND (kind = 'out' OR starts_with(file, 'note-')))")
def ignored_paths(spark, sf_dir):
    return ignore.ignored(*_ruled(spark, sf_dir))


@query(f"{_WITH_PATHS} SELECT path FROM p WHERE file LIKE '%.xml' AND (starts_with(file, 'junit') OR kind = 'test-results') AND kind <> 'build' AND NOT (pkg = 'pkg3' AND kind = 'out')")
def discovered_reports(spark, sf_dir):
    return ignore.discovered(*_ruled(spark, sf_dir), DEFAULT_PATTERNS)
