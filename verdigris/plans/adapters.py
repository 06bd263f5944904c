"""Sample tables as normalised tables: the SQL runs on Spark and, with another date function, elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris import schemas

SPARK_DAY, OTHER_DAY = "date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"

#: One execution for each event; a run is a calendar day.
EXECUTIONS = """
SELECT event_id AS id, {day} AS run_id, concat('user-', user_id) AS name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'passed' END AS status,
  value AS duration_ms,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('src/mod', user_id % 10, '.test.ts') END AS file_path,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4
    WHEN 0 THEN concat('Timeout of ', 1000 + event_id % 9000, 'ms exceeded for request id=', event_id)
    WHEN 1 THEN concat('expected status 200 but got ', 500 + user_id % 4, ' at /app/src/mod', user_id % 10, '.ts:', event_id % 97 + 1)
    WHEN 2 THEN concat('TypeError: cannot read property k', user_id % 7, ' of undefined')
    ELSE '' END END AS error_message,
  CAST(0 AS INT) AS retry_count, FALSE AS flaky
FROM {events}
"""

RUNS = """
SELECT id, CASE WHEN CAST(substr(id, 9, 2) AS INT) % 2 = 0 THEN 'main' ELSE 'feature' END AS branch, concat('c-', id) AS commit_sha,
  CAST(NULL AS {text}) AS ci_provider, 'vitest' AS framework, concat(id, 'T00:00:00+00:00') AS started_at,
  CASE WHEN id < latest THEN concat(id, 'T23:00:00+00:00') END AS finished_at, CASE WHEN id < latest THEN 'finished' ELSE 'running' END AS status,
  total, passed, failed, CAST(total - passed - failed AS INT) AS skipped, duration_ms, CAST(NULL AS {text}) AS synced_at
FROM (SELECT day AS id, max(day) OVER () AS latest, total, passed, failed, duration_ms FROM (
  SELECT {day} AS day, CAST(count(*) AS INT) AS total,
    CAST(sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) AS INT) AS passed,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) AS failed,
    CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS duration_ms
  FROM {events} GROUP BY 1) d) r
"""

#: Coverage of a run for each order, by its lines.
COVERAGE = """
SELECT o_orderkey AS id, o_orderpriority AS run_id, 'lcov' AS format,
  CAST(sum(floor(l_quantity * (1 - l_discount))) AS INT) AS lines_covered, CAST(sum(l_quantity) AS INT) AS lines_total,
  CAST(count(*) AS INT) AS branches_covered, CAST(2 * count(*) AS INT) AS branches_total,
  CAST(0 AS INT) AS functions_covered, CAST(0 AS INT) AS functions_total, {day} AS created_at
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate
"""

#: Lines of orders in a fixed order, as cases and as covered files.
LINES = """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS n,
  concat('part-', l_partkey) AS name, concat('supplier-', l_suppkey) AS owner, CAST(l_quantity AS INT) AS ms,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status, concat('expected line ', l_linenumber) AS message,
  concat('src/part-', l_partkey) AS path, CAST(CAST(l_quantity AS INT) % 4 + 1 AS INT) AS total, CAST(CAST(l_quantity AS INT) % 3 + 1 AS INT) AS hit
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXECUTIONS.replace("{day}", SPARK_DAY), events=table(spark, sf_dir, "events")).select(*schemas.TEST_EXECUTIONS.names)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS.replace("{day}", SPARK_DAY).replace("{text}", "STRING"), events=table(spark, sf_dir, "events")).select(*schemas.TEST_RUNS.names)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = SPARK_DAY.replace("ts", "o_orderdate", 1)
    return spark.sql(COVERAGE.replace("{day}", day), orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out by order ahead of the numbering, so that grouping by ``doc`` needs no further exchange
    return spark.sql(LINES, lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))


def _other(sql: str, day: str = OTHER_DAY) -> str:
    for name in ("events", "orders", "lineitem"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{day}", day).replace("{text}", "VARCHAR").strip()


WITH = f"WITH te AS ({_other(EXECUTIONS)}), tr AS ({_other(RUNS)})"
WITH_COVERAGE = f"WITH cov AS ({_other(COVERAGE, OTHER_DAY.replace('ts', 'o_orderdate', 1))})"
WITH_LINES = f"WITH ln AS ({_other(LINES)})"
