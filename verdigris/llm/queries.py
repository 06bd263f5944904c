"""Registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import alignment, jaccard, lattice, licences, linerules, mixing, packing, passages, quality, ranking, scratch, search, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    taken = (F.col("mix_size") * F.col("mix_copies")).cast("bigint")
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"]).select("doc_id", "held_out", "score", "predicted", "tox_matches")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def op10_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = _table(spark, sf_dir, "documents"), scratch.place(spark)
    first = sharding.published(docs, store, 8)
    grown = sharding.edited(spark, store, lambda last, _: last.grown()).frame(spark).withColumnRenamed("shard", "grown_shard")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.numbered(sharding.assign(rows, first), ["doc_id", "text_crc32", "size"])
    return placed.join(F.broadcast(grown), "virtual_slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_mixing, op4_licences, op5_toxicity, op6_line_rules, op7_substring_dedup, op8_jaccard_join, op9_top_k, op10_slots, op11_alignment, op12_lattice, op13_ranking)}

#: Words of a text, of a line or lower-cased; a document's id is taken to be unique.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {
    "op6_line_rules": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
        worded AS (SELECT doc_id, source, t, line, {_WORDS.format("line")} AS lw FROM lines),
        normal AS (SELECT *, {_LOWER.format("array_to_string(lw, ' ')")} AS norm FROM worded WHERE len(lw) > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM normal GROUP BY doc_id),
        frequent AS (SELECT source, norm FROM normal GROUP BY source, norm HAVING count(DISTINCT t) > 5),
        gone AS (SELECT n.doc_id, sum(len(n.lw)) AS n_removed_words FROM normal n JOIN frequent f ON n.norm = f.norm AND n.source IS NOT DISTINCT FROM f.source GROUP BY n.doc_id),
        pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
        win AS (SELECT doc_id, p, CASE WHEN p + 4 <= len(w) THEN array_to_string(w[p:p + 4], ' ') END AS g FROM pos),
        hit AS (SELECT doc_id, p, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS h FROM win),
        cover AS (SELECT doc_id, p, sum(h) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS c FROM hit),
        rep AS (SELECT doc_id, sum(CAST(c AS INT)) AS n_repeat_words FROM cover GROUP BY doc_id),
        base AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN rep USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10 AND 10 * (n_words - n_removed_words) >= 3 * n_words AS kept
        FROM base""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
        win AS (SELECT doc_id, p, w[p] AS word, CASE WHEN p + 34 <= len(w) THEN sha256(array_to_string(w[p:p + 34], ' ')) END AS g FROM pos),
        hit AS (SELECT doc_id, p, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN 1 ELSE 0 END AS h FROM win),
        cover AS (SELECT doc_id, p, word, sum(h) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS c FROM hit),
        kept AS (SELECT doc_id, sum(CAST(c AS INT)) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT c) AS k FROM cover GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL""",
    "op13_ranking": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM}) AS w FROM documents),
        d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
        g AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS length FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM})) AS term FROM benchmark),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
        s AS (
            SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * documents) // length))))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN f USING (term), g GROUP BY item_id, r, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
