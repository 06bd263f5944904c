"""The pipeline's stages over rows with null ids, null and empty texts, repeated rows and further columns."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import brute as links
from tests.llm.test_passages import brute as passages
from tests.llm.test_passages import words


def stages(spark, docs, folder):
    """Each stage's rows, written and read again as its successor's input."""
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") != 45).cast("int").alias("quality")).distinct()
    labels.write.parquet(f"{folder}/labels.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_against_brute_force(spark, clashing, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "mix_sources", "pack"]
    out = stages(spark, clashing, str(tmp_path))
    for name in list(out)[:-1]:
        assert out[name].columns == clashing.columns
        assert out[name].filter("score <> 'other score' OR mix_size <> 'other mix_size' OR s_words <> 'other s_words'").count() == 0
    # rows of the classifier are rows of the input, repeated ones included
    before = Counter((r["doc_id"], r["text"]) for r in clashing.collect())
    good = Counter((r["doc_id"], r["text"]) for r in out["quality_classifier"].collect())
    assert good and all(n == before[x] for x, n in good.items())
    # one row of each component stays, and all rows without words
    rows = [(i, t) for i, (_, t) in enumerate(good.elements())]
    found = links(rows)
    wanted = len({c for _, n, c in found if n}) + sum(not n for _, n, _ in found)
    unique = [(r["doc_id"], r["text"]) for r in out["near_duplicates"].collect()]
    assert len(unique) == wanted and not Counter(unique) - good
    # words in windows that recur go; other texts stay as they are
    want = sorted((str(i), kept if gone else t or "") for (i, t), (_, gone, kept) in zip(unique, passages([t for _, t in unique], 35), strict=True))
    assert sorted((str(r["doc_id"]), r["text"]) for r in out["substring_dedup"].collect()) == want
    assert out["substring_dedup"].filter("n_chars <> length(text)").count() == 0
    # no document more than twice, each source about as long as its target
    mixed = Counter((r["doc_id"], r["text"]) for r in out["mix_sources"].collect())
    kept = Counter((r["doc_id"], r["text"]) for r in out["substring_dedup"].collect())
    assert all(n <= 2 * kept[x] for x, n in mixed.items())
    total = sum(n * len(words(t)) for (_, t), n in kept.items())
    assert abs(sum(n * len(words(t)) for (_, t), n in mixed.items()) - 1.5 * total) < 0.2 * total + 200
    # the pieces of each document put its ids together again
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in mixed.elements() for t in [t[1]])
    assert Counter(r["doc_tokens"] for r in out["pack"].filter("start = 0").collect()) == lengths
    assert out["pack"].agg(F.sum("length")).first()[0] == sum(k * n for k, n in lengths.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(k * n for k, n in lengths.items())


def test_empty_tables(spark, empty, tmp_path):
    assert all(df.count() == 0 for df in stages(spark, empty, str(tmp_path)).values())


NAMES = ("n_words", "N_Removed", "kept_text", "a.b", "text_", "column_0", "value")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_further_columns_come_out_as_they_are(spark, docs, tmp_path, stage):
    """Of names that stages use themselves, in other cases, with dots and quotes."""
    wide = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in NAMES])
    wide = wide.select(F.lit(7).alias("ahead"), "*")
    docs.filter("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("quality")).distinct().write.parquet(f"{tmp_path}/labels.parquet")
    got = stage[1](spark, wide, str(tmp_path))
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(tuple(r)[-len(NAMES) :] == tuple(f"mine {c}" for c in NAMES) and r[0] == 7 for r in rows)
