import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdigris.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_lengths(n):
    got = packing.lengths(n, 4096)
    assert sum(got) == n and got == sorted(got, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 4096 for x in got)
    assert len(got) == n // 4096 + bin(n % 4096).count("1")


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["", "  ", "\n\na\n", "It's DON'T they'LL x1y22 ¿qué? «ça» naïve ÀÉß é", "İstanbul ΑΣ Σ <|endoftext|>x <| 漢字 🙂 ﬁ ªº µ ½ x²", "a b\x1cc\tz...,,!?", "word " * 500]
    for text, got in zip(texts, packing.token_ids(texts, PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_round_trip(docs, clashing, empty):
    rows = packing.decompose(docs, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] == len(r["ids"]) // 4 == 1 << r["bucket"] and r["offset"] == 0 for r in rows)
    want = sorted(packing.token_ids([r["text"] or ""], PATH)[0] + b"\2\0\0\0" for r in docs.collect())
    texts, last = [], None
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            texts.append(b"")
        assert len(texts[-1]) == 4 * r["start"]
        texts[-1] += r["ids"]
    assert sorted(texts) == want
    assert packing.decompose(clashing, PATH).count() == len(rows)
    assert packing.decompose(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.decompose(docs, PATH, longest=3000)


def test_buckets_are_folders(spark, docs, tmp_path):
    pieces = packing.decompose(docs, PATH)
    packing.write_buckets(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == pieces.count()
    assert back.filter(F.col("length") != F.expr("shiftleft(1L, bucket)")).count() == 0


def test_words_of_all_texts_are_learnt_at_once(monkeypatch):
    ids = packing._Ids(PATH)
    calls = []
    learn = packing._Ids._learn
    monkeypatch.setattr(packing._Ids, "_learn", lambda self, new: (calls.append(sorted(new)), learn(self, new))[1])
    got = ids.of(["one two!!", "two!! three", "ß \u0130 x", ""])
    assert calls == [sorted(["one", "two!!", "three", "ß", "\u0130", "x"])]
    want = [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in ("one two!!", "two!! three", "ß \u0130 x", "")]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert ids.of(["three one"]) and len(calls) == 1
    ids.forget()
    assert list(ids.words) == [""] and len(ids.parts) == 1
