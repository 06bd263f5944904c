"""Alignment of two tokenizers against whole texts tokenized at once and groups cut one token at a time."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from verdigris.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "  two\n\nlines \n", "tab\t and\r\n more", "l'été d'un çà €uro 𝄞x", "one ▁ two", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>",
       "a b   c", "\x00\x1c \x1d x", "don't they'll I'm", "x" * 3000, "word " * 500, "12345 3.14 a1b2", "日本語 テキスト", "é ́", " \u0085 end", "   "]


def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    raw_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def of(text):
        if not text:
            return None
        out = [(i, raw_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, raw_b(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return out if all(b"".join(x for _, x in side) == whole for side in out) else None

    return of


def brute(texts):
    """Numbers and groups of each text, by the contract's words."""
    of = tokens()
    found, links = [], []
    for text in texts:
        got = of(text)
        groups, linked = [], []
        if got:
            ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in got]
            common = sorted(set(ends[0]) & set(ends[1]))
            lo = 0
            for hi in common:
                groups.append([[i for (i, _), e in zip(side, at, strict=True) if lo < e <= hi] for side, at in zip(got, ends, strict=True)])
                lo = hi
            where = {e: i for (i, _), e in zip(got[1], ends[1], strict=True)}
            linked = [(i, where[e]) for (i, _), e in zip(got[0], ends[0], strict=True) if e in where]
        found.append((len(got[0]) if got else 0, len(got[1]) if got else 0, groups))
        links.append(linked)
    count = Counter(x for linked in links for x in linked)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [
        (n_a, n_b, len(g), len(x), sum(count[p] == highest[p[1]] for p in x), sum(count[p] for p in x), ";".join("|".join(",".join(map(str, side)) for side in both) for both in g))
        for (n_a, n_b, g), x in zip(found, links, strict=True)
    ]


@pytest.fixture
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]


def test_aligns_as_whole_texts_would(spark, rows):
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda rows: sorted(rows, key=str)
    want = key((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert key(map(tuple, alignment.align(texts, *PATHS).collect())) == want
    digests = alignment.align(texts, *PATHS, digest=True)
    assert digests.columns[-1] == "groups_sha256"
    assert key(map(tuple, digests.collect())) == key((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in want)
    got = sum(r["n"] for r in alignment.pair_counts(texts, *PATHS).collect())
    assert got == sum(x[4] for x in want)


def test_small_caches_change_nothing(rows, monkeypatch):
    """Workers that forget, short strings to tokenize: the same groups and counts."""
    of = alignment.Aligner(*PATHS)
    texts = [t or "" for _, t in rows]

    def groups(of):
        at, first, good = alignment._numbered(of, texts)
        return [";".join(of.text[x] for x in at[a:b]) if ok else "" for a, b, ok in zip(first, first[1:], good, strict=False)]

    want = groups(of)
    monkeypatch.setattr(alignment, "JOINED", 1)
    of.forget()
    assert groups(of) == want


def test_pairs_are_bounded_by_the_vocabularies():
    of = alignment.Aligner(*PATHS)
    of.numbers([x for t in ODD if t for x in alignment._parts(t)])
    pair, n = of.pairs(np.ones(len(of.text), np.int64))
    assert 0 < len(pair) <= of.most_pairs() < 1_000_000 and n.sum() == of.n_groups.sum()
    assert all(a.endswith(b) or b.endswith(a) for a, b in ((of.bytes_a[p >> 32], of.bytes_b[p & 0xFFFFFFFF]) for p in pair.tolist()))


def test_components_are_what_overlaps():
    a, b = alignment.components(np.array([2, 5, 6, 9]), np.array([1, 2, 4, 6, 7, 9]))
    assert a.tolist() == [0, 1, 1, 2] and b.tolist() == [0, 0, 1, 1, 2, 2]
    assert alignment.union_find(5, np.array([3, 4]), np.array([1, 3])).tolist() == [0, 1, 2, 1, 1]


def test_odd_tables(spark, clashing, empty):
    assert alignment.align(empty, *PATHS).count() == 0
    assert alignment.align(clashing, *PATHS).count() == clashing.count()
    none = spark.createDataFrame([(None, None), (None, ""), (3, None)], "doc_id bigint, text string")
    assert sorted(map(str, alignment.align(none, *PATHS, digest=True).collect())) == sorted(str(r) for r in none.selectExpr("doc_id", *[f"0L {c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], "'' groups_sha256").collect())


def test_texts_are_aligned_once(spark, rows):
    """The second pass reads the links that the first one saved, not the texts."""
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = alignment.align(texts, *PATHS)._jdf.queryExecution().toString()
    assert "links" in plan and "text#" not in plan
