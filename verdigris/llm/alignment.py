"""Alignment of two tokenizers over whole texts.

Two tokens of one text, one by each tokenizer, overlap where their byte ranges do. Overlapping tokens are the
edges of a bipartite graph; union-find over it gives components, and these are exactly the smallest groups of
tokens that cover the same bytes. Within a component the members whose ranges end together are linked. A first
pass aligns each text and saves its links; a second one reads these alone, and weighs each by how often its pair of
ids is linked in all documents.

Both tokenizers start anew at a space after anything but white space, so a text falls into chunks there. A
task tokenizes and aligns each distinct chunk once, many chunks in one string, and puts documents together
from chunks. Pairs are counted by task before they are shuffled. Tokens that end together have bytes of which
one ends with the other, so there are no more pairs of ids than suffixes of tokens in the two vocabularies
(:meth:`Aligner.most_pairs`): the counts are sent to all tasks, however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.packing import _BYTE_LETTERS
from verdigris.llm.scratch import saved
from verdigris.llm.search import _ranges
from verdigris.llm.text import trim

#: Distinct chunks that a worker remembers; beyond that it starts anew.
CACHE_CHUNKS = 300_000
#: Bytes of text that are split and aligned at once, and characters that are tokenized in one string.
BATCH, JOINED = 4 << 20, 1 << 16

_AFTER_SPACE = re.compile(r"\s ")
_CHUNK = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def _parts(text: str) -> list[str]:
    """Chunks of a text with a space before it, each without its first space; a last space stays where it is."""
    if text[0] != " " and not _AFTER_SPACE.search(text) and text[-1] != " ":
        return text.split(" ")  # each space stands after something else
    first, *rest = _CHUNK.split(" " + text)
    return [first[1:], *rest]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with by edges ``u, v``."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the components, in the order of the text, of the tokens that end at these bytes.

    Both are ends of gapless tokens over the same bytes; tokens that overlap are connected.
    """
    start_a, start_b = (np.concatenate([[0], e[:-1]]) for e in (end_a, end_b))
    b, a = _ranges(np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left"))
    root = union_find(len(end_a) + len(end_b), a, b + len(end_a))
    _, number = np.unique(root, return_inverse=True)
    return number[: len(end_a)], number[len(end_a) :]


class Aligner:
    """Tokenizers A and B, and the distinct chunks aligned so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {chr(x): x for x in range(256) if x not in _BYTE_LETTERS} | {chr(c): x for x, c in _BYTE_LETTERS.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.forget()

    def most_pairs(self) -> int:
        """No more pairs of ids than this can be linked."""
        ids: list[dict[bytes, int]] = [{}, {}]
        for of, tokens in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            for t in tokens:
                of[t] = of.get(t, 0) + 1
        ends = lambda tokens, of, whole: sum(of.get(t[i:], 0) for t in tokens for i in range(0 if whole else 1, len(t)))
        return ends(self.bytes_a, ids[1], True) + ends(self.bytes_b, ids[0], False)

    def forget(self) -> None:
        """Drop all chunks."""
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.valid, self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(4))
        self.link_chunk, self.link_pair = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of chunks; those not seen before are aligned."""
        got = list(map(self.index.get, parts))
        if None in got:
            self._learn(list(dict.fromkeys(p for p, i in zip(parts, got, strict=True) if i is None)))
            got = list(map(self.index.__getitem__, parts))
        return np.array(got, np.int64)

    def _learn(self, new: list[str]) -> None:
        results = []
        group: list[str] = []
        size = 0
        for part in new:
            if not part or part[-1].isspace():  # it must not stand before another one
                results.append(self._aligned([part]))
                continue
            group.append(part)
            size += len(part) + 1
            if size >= JOINED:
                results.append(self._aligned(group))
                group, size = [], 0
        if group:
            results.append(self._aligned(group))
        base = len(self.text)
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for parts, text, numbers, link_chunk, link_pair in (x for r in results for x in r):
            for part in parts:
                self.index[part] = base
                base += 1
            self.text += text
            for column, x in zip(columns, (*numbers, link_chunk + (base - len(parts)), link_pair), strict=True):
                column.append(x)
        for name, column in zip(("valid", "n_a", "n_b", "n_groups", "link_chunk", "link_pair"), columns, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), *column]))

    def _aligned(self, parts: list[str]) -> list[tuple]:
        """``parts, their groups as text, (valid, n_a, n_b, n_groups), link_chunk, link_pair``, in one or more runs."""
        joined = " " + " ".join(parts)
        raw = joined.encode()
        a = self.a.encode(joined, add_special_tokens=False).ids
        b = self.b.encode(joined[1:])
        if not (b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))):
            if len(parts) > 1:
                half = len(parts) // 2
                return self._aligned(parts[:half]) + self._aligned(parts[half:])
            none = np.zeros(0, np.int64)
            return [(parts, [""], [np.zeros(1, np.int64)] * 4, none, none)]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        of_a, of_b = components(end_a, end_b)
        groups = int(of_a[-1]) + 1
        first_a, first_b = np.searchsorted(of_a, np.arange(groups + 1)), np.searchsorted(of_b, np.arange(groups + 1))
        last = np.cumsum([len(p.encode()) + 1 for p in parts]) if not raw.isascii() else np.cumsum([len(p) + 1 for p in parts])
        chunk_of_group = np.searchsorted(last, end_a[first_a[1:] - 1])
        first = np.searchsorted(chunk_of_group, np.arange(len(parts) + 1))
        # members of a component that end together
        _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        text_a, text_b = list(map(str, a)), list(map(str, b))
        fa, fb = first_a.tolist(), first_b.tolist()
        said = [f"{text_a[fa[g]] if fa[g + 1] - fa[g] == 1 else ','.join(text_a[fa[g] : fa[g + 1]])}|{text_b[fb[g]] if fb[g + 1] - fb[g] == 1 else ','.join(text_b[fb[g] : fb[g + 1]])}" for g in range(groups)]
        f = first.tolist()
        numbers = [np.ones(len(parts), np.int64), np.diff(first_a[first]), np.diff(first_b[first]), np.diff(first)]
        return [(parts, [";".join(said[f[i] : f[i + 1]]) for i in range(len(parts))], numbers, np.searchsorted(last, end_a[at_a]), (ids_a[at_a] << 32) | ids_b[at_b])]

    def pairs(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids, A's above B's 32 bits, and how often they are linked if chunks stand so many times."""
        n = times[self.link_chunk[: np.searchsorted(self.link_chunk, len(times))]]
        pair = self.link_pair[: len(n)][n > 0]
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], np.cumsum(n[n > 0][order])
        last = np.flatnonzero(np.append(pair[1:] != pair[:-1], True)) if len(pair) else np.zeros(0, np.int64)
        return pair[last], np.diff(n[last], prepend=0)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner of the two tokenizers."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Some megabytes of texts at a time with the number of the first; nulls are empty."""
    texts, size, lo = [], 0, 0
    for i, x in enumerate(column):
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= BATCH:
            yield lo, texts
            texts, size, lo = [], 0, i + 1
    if texts:
        yield lo, texts


def _numbered(of: Aligner, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts, the first one of each text with a closing entry, and whether a text has tokens."""
    parts = [_parts(t) if t else [] for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    at = of.numbers([x for p in parts for x in p])
    bad = np.concatenate([[0], np.cumsum(1 - of.valid[at])])
    return at, first, (bad[first[1:]] == bad[first[:-1]]) & (first[1:] > first[:-1])


class _Counts:
    """How often a task's texts have each chunk."""

    def __init__(self, of: Aligner):
        self.of, self.times = of, np.zeros(0, np.int64)

    def add(self, at: np.ndarray) -> None:
        more = np.bincount(at, minlength=len(self.of.text))
        more[: len(self.times)] += self.times
        self.times = more

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids and how often they are linked, since the last time."""
        got = self.of.pairs(self.times)
        self.times = np.zeros(0, np.int64)
        return got


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id, b_id, n``: how often tokens of these ids end together in all texts of ``docs (text)``.

    Null and empty texts have no tokens, nor have texts that a tokenizer doesn't give back byte for byte.
    Repeated rows count again; an empty table gives no rows. Other columns don't matter.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        counts = _Counts(of)

        def out() -> pa.RecordBatch:
            pair, n = counts.taken()
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in rows:
            for _, texts in _runs(batch.column(0)):
                if len(of.index) > CACHE_CHUNKS:
                    yield out()
                    of.forget()
                at, first, good = _numbered(of, texts)
                counts.add(at[np.repeat(good, np.diff(first))])
        yield out()
        trim()

    return _summed(docs.select(F.col("text").cast("string")).mapInArrow(count, "pair bigint, n bigint"))


def _summed(pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, n`` of ``pair, n`` by task."""
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")).select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n")


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)]).astype(np.int64)


OUT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, `groups` string"
#: Rows of the table between the two passes: of a document with its links, or of a task's pairs and how often each is linked.
_LINKED = "n_a bigint, n_b bigint, n_groups bigint, `groups` string, links array<bigint>, pair array<bigint>, times array<bigint>"
#: Rows whose links are weighed at once.
WEIGHED_ROWS = 1000


def _linked(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """``doc_id`` and _LINKED: every text tokenized and aligned, once."""
    lists = pa.list_(pa.int64())

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        counts = _Counts(of)
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "pair", "times"]

        def counted(kind: pa.DataType) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), lists)]
            return pa.RecordBatch.from_arrays([*none, *(pa.array([x], lists) for x in counts.taken())], names)

        kind = None
        for batch in rows:
            kind = batch.column(0).type
            for lo, texts in _runs(batch.column(1)):
                if len(of.index) > CACHE_CHUNKS:
                    yield counted(kind)
                    of.forget()
                at, first, good = _numbered(of, texts)
                whole = at[np.repeat(good, np.diff(first))]
                counts.add(whole)
                columns = []
                for x in (of.n_a, of.n_b, of.n_groups):
                    total = _sums(x[at])
                    columns.append(np.where(good, total[first[1:]] - total[first[:-1]], 0))
                starts = _sums(of.n_groups)  # a group has one link, at its end
                links = of.link_pair[_ranges(starts[whole], starts[whole + 1])[0]]
                said, bounds, numbers = of.text, first.tolist(), at.tolist()
                groups = [";".join([said[x] for x in numbers[bounds[i] : bounds[i + 1]]]) if ok else "" for i, ok in enumerate(good.tolist())]
                if digest:
                    groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                links = pa.ListArray.from_arrays(pa.array(_sums(columns[2]), pa.int32()), pa.array(links))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *map(pa.array, columns), pa.array(groups, pa.string()), links, pa.nulls(len(texts), lists), pa.nulls(len(texts), lists)], names)
        if kind is not None:
            yield counted(kind)
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(read, f"doc_id {kind}, {_LINKED}")


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """``doc_id`` of each of ``docs (doc_id, text)`` with its tokens by two tokenizers, aligned.

    ``n_a, n_b`` tokens, ``n_groups`` components, ``n_links`` links, of which ``n_best`` have the highest count
    in all documents among the pairs of their B id; ``count_sum`` adds up the counts of all links. ``groups`` has
    the ids of each component, ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is their SHA-256, in ``groups_sha256``.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have zeros and ``''``.
    Ids may be null or repeat; each row gives one. Empty tables give no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    most = Aligner(a_path, b_path).most_pairs()
    linked = saved(_linked(docs, a_path, b_path, digest))
    table = _summed(linked.filter("times IS NOT NULL").select(F.explode(F.arrays_zip("pair", "times")).alias("x")).select("x.pair", F.col("x.times").alias("n"))).toArrow()
    if table.num_rows > most:
        raise ValueError(f"{table.num_rows} pairs of ids are linked, but the vocabularies allow {most}")
    a, b, n = (table.column(c).to_numpy() for c in ("a_id", "b_id", "n"))
    order = np.argsort((a << 32) | b)
    a, b, n = a[order], b[order], n[order]
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    sent = spark.sparkContext.broadcast(((a << 32) | b, n, n == highest[b]))

    def weighed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for all_rows in rows:
            for lo in range(0, all_rows.num_rows, WEIGHED_ROWS):
                batch = all_rows.slice(lo, WEIGHED_ROWS)
                links = batch.column(5)
                first = _sums(links.value_lengths().to_numpy(zero_copy_only=False))
                at = np.searchsorted(pair, links.flatten().to_numpy())  # each of them was counted
                numbers = [np.diff(x[first]) for x in (_sums(best[at]), _sums(count[at]))]
                columns = [*batch.columns[:4], pa.array(np.diff(first)), *map(pa.array, numbers), batch.column(4)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = linked.filter("times IS NULL").drop("pair", "times").mapInArrow(weighed, f"doc_id {kind}, {OUT}")
    return out.withColumnRenamed("groups", "groups_sha256") if digest else out
