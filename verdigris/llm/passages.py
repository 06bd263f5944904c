"""Substring deduplication with repeated-phrase automata.

A window is a fixed number of consecutive words. The documents are dealt into buckets of a few megabytes,
and every step works on a bucket at a time:

1. phrases: from each window the k-gram with the smallest hash is taken, so that equal windows give equal
   phrases; phrases that stand in two places go on, and others rule their windows out;
2. confirmation: windows of recurring phrases are matched by hash, and each bucket that has a window gets the
   passage around it, as words, from another bucket that has it. Those that have a window stand in a chain, so
   that none has to serve all others;
3. automata: each bucket compiles the phrases of the passages it got, and of those that recur within it, into
   an Aho-Corasick automaton over word numbers, its shard of all phrases, and streams all its documents
   through it. Each place found is compared with the passage word by word, and is covered as far as they agree.

A document is in one bucket, and that bucket's automaton has every recurring phrase that its documents can
hold, so no document needs another shard. A bucket sends each hash once, so a passage in a third of all
documents makes one row a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.text import as_bytes, hashed, ngrams, signed, trim

#: Bytes of text in a bucket, about.
BUCKET_BYTES = 2 << 20


class _Bucket:
    """Hashed words of a bucket's texts, its windows and their phrases."""

    def __init__(self, texts: list[bytes], window: int):
        self.h, self.starts, self.ends, self.first, self.data = hashed(texts)
        self.window, self.k = window, window // 2 + 1
        n = len(self.h)
        ends = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(max(0, n - window + 1))
        self.windows = at[at + window <= ends[: len(at)]]
        if len(self.windows):
            grams = ngrams(self.h, self.k)
            chosen = self.windows + _first_least(grams, window - self.k + 1)[self.windows]
            self.phrase = grams[chosen]
            self.places = np.unique(chosen)
            self.place_phrases = grams[self.places]
        else:
            self.places = np.zeros(0, np.int64)
            self.phrase = self.place_phrases = np.zeros(0, np.uint64)

    def candidates(self, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of phrases that recur here or, as ``recurring`` says, elsewhere; their hashes."""
        values, counts = np.unique(self.place_phrases, return_counts=True)
        found = np.isin(self.phrase, np.concatenate([values[counts > 1], recurring]))
        return self.windows[found], self._hashes(found)

    def _hashes(self, of: np.ndarray) -> np.ndarray:
        return ngrams(self.h, self.window)[self.windows[of]] if of.any() else np.zeros(0, np.uint64)

    def runs(self, at: np.ndarray) -> list[tuple[int, int]]:
        """First words and ends of passages: windows ``at``, in rising order, that follow one another in a text."""
        if not len(at):
            return []
        text = np.searchsorted(self.first, at, side="right")
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) > 0)) + 1
        return [(int(a), int(b) + self.window) for a, b in zip(at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)], strict=True)]

    def served(self, asked: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each bucket the passages, as text, that its windows ``asked`` (hashes) form here."""
        h = self._hashes(np.ones(len(self.windows), bool))
        known, first = np.unique(h, return_index=True)
        if not len(known):
            return
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        found = known[at] == asked
        places = self.windows[first[at[found]]]
        order = np.lexsort((places, bucket[found]))
        places, bucket = places[order], bucket[found][order]
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for part, to in zip(np.split(places, edges), bucket[np.append(0, edges)] if len(bucket) else (), strict=False):
            for a, b in self.runs(part):
                yield int(to), self.data[self.starts[a] : self.ends[b - 1]]

    def own(self) -> list[tuple[int, int]]:
        """Passages of windows whose hash stands here more than once, by their first places."""
        h = self._hashes(np.ones(len(self.windows), bool))
        _, first, counts = np.unique(h, return_index=True, return_counts=True)
        return self.runs(np.sort(self.windows[first[counts > 1]]))

    def covered(self, passages: list[bytes]) -> np.ndarray:
        """Which words lie in a window that stands in a passage of another bucket, or elsewhere in this one."""
        own = self.own()
        cover = np.zeros(len(self.h) + 1, np.int64)
        if own or passages:
            held = _Bucket([*(self.data[self.starts[a] : self.ends[b - 1]] for a, b in own), *passages], self.window)
            origin = np.full(len(held.h), -1, np.int64)  # the same words' place in this bucket
            for i, (a, b) in enumerate(own):
                origin[held.first[i] : held.first[i + 1]] = np.arange(a, b)
            q, p = self._occurrences(held)
            away = origin[p] != q
            q, p = q[away], p[away]
            left, right = _agreeing(self, held, q, p)
            good = left + self.k + right >= self.window
            q, p, left, right = q[good], origin[p[good]], left[good], right[good]
            for at, l, r in ((q, left, right), (p[p >= 0], left[p >= 0], right[p >= 0])):
                np.add.at(cover, at - l, 1)
                np.add.at(cover, at + self.k + r, -1)
        return np.cumsum(cover[:-1]) > 0

    def _occurrences(self, held: _Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Places here, and in the passages ``held``, of each phrase of these: all texts streamed through one automaton."""
        _, ids = np.unique(np.concatenate([self.h, held.h]), return_inverse=True)
        mine, theirs = ids[: len(self.h)].tolist(), ids[len(self.h) :].tolist()
        phrases: dict[tuple[int, ...], list[int]] = {}
        for p in held.places.tolist():
            phrases.setdefault(tuple(theirs[p : p + self.k]), []).append(p)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, phrase in enumerate(phrases):
            automaton.add_word(phrase, i)
        automaton.make_automaton()
        places, which = [], []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            for end, i in automaton.iter(tuple(mine[a:b])):
                places.append(a + end + 1 - self.k)
                which.append(i)
        sizes = np.array([len(x) for x in phrases.values()], np.int64)
        flat = np.array([p for x in phrases.values() for p in x], np.int64)
        which = np.array(which, np.int64)
        n = sizes[which]
        of = np.repeat(np.arange(len(which)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return np.array(places, np.int64)[of], flat[(np.cumsum(sizes) - sizes)[which[of]] + nth]


def _first_least(values: np.ndarray, n: int) -> np.ndarray:
    """For every ``n`` values in a row, how far from the first of them the first least one is."""
    count = len(values) - n + 1
    best, at = values[:count].copy(), np.zeros(count, np.int64)
    for i in range(1, n):
        less = values[i : i + count] < best
        best[less] = values[i : i + count][less]
        at[less] = i
    return at


def _agreeing(a: _Bucket, b: _Bucket, at: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after the phrases at ``at`` and ``bt`` are the same, as far as a window reaches."""
    reach, k = a.window - a.k, a.k
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    lo = [x.first[np.searchsorted(x.first, p, side="right") - 1] for x, p in ((a, at), (b, bt))]
    hi = [x.first[np.searchsorted(x.first, p, side="right")] for x, p in ((a, at), (b, bt))]
    same = [np.ones(len(at), bool), np.ones(len(at), bool)]
    for step in range(1, reach + 1):
        i, j = at - step, bt - step
        same[0] = same[0] & (i >= lo[0]) & (j >= lo[1])
        same[0][same[0]] = a.h[i[same[0]]] == b.h[j[same[0]]]
        left += same[0]
        i, j = at + k + step - 1, bt + k + step - 1
        same[1] = same[1] & (i < hi[0]) & (j < hi[1])
        same[1][same[1]] = a.h[i[same[1]]] == b.h[j[same[1]]]
        right += same[1]
    return left, right


def _sent(bucket: int, values: np.ndarray) -> pa.Table:
    """Each value once with the bucket, and whether the bucket has it twice and needn't be told."""
    values, counts = np.unique(values, return_counts=True)
    return pa.table({"value": signed(values), "dup_bucket": pa.array(np.full(len(values), bucket), pa.int64()), "twice": pa.array(counts > 1)})


def _told(spread: DataFrame) -> DataFrame:
    """``dup_bucket, value, other`` of values that a bucket has once and another bucket has too: the one before it,
    or for the first the one after it."""
    chain = Window.partitionBy("value").orderBy("dup_bucket")
    other = F.coalesce(F.lag("dup_bucket").over(chain), F.lead("dup_bucket").over(chain))
    return spread.withColumn("other", other).filter("other is not null and not twice").select("dup_bucket", "value", "other")


def _hashes(table: pa.Table) -> np.ndarray:
    return table.column("value").to_numpy().view(np.uint64)


def _texts(table: pa.Table) -> list[bytes]:
    return as_bytes(table.column("dup_text").combine_chunks()) if table.num_rows else []


def remove(docs: DataFrame, window: int = 35, rejoin: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without ``text``, with ``n_words, n_removed, kept_text``; one row for each row.

    A word is removed where it lies in a window whose words also start anywhere else, in the same text or
    another; windows are judged on the input. Words are runs of characters other than space and \\x09-\\x0D.
    ``kept_text`` is the words left, joined by one space; without ``rejoin``, a text that loses nothing stays
    as it is. Null and empty texts have no words. Repeated rows are documents of their own, so their windows
    recur; they are dealt over all buckets. An empty table gives no rows. Columns of ``docs`` named as the new
    ones, in any case, are replaced.

    Windows meet by a 64-bit hash but are removed only where their words agree; if different windows had one
    hash, a copy could stay. Words are compared by 64-bit hashes. ``docs`` is read several times and must give the
    same rows in the same partitions each time, as files do.
    """
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_words", "n_removed", "kept_text")]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    named = [F.col(f"`{c.replace('`', '``')}`").alias(f"keep_{i}") for i, c in enumerate(rest)]
    dealt = docs.select(*named, F.col("text").cast("string").alias("dup_text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("dup_bucket"))

    def phrases(key: tuple, table: pa.Table) -> pa.Table:
        return _sent(key[0].as_py(), _Bucket(_texts(table), window).place_phrases)

    def windows(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        return _sent(key[0].as_py(), _Bucket(_texts(table), window).candidates(_hashes(told))[1])

    def passages(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(_Bucket(_texts(table), window).served(_hashes(asked), asked.column("dup_bucket").to_numpy())) if asked.num_rows else []
        trim()
        return pa.table({"dup_bucket": pa.array([x for x, _ in found], pa.int64()), "passage": pa.array([x for _, x in found], pa.binary())})

    def result(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts = _texts(table)
        b = _Bucket(texts, window)
        gone = b.covered(told.column("passage").to_pylist())
        trim()
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[b.first[1:]] - removed[b.first[:-1]]
        kept = []
        for i, text in enumerate(texts):
            if not rejoin and not removed[i]:
                kept.append(text)
                continue
            words = text.split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[b.first[i] : b.first[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        out = {f"keep_{i}": table.column(f"keep_{i}") for i in range(len(rest))}
        out |= {"n_words": pa.array(np.diff(b.first)), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out)

    sent = "value bigint, dup_bucket bigint, twice boolean"
    by_bucket = dealt.groupBy("dup_bucket")
    recurring = _told(by_bucket.applyInArrow(phrases, sent)).select("dup_bucket", "value")
    asked = _told(by_bucket.cogroup(recurring.groupBy("dup_bucket")).applyInArrow(windows, sent))
    served = by_bucket.cogroup(asked.groupBy("other")).applyInArrow(passages, "dup_bucket bigint, passage binary")
    schema = T.StructType([T.StructField(f"keep_{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    out = by_bucket.cogroup(served.groupBy("dup_bucket")).applyInArrow(result, schema)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(rest)})
