"""Ranked lexical search by a threshold-seeded join.

Documents are read once: of each, the terms that any item has are kept, with their counts. An impact is what a
term adds to a score per unit of its weight. For each term the impact is stored that its k-th best document
reaches; times the weight, an item's k-th score is at least the largest of these. An item's terms are then taken
in falling order of what they can add at most; from where on all others together can't reach that score, a
suffix makes no candidates. Documents with one of an item's other terms are candidates; those whose sum so far,
with all that the suffix can add, reaches the item's least score are scored exactly, and the least score rises
with what a task has found. All is 64-bit integers, so equal scores are equal.

Items go to the tasks in blocks of a bounded size, each block one pass over the kept terms. Impacts are counted
in steps, so what is stored of a term is bounded, however many documents have it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.scratch import drop, saved
from verdigris.llm.search import _ranges
from verdigris.llm.text import as_bytes, batches, trim

#: Documents ranked for an item.
K = 50
#: Impacts, at most a million, are stored in steps of so much.
STEP = 250
#: Bytes of items' terms that tasks hold at once; cells of items by documents in memory.
ITEM_BYTES, CELLS = 1 << 20, 1 << 21
#: Digits, a-z after lower-casing and all beyond ASCII.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


def impact(tf: Column, n: Column, documents: int, length: int) -> Column:
    """What a term that stands ``tf`` times in a document of ``n`` terms adds, before its weight."""
    tf = tf.cast("bigint")
    m = F.lit(50).cast("bigint") + _div(n * F.lit(50 * documents).cast("bigint"), F.lit(max(1, length)))
    return _div(tf * 1_000_000_000, tf * 1000 + m * 20)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


class _Items:
    """Some items and their distinct terms by number; after :meth:`plan` with what prunes their documents."""

    def __init__(self, ids: pa.Array, texts: list[bytes]):
        self.ids = ids
        lists = [list(dict.fromkeys(terms(t))) for t in texts]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(lists)))}
        self.term = np.array([self.number[w] for ws in lists for w in ws], np.int64)
        self.item = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])

    def plan(self, documents: int, length: int, stored: pa.Table, k: int) -> None:
        """``stored``: by term its documents, the largest impact and a bound of the k-th (0: fewer documents)."""
        self.documents, self.length = documents, length
        df, most, kth = (np.zeros(len(self.number), np.int64) for _ in range(3))
        for array, name in ((df, "df"), (most, "most"), (kth, "kth")):
            array[stored.column("term").to_numpy()] = stored.column(name).to_numpy()
        weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)[self.term]
        bound = weight * most[self.term]
        self.least = np.zeros(len(self.ids), np.int64)
        np.maximum.at(self.least, self.item, weight * kth[self.term])
        # the terms of an item in rising order of what they can add: those that can't reach the least score together
        order = np.lexsort((bound, self.item))
        item, rise = self.item[order], np.cumsum(bound[order])
        first = np.searchsorted(item, np.arange(len(self.ids)))
        before = np.append(0, rise)[first]
        small = rise - before[item] < self.least[item]
        self.rest = np.zeros(len(self.ids), np.int64)
        np.maximum.at(self.rest, item[small], (rise - before[item])[small])
        used = (df[self.term] > 0)[order]
        self.leading = self._by_term(order[~small & used], weight)
        other = order[small & used]
        self.other_term, self.other_weight = self.term[other], weight[other]
        self.other_first = np.searchsorted(self.item[other], np.arange(len(self.ids) + 1))
        self.number = self.term = self.item = None

    def _by_term(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = at[np.argsort(self.term[at], kind="stable")]
        return np.searchsorted(self.term[at], np.arange(len(self.number) + 1)), self.item[at], weight[at]


class _Search:
    """The best documents of each item among those that a task has read."""

    def __init__(self, items: _Items, k: int):
        self.items, self.k, self.least = items, k, items.least.copy()
        none = np.zeros(0, np.int64)
        self.held = none, none, none, none  # item, score, whether the id is null, id

    def add(self, null: np.ndarray, ids: np.ndarray, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents by their numbers of terms; ``first, term, tf`` are the kept terms of each, in rising order."""
        it, docs = self.items, len(ids)
        m = 50 + 50 * n * it.documents // max(1, it.length)
        doc = np.repeat(np.arange(docs), np.diff(first))
        value = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        starts, item, weight = it.leading
        at, which = _ranges(starts[term], starts[term + 1])
        part = np.zeros(len(it.ids) * docs, np.int64)
        np.add.at(part, item[at] * docs + doc[which], weight[at] * value[which])
        reach = (self.least - it.rest)[:, None]
        table = part.reshape(-1, docs)
        item, doc_of = np.nonzero((table > 0) & (table >= reach))
        part = table[item, doc_of]
        key = doc * (len(starts) - 1) + term
        counts = np.bincount(item, minlength=len(it.ids))
        if (counts > 2 * self.k).any():  # the best of these first: what they reach rules out others
            order = np.lexsort((-part, item))
            place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            lead = order[place < self.k]
            self._score(item[lead], doc_of[lead], part[lead], key, value, null, ids)
            rest = order[place >= self.k]
            rest = rest[part[rest] >= (self.least - it.rest)[item[rest]]]
            item, doc_of, part = item[rest], doc_of[rest], part[rest]
        self._score(item, doc_of, part, key, value, null, ids)

    def _score(self, item: np.ndarray, doc: np.ndarray, part: np.ndarray, key: np.ndarray, value: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        it, width = self.items, len(self.items.leading[0]) - 1
        for lo in range(0, len(item), 1 << 16):
            some, d, score = item[lo : lo + (1 << 16)], doc[lo : lo + (1 << 16)], part[lo : lo + (1 << 16)].copy()
            at, which = _ranges(it.other_first[some], it.other_first[some + 1])
            wanted = d[which] * width + it.other_term[at]
            found = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
            there = key[found] == wanted if len(key) else np.zeros(len(wanted), bool)
            np.add.at(score, which[there], it.other_weight[at[there]] * value[found[there]])
            good = score >= self.least[some]
            held = [np.concatenate(x) for x in zip(self.held, (some[good], score[good], null[d[good]].astype(np.int64), ids[d[good]]), strict=True)]
            order = np.lexsort((held[3], held[2], -held[1], held[0]))
            counts = np.bincount(held[0], minlength=len(it.ids))
            start = np.cumsum(counts) - counts
            place = np.arange(len(order)) - np.repeat(start, counts)
            self.held = tuple(x[order[place < self.k]] for x in held)
            full = np.flatnonzero(counts >= self.k)
            self.least[full] = np.maximum(self.least[full], held[1][order[start[full] + self.k - 1]])


def _kept(docs: DataFrame, items) -> DataFrame:
    """``doc_id, n, terms, counts``: the number of terms of each document, and those that any item has."""

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number
        for batch in rows:
            texts = as_bytes(batch.column(1))
            for lo, hi in batches(texts):
                words = [terms(t) for t in texts[lo:hi]]
                found = [[number[w] for w in ws if w in number] for ws in words]
                key = np.repeat(np.arange(hi - lo), [len(x) for x in found]) * max(1, len(number)) + np.array(list(itertools.chain.from_iterable(found)), np.int64)
                key, tf = np.unique(key, return_counts=True)
                first = pa.array(np.searchsorted(key, np.arange(hi - lo + 1) * max(1, len(number))).astype(np.int32))
                lists = (pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (key % max(1, len(number)), tf))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(ws) for ws in words], pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
        trim()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(keep, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def stored_impacts(kept: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """``term, df, most, kth`` of each term: its documents, the largest impact, and one that ``k`` documents
    reach, rounded down to a step; 0 if it has fewer documents."""
    each = kept.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    value = each.select(F.col("x.terms").alias("term"), impact(F.col("x.counts"), F.col("n"), documents, length).alias("impact"))
    steps = value.groupBy("term", _div(F.col("impact"), F.lit(STEP)).alias("step")).agg(F.count("*").alias("docs"), F.max("impact").alias("most"))
    down = Window.partitionBy("term").orderBy(F.desc("step"))
    reached = steps.withColumn("so_far", F.sum("docs").over(down))
    return reached.groupBy("term").agg(F.sum("docs").alias("df"), F.max("most").alias("most"), F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("step") * STEP)), F.lit(0)).cast("bigint").alias("kth"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs (doc_id, text)`` for each of ``items (item_id, text)``.

    Scores above 0 alone count; equal ones go by id, nulls last. An item is the set of its terms. Null and empty
    texts have none. Repeated rows of items are one item, items of one id with different texts are ranked apart;
    repeated documents are found as often as they are there. Empty tables give no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string")).filter("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // item_bytes
    parts = []
    for block in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().combine_chunks()
        held = _Items(table.column("item_id").combine_chunks() if table.num_rows else pa.array([], table.schema.field(0).type), as_bytes(table.column("text")))
        sent = spark.sparkContext.broadcast(held)
        kept = saved(_kept(docs, sent))
        totals = kept.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        held.plan(totals["documents"], totals["length"], stored_impacts(kept, totals["documents"], totals["length"], k).toArrow(), k)
        planned = spark.sparkContext.broadcast(held)
        parts.append(saved(kept.mapInArrow(_searching(planned, k), f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint").withColumn("block", F.lit(block))))
        drop(kept)
        sent.unpersist()
        planned.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searching(planned, k: int):
    """A function over batches of kept terms: the ``k`` best documents among them for each item."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(planned.value, k)
        step = max(64, CELLS // max(1, len(search.items.ids)))
        for whole in rows:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                ids, lists, counts = batch.column(0), batch.column(2), batch.column(3)
                first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                search.add(ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(1).to_numpy(), first, *(x.flatten().to_numpy().astype(np.int64) for x in (lists, counts)))
        trim()
        item, score, null, doc = search.held
        yield pa.RecordBatch.from_arrays([pa.array(item), search.items.ids.take(pa.array(item)), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return run
