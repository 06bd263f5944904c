"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND pruning.

A task turns the documents it reads into shards of some megabytes, one after another: posting lists by term
with their impacts, the largest impact of a list and of each block of documents in it, and the same postings
by document. Some hundred queries pass a shard together. The lists of each are ordered by the most they can add
to a score; the pivot is the list from which on a document can reach the query's k-th best score so far, and the
lists from the pivot on are added up. The block bounds of the other lists leave some of these documents; if they
are still many, the other lists are added too, and what is left is scored in full. Frequent terms are rows of a
matrix, documents across, so that their lists are added for all queries by one product; it rounds, by less than
its bounds allow for, and full scores don't come from it. A query's k-th best score is carried from shard to
shard. Document frequencies, the number of documents and their mean length are global, so the tasks' lists merge
exactly. Documents pass in bulk, not one by one as cursors would have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.licences import _CLEAN
from verdigris.llm.scratch import drop, saved
from verdigris.llm.text import as_bytes, batches, hashed, signed, trim

K1, B = 1.2, 0.75
BLOCK = 64
#: Bytes of text in a shard; bytes of terms and weights of the queries that tasks hold at once.
SHARD_BYTES, QUERY_BYTES = 16 << 20, 32 << 20
#: A term in one of so many documents of a shard is frequent. Numbers of a matrix of frequent terms, of the most frequent if they
#: are more; scores of queries that pass a shard together; scores that are added up at once.
FREQUENT, MATRIX, CELLS, STEP = 20, 1 << 24, 1 << 20, 1 << 16


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of texts (digits, a-z after lower-casing, all beyond ASCII) and the first word of each."""
    h, _, _, first, _ = hashed([t.translate(_CLEAN) for t in texts])
    return h, first


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``term, text`` pairs in that order, how often each occurs, and the texts' lengths."""
    term, owner, lengths = [], [], []
    for lo, hi in batches(texts):
        h, first = _terms(texts[lo:hi])
        term.append(h)
        owner.append(np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(first)))
        lengths.append(np.diff(first))
    if not term:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, o = np.concatenate(term), np.concatenate(owner)
    # one sort of numbers that hold a term's upper bits and the text
    bits = np.uint64(len(texts).bit_length())
    distinct, both = np.unique(t), (t >> bits << bits) | o.astype(np.uint64)
    both.sort()
    at = _changes(both)
    upper = both[at] >> bits
    first = _changes(upper)
    if len(first) == len(distinct):
        pairs = np.repeat(distinct, np.diff(np.append(first, len(at)))), (both[at] - (upper << bits)).astype(np.int64)
    else:  # two terms differ in the lower bits alone
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        at = np.union1d(_changes(t), _changes(o))
        pairs = t[at], o[at]
    return *pairs, np.diff(np.append(at, len(t))), np.concatenate(lengths)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before, and the first."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and the range of each."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[which], which


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive ranges of items whose ``sizes`` add up to about 16 STEP, one item at least."""
    turn = np.cumsum(sizes) // (16 * STEP)
    edges = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


class Shard:
    """Inverted index of some documents; ``mean`` is the mean length of all documents."""

    def __init__(self, texts: list[bytes], mean: float):
        # long documents together, so that a block's bounds are close to its documents
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        term, doc, tf, words = _pairs([texts[i] for i in self.order])
        self.docs, self.blocks = len(texts), -(-len(texts) // BLOCK)
        self.width = self.blocks * BLOCK
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(term))
        self.terms, self.of_term = term[self.first], np.cumsum(new, dtype=np.int32) - 1
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / mean))
        self.doc = doc.astype(np.int32)
        block = self.doc // BLOCK
        new[1:] |= block[1:] != block[:-1]
        starts = np.flatnonzero(new)
        self.block, self.block_most = block[starts], np.maximum.reduceat(self.impact, starts) if len(starts) else self.impact
        self.block_first, self.block_last = np.searchsorted(starts, self.first), np.searchsorted(starts, self.last)
        self.most = np.maximum.reduceat(self.impact, self.first) if len(self.first) else self.impact
        by_doc = np.argsort(self.doc.astype(np.uint16) if self.docs <= 1 << 16 else self.doc, kind="stable")
        self.doc_first = np.searchsorted(self.doc[by_doc], np.arange(self.docs + 1))
        self.doc_term, self.doc_impact = self.of_term[by_doc], self.impact[by_doc]
        self.weight = np.zeros(len(self.terms))

    def ask(self, terms: np.ndarray, weights: np.ndarray) -> None:
        """From now on queries are numbers of these ``terms``, which have these ``weights``."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        self.number = np.where(known, at, -1)
        self.weight[:] = 0
        self.weight[at[known]] = weights[known]
        used = self.weight > 0
        self.asked = np.where(used, np.cumsum(used), 0).astype(np.int32)
        self.doc_asked = self.asked[self.doc_term]
        self.gain = self.weight[self.of_term] * self.impact
        self.bound = self.weight * self.most
        self.turn = np.argsort(self.bound, kind="stable")
        self.rank = np.empty_like(self.turn)
        self.rank[self.turn] = np.arange(len(self.turn))
        sizes = self.last - self.first
        frequent = np.flatnonzero((self.weight > 0) & (sizes * FREQUENT >= self.docs))
        frequent = frequent[np.argsort(-sizes[frequent], kind="stable")[: MATRIX // max(1, self.width)]]
        frequent = frequent[np.argsort(self.rank[frequent])]  # so those before a pivot are next to each other
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        postings, which = _ranges(self.first[frequent], self.last[frequent])
        self.rows = np.zeros((len(frequent), self.width), np.float32)
        self.rows[which, self.doc[postings]] = self.gain[postings]
        self.rows_most = self.rows.reshape(len(frequent), self.blocks, BLOCK).max(2)
        #: Single precision rounds a sum of n gains by n parts in 2**24: bounds are held to be so much larger, four times.
        self.slack = 1 - (len(frequent) + 16) * 2.0**-22

    def search(self, numbers: np.ndarray, offsets: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For several queries, rising: query, number and score of documents, among them all of the ``k`` best, and
        all that equal the last of these, that score the query's ``least`` or more."""
        n = len(offsets) - 1
        t = self.number[numbers[offsets[0] : offsets[-1]]]
        q = np.repeat(np.arange(n), np.diff(offsets))[t >= 0]
        t = t[t >= 0]
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # a query's lists by what they can add
        t = self.turn[np.sort(q * len(self.turn) + self.rank[t]) - q * len(self.turn)]
        bound = self.bound[t]
        rise = np.cumsum(bound)
        rise -= (rise - bound)[np.searchsorted(q, q)]
        enough = least * self.slack
        pivot = rise >= enough[q]  # the lists before it can't reach least together
        part = self._added(q[pivot], t[pivot], n)
        new = np.flatnonzero(enough <= 0)
        if len(new):  # all lists were added: a score that k documents reach
            if self.docs > k:
                enough[new] = np.partition(part[new], self.width - k, axis=1)[:, self.width - k] * self.slack
            enough = np.maximum(enough, np.finfo(np.float32).tiny)
        enough = enough.astype(np.float32)[:, None]
        if pivot.all():
            found = part >= enough
        else:
            most = self._block_bounds(q[~pivot], t[~pivot], n)
            found = (part.reshape(n, self.blocks, BLOCK) >= (enough - most)[:, :, None]).reshape(n, self.width)
            if np.count_nonzero(found) > 2 * k * n:
                # many are left: the other lists add what they have before scores are summed by document
                part += self._added(q[~pivot], t[~pivot], n)
                found &= part >= enough
        which, docs = np.divmod(np.flatnonzero(found), self.width)
        which, docs = which[docs < self.docs], docs[docs < self.docs]
        asked = np.zeros((n, self.asked.max() + 1), bool)  # which terms a query has, by their numbers from 1
        asked[q, self.asked[t]] = True
        scores = np.zeros(len(docs))
        for s in _slices((self.doc_first[1:] - self.doc_first[:-1])[docs]):
            scores[s] = self._scores(docs[s], asked, which[s])
        good = (scores >= least[which]) & (scores > 0)
        return which[good], self.order[docs[good]], scores[good]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query: numbers and scores of documents."""
        self.ask(terms, weights)
        _, found, scores = self.search(np.arange(len(terms)), np.array([0, len(terms)]), k, np.array([float(least)]))
        return found, scores

    def _added(self, q: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """What these lists of these queries add to each document's score: postings of rare terms one by one,
        lists of frequent terms as rows of a matrix."""
        rare = self.row[t] < 0
        part = self._picked(q[~rare], t[~rare], n, self.rows)
        few = max(1, STEP // max(1, self.width))  # queries whose sums stay in the processor's cache
        q, t = q[rare], t[rare]
        first, size = self.first[t], (self.last - self.first)[t]
        for lo in range(0, n, few):
            a, b = np.searchsorted(q, (lo, lo + few))
            for s in _slices(size[a:b]):
                start, count, of = first[a:b][s], size[a:b][s], (q[a:b][s] - lo) * self.width
                end = np.cumsum(count)
                postings = np.arange(end[-1]) + np.repeat(start - end + count, count)
                sums = np.bincount(np.repeat(of, count) + self.doc[postings], self.gain[postings], min(few, n - lo) * self.width)
                part[lo : lo + few] += sums.reshape(-1, self.width)
        return part

    def _block_bounds(self, q: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """The most that these lists of these queries can add in each block of documents."""
        rare = self.row[t] < 0
        entries, which = _ranges(self.block_first[t[rare]], self.block_last[t[rare]])
        most = np.bincount(q[rare][which] * self.blocks + self.block[entries], self.weight[t[rare]][which] * self.block_most[entries], n * self.blocks)
        return self._picked(q[~rare], t[~rare], n, self.rows_most) + most.reshape(n, self.blocks).astype(np.float32)

    def _picked(self, q: np.ndarray, t: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """Sums of the rows of these terms for each query."""
        row = self.row[t]
        lo, hi = (row.min(), row.max() + 1) if len(row) else (0, 0)
        pick = np.zeros((n, hi - lo), np.float32)
        pick[q, row - lo] = 1
        return pick @ rows[lo:hi]

    def _scores(self, docs: np.ndarray, asked: np.ndarray | None = None, query: np.ndarray | None = None) -> np.ndarray:
        """Full scores by the terms that a document's query ``asked`` (all, if none is given), summed in the order of
        the terms' hashes, so that equal documents score alike."""
        at, which = _ranges(self.doc_first[docs], self.doc_first[docs + 1])
        if asked is not None:
            held = np.flatnonzero(asked.ravel()[(query * asked.shape[1])[which] + self.doc_asked[at]])
            at, which = at[held], which[held]
        return np.bincount(which, self.weight[self.doc_term[at]] * self.doc_impact[at], len(docs))


class _Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.zeros(queries)
        #: Query, score, whether the id is null, and id, in the order of the result.
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))

    def add(self, query: np.ndarray | int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """Documents of one query or of several."""
        if not len(scores):
            return
        query = np.broadcast_to(query, len(scores))
        lo, hi = np.searchsorted(self.rows[0], [query.min(), query.max() + 1])
        more = [np.concatenate((a[lo:hi], b)) for a, b in zip(self.rows, (query, scores, null, ids), strict=True)]
        order = np.lexsort((more[3], more[2], -more[1], more[0]))
        of = more[0][order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        order = order[rank < self.k]
        last = order[rank[rank < self.k] == self.k - 1]
        self.least[more[0][last]] = more[1][last]
        self.rows = tuple(np.concatenate((a[:lo], b[order], a[hi:])) for a, b in zip(self.rows, more, strict=True))

    @property
    def held(self) -> list[tuple[np.ndarray, ...]]:
        """Scores, null and ids by query."""
        at = np.searchsorted(self.rows[0], np.arange(len(self.least) + 1))
        return [tuple(x[a:b] for x in self.rows[1:]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _weighted(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, float]:
    """``query_id, q_key, terms, weights`` of the queries' distinct words, and the mean length."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = as_bytes(batch.column(0))
            for lo, hi in batches(texts, 8 << 20):
                term, _, _, lengths = _pairs(texts[lo:hi])
                terms, df = np.unique(term, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), signed(terms)]), pa.array(np.concatenate([[len(lengths)], df])), pa.array(np.concatenate([[lengths.sum()], np.zeros(len(df), np.int64)]).astype(np.int64))], ["term", "df", "words"])

    stats = saved(docs.select(F.col("text").cast("string")).mapInArrow(counted, "term bigint, df bigint, words bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
    total = stats.filter("term is null").first()
    n, mean = (total["df"], max(1.0, total["words"] / max(1, total["df"]))) if total else (0, 1.0)

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = as_bytes(batch.column(2))
            for lo, hi in batches(texts, 8 << 20):
                term, owner, _, _ = _pairs(texts[lo:hi])
                owner = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), signed(term)], ["query_id", "q_key", "term"])

    keyed = queries.select(F.col("query_id").cast("bigint"), F.xxhash64("query_id", "text").alias("q_key"), F.col("text").cast("string")).dropDuplicates(["query_id", "q_key"])
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = keyed.mapInArrow(split, "query_id bigint, q_key bigint, term bigint").join(stats.filter("term is not null"), "term")
    listed = terms.groupBy("query_id", "q_key").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("weight")))).alias("list"))
    asked = saved(listed.select("query_id", "q_key", F.col("list.term").alias("terms"), F.col("list.weight").alias("weights")))
    drop(stats)
    return asked, mean


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, tasks: int | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best rows of ``docs (doc_id, text)`` for each of ``queries (query_id, text)``.

    A query is the set of its words; documents without any of them are not found. Equal scores go by id, nulls
    last. Null and empty texts have no words. Repeated query rows are one query; repeated documents are found
    as often as they are there. Empty tables give no rows. Other columns don't matter. Terms are told apart by
    64-bit hashes.

    Queries are sent to the tasks in blocks of about ``query_bytes``; each block is one pass over ``docs``, in
    ``tasks`` tasks (by default as many as there are cores), and each task gives ``k`` rows for a query.
    """
    spark = docs.sparkSession
    asked, mean = _weighted(queries, docs)
    blocks = 1 + 16 * (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_bytes
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).coalesce(tasks or spark.sparkContext.defaultParallelism)
    parts = []
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(_queries(asked.filter(F.pmod("q_key", F.lit(blocks)) == block).toArrow()))
        found = texts.mapInArrow(_searching(sent, mean, k, shard_bytes), "query_id bigint, q_key bigint, doc_id bigint, score double")
        parts.append(saved(found))
        sent.unpersist()
    drop(asked)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _queries(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys, offsets, numbers of terms of a block of queries; the terms, rising, and their weights."""
    table = table.combine_chunks()
    # queries of about one length together: their pivots are near each other
    table = table.take(np.argsort(table.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), kind="stable"))
    ids, keys = (table.column(c).combine_chunks() for c in ("query_id", "q_key"))
    terms, weights = table.column("terms").combine_chunks(), table.column("weights").combine_chunks()
    flat, weight = terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy()
    offsets = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    distinct, at, numbers = np.unique(flat, return_index=True, return_inverse=True)
    return ids, keys, offsets, numbers.astype(np.int32), distinct, weight[at]


def _searching(sent, mean: float, k: int, shard_bytes: int):
    """A function over batches ``doc_id, text``: the ``k`` best documents among them for each query sent."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, keys, offsets, numbers, terms, weights = sent.value
        best = _Best(len(query_ids), k)
        texts: list[bytes] = []
        ids: list[pa.Array] = []
        size = 0

        def search() -> None:
            shard, held = Shard(texts, mean), pa.concat_arrays(ids)
            null = held.is_null().to_numpy(zero_copy_only=False)
            held = held.fill_null(0).to_numpy()
            shard.ask(terms, weights)
            together = max(1, min(CELLS // shard.width, 16 * CELLS // (1 + int(shard.asked.max(initial=0)))))
            for q in range(0, len(query_ids), together):
                which, found, scores = shard.search(numbers, offsets[q : q + together + 1], k, best.least[q : q + together])
                best.add(which + q, scores, null[found], held[found])

        for batch in rows:
            whole = as_bytes(batch.column(1))
            for lo, hi in batches(whole):
                texts += whole[lo:hi]
                ids.append(batch.column(0).slice(lo, hi - lo))
                size += sum(map(len, whole[lo:hi]))
                if size >= shard_bytes:
                    search()
                    texts, ids, size = [], [], 0
        if texts:
            search()
        trim()
        of, scores, null, found = best.rows
        of = pa.array(of)
        yield pa.RecordBatch.from_arrays([query_ids.take(of), keys.take(of), pa.array(found, mask=null), pa.array(scores, pa.float64())], ["query_id", "q_key", "doc_id", "score"])

    return run
