"""Language-model scores of whole texts by the marginal likelihood of a subword lattice.

The pieces are those of an existing vocabulary, whose order gives first weights; a text is a sequence of words
that each begin with a space, and an end. All ways to spell a word in pieces are a lattice over its bytes, and a
forward recursion in log space adds them up. No piece goes on past the start of the next word, so the forward
value of a text is the sum of those of its words, and each distinct word is taken once, wherever it stands. The
weights are fitted to the counts of all words of the texts to learn from, by expectation and maximisation:
each turn adds up, over the table of distinct words, how often each piece is expected.

Words are counted by task before they are shuffled. The most frequent ones go to all tasks with their counts
and likelihoods, a bounded table; the others, of which none has more than a small share of all words, are joined.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.scratch import drop, saved
from verdigris.llm.text import as_bytes, batches, trim

#: Turns of fitting; what each piece is expected besides, so that none is impossible.
TURNS, PRIOR = 3, 0.01
#: Most frequent words that all tasks get, if they have at most so many bytes.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
#: Distinct words that a task counts before it gives them on; bytes of words in one lattice.
HELD, LATTICE = 200_000, 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 divided by 7. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Vocabulary:
    """Distinct byte strings of an existing vocabulary's pieces, all single bytes among them, as a trie."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # merged pieces stand in the order of their scores; single characters and bytes come after them
        usable.sort(key=lambda i: (model.is_byte(i), -model.get_score(i)))
        spelled = (bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in usable)
        self.pieces = list(dict.fromkeys(itertools.chain(spelled, (bytes([b]) for b in range(256)))))
        edges: dict[int, int] = {}
        piece = [-1]
        for number, spelling in enumerate(self.pieces):
            node = 0
            for b in spelling:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                node = edges[key]
            piece[node] = number
        keys = np.array(sorted(edges), np.int64)
        self.edges, self.child, self.piece = keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(piece, np.int64)

    def first_weights(self) -> np.ndarray:
        """Natural logarithms of shares that fall with the place in the vocabulary; the last one is the end's."""
        share = 1.0 / (np.arange(len(self.pieces) + 1) + 1.0)
        return np.log(share / share.sum())

    def matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of all pieces in ``flat``, which ends with a byte 32."""
        at = np.arange(len(flat) - 1)
        node = np.zeros(len(at), np.int64)
        start, end, piece = [], [], []
        length = 0
        while len(at):
            key = node << 8 | flat[at + length]
            found = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[found] == key
            length += 1
            at, node = at[on], self.child[found[on]]
            number = self.piece[node]
            whole = number >= 0
            start.append(at[whole])
            end.append(at[whole] + length)
            piece.append(number[whole])
            inside = at + length < len(flat) - 1
            at, node = at[inside], node[inside]
        return np.concatenate(start), np.concatenate(end), np.concatenate(piece)


class Lattice:
    """All spellings of some words, each without its space."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
        start, end, self.number = vocabulary.matches(flat)
        # cells: a word's start and the ends of its bytes, so one more than bytes for each word
        of = np.repeat(np.arange(len(words)), np.diff(self.bounds))
        self.first = self.bounds[:-1] + np.arange(len(words))
        self.last = self.bounds[1:] + np.arange(len(words))
        self.start, self.end = start + of[start], end + of[start]
        self.cells = len(flat) - 1 + len(words)
        self.place = start - self.bounds[of[start]], end - self.bounds[of[start]]
        self.of = of[start]

    def _along(self, turn: np.ndarray, target: np.ndarray, source: np.ndarray, weights: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Fill ``value`` at targets, one place of all words after another, from values at sources."""
        order = np.lexsort((target, turn))
        target, source, weight, turn = target[order], source[order], weights[self.number[order]], turn[order]
        new = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        steps = np.searchsorted(turn, np.arange(turn[-1] + 2)) if len(turn) else np.zeros(1, np.int64)
        cuts = np.searchsorted(new, steps)
        for lo, hi, a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo < hi:
                value[target[new[a:b]]] = np.logaddexp.reduceat(value[source[lo:hi]] + weight[lo:hi], new[a:b] - lo)
        return value

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Logarithm of the likelihood of all beginnings of words."""
        value = np.full(self.cells, -np.inf)
        value[self.first] = 0.0
        return self._along(self.place[1], self.end, self.start, weights, value)

    def likelihood(self, weights: np.ndarray) -> np.ndarray:
        """Logarithm of the likelihood of each word: of all its spellings together."""
        return self.forward(weights)[self.last]

    def expected(self, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that stand so many times; the end has none."""
        ahead, value = self.forward(weights), np.full(self.cells, -np.inf)
        value[self.last] = 0.0
        behind = self._along((np.diff(self.bounds)[self.of] - self.place[0]), self.start, self.end, weights, value)
        share = np.exp(ahead[self.start] + weights[self.number] + behind[self.end] - ahead[self.last][self.of])
        return np.bincount(self.number, share * times[self.of], len(weights))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n, trained``: how often each word stands in ``docs (doc_id, text)``, and in those to learn from.

    Words are runs of anything but white space, A-Z in lower case, as binary; the end of a text is the empty
    word. Null texts have no words but an end. Repeated rows count again; an empty table gives no rows.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(found[0].keys() | found[1].keys())
            away, near = (np.array([c[w] for w in words], np.int64) for c in found)
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(away + near), pa.array(near)], ["word", "n", "trained"])

        for batch in rows:
            for text, away in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                of = found[0 if away else 1]
                of.update(_words(text))
                of[b""] += 1
                if len(found[0]) + len(found[1]) > HELD:
                    yield out()
        yield out()
        trim()

    counted = docs.select(F.col("text").cast("string"), held_out(F.col("doc_id"))).mapInArrow(count, "word binary, n bigint, trained bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _lattices(path: str, words: list[bytes]) -> Iterator[tuple[int, int, Lattice]]:
    for lo, hi in batches(words, LATTICE):
        yield lo, hi, Lattice(vocabulary(path), words[lo:hi])


def fit(words: DataFrame, path: str, turns: int = TURNS) -> np.ndarray:
    """Natural logarithms of the weights of all pieces and the end, which add up to 1.

    ``words (word, trained)`` has the words to learn from with their counts, and the end as the empty word. Only
    sums by piece come to the driver, as many as the vocabulary has. Without any words the first weights stay
    the same for all pieces but for the prior.
    """
    of = vocabulary(path)
    weights, size = of.first_weights(), len(of.pieces) + 1
    used = words.filter("trained > 0")
    for _ in range(turns):
        sent = used.sparkSession.sparkContext.broadcast(weights)

        def expect(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in rows:
                texts, times = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
                ends = np.array([not t for t in texts], bool)
                total[-1] += times[ends].sum()
                texts, times = [t for t in texts if t], times[~ends]
                for lo, hi, lattice in _lattices(path, texts):
                    total += lattice.expected(sent.value, times[lo:hi])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])
            trim()

        table = used.select("word", "trained").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        found = np.full(size, PRIOR)
        found[table.column("piece").to_numpy()] += table.column("n").to_numpy()
        weights = np.log(found / found.sum())
        sent.unpersist()
    return weights


def _weighed(words: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """``word, n, c, likelihood``: counts in all texts and in those to learn from, log10 of the likelihood."""
    sent = words.sparkSession.sparkContext.broadcast(weights)

    def weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(0).to_pylist()
            out = np.full(len(texts), sent.value[-1])  # the end
            at = np.flatnonzero([bool(t) for t in texts])
            texts = [t for t in texts if t]
            for lo, hi, lattice in _lattices(path, texts):
                out[at[lo:hi]] = lattice.likelihood(sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out / np.log(10))], ["word", "n", "c", "likelihood"])
        trim()

    return words.select("word", "n", F.col("trained").alias("c")).mapInArrow(weigh, "word binary, n bigint, c bigint, likelihood double")


def score(docs: DataFrame, path: str, turns: int = TURNS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each of ``docs (doc_id, text)``.

    ``score`` is the log10 of a text's likelihood by the lattice over the pieces of the sentencepiece model at
    ``path``, ``base_score`` that by counts of whole words with one added. Both learn from all rows that
    :func:`held_out` leaves in. Null and empty texts are an end alone. Ids may be null or repeat, each row gives
    one. If no row is left to learn from, ``train_tokens`` is 0, base scores are 0 and pieces weigh alike. An
    empty table gives no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    words = saved(count_words(docs))
    totals = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    total, rest = totals["n"], np.log10(totals["n"] + totals["v"] + 1)
    lexicon = saved(_weighed(words, path, fit(words, path, turns)))
    drop(words)
    table = lexicon.filter(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    sent = spark.sparkContext.broadcast((table.column("word").to_pylist(), table.column("c").to_numpy(), table.column("likelihood").to_numpy()))

    def known(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, c, likelihood = sent.value
        # one entry more for words that are not listed
        number = {w: i for i, w in enumerate(listed)}
        seen, base, lattice = np.append(c > 0, False).astype(np.int64), np.append(np.log10(c + 1.0), 0.0), np.append(likelihood, 0.0)
        key = TaskContext.get().partitionId() << 40
        for batch in rows:
            texts = as_bytes(batch.column(1))
            for lo, hi in batches(texts):
                parts = [[*_words(t), b""] for t in texts[lo:hi]]
                lengths = np.array([len(p) for p in parts])
                flat = list(itertools.chain.from_iterable(parts))
                at = np.array([number.get(w, len(listed)) for w in flat])
                of = np.repeat(np.arange(hi - lo), lengths)
                keys = np.arange(key, key + hi - lo)
                key += hi - lo
                sums = [np.bincount(of, x[at], hi - lo) for x in (seen, base, lattice)]
                other = np.flatnonzero(at == len(listed))
                rare = Counter(zip(of[other].tolist(), map(flat.__getitem__, other.tolist()), strict=True))
                owner = np.array([d for d, _ in rare], np.int64)
                n = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys, keys[owner]])),
                        pa.concat_arrays([pa.nulls(hi - lo, pa.binary()), pa.array([w for _, w in rare], pa.binary())]),
                        pa.concat_arrays([pa.array(lengths), pa.array(list(rare.values()), pa.int64())]),
                        pa.concat_arrays([batch.column(0).slice(lo, hi - lo), pa.nulls(n, batch.column(0).type)]),
                        pa.concat_arrays([batch.column(2).slice(lo, hi - lo), pa.nulls(n, pa.bool_())]),
                        *(pa.concat_arrays([pa.array(x.astype(kind)), pa.nulls(n, arrow)]) for x, kind, arrow in zip(sums, (np.int64, float, float), (pa.int64(), pa.float64(), pa.float64()), strict=True)),
                    ],
                    ["key", "word", "n", "doc_id", "held_out", "n_known", "base", "lattice"],
                )
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = saved(docs.select("doc_id", F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(known, f"key bigint, word binary, n bigint, doc_id {kind}, held_out boolean, n_known bigint, base double, lattice double"))
    times = F.col("n")
    rare = found.filter("word is not null").select("key", "word", "n").join(lexicon.select("word", "c", "likelihood"), "word")
    added = rare.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("more_known"), F.sum(times * F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(times * F.col("likelihood")).alias("more_lattice"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    whole = found.filter("word is null").join(added, "key", "left")
    return whole.select("doc_id", "held_out", F.col("n").alias("n_tokens"), plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (plus("base", "more_base") - times * F.lit(float(rest))).alias("base_score"), plus("lattice", "more_lattice").alias("score"))
