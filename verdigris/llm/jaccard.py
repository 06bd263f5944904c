"""N-gram Jaccard join with signature trees.

Texts become sets of word n-grams; equal sets are one class. Two classes that link share an n-gram among
the first few of each in one global order (prefix filter), so each n-gram is the root of a tree over the
classes that have it there, frequent n-grams last. A tree's nodes hold size ranges and OR-combined bitmaps of
their members' n-grams. Its members lie by size and by their smallest n-gram, so that near copies share nodes.
A dual traversal goes down from the pair of the root with itself, and leaves out every pair of nodes whose
largest possible overlap is too small, or which lie in one component: between blocks of members by joins of
node summaries, within two blocks in memory. What is left is verified on the whole sets.

Copies don't make all their pairs. In a few turns before the last, blocks are traversed from the leaves up and
labels are merged on the way, so that a family of n members gives n - 1 pairs at most; these are verified and
make components, whose members the next turn doesn't compare. The last turn traverses whatever is still apart and
merges nothing, so it gives every pair left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.components import components
from verdigris.llm.scratch import drop, fresh, saved, small
from verdigris.llm.text import as_bytes, batches, hashed, ngrams, signed, trim

#: Children of a node, as a power of two; members of a block, about; turns that merge labels before the last one,
#: and the members of each component that a group has in such a turn after the first.
FAN_BITS, BLOCK, TURNS, SPREAD = 3, 1024, 3, 8
#: Bits of a bitmap, as a power of two, up to which it is made for few tokens; first tokens of a class that tell
#: in which of its groups a pair is given.
FEW_BITS, LEADS = 10, 8
#: Pairs of nodes whose bitmaps are compared at once; bytes of compressed texts whose sets are.
CHUNK, PACKED = 4096, 1 << 20
#: N-grams kept as frequent: the most frequent of those in HEAVY_LEAST documents of one batch; they only order
#: the n-grams, so that no result depends on them. Rows of a table that is broadcast.
HEAVY, HEAVY_LEAST, BROADCAST_ROWS = 100_000, 16, 1_000_000


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct n-grams; with fewer words, of the whole sequence."""
    h, _, _, first, _ = hashed([t.lower() for t in texts])
    grams = ngrams(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngrams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _class(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _read(docs: DataFrame, n: int, make, schema: str, whole: bool = False) -> DataFrame:
    """``make(ids, sets)``, with ``whole`` also of the texts, over parts of a few megabytes of text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, ids = as_bytes(batch.column(1)), batch.column(0)
            for lo, hi in batches(texts):
                yield from make(ids.slice(lo, hi - lo), _sets(texts[lo:hi], n), *([texts[lo:hi]] if whole else []))
        trim()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def _bits(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens: at least as many bits as tokens, four times as many as long as they are few."""
    few = (len(tokens) - 1).bit_length()
    size = 1 << max(6, few, min(few + 2, FEW_BITS))
    out = np.zeros(size, np.uint8)
    out[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def _needed(total, percent: int):
    """The overlap that two sets of ``total`` tokens together need to link."""
    return -(-percent * total // (100 + percent))


#: What a node of a tree is compared by, and a member as a node.
_NODE = ["lo", "hi", "loose", "label", "bits"]
_MEMBER = ["n AS lo", "n AS hi", "CAST(NULL AS bigint) AS loose", "label", "bits"]


class _Join:
    """One run of the join over one table."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent

    def members(self) -> tuple[DataFrame, np.ndarray]:
        """``doc_id, cls, n`` of all rows, and the frequent tokens in rising order."""

        def make(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = counts >= HEAVY_LEAST
            kinds = ["kind", "doc_id", "cls", "n"]
            classes = pa.array([_class(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), ids, classes, pa.array([len(s) for s in sets], pa.int64())], kinds)
            yield pa.RecordBatch.from_arrays([pa.array([1] * int(often.sum()), pa.int32()), pa.nulls(int(often.sum()), pa.int64()), signed(tokens[often]), pa.array(counts[often].astype(np.int64))], kinds)

        both = saved(_read(self.docs, self.n, make, "kind int, doc_id bigint, cls bigint, n bigint"))
        top = both.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(HEAVY)
        heavy = np.array([r["cls"] for r in top.collect()], np.int64).view(np.uint64)
        return both.filter("kind = 0").drop("kind"), np.sort(heavy)

    def classes(self, heavy: np.ndarray) -> DataFrame:
        """``cls, n, first`` (the prefix's tokens in order) and ``bits`` of each class."""
        percent = self.percent

        def make(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sets = [s for s in sets if len(s)]
            prefixes = []
            for s in sets:
                p = len(s) - -(-percent * len(s) // 100) + 1
                often = np.isin(s, heavy, assume_unique=True)
                prefixes.append(np.concatenate([s[~often], s[often]])[:p].view(np.int64) if often.any() else s[:p].view(np.int64))
            flat = pa.array(np.concatenate(prefixes) if sets else np.zeros(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            bits = pa.array([_bits(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat), bits], ["cls", "n", "first", "bits"])

        rows = _read(self.docs, self.n, make, "cls bigint, n bigint, first array<bigint>, bits binary")
        return saved(rows.groupBy("cls").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits")))

    def groups(self, classes: DataFrame) -> DataFrame:
        """``token, cls, n, least``: classes by the tokens that two or more have in their prefixes.

        Of tokens that the same classes have, one stays, as they would give the same pairs; sets of classes are
        told apart by their sizes and by 128 bits. ``least`` is a class's first token.
        """
        rows = classes.select("cls", F.explode("first").alias("token"))  # no repartition, so that Spark may split a frequent token
        # most tokens are in one prefix only: their counts alone are shuffled, hashes for the few others
        often = rows.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token").hint("shuffle_hash")
        shared = saved(rows.join(often, "token"))
        held = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"h{i}") for i in range(2)]
        sizes = shared.groupBy("token").agg(F.count("*").alias("size"), *held)
        kept = sizes.groupBy("size", "h0", "h1").agg(F.min("token").alias("token")).select("token").hint("shuffle_hash")
        narrow = saved(shared.join(kept, "token"))
        drop(shared)
        out = saved(narrow.join(classes.select("cls", "n", F.element_at("first", 1).alias("least")), "cls"))
        drop(narrow)
        return out

    @staticmethod
    def labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
        """``groups`` with ``label``, the component of each class so far, at first itself, and ``linked``, whether it
        is in one with others."""
        if labels is None:
            return groups.select("*", F.col("cls").alias("label"), F.lit(False).alias("linked"))
        named = groups.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        return named.withColumns({"label": F.coalesce("component", "cls"), "linked": F.col("component").isNotNull()}).drop("component")

    def chosen(self, groups: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
        """``token, cls, n, least, label``: what the trees of a turn that merges labels hold.

        At first each class is in one of its groups, by the smallest hash, so near copies mostly meet. Later turns take
        the groups that hold a component, and of each component SPREAD members at most in each group, others in each turn.
        """
        if labels is None:
            first = F.min(F.struct(F.xxhash64("token").alias("turn"), "token", "n", "least")).alias("first")
            return groups.groupBy("cls").agg(first).select("first.token", "cls", "first.n", "first.least", F.col("cls").alias("label"))
        named = self.labelled(groups, labels)
        some = named.groupBy("token").agg(F.max("linked").alias("linked")).filter("linked").select("token")
        turned = F.xxhash64("cls", F.lit(turn))
        one = F.min(F.struct(turned.alias("turn"), "cls", "n", "least")).alias("one")
        rows = named.join(some, "token", "left_semi").groupBy("token", "label", F.pmod(turned, F.lit(SPREAD)).alias("part")).agg(one)
        return rows.select("token", "one.cls", "one.n", "one.least", "label")

    def verified(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs that link by their whole sets, which are read again from one document of each class."""
        percent = self.percent
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        reps = saved(members.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
        docs = self.docs.select("doc_id", "text")
        wanted = reps.select(F.col("doc_id").alias("rep")).distinct()
        wanted = F.broadcast(wanted) if small(reps, BROADCAST_ROWS) else wanted
        texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        n = self.n

        def make(ids: pa.Array, sets: list[np.ndarray], whole: list[bytes]) -> Iterator[pa.RecordBatch]:
            some = [(_class(s), t) for s, t in zip(sets, whole, strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int64()), pa.array([zlib.compress(t, 1) for _, t in some], pa.binary())], ["cls", "whole"])

        # texts, as they are shorter than their hashes; compressed, as a task holds many pairs of them at once
        sets = _read(texts, n, make, "cls bigint, whole binary", True).join(reps.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("whole").alias("whole"))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                sides = [batch.column(i).to_pylist() for i in (2, 3)]
                good = []
                for lo, hi in batches([a + b for a, b in zip(*sides, strict=True)], PACKED):
                    for a, b in zip(*(_sets(list(map(zlib.decompress, side[lo:hi])), n) for side in sides), strict=True):
                        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                        good.append(100 * common >= percent * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
            trim()

        wide = pairs.join(sets.select(F.col("cls").alias("a"), F.col("whole").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("whole").alias("tb")), "b")
        out = saved(wide.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"))
        drop(reps)
        return out

    @staticmethod
    def placed(named: DataFrame) -> DataFrame:
        """Members of trees: of ``named`` (``token, cls, n, least, label``) the groups of several components.

        ``token, cls, n, least, label, band, block``: members lie by size band, then by their smallest token, and
        a block is about BLOCK of them. Their places come from counts by band and by the first bits of that
        token, so that no task orders a whole group.
        """
        open_ = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))).cast("int")
        held = saved(named.join(open_, "token", "left_semi").withColumns({"band": band, "bin": F.shiftrightunsigned("least", 52)}))
        cell = ["token", "band", "bin"]
        counts = held.groupBy(*cell).agg(F.count("*").alias("held"))
        before = Window.partitionBy("token").orderBy("band", "bin").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
        share = F.pmod(F.xxhash64("least", "cls"), F.lit(1 << 30)) / float(1 << 30)
        block = F.floor((F.col("start") + F.floor(share * F.col("held"))) / BLOCK)
        out = saved(held.join(starts, cell).select("token", "cls", "n", "least", "label", "band", block.alias("block")))
        drop(held)
        return out

    def block_pairs(self, placed: DataFrame, classes: DataFrame) -> DataFrame:
        """``token, a, b``: pairs of blocks, ``a <= b``, that a dual traversal of the trees above them leaves.

        A summary is made for each block of a tree with several; a node above has 8 children. A tree of one
        block is its root's pair with itself.
        """
        percent = self.percent
        last = saved(placed.groupBy("token").agg(F.max("block").alias("last")))
        tall = last.filter("last > 0")
        top = tall.agg(F.max("last")).first()[0] or 0
        schema = "token bigint, node bigint, lo bigint, hi bigint, loose bigint, label bigint, bits binary"

        def summed(key: tuple, table: pa.Table) -> pa.Table:
            nodes = _Nodes.of(table)
            return nodes.merged(np.zeros(1, np.int64)).table(key)

        rows = placed.join(tall, "token", "left_semi").join(classes.select("cls", "bits"), "cls").selectExpr("token", "block AS node", *_MEMBER)
        levels = []
        while top >> (FAN_BITS * len(levels)):
            levels.append(saved(rows.groupBy("token", "node").applyInArrow(summed, schema)))
            rows = levels[-1].withColumn("node", F.shiftright("node", FAN_BITS))

        def tested(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_:
                sides = [_Nodes.of(pa.Table.from_batches([batch]).select([f"{c}{x}" for c in _NODE]).rename_columns(_NODE)) for x in "ab"]
                good = sides[0].joined(sides[1]).possible(np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows, percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:3]], ["token", "a", "b"])

        pairs = tall.select("token", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
        for nodes in reversed(levels):
            one, two = (nodes.select(F.col("token"), F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in nodes.columns[2:]]) for x in "ab")
            parents = pairs.select("token", F.col("a").alias("pa"), F.col("b").alias("pb"))
            left = parents.join(one.withColumn("pa", F.shiftright("a", FAN_BITS)), ["token", "pa"])
            both = left.join(two.withColumn("pb", F.shiftright("b", FAN_BITS)), ["token", "pb"]).filter("a <= b").filter(100 * F.least("hia", "hib") >= percent * F.greatest("loa", "lob"))
            pairs = both.select("token", "a", "b", *one.columns[2:], *two.columns[2:]).mapInArrow(tested, "token bigint, a bigint, b bigint")
            pairs = saved(pairs)
        return pairs.union(last.filter("last = 0").select("token", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))

    def tree_pairs(self, placed: DataFrame, classes: DataFrame) -> DataFrame:
        """All pairs of classes of different components that the trees let through."""
        percent = self.percent
        pairs = self.block_pairs(placed, classes)
        sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
        asked = pairs.select("token", "a", "b", F.explode(sides).alias("s")).select("token", "a", "b", "s.block", "s.side")
        leads = placed.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("token")), 1, LEADS).alias("leads"))
        # bitmaps come last, so that they are shuffled once
        rows = placed.join(asked, ["token", "block"]).join(classes.select("cls", "bits").join(leads, "cls"), "cls").selectExpr("token", "a", "b", "side", "band", "least", "cls", "leads", *_MEMBER)
        rows = rows.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "side", "band", "least", "cls")

        def traverse(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole(batches_, 3):
                x, y = _once(table, *_traversed(table, percent))
                cls = table.column("cls").to_numpy()
                both = np.unique(np.sort(np.stack([cls[x], cls[y]]), axis=0), axis=1) if len(x) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
            trim()

        return rows.mapInArrow(traverse, "a bigint, b bigint").distinct()

    def forest_pairs(self, placed: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
        """Pairs that connect, within each block, all members that its tree lets through: one fewer than members at most."""
        percent = self.percent
        rows = placed.join(classes.select("cls", "bits"), "cls").selectExpr("token", "block AS a", "block AS b", "0 AS side", "band", "least", "cls", *_MEMBER)
        rows = rows.repartition("token", "a").sortWithinPartitions("token", "a", "band", "least", "cls")

        def traverse(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole(batches_, 2):
                x, y = _forest(table, percent, turn)
                cls = table.column("cls").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y]))], ["a", "b"])
            trim()

        return rows.mapInArrow(traverse, "a bigint, b bigint").distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """``doc_id, cls, n`` of all rows, and ``node, component`` of linked classes."""
        members, heavy = self.members()
        classes = self.classes(heavy)
        groups = self.groups(classes)
        found = edges = None
        last = False
        for turn in range(TURNS + 1):
            last = last or turn == TURNS
            placed = self.placed(self.labelled(groups, found) if last else self.chosen(groups, found, turn))
            close = saved(self.tree_pairs(placed, classes) if last else self.forest_pairs(placed, classes, turn))
            drop(placed)
            none = close.isEmpty()
            if not none:
                more = self.verified(close, members)
                found = saved(components(more if edges is None else edges.union(more)))
                edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
                drop(more)
            drop(close)
            if last:
                break
            last = none  # nothing was let through, so another turn before the last would give nothing either
        drop(groups, classes)
        return members, found if found is not None else members.select(F.col("cls").alias("node"), F.col("cls").alias("component")).filter("false")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as of ``size`` bytes: its parts OR-combined."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


class _Nodes:
    """Nodes of one level: size ranges, the most tokens without a bit of their own, one label or -1, and
    bitmaps, as long as the shortest of the members'."""

    def __init__(self, lo, hi, loose, label, bits: list[np.ndarray]):
        self.lo, self.hi, self.loose, self.label, self.bits = lo, hi, loose, label, bits
        self.width = np.array([len(b) for b in bits], np.int64)

    @classmethod
    def of(cls, table: pa.Table) -> _Nodes:
        """Nodes of a table; ``loose`` is null for members, whose bitmaps say it."""
        bits = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        label = table.column("label").fill_null(-1).to_numpy()
        loose = table.column("loose")
        if loose.null_count:
            loose = lo - np.array([int(np.bitwise_count(b).sum()) for b in bits], np.int64)
        else:
            loose = loose.to_numpy()
        return cls(lo, hi, loose, label, bits)

    def joined(self, other: _Nodes) -> _Nodes:
        cols = (np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("lo", "hi", "loose", "label"))
        return _Nodes(*cols, self.bits + other.bits)

    def merged(self, first: np.ndarray) -> _Nodes:
        """The nodes above: each has the nodes from one of ``first`` up to the next as its children."""
        stop = np.append(first[1:], len(self.lo)).tolist()
        lowest, highest = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
        bits, loose = [], []
        for a, b in zip(first.tolist(), stop, strict=True):
            if b - a == 1:
                bits.append(self.bits[a])
                loose.append(self.loose[a])
                continue
            size = min(map(len, self.bits[a:b]))
            folded = [_folded(x, size) for x in self.bits[a:b]]
            bits.append(np.bitwise_or.reduce(folded))
            # a token that folding takes onto another's bit has no bit of its own any more
            lost = [int(np.bitwise_count(x).sum()) - int(np.bitwise_count(y).sum()) if len(x) != size else 0 for x, y in zip(self.bits[a:b], folded, strict=True)]
            loose.append(max(int(n) + m for n, m in zip(self.loose[a:b], lost, strict=True)))
        return _Nodes(np.minimum.reduceat(self.lo, first), np.maximum.reduceat(self.hi, first), np.array(loose, np.int64), np.where(lowest == highest, lowest, -1), bits)

    def table(self, key: tuple) -> pa.Table:
        label = pa.array(self.label, mask=self.label == -1)
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array(x) for x in (self.lo, self.hi, self.loose)] + [label, pa.array([b.tobytes() for b in self.bits], pa.binary())], ["token", "node", *_NODE])

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether a member of ``a[i]`` and one of ``b[i]`` may link, by the largest overlap they can have."""
        need = _needed(self.lo[a] + self.lo[b], percent)
        good = 100 * np.minimum(self.hi[a], self.hi[b]) >= percent * np.maximum(self.lo[a], self.lo[b])
        good &= (self.label[a] != self.label[b]) | (self.label[a] == -1)
        at = np.flatnonzero(good)
        for lo in range(0, len(at), CHUNK):
            part = at[lo : lo + CHUNK]
            widths = np.minimum(self.width[a[part]], self.width[b[part]])
            for w in np.unique(widths).tolist():
                of = part[widths == w]
                sides = []
                for x in (a[of], b[of]):
                    nodes, back = np.unique(x, return_inverse=True)
                    bits = np.stack([_folded(self.bits[i], w) for i in nodes.tolist()])
                    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                    folded = np.array([int(np.bitwise_count(self.bits[i]).sum()) if len(self.bits[i]) != w else 0 for i in nodes.tolist()], np.int64)
                    lost = np.where(folded > 0, folded - ones, 0)
                    sides.append((bits[back], (self.loose[nodes] + lost)[back]))
                common = np.bitwise_count(sides[0][0] & sides[1][0]).sum(axis=1, dtype=np.int64)
                good[of] = np.minimum(sides[0][1], sides[1][1]) + common >= need[of]
        return good


def _whole(batches_: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that rows that agree in the first ``keys`` columns stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches_:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns[:keys]]
        turn = np.zeros(batch.num_rows, bool)
        for c in cols:
            turn[1:] |= c[1:] != c[:-1]
        turn[0] = bool(held) and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(cols))
        cut = np.flatnonzero(turn)
        if len(cut):
            done = [*held, batch.slice(0, int(cut[-1]))]
            if sum(x.num_rows for x in done):
                yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _trees(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[_Nodes], list[np.ndarray]]:
    """Trees over the rows of each ``token, a, b, side``: where groups and trees start, the levels from the members
    up, and for each level above the first child of each node."""
    cols = [table.column(c).to_numpy() for c in ("token", "a", "b", "side")]
    n = table.num_rows
    group, tree = np.zeros(n, bool), np.zeros(n, bool)
    for c in cols[:3]:
        group[1:] |= c[1:] != c[:-1]
    tree[1:] = group[1:] | (cols[3][1:] != cols[3][:-1])
    group[0] = tree[0] = True
    of_tree = np.cumsum(tree) - 1
    rank = np.arange(n) - np.flatnonzero(tree)[of_tree]
    levels, firsts = [_Nodes.of(table)], []
    while int(rank.max()):
        rank = rank >> FAN_BITS
        first = np.flatnonzero(np.append(True, (of_tree[1:] != of_tree[:-1]) | (rank[1:] != rank[:-1])))
        firsts.append(np.append(first, len(rank)))
        levels.append(levels[-1].merged(first))
        of_tree, rank = of_tree[first], rank[first]
    return group, tree, levels, firsts


def _descended(x: np.ndarray, y: np.ndarray, nodes: _Nodes, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children, of level ``nodes``, of pairs of nodes, that may link."""
    found = []
    for at in range(0, len(x), CHUNK):
        a, b = _children(x[at : at + CHUNK], y[at : at + CHUNK], first)
        keep = nodes.possible(a, b, percent)
        found.append((a[keep], b[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _forest(table: pa.Table, percent: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what may link within each ``token, a``, by a dual traversal from the leaves up.

    The children of each node are paired, level by level. Two of them first meet by one member each, which
    ``turn`` picks; only if these may not link the traversal goes down from the pair. Labels are merged at
    once, so that a pair of nodes of one label is never looked into.
    """
    _, _, levels, firsts = _trees(table)
    random = np.random.default_rng(turn)
    order = np.argsort(table.column("cls").to_numpy().view(np.uint64) * np.uint64(int(random.integers(1 << 62)) * 2 + 1))
    ranks = [np.argsort(order)]
    for first in firsts:
        ranks.append(np.minimum.reduceat(ranks[-1], first[:-1]))
    label = np.unique(levels[0].label, return_inverse=True)[1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, first in enumerate(firsts):
        _relabel(levels[: k + 1], firsts, label)
        parents = np.arange(len(first) - 1)
        x, y = _descended(parents, parents, levels[k], first, percent)
        x, y = x[x != y], y[x != y]
        one, two = order[ranks[k][x]], order[ranks[k][y]]
        keep = levels[0].possible(one, two, percent)
        label = _merged_labels(label, one[keep], two[keep], random, found)
        _relabel(levels[: k + 1], firsts, label)
        keep = levels[k].possible(x, y, percent)
        x, y = x[keep], y[keep]
        for j in range(k, 0, -1):
            x, y = _descended(x, y, levels[j - 1], firsts[j - 1], percent)
        label = _merged_labels(label, x, y, random, found)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _relabel(levels: list[_Nodes], firsts: list[np.ndarray], label: np.ndarray) -> None:
    """Give the members ``label``, and each node above the label of its members or -1."""
    levels[0].label = label
    for below, nodes, first in zip(levels, levels[1:], firsts, strict=False):
        lowest, highest = np.minimum.reduceat(below.label, first[:-1]), np.maximum.reduceat(below.label, first[:-1])
        nodes.label = np.where(lowest == highest, lowest, -1)


def _merged_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray, random: np.random.Generator, found: list) -> np.ndarray:
    """``label`` after the labels of each pair are merged; the pairs that it takes are added to ``found``."""
    mixed = random.permutation(len(x))
    x, y = x[mixed], y[mixed]
    while True:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return label
        # each label is hung below one smaller label, so there are no rings
        labels, at = np.unique(np.maximum(label[x], label[y]), return_index=True)
        found.append((x[at], y[at]))
        above = np.arange(int(label.max()) + 1)
        above[labels] = np.minimum(label[x[at]], label[y[at]])
        while not np.array_equal(above, above[above]):
            above = above[above]
        label = above[label]


def _traversed(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``table`` that may link: a dual traversal of the tree of side 0 with itself, or with that of side 1
    where there is one."""
    group, tree, levels, firsts = _trees(table)
    # roots are trees now, in order; a group has one or two
    starts = np.flatnonzero(group[np.flatnonzero(tree)])
    x, y = starts, np.append(starts[1:], int(tree.sum())) - 1
    keep = levels[-1].possible(x, y, percent)
    x, y = x[keep], y[keep]
    for nodes, first in zip(reversed(levels[:-1]), reversed(firsts), strict=True):
        x, y = _descended(x, y, nodes, first, percent)
    keep = x != y
    return x[keep], y[keep]


def _once(table: pa.Table, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows without those that the group of an earlier token gives, as far as the rows' first tokens tell."""
    token, lists = table.column("token").to_numpy(), table.column("leads").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    leads = np.full((len(n), LEADS), np.iinfo(np.int64).max)
    leads[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    keep = np.ones(len(x), bool)
    for at in range(0, len(x), CHUNK):
        a, b = x[at : at + CHUNK], y[at : at + CHUNK]
        shared = (leads[a][:, :, None] == leads[b][:, None, :]) & (leads[a] < token[a][:, None])[:, :, None]
        keep[at : at + CHUNK] = ~shared.any(axis=(1, 2))
    return x[keep], y[keep]


def _children(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of each pair of nodes, once each."""
    nx, ny = first[x + 1] - first[x], first[y + 1] - first[y]
    of = np.repeat(np.arange(len(x)), nx * ny)
    k = np.arange(len(of)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
    a, b = first[x][of] + k // ny[of], first[y][of] + k % ny[of]
    keep = (x[of] != y[of]) | (a <= b)
    return a[keep], b[keep]


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row for each row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of word n-grams (A-Z
    lower-cased; with fewer than ``n`` words the whole sequence). ``component_id`` is the smallest id
    reachable by links. Null and empty texts have no n-grams and link with nothing; a null id is never the
    smallest unless all are null. Repeated rows are one class. Other columns of ``docs`` are not read.
    N-grams and sets are told apart by 64-bit hashes.
    """
    members, found = _Join(docs, n, percent).run()
    lowest = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    named = lowest.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(ids, "component").select("cls", "component_id")
    out = members.join(by_class, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id, and every row without words.

    Rows are told apart by a 64-bit hash of id and text; null ids come last, equal ids go by that hash. Of
    rows with the same id and text one stays. An empty table gives no rows. Columns are those of ``docs``,
    whatever their names.
    """
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("bigint")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    members, found = _Join(docs.select(key.alias("doc_id"), F.col("text").cast("string")), n, percent).run()
    keys = members.filter("cls is not null").select(F.col("doc_id").alias("key"), "cls").distinct()
    rows = saved(keys.join(ids, "key"))
    lowest = rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"))
    named = lowest.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    kept = named.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.key", F.lit(True).alias("kept"))
    # joined by key, as a class of many copies would be one task
    decided = saved(rows.join(kept, "key", "left").filter("kept IS NULL OR copies > 1").select("key", F.col("kept").isNull().alias("gone")))
    drop(rows)
    stay = _matched(docs, key, decided.filter("gone"), "left_anti")
    again = decided.filter("not gone")
    if again.isEmpty():
        return stay
    one = _matched(docs, key, again, "left_semi").groupBy(key.alias("key")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return _matched(stay, key, again, "left_anti").union(one.select("row.*"))


def _matched(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``key`` of ``keys``, which are broadcast if they are few."""
    name = fresh(docs, "key")
    keys = keys.select(F.col("key").alias(name))
    return docs.join(F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys, key == F.col(name), how)
