"""Mixing sources to target weights, with DataFrame functions only.

Words are summed for each source, weights become target words by resharing what is above a source's
ceiling, and each document is emitted floor(rate) times and once more if a hash of it falls below the
rate's fraction. Of a fixed number of hash seeds, each source takes the one whose Bernoulli draws come
nearest its target, so that sources with few documents come near it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.scratch import drop, fresh, saved, small

#: Weights by the rank of a source, the share of all words, the ceiling of a source.
WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2.0
SEEDS = 16
#: A table of sources of up to so many rows is broadcast.
FEW_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources take the weights in turn by code point, null last. A source is full at ``ceiling`` times its
    size; with sources in the order of ceiling over weight, the full ones are those before the first at
    which an even rise of all others ends below its ceiling.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    table = by_source.withColumn("weight", w).withColumn("full", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    table = table.withColumn("level", level)
    # the level at the first source that does not fill up, the highest such; none: all are full
    rise = F.max(F.when(F.col("level") * F.col("weight") < F.col("full"), F.col("level"))).over(everywhere)
    return table.withColumn("rise", rise).select("source", "source_size", F.coalesce(F.least(F.col("rise") * F.col("weight"), "full"), "full").alias("target"))


def plan(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``.

    Null texts have size 0; a null source is a source. Rows that agree in id and text are emitted alike.
    A source without words has target 0 and gives no copies. An empty table gives no rows. The plan is
    the same in every run. Columns of ``docs`` with these names are replaced, others stay.
    """
    made = ("size", "source_size", "target", "copies")
    planned, name = _planned(docs.drop(*[f"mix_{c}" for c in made]), seed, **how)
    return planned.withColumnsRenamed({name[c]: f"mix_{c}" for c in made})


def _planned(docs: DataFrame, seed: int, **how) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with each row's size, its source's size and target, and its copies; and those columns' names."""
    name = {c: fresh(docs, f"mix_{c}") for c in ("size", "source_size", "target", "copies", "key", "rate", "turn", "source")}
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.withColumns({name["size"]: words(F.col("text")), name["key"]: key})
    narrow = saved(sized.select("source", F.col(name["key"]).alias("key"), F.col(name["size"]).alias("size")))
    rates = saved(targets(narrow, **how).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    few = small(rates, FEW_SOURCES)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", name["source"])
        return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right[name["source"]])).drop(name["source"])

    def draw(key: str, turn: Column) -> Column:
        """A number from 0 to 1 that a document's hash and the seed's number decide."""
        return F.pmod(F.xxhash64(F.col(key), turn), F.lit(1 << 40)) / float(1 << 40)

    fraction = F.col("rate") - F.floor("rate")
    draws = joined(narrow, rates.select("source", "rate"))
    extra = [F.sum(F.when(draw("key", F.lit(i)) < fraction, F.col("size")).otherwise(0)).cast("double").alias(f"x{i}") for i in range(SEEDS)]
    sums = draws.groupBy("source").agg(*extra)
    best = rates.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("want", F.col("target") - F.floor("rate") * F.col("source_size"))
    errors = F.array(*[F.struct(F.abs(F.col(f"x{i}") - F.col("want")).alias("e"), F.lit(i).alias("i")) for i in range(SEEDS)])
    chosen = saved(best.select("source", "source_size", "target", "rate", F.array_min(errors)["i"].alias("turn")))
    drop(narrow, rates)
    out = joined(sized, chosen.withColumnsRenamed({c: name[c] for c in ("source_size", "target", "rate", "turn")}))
    rate = F.col(name["rate"])
    copies = F.floor(rate) + (draw(name["key"], F.col(name["turn"])) < rate - F.floor(rate)).cast("int")
    return out.withColumn(name["copies"], copies.cast("int")).drop(*[name[c] for c in ("rate", "turn", "key")]), name


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The mixed documents: each row as often as :func:`plan` says, with the columns of ``docs`` unchanged."""
    planned, name = _planned(docs, seed, **how)
    return planned.withColumn(name["turn"], F.explode(F.array_repeat(F.lit(0), F.col(name["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])
