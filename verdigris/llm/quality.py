"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown over text statistics; every path from a root becomes a rule, a conjunction of
thresholds. A logistic model with a lasso penalty weighs the rules, and those it keeps are compiled into
one Spark column expression, so that scoring is a single pass of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.labelled import held_out, sample
from verdigris.llm.scratch import drop, fresh, saved

#: At most so many labelled documents are learned from.
SAMPLE_ROWS = 20_000

_WORD = r"[^\x20\x09-\x0D]+"


#: What is counted in a text, by the patterns of each.
COUNTED = {"capitals": r"\p{Lu}{2,}", "symbols": r"[#*$%&|<>]+", "bangs": "!+", "digits": "[0-9]+", "stops": "[.,;:?]+", "lines": r"\n"}
STATISTICS = ("s_words", "s_word_chars", *(f"s_{n}" for n in COUNTED), "s_distinct")


def _counts(text: Column) -> Column:
    """What is counted in a whole text, as a struct; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = {n: F.regexp_count(text, F.lit(p)).cast("double") for n, p in ({"words": _WORD} | COUNTED).items()}
    distinct = F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+")))
    return F.struct(*[c.alias(n) for n, c in (found | {"word_chars": F.char_length(text), "distinct": distinct}).items()])


def _shares(counts: str) -> Column:
    """The statistics, as a struct, from the column of counts: the words, and all else for each word."""
    of = lambda n: F.col(f"{counts}.{n}").cast("double")
    per = F.greatest(of("words"), F.lit(1.0))
    return F.struct(*[(of("words") if n == "s_words" else of(n.removeprefix("s_")) / per).alias(n) for n in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """Tests ``(statistic, at most?, threshold)`` that hold together."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, within: str = "") -> Column:
        """The rule over columns of its statistics' names, or over fields of the column ``within``."""
        out = F.lit(True)
        for name, at_most, threshold in self.tests:
            value = F.col(f"{within}.{name}" if within else name)
            out = out & (value <= threshold if at_most else value > threshold)
        return out


def paths(tree, names: list[str]) -> list[Rule]:
    """The rules of one fitted tree: the conjunction at every node below the root."""
    found: list[Rule] = []

    def walk(node, tests: tuple) -> None:
        if tests:
            found.append(Rule(tests))
        if node.subtreeDepth() == 0:
            return
        name, threshold = names[node.split().featureIndex()], float(node.split().threshold())
        for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
            same = [t for t in tests if t[:2] == (name, at_most)]
            tight = min if at_most else max
            kept = tuple(t for t in tests if t not in same)
            walk(child, (*kept, (name, at_most, tight([threshold, *[t[2] for t in same]]))))

    walk(tree._call_java("rootNode"), ())
    return found


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``constant`` is the score where there was nothing to learn from."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float
    constant: float | None = None

    def score(self, within: str = "") -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(within), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, trees: int = 24, depth: int = 3, penalty: float = 0.0005, seed: int = 11) -> RuleModel:
    """Learn from at most ``rows`` labelled documents; only their text is used.

    With one label among them the score is that label, with none it is 0.5.
    """
    chosen = F.broadcast(sample(labels, label, rows))  # at most ``rows`` rows
    measured, name = _measured(docs.select("doc_id", "text").join(chosen, "doc_id"))
    seen = saved(measured.select("label", f"{name}.*"))
    try:
        got = {r["label"] for r in seen.select("label").distinct().collect()}
        if len(got) < 2:
            return RuleModel((), 0.0, next(iter(got), 0.5))
        data = seen.coalesce(2).select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(data)
        rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree, list(STATISTICS))))
        held = F.array(*[rule.column().cast("double") for rule in rules])
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
        model = lasso.fit(seen.coalesce(2).select("label", array_to_vector(held).alias("features")))
    finally:
        drop(seen)
    weights = model.coefficients.toArray().tolist()
    return RuleModel(tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), float(model.intercept))


def _measured(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of the statistics, and that column's name.

    The struct comes out of a generator, as do the counts that it is made of, so that a filter on what is computed
    from it can't be moved below it: that would write each count out again for every rule that reads it.
    """
    counts, name = fresh(docs, "counts"), fresh(docs, "statistics")
    own = [F.col(f"`{c}`") for c in docs.columns]
    counted = docs.select(*own, F.explode(F.array(_counts(F.col("text")))).alias(counts))
    return counted.select(*own, F.explode(F.array(_shares(counts))).alias(name)), name


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; columns of these names are replaced, others stay.

    Every row is scored by its whole text, repeated rows alike; null and empty texts have the statistics of an
    empty text. Null ids count as not held out. An empty table gives no rows.
    """
    measured, name = _measured(docs.drop("held_out", "score", "predicted"))
    out = measured.withColumn("score", model.score(name)).drop(name)
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged, whatever their columns are called.

    Null and empty texts are judged as empty texts; repeated rows are kept or go together; null ids, which no
    label marks, are judged by their texts. Without labels all rows score 0.5. An empty table gives no rows.
    """
    measured, name = _measured(docs)
    model = fit(docs, labels, **how)
    return measured.filter(model.score(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
