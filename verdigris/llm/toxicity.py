"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are lower-cased and folded first: look-alike letters, and digits or signs that stand for letters
inside a word. The lexicon holds words and beginnings of words that toxic documents have much more often,
each only if it explains documents that stronger ones don't; phrases in which such a word is usual in
clean documents are exceptions. The weight of a text's matches, on its own and for its length, goes
through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.labelled import held_out, sample
from verdigris.llm.scratch import drop, fresh, saved

#: At most so many labelled documents are learned from.
SAMPLE_ROWS = 20_000

# Letters of other scripts that look like Latin ones, and signs used in place of letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαορντικυ", "aeopcyxijsdhkmtbhaopvtiku")
SIGNS = str.maketrans("01345789@$!|+", "oieastbgasiit")

_WORD = re.compile(r"[^\W\d_]+")
_SIGNED = re.compile(r"(?<![a-z])[a-z]*[0-9@$!|+][a-z0-9@$!|+]*")
_OTHER = re.compile("[\u0370-\u052f\uff00-\uffef]")


def _plain(found: re.Match) -> str:
    word = found[0].rstrip("@$!|+")
    letters = sum(c.isalpha() for c in word)
    return word.translate(SIGNS) + found[0][len(word) :] if 2 <= letters < len(word) and 5 * letters >= 2 * len(word) else found[0]


def fold(text: str) -> str:
    """Lower-cased text with look-alikes and in-word signs as plain letters."""
    text = text.lower()
    if _OTHER.search(text):
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    return _SIGNED.sub(_plain, text)


#: Lengths of beginnings of words that may be entries of the lexicon, written with a star.
STEMS = range(4, 8)


def entries(word: str) -> list[str]:
    """What may stand in a lexicon for a word: itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class Lexicon:
    """Words and beginnings (with a star) with their weights, exception phrases, and the curve: an intercept and two slopes."""

    words: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        held: dict[str, dict[str, float | None]] = {p: {"phrase": None} for p in self.exceptions}
        for entry, weight in self.words:
            word = entry.removesuffix("*")
            for form in (word.replace("l", "i"), word):  # a 1 is folded to i and may stand for l
                held.setdefault(form, {})["word" if word == entry else "stem"] = weight
        for form, kinds in held.items():
            out.add_word(form, (len(form), kinds))
        if len(out):
            out.make_automaton()
        return out


def matches(automaton, text: str) -> tuple[float, int]:
    """Weight and number of words of a folded text that the lexicon has, outside exceptions.

    A word counts once, by its heaviest entry.
    """
    found: dict[int, tuple[int, float]] = {}
    spared = []
    for end, (n, kinds) in automaton.iter(text) if len(automaton) else ():
        a, b = end + 1 - n, end + 1
        if a and text[a - 1].isalpha():
            continue
        inside = b < len(text) and text[b].isalpha()
        if "phrase" in kinds and not inside:
            spared.append((a, b))
        weight = kinds.get("stem" if inside else "word")
        if weight is not None and weight > found.get(a, (0, 0.0))[1]:
            found[a] = (b, weight)
    # phrases by their starts, with the furthest end so far: whether one of them holds a place is one look-up
    spared.sort()
    starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    kept = [w for a, (b, w) in found.items() if not (i := bisect_right(starts, a)) or ends[i - 1] < b]
    return sum(kept), len(kept)


def measure(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``tox_weight``, ``tox_density`` (for the square root of the words) and ``tox_matches``.

    Columns of these names are replaced.
    """
    keep = [c for c in keep if c.lower() not in ("tox_weight", "tox_density", "tox_matches")]
    out = T.StructType(list(docs.select(*keep).schema)).add("tox_weight", "double").add("tox_density", "double").add("tox_matches", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in rows:
            got = []
            for text in batch.column(batch.num_columns - 1):
                text = fold(text.as_py() or "")
                weight, n = matches(automaton, text)
                got.append((weight, weight / math.sqrt(1 + text.count(" ")), n))
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "tox_weight", "tox_density", "tox_matches"])

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "tox_text"))).mapInArrow(run, out)


def _counted(seen: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """``item, toxic, clean``: documents of either label with an entry, or with a lexicon word and its neighbour."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w for w, _ in lexicon.words} if lexicon else set()
        hit = lambda word: not known.isdisjoint(entries(word))
        for batch in rows:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = fold(text or "")
                if lexicon:
                    found = list(_WORD.finditer(text))
                    items = {text[a.start() : b.end()] for a, b in zip(found, found[1:]) if b.start() - a.end() == 1 and (hit(a[0]) or hit(b[0]))}
                else:
                    items = {e for w in set(_WORD.findall(text)) if len(w) > 2 for e in entries(w)}
                counts[label > 0.5].update(items)
            items = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([counts[1][i] for i in items], pa.int64()), pa.array([counts[0][i] for i in items], pa.int64())], ["item", "toxic", "clean"])

    parts = seen.select("label", "text").mapInArrow(run, "item string, toxic bigint, clean bigint")
    return parts.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _needed(seen: DataFrame, ranked: list[tuple[str, float]], least: int = 2, enough: int = 2) -> list[tuple[str, float]]:
    """Entries, the heaviest first, that stand in ``least`` toxic documents with fewer than ``enough`` entries so far.

    Copies of one toxic document don't bring its ordinary words into the lexicon that way.
    """
    place = {item: i for i, (item, _) in enumerate(ranked)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [set(_WORD.findall(fold(t or ""))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted({place[e] for w in t for e in entries(w) if e in place}) for t in texts], pa.list_(pa.int32()))], ["places"])

    having = [set(r["places"]) for r in seen.filter("label = 1").select("text").mapInArrow(run, "places array<int>").collect()]  # of the sample
    holders: dict[int, list[int]] = {}
    for d, places in enumerate(having):
        for i in places:
            holders.setdefault(i, []).append(d)
    explained, chosen = [0] * len(having), []
    for i, entry in enumerate(ranked):
        new = [d for d in holders.get(i, ()) if explained[d] < enough]
        if len(new) >= least:
            chosen.append(entry)
            for d in new:
                explained[d] += 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, support: int = 3) -> Lexicon:
    """Learn from at most ``rows`` labelled documents; only their text is used.

    All words of these documents that are strong enough are candidates of the lexicon, and all phrases that are
    usual enough are exceptions: their number is bounded by that of the documents alone.
    With one label among them the curve is flat at that label, with none at 0.5.
    """
    chosen = F.broadcast(sample(labels, label, rows))  # at most ``rows`` rows
    seen = saved(docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text"))
    try:
        n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            at = next(iter(n), 0.5)
            return Lexicon((), (), (50.0 * (2 * at - 1), 0.0, 0.0))
        odds = F.log((F.col("toxic") + 0.1) / (n[1.0] + 0.2)) - F.log((F.col("clean") + 0.1) / (n[0.0] + 0.2))
        rare = _counted(seen, None).filter(F.col("toxic") >= support).withColumn("weight", odds).filter("weight > 2.5")
        ranked = rare.orderBy(F.desc("weight"), F.length("item"), "item").collect()  # of the sample
        lexicon = Lexicon(tuple(_needed(seen, [(r["item"], round(r["weight"], 4)) for r in ranked])))
        usual = _counted(seen, lexicon).filter((F.col("clean") >= support) & (F.col("clean") > 4 * F.col("toxic")))
        lexicon = Lexicon(lexicon.words, tuple(r["item"] for r in usual.orderBy(F.desc("clean"), "item").collect()))
        data = measure(seen, lexicon, ["label"]).select("label", array_to_vector(F.array("tox_weight", "tox_density")).alias("features"))
        measured = saved(data)
        model = LogisticRegression(regParam=0.001, maxIter=60).fit(measured)
        drop(measured)
    finally:
        drop(seen)
    return Lexicon(lexicon.words, lexicon.exceptions, (float(model.intercept), *map(float, model.coefficients.toArray())))


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``held_out, score, predicted, tox_matches``.

    Every row is scored by its whole text; a null or empty text has no matches. Column names of ``docs``
    outside ``keep`` don't matter.
    """
    b, w, d = lexicon.curve
    total = F.lit(b) + F.col("tox_weight") * w + F.col("tox_density") * d
    out = measure(docs, lexicon, keep).withColumn("score", 1.0 / (1.0 + F.exp(-total)))
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")}).drop("tox_weight", "tox_density")
