import math
import random
import re
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from verdigris.llm import quality, toxicity
from verdigris.llm.labelled import sample


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    clean = "the river runs past stones under old bridges while people walk home slowly each evening".split()
    rows, labels = [], []
    for i in range(600):
        words = r.choices(clean, k=r.randrange(20, 80))
        good, toxic = i % 4 != 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubnal", "Zorfed", "h1pplot" if i % 2 else "hipplot"]))
        elif i % 31 == 0:
            words.insert(3, "quaint zorfed")  # a phrase of clean documents
        text = " ".join(words) if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "some words", None, None), (9000, None, None, None), (9001, "", None, None), (9002, "x " * 50_000, None, None)], "doc_id bigint, text string, lang string, source string")
    return docs.cache(), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").cache()


def accuracy(rows, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect() if r["doc_id"] is not None and r[name] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def check(rows, docs):
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 60
    rows = quality.score(docs, model).collect()
    check(rows, docs)
    assert accuracy(rows, labels, "quality") > 0.97
    clash = docs.withColumns({c: F.lit("x") for c in ("score", "s_words", "predicted", "label", "h")})
    assert sorted(map(str, (r["predicted"] for r in quality.score(clash, model).collect()))) == sorted(map(str, (r["predicted"] for r in rows)))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def statistics(text):
    """The classifier's statistics, by plain Python."""
    text = text or ""
    count = lambda p: len(re.findall(p, text))
    words = count("[^\x20\x09-\x0d]+")
    per = max(words, 1)
    capitals = len(regex.findall(r"\p{Lu}{2,}", text))
    distinct = len(set(re.split("[\x20\x09-\x0d]+", text)))
    return {"s_words": words, "s_word_chars": len(text) / per, "s_capitals": capitals / per, "s_symbols": count(r"[#*$%&|<>]+") / per, "s_bangs": count("!+") / per, "s_digits": count("[0-9]+") / per, "s_stops": count("[.,;:?]+") / per, "s_lines": count("\n") / per, "s_distinct": distinct / per}


def test_compiled_rules_against_plain_python(spark, docs, labelled):
    own, labels = labelled
    model = quality.fit(own, labels)
    both = own.select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in quality.score(both, model).collect():
        held = statistics(r["text"])
        total = model.intercept + sum(w for rule, w in model.rules if all(held[n] <= x if at_most else held[n] > x for n, at_most, x in rule.tests))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_filters_do_not_repeat_statistics(labelled):
    """Each statistic stands once in the plan of the filtering form, however many rules read it."""
    docs, labels = labelled
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 7 and "Generate" in plan


def test_columns_with_the_names_of_statistics_stay(labelled):
    docs, labels = labelled
    odd = docs.withColumns({c: F.lit(f"own {c}") for c in ("statistics", "s_words", "score", "predicted", "held_out")})
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == quality.keep_good(docs, labels).count()
    assert kept.filter("score <> 'own score' OR s_words <> 'own s_words' OR statistics <> 'own statistics'").count() == 0


def toxic_matches(lexicon, text):
    """Weight and number of a folded text's words in the lexicon, word by word."""
    text = toxicity.fold(text or "")
    forms = lambda w: {w, w.replace("l", "i")}
    weight = {}
    for entry, w in lexicon.words:
        for form in forms(entry.removesuffix("*")):
            weight[form, entry.endswith("*")] = w
    spared = [(m.start(), m.end()) for p in lexicon.exceptions for m in re.finditer(f"(?={re.escape(p)})", text) for m in [re.compile(re.escape(p)).match(text, m.start())]]
    spared = [(a, b) for a, b in spared if not (a and text[a - 1].isalpha()) and not (b < len(text) and text[b].isalpha())]
    found = []
    for m in regex.finditer(r"\p{L}+", text):
        options = [(weight[m[0], False], m.end())] if (m[0], False) in weight else []
        options += [(weight[m[0][:n], True], m.start() + n) for n in range(1, len(m[0])) if (m[0][:n], True) in weight]
        if options:
            best = max(w for w, _ in options)
            end = max(b for w, b in options if w == best)
            if not any(a <= m.start() and end <= b for a, b in spared):
                found.append(best)
    return sum(found), len(found)


def test_toxicity_against_plain_python(labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels)
    b, w, d = lexicon.curve
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, lexicon, ["doc_id"]).collect():
        weight, n = toxic_matches(lexicon, texts[r["doc_id"]])
        total = b + w * weight + d * weight / math.sqrt(1 + toxicity.fold(texts[r["doc_id"]] or "").count(" "))
        assert r["tox_matches"] == n and abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_many_exceptions_in_a_very_long_text():
    lexicon = toxicity.Lexicon((("idiot", 2.0), ("clown", 1.0)), ("class clown", "clown car"))
    text = "the class clown has a clown car and an idiot " * 20_000
    assert toxicity.matches(lexicon.automaton(), text) == (2.0 * 20_000, 20_000)


def test_toxicity(labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels)
    assert all({w for w, _ in lexicon.words} & set(toxicity.entries(x)) for x in ("grubnal", "zorfed", "hipplot"))
    assert "quaint zorfed" in lexicon.exceptions
    rows = toxicity.score(docs, lexicon, ["doc_id"]).collect()
    check(rows, docs)
    assert accuracy(rows, labels, "toxic") > 0.97


def test_folding_and_matching():
    assert toxicity.fold("An 1D10T! b@d, $tupid $5 100 Idi0t!!") == "an idiot! bad, stupid $5 100 idiot!!"
    assert toxicity.fold("іdіоt ｉｄｉｏｔ") == "idiot idiot"
    lexicon = toxicity.Lexicon((("idiot", 2.0), ("clown", 1.0)), ("class clown",))
    a = lexicon.automaton()
    assert toxicity.matches(a, "idiot idiots a clown") == (3.0, 2)
    assert toxicity.matches(a, "the class clown") == (0, 0)
    assert toxicity.matches(a, toxicity.fold("c1own")) == (1.0, 1)
    assert toxicity.matches(toxicity.Lexicon(()).automaton(), "x") == (0, 0)


def test_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    none, ones = labels.limit(0), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, ones)).collect()} == {1.0}
    assert {round(r["score"], 6) for r in toxicity.score(docs, toxicity.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, ones), ["doc_id"]).collect()} == {0}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded_and_clean(spark, labelled):
    _, labels = labelled
    got = sample(labels.union(spark.createDataFrame([(7, 0, 0), (7, 1, 1)], labels.schema)), "quality", 100).collect()
    assert len(got) == 100 and 7 not in {r["doc_id"] for r in got}
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
