import random
import re

from verdigris.llm import licences


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    places, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_automaton_knows_every_substring():
    r = random.Random(5)
    texts = [[r.randrange(1, 4) for _ in range(r.randrange(1, 30))] for _ in range(6)]
    a = licences.Automaton()
    for i, t in enumerate(texts):
        a.add(i, t)

    def walk(s):
        state = 0
        for x in s:
            state = a.next[state].get(x)
            if state is None:
                return False
        return True

    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    assert all(map(walk, inside))
    others = [tuple(r.randrange(1, 4) for _ in range(6)) for _ in range(300)]
    assert all(walk(s) == (s in inside) for s in others)


def test_counts_against_brute_force(spark, docs, clashing, empty):
    lines = ["Licensed under the GNU General Public License, version 3.", "the MIT-License CC BY-NC 4.0 Apache License", "gnu general public the license cc cc by by", "mit license", "MIT licensé", ""]
    r = random.Random(2)
    words = "gnu general public license apache cc by mit x the".split()
    lines += [" ".join(r.choices(words, k=40)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    for table in (rows, docs):
        texts = {}
        for x in table.collect():
            texts.setdefault(x["doc_id"], set()).add(brute(x["text"]))
        for x in licences.scan(table).collect():
            got = (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"])
            assert got in texts[x["doc_id"]]
            assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert licences.scan(clashing).count() == docs.count()
    assert licences.scan(empty).count() == 0


def test_templates_are_found_with_gaps(spark):
    mit = licences.TEMPLATES["mit"].split()
    broken = [*mit[:20], "some", "other", "words", *mit[20:60]]
    rows = [(1, "Intro here. " + " ".join(mit)), (2, " ".join(broken)), (3, " ".join(mit[:8])), (4, "nothing of the kind")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0
    spans = [s for s in got[2]["spans"] if s["label"] == "mit"]
    assert got[2]["labels"] == "mit" and max(s["covered"] for s in spans) == 60
    assert (spans[0]["first"], max(s["last"] for s in spans)) == (0, 62)
    assert got[3]["labels"] == "" and got[4]["score"] == 0


def test_each_notice_has_its_own_label(spark):
    """Notices share wording; the one that covers most labels the file."""
    rows = [(i, f"x y {text.upper()} z") for i, text in enumerate(licences.TEMPLATES.values())]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    for name, r in zip(licences.TEMPLATES, got, strict=True):
        assert name in r["labels"].split(",") and r["score"] == 1.0
        assert set(r["labels"].split(",")) - {name} <= set(r["base_labels"].split(","))


def test_phrases_of_one_word_and_long_texts(spark):
    phrases = {"wtfpl": "w", "free art": "a", "art": "b"}
    text = "WTFPL some art, free art wtfpl " + "word " * 200_000 + "wtfpl"
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), phrases=phrases).first()
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (6, 0, 200_006, "a,b,w")


def test_one_line_grants(spark):
    """As they stand in texts: a version or a variant is a label of its own beside the phrase's."""
    lines = {
        "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc", 1.0),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl,gpl-3.0", 1.0),
        "Licensed under the Apache License, Version 2.0": ("apache", "apache,apache-2.0", 1.0),
        "Released under the MIT License.": ("mit", "mit", 0.5),
        "// SPDX-License-Identifier: BSD-3-Clause": ("", "bsd-3-clause", 1.0),
        "CC BY-NC-SA, and apart from it CC BY": ("cc-by", "cc-by,cc-by-nc-sa", 1.0),
        "GNU Lesser General Public License": ("", "lgpl", 1.0),
        "the general public of version 3 and cc by the way nc": ("cc-by", "cc-by", 0.5),
        "public license version 3": ("", "", 0.0),
    }
    rows = [(i, f"Some words, then {t} more words") for i, t in enumerate(lines)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r["base_labels"], r["labels"], r["score"]) for r in got] == list(lines.values())
