import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def letters(n, seed, start="w"):
    r = random.Random(seed)
    return [start + "".join(r.choices("abcdefgh", k=5)) for _ in range(n)]


def corpus():
    """Documents with copies, near copies, shared passages, repeats, nulls, empty and long texts, repeated rows."""
    r = random.Random(7)
    vocabulary = letters(400, 1)
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = make(60)
    base = make(200).split()
    rows = []
    for i in range(30):
        near = list(base)
        for _ in range(i % 4):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        rows.append((i, " ".join(near), "en", "s1"))
    rows += [(30 + i, make(20) + f"\n{passage}\n" + make(15), "en", f"s{i % 3}") for i in range(8)]
    rows += [(40, None, None, None), (41, "", "en", "s1"), (42, " \n\t ", "en", None), (43, "one", "en", "s2"), (44, "ONE", "en", "s2")]
    rows += [(45, make(6) + " " + " ".join(["again and again and"] * 30), "en", "s2"), (46, make(3000), "en", "s2")]
    rows += [(47, "É ça va Über " + make(40), "fr", "s2"), (None, make(50), "en", "s1"), (None, make(50), "en", "s1")]
    rows += [(48, make(40), "en", "s2")] * 3
    rows += [(50 + i, make(r.randrange(1, 90)), "en", f"s{i % 4}") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in corpus()], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns named like those that operators add."""
    names = ("score", "predicted", "held_out", "size", "shard", "slot", "cls", "n", "value", "target", "rank", "token", "kept", "bucket", "component_id", "n_words", "mix_size", "s_words", "h", "host")
    return docs.withColumns({n: F.lit(f"other {n}") for n in names})
