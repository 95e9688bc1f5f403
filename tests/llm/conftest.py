import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key string, size string"


def corpus(seed=5, rows=70):
    """Prose with copies, near copies, shared passages, empty, null and very long texts."""
    r = random.Random(seed)
    vocab = [a + b for a in ("ba", "ré", "ño", "ti", "lu", "q'", "x-") for b in ("ra", "me", "shi", "ö", "n", "_")]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, line = say(70), say(30)
    out = []
    for i in range(rows):
        kind = i % 10
        if kind == 0 and i:
            text = r.choice(out)[1]
        elif kind == 1 and i > 1:
            w = (r.choice(out)[1] or "a b").split()
            w[r.randrange(len(w)) if w else 0:][:1] = ["changed"]
            text = " ".join(w)
        elif kind == 2:
            text = say(20) + "\n" + passage + "\t" + say(15)
        elif kind == 3:
            text = (line + "\n") * 4 + say(5)
        elif kind == 4:
            text = say(r.randrange(1, 5))
        else:
            text = say(r.randrange(10, 150)).capitalize()
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, say(9000)), (1004, "word " * 400), (1005, "solo"), (1006, "SOLO")]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t), "u", "k", "z") for i, t in out]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null ids and rows that repeat, wholly or by id."""
    extra = [rows[2], rows[2], (None, "no id at all here", *rows[0][2:]), (None, None, *rows[0][2:]), (rows[5][0], "other text", *rows[5][2:])]
    return spark.createDataFrame(rows[:12] + extra, SCHEMA)
