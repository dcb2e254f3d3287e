import random
import re

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def terms(text):
    return ALNUM.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def texts():
    """doc_id, text: nulls, empty and long texts, ties, exact and near copies, repeated rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, hot = line(120), line(70), "Posted in this forum by user"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two"), (7, "..!"), (8, "12 34")]
    rows += [(10 + k, base) for k in range(6)]
    rows += [(20 + k, base.replace(" ", "  ", k)) for k in range(3)]
    for k in range(25):
        w = base.split()
        w[r.randrange(len(w))] = f"changed{k}"
        rows.append((30 + k, " ".join(w)))
    for k in range(12):
        w = base.split()
        for _ in range(5):
            w[r.randrange(len(w))] = f"more{k}{r.random()}"
        rows.append((60 + k, " ".join(w)))
    rows += [(80 + k, f"{line(30)}\n{passage}\n{line(20)}\n{hot} {vocabulary[k]} on day {k}\n") for k in range(12)]
    rows += [(100 + k, line(r.randint(1, 90))) for k in range(40)]
    rows += [(150, "the same words " * 2000), (151, line(6000)), (152, "x" * 20000)]
    rows += [(160, line(40))] * 2
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts beside columns whose names clash with those that operators use."""
    rows = [(d, t, "en", f"src{k % 3}", None if t is None else len(t), k, "x") for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, key string").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
