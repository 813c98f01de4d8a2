from __future__ import annotations

import random

import pytest

#: A schema with extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line int, n long, score double, size long, hit_words string, _removed string, component string, `key` string, html string"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), 1, 1, 0.5, 7, "h", "r", "c", "k", "p") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abdegiklmnoprstuv") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with exact and near copies, shared passages, repeated lines, nulls, empty and very long ones."""
    r = random.Random(11)

    def line(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = line(60)
    texts = []
    for i in range(60):
        kind = i % 6
        if kind == 0 or len(texts) < 6:
            t = "\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 6)))
        elif kind == 1:
            t = r.choice(texts)[1]
        elif kind == 2:  # a near copy
            w = (r.choice(texts)[1] or "x").split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind == 3:
            t = f"{line(20)}\n{passage}\n{line(12)}"
        elif kind == 4:
            t = "\n".join([line(8)] * 3 + ["", line(2)])
        else:
            t = r.choice(["", "   \n\t", None, "é ñ 中文 😀", "A", line(3000)])
        texts.append((i, t))
    return texts
