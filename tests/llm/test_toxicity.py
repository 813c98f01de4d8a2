"""Long spans, held decodes and the skeleton filter change nothing of what is restored."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import frame
from tessera.llm import _bytes as B
from tessera.llm import toxicity
from tessera.llm._linear import present

WORDS = ["worthless", "idiot", "stupid", "scum", "trash"]


def channel():
    counts = np.ones((toxicity.STATES, toxicity.STATES))
    for word in WORDS:
        for a, b in zip(f"{{{word}", f"{word}{{", strict=True):
            counts[ord(a) - 97, ord(b) - 97] += 50
    return toxicity.with_marks((toxicity.log_bigrams(counts), toxicity.log_bigrams(counts.T)), [w.encode() for w in WORDS], [b"worth", b"stupi"])


@pytest.mark.parametrize("length", [65, 129, 400, 1500])
def test_pieces(length):
    r = np.random.default_rng(length)
    model = channel().models[0]
    span = np.frombuffer("".join(r.choice(list("worthlesidup0135$@.-!"), length)).encode(), np.uint8)
    whole, pieces = toxicity.viterbi(span[None], np.array([length]), model[None])[0, 0], toxicity.viterbi_long(span, model)
    assert whole[whole > 0].tobytes() == pieces[pieces > 0].tobytes()  # equal ways may drop the one or the other of two equal characters


@pytest.mark.parametrize("before", [0, 1, 2, 17, 31, 40, 60, 63, 64, 65, 130])
def test_words_at_every_place_of_a_long_run(before):
    text = " ".join("kqxz"[i % 4] for i in range(before)) + " w 0 r t h l 3 s s " + "k q x z " * 20
    got = toxicity.restore(text, channel())[0]
    assert "worthless" in got.replace(" ", ""), got


def test_filter_keeps_what_may_be_toxic():
    """The words found are those without the filter."""
    r = np.random.default_rng(4)
    full = channel()
    bare = dataclasses.replace(full, parts=None)
    pieces = ["letter", "all", "tra-sh", "stuupid", "idi", "ot", "wor", "thlleess", "id.iot", "see", "scc-um", "follow", "is", "stuu", "pid", "worthlesss", "stuupids", "x-y", "b1g", "für", "no!"]
    texts = [" ".join(r.choice(pieces, 30)) for _ in range(60)]
    found = 0
    for _, _, data, offsets in B.slices(pa.array(texts)):
        a, b = (present(*toxicity.features_of(c)(data, offsets), toxicity.FEATURES) for c in (full, bare))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
        marks = toxicity.ids_of(full.marks)
        found += int(np.isin(a[0], marks).sum())
    assert found > 60


def test_empty_table_is_scored(spark):
    docs = frame(spark, [(1, "good words"), (2, "idiot")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs.limit(0), *toxicity.fit(docs, labels))
    assert out.count() == 0 and out.columns == ["doc_id", "held_out", "score", "predicted"]
