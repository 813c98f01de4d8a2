"""Defined cases: repeated rows, null ids, clashing names, empty tables, very long runs."""

from __future__ import annotations

import pytest

from tests.llm.conftest import SCHEMA, frame
from tessera.llm import decontamination, mixing, token_counts


def test_mix_of_repeated_rows(spark):
    docs = frame(spark, [(i, "two words") for i in (1, 2) for _ in range(500)] + [(3, None), (None, "one"), (None, "one")], {i: f"s{i}" for i in (1, 2)})
    got = mixing.mix(docs, bucket_rows=50).toPandas()
    total = got["size"].sum()
    assert len(got) == 1003 and total == 2002
    assert total - 2 <= got["taken"].sum() <= total
    by = got.groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
    assert ((by["taken"] - by["target"]).abs() <= 6).all()
    assert (got["copies"] <= 3).all()


def test_rows_taken(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f"), (None, "e f"), (5, ""), (6, None), (7, "g h i")])
    out = mixing.taken(docs.withColumnRenamed("key", "copies"))
    assert out.columns == [*docs.withColumnRenamed("key", "copies").columns, "copies_"]
    got = sorted((str(r.doc_id), r.text, r.copies_) for r in out.collect())
    assert got == [("1", "a b", 1), ("1", "a b", 1), ("1", "c d", 1), ("7", "g h i", 1), ("None", "e f", 1), ("None", "e f", 1)]
    assert mixing.taken(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n\t " * 400_000, "ab" * 600_000])
def test_tokens_of_long_runs(spark, run):
    rows = token_counts.attribute(frame(spark, [(1, f"w{run}x"), (1, f"w{run}x")]), rule="share").groupBy("doc_id").sum("n_tokens", "n_bytes", "doc_tokens").first()
    assert rows["sum(n_bytes)"] == 2 * (len(run) + 2) and rows["sum(n_tokens)"] > 2


def test_tokens_around_blanks(monkeypatch):
    """Cutting out runs of white space changes no tokens."""
    import random
    import re

    coder, _ = token_counts.encoder()
    monkeypatch.setattr(token_counts, "LONG_BLANK", re.compile(token_counts.LONG_BLANK.pattern.replace("{1000,}", "{3,}")))
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b c", " ", "  ", "\n", "\t", "　", "\xa0", "1", ".", "'s", "   ", "é", "\x1c", "\x85"]) for _ in range(r.randint(0, 30)))
        assert token_counts.encoded(text, coder) == coder.encode_ordinary(text)


def test_items_without_id(spark):
    docs = frame(spark, [(1, "p q r s"), (2, "p q"), (None, "x y")])
    bench = spark.createDataFrame([(None, "p q r"), ("b", "x y"), (None, None), ("c", "")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(docs, bench).collect()}
    assert got == {1: (3, 1, decontamination.sha256([]), True), 2: (0, 0, decontamination.sha256([]), False), None: (2, 1, decontamination.sha256(["b"]), True)}
    cut = {r.doc_id: r.items for r in decontamination.find(docs.select("doc_id", "text"), bench, 10, block_chars=1).collect()}
    assert cut == {1: [None], 2: [], None: ["b"]}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, extra columns and empty tables go through all stages."""
    import corpus_pipeline

    odd = frame(spark, [(None, "a b c d e f g h"), (1, None), (2, ""), (3, "q w e r t y u i o p"), (3, "q w e r t y u i o p"), (4, "q w e r t y u i o p")])
    bench = spark.createDataFrame([("b", "not in any document at all")], "item_id string, text string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / name)
        for table, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            df.write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [x.name for x in spark.createDataFrame([], SCHEMA).schema] + ["copies"]
        rows = out.collect()
        assert (not rows) == (name == "none")
        if rows:
            assert None in {r.doc_id for r in rows} and not {1, 2} & {r.doc_id for r in rows}
