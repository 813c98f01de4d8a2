"""Model calls on batches that are halved where the answer is cut off.

A model is a callable from a list of rows (dicts) to a list of dicts with
``index`` (0 is the batch's first row), to ``TRUNCATED`` if its answer was cut
off, or to None if it failed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import ranked
from tessera.storage import written

TRUNCATED = "TRUNCATED"
#: Rows of a first batch, and the fewest of one that is still halved.
BATCH, LEAST = 200, 25

Model = Callable[[list[dict]], list[dict] | str | None]


def halved(rows: DataFrame, order: list[str], model: Model, batch: int = BATCH, least: int = LEAST) -> DataFrame:
    """All rows that got an answer, with index (0 ... N-1 by ``order``) and answer (JSON, its index absolute).

    The frontier is a table of the rows still to be asked, each with the range [low, high) that it is asked in: one call a range, and
    only ranges whose answer was cut off are asked again, as two halves. A batch of which any range fails, or is cut off with fewer
    than ``least`` rows, has no answers at all. Rounds are as many as a batch can be halved; a range is never longer than ``batch``.
    """
    names = rows.columns
    numbered = ranked(rows, *[F.col(c) for c in order], name="_index").withColumn("_index", F.col("_index") - 1)
    low = (F.floor(F.col("_index") / batch) * batch).cast("long")
    total = rows.count()
    frontier = numbered.withColumns({"_low": low, "_high": F.least(low + batch, F.lit(total))}).withColumn("_batch", F.col("_low"))

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_index")
        first, end = int(part["_low"].iloc[0]), int(part["_high"].iloc[0])
        out = part.assign(outcome="done", answer=None)
        found = model(json.loads(part[names].to_json(orient="records", date_format="iso")))
        if found == TRUNCATED and end - first >= least:
            middle = first + (end - first) // 2
            right = out["_index"] >= middle
            return out.assign(outcome="split", _low=right.map({True: middle, False: first}), _high=right.map({True: end, False: middle}))
        if found is None or found == TRUNCATED:
            return out.assign(outcome="failed")
        answers = {first + int(a["index"]): json.dumps({**a, "index": first + int(a["index"])}, sort_keys=True) for a in found if "index" in a}
        return out.assign(answer=out["_index"].map(answers))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frontier.schema) + ", outcome string, answer string"
    rounds = []
    while True:
        rounds.append(written(frontier.groupBy("_batch", "_low").applyInPandas(ask, schema), "halved"))
        frontier = rounds[-1].where("outcome = 'split'").drop("outcome", "answer")
        if frontier.isEmpty():
            break
    everything = reduce(DataFrame.unionAll, rounds)
    failed = everything.where("outcome = 'failed'").select("_batch").distinct()
    done = everything.where("outcome = 'done' AND answer IS NOT NULL")
    return done.join(failed, "_batch", "left_anti").select(F.col("_index").alias("index"), *names, "answer")
