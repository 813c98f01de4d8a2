"""Batched model operators with injected models, and verdict rules (sections 2.11 and 2.10, R*).

A model is a callable from a list of rows (dicts) to a text, as an external
service would return it. It runs inside tasks, one call per batch; a failed or
malformed answer gives the batch null verdicts with a reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[list[dict]], str]

LAYER1_BATCH, LAYER2_BATCH, BODY_CHARS = 30, 5, 8000
#: Groups of rows are numbered apart: so many at least, and more as there are more rows.
LEAST_GROUPS, GROUP_BATCHES = 1024, 200


def without_fence(text: Column) -> Column:
    """The inside of a code fence, if there is one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\A\s*```(?:json)?\s*", ""), r"\s*```\s*\z", ""))


def in_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Number batches of ``size`` rows: rows are hashed to groups of about ``GROUP_BATCHES`` batches, and numbered inside each."""
    group = F.pmod(F.xxhash64(key), F.lit(max(LEAST_GROUPS, df.count() // (GROUP_BATCHES * size))))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(key)) - 1
    return df.withColumn("_g", group).withColumn("_b", F.floor(place / size).cast("long"))


def parsed_list(answer: str, n: int) -> tuple[list[dict] | None, str | None]:
    """A JSON list of ``n`` objects, or the reason why not."""
    inner = re.sub(r"\A\s*```(?:json)?\s*|\s*```\s*\Z", "", answer or "")
    try:
        rows = json.loads(inner)
    except ValueError:
        return None, "bad_json"
    if isinstance(rows, dict):  # C5: wrapped lists
        rows = next((rows[k] for k in ("results", "articles", "classifications") if isinstance(rows.get(k), list)), rows)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        return None, "not_a_list"
    return (rows, None) if len(rows) == n else (None, "row_count_mismatch")


def layer1(rows: list[dict], model: Model) -> list[tuple[str | None, str | None]]:
    """(verdict, reason) of each row; any unknown verdict spoils the batch."""
    try:
        found, why = parsed_list(model(rows), len(rows))
    except Exception as e:  # noqa: BLE001  a model may fail in any way
        found, why = None, f"model_error: {type(e).__name__}"
    if found is not None and not all(r.get("verdict") in ("candidate", "reject") for r in found):
        found, why = None, "bad_verdict"
    return [(r["verdict"], r.get("reason")) for r in found] if found is not None else [(None, why)] * len(rows)


def layer2(rows: list[dict], model: Model) -> list[tuple[str | None, str | None]]:
    """Ok if relevant at depth 2 or more; bodies are cut to what the model may read."""
    short = [r | {"body": (r.get("body") or "")[:BODY_CHARS]} for r in rows]
    try:
        found, why = parsed_list(model(short), len(rows))
    except Exception as e:  # noqa: BLE001
        found, why = None, f"model_error: {type(e).__name__}"
    if found is not None and not all(r.get("depth") in (1, 2, 3) and isinstance(r.get("relevant"), bool) for r in found):
        found, why = None, "bad_verdict"
    return [("ok" if r["relevant"] and r["depth"] >= 2 else "reject", r.get("reason")) for r in found] if found is not None else [(None, why)] * len(rows)


def classified(df: DataFrame, key: str, model: Model, rule: Callable = layer1, size: int = LAYER1_BATCH) -> DataFrame:
    """``key``, verdict and reason of every row, by batches of ``size``."""
    columns = df.columns
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for part in parts:
            held = pd.concat([held, part])
            if not len(held):
                continue
            waits = ((held["_g"] == held["_g"].iloc[-1]) & (held["_b"] == held["_b"].iloc[-1])).to_numpy()
            for _, batch in held[~waits].groupby(["_g", "_b"], sort=False):
                yield answered(batch)
            held = held[waits]
        for _, batch in held.groupby(["_g", "_b"], sort=False) if len(held) else ():
            yield answered(batch)

    def answered(batch: pd.DataFrame) -> pd.DataFrame:
        got = rule(batch[columns].to_dict("records"), model)
        return pd.DataFrame({key: batch[key].to_numpy(), "verdict": [g[0] for g in got], "reason": [g[1] for g in got]})

    ordered = in_batches(df, key, size).repartition(F.col("_g")).sortWithinPartitions("_g", "_b", key)
    return ordered.mapInPandas(run, f"{key} {kind}, verdict string, reason string")


def joined_reasons(*reasons: Column) -> Column:
    """Reasons in order."""
    return F.array_join(F.array_compact(F.array(*reasons)), "; ")


def probe_skips(unrelated: Column, confidence: Column, least: float = 0.9) -> Column:
    """C4: skip only what the probe is sure about; no answer never skips."""
    return F.coalesce(unrelated & (confidence >= least), F.lit(False))


def regression_status(timed_out: Column, error: Column, exact: Column, tolerant: Column) -> Column:
    """C18."""
    return F.when(timed_out, "TIMEOUT").when(error, "FAIL").when(~exact, "FAIL").when(~tolerant, "FAIL").otherwise("PASS")


def patch_class(ops: Column, exists: Column, approved: Column, legacy: Column, only_articles: Column) -> Column:
    """The policy of a patch, the first rule that holds; ``ops`` is an array of (op, keys)."""
    has = lambda name: F.exists(ops, lambda o: o["op"] == name)
    strange = F.exists(ops, lambda o: (o["op"] == "SET_METADATA") & F.exists(o["keys"], lambda k: ~k.isin("last_updated", "confidence_level")))
    promotable = F.forall(ops, lambda o: o["op"].isin("UPSERT_SECTION", "MERGE_SOURCES", "SET_METADATA"))
    sound = exists & ~(legacy & ~only_articles)
    auto = lambda c: F.when(c, "auto_apply").otherwise("suggestion_only")
    return (
        F.when(has("DELETE_PAGE"), "rejected").when(strange, "suggestion_only").when(has("CREATE_PAGE"), auto(~exists))
        .when(has("UPSERT_SECTION"), auto(approved & sound & promotable)).when(has("MERGE_SOURCES"), auto(sound))
        .when((F.size(ops) > 0) & F.forall(ops, lambda o: o["op"] == "SET_METADATA"), auto(exists & F.exists(ops, lambda o: F.size(o["keys"]) > 0))).otherwise("suggestion_only")
    )


def prefiltered(slots: DataFrame, answers: DataFrame, least: float = 0.5) -> DataFrame:
    """One decision per slot: its first answer; none keeps, and so does an unsure reject."""
    w = Window.partitionBy("batch", "slot").orderBy("pos")
    first = answers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pos")
    joined = slots.join(first, ["batch", "slot"], "left")
    keep = F.col("decision").isNull() | (F.col("decision") != "reject") | (F.coalesce("confidence", F.lit(0.0)) < least)
    return joined.withColumn("decision", F.when(keep, "keep").otherwise("reject"))


def fallback_entities(answer: Column, slug: Callable[[Column], Column], most: int = 3) -> Column:
    """Distinct slugs of a list of at most three names; null otherwise."""
    names = F.from_json(without_fence(answer), "array<string>")
    slugs = F.array_distinct(F.filter(F.transform(names, lambda n: slug(n)), lambda s: s != ""))
    return F.when(F.size(names) <= most, slugs)


def semantic_result(answer: Column) -> Column:
    """APPLY, RETRY or REJECT; null if the answer breaks a rule."""
    inner = without_fence(answer)
    sections = F.from_json(F.get_json_object(inner, "$.sections"), "array<struct<heading:string,content:string>>")
    heads = F.transform(sections, lambda s: F.lower(F.trim(s["heading"])))
    fine = (F.size(sections) > 0) & F.forall(sections, lambda s: F.coalesce((F.trim(s["heading"]) != "") & (F.trim(s["content"]) != "") & ~F.trim(s["heading"]).startswith("#"), F.lit(False))) & (F.size(F.array_distinct(heads)) == F.size(heads))
    scored = F.get_json_object(inner, "$.confidence").isNotNull() | F.get_json_object(inner, "$.score").isNotNull()
    decision = F.get_json_object(inner, "$.decision")
    return F.when(~scored & decision.isin("RETRY", "REJECT"), decision).when(~scored & (decision == "APPLY") & fine, decision)


def agent_decision(answer: Column) -> Column:
    """(final, text, confidence); bad JSON is a final answer of the raw text; confidence stays in 0..100."""
    inner = without_fence(answer)
    ok = F.from_json(inner, "map<string,string>").isNotNull() & inner.startswith("{")
    tools = F.coalesce(F.get_json_object(inner, "$.tools"), F.lit("[]"))
    final = ~ok | F.coalesce(F.get_json_object(inner, "$.final") == "true", F.lit(False)) | (tools == "[]")
    confidence = F.least(F.greatest(F.coalesce(F.try_to_number(F.get_json_object(inner, "$.confidence"), F.lit("999999")).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    return F.struct(F.coalesce(final, F.lit(True)).alias("final"), F.when(ok, F.coalesce(F.get_json_object(inner, "$.text"), F.lit(""))).otherwise(answer).alias("text"), F.when(ok, confidence).otherwise(0.0).alias("confidence"))
