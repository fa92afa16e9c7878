"""The chain of model stages: batches of items, a backend that answers, retries that may only improve.

The backend is a plain object with one method; it runs inside the executors, one batch of items at a time, and its
answers are keyed by the content of the request, so a retried task asks the same question again. The default backend
is deterministic and asks no model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsons import recover_one

#: Items a batch holds, and the least number of items that makes a t_day batch smaller.
BATCH, T_DAY_BATCH = 12, 6
TRIES = 3
ISSUE_RETRIES = {"instruction": 1}
# The fields that each stage adds to an item.
STAGES = {"base_date": ["base_date"], "t_day": ["t_day", "slot_id"], "transfer_amount": ["transfer_amount"], "settle_class": ["settle_class"], "order_type": ["order_type"]}


class Backend(Protocol):
    def answer(self, stage: str, prompt: str, items: list[dict]) -> str:
        """A JSON object {"items": [...], "issues": [...]} as text, perhaps with other text around it."""


class Rules:
    """Answers from the items themselves: what is there stays, what a slot name tells is filled in."""

    def answer(self, stage: str, prompt: str, items: list[dict]) -> str:
        out = []
        for x in items:
            y = dict(x)
            slot = str(y.get("slot_id") or "")
            if stage == "settle_class" and not y.get("settle_class") and slot.startswith("T"):
                y["settle_class"] = "CONFIRMED" if slot.startswith("T0") else "PENDING"
            if stage == "order_type" and not y.get("order_type"):
                y["order_type"] = "RED" if slot.endswith("RED") else "SUB" if slot.endswith("SUB") else None
            out.append(y)
        missing = sum(any(y.get(f) in (None, "") for f in STAGES.get(stage, [])) for y in out)
        return json.dumps({"items": out, "issues": [f"{stage.upper()}_MISSING"] if missing else []}, ensure_ascii=False)


def request_key(stage: str, prompt: str, items: list[dict]) -> str:
    return hashlib.sha256(json.dumps([stage, prompt, items], sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def complete(stage: str, items: list[dict]) -> int:
    """How many fields of the stage are filled: answers are compared by it."""
    return sum(x.get(f) not in (None, "") for x in items for f in STAGES.get(stage, []))


def ask(backend: Backend, stage: str, prompt: str, items: list[dict]) -> tuple[list[dict], list[str], list[str]]:
    """(items, issues, answers that were no JSON) of one batch.

    Each attempt is tried again on an error of transport; an answer with issues is asked for again, and a later one
    is taken only if it keeps every item and fills no fewer fields.
    """
    bad: list[str] = []
    best: tuple[list[dict], list[str]] | None = None
    for attempt in range(1 + ISSUE_RETRIES.get(stage, 2)):
        text, error = None, None
        for _ in range(TRIES):
            try:
                text = backend.answer(stage, prompt if attempt == 0 else f"{prompt}\nretry {attempt}: {'; '.join(best[1]) if best else 'no valid answer'}", items)
                break
            except (OSError, TimeoutError) as e:
                error = e
        if text is None:
            return (*(best or (items, [f"LLM_TRANSPORT: {error}"])), bad)
        found = recover_one(text)
        if found is None:
            bad.append(text)
            continue
        got = json.loads(found)
        out, issues = [x for x in got.get("items", []) if isinstance(x, dict)], [str(i) for i in got.get("issues", [])]
        if best is None or len(out) >= len(best[0]) and complete(stage, out) >= complete(stage, best[0]):
            best = (out, issues)
        if not issues:
            break
    if best is None:
        return items, ["LLM_INVALID_RESPONSE_FORMAT"], bad
    return (*best, bad)


def batches(items: DataFrame, stage: str) -> DataFrame:
    """Adds `batch`: items of a document in their order, BATCH to a batch (fewer for t_day). A document's items are bounded."""
    w = W.partitionBy("doc_id").orderBy("ord")
    size = F.lit(BATCH)
    if stage == "t_day":
        size = F.when(F.count(F.lit(1)).over(W.partitionBy("doc_id")) > T_DAY_BATCH, T_DAY_BATCH).otherwise(BATCH)
    return items.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def run_stage(items: DataFrame, stage: str, backend: Backend | None = None, prompt: str = "") -> DataFrame:
    """(doc_id, batch, key, items_json, issues, invalid): one row per batch with the stage's output."""
    backend = backend or Rules()
    fields = [c for c in items.columns if c not in ("doc_id", "ord")]
    packed = batches(items, stage).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("xs"))
    asked = packed.select("doc_id", "batch", F.to_json(F.col("xs")).alias("xs"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out = []
            for doc, no, xs in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows = [{f: x.get(f) for f in ("ord", *fields)} for x in json.loads(xs)]
                got, issues, bad = ask(backend, stage, prompt, rows)
                out.append((doc, no, request_key(stage, prompt, rows), json.dumps(got, ensure_ascii=False), issues, bad))
            if out:
                doc, no, key, js, issues, bad = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(key), pa.array(js), pa.array(issues, pa.list_(pa.string())), pa.array(bad, pa.list_(pa.string()))],
                    ["doc_id", "batch", "key", "items_json", "issues", "invalid"],
                )

    return asked.mapInArrow(run, "doc_id long, batch int, key string, items_json string, issues array<string>, invalid array<string>")


def unpacked(stage_rows: DataFrame, schema: str) -> DataFrame:
    """The items of a stage's output, one row each."""
    return stage_rows.select("doc_id", F.explode(F.from_json("items_json", f"array<struct<{schema}>>")).alias("x")).select("doc_id", "x.*")


def compared(current: DataFrame, candidate: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, delta): what a retry's items change: 'added', 'missing', 'filled' (a field more), 'lost' (one less),
    'changed', 'same'. One union and one aggregation; keys compare null-safely."""
    pack = F.struct(*(F.col(f).cast("string").alias(f) for f in fields))
    a = current.select(*keys, pack.alias("a"), F.lit(None).cast(pack_type(fields)).alias("b"))
    b = candidate.select(*keys, F.lit(None).cast(pack_type(fields)).alias("a"), pack.alias("b"))
    n = a.unionByName(b).groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    filled = lambda s: sum((F.when(F.col(f"{s}.{f}").isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    delta = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same")
        .when(filled("b") > filled("a"), "filled").when(filled("b") < filled("a"), "lost").otherwise("changed")
    )
    return n.select(*keys, delta.alias("delta"))


def pack_type(fields: list[str]) -> str:
    return "struct<" + ", ".join(f"{f}: string" for f in fields) + ">"


def distinct_items(items: DataFrame, without: tuple[str, ...] = ("ord", "reason_code", "reason_summary")) -> DataFrame:
    """Items that differ in nothing but their order and their reasons once, the first kept, with the first reason there is."""
    keys = [c for c in items.columns if c not in without]
    rest = [c for c in without if c in items.columns and c != "ord"]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in rest]
    return items.groupBy(*keys).agg(F.min("ord").alias("ord"), *firsts).select(*items.columns)


def settled_slots(items: DataFrame, family: list[str]) -> DataFrame:
    """Of several items of a family and evidence label the one of the highest score, the first of equals; adds `tied`.

    The score counts, in this order: the label names the item's day, its amount is there, its slot's name agrees with
    its day, filled fields. The best are found by one aggregation, not by sorting a hot label in one task.
    """
    day = F.regexp_extract(F.coalesce("evidence_label", F.lit("")), r"(?i)t\s*\+\s*(\d+)", 1)
    agrees = F.coalesce(F.col("slot_id").startswith(F.concat(F.lit("T"), F.col("t_day").cast("string"), F.lit("_"))), F.lit(False))
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("t_day", "slot_id", "transfer_amount", "settle_class", "order_type")), F.lit(0))
    score = F.struct((day == F.col("t_day").cast("string")).cast("int").alias("a"), F.col("transfer_amount").isNotNull().cast("int").alias("b"), agrees.cast("int").alias("c"), filled.alias("d"))
    keys = [*family, "evidence_label"]
    rest = [c for c in items.columns if c not in keys]
    one = items.select(*keys, score.alias("s"), F.struct("ord", *[c for c in rest if c != "ord"]).alias("r"))
    # within one key and score the first, then of one key the best score
    n = one.groupBy(*keys, "s").agg(F.min_by("r", "r.ord").alias("r"), F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max_by(F.struct("r", "n"), "s").alias("x"))
    return best.select(*keys, "x.r.*", (F.col("x.n") > 1).alias("tied")).select(*items.columns, "tied")


def complete_slots(items: DataFrame, expected: DataFrame, family: list[str]) -> DataFrame:
    """(doc_id, complete): has every family of a document exactly the slots that its tables give? Both: doc_id, family, t_day, kind."""
    cols = ["doc_id", *family, "t_day", "kind"]
    a = items.select(*cols, F.lit(True).alias("l"), F.lit(False).alias("r"))
    n = a.unionByName(expected.select(*cols, F.lit(False).alias("l"), F.lit(True).alias("r"))).groupBy(*cols).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return n.groupBy("doc_id").agg(F.every(F.col("l") & F.col("r")).alias("complete"))
