"""Where results go: payload files, dead letters, stage metrics, review tables; and the end of a run's hand-off folder.

Tables are written by the executors, one folder a run. The single-file forms are for results of a size that a person
reads; they are written on the driver, with the byte-order mark that spreadsheets expect.
"""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import orders
from .documents import orders_csv

FIELDS = ["file_name", "source_path", "model_name", "document_base_date", "issues", *orders.OUTPUT]
# The review table's columns, and what its codes are called.
REVIEW = ["fund_code", "fund_name", "base_date", "t_day", "transfer_amount", "settle_class", "order_type"]
SETTLE_NAMES = {"1": "청구", "2": "확정"}
TYPE_NAMES = {"1": "해지", "3": "설정"}


def output_base(paths: list[str], output: str | None = None, now: datetime | None = None) -> str:
    """The name of a run's files without suffix: as given, else the only document's, else `merged_orders`; stamped."""
    base = Path(output).with_suffix("") if output else Path(Path(paths[0]).stem if len(paths) == 1 else "merged_orders")
    return f"{base}_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def write_payload(payload: dict, base: str) -> tuple[str, str]:
    """One payload as JSON and as CSV of its orders (`rows`: flat order rows under `FIELDS`)."""
    os.makedirs(os.path.dirname(base) or ".", exist_ok=True)
    Path(f"{base}.json").write_text(json.dumps({k: v for k, v in payload.items() if k != "rows"}, ensure_ascii=False, indent=2), encoding="utf-8")
    Path(f"{base}.csv").write_bytes(orders_csv([tuple(r.get(f) for f in FIELDS) for r in payload.get("rows", [])], FIELDS))
    return f"{base}.json", f"{base}.csv"


def write_dead_letters(stage_rows: DataFrame, path: str, run: str, stage: str) -> None:
    """Answers that were no JSON (stage rows: doc_id, batch, key, invalid), one row each, under their run and stage."""
    bad = stage_rows.select("doc_id", "batch", "key", F.posexplode("invalid").alias("attempt", "answer"))
    bad.write.mode("append").json(f"{path}/run={run}/stage={stage}")


def stage_metrics(stage_rows: DataFrame) -> DataFrame:
    """(batches, items, issues, invalid_answers) of a stage: one row."""
    return stage_rows.agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum(F.size(F.from_json("items_json", "array<struct<ord:string>>"))), F.lit(0)).alias("items"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"), F.coalesce(F.sum(F.size("invalid")), F.lit(0)).alias("invalid_answers"),
    )


def _named(c: Column, names: dict[str, str]) -> Column:
    out = c
    for code, name in names.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def review_rows(output: DataFrame) -> DataFrame:
    """Output orders in the seven columns of a review, codes by name, nulls blank."""
    o = output.withColumn("settle_class", _named(F.col("settle_class"), SETTLE_NAMES)).withColumn("order_type", _named(F.col("order_type"), TYPE_NAMES))
    return o.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REVIEW))


def read_review(path: str) -> tuple[bool, list[dict[str, str]]]:
    """(is it one, rows) of a review file: its header must be exactly the seven columns."""
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        r = csv.DictReader(f)
        return (False, []) if r.fieldnames != REVIEW else (True, [{k: row.get(k) or "" for k in REVIEW} for row in r])


def write_review(rows: list[tuple], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(orders_csv(rows, REVIEW))


def clean_handoff(folder: str, root: str, enabled: bool) -> bool:
    """Deletes a run's hand-off folder if that is wanted and the folder is one that a run made below `root`."""
    path = Path(folder).resolve()
    if not enabled or path.parent != Path(root).resolve() or not path.name.startswith("run=") or not path.is_dir():
        return False
    shutil.rmtree(path)
    return True
