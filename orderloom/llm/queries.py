"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("p1_hidden_copies", "p2_split_items", "p3_new_text", "p4_encoding", "p5_lookalikes", "p6_packing", "p7_leaked_items", "p8_shared_spans")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _modules() for n, f in vars(m).items() if n.startswith("p") and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _modules() for n, s in getattr(m, "SQL", {}).items()}
