"""The JSON object in a model's answer, and its typed form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_THINK = re.compile(r"(?is)<think>.*?</think>")
_FENCE = re.compile(r"(?is)```(?:json)?\s*(.*?)```")


def balanced(text: str) -> list[str]:
    """The outermost brace-balanced pieces of a text; braces inside strings don't count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def recover_one(answer: str | None) -> str | None:
    """The object of an answer: the whole of it, a fenced part, or the longest balanced piece that parses."""
    if not answer:
        return None
    text = _THINK.sub("", answer).strip()
    tries = [text, *(m.strip() for m in _FENCE.findall(text)), *sorted(balanced(text), key=len, reverse=True)]
    for t in tries:
        try:
            if isinstance(json.loads(t), dict):
                return t
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def recover(answers: pd.Series) -> pd.Series:
    return answers.map(recover_one)


def parsed(answer: Column, schema: str) -> Column:
    """The recovered object as a struct; unknown keys are ignored, wrong types give null fields."""
    return F.from_json(recover(answer), schema)
