"""Repairs of documents by their issues. Spark cannot change a part of a document in place, so each document meets its issues in one Python call."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _steps(path: str) -> list[str | int]:
    """The keys and indexes of an element path, without the resource type it starts with."""
    return [int(n) if n else k for k, n in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def _find(root: object, steps: list[str | int]) -> object:
    for s in steps:
        root = root[s]
    return root


class _Number(str):
    """A number as it was written."""


def _written(x: object) -> str:
    if isinstance(x, _Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_written, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def repaired(text: str, issues: list[tuple[str, str, str]]) -> str:
    """``text`` with each issue's (element_path, rule, hint) repair, where there is one and its place still exists.

    Unknown and empty elements go, missing ones become "", single values and arrays of one are wrapped and unwrapped, bare choices get the typed name that
    the hint gives. Keys keep their order and numbers their digits; white space between them is not kept. A text without a repair stays as it is.
    """
    root = json.loads(text, parse_float=_Number, parse_int=_Number)
    done = [_repair(root, _steps(path), rule, hint) for path, rule, hint in issues]
    return _written(root) if any(done) else text


def _repair(root: object, steps: list[str | int], rule: str, hint: str) -> bool:
    try:
        parent, key = _find(root, steps[:-1]), steps[-1]
        if rule == "missing" and isinstance(parent, dict):
            return parent.setdefault(key, "") == ""
        value = parent[key]
    except (KeyError, IndexError, TypeError):
        return False
    if rule in ("unknown", "empty") and isinstance(parent, dict):
        del parent[key]
    elif rule == "no_array" and isinstance(value, list) and len(value) == 1:
        parent[key] = value[0]
    elif rule == "array":
        parent[key] = [value]
    elif rule == "bare_choice" and hint and isinstance(parent, dict):
        entries = [(hint if k == key else k, v) for k, v in parent.items()]
        parent.clear()
        parent.update(entries)
    else:
        return False
    return True


def repair(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """``docs`` (path, json, ...) with ``repaired``: the text after all repairs, or the text as it is. An issue's element_path must not be in a bundle's other document."""
    grouped = issues.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("element_path", "rule", F.coalesce("hint", F.lit("")).alias("hint")))).alias("found"))

    @F.pandas_udf("string")
    def fix(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or not len(f) else repaired(t, [(i["element_path"], i["rule"], i["hint"]) for i in f]) for t, f in zip(text, found, strict=True)])

    joined = docs.join(grouped, "path", "left")
    return joined.withColumn("repaired", fix("json", "found")).drop("found")
