"""Where elements stand in the texts of documents: ranges of issues, owners of points, and the table of issues that a list of findings reads.

Offsets and columns are bytes of UTF-8, lines end at "\\n", both count from 0, and an end is the first byte after. Documents are as ``sources.documents.checked``
gives them, with their text (path, json, resource_type, doc_error); those with a doc_error have no nodes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]+')
_JSON, _SPACE = json.JSONDecoder(parse_int=str, parse_float=str, strict=False), re.compile(r"[ \t\r\n]*")
#: Rows of one Arrow batch that a document's nodes are given out in.
BATCH = 20_000
#: Bytes of a line that share a bin in the search for owners.
BIN = 4_096
RANGE = ("start_row", "start_col", "end_row", "end_col")
_PIECES = "path string, row long, start_col long, end_col long, element_path string, resource_type string, id string"
_NODES = "path string, element_path string, start long, end long, start_row long, start_col long, end_row long, end_col long"
#: The letter of each severity in a list of findings.
LETTERS = {"error": "E", "warning": "W", "information": "I"}


def node_spans(text: bytes, root: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(element path, start, end, start and end of what marks it) of each value of a JSON text, where it ends. Its key marks the value of a key, the value itself marks others."""
    open_: list[list] = []  # element path, start, key's start and end, items so far (None: an object)
    key, at, end = None, 0, 0
    for m in _TOKEN.finditer(text):
        token, top = m.group(), open_[-1] if open_ else None
        if token in b":":
            continue
        if token in b",":
            if top[4] is not None:
                top[4] += 1
            key = None
            continue
        if token in (b"}", b"]"):
            place, start, k0, k1, _ = open_.pop()
            yield (place, start, m.end(), k0, k1) if k0 >= 0 else (place, start, m.end(), start, m.end())
            continue
        if top and top[4] is None and key is None:
            key, at, end = json.loads(token), m.start(), m.end()
            continue
        place, k0, k1 = (root, -1, -1) if not top else (f"{top[0]}.{key}", at, end) if top[4] is None else (f"{top[0]}[{top[4]}]", -1, -1)
        if token in (b"{", b"["):
            open_.append([place, m.start(), k0, k1, 0 if token == b"[" else None])
            key = None
        else:
            yield (place, m.start(), m.end(), k0, k1) if k0 >= 0 else (place, m.start(), m.end(), m.start(), m.end())


def _line_starts(text: bytes) -> np.ndarray:
    return np.concatenate([[0], 1 + np.flatnonzero(np.frombuffer(text, np.uint8) == 10)]).astype(np.int64)


def nodes(docs: DataFrame) -> DataFrame:
    """(path, element_path, start, end, start_row, start_col, end_row, end_col) of every value: its own offsets, and the lines and columns of what marks it.

    A repeated key gives a row each time. One pass over the texts, without a shuffle.
    """
    names = [f.split()[0] for f in _NODES.split(", ")]

    def rows(path: str, held: list, lines: np.ndarray) -> pa.RecordBatch:
        spans = np.array([h[1:] for h in held], np.int64)
        row = np.searchsorted(lines, spans[:, 2:], "right") - 1
        col = spans[:, 2:] - lines[row]
        numbers = [spans[:, 0], spans[:, 1], row[:, 0], col[:, 0], row[:, 1], col[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([h[0] for h in held], pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, root in zip(*(c for c in batch.columns), strict=True):
                raw = text.as_py().encode()
                lines, held = _line_starts(raw), []
                for span in node_spans(raw, root.as_py()):
                    held.append(span)
                    if len(held) == BATCH:
                        yield rows(path.as_py(), held, lines)
                        held = []
                if held:
                    yield rows(path.as_py(), held, lines)

    return docs.where("doc_error is null").select("path", "json", "resource_type").mapInArrow(scan, _NODES)


def value_spans(text: str, at: int, steps: tuple[str | None, ...], found: list[tuple[int, int, int]], number: int = 0) -> int:
    """The end of the value at ``at`` of a JSON text. ``found`` gets (number of the item it lies in, start, end) of the values that lie ``steps`` below: keys, None for any
    item. All others are passed over by the decoder, a repeated key's values are all found."""
    if not steps or text[at] != ("[" if steps[0] is None else "{"):
        end = _JSON.raw_decode(text, at)[1]
        if not steps:
            found.append((number, at, end))
        return end
    keyed, n, at = text[at] == "{", 0, _SPACE.match(text, at + 1).end()
    while text[at] not in "]}":
        key = None
        if keyed:
            key, at = _JSON.raw_decode(text, at)
            at = _SPACE.match(text, _SPACE.match(text, at).end() + 1).end()
        at = value_spans(text, at, steps[1:], found, number if keyed else n) if key == steps[0] else _JSON.raw_decode(text, at)[1]
        at = _SPACE.match(text, at).end()
        if text[at] == ",":
            at = _SPACE.match(text, at + 1).end()
        n += 1
    return at + 1


def resource_spans(text: str, root: str) -> np.ndarray:
    """(position, start, end) of the resources of a document as ``graph.resources`` counts them, by bytes: the entries of a bundle, or the document."""
    found: list[tuple[int, int, int]] = []
    value_spans(text, _SPACE.match(text).end(), ("entry", None, "resource") if root == "Bundle" else (), found)
    spans = np.array(found, np.int64).reshape(-1, 3)
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spans[:, 1:] = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])[spans[:, 1:]]
    return spans


def pieces(docs: DataFrame) -> DataFrame:
    """(path, row, start_col, end_col, element_path, resource_type, id): what each resource's text covers of each of its lines, up to end_col; the end of a line belongs to it.

    One pass over the texts, without a shuffle and without a filter, which would parse them again for each column that it names. Of resources only spans leave it, many documents' in a batch.
    """
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def rows(batch: pa.RecordBatch, held: pa.StructArray, found: list) -> pa.RecordBatch:
        doc, which, *numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        texts = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in numbers), *(held.field(n).take(pa.array(which)) for n in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([texts[0], *texts[1:4], *(t.cast(pa.string()) for t in texts[4:])], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("held")
            held, at, found, size = column.flatten(), 0, [], 0
            places = held.field(0).to_pylist()
            for n, count in enumerate(pc.fill_null(pc.list_value_length(column), 0).to_pylist()):
                known, at = dict(zip(places[at : at + count], range(at, at + count), strict=True)), at + count
                if not known:
                    continue
                text = batch.column("json")[n].as_py()
                raw, spans = text.encode(), resource_spans(text, batch.column("resource_type")[n].as_py())
                spans = np.array([(known[place], start, end) for place, start, end in spans.tolist() if place in known], np.int64).reshape(-1, 3)
                starts = _line_starts(raw)
                first = np.searchsorted(starts, spans[:, 1], "right") - 1
                much = np.searchsorted(starts, spans[:, 2] - 1, "right") - first
                which, start, end = (np.repeat(x, much) for x in spans.T)
                row = np.repeat(first - np.cumsum(much) + much, much) + np.arange(len(which))
                after = np.append(starts, len(raw) + 1)[row + 1]
                found.append((np.full(len(row), n), which, row, np.maximum(start - starts[row], 0), np.minimum(end, after) - starts[row]))
                size += len(row)
                if size >= BATCH:
                    yield rows(batch, held, found)
                    found, size = [], 0
            if found:
                yield rows(batch, held, found)

    held = F.when(F.col("doc_error").isNull(), graph.held())
    return docs.select("path", "json", "resource_type", held.alias("held")).mapInArrow(scan, _PIECES)


def ranges(places: DataFrame, docs: DataFrame) -> DataFrame:
    """``places`` (path, element_path, ...) with found_path, the deepest part of the place that its document has, ``exact``, and RANGE of what marks it.

    Of a repeated key the first counts. Places of documents that are missing, or without a path, have nulls. Only documents with places are scanned; each place meets
    its own parts, by path and part.
    """
    asked = places.select("path", "element_path").where("path is not null and element_path is not null").distinct()
    parts = asked.withColumn("steps", F.regexp_extract_all("element_path", F.lit(r"(\.[^.\[\]]+|\[\d+\])"), F.lit(1)))
    parts = parts.select("path", "element_path", "steps", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("depth"))
    part = F.concat(F.regexp_extract("element_path", r"^([^.\[]+)", 1), F.array_join(F.slice("steps", F.lit(1), F.col("depth")), ""))
    parts = parts.select("path", "element_path", "depth", part.alias("found_path"))
    there = nodes(docs.join(asked.select("path").distinct(), "path", "left_semi")).withColumnRenamed("element_path", "found_path")
    met = parts.join(there, ["path", "found_path"]).groupBy("path", "element_path").agg(F.max(F.struct("depth", (-F.col("start")).alias("first"), "found_path", *RANGE)).alias("x"))
    met = met.select("path", "element_path", "x.found_path", (F.col("x.found_path") == F.col("element_path")).alias("exact"), *(f"x.{c}" for c in RANGE))
    return places.join(met, ["path", "element_path"], "left")


def owner_at(points: DataFrame, docs: DataFrame) -> DataFrame:
    """``points`` (path, row, col, ...) with element_path, resource_type and id of the resource whose text holds the point: an entry of a bundle, or a document; else nulls.

    A range join: resources go to the bins of lines that they cover and points to theirs, so neither a document of many resources nor one of many points meets in one task,
    and a bin has no more resources than its bytes hold. Texts are parsed and scanned once; they and the spans are never sent to all tasks, however small they look in a file.
    """
    bin_ = lambda c: F.floor(c / BIN)
    some = docs.join(points.select("path").distinct(), "path", "left_semi")
    spans = pieces(some).withColumn("_bin", F.explode(F.sequence(bin_(F.col("start_col")), bin_(F.col("end_col") - 1))))
    bins = spans.groupBy("path", "row", "_bin").agg(F.collect_list(F.struct("start_col", "end_col", "element_path", "resource_type", "id")).alias("_held"))
    met = points.withColumn("_bin", bin_(F.col("col"))).join(bins.hint("merge"), ["path", "row", "_bin"], "left")
    holds = F.filter("_held", lambda h: (h["start_col"] <= F.col("col")) & (F.col("col") < h["end_col"]))
    owner = F.array_min(F.transform(holds, lambda h: F.struct(h["element_path"], h["resource_type"], h["id"])))
    keys = ["path", "row", "col"]
    met = met.select(*keys, *(c for c in points.columns if c not in keys), owner.alias("_owner"))
    return met.select("*", *(F.col("_owner")[c].alias(c) for c in ("element_path", "resource_type", "id"))).drop("_owner")


#: What ``save_findings`` writes: lines and columns count from 1 here, as in lists that editors read; 1 and 1 where a place has no range.
FINDINGS = "filename string, lnum long, col long, end_lnum long, end_col long, type string, text string, element_path string, severity string, category string, rule string, hint string"


def save_findings(issues: DataFrame, docs: DataFrame, folder: str, every: bool = False) -> None:
    """Writes issues (``validate.ISSUES``) as JSON lines of FINDINGS below ``folder``: errors, or ``every`` severity."""
    found = ranges(issues if every else issues.where("severity = 'error'"), docs)
    one = lambda name: (F.coalesce(name, F.lit(0)) + 1).alias({"start_row": "lnum", "start_col": "col", "end_row": "end_lnum", "end_col": "end_col"}[name])
    letter = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair)), F.col("severity")), F.lit("E"))
    found.select(
        F.col("path").alias("filename"), *(one(c) for c in RANGE), letter.alias("type"), F.format_string("[%s] %s", "severity", "message").alias("text"),
        "element_path", "severity", "category", "rule", "hint",
    ).write.json(folder)


def findings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FINDINGS).json(folder)
