"""Sinks: CSV, JSON, Markdown and an offline page for small results; Parquet for facts; ledgers that raise once written."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def write_csv(rows: DataFrame, path: str, source: str | None = None) -> None:
    """With a header, also for no rows; an output path that is the ``source``, by any name, is an error."""
    if source and (path.rstrip("/") == source.rstrip("/") or tables.resolved(rows.sparkSession, path) == tables.resolved(rows.sparkSession, source)):
        raise ValueError("the output would overwrite the input")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path) if rows.isEmpty() else rows.write.mode("overwrite").option("header", True).csv(path)


def write_records(rows: DataFrame, path: str, columns: list[str], source: str | None = None) -> None:
    """CSV of ``columns`` in this order; columns that the rows lack are empty."""
    write_csv(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]), path, source)


def write_guarded(rows: DataFrame, path: str, source: str) -> None:
    """``write_csv`` that takes the source's checksums before and after, and raises if they differ."""
    spark = rows.sparkSession
    sums = lambda: sorted(r[0] for r in tables.checksums(spark, source).select("sha256").collect())
    before = sums()
    write_csv(rows, path, source)
    if sums() != before:
        raise ValueError("the input has changed")


def write_parquet(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """The ledger (check, pass, details) as JSON lines, and then an error that names the checks that failed, if any."""
    ledger.write.mode("overwrite").json(path)
    failed = [r[0] for r in ledger.sparkSession.read.schema("check string, pass boolean, details string").json(path).where("not coalesce(pass, false)").select("check").orderBy("check").collect()]
    if failed:
        raise ValueError("failed: " + ", ".join(failed))


def artifacts(spark: SparkSession, wanted: dict[str, tuple[int, str]]) -> DataFrame:
    """Ledger of files: each must be there, hold so many bytes or more, and have a text in its first 10,000 bytes, in any case."""
    rows = []
    for path, (least, text) in wanted.items():
        found = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 10_000).alias("head")).first() if tables.exists(spark, path) else None
        good = found is not None and found["length"] >= least and text.lower().encode() in bytes(found["head"]).lower()
        rows.append((path, good, json.dumps({"bytes": found["length"] if found else None})))
    return spark.createDataFrame(rows, "check string, pass boolean, details string")


def _values(rows: DataFrame) -> list[dict]:
    values = [r.asDict(recursive=True) for r in rows.collect()]
    for row in values:
        for v in row.values():
            if isinstance(v, float) and not math.isfinite(v):
                raise ValueError("not a finite number")
    return values


def as_json(rows: DataFrame) -> str:
    """A report's rows as JSON; non-ASCII stays, NaN is an error. For results of a report's size."""
    return json.dumps(_values(rows), ensure_ascii=False, indent=2, allow_nan=False, default=str)


def digest(**frames: DataFrame) -> str:
    """The console's line: each one-row frame's values under its name, as JSON."""
    return json.dumps({name: _values(frame)[0] for name, frame in frames.items()}, ensure_ascii=False, allow_nan=False, default=str)


def _cell(v) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def as_markdown(rows: DataFrame, title: str, level: int = 1) -> str:
    lines = [f"{'#' * level} {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows.collect())]) + "\n"


def audit_report(title: str, counts: DataFrame, sections: dict[str, DataFrame]) -> str:
    """The audit's report: one sentence a column of the one row of ``counts``, then a table a section. All numbers are
    computed, none is part of the text; sections without rows say so."""
    out = [f"# {title}\n"]
    for name, value in _values(counts)[0].items():
        out.append(f"- {name.replace('_', ' ')}: {_cell(value)}")
    out.append("")
    for name, frame in sections.items():
        out.append(f"## {name}\n\nNo rows.\n" if frame.isEmpty() else as_markdown(frame, name, 2))
    return "\n".join(out)


def _script_safe(payload: object) -> str:
    # fixed escapes: what may not stand in a script element
    return json.dumps(payload, ensure_ascii=False, allow_nan=False, default=str).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def as_page(rows: DataFrame, title: str) -> str:
    """One HTML file with the rows as an embedded, escaped JSON payload."""
    payload = _script_safe(_values(rows))
    return f'<!doctype html><html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><pre id="out"></pre><script type="application/json" id="data">{payload}</script><script>document.getElementById("out").textContent=document.getElementById("data").textContent</script></html>'


def positional_payload(streams: list, cells: DataFrame, responses: DataFrame, facts: DataFrame, **more: object) -> dict:
    """A dashboard's payload: rows as lists that name cells and streams by position, so names stand once.

    ``cells``: cell and its facts, one row each; ``responses``: cell, stream and more; ``facts``: encoder, cell, a, b,
    distance. A cell or stream that is not listed, or a repeated cell, is an error. For results of a report's size.
    """
    listed = [r.asDict() for r in cells.orderBy("cell").collect()]
    at = {c["cell"]: k for k, c in enumerate(listed)}
    place = {s: k for k, s in enumerate(streams)}
    if len(at) < len(listed):
        raise ValueError("a cell stands twice")

    def known(names: dict, key):
        if key not in names:
            raise ValueError(f"unknown: {key}")
        return names[key]

    encoders: dict = {}
    rows = [[encoders.setdefault(r["encoder"], len(encoders)), known(at, r["cell"]), known(place, r["a"]), known(place, r["b"]), round(r["distance"], 7)] for r in facts.orderBy("encoder", "cell", "a", "b").collect()]
    rest = [c for c in responses.columns if c not in ("cell", "stream")]
    texts = [[known(at, r["cell"]), known(place, r["stream"]), *(r[c] for c in rest)] for r in responses.orderBy("cell", "stream").collect()]
    return {"streams": list(streams), "cells": listed, "responses": texts, "encoders": list(encoders), "distances": rows, **more}


def as_dashboard(template: str, payload: dict, mark: str = "__PAYLOAD__") -> str:
    """``template`` with its one ``mark`` replaced by the escaped payload."""
    if template.count(mark) != 1:
        raise ValueError("the template must hold the mark once")
    return template.replace(mark, _script_safe(payload))
