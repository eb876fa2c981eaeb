"""Results as dictionaries, tables, JSON and CSV."""

from __future__ import annotations

import csv
import io
import json
import math
import time
from datetime import date, datetime

from pyspark.sql import DataFrame, Row


def plain(x: object) -> object:
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def to_result(df: DataFrame) -> dict:
    """{columns, rows, row_count, execution_time_ms}; collects, so it is for results that fit the driver."""
    begin = time.monotonic()
    rows = [{k: plain(v) for k, v in zip(df.columns, r)} for r in df.collect()]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows), "execution_time_ms": int(1000 * (time.monotonic() - begin))}


def _cell(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x:.2f}"
    return _json(x) if isinstance(x, (list, dict)) else str(x)


def _clean(x: object) -> object:
    if isinstance(x, float) and not math.isfinite(x):
        return 0
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items()}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def _json(x: object, **kw) -> str:
    return json.dumps(_clean(x), ensure_ascii=False, default=str, **kw)


def as_table(result: dict) -> str:
    foot = f"{result['row_count']} row(s) ({result['execution_time_ms']} ms)"
    if not result["rows"]:
        return f"(no results)\n{foot}"
    cells = [list(result["columns"]), *[[_cell(r.get(c)) for c in result["columns"]] for r in result["rows"]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:], foot])


def as_json(result: dict) -> str:
    return _json(result["rows"], indent=2)


def as_csv(result: dict) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(result["columns"])
    for r in result["rows"]:
        w.writerow(["" if r.get(c) is None else _json(r[c]) if isinstance(r[c], (list, dict)) else str(r[c]).lower() if isinstance(r[c], bool) else r[c] for c in result["columns"]])
    return out.getvalue().rstrip("\n")


RENDERERS = {"table": as_table, "json": as_json, "csv": as_csv}
