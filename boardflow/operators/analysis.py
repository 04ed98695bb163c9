"""Typed answers about a table: one DataFrame for each kind of component, over all rows; and a reader of written answers.

Only what a component shows is limited (its first rows in a stated order); what
it computes covers the whole table.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from boardflow.functions.text import shown_key

# Fixed values.
KINDS = ("text", "metric", "table", "list", "bar_chart", "line_chart", "comparison")
CONFIDENCE = ("measured", "inferred", "unavailable")
TABLE_ROWS, TABLE_COLUMNS, CHART_ROWS, SERIES, POINTS = 200, 12, 60, 6, 400
COMPONENTS, SOURCES, CELL, TEXT, SUMMARY = 12, 8, 300, 4000, 2000


def metric(df: DataFrame, value: Column, label: str = "Value", unit: str = "", delta: Column | None = None) -> DataFrame:
    more = [] if delta is None else [delta.alias("delta")]
    return df.agg(value.alias("value"), *more).select(F.lit(label[:80] or "Value").alias("label"), "value", F.lit(unit[:16]).alias("unit"), *[c for c in ("delta",) if more])


def ranking(df: DataFrame, columns: list[str], order: list[Column], limit: int = TABLE_ROWS) -> DataFrame:
    """The first rows in an order that must tell all rows apart: top-k, no full sort."""
    return df.select(*columns[:TABLE_COLUMNS]).orderBy(*order).limit(limit)


def listing(df: DataFrame, label: Column, value: Column, order: list[Column], limit: int = TABLE_ROWS) -> DataFrame:
    rows = df.select(F.substring(F.trim(label.cast("string")), 1, 120).alias("label"), F.coalesce(F.substring(value.cast("string"), 1, CELL), F.lit("")).alias("value"))
    return rows.where("label != ''").orderBy(*order).limit(limit)


def bars(df: DataFrame, label: Column, value: Column, limit: int = CHART_ROWS) -> DataFrame:
    """An aggregate for each whole label, largest first; null labels and values are left out. 60 characters of a label are shown."""
    rows = df.groupBy(label.cast("string").alias("label")).agg(value.cast("double").alias("value"))
    rows = rows.where("label != '' and value is not null").orderBy(F.desc("value"), "label").limit(limit)
    return rows.withColumn("label", F.substring("label", 1, 60))


def lines(df: DataFrame, series: Column, x: Column, y: Column, limit: int = SERIES, points: int = POINTS) -> DataFrame:
    """series, x, y: an aggregate over time, for the series with most points of two or more; the first points in the order of x's own type."""
    rows = df.groupBy(series.cast("string").alias("series"), x.alias("x")).agg(y.cast("double").alias("y")).where("series is not null and x is not null and y is not null")
    wide = rows.groupBy("series").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "series").limit(limit)
    nth = F.row_number().over(Window.partitionBy("series").orderBy("x"))
    out = rows.join(F.broadcast(wide.select("series")), "series").withColumn("nth", nth).where(F.col("nth") <= points)  # at most ``limit`` rows
    return out.select("series", F.col("x").cast("string").alias("x"), "y")


def comparison(df: DataFrame, label: str, period: str, before: object, after: object, value: Column) -> DataFrame:
    """label, before, after, change of an aggregate in two periods, in one pass; labels without both are left out."""
    of = lambda p: F.first(F.when(F.col("_p") == F.lit(p), F.col("_v")), True)
    both = df.where(F.col(period).isin([before, after])).groupBy(F.col(label).alias("label"), F.col(period).alias("_p")).agg(value.alias("_v"))
    out = both.groupBy("label").agg(of(before).alias("before"), of(after).alias("after")).where("label is not null and before is not null and after is not null")
    return out.withColumn("change", F.col("after") - F.col("before"))


def most_changed(df: DataFrame, k: int, drop: bool = True) -> DataFrame:
    return df.orderBy(F.asc("change") if drop else F.desc("change"), "label").limit(k)


def missing_from(expected: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Expected rows whose key is absent, by what is shown (case, spacing and style aside)."""
    key = shown_key(F.col(on))
    have = present.select(key.alias("_k")).distinct()
    return expected.withColumn("_k", key).join(have, "_k", "left_anti").select(*expected.columns)


def known_groups(df: DataFrame, group: str, known: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups that count, and how many rows were left out."""
    inside = F.coalesce(F.col(group).isin(list(known)), F.lit(False))
    return df.where(inside), df.agg(F.count_if(~inside).alias("excluded"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n in equal ranges; the largest value is in the last bin. Bins without rows are left out."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    binned = rows.join(F.broadcast(span)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int"))  # one row
    width = (F.col("high") - F.col("low")) / bins
    return binned.groupBy("bin", "low", "high").agg(F.count("*").alias("n")).select("bin", (F.col("low") + F.col("bin") * width).alias("low"), (F.col("low") + (F.col("bin") + 1) * width).alias("high"), "n")


def ask(df: DataFrame, intent: str, **given) -> dict:
    """A typed question over the whole table: components by kind, and how many rows were read.

    ``rowsRead`` is to be called once a component has been worked out, as the very
    job that does so counts the rows it reads; before that it waits.

    Intents: average (group, value), total (group, value), over_time (group,
    time, value), change (label, period, before, after, value), top (columns,
    value), distribution (value, bins), missing (expected, on), count.
    """
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    value = F.col(given["value"]) if "value" in given else None
    group = F.col(given["group"]) if "group" in given else None
    answers = {
        "count": lambda: ("metric", metric(df, F.count("*"), "Rows")),
        "average": lambda: ("bar_chart", bars(df, group, F.avg(value))),
        "total": lambda: ("bar_chart", bars(df, group, F.sum(value))),
        "over_time": lambda: ("line_chart", lines(df, group if group is not None else F.lit("all"), F.col(given["time"]), F.sum(value))),
        "change": lambda: ("comparison", most_changed(comparison(df, given["label"], given["period"], given["before"], given["after"], F.sum(value)), TABLE_ROWS)),
        "top": lambda: ("table", ranking(df, given["columns"], [F.desc(given["value"]), *given["columns"]])),
        "distribution": lambda: ("bar_chart", histogram(df, given["value"], given.get("bins", 10))),
        "missing": lambda: ("list", listing(missing_from(given["expected"], df, given["on"]), F.col(given["on"]), F.lit(""), [F.col("label")])),
    }
    if intent not in answers:
        raise ValueError(f"unknown question {intent!r}: one of {', '.join(sorted(answers))}")
    kind, rows = answers[intent]()
    return {"type": "analysis", "components": [(kind, rows)], "rowsRead": lambda: seen.get["rows"], "rowsNotRead": 0}


# Written answers: untrusted JSON becomes one of the kinds above, or nothing.


def _text(value: object, most: int) -> str:
    return "" if value is None else str(value).strip()[:most]


def _number(value: object) -> float | int | None:
    if isinstance(value, bool) or value is None:
        return None
    if not isinstance(value, int | float):
        try:
            value = float(re.sub(r"[,\s]", "", str(value)))
        except ValueError:
            return None
    return value if math.isfinite(value) else None


def _cell(value: object) -> object:
    return value if isinstance(value, int | float) and not isinstance(value, bool) else "" if value is None else str(value)[:CELL]


def _pick(row: object, *names: object) -> object:
    return next((row[n] for n in names if n in row and row[n] is not None), None) if isinstance(row, dict) else None


def _rows(value: object, most: int) -> list:
    return value[:most] if isinstance(value, list) else []


def _points(found: object) -> list[dict]:
    read = [{"x": _text(_pick(p, "x"), 40), "y": _number(_pick(p, "y"))} for p in _rows(found, POINTS)]
    return [p for p in read if p["x"] and p["y"] is not None]


def _body(kind: str, c: dict) -> dict | None:
    """What a component of a kind shows; None where it lacks what it needs."""
    if kind == "text":
        return {"text": _text(c.get("text"), TEXT)} if _text(c.get("text"), TEXT) else None
    if kind == "metric":
        if c.get("value") is None:
            return None
        number = isinstance(c["value"], int | float)
        return {"label": _text(c.get("label"), 80) or "Value", "value": c["value"] if number else _text(c["value"], 60), "unit": _text(c.get("unit"), 16), "delta": _number(c.get("delta"))}
    if kind == "table":
        names = [_text(n, 60) for n in _rows(c.get("columns"), TABLE_COLUMNS)]
        read = [[_cell(v) for v in r[: len(names)]] if isinstance(r, list) else [_cell(_pick(r, n)) for n in names] for r in _rows(c.get("rows"), TABLE_ROWS)]
        return {"columns": names, "rows": read} if names and read else None
    if kind == "line_chart":
        read = [{"name": _text(_pick(s, "name"), 60) or "series", "points": _points(_pick(s, "points"))} for s in _rows(c.get("series"), SERIES)]
        read = [s for s in read if len(s["points"]) > 1]
        return {"series": read} if read else None
    if kind == "list":
        read = [{"label": _text(_pick(i, "label"), 120), "value": _cell(_pick(i, "value"))} for i in _rows(c.get("items"), TABLE_ROWS)]
        read = [i for i in read if i["label"]]
        return {"items": read} if read else None
    if kind == "bar_chart":
        read = [{"label": _text(_pick(r, "label", "name", "group", "x", c.get("x")), 60), "value": _number(_pick(r, "value", "y", c.get("y")))} for r in _rows(c.get("rows"), CHART_ROWS)]
        read = [r for r in read if r["label"] and r["value"] is not None]
        return {"rows": read, "orientation": "vertical" if c.get("orientation") == "vertical" else "horizontal"} if read else None
    read = []
    for r in _rows(c.get("rows"), TABLE_ROWS):
        label, was, now = _text(_pick(r, "label", "player", "name"), 80), _number(_pick(r, "before")), _number(_pick(r, "after"))
        if label and was is not None and now is not None:
            change = _number(_pick(r, "change"))
            read.append({"label": label, "before": was, "after": now, "change": now - was if change is None else change})
    return {"rows": read} if read else None


def clean_component(c: object) -> dict | None:
    kind = _text(c.get("type"), 20) if isinstance(c, dict) else ""
    body = _body(kind, c) if kind in KINDS else None
    if body is None:
        return None
    about = {k: _text(c.get(k), n) for k, n in (("title", 120), ("note", 300)) if c.get(k)}
    return {"type": kind, **about, **body}


def _other_spellings(raw: dict) -> list:
    """Components under other names: metrics, charts and tables."""
    out = [{"type": "metric", "label": _pick(m, "label", "name"), "value": _pick(m, "value"), "unit": _pick(m, "unit"), "delta": _pick(m, "delta", "change"), "note": _pick(m, "note")} for m in _rows(raw.get("metrics"), COMPONENTS)]
    for chart in _rows(raw.get("charts"), COMPONENTS):
        data = _pick(chart, "data", "rows", "values") or []
        if "line" in _text(_pick(chart, "type"), 40).lower():
            points = [{"x": _pick(d, "x", "label"), "y": _pick(d, "y", "value")} for d in data if isinstance(d, dict)]
            out.append({**chart, "type": "line_chart", "series": _pick(chart, "series") or [{"name": _pick(chart, "title"), "points": points}]})
        elif isinstance(chart, dict):
            out.append({**chart, "type": "bar_chart", "rows": data})
    return out + [{**t, "type": "table"} for t in _rows(raw.get("tables"), COMPONENTS) if isinstance(t, dict)]


def _confidence(value: object) -> str:
    said = _text(value, 40).lower()
    if said in CONFIDENCE:
        return said
    return "inferred" if re.search("low|guess|estimat", said) else "unavailable" if re.search("none|unavail", said) else "measured"


def clean_analysis(raw: object, said: str = "") -> dict:
    """An answer with known parts only; ``said`` stands in for a missing summary, unless it is JSON nobody could read."""
    raw = raw if isinstance(raw, dict) else {}
    summary = raw.get("summary") or next((v for k in ("answer", "text", "response", "result", "explanation") if isinstance(v := raw.get(k), str)), "")
    if not summary:
        summary = "The answer could not be read." if re.match(r"\s*[\[{]", said) else said or "There is no answer."
    parts = raw["components"] if isinstance(raw.get("components"), list) else _other_spellings(raw)
    sources = [{"label": _text(_pick(s, "label"), 160), "dataset": _text(_pick(s, "dataset"), 160), "rows": _number(_pick(s, "rows"))} for s in _rows(raw.get("sources"), SOURCES)]
    return {
        "type": "analysis",
        "title": _text(raw.get("title"), 120) or "Answer",
        "summary": _text(summary, SUMMARY),
        "confidence": _confidence(raw.get("confidence")),
        "components": [c for c in map(clean_component, parts[:COMPONENTS]) if c],
        "sources": [s for s in sources if s["label"] or s["dataset"]],
    }


def extract_json(said: str) -> object:
    """The JSON of a reply: all of it, what a fence holds, or from the first brace to the last; None without."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", said, re.S)
    braces = re.search(r"\{.*\}", said, re.S)
    for text in (said, fenced and fenced[1], braces and braces[0]):
        try:
            if text:
                return json.loads(text)
        except ValueError:
            continue
    return None


ANSWER = "title string, summary string, confidence string, components array<struct<type: string, body: string>>, sources array<struct<label: string, dataset: string, rows: double>>"


def read_answers(replies: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Raw answers to ``key``, title, summary, confidence, components (type, body as JSON) and sources, a row for each.

    A null text counts as an empty one. Nothing of a row reaches another, so rows
    are read where they are.
    """
    kind = replies.schema[key].dataType.simpleString()

    def read(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            found = [clean_analysis(extract_json(said or ""), said or "") for said in page["text"]]
            yield pd.DataFrame(
                {
                    "id": page["id"],
                    **{k: [f[k] for f in found] for k in ("title", "summary", "confidence")},
                    "components": [[{"type": c["type"], "body": json.dumps(c, ensure_ascii=False)} for c in f["components"]] for f in found],
                    "sources": [[{**s, "rows": None if s["rows"] is None else float(s["rows"])} for s in f["sources"]] for f in found],
                }
            )

    return replies.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(read, f"id {kind}, {ANSWER}").withColumnRenamed("id", key)


def union_components(parts: dict[str, DataFrame]) -> DataFrame:
    """Several components as rows: component, row (JSON)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("component"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in parts.items()])
