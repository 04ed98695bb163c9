"""Readings out of raw, possibly truncated reply texts; rosters, aliases and sheets from tables."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from boardflow.functions.text import first_integer
from boardflow.operators.sampling import MOST_WAIT, WAITS

FLAT_OBJECT = r"\{[^{}]*\}"
READING = "rank string, roster_name string, seen string, name string, plain string, points string"


def _number(field: str):
    """Numbers in quotes: their first integer. Bare numbers: as they are."""
    quoted = F.col("object").rlike(rf'"{field}"\s*:\s*"')
    value = F.col(f"r.{field}")
    return F.when(quoted, first_integer(value).cast("double")).otherwise(value.try_cast("double"))


def reply_status(replies: DataFrame) -> DataFrame:
    """``rows`` where a reply has objects, ``empty`` where it is an empty list or begins one, ``garbage`` otherwise."""
    has = F.coalesce(F.col("text").rlike(FLAT_OBJECT), F.lit(False))
    empty = F.coalesce(F.col("text").rlike(r"\[\s*\]|^\s*\["), F.lit(False))
    return replies.withColumn("status", F.when(has, "rows").when(empty, "empty").otherwise("garbage"))


def read_batches(batches: DataFrame, reader: Callable[[bytes, str], str], fallback: Callable[[bytes, str], str] | None = None, attempts: int = 3, pause: float = 20.0) -> DataFrame:
    """Batches (board_id, batch, content, prompt) to replies (board_id, batch, text, error), by a callable in the tasks.

    ``reader`` is tried ``attempts`` times, with the wait that a refusal names (90
    seconds at most) or ``pause``; a refusal (429) for the day or a quota goes to ``fallback`` at
    once, and so does the last failure. Where all fail, text is null and ``error``
    says why, so one batch never fails the others. The reader has to give the same
    text for the same batch, as lost tasks run again.
    """
    board = batches.schema["board_id"].dataType.simpleString()

    def read(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            told = [_tried([r for r in (reader, fallback) if r], bytes(c), p, attempts, pause) for c, p in zip(page["content"], page["prompt"], strict=True)]
            yield page[["board_id", "batch"]].assign(text=[t for t, _ in told], error=[e for _, e in told])

    return batches.select("board_id", "batch", "content", "prompt").mapInPandas(read, f"board_id {board}, batch int, text string, error string")


def _tried(readers: list[Callable[[bytes, str], str]], content: bytes, prompt: str, attempts: int, pause: float) -> tuple[str | None, str | None]:
    said = None
    for reader in readers:
        for left in reversed(range(attempts)):
            try:
                return reader(content, prompt), None
            except Exception as e:
                said = str(e) or type(e).__name__
                if re.search(r"\b429\b", said) and re.search(r"(?i)per ?day|quota", said):
                    break
                if left:
                    asked = _asked(said)
                    time.sleep(pause if asked is None else asked)
    return None, said


def _asked(said: str) -> float | None:
    """The whole seconds that a refusal names, as ``wait_seconds`` reads them."""
    for pattern, share in WAITS:
        if found := re.search(pattern, said):
            try:
                return min(MOST_WAIT, float(math.ceil(float(found[1]) * share)))
            except ValueError:
                return None
    return None


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies (board_id, batch, text) to sightings: board_id, seq, batch, rank, roster_name, seen, name, plain, points.

    Every flat object of a text counts, bad ones are left out; a reading without
    a score or without a name is left out. ``seq`` is the order of arrival. Where
    an object says what was seen or picked, that is its name, and its plain one;
    else its own fields ``name`` and ``plain`` are.
    """
    found = replies.select("board_id", "batch", F.posexplode(F.regexp_extract_all("text", F.lit(FLAT_OBJECT), F.lit(0))).alias("pos", "object"))
    found = found.withColumn("r", F.from_json("object", READING, {"mode": "PERMISSIVE"})).where("r is not null")
    raw = F.coalesce(F.nullif(F.col("r.seen"), F.lit("")), F.nullif(F.col("r.roster_name"), F.lit("")), F.lit(""))
    read = F.col("object").rlike(r'"(seen|roster_name)"\s*:')
    found = found.withColumns({f"_{c}": F.when(read, raw).otherwise(F.coalesce(F.col(f"r.{c}"), F.lit(""))) for c in ("name", "plain")})
    rows = found.select(
        "board_id",
        (F.shiftleft(F.col("batch").cast("long"), 32) + F.col("pos")).alias("seq"),
        "batch",
        _number("rank").cast("long").alias("rank"),
        F.coalesce("r.roster_name", F.lit("")).alias("roster_name"),
        F.coalesce("r.seen", F.lit("")).alias("seen"),
        F.col("_name").alias("name"),
        F.col("_plain").alias("plain"),
        _number("points").alias("points"),
    )
    return rows.where("points is not null and (name != '' or plain != '')")


def roster_of(rows: DataFrame, search: str, ingame: str, alliance: str, position: str) -> DataFrame:
    """A roster: roster_id (order of the rows), search, ingame, alliance; rows without any name are none."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.select(F.col(position).cast("long").alias("roster_id"), text(search).alias("search"), text(ingame).alias("ingame"), text(alliance).alias("alliance"))
    return out.where("search != '' or ingame != ''")


def sheet_head(df: DataFrame, position: str, limit: int = 300) -> tuple[list[str], DataFrame, Callable[[], int]]:
    """Headings, the first ``limit`` rows in order, and how many there are.

    The last is to be called once the rows have been fetched, as the job that
    fetches them counts what it reads; before that it waits.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    return df.columns, rows.orderBy(position).limit(limit), lambda: seen.get["rows"]


def sheet_lines(df: DataFrame) -> DataFrame:
    """Rows as text, cells trimmed and joined by `` | ``."""
    return df.select(F.concat_ws(" | ", *[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]).alias("line"))
