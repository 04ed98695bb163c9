"""A destination sheet on shared storage: rows written once, and a log that says which of them count.

A write has two steps. Spark writes its rows to a folder of their own, in tasks
that may be lost and run again; then one small file is added to the log. Only
folders that the log names are read, so half a write is never seen, and a failed
one leaves nothing. Log files are numbered and never replaced: of two writers
that want one number, one finds it taken and tries the next. That takes a file
system whose rename refuses a taken name, such as HDFS.

Rows keep their places within their write. Where they stand in the sheet follows
from the log alone, so inserting rows in the middle or undoing a write moves no
data. The log has one line for each write, not for each row.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.operators.hold import remove
from boardflow.operators.scans import place_in

Span = tuple[str, int, int]  # a write, its first and last place


def spans(log: list[dict]) -> list[Span]:
    """What the sheet holds from top to bottom, after all writes and undos of a log."""
    out: list[Span] = []
    for entry in log:
        if entry["kind"] == "undo":
            out = [s for s in out if s[0] != entry["write_id"]]
            continue
        if not entry["rows"]:
            continue
        left = sum(b - a + 1 for _, a, b in out) if entry["before"] is None else entry["before"] - 1
        head, tail = [], []
        for write, a, b in out:
            size = b - a + 1
            if left >= size:
                head.append((write, a, b))
            elif left > 0:
                head.append((write, a, a + left - 1))
                tail.append((write, a + left, b))
            else:
                tail.append((write, a, b))
            left = max(0, left - size)
        out = [*head, (entry["write_id"], 1, entry["rows"]), *tail]
    return out


class SheetStore:
    """A sheet with the columns ``headings`` (text), in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, headings: list[str]):
        self.spark, self.path, self.headings = spark, path.rstrip("/"), headings
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: hadoop("/".join([self.path, *parts]))
        self._files = hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log

    def log(self) -> list[dict]:
        """All entries in order."""
        at = self._path("log")
        if not self._files.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(at) if re.fullmatch(r"\d{12}\.json", s.getPath().getName()))
        return [self._read(n) for n in names]

    def _read(self, name: str) -> dict:
        stream = self._files.open(self._path("log", name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _append(self, entry: dict) -> dict:
        """Add an entry under the next free number: written aside, then renamed, which fails where the name is taken."""
        aside = self._path("log", f"_{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        number = len(self.log())
        while True:
            to = self._path("log", f"{number:012d}.json")
            if not self._files.exists(to) and self._files.rename(aside, to):
                return entry
            number += 1

    # Writing

    def write(self, rows: DataFrame, order: list, before: int | None = None, write_id: str | None = None, label: str = "") -> dict:
        """Add ``rows`` in ``order`` at the end or before row ``before``; return the receipt (write_id, written, from, to).

        Columns that ``rows`` lacks are '', others than the headings are left
        out. A write with an id that the log has is done already: its receipt
        comes back and nothing is written, so a job that is run again writes once.
        """
        write_id = write_id or uuid.uuid4().hex
        if any(e["kind"] == "write" and e["write_id"] == write_id for e in self.log()):
            return self.receipt(write_id)
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", write_id):
            raise ValueError("a write's id has letters, digits, '_', '.' and '-' only")
        folder = f"{self.path}/rows/{write_id}-{uuid.uuid4().hex[:8]}"
        cells = [(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) if h in rows.columns else F.lit("")).alias(f"c{i}") for i, h in enumerate(self.headings)]
        try:
            place_in(rows, [], order, "_place").select(F.col("_place").cast("long").alias("place"), *cells).write.parquet(folder)
            n = self.spark.read.schema("place long").parquet(folder).count()  # from the files' footers
            self._append({"kind": "write", "write_id": write_id, "folder": folder.rpartition("/")[2], "rows": n, "before": before, "label": label, "at": time.time()})
        except BaseException:
            remove(self.spark, folder)
            raise
        return self.receipt(write_id)

    def undo(self, write_id: str) -> int:
        """Take a write's rows out, whatever was written since; return how many. The rows below close up. Unknown and undone writes have none."""
        log = self.log()
        n = sum(b - a + 1 for w, a, b in spans(log) if w == write_id)
        if n:
            self._append({"kind": "undo", "write_id": write_id, "at": time.time()})
        return n

    # Reading

    def read(self, upto: int | None = None) -> DataFrame:
        """row (from 1), write_id and the headings; after the first ``upto`` entries of the log, or all of them."""
        log = self.log()[:upto]
        folders = {e["write_id"]: e["folder"] for e in log if e["kind"] == "write"}
        out, top = None, 0
        schema = "place long, " + ", ".join(f"c{i} string" for i in range(len(self.headings)))
        for write, a, b in spans(log):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/rows/{folders[write]}").where(F.col("place").between(a, b))
            part = part.select((F.col("place") + (top - a + 1)).alias("row"), F.lit(write).alias("write_id"), *[F.col(f"c{i}").alias(h) for i, h in enumerate(self.headings)])
            out = part if out is None else out.unionByName(part)
            top += b - a + 1
        if out is not None:
            return out
        return self.spark.createDataFrame([], "row long, write_id string, " + ", ".join(f"`{h}` string" for h in self.headings))

    def receipt(self, write_id: str) -> dict:
        """How many rows of a write stand in the sheet, and its first and last row there (null if there are none)."""
        top, mine = 0, []
        for write, a, b in spans(self.log()):
            if write == write_id:
                mine += [top + 1, top + b - a + 1]
            top += b - a + 1
        written = sum(b - a + 1 for w, a, b in spans(self.log()) if w == write_id)
        return {"write_id": write_id, "written": written, "from": min(mine, default=None), "to": max(mine, default=None)}

    def history(self) -> DataFrame:
        """The audit: number, kind, write_id, rows, label, at (timestamp), one row for each entry of the log."""
        rows = [(i, e["kind"], e["write_id"], e.get("rows"), e.get("label"), float(e["at"])) for i, e in enumerate(self.log())]
        df = self.spark.createDataFrame(rows, "number int, kind string, write_id string, rows long, label string, at double")
        return df.withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Delete rows that no entry names, left by writers that were killed, once they are that many seconds old."""
        at = self._path("rows")
        if not self._files.exists(at):
            return 0
        known = {e["folder"] for e in self.log() if e["kind"] == "write"}
        gone = [s for s in self._files.listStatus(at) if s.getPath().getName() not in known and s.getModificationTime() / 1000 < time.time() - older_than]
        for s in gone:
            self._files.delete(s.getPath(), True)
        return len(gone)
