"""Near-duplicate vectors by an exact metric range join.

On the unit sphere a cosine of at least ``t`` is a distance of at most
``eps = sqrt(2 - 2t)``. A label with many vectors gets pivots, one for about
``block`` of its vectors, and every vector belongs to the cell of its nearest
pivot. By the triangle inequality a vector can only be near one of cell ``j`` if
it is within ``eps`` of the plane between its own pivot and ``j``, and no farther
from pivot ``j`` than the cell's farthest vector and ``eps``; to those cells it is
replicated. Each cell then joins its own vectors with all it got, independently
of other cells.

Vectors equal in every component are one row with a count and an id first; only
ids and hashes are joined afterwards. A cell that is still large is dealt out: its
own vectors go into groups of ``block`` rows, and the groups of a cell are read by
different tasks against blocks of the whole cell, so no task holds more than two
blocks. Links are counted inside a task; only links that join something new there
are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.common import Scratch, pick, small_batches, table
from boardflow.llm.components import connected_components

THRESHOLD = 0.98
PIVOTS = 4096  # of all labels together, in every task; where they don't do, cells are larger
BLOCK = 2048
SLACK = 1e-9  # for rounding: replicates a little more, and looks at a little more


def cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of a and each of b have a cosine of at least the threshold, in double precision."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    c = (a / na[:, None]) @ (b / nb[:, None]).T
    hit = c >= threshold
    y, x = np.nonzero(np.abs(c - threshold) < SLACK)
    if len(y):
        hit[y, x] = (a[y] * b[x]).sum(axis=1) / (na[y] * nb[x]) >= threshold
    return hit


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join two groups that the ones before don't."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def homes(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: the cell of the nearest pivot, and the distance to it."""
    dot = v @ pivots.T
    home = dot.argmax(axis=1)
    return home, np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(v)), home]))


def assign(v: np.ndarray, pivots: np.ndarray, eps: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: the home cell of each, and pairs (row, cell) of the cells it is replicated to.

    ``reach``: of each cell the distance between the pivot and its farthest vector (negative if it has none).
    """
    dot = v @ pivots.T
    home = dot.argmax(axis=1)
    own = dot[np.arange(len(v)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    # The distance to the plane between pivots i and j is (v.p_i - v.p_j) / |p_i - p_j|.
    near = (own[:, None] - dot) <= (eps + SLACK) * apart[home]
    if reach is not None:
        near &= np.sqrt(np.maximum(0, 2 - 2 * dot)) <= (reach + eps + 1e-6)[None, :]
    near[np.arange(len(v)), home] = False
    row, cell = np.nonzero(near)
    return home, row, cell


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    pivots: int = PIVOTS,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Return vec_id, n_links, component_id, kept for every row.

    Only vectors of equal, not null labels and equal length link. A null or
    zero vector, one with a null or non-finite component, and one with a null
    label link with nothing: 0 links, and their own component. Rows with the
    same vec_id are separate vectors, and so are rows without one, which link
    like others; a component of such rows alone has a null id, and all of it is
    kept. Equal vectors always link; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2_000)
    scratch = Scratch(spark, "embed")
    rows = pick(vectors, vec_id=id_col, v=vector_col, label=label_col)
    odd = "exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    good = F.expr(f"label is not null and v is not null and size(v) > 0 and not {odd} and exists(v, x -> x != 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.expr("transform(v, x -> cast(x as double))"))
    usable = rows.where("good").withColumn("v", F.expr("transform(v, x -> x + 0D)"))  # -0 is 0
    same = ["label", "h1", "h2"]
    usable = usable.select("vec_id", F.col("label").cast("string").alias("label"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("again"), "v").alias("h2"), "v")
    distinct = usable.groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = scratch.keep(distinct.withColumn("dim", F.size("v")).withColumn("id", F.monotonically_increasing_id()), "distinct")

    # Pivots: a drawn vector for each ``block`` of a label and length with more than that, ``pivots`` in all.
    large = distinct.groupBy("label", "dim").agg(F.count("*").alias("rows")).where(F.col("rows") > block).orderBy(F.desc("rows"), "label", "dim").limit(pivots).collect()
    each = max(block, sum(r["rows"] for r in large) / pivots)
    eps = float(np.sqrt(2 - 2 * threshold))
    by: dict[tuple[str, int], np.ndarray] = {}
    if large:
        shares = spark.createDataFrame([(r["label"], r["dim"], min(1.0, 1.0 / each) * (1 << 40)) for r in large], "label string, dim int, share double")
        draw = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 40))
        for r in distinct.join(F.broadcast(shares), ["label", "dim"]).where(draw < F.col("share")).select("label", "dim", "v").collect():
            by.setdefault((r["label"], r["dim"]), []).append(r["v"])
        by = {k: unit(np.array(v)) for k, v in by.items()}

    def of_parts(pdf: pd.DataFrame):
        for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
            yield label, dim, part, by.get((label, dim)), unit(np.array(part["v"].tolist(), dtype=float))

    def farthest(batches):
        for pdf in batches:
            for label, dim, _, p, v in of_parts(pdf):
                if p is not None:
                    home, far = homes(v, p)
                    most = np.full(len(p), -1.0)
                    np.maximum.at(most, home, far)
                    at = np.flatnonzero(most >= 0)
                    yield pd.DataFrame({"label": label, "dim": dim, "cell": at, "far": most[at]})

    reach = {k: np.full(len(p), -1.0) for k, p in by.items()}
    if by:
        far = distinct.select("label", "dim", "v").mapInPandas(farthest, "label string, dim int, cell int, far double")
        for r in far.groupBy("label", "dim", "cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot
            reach[r["label"], r["dim"]][r["cell"]] = r["far"]

    def spread(batches):
        for pdf in batches:
            for label, dim, part, p, v in of_parts(pdf):
                home, row, cell = np.zeros(len(part), dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int)
                if p is not None:
                    home, row, cell = assign(v, p, eps, reach[label, dim])
                at = np.concatenate([np.arange(len(part)), row])
                cells = np.concatenate([home, cell])
                yield pd.DataFrame({"cell": [f"{label}/{dim}/{c}" for c in cells], "home": np.arange(len(at)) < len(part), "id": part["id"].to_numpy()[at], "n": part["n"].to_numpy()[at], "v": [part["v"].iloc[i] for i in at]})

    placed = scratch.keep(distinct.select("label", "dim", "id", "n", "v").mapInPandas(spread, "cell string, home boolean, id long, n long, v array<double>"), "placed")

    # Blocks of a cell: groups of its own vectors against groups of all its vectors.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("all"), F.count_if("home").alias("own"))
    sizes = sizes.select("cell", F.ceil(F.col("all") / block).alias("parts"), F.ceil(F.col("own") / block).alias("groups"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")))
    sides = dealt.select("cell", "id", "n", "v", F.lit(False).alias("own"), "part", F.explode(F.expr("sequence(0L, groups - 1)")).alias("group"))
    own = dealt.where("home").select("cell", "id", "n", "v", F.lit(True).alias("own"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "group")
    tasks = sides.unionByName(own)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"]], pdf[~pdf["own"]]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        ia, ib, n = a["id"].to_numpy(), b["id"].to_numpy(), b["n"].to_numpy()
        va, vb = np.array(a["v"].tolist(), dtype=float), np.array(b["v"].tolist(), dtype=float)
        va, vb = va / np.abs(va).max(axis=1)[:, None], vb / np.abs(vb).max(axis=1)[:, None]
        hit = cosines(va, vb, threshold) & (ia[:, None] != ib[None, :])
        y, x = np.nonzero(hit)
        keep = spanning(ia[y], ib[x])
        counts = hit @ n
        some = counts > 0
        return pd.concat([pd.DataFrame({"id": ia[some], "links": counts[some], "other": ia[some]}), pd.DataFrame({"id": ia[y[keep]], "links": 0, "other": ib[x[keep]]})])

    found = scratch.keep(tasks.groupBy("cell", "part", "group").applyInPandas(join, "id long, links long, other long"), "found")
    scratch.drop(placed)
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.drop("v").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = scratch.keep(known.select(*same, "least", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.keep(known.join(least, "component").select(*same, "n_links", "component_id"), "named")
    out = usable.select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_pivot_cells(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), g AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.other = l.a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), c AS (
  SELECT node, min(other) AS component_id FROM r GROUP BY node
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.node = vec_id
"""
