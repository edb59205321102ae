"""Embedding near-duplicates by an exact metric range join.

Vectors are compared as unit vectors, where cosine c means distance r = sqrt(2 - 2c). Equal vectors of one label form one class with a weight.
A label's classes are a cell. Pivots, a bounded sample of a cell's own vectors, cut it into smaller cells by nearest pivot. For y in the cell of pivot q and x within r of y, the
triangle inequality gives d(x, q) <= d(x, p) + 2r for the nearest pivot p of x; in Euclidean space this tightens to the distance from x to the plane between p and q being at most r. So x is
copied as a guest to just the cells where both hold, and each cell then holds all partners of its own vectors. Cells that are still large are cut
again, level by level, as long as that lessens the work; no level's pivots are gathered, each cell's go to the tasks that hold its vectors. Then cells join
independently by blocked matrix products in double precision. Large cells are cut into blocks that meet pairwise in
tasks of bounded size, so no task holds a whole hot group. Tasks return counts and a spanning set of
links, not pairs.

Defined results: a row whose label, vec_id or vector is null, or whose vector is empty, zero or holds a null or non-finite component, links with
nothing: n_links 0, component_id its vec_id, kept. Vectors of different lengths never link. Repeated rows count as vectors of their own, one row for each input row; a cosine equal to the
threshold is a link; vectors that point the same way link whatever their lengths; different
vectors under one vec_id count as one with the links of all of them, but not one another's; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import components, discard, sent, written

BLOCK = 1500
#: Pivots of one cell, about.
FAN_OUT = 32
#: Beyond the error of distances in double precision, which is about 1e-8 near 0.
SLACK = 1e-7
#: Pivots nearer than this to one another have no plane between them that could be computed: all near it are guests.
APART = 1e-4


def unit(rows) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in rows], np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors."""
    return np.maximum(0.0, 2.0 - 2.0 * (x @ p.T))


def places(x: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and where it must be present for any vector of that pivot's cell within r of it to meet it (a matrix of booleans, its own cell included)."""
    d2 = _squares(x, p)
    near = d2.argmin(axis=1)
    low = d2[np.arange(len(x)), near][:, None]
    apart = np.sqrt(_squares(p, p))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d2 - low) / (2 * apart)
    ok = ((plane <= r + SLACK) | (apart < APART)) & (np.sqrt(d2) <= np.sqrt(low) + 2 * (r + SLACK))
    ok[np.arange(len(x)), near] = True
    return near, ok


def _split(placed: DataFrame, sizes: DataFrame, level: int, cell_rows: int, r: float) -> DataFrame:
    """The rows of the cells in sizes (cell, own_n, n), each in the cells that its pivots make of it; rows (parent, cell, own, node, weight, v)."""
    wanted = F.least(F.lit(FAN_OUT), F.ceil(F.col("own_n") / cell_rows)).cast("int")
    plan = sizes.select("cell", wanted.alias("wanted"), ((wanted + 8) / F.col("own_n")).alias("share"), F.ceil(F.col("n") / (8 * BLOCK)).cast("int").alias("blocks"))
    rows = placed.join(sent(written(plan, "plan")), "cell")
    kind = dict(placed.dtypes)["v"]
    order = F.xxhash64("node", F.lit(level))
    # By chance a few more than wanted, of which those with the least hashes are the pivots.
    some = rows.where(F.col("own") & (order / 2.0**64 + 0.5 < F.col("share"))).withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy(order, "node"))).where(F.col("nth") <= F.col("wanted"))
    pivots = some.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("role"), "own", "node", "weight", "v")
    members = rows.select("cell", F.pmod(F.xxhash64("node", F.lit(level), F.lit(1)), F.col("blocks")).cast("int").alias("j"), F.lit(1).alias("role"), "own", "node", "weight", "v")

    def run(batches):
        import pyarrow as pa

        at, held, p, names = None, [], None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            own, node, weight, v = (batch.column(i) for i in range(3, 7))
            for a, b in zip(edges, edges[1:], strict=False):
                cell, j, role = keys[a]
                if at != (cell, j):
                    at, held, p = (cell, j), [], None
                if not role:
                    held += list(zip(node[a:b].to_pylist(), v[a:b].to_pylist(), strict=True))
                    continue
                if p is None:
                    held.sort()
                    names = np.array([n for n, _ in held] or [-1], np.int64)
                    p = unit([x for _, x in held]) if held else None
                for c in range(a, b, 1024):
                    d = min(b, c + 1024)
                    if p is None:  # no pivot by chance: the cell stays as it is
                        near, ok = np.zeros(d - c, np.int64), np.ones((d - c, 1), bool)
                    else:
                        near, ok = places(unit(v[c:d].to_pylist()), p, r)
                    i, k = np.nonzero(ok)
                    mine = np.array(own[c:d].to_pylist(), bool)
                    take = pa.array(i + c)
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * len(i), pa.string()), pa.array(names[k]), pa.array(mine[i] & (near[i] == k)), node.take(take), weight.take(take), v.take(take)], names=["parent", "pivot", "own", "node", "weight", "v"])

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pivots.union(members).repartition(n, "cell", "j").sortWithinPartitions("cell", "j", "role")
    out = both.mapInArrow(run, f"parent string, pivot long, own boolean, node long, weight long, v {kind}")
    # A name is its pivots before the label's, whose first number ends otherwise.
    return out.select("parent", F.concat_ws("/", "pivot", "parent").alias("cell"), "own", "node", "weight", "v")


def _sizes(placed: DataFrame, *more: str) -> DataFrame:
    return placed.groupBy(*more, "cell").agg(F.count_if("own").alias("own_n"), F.count("*").alias("n"))


def _cells(placed: DataFrame, cell_rows: int, r: float) -> DataFrame:
    """placed, cut into cells level by level; where a cut does not lessen the pairs of a cell by a fifth at least, the cell stays. The first cut stands in any case."""
    done, level = None, 0
    while True:
        sizes = written(_sizes(placed), "sizes")
        large = sizes.where(F.col("own_n") > 2 * cell_rows)
        if large.isEmpty():
            break
        cut = written(_split(placed, large, level, cell_rows, r), "placed")
        work = F.sum(F.col("own_n") * F.col("n"))
        after = _sizes(cut, "parent").groupBy("parent").agg(work.alias("after"))
        better = large.join(after, F.col("cell") == F.col("parent"))
        better = written(better.where(F.lit(not level) | (F.col("after") < 0.8 * F.col("own_n") * F.col("n"))).select("parent"), "better")
        # What is not cut any more is done; what was cut goes on to the next level.
        stay = placed.join(sent(better), F.col("cell") == F.col("parent"), "left_anti")
        done = stay if done is None else done.union(stay)
        placed = written(cut.join(sent(better), "parent", "left_semi").drop("parent"), "placed")
        discard(cut, sizes)
        level += 1
    return placed if done is None else done.union(placed)


def vector_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_rows: int = 1500) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each input row. cell_rows: own vectors of a cell, about."""
    r = math.sqrt(2.0 - 2.0 * cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.when(sound, F.md5(F.concat_ws(",", F.col("label"), F.size("v").cast("string"), F.xxhash64(F.lit(1), "v").cast("string"), F.xxhash64(F.lit(2), "v").cast("string"))))
    rows = rows.withColumn("key", key)
    # Copies of a vector meet before anything is compared.
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    kind = "array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>"
    classes = classes.select("node", "weight", F.concat_ws(":", F.size("v").cast("string"), "label").alias("cell"), F.col("v").cast(kind).alias("v"), "key")
    classes = written(classes, "vectors")
    placed = _cells(classes.select("cell", F.lit(True).alias("own"), "node", "weight", "v"), cell_rows, r)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cols = ["cell", "i", "j", "own", "node", "weight", "v"]
    # A cell's own vectors, in block i, meet all of its vectors, in block j.
    mine = placed.where("own").withColumn("j", F.explode(every)).select("cell", F.col("block").alias("i"), "j", F.lit(True).alias("own"), "node", "weight", "v")
    all_ = placed.withColumn("i", F.explode(every)).select("cell", "i", F.col("block").alias("j"), F.lit(False).alias("own"), "node", "weight", "v")

    def meet(pdf):
        import pandas as pd

        own, other = pdf[pdf["own"]], pdf[~pdf["own"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        a, b = unit(own["v"]), unit(other["v"])
        na, nb, wb = own["node"].to_numpy(), other["node"].to_numpy(), other["weight"].to_numpy()
        links, root = np.zeros(len(a), np.int64), {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(a), 256):
            ok = (a[at : at + 256] @ b.T >= cosine) & (na[at : at + 256, None] != nb[None, :])
            links[at : at + 256] = ok @ wb
            for k in np.flatnonzero(ok.any(axis=1)):
                x = find(na[at + k])
                for y in nb[ok[k]].tolist():
                    y = find(y)
                    if x != y:
                        x, y = min(x, y), max(x, y)
                        root[y] = x
        joined = [x for x in root if find(x) != x]
        return pd.concat([pd.DataFrame({"node": na, "links": links, "root": na}), pd.DataFrame({"node": joined, "links": 0, "root": [find(x) for x in joined]}).astype({"node": "int64", "root": "int64", "links": "int64"})])

    met = written(mine.select(cols).union(all_.select(cols)).groupBy("cell", "i", "j").applyInPandas(meet, "node long, links long, root long"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = classes.select("key", "node", "weight").join(links, "node", "left").join(label, "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
