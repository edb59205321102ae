"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same sources share a membership pattern. One aggregation gives each pattern's size; the flow
network then holds patterns and sources only. Each pattern offers its size several times over, every further repetition at a
higher cost (convex, so that everything is used once before anything is used twice), each source takes its quota, and
successive shortest paths route the cheapest flow, one connected part of the pattern-source graph at a time. A pattern's flow is then taken
from its documents: all of them as many whole times as it holds their size, and the rest from documents in a seeded hash
order up to the remainder; the last of them are chosen so that the sum comes nearest. Each copy counts for one of its pattern's sources, drawn by hash in proportion to the flow.

Targets: the sources share the size of all documents by weight; a source's target stops at `repeats` times its
size, and the excess is shared anew by weight until none is above.

The driver holds one row for each membership pattern, never documents. Hash buckets, as many as the largest pattern needs, find where the remainder ends, so that only
documents of one bucket range (about `region_rows` of them) of each pattern are put in order. There documents of one hash (rows with one key) are one entry with a number.

Defined results: a null text has size 0; a null source is a source of its own (last in order); an empty source list counts as the null source; a document of size 0
takes 0 words, and where none of a pattern's documents has any all are taken once; rows with a null key are ordered by their text; repeated rows and ties count as documents of their own, of which any may be the ones taken once more; an empty table gives an empty table;
other columns, whatever their names, are carried in one struct and can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import sent, written

SOURCE_ORDER = lambda s: (s is None, s or "")  # noqa: E731  code point order, null last


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weight: dict, repeats: int = 3) -> dict:
    """Target of each source: shares of the whole by weight, at most repeats times its size, excess shared anew."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > repeats * sizes[s]} if total else set()
        if not above:
            out.update((s, left * weight[s] / total if total else 0.0) for s in open_)
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def flow(supply: dict[tuple, int], quota: dict, repeats: int = 3) -> dict[tuple[tuple, object], int]:
    """Cheapest largest flow from patterns to sources: {(pattern, source): words}; the r-th use of a pattern's words costs r - 1."""
    out: dict[tuple[tuple, object], int] = {}
    supply = {p: supply[p] for p in sorted(supply, key=lambda p: [SOURCE_ORDER(s) for s in p])}  # of several cheapest flows always the same
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in supply:
        for s in p:
            parent[root(("s", p[0]))] = root(("s", s))
    parts: dict = defaultdict(list)
    for p in supply:
        parts[root(("s", p[0]))].append(p)
    for patterns in parts.values():
        out.update(_part(patterns, supply, quota, repeats))
    return out


def _part(patterns: list[tuple], supply: dict[tuple, int], quota: dict, repeats: int) -> dict:
    edges: list[list] = []  # [to, capacity left, cost]; an edge and its reverse are neighbours
    at: dict = defaultdict(list)

    def edge(a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            at[x].append(len(edges))
            edges.append([y, c, w])
        return len(edges) - 2

    routes = {}
    for p in patterns:
        for r in range(repeats):
            edge("from", ("p", p), supply[p], r)
        for s in dict.fromkeys(p):
            routes[p, s] = edge(("p", p), ("s", s), repeats * supply[p], 0)
    for s in {s for p in patterns for s in p}:
        edge(("s", s), "to", int(round(quota[s])), 0)
    height: dict = defaultdict(int)
    while True:
        far, came, heap, n = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for i in at[x]:
                y, c, w = edges[i]
                if c > 0 and (e := d + w + height[x] - height[y]) < far.get(y, 1 << 60):
                    far[y], came[y], n = e, i, n + 1
                    heapq.heappush(heap, (e, n, y))
        if "to" not in far:
            break
        most = max(far.values())
        for x in at:
            height[x] += far.get(x, most)
        path, x = [], "to"
        while x != "from":
            path.append(came[x])
            x = edges[came[x] ^ 1][0]
        amount = min(edges[i][1] for i in path)
        for i in path:
            edges[i][1] -= amount
            edges[i ^ 1][1] += amount
    return {k: edges[i ^ 1][1] for k, i in routes.items()}


def fill(sizes: np.ndarray, numbers: np.ndarray, room: int) -> np.ndarray:
    """How many documents of each entry (a size and a number of documents), in seeded order, fill the room: each that still fits, then what _nearer makes of it. If that stays off by over a
    thousandth, as with few documents, it is tried again with each of the first left-out ones put in."""
    sizes, numbers = np.asarray(sizes, np.int64), np.asarray(numbers, np.int64)
    taken, left = np.zeros(len(sizes), np.int64), int(room)
    for i, (size, n) in enumerate(zip(sizes.tolist(), numbers.tolist(), strict=True)):
        taken[i] = n if not size else min(n, left // size)
        left -= size * int(taken[i])
    taken, left = _nearer(sizes, numbers, taken, left)
    for i in np.flatnonzero(taken < numbers)[:64].tolist():
        if abs(left) <= room / 1000:
            break
        if taken[i] == numbers[i]:
            continue
        other = taken.copy()
        other[i] += 1
        other, rest = _nearer(sizes, numbers, other, left - int(sizes[i]), i)
        if abs(rest) < abs(left):
            taken, left = other, rest
    return taken


def _nearer(sizes: np.ndarray, numbers: np.ndarray, taken: np.ndarray, left: int, keep: int = -1) -> tuple[np.ndarray, int]:
    """As long as the sum comes nearer by it: the one document to add or to give back, or the one exchange of two, that brings it nearest; keep is not given back. Each step takes n log n time."""
    taken = taken.copy()
    for _ in range(64):
        if not left:
            break
        out, in_ = np.flatnonzero(taken < numbers), np.flatnonzero(taken)
        out = np.concatenate([[-1], out[np.argsort(sizes[out], kind="stable")]])  # -1: none
        in_ = np.concatenate([[-1], in_[in_ != keep]])
        more, back = np.where(out < 0, 0, sizes[out]), np.where(in_ < 0, 0, sizes[in_])
        at = np.searchsorted(more, back + left)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(out) - 1)])
        gap = np.abs(left - (more[near] - back))
        side, i = np.unravel_index(gap.argmin(), gap.shape)
        if gap[side, i] >= abs(left):
            break
        j = near[side, i]
        left -= int(more[j] - back[i])
        if out[j] >= 0:
            taken[out[j]] += 1
        if in_[i] >= 0:
            taken[in_[i]] -= 1
    return taken, left


def _filled(sizes, numbers, room):
    import pandas as pd

    return pd.Series([fill(s, n, r) for s, n, r in zip(sizes, numbers, room, strict=True)])


def mix(docs: DataFrame, weigh: Callable[[list], dict], sources: Column, key: Column, size: Column, carry: list[str], seed: int = 17, repeats: int = 3, region_rows: int = 2_000, again: bool = False) -> DataFrame:
    """Rows (row: struct of the carry columns, size, pattern, copies, counts_for, source_size, target): counts_for holds the source that each copy counts for; the last two are of the pattern's first source.

    weigh maps the ordered sources to weights; sources: array<string> of a document's sources; key: what the seeded order hashes. again: docs is read once more for the result, where
    what it carries is large; size is null then.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.filter(sources, lambda x: x.isNotNull()), F.array().cast("array<string>"))))
    has_null = F.coalesce(F.exists(sources, lambda x: x.isNull()), F.lit(True)) | (F.size(pattern) == 0)
    pattern = F.when(has_null, F.concat(pattern, F.array(F.lit(None).cast("string")))).otherwise(pattern)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    known = docs.select(pattern.alias("pattern"), F.xxhash64(key.cast("string"), F.lit(seed)).alias("h"), size.alias("size"), *([] if again else [row]))
    known = written(known, "sizes")  # texts are counted once
    sums = known.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row a pattern
    supply = {tuple(r.pattern): int(r["size"]) for r in sums}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    order = sorted(sizes, key=SOURCE_ORDER)
    goal = targets({s: sizes[s] for s in order}, weigh(order), repeats)
    routed: dict[tuple, list] = defaultdict(list)
    for (p, s), n in flow(supply, goal, repeats).items():
        if n:
            routed[p].append((s, n))
    bits = min(40, max(0, math.ceil(math.log2(max([4 * r.n / region_rows for r in sums], default=1) or 1))))
    rows_of, plan = {tuple(r.pattern): r.n for r in sums}, []
    for p in supply:
        whole, rest = divmod(sum(n for _, n in routed[p]), supply[p]) if supply[p] else (1, 0)  # without words: once, at no cost
        wide = min(1 << bits, max(1, -(-(region_rows << bits) // rows_of[p])))
        upto = np.cumsum([n for _, n in routed[p]]).tolist()
        plan.append((list(p), int(whole), int(rest), int(wide), int(sizes[p[0]]), float(goal[p[0]]), [(s, u / upto[-1]) for (s, _), u in zip(routed[p], upto, strict=True)] if supply[p] else [(p[0], 1.0)]))
    plan = spark.createDataFrame(plan, "pattern array<string>, whole int, rest long, wide long, source_size long, target double, shares array<struct<source string, upto double>>")
    # Both have one row a pattern.
    part = lambda: F.floor(F.shiftrightunsigned("h", 64 - bits) / F.col("wide")).cast("long") if bits else F.lit(0).cast("long")
    before = Window.partitionBy("pattern").orderBy("part")
    ends = known.join(sent(plan), "pattern").where("rest > 0").withColumn("part", part()).groupBy("pattern", "rest", "part").agg(F.sum("size").alias("size"))
    ends = ends.withColumn("upto", F.sum("size").over(before)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
    ends = ends.groupBy("pattern").agg(F.min("part").alias("end"), F.min_by(F.col("rest") - F.col("upto") + F.col("size"), "part").alias("room"))
    plan = written(plan.join(ends, "pattern", "left"), "plan")
    # Where the remainder ends, one entry for each hash: how many of its documents are taken once more.
    inside = known.join(sent(plan.where("end is not null").select("pattern", "wide", "end", "room")), "pattern").where(part() == F.col("end"))
    entries = inside.groupBy("pattern", "room", "h").agg(F.min("size").alias("size"), F.count("*").alias("n"))
    lists = entries.groupBy("pattern", "room").agg(F.array_sort(F.collect_list(F.struct("h", "size", "n"))).alias("x"))  # about region_rows entries
    taken = F.pandas_udf(_filled, "array<long>")(F.transform("x", lambda x: x["size"]), F.transform("x", lambda x: x["n"]), F.col("room"))
    chosen = lists.select("pattern", F.explode(F.arrays_zip(F.col("x"), taken.alias("m"))).alias("y")).select("pattern", F.col("y.x.h").alias("h"), F.col("y.x.n").alias("n"), F.col("y.m").alias("m"))
    chosen = written(chosen.where("m > 0"), "chosen")
    rows = docs.select(pattern.alias("pattern"), F.xxhash64(key.cast("string"), F.lit(seed)).alias("h"), F.lit(None).cast("long").alias("size"), row) if again else known
    rows = rows.join(sent(plan), "pattern").withColumn("part", part()).drop("wide", "rest", "room")
    clear = rows.where(F.col("end").isNull() | (F.col("part") != F.col("end"))).withColumn("more", F.coalesce(F.col("part") < F.col("end"), F.lit(False)).cast("int"))
    edge = rows.where(F.col("part") == F.col("end")).join(sent(chosen), ["pattern", "h"], "left")
    sole = edge.where("m is null or m = n").withColumn("more", F.col("m").isNotNull().cast("int"))
    # Only where some of the documents of one hash are taken they are told apart.
    nth = Window.partitionBy("pattern", "h").orderBy(F.xxhash64("row"))
    tied = edge.where("m < n").withColumn("more", (F.row_number().over(nth) <= F.col("m")).cast("int"))
    every = clear.drop("part", "end").unionByName(sole.drop("part", "end", "n", "m")).unionByName(tied.drop("part", "end", "n", "m"))
    every = every.withColumn("copies", F.col("whole") + F.col("more"))
    draw = lambda i: F.xxhash64("h", i) / 2.0**64 + 0.5
    source = lambda i: F.get(F.filter("shares", lambda x: x["upto"] > draw(i)), 0)["source"]
    counts_for = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), source)).otherwise(F.array().cast("array<string>"))
    return every.select("row", "size", "pattern", "copies", counts_for.alias("counts_for"), "source_size", "target")


def _seeded(id_col: str, text_col: str) -> Column:
    """What rows are ordered by: their id, or their text where they have none."""
    return F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def cycle(weights: tuple[float, ...] = (5, 2, 1)) -> Callable[[list], dict]:
    """Weights that repeat along the ordered sources."""
    return lambda order: {s: weights[i % len(weights)] for i, s in enumerate(order)}


def mix_documents(docs: DataFrame, weigh: Callable[[list], dict] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies), one for each input row of documents with one source each."""
    out = mix(docs, weigh or cycle(), F.array(F.col(source_col).cast("string")), _seeded(id_col, text_col), words(F.col(text_col)), [id_col], **how)
    return out.select(F.col("row")[id_col].alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, weigh: Callable[[list], dict] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them."""
    out = mix(docs, weigh or cycle(), F.array(F.col(source_col).cast("string")), _seeded(id_col, text_col), words(F.col(text_col)), docs.columns, again=True, **how)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
