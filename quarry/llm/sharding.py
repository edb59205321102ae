"""Sharding by a hierarchical weighted hash tree.

Every node of the tree (region, rack, shard) has a weight, an inner node's being the sum of its shards'. A
key descends from the root: at each level every child draws -ln(u) / weight, u the child's own hash of the key in
(0, 1), and the least draw wins, so that a child gets keys in proportion to its weight. A child's draw
depends on nothing else: when weights change, keys move only into or out of the subtrees whose weights changed. A shard that
is added as a branch of its own at the root takes keys only into itself.

Slots number a shard's rows from 0 without gaps, in the order (hash bucket, key, size, checksum): counts of each
bucket, of which there are a fixed number, give offsets, and rows are ranked within one bucket of one shard only. The bucket is of key and checksum, so rows without a key are dealt over all of them.

Defined results: a null key is placed as the empty string is; a null text has no bytes and checksum 0; repeated rows all go to
one shard and get slots of their own; an empty table gives an empty table; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A tree is a list of regions, these lists of racks, these lists of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]
SLOT_DIGITS = 3  # hex digits of the hash that give the slot bucket: 4,096 buckets a shard


def regular(shards: int, racks: int, per_rack: int, extra: int = 0) -> Tree:
    """shards equal shards in racks of per_rack and regions of `racks` racks; extra ones in a region each."""
    rows = [[(s, 1.0) for s in range(a, min(a + per_rack, shards))] for a in range(0, shards, per_rack)]
    return [rows[a : a + racks] for a in range(0, len(rows), racks)] + [[[(shards + i, 1.0)]] for i in range(extra)]


def nodes(tree: Tree) -> list[tuple[str, str, float, int | None]]:
    """(node, parent, weight, shard) of all nodes below the root, whose name is empty. Names hold no positions of others, so they stay when the tree grows."""
    out: list[tuple[str, str, float, int | None]] = []
    for i, racks in enumerate(tree):
        out.append((f"/{i}", "", sum(w for r in racks for _, w in r), None))
        for j, rack in enumerate(racks):
            out.append((f"/{i}/{j}", f"/{i}", sum(w for _, w in rack), None))
            out += [(f"/{i}/{j}/{s}", f"/{i}/{j}", w, s) for s, w in rack]
    return [n for n in out if n[2] > 0]


def _unit(key: Column, name: str) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + name))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def place(key: Column, tree: Tree) -> Column:
    """The shard of a string key. The expression grows with the number of nodes, but a row only draws for one node's children a level."""
    all_nodes = nodes(tree)

    def pick(parent: str) -> Column:
        below = [n for n in all_nodes if n[1] == parent]
        if below[0][3] is not None:
            options = [(F.lit(n[3]), n) for n in below]
        else:
            options = [(pick(n[0]), n) for n in below]
        if len(below) == 1:
            return options[0][0]
        best = F.array_min(F.array(*[F.struct((-F.log(_unit(key, n[0])) / F.lit(n[2])).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(below)]))["i"]
        if below[0][3] is not None:
            return F.element_at(F.array(*[o for o, _ in options]), best + 1)
        out = F.when(best == 0, options[0][0])
        for i in range(1, len(options)):
            out = out.when(best == i, options[i][0])
        return out

    return pick("").cast("int")


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each input row."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("string")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    bucket = F.substring(F.md5(F.concat(key, F.lit(":"), crc.cast("string"), F.lit(":slot"))), 1, SLOT_DIGITS)
    ids = docs.select(F.col(id_col).alias("doc_id"), place(key, tree).alias("shard"), bucket.alias("bucket"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4,096 rows a shard, whatever the table: small enough to send to all.
    offsets = ids.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        bucket.alias("bucket"),
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("k")).cast("long").alias("slot"), "grown_shard")


def shard_sql(tree: Tree, grown: Tree) -> str:
    """The same over documents for DuckDB."""

    def descend(name: str, tree: Tree) -> str:
        values = ", ".join(f"('{n}', '{p}', {w!r}::DOUBLE, {'NULL' if s is None else s})" for n, p, w, s in nodes(tree))
        u = "((('0x' || substr(md5(k || ':' || n.node), 1, 8))::UBIGINT + 0.5) / 4294967296.0)"
        step = lambda a, b: f"{b} AS (SELECT k, arg_min(n.node, -ln({u}) / n.w) AS node FROM {a} JOIN {name}_nodes n ON n.parent = {a}.node GROUP BY k)"
        return f"""{name}_nodes(node, parent, w, s) AS (VALUES {values}), {name}_0 AS (SELECT DISTINCT k, '' AS node FROM keys),
{step(f"{name}_0", f"{name}_1")}, {step(f"{name}_1", f"{name}_2")}, {step(f"{name}_2", f"{name}_3")},
{name} AS (SELECT t.k, n.s FROM {name}_3 t JOIN {name}_nodes n ON n.node = t.node)"""

    return f"""WITH keys AS (SELECT coalesce(doc_id::VARCHAR, '') AS k FROM documents), {descend("old", tree)}, {descend("grown", grown)},
crc_table AS (SELECT i, list_reduce([i::UBIGINT] || [0::UBIGINT FOR _ IN range(8)], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
lookup AS (SELECT list(v ORDER BY i) AS v FROM crc_table),
texts AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
  xor(list_reduce([4294967295::UBIGINT] || [('0x' || hex[2 * i - 1 : 2 * i])::UBIGINT FOR i IN range(1, len(hex) // 2 + 1)], lambda c, b: xor(c >> 8, v[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS hex FROM documents), lookup)
SELECT t.doc_id, t.size::BIGINT AS size, t.text_crc32, 'key' AS law, old.s AS shard,
  row_number() OVER (PARTITION BY old.s ORDER BY substr(md5(old.k || ':' || t.text_crc32 || ':slot'), 1, {SLOT_DIGITS}), t.doc_id, t.size, t.text_crc32) - 1 AS slot, grown.s AS grown_shard
FROM texts t JOIN old ON old.k = coalesce(t.doc_id::VARCHAR, '') JOIN grown ON grown.k = old.k"""
