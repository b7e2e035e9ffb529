"""Shards by a weighted hash tree.

A row descends the levels region, rack and shard. At each node every child draws -ln(u) / weight with u a
hash of the row's id and the child's name; the smallest draw wins. The draw of a child depends on nothing
but the id, its name and its own weight: if one weight rises, rows move only into that child, and if one
falls, only out of it. A new shard comes as a region of its own, so no other node's weight changes and
rows move into the new shard alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets within a shard in which slots are numbered apart.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = ()


def tree(shards: int, base: int = 8, weights: dict[int, float] | None = None) -> Node:
    """The first base shards two to a rack, two racks to a region; each later one a region of its own."""
    weights = weights or {}

    def leaf(i: int, at: str) -> Node:
        return Node(f"{at}/s{i}", weights.get(i, 1.0), i)

    def parent(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), None, tuple(children))

    regions = []
    first = min(shards, base)
    for r in range(0, first, 4):
        racks = [parent(f"r{r // 4}/k{k // 2}", [leaf(i, f"r{r // 4}/k{k // 2}") for i in range(k, min(k + 2, first))]) for k in range(r, min(r + 4, first), 2)]
        regions.append(parent(f"r{r // 4}", racks))
    regions += [parent(f"x{i}", [parent(f"x{i}/k0", [leaf(i, f"x{i}/k0")])]) for i in range(first, shards)]
    return parent("", regions)


def draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) * (2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def place(key: Column, node: Node) -> Column:
    """The shard of the key below a node."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return place(key, live[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = F.when(best == 0, place(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(best == i, place(key, c))
    return out


def numbered(rows: DataFrame, group: list[str], order: list[str], key: Column, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds slot: 0, 1, 2, ... within each group, without one task that holds a whole group. Rows are
    numbered in hash buckets of the group; a bucket begins where those before it end."""
    split = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = split.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = split.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    return inside.join(begins, [*group, "_bucket"]).withColumn("slot", F.col("_from") + F.col("_k") - 1).drop("_bucket", "_from", "_k")


def assign(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot, grown_shard (with one
    more shard of weight 1).

    The law is `key`: doc_id and the number of shards decide. Null text: size 1, checksum of the empty
    text. Null doc_id: one key as any other. Repeated rows share a shard, each has a slot. Texts
    are read once and never shuffled. Other columns are not read.
    """
    key, text = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    ).withColumns({"shard": place(key, tree(shards, shards, weights)).cast("int"), "grown_shard": place(key, tree(shards + 1, shards, weights)).cast("int")})
    spread = F.struct("doc_id", "text_crc32", "size")
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], spread)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
