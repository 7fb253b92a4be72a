"""Best-fit-decreasing packing of indivisible groups into shards.

Groups (equal texts) are taken from the largest to the smallest; each enters the open shard with the tightest remaining
capacity that still holds it, found by a successor search in a balanced tree.

At any size the items that are packed are bounded: a group above ``total / (shards * grain)`` is an item of its own (there
can be at most ``shards * grain``), smaller groups of the same size class are bundled by a hash of the group into items of
about that size. Whole groups stay together either way. Only the items and their sizes reach the driver; the rows find
their shard by a join with the placed items, whose number is bounded the same way.

Defined results: a null text counts as an empty one; a repeated row is a member of the same group; an empty table gives
an empty result; an item above the fixed capacity gets a shard of its own that holds nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from counterpoise.session import stage


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = field(default=1)


class BalancedTree:
    """AVL tree of (remaining capacity, shard) with insert, remove and successor in logarithmic time."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    def insert(self, key: tuple[int, int]) -> None:
        self._root = self._insert(self._root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self._root = self._remove(self._root, key)

    def at_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Smallest key that is not below ``key``."""
        node, found = self._root, None
        while node:
            if node.key >= key:
                found, node = node.key, node.left
            else:
                node = node.right
        return found

    def _insert(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._balanced(node)

    def _remove(self, node: _Node | None, key: tuple[int, int]) -> _Node | None:
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            follower = node.right
            while follower.left:
                follower = follower.left
            node.key = follower.key
            node.right = self._remove(node.right, follower.key)
        return self._balanced(node)

    @staticmethod
    def _height(node: _Node | None) -> int:
        return node.height if node else 0

    def _balanced(self, node: _Node) -> _Node:
        self._measure(node)
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turn(node.left, "right", "left")
            return self._turn(node, "left", "right")
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turn(node.right, "left", "right")
            return self._turn(node, "right", "left")
        return node

    def _turn(self, node: _Node, side: str, other: str) -> _Node:
        """Lift the child of ``side`` above its parent."""
        child = getattr(node, side)
        setattr(node, side, getattr(child, other))
        setattr(child, other, node)
        self._measure(node)
        return self._measure(child)

    def _measure(self, node: _Node) -> _Node:
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        return node


def best_fit(sizes: list[int], capacity: int, open_shards: int = 0) -> list[int]:
    """Shard of each size; ``sizes`` must come in decreasing order. ``open_shards`` are open from the start."""
    tree, placed, n = BalancedTree(), [], open_shards
    for shard in range(open_shards):
        tree.insert((capacity, shard))
    for size in sizes:
        found = tree.at_least((size, -1))
        if found is None:
            found = (capacity, n)
            n += 1
        else:
            tree.remove(found)
        placed.append(found[1])
        if found[0] > size:
            tree.insert((found[0] - size, found[1]))
        elif found[0] == size:
            # A full shard still takes what has no size.
            tree.insert((0, found[1]))
    return placed


def pack(sizes: list[int], shards: int) -> list[int]:
    """Best fit into ``shards`` shards of the smallest capacity, found by bisection, for which they suffice."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // shards))
    high = max(2 * low, low + 1)
    while max(best_fit(sizes, high)) >= shards:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, high)


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes and 8 for the row itself."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def assign_shards(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", capacity: int | None = None, grain: int = 256,
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Each row's key, size, crc of the text, shard and place in the shard.

    With ``capacity`` the shards are as many as best fit needs; otherwise ``shards`` of near equal size. ``grain`` is the
    number of items a shard is made of at least, and so how even the shards are.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), text_size(text).alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.md5(body.cast("binary")).alias("g"))
    rows = stage(rows, "shard-rows")
    groups = stage(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.first("size").alias("size")), "shard-groups")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = shards if capacity is None else max(1, -(-total // capacity))
    step = max(1, total // (wanted * grain))
    # Equal texts have equal row sizes, so a row knows its size class without knowing its group.
    size_class = F.floor(F.log2("size")).cast("int")
    large = groups.where(F.col("bytes") > step)
    small = groups.where(F.col("bytes") <= step).withColumn("class", size_class)
    volume = {r[0]: r[1] for r in small.groupBy("class").agg(F.sum("bytes")).collect()}
    bundles = F.create_map(*[F.lit(x) for c, v in volume.items() for x in (c, max(1, -(-v // step)))]) if volume else None

    def bundle() -> Column:
        if bundles is None:
            return F.lit("")
        return F.concat_ws("/", size_class, F.pmod(F.xxhash64("g"), F.element_at(bundles, size_class)))

    items = [(r[0], r[1]) for r in large.select("g", "bytes").collect()]
    items += [(r[0], r[1]) for r in small.groupBy(bundle().alias("item")).agg(F.sum("bytes")).collect()]
    items.sort(key=lambda x: (-x[1], x[0]))
    sizes = [x[1] for x in items]
    placed = best_fit(sizes, capacity) if capacity is not None else pack(sizes, shards)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())])
    # At most 2 * wanted * grain + 64 items of under 50 bytes.
    where = spark.createDataFrame([(item[0], shard) for item, shard in zip(items, placed)], schema)
    own, shared = (where.where(F.col("item").contains("/") == side) for side in (False, True))
    known = rows.join(F.broadcast(own.withColumnRenamed("shard", "own")), F.col("g") == F.col("item"), "left").drop("item")
    known = known.withColumn("b", F.when(F.col("own").isNull(), bundle()))
    known = known.join(F.broadcast(shared), F.col("b") == F.col("item"), "left")
    known = known.select("k", "size", "crc", F.coalesce("own", "shard").alias("shard"))
    return _with_slots(known, max(1, -(-count // (rows_per_task * max(1, wanted))))).withColumnRenamed("k", key)


def _with_slots(rows: DataFrame, parts: int) -> DataFrame:
    """Gapless places from 0 within a shard: places within hash parts of it plus the sizes of the parts before."""
    part = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("shard", "part").orderBy("k", "crc", "size")
    rows = rows.withColumn("place", F.row_number().over(place).cast("long") - 1)
    joined = rows.join(counts, ["shard", "part"])
    return joined.select("k", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("place")).alias("slot"))
