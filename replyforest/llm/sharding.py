"""Shards of nearly equal bytes by a k-d tree over metadata.

Groups of equal texts are points.  A node of the tree is split along its widest dimension at the weighted median,
found by passes over ever finer digits, each of which brings at most 4096 sums per node to the driver.  Ties along a
dimension are told apart by a hash of the text, so that one source that holds a third of the rows can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.llm.common import numbered_in_groups, text_of
from replyforest.session import passing_folder, stage

SHARDS = 16
DIMENSIONS = ("lang", "source", "doc_id")  # besides the size
PLACE_BITS, TIE_BITS, DIGIT = 31, 31, 12
EXACT = 0.0005  # share of a node's bytes that a digit may hold without being split further
HEAVY = 1 / 8  # of a shard's bytes: a heavier group is placed first; at most SHARDS / HEAVY are


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number that keeps its order; of texts the first seven bytes."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = column.cast("double")
        return F.when(F.isnan(value), F.lit(None)).otherwise(value)
    start = F.hex(F.substring(F.encode(text_of(column.cast("string")), "UTF-8"), 1, 7))
    return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("double")


def _spread(capacity: list[int], total: int) -> list[float]:
    """What each shard still takes of ``total`` bytes so that the fullest are as small as can be."""
    level, order = 0.0, sorted(capacity)
    for i, used in enumerate(order, 1):
        level = (total + sum(order[:i])) / i
        if i == len(order) or level <= order[i]:
            break
    return [max(0.0, level - used) for used in capacity]


class _Node:
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last  # shards
        self.dimension, self.threshold = 0, 0
        self.left: _Node | None = None
        self.right: _Node | None = None

    def shard(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(f"_k{self.dimension}") < self.threshold, self.left.shard()).otherwise(self.right.shard())

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()


def _thresholds(points: DataFrame, nodes: list[_Node], weights: dict[int, float], wanted: dict[int, float]) -> None:
    """Sets the threshold of every node so that about ``wanted`` of its bytes lie below."""
    bits = PLACE_BITS + TIE_BITS
    open_nodes = {n.first: (0, 0.0) for n in nodes}  # digits so far, bytes before them
    by_first = {n.first: n for n in nodes}
    shift = bits
    while open_nodes:
        step = min(DIGIT, shift)
        shift -= step
        key, prefix = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for first, (digits, _) in open_nodes.items():
            key = F.when(F.col("_node") == first, F.col(f"_k{by_first[first].dimension}")).otherwise(key)
            prefix = F.when(F.col("_node") == first, F.lit(digits)).otherwise(prefix)
        keyed = points.select("_node", "_weight", key.alias("key"), prefix.alias("prefix")).where(F.shiftright("key", shift + step) == F.col("prefix"))
        digit = F.shiftright("key", shift).alias("digits")
        found: dict[int, list[tuple[int, int]]] = {}
        for row in keyed.groupBy("_node", digit).agg(F.sum("_weight").alias("w")).collect():  # at most 4096 per node
            found.setdefault(row["_node"], []).append((row["digits"], row["w"]))
        following = {}
        for first, (digits, before) in open_nodes.items():
            node, at = by_first[first], before
            for value, weight in sorted(found.get(first, [])):
                if at + weight > wanted[first]:
                    if shift and weight > EXACT * weights[first]:
                        following[first] = (value, at)
                    else:  # the digit goes where it fits better
                        node.threshold = (value + int(wanted[first] - at > weight / 2)) << shift
                    break
                at += weight
            else:
                node.threshold = (digits + 1) << (shift + step)
        open_nodes = following


def shard(
    docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the shards have nearly equal bytes.

    ``size`` is the bytes of the text, null as none, plus 1.  Equal texts, null counting as empty, share a shard, so a
    group of more than a shard's bytes makes its shard larger than the others.  A group has the smallest value of its
    rows in every dimension; nulls come first, all else of a row is not read.  ``slot`` has no gaps in a shard.  Ids
    may be null or repeat.  An empty table gives no rows.
    """
    with passing_folder(docs.sparkSession, "shards") as steps:
        body = text_of(F.col(f"`{text}`"))
        raw = docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(f"`{doc_id}`").alias("_id"),
            (F.octet_length(body) + 1).cast("bigint").alias("_size"),
            F.crc32(F.encode(body, "UTF-8")).alias("_crc"),
            F.xxhash64(body).alias("_text"),
            F.xxhash64(F.lit(1), body).alias("_text2"),
            *[_number(docs, name).alias(f"_d{i + 1}") for i, name in enumerate(dimensions)],
        )
        rows = stage(raw.withColumn("_d0", F.log2(F.col("_size").cast("double"))), "rows", folder=steps)
        names = [f"_d{i}" for i in range(len(dimensions) + 1)]
        same = ["_text", "_text2", "_size", "_crc"]  # together no two texts share them
        groups = rows.groupBy(*same).agg(F.sum("_size").alias("_weight"), *[F.min(n).alias(n) for n in names])
        groups = stage(groups, "groups", folder=steps)
        bounds = groups.agg(F.sum("_weight").alias("total"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("min", F.min), ("max", F.max))]).first()
        total = bounds["total"] or 0
        heavy = groups.where(F.col("_weight") > total / shards * HEAVY)
        placed, used = [], [0] * shards
        for row in sorted(heavy.select(*same, "_weight").collect(), key=lambda r: (-r["_weight"], r["_text"], r["_text2"])):
            lightest = used.index(min(used))
            used[lightest] += row["_weight"]
            placed.append((*[row[c] for c in same], lightest))

        def place(i: int, name: str) -> Column:
            low, high = bounds[f"min{name}"], bounds[f"max{name}"]
            if low is None or high <= low:
                return F.lit(0).cast("bigint")
            share = (F.coalesce(F.col(name), F.lit(low)) - low) / (high - low)
            return F.floor(share * ((1 << PLACE_BITS) - 1)).cast("bigint")

        tie = F.shiftrightunsigned(F.xxhash64("_text", "_text2"), 64 - TIE_BITS)
        points = groups.where(F.col("_weight") <= total / shards * HEAVY)
        points = points.select(*same, "_weight", *[(F.shiftleft(place(i, n), TIE_BITS) + tie).alias(f"_k{i}") for i, n in enumerate(names)])
        points = stage(points, "points", folder=steps)

        capacity = _spread(used, total - sum(used))
        root = _Node(0, shards - 1)
        while splitting := [n for n in root.leaves() if n.last > n.first]:
            located = points.withColumn("_node", root.shard())
            widths = [(F.max(F.shiftright(f"_k{i}", TIE_BITS)) - F.min(F.shiftright(f"_k{i}", TIE_BITS))).alias(f"w{i}") for i in range(len(names))]
            known = {r["_node"]: r for r in located.groupBy("_node").agg(F.sum("_weight").alias("w"), *widths).collect()}
            weights, wanted = {}, {}
            for node in splitting:
                row = known.get(node.first)
                middle = (node.first + node.last) // 2
                left, right = sum(capacity[node.first : middle + 1]), sum(capacity[middle + 1 : node.last + 1])
                weights[node.first] = row["w"] if row else 0
                wanted[node.first] = weights[node.first] * (left / (left + right) if left + right else 0.5)
                node.dimension = max(range(len(names)), key=lambda i: row[f"w{i}"]) if row else 0
            _thresholds(located, splitting, weights, wanted)
            for node in splitting:
                middle = (node.first + node.last) // 2
                node.left, node.right = _Node(node.first, middle), _Node(middle + 1, node.last)
        shards_of = points.select(*same, root.shard().alias("shard"))
        if placed:
            kinds = "_text bigint, _text2 bigint, _size bigint, _crc bigint, shard int"
            shards_of = shards_of.unionByName(docs.sparkSession.createDataFrame(placed, kinds))
        count = rows.count()
        found = rows.join(stage(shards_of, "shards", folder=steps), same).select("_row", "_id", "_size", "_crc", "shard")
        numbered = numbered_in_groups(stage(found, "found", folder=steps), "shard", "_row", count, "slot")
        result = numbered.select(
            F.col("_id").alias("doc_id"),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
        )
        return stage(result, "shards")
