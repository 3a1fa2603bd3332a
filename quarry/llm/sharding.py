"""K-d tree partitioning into shards of near-equal bytes, in DataFrame functions only.

Nodes split at distributed weighted medians: each split takes three histogram passes over a narrow
stored table, and every pass sends at most `nodes x BINS` sums to the driver, whatever the input's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Stored, read_table, running_offset

BINS, ROUNDS = 1024, 3
#: A composite split key has 30 bits: the position in the node's widest dimension, then a hash that parts ties.
DIM_BITS, TIE_BITS = 16, 14
#: Rows that one slot-numbering part holds, about.
ROWS_A_PART = 16_384


@dataclass
class Node:
    leaves: int
    dim: str = ""
    low: float = 0.0
    high: float = 0.0
    cut: int = 0
    kids: list["Node"] = field(default_factory=list)


def string_key(c: Column) -> Column:
    """The first six UTF-8 bytes as a long that sorts as the string does; null and empty give 0."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long"), F.lit(0))


class Tree:
    """The tree as arrays by node number, level by level, which rows walk down with one step a level."""

    def __init__(self, root: Node, dims: list[str]):
        self.nodes, self.depth = [root], 0
        level = [root]
        while any(n.kids for n in level):
            level = [k for n in level for k in n.kids]
            self.nodes += level
            self.depth += 1
        number = {id(n): i for i, n in enumerate(self.nodes)}
        self.number = number
        array = lambda values, kind: F.expr(f"array({', '.join(map(repr, values))})").cast(f"array<{kind}>")  # noqa: E731  one expression, however many nodes
        self.dim = array([dims.index(n.dim) + 1 if n.dim else 1 for n in self.nodes], "int")
        self.low = array([float(n.low) for n in self.nodes], "double")
        self.span = array([max(n.high - n.low, 1.0) for n in self.nodes], "double")
        self.cut = array([n.cut for n in self.nodes], "long")
        self.first = array([number[id(n.kids[0])] if n.kids else -1 for n in self.nodes], "int")
        self.values = F.array(*[F.col(d).cast("double") for d in dims])

    def key(self, node: Column) -> Column:
        """A row's place in its node's dimension, with bits of a hash below it that part ties."""
        at = node + 1
        place = F.floor((F.element_at(self.values, F.element_at(self.dim, at)) - F.element_at(self.low, at)) / F.element_at(self.span, at) * F.lit(float(2**DIM_BITS - 1)))
        place = F.least(F.greatest(place.cast("long"), F.lit(0)), F.lit(2**DIM_BITS - 1))
        return F.shiftleft(place, TIE_BITS).bitwiseOR(F.col("tie").bitwiseAND(F.lit(2**TIE_BITS - 1)))

    def leaf(self) -> Column:
        """The number of the leaf that a row comes to."""
        if not self.depth:
            return F.lit(0)

        def step(node, _):
            first = F.element_at(self.first, node + 1)
            right = F.when(self.key(node) >= F.element_at(self.cut, node + 1), 1).otherwise(0)
            return F.when(first < 0, node).otherwise(first + right)

        return F.aggregate(F.array(*map(F.lit, range(self.depth))), F.lit(0), step)


def _frontier(root: Node) -> list[Node]:
    return [root] if not root.kids else [x for k in root.kids for x in _frontier(k)]


def _split(base: DataFrame, root: Node, dims: list[str], widths: dict[str, float]) -> None:
    """Splits every leaf of the tree that still stands for more than one shard."""
    live = [n for n in _frontier(root) if n.leaves > 1]
    before_split = Tree(root, dims)
    index = before_split.number
    rows = base.withColumn("node", before_split.leaf())
    spans = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
    for n in live:
        if s := spans.get(index[id(n)]):
            n.dim = max(dims, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / max(widths[d], 1.0))
            n.low, n.high = float(s[f"lo_{n.dim}"]), float(s[f"hi_{n.dim}"])
        else:
            n.dim = dims[0]
    # one long a row: the node's number above the 30 bits of its key; rows of whole nodes have nothing to split
    split = F.col("node").isin([index[id(n)] for n in live])
    tree = Tree(root, dims)
    coded = rows.where(split).select("size", (tree.key(F.col("node")) + F.shiftleft(F.col("node").cast("long"), 30)).alias("code"))
    want = {index[id(n)]: (spans[index[id(n)]]["bytes"] if index[id(n)] in spans else 0) * ((n.leaves + 1) // 2) / n.leaves for n in live}
    found = {i: (i, 0) for i in want}  # the code's leading bits so far; bytes before them
    for step in range(ROUNDS):
        shift = (ROUNDS - 1 - step) * 10
        inside = coded.where(F.shiftright("code", shift + 10).isin([p for p, _ in found.values()]))
        sums: dict[int, dict[int, int]] = {i: {} for i in want}
        for r in inside.groupBy(F.shiftright("code", shift).alias("bin")).agg(F.sum("size").alias("b")).collect():
            sums[r["bin"] >> (30 - shift)][r["bin"]] = r["b"]
        for i, by_bin in sums.items():
            prefix, before = found[i]
            at = prefix * BINS
            for at in sorted(by_bin):
                if before + by_bin[at] >= want[i]:
                    break
                before += by_bin[at]
            if shift == 0 and by_bin and before + by_bin.get(at, 0) - want[i] < want[i] - before:
                at += 1  # the nearer side of the last cell
            found[i] = (at, before)
    for n in live:
        left = (n.leaves + 1) // 2
        n.cut = found[index[id(n)]][0] - (index[id(n)] << 30)
        n.kids = [Node(left), Node(n.leaves - left)]


def kd_shards(docs: DataFrame, *, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """Deals all rows into shards of near-equal bytes: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1. A node is split at the weighted median along the
    dimension that is widest in it, as a share of that dimension's width over all rows, until leaves reach
    `target_bytes` (or there are `n_shards`). `dims` maps names to numeric columns; by default the id, the
    size, and source and lang where the table has them. Ties in a dimension are parted by a hash of id and
    text, so one hot source or language is split like any other; only rows equal in both id and text, or
    in one of 2^14 hash cells of one value, stay together, which bounds how uneven a split can be.
    Null dimensions count as 0, an empty table gives an empty result, other columns are ignored.
    slot numbers a shard's rows from 0 without gaps.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    if dims is None:
        dims = {"d_id": F.col(id_col), "d_size": F.octet_length(text)} | {f"d_{c}": string_key(F.col(c)) for c in ("source", "lang") if c in docs.columns}
    names = list(dims)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in dims.items()],
    ).withColumn("tie", F.xxhash64("doc_id", "text_crc32"))
    keep = Stored(base, "kd-base")
    base = keep.df
    total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), *[f(d).alias(f"{k}_{d}") for d in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if n_shards is None:
        n_shards = max(1, math.ceil((total["b"] or 0) / (target_bytes or 1)))
    root = Node(n_shards)
    if total["n"]:
        widths = {d: float(total[f"hi_{d}"] - total[f"lo_{d}"]) for d in names}
        while any(n.leaves > 1 for n in _frontier(root)):
            _split(base, root, names, widths)
    tree = Tree(root, names)
    shards = {tree.number[id(n)]: i for i, n in enumerate(_frontier(root))}
    shard = F.element_at(F.expr(f"array({', '.join(str(shards.get(i, -1)) for i in range(len(tree.nodes)))})"), tree.leaf() + 1)
    placed = base.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "tie", "shard")
    parts = max(1, math.ceil((total["n"] or 0) / (n_shards * ROWS_A_PART)))
    numbered = running_offset(placed, ["shard"], F.pmod(F.shiftright("tie", 20), F.lit(parts)), [F.col("doc_id"), F.col("text_crc32")], parts, F.lit(1), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards; for nulls, ties and repeats see `kd_shards`."""
    return kd_shards(read_table(spark, sf_dir, "documents"), n_shards=16)
