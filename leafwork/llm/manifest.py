"""A Merkle manifest of a dataset: a digest for each row, a tree over the rows of each group, and one over the groups.

Rows stand in order within their group and are cut into aligned blocks of 2 ** BLOCK_LEVELS leaves.  A task goes through the
leaves of one block by fractal traversal: it keeps the stacked subtrees that the current leaf's path runs through, and beside each of
them the subtree that the path will enter next, which grows by a few hashes at every leaf; so the authentication path of
each successive leaf is at hand while only a few small subtrees are held.  The roots of the blocks are the leaves of the next tier, and
so on up to the group's root; the groups' roots, in order, are the leaves of a last tree.  What a leaf's path needs above its block is
joined to it tier by tier.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import cut

BLOCK_LEVELS = 10
SUBTREE_LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, as lowercase hex, of fields written one after the other: ``-`` for null, else byte count, ``:`` and value."""
    written = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*[w.cast("binary") for w in written]), 256)


def parent(left: str | None, right: str | None) -> str | None:
    """The digest of the digests that are there, in order; none if neither is."""
    return None if left is None else sha256((left if right is None else left + right).encode()).hexdigest()


class _Growing:
    """The subtree over leaves ``begin`` to ``begin + 2 ** top - 1`` of a block, kept from level ``low`` up, made one leaf or one
    hash at a time.  Its stack holds at most one finished node a level."""

    def __init__(self, leaves: list[str], begin: int, low: int, top: int):
        self.leaves, self.next, self.low, self.top = leaves, begin, low, top
        self.begin, self.end = begin, begin + (1 << top)
        self.stack: list[tuple[int, int, str | None]] = []  # level, index, digest
        self.nodes: dict[tuple[int, int], str | None] = {}

    def grow(self, steps: int) -> None:
        for _ in range(steps):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (level, at, left), (_, _, right) = self.stack[-2:]
                self.stack[-2:] = [(level + 1, at >> 1, parent(left, right))]
            elif self.next < self.end:
                self.stack.append((0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None))
                self.next += 1
            else:
                return
            level, at, digest = self.stack[-1]
            if level >= self.low:
                self.nodes[level, at] = digest


def authentication_paths(leaves: list[str], levels: int, step: int = SUBTREE_LEVELS):
    """The root of a block of at most 2 ** levels leaves, then the siblings of each leaf in turn, from below; None where there is none.

    Every level hashes even a node that stands alone.  Subtrees of ``step`` levels are stacked; at each leaf the coming
    subtree of each tier below the top takes two steps, which finishes it before the path enters it.
    """
    cuts = [*range(0, levels, step), levels] if levels else [0]
    tiers = list(zip(cuts, cuts[1:]))
    now = [_Growing(leaves, 0, low, top) for low, top in tiers]
    # All leaves pass once; a tier's first subtree is finished when its own leaves have passed.
    for tree in now:
        tree.grow(1 << (tree.top + 2))
    yield now[-1].nodes[levels, 0] if levels else leaves[0]
    coming = [_Growing(leaves, 1 << top, low, top) for low, top in tiers[:-1]]
    for i in range(len(leaves)):
        path = []
        for tree in now:
            path += [tree.nodes.get((level, (i >> level) ^ 1)) for level in range(tree.low, tree.top)]
        yield path
        for k, (low, top) in enumerate(tiers[:-1]):
            coming[k].grow(2)
            if (i + 1) % (1 << top) == 0:
                now[k], coming[k] = coming[k], _Growing(leaves, i + 1 + (1 << top), low, top)


def _in_order(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``g``, the number of their group in the order of groups, null first, ``n``, the rows of it, and ``i``, their place
    in it; groups (group, g, n)).  Rows are sorted over ranges; a group may lie in any number of them."""
    rows = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.withColumns({"_before": before, "n": F.sum("_n").over(whole)}))
    # A group begins in one range; groups are numbered by these ranges and within a range by their first rows.
    first = runs.where("_before = 0").select("_part", "_group", "_first", "n")
    starts = first.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = starts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_first")) - 1
    groups = cut(first.withColumn("_nth", nth).join(starts, "_part").select(F.col("_group").alias("_named"), (F.col("_base") + F.col("_nth")).alias("g"), "n"))
    runs = runs.drop("n").join(groups, F.col("_group").eqNullSafe(F.col("_named"))).select("_part", "_group", "g", "n", (F.col("_before") - F.col("_first")).alias("_shift"))
    rows = rows.withColumn("_p", part).join(runs, (F.col("_p") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_part", "_group", "_shift"), groups.select(F.col("_named").alias(group), "g", "n")


def _tier(nodes: DataFrame, done: int) -> tuple[DataFrame, DataFrame]:
    """nodes (g, n, i, digest, ...) at level ``done`` of the trees g over n leaves, with ``block`` and the ``path`` of each within it,
    and the roots of the blocks (g, n, i, digest)."""
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    levels = F.greatest(F.lit(0), F.least(F.lit(BLOCK_LEVELS), height - done)).cast("int")
    rows = nodes.withColumns({"levels": levels, "block": F.shiftright("i", BLOCK_LEVELS)})
    kept = rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i").select(kept)
        paths = authentication_paths(table["digest"].to_pylist(), table["levels"][0].as_py())
        root = next(paths)
        path = pa.array(list(paths), pa.list_(pa.string()))
        return table.append_column("path", path).append_column("block_root", pa.array([root] + [None] * (len(table) - 1), pa.string()))

    kind = StructType([*rows.schema.fields, StructField("path", ArrayType(StringType())), StructField("block_root", StringType())])
    found = cut(rows.groupBy("g", "block").applyInArrow(run, kind))
    roots = found.where("block_root is not null").select("g", "n", F.col("block").alias("i"), F.col("block_root").alias("digest"))
    return found.drop("levels", "block_root"), roots


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All trees g over nodes (g, n, i, digest, ...), i gapless from 0 to n - 1: (nodes with block and path within it; for each
    block (g, block, above), the path from there to the root; (g, root))."""
    most = ((nodes.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    leaves, tops = _tier(nodes, 0)
    tiers, done = [], BLOCK_LEVELS
    while done < most:
        paths, tops = _tier(tops, done)
        tiers.append(paths.select("g", "i", "block", "path"))
        done += BLOCK_LEVELS
    if not tiers:
        above = tops.select("g", F.col("i").alias("block"), F.array().cast("array<string>").alias("above"))
    else:
        path = tiers.pop().select("g", "i", "path")
        while tiers:
            up = path.select("g", F.col("i").alias("block"), F.col("path").alias("up"))
            path = tiers.pop().join(up, ["g", "block"]).select("g", "i", F.concat("path", "up").alias("path"))
        above = path.select("g", F.col("i").alias("block"), F.col("path").alias("above"))
    return leaves, above, tops.select("g", F.col("digest").alias("root"))


def fold(leaf: Column, index: Column, path: Column) -> Column:
    """The root that a leaf at a place and a path of siblings lead to; a null sibling is one that is not there."""
    start = F.struct(leaf.alias("digest"), index.cast("long").alias("at"))

    def up(s, sibling):
        both = F.when(sibling.isNull(), s["digest"]).when(s["at"] % 2 == 0, F.concat(s["digest"], sibling)).otherwise(F.concat(sibling, s["digest"]))
        return F.struct(F.sha2(both.cast("binary"), 256).alias("digest"), F.shiftright(s["at"], 1).alias("at"))

    return F.aggregate(path, start, up, lambda s: s["digest"])


def manifest(rows: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: the order and group columns, leaf, i, path, subroot, g, upper_path, root, and the columns of ``keep``.

    ``path`` leads from the leaf at place i to the subroot of its group, ``upper_path`` from the subroot at place g to the
    root; ``fold`` checks them.  Rows of a group stand by ascending ``order``, a null one first, and equal ones by their
    leaf, so repeated rows are leaves each.  Groups stand in the order of their bytes, a null one first.  Null fields are
    told from empty ones.  An empty table gives no rows.  Other columns are ignored.

    A task holds one block of 2 ** BLOCK_LEVELS digests, however large a group is; each text is read and hashed once.
    """
    leaves = rows.select(F.col(order).alias("_order"), F.col(group).alias("_group_"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in (keep or {}).items()])
    placed, groups = _in_order(cut(leaves), "_group_", ["_order", "digest"])
    found, above, roots = trees(cut(placed))
    roots, zero = cut(roots), F.lit(0).cast("long").alias("g")
    count = roots.count()
    upper, over, top = trees(roots.select(zero, F.lit(count).cast("long").alias("n"), F.col("g").alias("i"), F.col("root").alias("digest")))
    top = top.first()
    upper = upper.join(over.drop("g"), "block").select(F.col("i").alias("g"), F.concat("path", "above").alias("upper_path"), F.col("digest").alias("subroot"))
    blocks = cut(above.join(upper, "g").withColumn("root", F.lit(top and top["root"]).cast("string")))
    out = found.join(blocks, ["g", "block"])
    return out.select(F.col("_order").alias(order), F.col("_group_").alias(group), F.col("digest").alias("leaf"), "i", F.concat("path", "above").alias("path"), "subroot", "g", "upper_path", "root", *(keep or {}))
