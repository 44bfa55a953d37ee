"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The k-th block (from 0) of a source with share w may run from slot floor(k / w) and must run before slot
ceil((k + 1) / w).  Earliest deadline first among released blocks meets every deadline of such unit jobs,
so after any number of slots each source is less than one block from its target.  With whole-number weights
the schedule repeats after sum(weights) slots; one period is computed in SQL from the weights alone and joined
to all blocks, so nothing here grows with the data but one shuffle that ranks the rows of each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_rank

OTHER = "*"


def period(spark, weights: dict[str, int], other: int) -> DataFrame:
    """Rows (mix_source, weight, nth, at, before): the nth block of a period runs in slot ``at``; ``before`` counts
    each source's blocks in earlier slots.  Sum of weights rows, at most; bounded by the parameters."""
    names, w = [*weights, OTHER], [*weights.values(), other]
    if not all(isinstance(x, int) and x > 0 for x in w):
        raise ValueError("weights must be positive whole numbers")
    total, g = sum(w), len(w)
    ws = f"array({','.join(map(str, w))})"
    due = f"transform(sequence(0, {g - 1}), i -> struct((s.k[i] + 1) * {total} + {ws}[i] - 1 as d, i as i))"
    due = f"transform({due}, x -> struct(x.d div {ws}[x.i] as deadline, x.i as i, (s.k[x.i] * {total}) div {ws}[x.i] as release))"
    pick = f"array_min(filter({due}, x -> x.release <= t and s.k[x.i] < {ws}[x.i])).i"
    fold = f"""aggregate(sequence(0, {total - 1}), named_struct('k', array_repeat(0, {g}), 'picks', cast(array() as array<int>)),
        (s, t) -> transform(array({pick}), p -> named_struct('k', transform(s.k, (v, i) -> v + int(i = p)), 'picks', concat(s.picks, array(p))))[0], s -> s.picks)"""
    one = spark.range(1).select(F.expr(fold).alias("picks"))
    slots = one.select("picks", F.posexplode("picks").alias("at", "g"))
    slots = slots.select("at", "g", F.expr(f"transform(sequence(0, {g - 1}), i -> size(filter(slice(picks, 1, at), x -> x = i)))").alias("before"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("g") + 1)
    return slots.select(label.alias("mix_source"), F.expr(f"{ws}[g]").alias("weight"), F.expr("before[g]").alias("nth"), "at", "before")


def _own_source(source, weights: dict[str, int]):
    names = F.array(*map(F.lit, weights)) if weights else F.array().cast("array<string>")
    return F.coalesce(F.when(F.array_contains(names, source), source), F.lit(OTHER))


def _plan(rows: DataFrame, weights: dict[str, int], other: int) -> DataFrame:
    """One period with the rows of each source; at most one row per unit of weight."""
    totals = rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.withColumn("all", F.map_from_entries(F.collect_list(F.struct("mix_source", "n")).over(Window.partitionBy(F.lit(0)))))
    order = F.array(*map(F.lit, [*weights, OTHER]))
    w = F.array(*map(F.lit, [*weights.values(), other]))
    plan = period(rows.sparkSession, weights, other).join(F.broadcast(totals), "mix_source")
    return plan.withColumn("counts", F.transform(order, lambda x: F.coalesce(F.try_element_at("all", x), F.lit(0)))).withColumn("w", w).drop("n", "all")


def _placed(ranked: DataFrame, plan: DataFrame, weights: dict[str, int], other: int, block_rows: int) -> DataFrame:
    """Add block, slot and position to rows with mix_source and their rank ``r`` in it."""
    block = F.floor(F.col("r") / block_rows)
    cycle = F.floor(F.col("block") / F.col("weight"))
    ranked = ranked.withColumn("block", block).join(F.broadcast(plan.select("mix_source", "weight").distinct()), "mix_source")
    ranked = ranked.withColumns({"cycle": cycle, "nth": F.pmod("block", "weight").cast("int")}).drop("weight")
    start = F.expr(f"aggregate(sequence(0, size(w) - 1), 0L, (a, i) -> a + least(counts[i], {block_rows}L * (cycle * w[i] + before[i])))")
    slot = F.col("cycle") * (sum(weights.values()) + other) + F.col("at")
    return ranked.join(F.broadcast(plan), ["mix_source", "nth"]).withColumns({"slot": slot.cast("long"), "position": (start + F.pmod("r", F.lit(block_rows))).cast("long"), "block": F.col("block").cast("long")})


ADDED = ("mix_source", "block", "slot", "position")


def _rows(docs: DataFrame, weights: dict[str, int], block_rows: int, id_col: str, source_col: str) -> DataFrame:
    """The whole row as one column, so that no name of docs meets one used here; with its source and id."""
    if block_rows < 1:
        raise ValueError("block_rows must be positive")
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _own_source(F.col(source_col), weights).alias("mix_source"))


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Add mix_source, block, slot and position (from 0, gapless) to the rows of docs; every row stays.

    A row's source is one that ``weights`` names or else, null included, OTHER.  Rows of a source follow
    the hash of their id, a null id that of the empty text; equal ids, and so repeated rows, count as ties in any order.
    Until the first source runs out, the first n blocks hold each source to within one block of its weight; then the
    rest share its slots by their own weights.  The last block of a source may be short.  An empty table gives no rows.
    Other columns are carried along whatever their names, but those named like the four added ones are replaced.
    """
    rows = _rows(docs, weights, block_rows, id_col, source_col)
    placed = _placed(with_rank(rows, ["mix_source"], F.col("id"), "r"), _plan(rows, weights, other), weights, other, block_rows)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    return placed.select(*kept, *ADDED)


def mixed_order(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 64, leaves: int = 4096, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows and columns of docs, laid out in mixed order: each partition sorted by position, and partitions by where they begin.

    Rows move once.  Hashes of ids fall into ``leaves`` ranges a source (a power of 16); counts give each range its first
    rank, and so its place in the order; rows go to the partition of that place and are ranked there.  Rows, ties and
    odd values are treated as by mix.
    """
    digits = len(f"{leaves - 1:x}")
    rows = _rows(docs, weights, block_rows, id_col, source_col)
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("leaf", F.substring("h", 1, digits)).drop("id")
    plan = _plan(rows, weights, other)
    leaf = rows.groupBy("mix_source", "leaf").agg(F.count(F.lit(1)).alias("n"))  # at most leaves x sources rows
    leaf = leaf.withColumn("r", F.sum("n").over(Window.partitionBy("mix_source").orderBy("leaf")) - F.col("n"))
    leaf = cut(_placed(leaf, plan, weights, other, block_rows).select("mix_source", "leaf", F.col("r").alias("base"), F.col("position").alias("place")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(F.broadcast(leaf), ["mix_source", "leaf"]).repartitionByRange(parts, "place")
    own = Window.partitionBy("place", "mix_source", "leaf").orderBy("h")
    ranked = rows.select("row", "mix_source", (F.col("base") + F.row_number().over(own) - 1).alias("r"))
    return _placed(ranked, plan, weights, other, block_rows).sortWithinPartitions("position").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
