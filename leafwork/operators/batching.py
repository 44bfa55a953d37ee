"""Greedy batches over ordered rows, split over tasks however many rows a key has.

Where a batch starts depends on all rows of the key before it, but only through the batch that is open: at most
``max_items`` rows.  So a block of sorted rows is a function from the number of rows that are open where it begins to the
number that are open where it ends, and functions of blocks are composed in order, one row a block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..tables import cut


def _moved(state: tuple[int, int, int], size: int, max_items: int, max_chars: int) -> tuple[int, int, int]:
    """(rows, characters) of the open batch and its number, after one more row."""
    n, chars, batch = state
    if n and (n >= max_items or chars + size > max_chars):
        return 1, size, batch + 1
    return n + 1, chars + size, batch


def _rows(frames):
    """(block, key, size) of record batches whose columns are block, keys, order and size."""
    for b in frames:
        block, *keys, _, size = (c.to_pylist() for c in b.columns)
        yield from zip(block, zip(*keys), size)


def with_batches(rows: DataFrame, keys: list[str], order: str, length: Column, max_items: int = 6, max_chars: int = 6000, blocks: int | None = None) -> DataFrame:
    """(keys, order, batch): batch numbers, from 0, for the rows of each key in order.

    A batch closes when it is full or the next text would exceed its characters; a longer text stands alone.  ``order`` is
    unique within a key; null lengths count as 0, null keys are a key like any other.  Rows are sorted by ranges of (keys, order)
    into ``blocks`` (by default, as many as Spark shuffles into), so a key with most of the rows lies in many tasks.  The driver
    sees one row a block.
    """
    picked = rows.select(*keys, order, F.coalesce(length.cast("long"), F.lit(0)).alias("_length"))
    by = [*keys, order]
    ranged = picked.repartitionByRange(blocks, *by) if blocks else picked.repartitionByRange(*by)
    ranged = cut(ranged.select(F.spark_partition_id().alias("_block"), "*"))
    spark = rows.sparkSession
    count = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(count, "_block").sortWithinPartitions("_block", *by)

    def ends(frames):
        """Of each block: its first and last key, how many it has, its last rows, and what is open at its end if its last key starts within."""
        block, out, types = None, [], []
        for b in frames:
            types = [b.schema.field(1 + i).type for i in range(len(keys))]
            for at, key, size in _rows([b]):
                if at != block:
                    block, first, last, state, tail, kinds = at, key, key, (0, 0, 0), [], 1
                    out.append(None)
                elif key != last:
                    last, state, tail, kinds = key, (0, 0, 0), [], kinds + 1
                state, tail = _moved(state, size, max_items, max_chars), [*tail, size][-max_items:]
                out[-1] = (block, kinds, state[0], state[2], tail, *first, *last)
        if out:
            kinds_ = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *types, *types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds_)], told.names)

    told = StructType.fromDDL("_block int, kinds long, n int, batch int, tail array<long>")
    told = StructType([*told, *[StructField(f"_{end}{i}", picked.schema[k].dataType) for end in ("first", "last") for i, k in enumerate(keys)]])
    edges = sorted(dealt(ranged).mapInArrow(ends, told).collect(), key=lambda r: r["_block"])
    known = {r["_block"]: r for r in edges}
    goes_on = {b["_block"]: a is not None and all(a[f"_last{i}"] == b[f"_first{i}"] for i in range(len(keys))) for a, b in zip([None, *edges], edges)}

    # The rows before each block that may be open where it begins.
    before: dict[int, list[int]] = {}
    tail: list[int] = []
    for e in edges:
        at = e["_block"]
        before[at] = tail if goes_on[at] else []
        tail = [*(before[at] if known[at]["kinds"] == 1 else []), *known[at]["tail"]][-max_items:]

    def moves(frames):
        """Of each block of one key: what is open at its end, for each number of rows that may be open where it begins."""
        block, states, out = None, {}, []

        def close():
            for n, (state, starts) in states.items():
                out.extend((block, start, state[0], state[2] + more) for start, more in starts)

        for at, _, size in _rows(frames):
            if at != block:
                close()
                block, rows_ = at, before[at]
                states = {n: ((n, sum(rows_[len(rows_) - n :]), 0), [(n, 0)]) for n in range(1, len(rows_) + 1)}
            merged = {}
            for state, starts in states.values():
                n, chars, batch = _moved(state, size, max_items, max_chars)
                # States with the same open batch stay the same for good; each start keeps how many batches it is ahead.
                same = merged.setdefault((n, chars), ((n, chars, batch), []))
                same[1].extend((start, more + batch - same[0][2]) for start, more in starts)
            states = merged
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in (zip(*out) if out else [()] * 4)], ["_block", "start", "n", "batch"])

    through = [at for at, on in goes_on.items() if on and known[at]["kinds"] == 1]
    moved = {}
    if through:
        inner = spark.createDataFrame([(at,) for at in through], "_block int")
        for r in dealt(ranged.join(F.broadcast(inner), "_block", "left_semi")).mapInArrow(moves, "_block int, start int, n int, batch int").collect():
            moved[r["_block"], r["start"]] = r["n"], r["batch"]
    entry: dict[int, tuple[int, int, int]] = {}
    n = batch = 0
    for e in edges:
        at = e["_block"]
        if not goes_on[at]:
            n = batch = 0
        entry[at] = (n, sum(before[at][len(before[at]) - n :]), batch)
        if goes_on[at] and known[at]["kinds"] == 1:
            n, more = moved[at, n]
            batch += more
        else:
            n, batch = known[at]["n"], known[at]["batch"]

    kind = StructType([*picked.schema.fields[:-1], StructField("batch", IntegerType())])

    def number(frames):
        block, last, state = None, None, (0, 0, 0)
        for b in frames:
            out = []
            for at, key, size in _rows([b]):
                if at != block:
                    state = entry[at]
                elif key != last:
                    state = (0, 0, 0)
                block, last, state = at, key, _moved(state, size, max_items, max_chars)
                out.append(state[2])
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], pa.array(out, pa.int32())], [*b.schema.names[1:-1], "batch"])

    return dealt(ranged).mapInArrow(number, kind)
