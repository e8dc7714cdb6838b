"""Global places of sorted rows without a task that sees them all: sorted blocks by key ranges, and offsets of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch

BLOCK_ROWS = 1 << 20
_LOW = (1 << 33) - 1  # monotonically_increasing_id keeps the row of its partition in the lower 33 bits


def sorted_blocks(
    df: DataFrame, keys: list[Column | str], scratch: Scratch, name: str, rows: int = BLOCK_ROWS, then: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """df, sorted by keys, as blocks of about so many rows: a written table with `block`, and `pos` from 0 in it.

    Keys that leave no ties spread equal rows over blocks. The written table fixes blocks and places for all later plans.
    `then` is applied to the sorted rows before they are written; a partition is a block there, in order."""
    df = scratch.write(df, f"{name}-unsorted")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(df.count() / rows))
    cut = df.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    cut = cut.withColumn("_id", F.monotonically_increasing_id())
    placed = cut.withColumn("block", F.shiftright("_id", 33).cast("int")).withColumn("pos", F.col("_id").bitwiseAND(F.lit(_LOW))).drop("_id")
    out = scratch.write(then(placed), name)
    scratch.drop(df)
    return out


def with_places(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks with the place of each row from 1 in the order of all; the offsets are a row a block."""
    counts = sorted((r["block"], r["count"]) for r in blocks.groupBy("block").count().collect())
    offsets, total = [], 1
    for block, n in counts:
        offsets.append((block, total))
        total += n
    at = blocks.sparkSession.createDataFrame(offsets, "block int, _from long")
    return blocks.join(F.broadcast(at), "block").withColumn(name, F.col("pos") + F.col("_from")).drop("block", "pos", "_from")
