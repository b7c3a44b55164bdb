"""Members of a key compared with each other in blocks of bounded size, however many share the key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """rows with a, b and block before the other columns, dealt out and sorted by (key, a, b).

    A key with more than ``most`` rows is cut into blocks by a hash of the member; its rows go to every pair (a, b) of
    blocks that theirs is in, so each pair of members meets exactly once: those of one block where a = b."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    n = F.coalesce("blocks", F.lit(1))
    split = rows.join(hot, key, "left").withColumn("block", F.pmod(F.xxhash64(member), n).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    split = split.select(key, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", *(c for c in rows.columns if c != key))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return split.repartition(tasks, key, "a", "b").sortWithinPartitions(key, "a", "b")


def groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """The runs of rows with equal first columns, of two rows at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(keys)):
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)
