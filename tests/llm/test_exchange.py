"""The block exchange with one level and with several, held against plain counting, and its number of rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfell.llm import blockexchange as bx
from netfell.llm.words import mix
from netfell.scratch import Scratch

SUM = bx.Answer(lambda kind, numbers, first: np.add.reduceat(numbers, first), lambda kind, merged, own: merged * np.uint64(1000) + own, lambda kind, merged: {f"n{kind}": float(len(merged)), f"s{kind}": float(merged.sum())})


def entries(payload):
    """Two kinds of keys of a block: some common, some its own; block 3 has none, block 5 none of the second kind."""
    block = int(payload)
    rng = np.random.default_rng(block)
    common, own = mix(np.arange(60, dtype=np.uint64)), mix(np.uint64(1000 * (block + 1)) + np.arange(20, dtype=np.uint64))
    keys = np.unique(np.concatenate([common[rng.random(60) < 0.5], own]))[: 0 if block == 3 else None]
    kinds = [(keys, keys & np.uint64(255)), (np.sort(common)[: 0 if block in (3, 5) else 7], np.full(0 if block in (3, 5) else 7, block, np.uint64))]
    return [(k, n.astype(np.uint64)) for k, n in kinds]


def sent(spark, n, radix, name):
    scratch = Scratch(spark, name)
    blocks = scratch.write(spark.range(n).selectExpr("id AS block", "CAST(CAST(id AS STRING) AS BINARY) AS payload").rdd.map(lambda r: (r.block, bx.squeeze(bytes(r.payload)))).toDF(bx.BLOCKS), "blocks")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    replies, sums = bx.exchange(blocks, entries, SUM, scratch, "replies", radix)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

    def finish(block, payload, said):
        import pyarrow as pa

        own = entries(payload)
        for kind in (0, 1):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(own[kind][0]), pa.int64()), "kind": pa.array([kind] * len(own[kind][0]), pa.int64()), "key": pa.array(own[kind][0].view(np.int64)), "said": pa.array(said[kind].astype(np.int64))})

    rows = bx.answers(blocks, replies, 2, finish, "block long, kind long, key long, said long").collect()
    return rows, sums, replies


@pytest.mark.parametrize("radix", [10, 3, 2])
def test_every_block_hears_the_outcome(spark, radix):
    n = 40
    rows, sums, replies = sent(spark, n, radix, f"exchange-{radix}")
    all_of = [entries(str(b)) for b in range(n)]
    total = [Counter(), Counter()]
    for own in all_of:
        for kind in (0, 1):
            for k, x in zip(own[kind][0].tolist(), own[kind][1].tolist(), strict=True):
                total[kind][k] += x
    got = {(r.block, r.kind, r.key): r.said for r in rows}
    want = {(b, kind, int(np.uint64(k).astype(np.int64))): total[kind][k] * 1000 + x for b, own in enumerate(all_of) for kind in (0, 1) for k, x in zip(own[kind][0].tolist(), own[kind][1].tolist(), strict=True)}
    assert got == want and len(rows) == len(want)
    assert sums == {"n0": len(total[0]), "s0": sum(total[0].values()), "n1": len(total[1]), "s1": sum(total[1].values())}
    assert replies.groupBy("block").count().agg(F.max("count")).first()[0] <= 1 << max(4, radix)


def test_rows_grow_with_the_blocks(spark):
    counts = [sent(spark, n, 2, f"rows-{n}")[2].count() for n in (24, 48, 96)]
    assert counts[1] < 2.5 * counts[0] and counts[2] < 2.5 * counts[1]


def test_a_table_without_blocks(spark):
    rows, sums, _ = sent(spark, 0, 10, "no-blocks")
    assert rows == [] and sums == {}
