"""Pairs of small buckets: those that a join of the buckets gives, without one."""

from __future__ import annotations

import random

import numpy as np

from gleanery.llm import minhash


def test_pairs_of_small_buckets(spark):
    pick = random.Random(5)
    rows = []
    for bucket in range(60):
        for b in pick.sample(range(40), pick.randint(2, minhash.BLOCK)):
            rows += [(k, b, 20 + b % 9, b // 3) for k in (bucket, 1000 + bucket)]
    held = spark.createDataFrame(rows, "bucket long, b long, n long, label long")
    got, want = minhash._block_pairs(held, 80), minhash._pairs(held, "bucket", "true", 80)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_star_with_a_large_bucket(spark, monkeypatch):
    """Its buckets stay a row each, whatever their members, and links of its small buckets are found by differences."""
    base = list(range(50))
    texts = {0: base + list(range(50, 100)), 31: base + list(range(9000, 9050)), 32: base + list(range(9000, 9051))}
    texts |= {i: base + list(range(100 * i, 100 * i + 50)) for i in range(1, 31)}
    sets = spark.createDataFrame([(k, bytearray(np.array(sorted(v), np.uint64).tobytes())) for k, v in texts.items()], "nd_key long, nd_set binary")
    rows = [(bucket, 0, b) for bucket in range(25) for b in range(1, 31)] + [(99, 0, 31), (99, 0, 32)]
    members = spark.createDataFrame(rows, "bucket long, a long, b long")
    counts, write = {}, minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, label: (t := write(df, label), counts.__setitem__(label, t.count()))[0])
    assert sorted(map(tuple, minhash._labels(members, sets, 80).collect())) == [(31, 31), (32, 31)]
    assert counts["minhash-open"] == 26 and counts["minhash-left"] == 32
