"""The pipeline's stages each against what its operator alone decides, on a small table."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp

from gleanery.llm.common import materialize

from .test_operators import brute_components, brute_rules, packed_ok


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs.collect()
        out[f"{name}-columns"] = docs.columns
    return out


def test_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "near_dedup", "mixing", "packing"]
    assert all(steps[f"{n}-columns"] == cp.COLUMNS for n, _ in cp.STAGES[:-1])


def test_toxic_documents_go(steps, spark, sf):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    before, after = {r.doc_id for r in steps["documents"]}, {r.doc_id for r in steps["toxicity"]}
    assert after < before and len(toxic & after) <= 0.3 * len(toxic) + 1


def test_rules_hold(steps):
    for r in steps["quality_rules"]:
        n, _, _, _, repeat = brute_rules(r.text)
        assert n >= 20 and 100 * repeat <= 30 * n
    passing = [r for r in steps["toxicity"] if brute_rules(r.text)[0] >= 20 and 100 * brute_rules(r.text)[4] <= 30 * brute_rules(r.text)[0]]
    assert len(steps["quality_rules"]) >= 0.97 * len(passing)


def test_one_of_each_group_stays(steps):
    groups = brute_components([(r.doc_id, r.text) for r in steps["quality_rules"]], 5, 80)
    assert {r.doc_id for r in steps["near_dedup"]} == {c for _, c in groups.values()}


def test_mixing_repeats_whole_rows(steps):
    rows = {r.doc_id: r for r in steps["near_dedup"]}
    assert all(rows[r.doc_id] == r for r in steps["mixing"])
    assert 0.5 * len(rows) < len(steps["mixing"]) < 1.6 * len(rows)


def test_packed(steps):
    packed_ok([r.asDict() for r in steps["packing"]])
    copies = collections.Counter(r.doc_id for r in steps["mixing"])
    assert collections.Counter(r.doc_id for r in steps["packing"] if r.piece == 0) == copies


def test_stages_of_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated and missing ids, ties, clashing columns and an empty table, stage by stage."""
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    good = next(r.text for r in plain.orderBy("doc_id").collect() if 40 < brute_rules(r.text)[0] < 400 and 100 * brute_rules(r.text)[4] <= 30 * brute_rules(r.text)[0])
    odd = [(None, good, "en", "a", 1), (None, good, "en", "a", 1), (None, "x y", "en", "a", 1), (7001, good, None, None, None), (7001, "too short", "en", "a", 1), (7002, None, "en", "b", 0), (7003, "", "en", "b", 0), (7004, "word " * 30_000, "en", "b", 0)]
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema)).selectExpr("*", "1 as score", "2 as nd_row", "'x' as r_row", "0 as kept")
    calm = cp.drop_toxic(spark, docs, sf)
    kept = cp.drop_poor(spark, docs, sf).collect()
    assert calm.columns == cp.COLUMNS and calm.where("doc_id = 7002 or doc_id is null").count() >= 1
    assert all(brute_rules(r.text)[0] >= 20 and 100 * brute_rules(r.text)[4] <= 30 * brute_rules(r.text)[0] for r in kept)
    few = docs.where("doc_id is null or doc_id >= 7001")
    one = cp.drop_near_duplicates(spark, few, sf).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in one) == [(0, "x y"), (7001, good[:9]), (7002, ""), (7003, ""), (7004, "word word")]
    mixed = cp.mix(spark, few, sf)
    packed_ok([r.asDict() for r in cp.pack(spark, mixed, sf).collect()])
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
