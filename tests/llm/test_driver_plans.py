"""What the driver plans at once: the model of the quality rules, and merges without new links."""

from __future__ import annotations

import re

from gleanery.llm import minhash, perplexity
from gleanery.llm.common import materialize


def test_model_is_read_not_computed_again(spark):
    counts = spark.createDataFrame([("x", i * 7919 % 65536, 1 + i % 5) for i in range(500)], "lang string, gram long, c long")
    model = perplexity.kneser_ney(counts, 2)
    plan = model._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search(r"Exchange|Join|Aggregate", plan)  # it had two exchanges and a join at least for each order
    kinds = {r["kind"]: r["count"] for r in model.groupBy("kind").count().collect()}
    assert set(kinds) == {2, 1, 0, -1} and kinds[0] == 1


def test_merge_without_new_links_keeps_labels(spark, monkeypatch):
    labels = materialize(spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id long, label long"), "test-labels")
    followed = []
    monkeypatch.setattr(minhash, "components", lambda links, real=minhash.components: followed.append(1) or real(links))
    rows = lambda links: {tuple(r) for r in minhash.merged(labels, spark.createDataFrame(links, "a long, b long")).collect()}
    assert rows([]) == rows([(2, 1), (5, 6)]) == {(1, 1), (2, 1), (5, 5), (6, 5)} and not followed
    assert rows([(2, 6), (9, 8)]) == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)} and len(followed) == 1
