"""Classifiers and sharding against plain twins: n-grams, log-count ratios, the fit, statistics, split search, interleaving order."""

from __future__ import annotations

import collections
import hashlib
import math
import statistics as st
import zlib

import numpy as np
import pandas as pd

from gleanery.llm import quality, sharding, toxicity

MASK = (1 << 64) - 1


def plain_buckets(text, options):
    """The n-grams as strings, each hashed by itself in Python integers."""
    out = set()
    padded = f" {text.lower()} " if text else ""
    for size in options.sizes:
        for i in range(len(padded) - size + 1):
            h = size
            for c in padded[i : i + size]:
                h = (h * 0x100000001B3 + ord(c)) & MASK
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
            out.add((h ^ (h >> 31)) >> (64 - options.bits))
    return out


def test_ngrams_are_distinct_whole_and_padded():
    options = toxicity.NgramOptions(bits=19)
    for text in ("", "a", "Ab", "héé €😀", "the same the same the same", "x" * 40, "word " * 20_000 + "end"):
        assert set(toxicity.ngram_buckets(text, options).tolist()) == plain_buckets(text, options)


def test_ratios_and_fit(spark):
    rng = np.random.default_rng(4)
    options = toxicity.NgramOptions(sizes=(3,), bits=16, features=25, least=2, steps=40, ridge=0.01)
    good, bad = "calm soft mild kind warm".split(), "vile foul grim mean dire".split()
    rows = [(" ".join(rng.choice(bad if label and rng.random() < 0.7 else good, 6)), label) for label in (0, 1) * 40]
    rows += [("kind calm", 0)] * 15 + [("", 1), (None, 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "t string, y int"), "t", "y", options)

    own, labels = [plain_buckets(t, options) for t, _ in rows], [y for _, y in rows]
    neg, pos = (collections.Counter(b for s, y in zip(own, labels, strict=True) if y == k for b in s) for k in (0, 1))
    n0, n1 = labels.count(0), labels.count(1)
    apart = lambda b: (pos[b] * n0 - neg[b] * n1) ** 2 / ((pos[b] + neg[b]) * (n0 + n1 - pos[b] - neg[b] + 1))
    often = [b for b in neg | pos if neg[b] + pos[b] >= options.least]
    chosen = sorted(often, key=lambda b: (-apart(b), b))[: options.features]
    ratio = log_count_ratios(pos, neg, chosen, n0, n1)
    w, bias = adam(np.array([[r * (b in s) for r, b in zip(ratio, chosen, strict=True)] for s in own]), np.array(labels, float), options)
    assert set(np.flatnonzero(model.weights)) <= set(chosen) and len(chosen) == options.features
    assert np.allclose(model.weights[chosen], w * ratio, rtol=1e-4, atol=1e-6) and math.isclose(model.bias, bias, rel_tol=1e-6)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    assert all(math.isclose(scored[i], 1 / (1 + math.exp(-(bias + sum(w[k] * ratio[k] for k, b in enumerate(chosen) if b in s)))), rel_tol=1e-4) for i, s in enumerate(own))


def log_count_ratios(pos, neg, chosen, n0, n1):
    """Of each feature: its smoothed share of the rows of class 1 over that of class 0, as a logarithm."""
    return np.array([math.log((pos[b] + 1) / (n1 + 2)) - math.log((neg[b] + 1) / (n0 + 2)) for b in chosen])


def adam(x, y, options):
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], options.ridge), 0.0)
    for step in range(1, options.steps + 1):
        p = 1 / (1 + np.exp(-full @ w))
        grad = full.T @ (p - y) / len(y) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def plain_statistics(text):
    """The document statistics, each by its definition."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return [0.0] * 22
    n, chars, lens = len(words), len(text), [len(w.encode()) for w in words]
    count = lambda chosen: sum(c in chosen for c in text) / chars
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    window = lambda k: [tuple(words[i : i + k]) for i in range(max(1, n - k + 1))]
    dup = lambda k: 1 - len(set(window(k))) / len(window(k))
    upper = [w for w in words if any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w)]
    return [
        math.log(1 + n), math.log(1 + chars), st.fmean(lens), st.pstdev(lens), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("0123456789"), count("#*$%&|<>"), count("!"), count(".,;:?"), sum(ord(c) > 127 for c in text) / chars,
        sum(w[-1] in ".,;:?" for w in words) / n, len(set(words)) / n, max(collections.Counter(words).values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), dup(2), dup(4),
        len(lines) / n, sum(x <= 3 for x in lens) / n, words.count("|") / n, len(upper) / n, sum(w[-1] in "#*$%&!|<>" for w in words) / n,
    ]


def test_statistics():
    texts = [None, "", " \n\t", "a", "One two, two. THREE | 4!", "line one\nline one\n\nline TWO? #tag $5% x&y", "éà ÉÀ €😀 naïve", "la " * 3_000 + "end", "A B C D E F G. " * 40 + "\n" + "A B C D\n" * 9, "| | <b> x!"]
    for text in texts:
        assert np.allclose(quality.statistics(text), plain_statistics(text), rtol=1e-9, atol=1e-12), text


def plain_forest(x, y, o):
    """Boosted trees by trying every cut of every statistic in every node."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, o.bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1)
    z, trees = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(o.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes, tree = {0: np.arange(len(y))}, {}
        for node in range(2**o.depth - 1):
            rows = nodes.get(node, np.arange(0))
            value = lambda at: g[at].sum() ** 2 / (h[at].sum() + o.ridge)  # noqa: B023, E731
            best = (1e-6, 0, math.inf)
            for j in range(x.shape[1]):
                for cut in cuts[j]:
                    left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(h[left].sum(), h[right].sum()) >= o.least_weight and (gain := value(left) + value(right) - value(rows)) > best[0] + 1e-9:
                        best = (gain, j, cut)
            tree[node] = best[1:]
            side = x[rows, best[1]] > best[2]
            nodes[2 * node + 1], nodes[2 * node + 2] = rows[~side], rows[side]
        first = 2**o.depth - 1
        leaves = [o.rate * g[at].sum() / (h[at].sum() + o.ridge) for at in (nodes[first + k] for k in range(first + 1))]
        for k, leaf in enumerate(leaves):
            z[nodes[first + k]] += leaf
        trees.append((tree, leaves))
    return trees, z


def test_split_search():
    rng = np.random.default_rng(9)
    options = quality.TreeOptions(trees=4, depth=3, bins=8, least_weight=1.0)
    x = np.round(rng.normal(size=(150, 4)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0) | (rng.random(150) < 0.1)).astype(float)
    forest = quality.fit_forest(x, y, options)
    trees, z = plain_forest(x, y, options)
    for (tree, leaves), feature, threshold, leaf in zip(trees, forest.feature, forest.threshold, forest.leaf, strict=True):
        split = [k for k in tree if math.isfinite(tree[k][1])]
        assert len(split) >= 3 and all(feature[k] == tree[k][0] and threshold[k] == tree[k][1] for k in split) and all(math.isinf(threshold[k]) for k in tree if k not in split)
        assert np.allclose(leaf, leaves)
    assert np.allclose(quality.forest_scores(forest, x), 1 / (1 + np.exp(-z)))


def number(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16)


def test_interleaving_order(spark, sf):
    """Ranks within each source of seeded hashes, sorted by fractional rank, cut into shards."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = []
    for i, text, source in zip(docs["doc_id"].tolist(), docs["text"].tolist(), docs["source"].tolist(), strict=True):
        data = (text or "").encode()
        crc = zlib.crc32(data)
        rows.append((f"={source}", number(29, i, crc), i, crc, len(data) + 1))
    ranked = []
    for source in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == source)
        phase = (number("29 phase", source) + 0.5) / 2.0**52
        ranked += [((k + phase) / len(own), *r) for k, r in enumerate(own)]
    total, want = len(rows), {}
    for at, r in enumerate(sorted(ranked)):
        shard = at * 16 // total
        want[r[3]] = (shard, at - -(-shard * total // 16))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(spark.read.parquet(f"{sf}/documents.parquet"), bucket_rows=37).collect()}
    assert got == want


def test_revisits_of_one_busy_url(spark):
    """A third of all captures in a few seconds of one URL: each revisit finds the latest response of an earlier second."""
    from gleanery.llm import revisits

    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        busy = i % 3 == 0
        at = 7_200 + int(rng.integers(0, 5)) if busy else int(rng.integers(0, 40_000))
        url = "http://busy.test/" if busy else f"http://h{rng.integers(0, 20)}.test/"
        response = rng.random() < 0.4
        rows.append((i, url, at, "response" if response else "revisit", 200 if response else 304, [("ETag", f"t{rng.integers(0, 2)}")], None))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers array<struct<name:string,value:string>>, digest string")
    want = {}
    for i, url, at, kind, _, headers, _ in rows:
        earlier = max(((t, r, h) for r, u, t, k, _, h, _ in rows if k == "response" and u == url and t < at), default=None)
        outcome = "full" if kind == "response" else "no_earlier_response" if earlier is None else "resolved" if earlier[2] == headers else "validator_mismatch"
        want[i] = (outcome, earlier[1] if outcome == "resolved" else None)
    got = {r["record_id"]: (r["outcome"], r["source_record_id"]) for r in revisits.resolve_revisits(df).collect()}
    assert got == want and len({w[0] for w in want.values()}) >= 3
