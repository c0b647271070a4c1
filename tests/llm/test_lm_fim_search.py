"""Language-model scores, fill-in-middle and ranked search on whole small tables and odd rows, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import automaton, fim, queries, search

DOCS = "doc_id long, text string, score double, n long, part int, row string, item int, units string"
SAME = "The quick brown fox\njumps over the lazy dog\n\nagain and again"
ROWS = [
    (1, SAME), (2, SAME), (2, SAME), (3, None), (4, ""), (None, "no id here\nat all"), (None, SAME), (5, "word " * 30_000 + "end\n" + "line\n" * 3_000), (6, "  \n\t \r\n"), (7, "x"),
    (8, SAME + "\nThe fox"), (9, "éà €😀 <|endoftext|>  ok\n"), (10, "has <S> inside"), (11, "a <"), (12, "<P"), (20, "\n"), (21, "quick\x00fox QUICK quick"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, "no", 3, "u") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


# Language-model scores


def brute_scores(rows, held, order, masses):
    """The recursive definition of the smoothed probabilities, over dictionaries of counts."""
    texts = [[b" begin", *words(t), b" end"] for _, t in rows]
    count = collections.Counter(tuple(t[i : i + n]) for t, h in zip(texts, held, strict=True) if not h for n in range(1, order + 1) for i in range(len(t) - n + 1))
    ones = {k[0]: c for k, c in count.items() if len(k) == 1 and k != (b" begin",)}
    total, distinct = sum(ones.values()), len(ones)
    n1, n2 = (sum(c == k for c in ones.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))

    def p(history, word):
        if not history:
            return (ones[word] - discount) / total if word in ones else discount * distinct / total if total else 1.0
        if not count[history]:
            return p(history[1:], word)
        m = masses[min(len(history), len(masses)) - 1]
        return (count[(*history, word)] + m * p(history[1:], word)) / (count[history] + m)

    out = []
    for t in texts:
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        base = sum(math.log10((ones.get(w, 0) + 1) / (total + distinct + 1)) for w in t[1:])
        out.append((len(t) - 1, sum(w in ones for w in t[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 50, 1 << 21])
def test_scores_of_odd_rows(spark, odd, order, block, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK_TOKENS", block)
    held = [i is not None and i % 3 == 1 for i, _ in ROWS]
    got = automaton.score_texts(odd.repartition(3, "doc_id"), F.col("doc_id") % 3 == 1, order, (2.0, 5.0)).toPandas()
    want = pd.DataFrame(brute_scores(ROWS, held, order, (2.0, 5.0)), columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    want["doc_id"], want["held_out"] = pd.array([i for i, _ in ROWS], "Int64"), held
    key = ["n_tokens", "base_score", "doc_id"]
    got, want = (x.round(9).sort_values(key).reset_index(drop=True) for x in (got, want))
    assert got["doc_id"].fillna(-1).tolist() == want["doc_id"].fillna(-1).tolist() and got["held_out"].tolist() == want["held_out"].tolist()
    for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9), c


def test_scores_of_all_documents(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    want = {i: (h, *w) for (i, _), h, w in zip(rows, held, brute_scores(rows, held, 2, automaton.MASSES), strict=True)}
    got = {r[0]: tuple(r[1:]) for r in queries.op11_lm_scores(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (h, n, known, total, base, score) in want.items():
        assert got[i][:4] == (h, n, known, total) and np.allclose(got[i][4:], (base, score), rtol=1e-9)
    unseen = [i for i, h in zip(want, held, strict=True) if h]
    assert sum(got[i][5] for i in unseen) > sum(got[i][4] for i in unseen)  # better than single words


def test_probabilities_add_up_to_one(spark):
    rows = [(1, "a b a c"), (2, "b a"), (3, "c"), (4, "a b c a b")]
    heads = ["a", "b", "c", "a b", "z", ""]
    probes = [(10 + i, f"{h} {w}".strip()) for i, (h, w) in enumerate((h, w) for h in heads for w in ("a", "b", "c", "unknown", ""))]
    df = spark.createDataFrame(rows + probes, "doc_id long, text string")
    at = {r["doc_id"]: r["score"] for r in automaton.score_texts(df, F.col("doc_id") >= 10, 3, (2.0, 3.0)).collect()}
    ends = {h: 10 ** at[10 + 5 * i + 4] for i, h in enumerate(heads)}  # p(head) p(end | head)
    for h, i in zip(heads, range(len(heads)), strict=True):
        if h:
            continue
        # From the start: the four words, and the end alone.
        firsts = brute_scores([*rows, *[(0, w) for w in ("a", "b", "c", "unknown")]], [False] * 4 + [True] * 4, 3, (2.0, 3.0))
        assert np.allclose([at[10 + 5 * i + k] for k in range(4)], [f[4] for f in firsts[4:]])
    model = lambda text: brute_scores([*rows, (0, text)], [False] * 4 + [True], 3, (2.0, 3.0))[-1][4]
    assert all(np.isclose(math.log10(ends[h]), model(h)) for h in heads)
    every = [t for n in range(1, 3) for t in __import__("itertools").product("abcz", repeat=n)]
    begun = {(): 1.0} | {t: sum(10 ** model(" ".join((*t, *u))) for u in [()]) for t in every}
    assert sum(begun[t] for t in every) + 10 ** model("") < 1.0 + 1e-9  # all texts of up to two words hold no more than everything


def test_scores_without_rows_or_training(spark, none, odd):
    assert automaton.score_texts(none, F.lit(False)).collect() == []
    rows = automaton.score_texts(odd, F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r["score"] == r["base_score"] == r["n_known"] == r["train_tokens"] == 0 for r in rows)


@given(st.lists(st.integers(0, 2**64 - 1)))
@settings(max_examples=50, deadline=None)
def test_packed(values):
    a = np.array(values, np.uint64)
    assert (automaton.unpacked(automaton.packed(a), np.uint64) == a).all()


# Fill-in-middle


def brute_fim(i, text, seed="7", percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", a, b, c, f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", a, b, c, f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("percent", [0, 40, 100])
def test_fim_of_odd_rows(odd, percent):
    made = fim.fill_in_middle(odd, percent=percent)
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(map(repr, (tuple(r) for r in back.collect())))
    assert got == sorted(repr((i, *brute_fim(i, t, percent=percent), t or "")) for i, t in ROWS)


def test_fim_of_all_documents(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        n, form, a, b, _, out = brute_fim(i, t)
        want.add((i, n, form, a if a is None else len(a), b if b is None else len(b), sha(out), sha(t or "")))
    df = queries.op12_fill_in_middle(spark, sf)
    assert {tuple(r) for r in df.collect()} == want and len({w[2] for w in want}) >= 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_fim_of_no_rows_and_unfit_sentinels(none):
    assert fim.fill_in_middle(none).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<PP>>", ">x"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(none, marks=fim.Sentinels(*marks))


# Ranked search


def brute_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(rows, items, k):
    """Scores of all documents, sorted."""
    docs = [(i, collections.Counter(brute_terms(t))) for i, t in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = collections.Counter(t for d in docs for t in d[1])
    out = []
    for item, text in items:
        found = []
        for i, c, size in docs:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


ITEMS = [(1, "the FOX"), (2, "quick quick brown, lazy-dog"), (3, None), (4, ""), (5, "nowhere"), (1, "again"), (None, "word end line"), (6, "x 😀 éà no id here at all " * 40)]


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("terms", [4, 200_000])
def test_search_of_odd_rows(spark, odd, monkeypatch, k, terms):
    monkeypatch.setattr(search, "QUERY_TERMS", terms)
    monkeypatch.setattr(search, "SEGMENT_POSTINGS", 9)
    monkeypatch.setattr(search, "ROUNDS", 1)
    items = spark.createDataFrame([(*i, 5, "x") for i in ITEMS], "item_id long, text string, doc_id long, term string")
    got = search.ranked_search(odd.repartition(3), items, k).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute_search(ROWS, ITEMS, k)))


def test_search_of_no_rows(spark, none, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked_search(none, items).collect() == [] and search.ranked_search(odd, items.limit(0)).collect() == []


@given(st.integers(0, 10**6), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_threshold_search_equals_all_scores_and_stops_early(seed, k):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 400)), 8
    own = [np.flatnonzero(rng.random(width) < 0.4) for _ in range(n)]
    rows = pd.DataFrame({"row": range(n), "doc_id": pd.array(rng.integers(0, 50, n), "Int64"), "n": rng.integers(8, 60, n), "terms": own, "tf": [rng.integers(1, 4, len(x)) for x in own]})
    weights = rng.integers(0, 5000, width)
    s = search.Segment(rows, weights, n, int(rows["n"].sum()))
    terms = np.flatnonzero(rng.random(width) < 0.6)
    every = s.scores(np.arange(n), terms) if len(s.keys) and len(terms) else np.zeros(n, np.int64)
    order = [i for i in np.lexsort((np.arange(n), -every)) if every[i] > 0][:k]
    found, scores, read = s.search(terms, k)
    assert found.tolist() == order and scores.tolist() == every[order].tolist() and read <= len(s.keys)
    least = int(np.median(every))
    assert s.search(terms, k, least)[0].tolist() == [i for i in order if every[i] >= least]


def test_threshold_stops_before_the_lists_end():
    n = 5_000
    rows = pd.DataFrame({"row": range(n), "doc_id": pd.array(range(n), "Int64"), "n": np.arange(n) + 2, "terms": [np.arange(2)] * n, "tf": [np.ones(2, np.int64)] * n})
    s = search.Segment(rows, np.array([1000, 2000]), n, int(rows["n"].sum()))
    found, _, read = s.search(np.array([0, 1]), 10)
    assert found.tolist() == list(range(10)) and read < 500


def test_impacts_beyond_64_bits():
    got = search.impacts(np.array([7]), np.array([3]), np.array([10**9]), 10**12, 10**15)
    assert got.tolist() == [7 * (3 * 10**9 // (3000 + 20 * (50 + 50 * 10**9 * 10**12 // 10**15)))]
