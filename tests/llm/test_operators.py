"""The ten operators on whole small tables and on edge cases, against brute force."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, minhash, mixing, packing, perplexity, quality, queries, revisits, sharding, topk, toxicity, url_trust

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, label int, `group` int, u int"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    same = "The quick brown fox jumps over the lazy dog again and again until the evening comes to the quiet town by the river"
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "no id here", "en", "a", 1), (None, same, "en", "b", 1),
        (5, LONG, "en", "a", len(LONG)), (6, "  \n\t ", "de", "b", 5), (7, "x", "de", "b", 1), (8, same + " extra", "en", "a", 2), (9, "éà €😀 <|endoftext|> ok", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, 0.5, "no", 1, 7, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (8, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Packing


def packed_ok(rows, limit=1024):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and 0 < length <= limit
            at += length
        assert at <= limit
    return len(bins)


def test_pack_all_documents(spark, sf):
    from tokenizers import Tokenizer

    docs = collected(queries.read(spark, sf, "documents"))
    rows = collected(queries.op1_pack(spark, sf))
    bins = packed_ok(rows)
    total = sum(r["length"] for r in rows)
    assert bins <= math.ceil(total / 1024) * 1.03 + 2
    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(by) == len(docs)
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert len(own) == p["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]
        assert all(p["length"] == 1024 for p in pieces[1:])


def test_pack_edge_cases(spark, odd, none):
    rows = collected(packing.pack_documents(odd))
    packed_ok(rows)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack_documents(none).count() == 0
    ids = {(r["doc_id"], r["piece"]): r["ids"] for r in collected(packing.token_pieces(odd))}
    assert 50256 in ids[9, 0] and ids[9, 0][-1] == 2


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 3, 3, 2])
    bins = [[0, 3], [1, 4], [2, 5]]  # 9, 9 and 6 of 12
    out = packing.local_search(bins, lengths, 12)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6)) and all(lengths[b].sum() <= 12 for b in out)
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)]


def test_local_search_packs_middle_sizes_tighter():
    lengths = np.random.default_rng(1).integers(250, 601, 3000)
    first = packing.best_fit_decreasing(lengths, 1024)
    out = packing.local_search(first, lengths, 1024)
    assert sorted(i for b in out for i in b) == list(range(3000)) and all(lengths[b].sum() <= 1024 for b in out)
    assert len(out) < 0.98 * len(first) and len(out) >= lengths.sum() / 1024
    assert len(packing.local_search(out, lengths, 1024)) == len(out)


# Classifiers


def held_out_scores(spark, rows, sf, label):
    marks = {r["doc_id"]: r[label] for r in collected(queries.read(spark, sf, "labels"))}
    return [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = collected(queries.op2_toxicity(spark, sf))
    pairs = held_out_scores(spark, rows, sf, "toxic")
    assert auc(pairs) > 0.96 and sum((s >= 0.3) == y for s, y in pairs) / len(pairs) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = collected(queries.op4_quality(spark, sf))
    pairs = held_out_scores(spark, rows, sf, "quality")
    assert auc(pairs) > 0.97 and sum((s >= 0.3) == y for s, y in pairs) / len(pairs) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("make", [toxicity.toxicity, quality.quality])
def test_classifier_edge_cases(spark, odd, none, marks, make):
    rows = collected(make(odd, marks))
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["doc_id"] is None and not r["held_out"] for r in rows) == 2
    assert make(none, marks).count() == 0
    assert {round(r["score"], 6) for r in collected(make(odd, marks.limit(0)))} == {0.5}


def test_forest_walk_is_the_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = quality.fit_forest(x, y, quality.TreeOptions(trees=30))
    p = quality.forest_scores(f, x)
    assert ((p > 0.5) == y).mean() > 0.95

    def one(row):
        z = f.start
        for feat, cut, leaf in zip(f.feature, f.threshold, f.leaf, strict=True):
            k = 0
            while k < len(feat):
                k = 2 * k + (2 if row[feat[k]] > cut[k] else 1)
            z += leaf[k - len(feat)]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(p[:50], [one(r) for r in x[:50]])


# Top-k


def brute_top_k(rows, k=5):
    terms = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in terms:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(terms[q], v, strict=False)), i) for i, v in terms.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in collected(queries.read(spark, sf, "embeddings"))]
    got = {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in collected(queries.op3_top_k(spark, sf))}
    assert got == brute_top_k(rows)
    few = topk.exact_top_k(queries.read(spark, sf, "embeddings"), lambda i: i % 50 == 0, block_rows=60, block_queries=3)
    assert {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in collected(few)} == got


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, terms int")
    got = {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in collected(topk.exact_top_k(df, lambda i: i % 50 == 0))}
    assert got == brute_top_k([r for r in rows if r[0] is not None])
    assert topk.exact_top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


# URL filter


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "http://x.example.com/de/", "http://k.net/es/1", "http://k.net/en/1", "no url", None, "ftp://org.org", "http://b.net/fr/", "http://com", "http://com/"]
    df = spark.createDataFrame([(i, u, None, "mine", "rule") for i, u in enumerate(urls)], "page_id int, url string, html string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in collected(url_trust.filter_urls(df, queries.RULES))}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4] == ("k.net", "/en/1", None, "allow")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7] == ("org.org", "", None, "allow") and got[8][2] == "net/fr/" and got[9][2] is None and got[10][2] == "com/"
    assert url_trust.filter_urls(df.limit(0), queries.RULES).count() == 0


def test_propagation_is_pagerank(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "bad", 3), ("d", "a", 1), ("bad", "d", 1)]
    seeds = [("a", 1, 0), ("bad", 0, 1)]
    got = {r["host"]: r for r in collected(url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, good int, bad int"), rounds=40, tolerance=1e-5))}
    hosts = sorted({h for e in edges for h in e[:2]})
    out = collections.Counter()
    for s, _, n in edges:
        out[s] += n
    t, b = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    for _ in range(300):
        nt, nb = {h: 0.15 * (h == "a") for h in hosts}, {h: 0.15 * (h == "bad") for h in hosts}
        for s, d, n in edges:
            nt[d] += 0.85 * t[s] * n / out[s]
            nb[s] += 0.85 * b[d] * n / out[s]
        t, b = nt, nb
    assert all(abs(got[h]["trust"] - t[h]) < 1e-3 and abs(got[h]["distrust"] - b[h]) < 1e-3 for h in hosts)


def test_linked_hosts_are_blocked(spark):
    page = lambda i, u, *to: (i, u, "".join(f'<a href="{t}">x</a>' for t in to))
    rows = [page(1, "http://bad.net/fr/1"), page(2, "http://farm.org/1", "http://bad.net/fr/1"), page(3, "http://good.com/1", "//friend.org/x"), page(4, "http://friend.org/2")]
    got = {r["page_id"]: r["verdict"] for r in collected(url_trust.filter_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), queries.RULES))}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


@pytest.mark.parametrize("linkers", [3, 100, 10_000])
def test_linkers_are_blocked_however_many(spark, linkers):
    """All links to a blocked host: block. Half of them: block. One in twenty, or none: allow. A host before it: block."""
    link = lambda i, host, *to: (i, f"http://{host}/", "".join(f'<a href="http://{t}/">x</a>' for t in to))
    rows = [link(i, f"farm{i}.org", "bad.net/fr") for i in range(linkers)]
    rows += [link(-1, "half.org", "bad.net/fr", "a.org"), link(-2, "twentieth.org", "bad.net/fr", *["a.org"] * 19), link(-3, "a.org", "b.org"), link(-4, "before.org", "farm1.org"), link(-5, "bad.net/fr")]
    got = {r["page_id"]: r["verdict"] for r in collected(url_trust.filter_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), queries.RULES))}
    assert got == dict.fromkeys(range(linkers), "block") | {-1: "block", -2: "allow", -3: "allow", -4: "block", -5: "block"}


# Quality rules


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules_all_documents(spark, sf):
    docs = {r["doc_id"]: r for r in collected(queries.read(spark, sf, "documents"))}
    rows = collected(queries.op6_quality_rules(spark, sf))
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_rules(docs[r["doc_id"]]["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    clean = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in clean) > 0.97 * len(clean)


def test_rules_edge_cases(spark, odd, none):
    rows = collected(perplexity.quality_rules(odd))
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["doc_id"] in (3, 4, 6, 7))
    assert next(r for r in rows if r["doc_id"] == 5)["n_repeat_words"] == 30_000
    assert perplexity.quality_rules(none).count() == 0


def test_model_is_kneser_ney(spark):
    texts = ["abracadabra abra", "banana bandana", "abba banana"]
    model = perplexity.fit(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string"), order=3)
    gram = lambda s: np.array([int.from_bytes(s, "big")], np.uint64)
    counts = collections.Counter()
    for t in texts:
        b = b"\0\0" + t.encode()
        counts.update(b[i : i + 3] for i in range(len(b) - 2))
    tables = {3: counts}
    for n in (2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        t = tables[n]
        k = [sum(c == j for c in t.values()) for j in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else None
        d = [max(0.05, min(j * 0.95, j - (j + 1) * y * k[j] / k[j - 1] if y is not None and k[j - 1] else j * 0.5)) for j in (1, 2, 3)]
        own = {h: c for h, c in t.items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        gamma = sum(d[min(c, 3) - 1] for c in own.values()) / total
        c = t[g]
        return max(c - d[min(c, 3) - 1], 0) / total * (c > 0) + gamma * p(g[1:])

    for g in (b"abr", b"ana", b"\0\0a", b"abz", b"zzz", b"nab"):
        assert abs(perplexity.log_probabilities(model, "xx", gram(g))[0] - math.log(p(g))) < 1e-4


def test_model_holds_every_gram_apart(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    model = perplexity.fit(docs)
    unseen = np.random.default_rng(3).integers(0xF8, 0x100, (200_000, 5)).astype(np.uint64)  # bytes that no UTF-8 text has
    unseen = np.unique(sum(unseen[:, j] << np.uint64(8 * j) for j in range(5)))
    assert not any(perplexity._found(model, lang, kind, unseen)[1].any() for lang in ("en", "de") for kind in (5, -4))
    of_all = collections.defaultdict(set)
    for r in docs.collect():
        data = b"\0" * 4 + (r["text"] or "").encode()
        of_all[r["lang"] or ""].update(data[i : i + 5] for i in range(len(data) - 4))
    for lang, seen in of_all.items():
        assert perplexity._found(model, lang, 5, np.array([int.from_bytes(g, "big") for g in seen], np.uint64))[1].all()


@pytest.fixture(scope="module")
def planted(spark):
    """Verdicts on the documents of sf0.01 with shuffled, random and wrong-language texts planted among the English."""
    docs = collected(queries.read(spark, "/root/testdata/sf0.01", "documents"))
    clean = {r["doc_id"]: r for r in perplexity.quality_rules(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string")).where("kept").collect()}
    words = lambda lang: " ".join(r["text"] for r in docs if r["lang"] == lang and r["doc_id"] in clean).split()
    rng, rows = np.random.default_rng(7), []
    for other in sorted({r["lang"] for r in docs} - {"en", None}):
        rows += [(f"{other} as en", n, " ".join(words(other)[n : 2 * n])) for n in (60, 150, 500)]
    for n in (25, 60, 150, 500):
        text = list(" ".join(words("en")[n : 2 * n]))
        rng.shuffle(text)
        rows.append(("shuffled", n, "".join(text)))
        rows.append(("random", n, " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(n))))
    table = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(-k, t, "en") for k, (_, _, t) in enumerate(rows, 1)]
    verdicts = {r["doc_id"]: r for r in collected(perplexity.quality_rules(spark.createDataFrame(table, "doc_id long, text string, lang string")))}
    return [(*row[:2], verdicts[-k]) for k, row in enumerate(rows, 1)], [r for i, r in verdicts.items() if i > 0 and not r["base_failed"]]


def test_planted_garbage_is_rejected(planted):
    garbage, others = planted
    wrong = [(kind, n, round(r["log_perplexity"], 2)) for kind, n, r in garbage if r["kept"]]
    assert not wrong and sum(r["kept"] for r in others) > 0.95 * len(others)


# Near-duplicates


def brute_components(docs, size, percent):
    sets, ids = {}, sorted(d for d, _ in docs)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_all_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in collected(queries.read(spark, sf, "documents"))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(queries.op7_near_duplicates(spark, sf))}
    assert got == brute_components(docs, 2, 80)


def test_near_duplicates_of_a_large_group(spark):
    """Random edits of one text, many of them on either side of the threshold; stars stay open and must be settled."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(260):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 14), replace=False):
            w[j] = f"e{rng.integers(0, 40)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(docs[i][1].split()[:-3])) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2))}
    assert got == brute_components(docs, 2, 80)


def test_near_duplicates_edge_cases(spark, odd, none):
    rows = collected(minhash.near_duplicates(odd, shingle_words=2))
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 == by[8]["component_id"] and not by[2]["kept"] and by[1]["kept"]
    assert [by[i]["n_shingles"] for i in (3, 4, 6, 7)] == [0, 0, 0, 1] and all(by[i]["component_id"] == i for i in (3, 4, 6, 7))
    assert minhash.near_duplicates(none).count() == 0
    kept = collected(minhash.keep_one_of_each_group(odd, shingle_words=2))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 9]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here"]  # the other one is a copy of 1
    assert [c for c in minhash.keep_one_of_each_group(odd).columns] == odd.columns


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    words = lambda stem, n=45: [f"{stem}{i}" for i in range(n)]
    edited = lambda w: " ".join([*w[:-1], "edit"])
    one, two, three = words("a"), words("b"), words("c")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, edited(one)), (7, edited(two)), (None, " ".join(three)), (None, edited(three)), (None, " ".join(one)), (8, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(df, shingle_words=2)))
    assert got == {(5, 5, True): 2, (6, 5, False): 1, (7, 5, False): 1, (None, None, True): 4, (None, 5, False): 1, (8, 8, True): 1}
    kept = collections.Counter(r["doc_id"] for r in collected(minhash.keep_one_of_each_group(df, shingle_words=2)))
    assert kept == {5: 1, None: 3, 8: 1}


def test_near_duplicates_of_groups_within_groups(spark, monkeypatch):
    """Small blocks and few spokes a copy: groups are settled by stars of stars, whose centres are copied."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SPOKES", 50)
    rng = np.random.default_rng(5)
    docs = []
    for i in range(420):
        w = [f"w{j}" for j in range(60)]
        for j in rng.choice(60, rng.integers(0, 13), replace=False):
            w[j] = f"e{rng.integers(0, 6)}"
        docs.append((i, " ".join([*w, "same end"] if i else w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2))}
    assert got == brute_components(docs, 2, 80)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["id"], r["label"]) for r in collected(minhash.components(links))} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# Sharding and mixing


def test_shards(spark, sf):
    docs = {r["doc_id"]: r for r in collected(queries.read(spark, sf, "documents"))}
    rows = collected(queries.op8_shards(spark, sf))
    assert len(rows) == len(docs)
    slots, mix = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in rows:
        d = docs[r["doc_id"]]
        slots[r["shard"]].append(r["slot"])
        mix[d["source"]][r["shard"]] += 1
        data = (d["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for counts in mix.values():
        assert all(abs(counts[i] - counts.total() / 16) <= 2 for i in range(16))


def test_shards_edge_cases(spark, odd, none):
    rows = collected(sharding.shard_rows(odd, shards=4, bucket_rows=3))
    assert len(rows) == odd.count() and sorted(collections.Counter(r["shard"] for r in rows).values()) == [3, 3, 3, 3]
    assert sharding.shard_rows(none).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    assert [r["count"] for r in collected(spark.read.parquet(f"file://{tmp_path}/out").groupBy("shard").count())] == [10] * 4


def test_written_shards_keep_every_row(spark, odd, tmp_path):
    sharding.write_shards(odd, f"file://{tmp_path}/out", shards=4, bucket_rows=3)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    rows = lambda df: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in collected(df))
    assert rows(got) == rows(odd) and [r["count"] for r in collected(got.groupBy("shard").count())] == [3] * 4


def test_mix_rates(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    out = mixing.mix_sources(docs, weights={"big": 0.25, "small": 0.75}, total=12_000)
    n = {r["source"]: r["count"] for r in collected(out.groupBy("source").count())}
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 9000) < 400
    copies = collections.Counter(collections.Counter(r["doc_id"] for r in collected(out.where("source = 'small'"))).values())
    assert all(abs(copies[k] / 5000 - math.exp(-1.8) * 1.8**k / math.factorial(k)) < 0.03 for k in range(1, 6))
    assert collected(out) == collected(mixing.mix_sources(docs.repartition(7), weights={"big": 0.25, "small": 0.75}, total=12_000))


def test_mix_edge_cases(spark, odd, none):
    out = collected(mixing.mix_sources(odd.withColumn("mix_key", F.lit("mine"))))
    assert {r["mix_copy"] for r in out} <= set(range(1, 30)) and {"score", "label", "u"} <= set(out[0])
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(odd, weights={"zzz": 1.0}).count() == 0


# Revisits


def test_revisits_all_pages(spark, sf):
    pages = queries.read(spark, sf, "pages")
    records = [r.asDict(recursive=True) for r in queries.captures(pages).withColumn("key", revisits.canonical_url(F.col("url"))).collect()]
    got = {r["record_id"]: r for r in collected(queries.op10_revisits(spark, sf))}
    assert len(got) == len(records) == 3 * pages.count()
    value = lambda r, name: next((h["value"] for h in r["headers"] if h["name"].lower() == name), None)
    seen = collections.Counter()
    for r in records:
        g = got[r["record_id"]]
        seen[g["outcome"]] += 1
        if r["kind"] == "response":
            assert g["outcome"] == "full"
            continue
        before = [o for o in records if o["kind"] == "response" and o["key"] == r["key"] and o["at"] < r["at"]]
        if not before:
            assert g["outcome"] == "no_earlier_response"
            continue
        last = max(before, key=lambda o: (o["at"], o["record_id"]))
        tag, since = value(r, "etag"), value(r, "last-modified")
        agree = tag.removeprefix("W/") == value(last, "etag") if tag else since == value(last, "last-modified")
        assert g["outcome"] == ("resolved" if agree else "validator_mismatch")
        if agree:
            assert g["source_record_id"] == last["record_id"] and g["status"] == 200 and g["digest"] == last["digest"]
            lines = dict(x.split(": ", 1) for x in g["headers"].split("\n"))
            assert lines["content-length"] == value(last, "content-length") and (not tag or lines["cache-control"] == "max-age=90")
    assert min(seen[k] for k in ("full", "resolved", "no_earlier_response", "validator_mismatch")) > 0


def test_revisits_edge_cases(spark):
    h = lambda *pairs: [{"name": a, "value": b} for a, b in pairs]
    rows = [
        (1, "http://www.a.org/x/", 100, "response", 200, h(("ETag", "1")), "d1"), (2, "https://A.org/x#f", 100, "response", 200, h(("ETag", "2")), "d2"), (3, "http://a.org/x", 100, "revisit", 304, h(("ETag", "2")), None),
        (4, "http://a.org/x", 9999999, "revisit", 304, h(("etag ", " 2"), ("Content-Type", "no"), ("X", "y")), None), (5, "http://a.org/x", 200, "revisit", 304, None, None), (6, None, 200, "revisit", 304, None, "d"), (7, "http://a.org/x", None, "revisit", 304, None, "d"),
        (8, "http://a.org/x", 200, "revisit", 304, None, "d2"), (8, "http://a.org/x", 200, "revisit", 304, None, "d2"), (9, "http://a.org/x", 150, "response", 404, None, None), (10, "http://a.org/x?q", 300, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "record_id long, url string, at long, kind string, status int, headers array<struct<name:string,value:string>>, digest string, found string")
    got = collections.defaultdict(list)
    for r in collected(revisits.resolve_revisits(df)):
        got[r["record_id"]].append(r)
    say = {k: v[0]["outcome"] for k, v in got.items()}
    assert say == {1: "full", 2: "full", 3: "no_earlier_response", 4: "resolved", 5: "no_validator", 6: "invalid", 7: "invalid", 8: "resolved", 9: "other", 10: "other"}
    assert len(got[8]) == 2 and got[4][0]["source_record_id"] == 2 and got[4][0]["headers"] == [{"name": "etag", "value": "2"}, {"name": "x", "value": "y"}]
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
    paid = collected(revisits.with_payloads(revisits.resolve_revisits(df), spark.createDataFrame([(2, "body")], "record_id long, payload string")))
    assert {r["record_id"] for r in paid if r["payload"] == "body"} == {2, 4, 8}


def test_words_are_ascii_split():
    assert common.words_of("A b \x0bC\x1cd", lower=True) == ["a b".encode(), b"c\x1cd"]
