"""MinHash near-duplicates with tensored banding.

Every text gets ``collections`` small keys of ``half`` minhashes each. A table of the banding is a pair of collections,
so ``collections * half`` minhashes serve ``collections * (collections - 1) / 2`` tables of ``2 * half`` minhashes: about
a square root of the work of independent tables. Two texts share a table bucket exactly if at least two of their small
keys agree, so a text's small keys that no other text has are dropped before any pair is formed; nothing is lost by it.

Texts with equal shingle sets are one class, so copies never meet as pairs. A bucket is compared as a star: each member
with the centre, the member whose small keys the most texts share (so near the middle of its group); all pairs of a
bucket are never formed. What that leaves are pairs of one bucket that the links found so far do not connect. In buckets
of up to ``BLOCK`` such texts they are compared one by one. Components with a larger one are stars again, all of their
buckets together, and links of members that are not similar to the star's centre c are found exactly, by differences from it: with D(x) the
elements in one of x and c only, |D(x) & D(y)| = (|D(x)| + |D(y)| - |x ^ y|) / 2, a similar pair has
|x ^ y| <= k (|x| + |y|) with k = (100 - p) / (100 + p), and so D(x) and D(y) share an element among their first few in
any common order (the prefix principle). The order is the star's rarest elements first, so that few texts meet; those that
share an element, and are not connected already, are compared. No cap drops a comparison, and all candidates are
confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, materialize, mix, small_batches, window_hashes, word_hashes, words_of

_seen = WordHashes()
#: Texts of a group that are compared one by one, so that a group's comparisons are linear in its texts.
BLOCK = 16
#: Members of a star that are joined with one copy of their centre's set; larger stars get more copies.
SPOKES = 10_000
#: Stars up to which a list of them is broadcast, its length being checked; beyond it, it is joined by shuffle.
BROADCAST_STARS = 100_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased."""
    return np.unique(window_hashes(word_hashes(words_of(text, lower=True), _seen), size))


def minhash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of the family's functions over the shingles."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        out = np.minimum(out, (a[:, None] * low[None, i : i + 1024] + b[:, None]).min(axis=1))
    return out


def collection_keys(values: np.ndarray, half: int) -> np.ndarray:
    """One 64-bit key for each collection of ``half`` minhashes; a collection's number is part of its key."""
    rows = values.reshape(-1, half).astype(U64)
    out = mix(np.arange(1, len(rows) + 1, dtype=U64))
    for j in range(half):
        out = mix(out * U64(0x9E3779B97F4A7C15) + rows[:, j])
    return out.view(np.int64)


def _signatures(size: int, collections: int, half: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = minhash_family(collections * half, seed)
        for rows in batches:
            out = []
            for text in rows["nd_text"]:
                s = shingle_set(text, size)
                out.append((len(s), *((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), collection_keys(minhashes(s, a, b), half)) if len(s) else (None, None))))
            found = pd.DataFrame(out, columns=["nd_n", "nd_class", "nd_keys"])
            yield pd.concat([rows[["nd_row", "nd_id"]].reset_index(drop=True).astype({"nd_id": "Int64"}), found], axis=1)

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"nd_key": rows["nd_row"], "nd_set": [shingle_set(t, size).tobytes() for t in rows["nd_text"]]})

    return run


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.intersect1d(p, q, assume_unique=True)


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["set_a"], rows["set_b"], strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(_shared(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield rows.loc[keep, ["a", "b"]]

    return run


def _linked(percent: int):
    """Of both ends of an edge: whether they are linked, and the size of ``b``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for x, y in zip(rows["set_a"], rows["set_b"], strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(_shared(p, q))
                out.append((len(q), 100 * both >= percent * (len(p) + len(q) - both)))
            yield pd.concat([rows[["a", "b"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "linked"])], axis=1)

    return run


def _compare_with_centre(percent: int):
    """Of a star's centre and a member: whether they are linked, ``diff``, the elements in one of them only, and how many
    of its first elements a link of the member must share: ``reach`` with any other member (with one not linked to the
    centre, if it is linked itself), ``far_reach`` with members that the centre is not linked to either."""
    k = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for x, y in zip(rows["set_a"], rows["set_b"], strict=True):
                c, m = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(_shared(c, m))
                diff = np.setxor1d(c, m, assume_unique=True).view(np.int64)
                n = len(diff)
                half = max(1, int(np.ceil((n - k * len(m) + k * len(c)) / 2 - 1e-9)))
                most = int(k * len(m) * (1 + 100 / percent) + 1e-9)
                linked = 100 * both >= percent * (len(c) + len(m) - both)
                out.append((len(m), n, bool(linked), n - half + 1 if linked else min(n, most + 1), 0 if linked else n - max(half, n - most) + 1, diff))
            found = pd.DataFrame(out, columns=["n", "d", "linked", "reach", "far_reach", "diff"])
            yield pd.concat([rows[["star", "a", "b"]].reset_index(drop=True), found], axis=1)

    return run


_COMPARED = "star long, a long, b long, n long, d long, linked boolean, reach long, far_reach long, diff array<long>"


def _few(stars: DataFrame) -> DataFrame:
    """A written list of stars, to be broadcast if it is no longer than BROADCAST_STARS."""
    return F.broadcast(stars) if stars.count() <= BROADCAST_STARS else stars


def _with_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``edges`` with both ends' sets. An end ``a`` of many edges is not one join key: its set is copied for each SPOKES."""
    heavy = materialize(edges.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("parts")).where("parts > 1"), "minhash-large-stars")
    large = _few(heavy)
    parts = F.coalesce("parts", F.lit(1))
    left = sets.select(F.col("nd_key").alias("a"), F.col("nd_set").alias("set_a")).join(large, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = sets.select(F.col("nd_key").alias("b"), F.col("nd_set").alias("set_b"))
    dealt = edges.join(large, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    return dealt.join(left, ["a", "part"]).join(right, "b").select(*edges.columns, "set_a", "set_b")


def _open_groups(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """``grp, b, n, d, linked, near_far, label``: members of open stars that share one of the first elements
    of their differences from the centre, in groups whose members are not all connected already."""
    named = compared.join(labels.select(F.col("id").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    parts = named.select("star", "b", "n", "d", "linked", "reach", "far_reach", "label", F.explode("diff").alias("element"))
    held = parts.groupBy("star", "element").agg(F.count("*").alias("holders")).where("holders > 1")
    member = Window.partitionBy("star", "b")
    # An element of one member only is shared with none; those are the rarest, and come first.
    place = F.col("d") - F.count("*").over(member) + F.row_number().over(member.orderBy("holders", "element"))
    first = parts.join(held, ["star", "element"]).withColumn("place", place).where("place <= reach")
    entries = materialize(first.select(F.xxhash64("star", "element").alias("grp"), "b", "n", "d", "linked", (F.col("linked") | (F.col("place") <= F.col("far_reach"))).alias("near_far"), "label"), "minhash-parts")
    groups = entries.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("grp")
    return materialize(entries.join(groups, "grp"), "minhash-groups")


def _pairs(groups: DataFrame, by: str, rule: str, percent: int) -> DataFrame:
    """Pairs (a, b) of members ``by, b, n, label, ...`` of one group that are not connected, of sizes that allow a link."""
    side = lambda x: groups.select(by, *[F.col(c).alias(f"{c}_{x}") for c in groups.columns if c != by])
    close = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    met = side("x").join(side("y"), by).where("b_x < b_y and label_x <> label_y").where(close).where(rule)
    return met.select(F.col("b_x").alias("a"), F.col("b_y").alias("b")).distinct()


def _block_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) as ``_pairs`` gives them, of buckets ``bucket, b, n, label`` of at most BLOCK members. A group's members share
    many buckets, so buckets of the same members are one list, and pairs are made within lists."""
    lists = buckets.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("b", "n", "label"))).alias("held")).select("held").distinct()
    close = f"x.label <> y.label and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = f"flatten(transform(held, (x, i) -> transform(filter(slice(held, i + 2, size(held)), y -> {close}), y -> struct(x.b as a, y.b as b))))"
    found = lists.select(F.array_distinct(F.expr(pairs)).alias("pairs")).where("size(pairs) > 0").distinct()
    return found.select(F.explode("pairs").alias("p")).select("p.a", "p.b").distinct()


def _bucket_links(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From buckets ``bucket, a, b`` of a centre and a member: components of the links with centres, more links (a, b)
    between those, and stars ``star, a, b`` left to settle."""
    spokes = members.select("a", "b").distinct()
    compared = materialize(_with_sets(spokes, sets).mapInPandas(_linked(percent), "a long, b long, n long, linked boolean"), "minhash-spokes")
    labels = components(compared.where("linked").select("a", "b"))
    of = lambda end, name: labels.select(F.col("id").alias(end), F.col("label").alias(name))
    named = compared.join(of("b", "label"), "b", "left").join(of("a", "star"), "a", "left").select("a", "b", "n", F.coalesce("label", "b").alias("label"), F.coalesce("star", "a").alias("star"))
    named = materialize(named, "minhash-named")
    opened = named.join(_few(materialize(named.where("label <> star").select("star").distinct(), "minhash-open-stars")), "star")
    held = materialize(members.join(opened, ["a", "b"]), "minhash-held")
    buckets = held.groupBy("bucket").agg(F.min("star").alias("star"), F.min("a").alias("a"), F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    buckets = materialize(buckets.where("low < high").select("bucket", "star", "a", "size"), "minhash-open")
    large = buckets.where(f"size > {BLOCK}").groupBy("star", "a").agg(F.sum("size").alias("c")).groupBy("star").agg(F.max(F.struct("c", "a")).alias("m"))
    centres = _few(materialize(large.select("star", "m.a"), "minhash-centres"))
    # All members of a star with a large bucket are settled by differences, those of its small buckets too.
    small = buckets.join(centres.select("star"), "star", "left_anti").select("bucket")
    pairs = _block_pairs(held.join(small, "bucket").select("bucket", "b", "n", "label"), percent)
    found = materialize(_with_sets(pairs, sets).mapInPandas(_confirm(percent), "a long, b long"), "minhash-links")
    stars = opened.select("star", "b").distinct().join(centres, "star").where("a <> b")
    return labels, found, materialize(stars, "minhash-left")


def _labels(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, label) of the components of links between members of one bucket, from ``bucket, a, b``."""
    labels, links, spokes = _bucket_links(members, sets, percent)
    if spokes.isEmpty():
        return merged(labels, links)
    near = f"abs(d_x - d_y) * {100 + percent} <= {100 - percent} * (n_x + n_y)"  # as |x ^ y| >= ||D(x)| - |D(y)||
    compared = materialize(_with_sets(spokes, sets).mapInPandas(_compare_with_centre(percent), _COMPARED), "minhash-stars")
    labels = merged(labels, links.unionByName(compared.where("linked").select("a", "b")))
    pairs = _pairs(_open_groups(compared, labels), "grp", f"{near} and (linked_x or linked_y or (near_far_x and near_far_y))", percent)
    return merged(labels, materialize(_with_sets(pairs, sets).mapInPandas(_confirm(percent), "a long, b long"), "minhash-links-of-stars"))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Columns (id, label): the smallest id reachable over the links (a, b), for every id that has a link.

    Least labels spread along the links and each label is then replaced by its own label, so that chains shorten by
    halves; every round is written. Nothing is collected but the count of labels that changed.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("up_label"))
        new = materialize(spread.join(up, spread["label"] == up["up"], "left").select("id", "was", F.least("label", F.coalesce("up_label", "label")).alias("label")), f"{label}-{turn}")
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, label) of the components that more links (a, b) make of those of ``labels``: only the distinct links
    between components are followed, and without any ``labels`` stay."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    between = materialize(between, "labels-between")
    if between.isEmpty():
        return labels
    found = components(between)
    old = labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    return materialize(old.unionByName(found.join(labels.select("id"), "id", "left_anti")), "labels")


def _grouped(rows: DataFrame, shingle_words: int, percent: int, collections: int, half: int, seed: int) -> DataFrame:
    """``nd_row, nd_id, nd_n, nd_group, component_id`` of ``rows`` (nd_row, nd_id, nd_text), nd_row being unique.

    ``nd_group`` is a row number for each group, null for empty sets. A class of equal sets goes by its least row.
    """
    small_batches(rows.sparkSession)
    prep = materialize(rows.mapInPandas(_signatures(shingle_words, collections, half, seed), "nd_row long, nd_id long, nd_n long, nd_class binary, nd_keys array<long>"), "minhash-keys")
    classes = prep.where("nd_class is not null").groupBy("nd_class").agg(F.min(F.struct("nd_row", "nd_keys")).alias("r"), F.min("nd_id").alias("low_id"))
    classes = materialize(classes.select("nd_class", F.col("r.nd_row").alias("nd_key"), F.col("r.nd_keys").alias("nd_keys"), "low_id"), "minhash-classes")

    keys = classes.select("nd_key", F.explode("nd_keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    tables = (
        keys.join(shared, "key").groupBy("nd_key").agg(F.array_sort(F.collect_set("key")).alias("ks"), F.sum("c").alias("weight")).where("size(ks) > 1")
        .select("nd_key", "weight", F.explode(F.expr("flatten(transform(ks, (x, i) -> transform(slice(ks, i + 2, size(ks)), y -> xxhash64(x, y))))")).alias("bucket"))
    )
    tables = materialize(tables, "minhash-tables")
    central = F.max(F.struct("weight", (-F.col("nd_key")).alias("at")))
    stars = tables.groupBy("bucket").agg(F.min("nd_key").alias("low"), F.max("nd_key").alias("high"), central.alias("c")).where("low < high").select("bucket", (-F.col("c.at")).alias("a"))
    members = materialize(tables.join(stars, "bucket").where("nd_key <> a").select("bucket", "a", F.col("nd_key").alias("b")), "minhash-members")

    ends = members.select(F.col("a").alias("nd_row")).union(members.select("b")).distinct()
    texts = rows.select("nd_row", "nd_text").join(ends.hint("merge"), "nd_row")  # one shuffle of the texts, at every size
    sets = materialize(texts.mapInPandas(_sets(shingle_words), "nd_key long, nd_set binary"), "minhash-sets")
    labels = _labels(members, sets, percent)

    # An id with several texts joins their groups, as groups are of ids.
    ids = prep.where("nd_id is not null and nd_class is not null").groupBy("nd_id").agg(F.min("nd_class").alias("one"), F.max("nd_class").alias("other")).where("one <> other").select("nd_id", "one")
    texts_of = prep.join(ids, "nd_id").select("one", F.col("nd_class").alias("other")).where("one <> other").distinct()
    key = lambda name, at: classes.select(F.col("nd_class").alias(at), F.col("nd_key").alias(name))
    same_id = texts_of.join(key("a", "one"), "one").join(key("b", "other"), "other").select("a", "b")
    labels = merged(labels, same_id)

    named = materialize(classes.join(labels, classes["nd_key"] == labels["id"], "left").select("nd_class", F.coalesce("label", "nd_key").alias("nd_group"), "low_id"), "minhash-groups")
    least = named.groupBy("nd_group").agg(F.min("low_id").alias("least_id"))
    named = named.select("nd_class", "nd_group").join(least, "nd_group")
    out = prep.select("nd_row", "nd_id", "nd_n", "nd_class").join(named, "nd_class", "left")
    return out.select("nd_row", "nd_id", "nd_n", "nd_group", F.when(F.col("nd_group").isNull(), F.col("nd_id")).otherwise(F.col("least_id")).alias("component_id"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """``docs`` with a number for each row, written, so that a row is told from others whatever its id."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("nd_row"), F.col(id_col).cast("long").alias("nd_id"), F.col(text_col).alias("nd_text"), *[F.col(c).alias(f"nd_own_{i}") for i, c in enumerate(others)]), "minhash-rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, collections: int = 28, half: int = 4, seed: int = 7) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links, a link being two texts whose sets of word shingles have
    ``100 * intersection >= percent * union``. At similarity 0.8 the default banding misses one link in 130,000.
    ``shingle_words`` is five unless a caller's contract says otherwise.

    Null and wordless texts have an empty set and are linked with nothing; a text shorter than a shingle is one shingle.
    Rows of one id share its component, with equal texts or different ones, and are each returned. Rows without an id
    are linked like others: they are kept only where no row of their component has an id, ``component_id`` being null.
    Other columns are ignored, whatever their names; an empty table gives none.
    """
    found = _grouped(_numbered(docs, id_col, text_col), shingle_words, percent, collections, half, seed)
    return found.select(F.col("nd_id").alias("doc_id"), F.col("nd_n").alias("n_shingles"), "component_id", F.col("nd_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, collections: int = 28, half: int = 4, seed: int = 7) -> DataFrame:
    """One row of ``docs`` for each group of near_duplicates: one with the smallest id; rows with empty sets all stay."""
    others = [c for c in docs.columns if c != text_col]
    rows = _numbered(docs, id_col, text_col, *others)
    found = materialize(_grouped(rows, shingle_words, percent, collections, half, seed).select("nd_row", "nd_id", "nd_group"), "minhash-verdicts")
    first = found.where("nd_group is not null").groupBy("nd_group").agg(F.min(F.struct(F.col("nd_id").isNull().alias("last"), "nd_id", "nd_row")).alias("one"))
    kept = found.where("nd_group is null").select("nd_row").union(first.select("one.nd_row"))
    return rows.join(kept, "nd_row", "left_semi").select(*[F.col("nd_text" if c == text_col else f"nd_own_{others.index(c)}").alias(c) for c in docs.columns])
