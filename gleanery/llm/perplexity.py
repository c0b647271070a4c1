"""Quality rules: word and line statistics, and perplexity under a modified Kneser-Ney model counted by Spark.

The model is over UTF-8 bytes, a model for each language: an n-gram of up to seven bytes is one exact 64-bit number, its
context and suffix are a shift and a mask of it, and the table of n-grams is bounded by the alphabet, not by the corpus.
Every task counts the n-grams of its texts (all texts, whole), Spark adds them up and derives continuation counts,
discounts and interpolated probabilities with DataFrame operations. They are written to the shared folder as files of
consecutive ranges of keys, sorted: 64 bits that tell (order, n-gram) exactly within a language, and the log probability
or back-off weight. The table grows with the corpus; workers map its files into memory and look up distinct n-grams, so
neither the driver nor a worker holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WordHashes, materialize, mix, shared_dir, small_batches, window_hashes, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
#: Entries of a model file, of twelve bytes each.
FILE_ENTRIES = 1 << 20
#: Bytes whose n-grams are looked up at once.
CHUNK = 1 << 20
#: Robust deviations of a band to either side, and the words at which a band is wider by the square root of two.
WIDTH, SHORT = 6.0, 200.0
#: Languages up to which their bands and discounts are broadcast; beyond it, they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
_seen = WordHashes()


@dataclass(frozen=True)
class ByteModel:
    """The ``order``, and (first key, path, entries) of the files that hold sorted keys and their values, ascending."""

    order: int
    files: tuple[tuple[int, str, int], ...]


def padded(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``order - 1`` zero bytes, and the place of each text's first byte."""
    pad, parts, starts, at = b"\0" * (order - 1), [], [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        starts.append(at + order - 1)
        parts += [pad, data]
        at += order - 1 + len(data)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts, np.int64)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte from ``order - 1`` on, as numbers."""
    n = max(0, len(data) - order + 1)
    out = np.zeros(n, U64)
    for j in range(order):
        out = (out << U64(8)) | data[j : j + n].astype(U64)
    return out


def _counts(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        for rows in batches:
            for lang, own in rows.groupby("lm_lang", sort=True):
                data, _ = padded(own["lm_text"].tolist(), order)
                parts = kept.setdefault(lang, [])
                for i in range(0, len(data), CHUNK):
                    piece = data[i : i + CHUNK + order - 1]
                    g = grams(piece, order)
                    parts.append(np.unique(g[piece[order - 1 :] != 0], return_counts=True))
                if len(parts) > 16:
                    kept[lang] = [folded(parts)]
        for lang, parts in kept.items():
            keys, counts = folded(parts)
            yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "c": counts})

    return run


def keys_of(lang: str, kind: int, keys: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys of n-grams: ``kind`` is n for probabilities and -n for the back-off weights of contexts of n bytes.

    Within a language no two are alike, as n-grams have seven bytes at most and the mixing is one to one.
    """
    seed = U64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
    return mix(mix(keys.astype(U64) | U64((kind & 0xFF) << 56)) ^ seed).view(np.int64)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for (lang, kind), own in rows.groupby(["lang", "kind"], sort=True):
            keys = own["gram"].to_numpy(np.int64).view(U64)
            yield pd.DataFrame({"key": keys_of(lang, int(kind), keys), "value": own["value"].to_numpy(np.float32)})


def _to_files(folder: str):
    """Writes a task's keys, which are a range of all, to one file; a repeated task writes another and only one counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["key"].to_numpy(np.int64), b["value"].to_numpy(np.float32)) for b in batches if len(b)]
        if not parts:
            return
        keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.argsort(keys, kind="stable")
        store, path = FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(keys[place].tobytes())
            out.write(values[place].tobytes())
        yield pd.DataFrame({"first": [keys[place[0]]], "name": [name], "entries": [len(keys)]})

    return run


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """``lang, kind, gram, value`` of the interpolated model from highest-order counts ``lang, gram, c``.

    Contexts and probabilities are written once for their uses, so what is returned only reads them.
    """
    few = counts.select("lang").distinct().count() <= BROADCAST_LANGUAGES
    tables = {order: counts}
    for n in range(order - 1, 0, -1):  # continuation counts: the distinct bytes before
        tables[n] = materialize(tables[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count("*").alias("c")), f"grams-{n}")
    every = reduce(DataFrame.unionByName, [t.select("lang", F.lit(n).alias("n"), F.shiftright("gram", 8).alias("ctx"), "c") for n, t in tables.items()])
    of_count = [F.count(F.when(F.col("c") == k, 1)).alias(f"m{k}") for k in (1, 2, 3, 4)]
    own = materialize(every.groupBy("lang", "n", "ctx").agg(F.sum("c").alias("total"), *of_count, F.count(F.when(F.col("c") > 2, 1)).alias("more")), "context-counts")
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
    discount = lambda k: F.greatest(F.lit(0.05), F.least(F.lit(k * 0.95), F.coalesce(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)), F.lit(k * 0.5)))).alias(f"d{k}")
    discounts = own.groupBy("lang", "n").agg(*[F.sum(f"m{k}").cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]).select("lang", "n", discount(1), discount(2), discount(3))
    gamma = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("more")) / F.col("total")
    contexts = own.join(F.broadcast(discounts) if few else discounts, ["lang", "n"]).select("n", "lang", "ctx", "total", "d1", "d2", "d3", gamma.alias("gamma"))
    contexts = materialize(contexts, "contexts")
    out, lower = [contexts.select("lang", (1 - F.col("n")).alias("kind"), F.col("ctx").alias("gram"), F.ln("gamma").alias("value"))], None
    for n in range(1, order + 1):
        p = tables[n].withColumn("ctx", F.shiftright("gram", 8)).join(contexts.where(F.col("n") == n).drop("n"), ["lang", "ctx"])
        seen = (F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        if lower is None:
            p = p.select("lang", "gram", (seen + F.col("gamma") / 256).alias("p"))
        else:
            low = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            p = p.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(low, ["lang", "suffix"]).select("lang", "gram", (seen + F.col("gamma") * F.col("low")).alias("p"))
        lower = materialize(p, f"probabilities-{n}")
        out.append(lower.select("lang", F.lit(n).alias("kind"), "gram", F.ln("p").alias("value")))
    return reduce(DataFrame.unionByName, out)


def fit(docs: DataFrame, order: int = 5, lang_col: str = "lang", text_col: str = "text") -> ByteModel:
    """The model of all texts; texts of a null language share one. ``order`` is at most seven."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lm_lang"), F.col(text_col).alias("lm_text"))
    counts = rows.mapInPandas(_counts(order), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    model = kneser_ney(materialize(counts, "gram-counts"), order)
    keyed = materialize(model.mapInPandas(_keyed, "key long, value float"), "model-entries")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    ranges = keyed.repartitionByRange(-(-keyed.count() // FILE_ENTRIES) or 1, "key")
    files = ranges.mapInPandas(_to_files(folder), "first long, name string, entries long").collect()  # a row a file
    return ByteModel(order, tuple(sorted((f["first"], f"{folder}/{f['name']}", f["entries"]) for f in files)))


def _read(path: str, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a model file: mapped where the folder is mounted, else read."""
    store, at = FileSystem.from_uri(path)
    if isinstance(store, LocalFileSystem):
        return np.memmap(at, np.int64, "r", 0, (entries,)), np.memmap(at, np.float32, "r", 8 * entries, (entries,))
    with store.open_input_stream(at) as data:
        whole = data.read()
    return np.frombuffer(whole, np.int64, entries), np.frombuffer(whole, np.float32, entries, 8 * entries)


#: A worker keeps some files open; read ones hold 12 MB each.
_opened = lru_cache(maxsize=16)(_read)


def _found(model: ByteModel, lang: str, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    if not model.files or not len(keys):
        return value, known
    h = keys_of(lang, kind, keys)
    place = np.argsort(h)
    h = h[place]
    edges = np.append(np.searchsorted(h, np.array([f[0] for f in model.files], np.int64)), len(h))
    for (_, path, entries), start, end in zip(model.files, edges[:-1], edges[1:], strict=True):
        if start < end:
            all_keys, values = _opened(path, entries)
            at = np.minimum(np.searchsorted(all_keys, h[start:end]), entries - 1)
            value[place[start:end]], known[place[start:end]] = values[at], all_keys[at] == h[start:end]
    return value, known


def log_probabilities(model: ByteModel, lang: str, keys: np.ndarray) -> np.ndarray:
    """Of each highest-order n-gram's last byte after the others; unseen n-grams back off to shorter ones."""
    value, known = _found(model, lang, model.order, keys)
    out = value.astype(float)
    rest, back = np.flatnonzero(~known), np.zeros((~known).sum())
    for n in range(model.order - 1, 0, -1):
        if not len(rest):
            return out
        ctx = (keys[rest] >> U64(8)) & U64((1 << 8 * n) - 1)
        gamma, has = _found(model, lang, -n, ctx)
        back = back + np.where(has, gamma, 0.0)
        value, known = _found(model, lang, n, keys[rest] & U64((1 << 8 * n) - 1))
        out[rest[known]] = value[known] + back[known]
        rest, back = rest[~known], back[~known]
    if len(rest):
        gamma, has = _found(model, lang, 0, np.zeros(len(rest), U64))
        out[rest] = back + np.where(has, gamma, 0.0) + np.log(1 / 256)
    return out


def log_perplexities(model: ByteModel, lang: str, texts: list[str | None]) -> np.ndarray:
    """Mean negative log probability a byte of each text; zero for texts without bytes."""
    data, starts = padded(texts, model.order)
    logs = np.zeros(len(data))
    for i in range(0, len(data), CHUNK):
        piece = data[i : i + CHUNK + model.order - 1]
        g, place = np.unique(grams(piece, model.order), return_inverse=True)
        logs[i + model.order - 1 : i + model.order - 1 + len(place)] = np.where(piece[model.order - 1 :] != 0, log_probabilities(model, lang, g)[place], 0.0)
    sums = np.append(np.cumsum(logs), 0.0)
    ends = np.append(starts[1:] - (model.order - 1), len(data))
    total = np.where(ends > starts, sums[ends - 1] - sums[starts - 1], 0.0)
    return -total / np.maximum(ends - starts, 1)


def base_statistics(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = words_of(text)
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0
    blank = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeat = 0
    if len(words) > window:
        w = window_hashes(word_hashes(words, _seen), window)
        _, place, counts = np.unique(w, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[place] > 1)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + window, -1)
        repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def _judged(docs: DataFrame, carried: list[str], order: int, width: float, least_words: int, most_repeat_percent: int, text_col: str, lang_col: str, model: ByteModel | None) -> DataFrame:
    """``r_row`` (the ``carried`` columns of a row of ``docs``), its statistics, ``base_failed``, ``kept`` and ``log_perplexity``."""
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    fold = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2))
    model_of = lambda f: F.concat(f.cast("string"), F.lit(":"), lang)
    fitted = model or fit(docs.select(model_of(1 - fold).alias("r_model"), F.col(text_col).alias("r_text")), order, "r_model", "r_text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, logs = rows.column("r_text").to_pylist(), np.zeros(len(rows))
            models = np.array(rows.column("r_model").to_pylist(), object)
            for name in sorted(set(models)):
                at = np.flatnonzero(models == name)
                logs[at] = log_perplexities(fitted, name, [texts[i] for i in at])
            base = np.array([base_statistics(t) for t in texts], np.int64).reshape(-1, len(counts))
            yield pa.RecordBatch.from_arrays([rows.column("r_row"), rows.column("r_lang"), *(pa.array(base[:, k]) for k in range(len(counts))), pa.array(logs)], names=["r_row", "r_lang", *counts, "log_perplexity"])

    rows = docs.select(F.struct(*carried).alias("r_row"), lang.alias("r_lang"), (lang if model else model_of(fold)).alias("r_model"), F.col(text_col).alias("r_text"))
    schema = T.StructType([*rows.select("r_row", "r_lang").schema, *(T.StructField(c, T.LongType()) for c in counts), T.StructField("log_perplexity", T.DoubleType())])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    scored = materialize(rows.mapInArrow(run, schema).withColumn("base_failed", failed), "rules")
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    bands = scored.where("not base_failed").groupBy("r_lang").agg(q.alias("q")).select("r_lang", F.col("q")[1].alias("mid"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.03)).alias("spread"))
    bands = materialize(bands, "bands")
    inside = F.abs(F.col("log_perplexity") - F.col("mid")) <= width * F.col("spread") * F.sqrt(1 + F.lit(SHORT) / F.col("n_words"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    few = F.broadcast(bands) if bands.count() <= BROADCAST_LANGUAGES else bands
    return scored.join(few, "r_lang", "left").select("r_row", *counts, "base_failed", kept.alias("kept"), "log_perplexity")


def quality_rules(docs: DataFrame, order: int = 5, width: float = WIDTH, least_words: int = 20, most_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: ByteModel | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``log_perplexity``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeat_percent`` of them in repeated windows of
    eight. Of the others, a document is kept if its log perplexity lies in its language's band: the median of those
    documents, ``width`` robust deviations (interquartile range / 1.349, at least 0.03) to either side, widened by
    sqrt(1 + 200 / words) as the means of short texts scatter more.

    Null texts have no words and fail. A null language is a language of its own. Null ids stay null; repeated rows are
    each returned. Other columns are ignored; an empty table gives none.

    Unless a model is given, texts are dealt by a hash into two folds, and each is scored under the model of its
    language's other fold: no text, nor an exact copy of it, is known to the model that scores it. Every text is counted
    in one model and scored by the other. A text whose language has no other fold is scored as uniformly random bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("r_id"), F.col(text_col).alias("r_text"), F.col(lang_col).alias("r_lang"))
    return _judged(rows, ["r_id"], order, width, least_words, most_repeat_percent, "r_text", "r_lang", model).select(F.col("r_row.r_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def drop_poor(docs: DataFrame, order: int = 5, width: float = WIDTH, least_words: int = 20, most_repeat_percent: int = 30, text_col: str = "text", lang_col: str = "lang", model: ByteModel | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, each judged by itself, whatever its id."""
    return _judged(docs, docs.columns, order, width, least_words, most_repeat_percent, text_col, lang_col, model).where("kept").select("r_row.*")
