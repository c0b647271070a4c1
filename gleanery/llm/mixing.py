"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source has a mean repetition rate: its target rows over the rows it has. A document's uniform number comes from a
hash of a seed and its id; inverting its source's Poisson distribution there gives its count of copies, so a rate under
one samples and a rate over one repeats, independently for each document and repeatable for a seed. Copies are exploded
and shuffled globally by a hash of id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their rates are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def hash_number(*parts: Column) -> Column:
    """A 52-bit number from the md5 of the parts joined by ``|``; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float = 2.0, total: int | None = None, source_col: str = "source") -> DataFrame:
    """``mx_source, rows, rate``: each source's mean repetition rate.

    ``weights`` are the sources' target shares (a source that is not named gets none). Without them, shares follow
    ``rows ** (1 / temperature)``. ``total`` is the rows wanted, by default as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("mx_source")).agg(F.count("*").alias("rows"))
    if weights is None:
        share = F.pow(F.col("rows").cast("double"), F.lit(1 / temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("mx_source") == name, float(weight)).otherwise(share)
    shares = counts.select("mx_source", "rows", share.alias("share"))
    sums = shares.agg(F.sum("rows").alias("rows"), F.sum("share").alias("share"), F.count("*").alias("sources")).head()
    if not sums["rows"] or not sums["share"]:
        return shares.select("mx_source", "rows", F.lit(0.0).alias("rate"))
    wanted = float(total if total is not None else sums["rows"])
    rates = shares.select("mx_source", "rows", (F.col("share") / F.lit(float(sums["share"])) * wanted / F.col("rows")).alias("rate"))
    return F.broadcast(rates) if sums["sources"] <= BROADCAST_SOURCES else rates


def poisson_steps(rate: Column) -> Column:
    """The cumulative Poisson distribution from 0 up to where it is 1 for a double, as an array."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    start = F.struct((-rate).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_p = F.when(k == 0, acc["log_p"]).otherwise(acc["log_p"] + F.ln(rate) - F.ln(k.cast("double")))
        at = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), at.alias("sum"), F.concat(acc["steps"], F.array(at)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["steps"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, total: int | None = None, seed: int = 13, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` for every copy drawn, plus ``mix_copy`` (from 1) and ``mix_key``, in global order of it.

    A null source is a source of its own; with ``weights`` it gets none. A null id draws like an empty one. Repeated
    rows of an id draw alike. Clashing columns ``mix_copy`` and ``mix_key`` are replaced. An empty table gives none.
    """
    docs = docs.drop("mix_copy", "mix_key")
    rates = source_rates(docs, weights, temperature, total, source_col).where("rate > 0").select("mx_source", poisson_steps(F.col("rate")).alias("mx_steps"))
    u = (hash_number(F.lit(seed), F.col(id_col)) + F.lit(0.5)) / F.lit(float(2**52))
    drawn = docs.withColumn("mx_u", u).join(rates, docs[source_col].eqNullSafe(rates["mx_source"]))
    copies = F.size(F.filter("mx_steps", lambda s: s <= F.col("mx_u")))
    many = drawn.withColumn("mx_n", copies).where("mx_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mx_n"))))
    keyed = many.withColumn("mix_key", hash_number(F.lit(f"{seed} order"), F.col(id_col), F.col("mix_copy"))).select(*docs.columns, "mix_copy", "mix_key")
    return keyed.repartitionByRange("mix_key", id_col, "mix_copy").sortWithinPartitions("mix_key", id_col, "mix_copy")
