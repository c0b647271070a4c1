"""Fill-in-middle in Spark SQL: a text's units are cut in three by a hash of its id, rearranged around sentinels, restored.

Everything is a projection of built-in functions: no shuffle, no Python worker, one pass over the texts.
"""

from __future__ import annotations

from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or what follows the last of them.
LINES = r"[^\n]*\n|[^\n]+"


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> Sentinels:
        """Sentinels must be found where they were put: none may hold, or run over into, another or itself."""
        for a, b in permutations([*self, *self], 2):
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} could be found in one another")
        if len(set(self)) < 3:
            raise ValueError("sentinels must differ")
        return self


def draw(seed: str, key: Column, place: int) -> Column:
    """The ``place``-th group (from 0) of eight hexadecimal digits of sha256(``seed:key``), as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` was made of, from ``output`` and ``form`` alone; null where either is null."""
    before, after = (lambda x, mark: F.substring_index(x, mark, 1)), (lambda x, mark: F.substring_index(x, mark, -1))
    part = {
        "psm": (after(before(output, marks.suffix), marks.prefix), after(before(output, marks.middle), marks.suffix)),
        "spm": (after(before(output, marks.middle), marks.prefix), after(before(output, marks.prefix), marks.suffix)),
    }
    middle = after(output, marks.middle)
    whole = {kind: F.concat(prefix, middle, suffix) for kind, (prefix, suffix) in part.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).when(form == "plain", output)


def fill_in_middle(docs: DataFrame, seed: str = "7", percent: int = 100, spm_percent: int = 50, units: str = LINES, marks: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output``: one row for each row of ``docs``.

    ``units`` is the pattern whose matches, laid end to end, are the whole text; ``n`` of them are cut at two places drawn
    from the id. ``percent`` of the texts are rearranged, ``spm_percent`` of those as suffix-prefix-middle (``spm``), the
    others as prefix-suffix-middle (``psm``). Empty texts and texts that hold a sentinel stay ``plain``: their output is
    the text, and their parts are null.

    A null text is empty. A null id draws like an empty one; rows of one id are cut at places of the same draw. Repeated
    rows are each returned, texts of any length whole. Other columns are ignored; an empty table gives none.
    """
    marks.check()
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[draw(seed, key, k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(units), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    rows = rows.withColumns({"x": F.col("h1") % (F.col("n") + 1), "y": F.col("h2") % (F.col("n") + 1)})
    rows = rows.withColumns({"low": F.least("x", "y").cast("int"), "high": F.greatest("x", "y").cast("int")})
    holds = F.lit(False)
    for mark in marks:
        holds = holds | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    joined = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))
    low, high = F.col("low"), F.col("high")
    rows = rows.withColumns({"prefix": joined(F.lit(0), low), "middle": joined(low, high - low), "suffix": joined(high, F.size("units") - high)})
    laid = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])
    output = F.when(F.col("form") == "psm", laid(marks.prefix, "prefix", marks.suffix, "suffix", marks.middle, "middle")).when(F.col("form") == "spm", laid(marks.suffix, "suffix", marks.prefix, "prefix", marks.middle, "middle"))
    return rows.withColumn("output", F.coalesce(output, "text")).select("doc_id", "n", "form", "prefix", "middle", "suffix", "output")
