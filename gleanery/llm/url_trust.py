"""URL filters by rules and, where no rule fits, by link-graph propagation. DataFrame functions only.

Trust spreads from hosts that the rules mostly allow along host links: a personalised PageRank. Distrust spreads against
the links from hosts that the rules mostly block, each host taking that of the hosts it links to by the share of its own
links: the discounted chance that a walk along its links meets a blocked seed. So the threshold is one on a host's own
links, and means the same for one linking host and for ten thousand, and at every size of graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``host`` fits itself and its subdomains, ``path`` is a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, links``: counted links between different hosts, from absolute and protocol-relative hrefs."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(found).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return linked.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """``host, trust, distrust`` of every host in ``seeds`` (host, good, bad) or ``edges`` (src, dst, links).

    Each round is one join and one sum, written to the shared folder; rounds end when no score moves by more than
    ``tolerance``; 60 bring them within 1e-4 of their limits. A host without out-links passes no trust on and takes none
    of others' distrust.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    zero = F.lit(0.0)
    forward = edges.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("all_links")).alias("t"), zero.alias("d"))
    back = edges.join(out, "src").select(F.col("dst").alias("from"), F.col("src").alias("to"), zero.alias("t"), (F.col("links") / F.col("all_links")).alias("d"))
    arcs = materialize(forward.union(back), "host-arcs")
    ends = arcs.select(F.col("to").alias("host"), zero.alias("good"), zero.alias("bad"))
    start = seeds.select("host", F.col("good").cast("double").alias("good"), F.col("bad").cast("double").alias("bad")).union(ends)
    start = start.groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    state = materialize(start.select("host", "good", "bad", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust")), "host-scores")
    for turn in range(rounds if not arcs.isEmpty() else 0):
        sent = arcs.join(state, arcs["from"] == state["host"]).groupBy("to").agg(F.sum(F.col("trust") * F.col("t")).alias("t"), F.sum(F.col("distrust") * F.col("d")).alias("d"))
        grown = lambda seed, got: F.col(seed) * (1 - damping) + F.coalesce(F.col(got), zero) * damping
        moved = F.greatest(F.abs(grown("good", "t") - F.col("trust")), F.abs(grown("bad", "d") - F.col("distrust")))
        new = state.join(sent, state["host"] == sent["to"], "left").select("host", "good", "bad", grown("good", "t").alias("trust"), grown("bad", "d").alias("distrust"), moved.alias("moved"))
        state = materialize(new, f"host-scores-{turn}")
        if state.where(F.col("moved") > tolerance).isEmpty():
            break
    return state.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.05, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    A host whose pages the rules mostly allow is a trusted seed, one whose pages they mostly block a blocked seed. A
    page that no rule fits is blocked if its host's distrust is over its trust and at least ``least``, else allowed: at
    0.05, if two fifths of its host's links go to blocked seeds, or more to hosts that link to those.

    Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed. Null html has no links.
    Repeated rows count as pages each. Other columns are ignored; an empty table gives none.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", text.alias("rule"), verdict.alias("by_rule"))
    most = lambda v: (2 * F.count(F.when(F.col("by_rule") == v, 1)) > F.count("*")).cast("double")
    seeds = materialize(judged.where("host <> ''").groupBy("host").agg(most("allow").alias("good"), most("block").alias("bad")), "host-seeds")
    edges = materialize(host_edges(pages, url_col, html_col), "host-edges")
    scores = propagate(edges, seeds, **options).select(F.col("host").alias("scored"), "trust", "distrust")
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    by_method = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return judged.join(scores, judged["host"] == scores["scored"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
