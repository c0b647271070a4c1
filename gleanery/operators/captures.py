"""Which of several captures of a URL counts: block pages, shells without cards, and the order of the ways to fetch.

A capture is ``run_id, url, way, at, html, cards, error``: ``way`` is fetch, rendered, first or second (browsers), plain; ``cards``
is null where the site has no card selector; ``error`` is null where a page came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diagnostics

# What block pages hold, and the lengths over which two of them are pages.
BLOCK_HOST, BLOCK_ASK, BLOCK_ASK_CHARS = "captcha-delivery.com", "Please enable JS and disable any ad blocker", 4000
FIREWALL = ('id="cf-error-details"', "Attention Required! | Cloudflare")
WAIT_TITLE, WAIT_PATH, WAIT_CHARS = "Just a moment...", "/cdn-cgi/challenge-platform/", 200_000
WAYS = ("fetch", "rendered", "first", "second", "plain")
CHALLENGED, SHELL, UNFETCHED, UNSERVED = "datadome challenge still present after all bypass strategies", "HTTP response contained no configured inventory cards", "page not landed", "protected inventory page returned zero cards; DataDome bypass is unavailable or was challenged"


def is_blocked(html: Column) -> Column:
    """A block page by one of four rules, two of which hold for short pages only; null is none."""
    chars = F.char_length(html)
    ask = (chars < BLOCK_ASK_CHARS) & html.contains(BLOCK_ASK)
    wait = (chars < WAIT_CHARS) & html.contains(WAIT_TITLE) & html.contains(WAIT_PATH)
    return F.coalesce(html.contains(BLOCK_HOST) | ask | html.contains(FIREWALL[0]) | html.contains(FIREWALL[1]) | wait, F.lit(False))


def choose(captures: DataFrame, protected: bool = False) -> DataFrame:
    """``run_id, url, way, at, cards, message``: for each URL of a run the capture that counts, else why none does.

    A challenge in the fetched page ends all. A fetched page counts if it has cards or the site no card selector; a
    rendered one only after a fetched page without cards, and only with cards. Then the browsers: the first counts if it
    has two cards or more, the site no selector or the second did not try; else the second, and if that failed, its error. Then
    the plain page. A ``protected`` site's page without cards is an error. Of several captures of one way the latest counts;
    blocked ones are errors. One aggregation with map-side combine: pages themselves are not moved.
    """
    blocked = is_blocked(F.col("html"))
    error = F.coalesce("error", F.when(blocked, F.lit("blocked")), F.when(F.col("html").isNull(), F.lit("empty")))
    state = F.struct("at", error.alias("error"), "cards", (F.coalesce(diagnostics.is_challenge(F.col("html")), F.lit(False)) & F.col("error").isNull()).alias("challenge"))
    ways = captures.groupBy("run_id", "url").agg(*[F.max(F.when(F.col("way") == w, state)).alias(w) for w in WAYS])
    of = lambda w: F.col(w)
    came = lambda w: of(w).isNotNull() & of(w)["error"].isNull()
    carded = lambda w, least=1: of(w)["cards"].isNull() | (of(w)["cards"] >= least)
    fetched = came("fetch") & carded("fetch")
    rendered = came("fetch") & ~carded("fetch") & came("rendered") & (F.coalesce(of("rendered")["cards"], F.lit(0)) > 0)
    tried_second = of("second").isNotNull() & ~(came("first") & carded("first", 2))
    way = (
        F.when(of("fetch")["challenge"], None).when(fetched, "fetch").when(rendered, "rendered").when(came("first") & ~tried_second, "first").when(tried_second & came("second"), "second")
        .when(came("first"), None).when(came("plain"), "plain")
    )
    last = F.coalesce(F.when(tried_second, of("second")["error"]), of("plain")["error"], of("first")["error"], F.when(came("fetch"), F.lit(SHELL)), F.concat(F.lit("fetch failed: "), of("fetch")["error"]), F.lit(UNFETCHED))
    picked = F.coalesce(*[F.when(F.col("way") == w, of(w)) for w in WAYS])
    out = ways.withColumn("way", way).withColumn("picked", picked)
    unserved = F.lit(protected) & (F.col("picked.cards") == 0)
    message = F.when(of("fetch")["challenge"], F.lit(CHALLENGED)).when(F.col("way").isNull(), last).when(unserved, F.lit(UNSERVED))
    return out.withColumn("message", message).select("run_id", "url", F.when(F.col("message").isNull(), F.col("way")).alias("way"), F.when(F.col("message").isNull(), F.col("picked.at")).alias("at"), F.when(F.col("message").isNull(), F.col("picked.cards")).alias("cards"), "message")
