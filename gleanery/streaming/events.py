"""Diagnostic events out of the output of fetchers, as a bounded log: of whole outputs, or of a stream of their chunks.

An event is a line ``SCRAPE_DIAGNOSTIC {json}``. A log keeps its first and its latest events and counts those between. The
stream keeps, for each log, those events and the line that is not ended yet; in whatever chunks and batches an output comes,
its log is that of the whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text, urls
from ..operators.diagnostics import FIRST_EVENTS, LAST_EVENTS, bounded_events

# The mark of an event's line, its fields, and the bytes that some of them keep.
PREFIX = "SCRAPE_DIAGNOSTIC "
TEXTS, NUMBERS = ("at", "stage", "method", "url", "finalUrl", "title", "blockMarker", "bodySha256", "message"), ("attempt", "httpStatus", "durationMs", "bytes", "count")
BYTES = {"title": 200, "method": 80, "stage": 80, "blockMarker": 100, "bodySha256": 64}
EVENT = "struct<" + ",".join([*(f"{n}:string" for n in TEXTS), *(f"{n}:long" for n in NUMBERS)]) + ">"
STATE = "rest string, first array<string>, latest array<string>, dropped long"


def event_of(line: str) -> str | None:
    """The event of a line with all fields, as JSON; None for other lines, other JSON and fields of other types."""
    if not line.startswith(PREFIX):
        return None
    try:
        found = json.loads(line[len(PREFIX) :])
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    own = {n: found.get(n) for n in (*TEXTS, *NUMBERS)}
    right = all(v is None or (isinstance(v, str) if n in TEXTS else isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63) for n, v in own.items())
    return json.dumps({n: ("" if n in TEXTS else 0) if v is None else v for n, v in own.items()}) if right else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        rows["event"] = [event_of(line) for line in rows["line"]]
        yield rows.loc[rows["event"].notna(), ["log", "place", "event"]]


def cleaned(e: Column) -> Column:
    """An event without secrets: URLs bare, texts redacted and cut."""
    address = lambda n: F.when(e[n] == "", "").otherwise(urls.diagnostic_url(e[n]))
    of = lambda n: address(n) if n in ("url", "finalUrl") else e[n] if n in ("at", "bodySha256") else text.redact(e[n])
    return F.struct(*[(text.byte_prefix(of(n), BYTES[n]) if n in BYTES else of(n)).alias(n) for n in TEXTS], *[e[n].alias(n) for n in NUMBERS])


def _shown(found: DataFrame) -> DataFrame:
    e = F.from_json("event", EVENT)
    return found.select("log", "place", "dropped", cleaned(e).alias("e")).select("log", "place", "dropped", "e.*")


def output_events(outputs: DataFrame) -> DataFrame:
    """``log, place, dropped`` and the fields of the events kept of whole outputs (log, output); ``place`` is from 1 among
    those kept."""
    lines = outputs.select("log", F.posexplode(F.split("output", "\n")).alias("place", "line")).where(F.col("line").startswith(PREFIX))
    kept = bounded_events(lines.mapInPandas(_parsed, "log string, place int, event string"), ["log"], ["place"])
    place = F.when(F.col("place") <= FIRST_EVENTS, F.col("place")).otherwise(F.col("place") - F.col("dropped"))
    return _shown(kept.withColumn("place", place))


def subprocess_events(outputs: DataFrame) -> DataFrame:
    """The events of outputs (log, method, url, output), and after them, within the same bounds, the output itself as one."""
    own = F.to_json(F.struct(F.lit("fetcher_output").alias("stage"), "method", "url", F.col("output").alias("message")))
    whole = F.when(F.col("output") != "", F.concat("output", F.lit("\n" + PREFIX), own)).otherwise("")
    return output_events(outputs.select("log", whole.alias("output")))


class _Log:
    """The first and the latest events, with a count of those between."""

    def __init__(self, first: list[str], latest: list[str], dropped: int):
        self.first, self.latest, self.dropped = list(first), list(latest), dropped

    def add(self, line: str) -> None:
        event = event_of(line)
        if event is None:
            return
        if len(self.first) < FIRST_EVENTS:
            self.first.append(event)
            return
        self.latest.append(event)
        if len(self.latest) > LAST_EVENTS:
            del self.latest[0]
            self.dropped += 1


def _extend(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, first, latest, dropped = state.get if state.exists else ("", [], [], 0)
    log = _Log(first, latest, dropped)
    rows = pd.concat(list(chunks)).sort_values("seq", kind="stable")
    *lines, rest = (rest + "".join(c or "" for c in rows["chunk"])).split("\n")
    for line in lines:
        log.add(line)
    state.update((rest, log.first, log.latest, log.dropped))
    log.add(rest)  # as if it ended here
    events = log.first + log.latest
    yield pd.DataFrame({"log": key[0], "version": int(rows["seq"].max()), "events": [events], "dropped": [log.dropped]})


def stream_logs(chunks: DataFrame) -> DataFrame:
    """``log, version, events, dropped``, a row for each log that a batch extends: its whole bounded log so far.

    ``chunks`` is a stream of (log, seq, chunk): pieces of outputs, cut anywhere, ascending by ``seq`` over the batches.
    ``version`` is the last piece's; of several rows of a log the one of the highest version counts.
    """
    given = chunks.select(F.col("log").cast("string").alias("log"), F.col("seq").cast("long").alias("seq"), "chunk")
    return given.groupBy("log").applyInPandasWithState(_extend, "log string, version long, events array<string>, dropped long", STATE, "update", GroupStateTimeout.NoTimeout)


def logged_events(logs: DataFrame) -> DataFrame:
    """``log, place, dropped`` and the fields of the events of the latest versions of ``stream_logs``."""
    last = logs.groupBy("log").agg(F.max(F.struct("version", "events", "dropped")).alias("r"))
    return _shown(last.select("log", "r.dropped", F.posexplode("r.events").alias("place", "event")).withColumn("place", F.col("place") + 1))
