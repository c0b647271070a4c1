"""Bounded logs of diagnostic events: whole outputs and streams of their chunks, in any split."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from gleanery.streaming import events


def test_event_lines():
    assert events.event_of("other") is None and events.event_of(events.PREFIX + "{") is None and events.event_of(events.PREFIX + "[1]") is None and events.event_of(" " + events.PREFIX + "{}") is None
    assert events.event_of(events.PREFIX + '{"count": "1"}') is None and events.event_of(events.PREFIX + '{"stage": 1}') is None and events.event_of(events.PREFIX + '{"count": true}') is None
    assert json.loads(events.event_of(events.PREFIX + '{"stage": "s", "count": 2, "title": null, "x": 1}\r')) == dict.fromkeys(events.TEXTS, "") | dict.fromkeys(events.NUMBERS, 0) | {"stage": "s", "count": 2}


def output(rng, n):
    lines = []
    for i in range(n):
        kind = rng.random()
        lines.append(events.PREFIX + json.dumps({"stage": f"s{i}", "count": i, "message": "Cookie: a=b\nnext", "url": "https://u:p@a.test/x?token=1#f", "title": "é" * 150}) if kind < 0.8 else rng.choice(["noise", "", events.PREFIX + "{bad", events.PREFIX[:-1] + '{"count": 1}']))
    return "\n".join(lines) + rng.choice(["", "\n", "\n" + events.PREFIX + '{"stage": "open"', "\n" + events.PREFIX + '{"stage": "last"}'])


def test_any_split_gives_the_whole_outputs_log(spark, tmp_path):
    rng = random.Random(2)
    outputs = {f"l{i}": output(rng, n) for i, n in enumerate([0, 1, 5, 16, 17, 150, 159, 160, 161, 162, 400])}
    whole = spark.createDataFrame(list(outputs.items()), "log string, output string")
    order = ["log", "place"]
    want = events.output_events(whole).orderBy(*order).collect()
    assert {r.log for r in want} >= {"l4", "l10"} and max(r.dropped for r in want) > 100 and {r.url for r in want if r.stage.startswith("s")} == {"https://a.test/x"} and not any("a=b" in r.message for r in want) and max(len(r.title.encode()) for r in want) == 200
    seq, landed = 0, f"file://{tmp_path}/landed"
    left = dict(outputs)
    for _ in range(4):
        rows = []
        for log, rest in left.items():
            upto = rng.randint(0, len(rest)) if _ < 3 else len(rest)
            part, left[log] = rest[:upto], rest[upto:]
            for cut in range(0, len(part), max(1, len(part) // 3 + 1)):
                rows.append((log, seq, part[cut : cut + max(1, len(part) // 3 + 1)]))
                seq += 1
        rng.shuffle(rows)
        spark.createDataFrame(rows, "log string, seq long, chunk string").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema("log string, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(landed)
    events.stream_logs(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"file://{tmp_path}/logs/batch={n}")).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = events.logged_events(spark.read.parquet(f"file://{tmp_path}/logs")).orderBy(*order).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_outputs_end_with_themselves(spark):
    given = spark.createDataFrame([("a", "m", "https://x.test/?q=1", "token: abc\n" + events.PREFIX + '{"stage": "s"}'), ("b", "m", "u", ""), ("c", "m", "", "\n".join(events.PREFIX + "{}" for _ in range(160)))], "log string, method string, url string, output string")
    got = events.subprocess_events(given).orderBy("log", "place").collect()
    assert [(r.log, r.stage, r.url, r.message.split("\n")[0]) for r in got[:2]] == [("a", "s", "", ""), ("a", "fetcher_output", "https://x.test/", "token: [redacted]")]
    assert {r.log for r in got} == {"a", "c"} and len(got) == 162 and got[-1].dropped == 1 and got[-1].stage == "fetcher_output" and got[-1].message.endswith(" [truncated]")
    assert events.output_events(given.select("log", "output").where(F.lit(False))).count() == 0
