"""The numbered queries over the test tables, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, fim, minhash, mixing, packing, perplexity, quality, revisits, search, sharding, topk, toxicity, url_trust

RULES = [
    url_trust.Rule("allow", "com", "/"),
    url_trust.Rule("block", "example.com", "/en/"),
    url_trust.Rule("allow", "www.example.com", "/en/"),
    url_trust.Rule("block", "net", "/es/"),
    url_trust.Rule("block", "net", "/fr/"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of ``pages``: a full response of every page, a matching revisit a day later, and one of three others
    two days later or a day before (changed tag; before any response; Last-Modified only)."""
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    at = F.lit(1_700_000_000) + (F.col("page_id") * 7919) % 2_592_000
    tag, changed = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"')), F.concat(F.lit("time "), at.cast("string"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    base = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), changed.alias("changed"), size.alias("size"), (F.col("page_id") % 3).alias("case"))
    full = base.select("page_id", (F.col("page_id") * 3).alias("record_id"), "url", "at", F.lit("response").alias("kind"), F.lit(200).alias("status"), F.array(entry("ETag", F.col("tag")), entry("Last-Modified", F.col("changed")), entry("Content-Length", F.col("size")), entry("Cache-Control", F.lit("max-age=60"))).alias("headers"), "tag")
    same = base.select("page_id", (F.col("page_id") * 3 + 1).alias("record_id"), "url", (F.col("at") + 86_400).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.array(entry("ETag", F.concat(F.lit("W/"), "tag")), entry("Content-Length", F.lit("0")), entry("Cache-Control", F.lit("max-age=90"))).alias("headers"), "tag")
    third = F.when(F.col("case") == 0, F.array(entry("ETag", F.lit('"other"')))).otherwise(F.array(entry("Last-Modified", F.col("changed")), entry("X-Seen", F.lit("again"))))
    last = base.select("page_id", (F.col("page_id") * 3 + 2).alias("record_id"), "url", (F.col("at") + F.when(F.col("case") == 1, -86_400).otherwise(172_800)).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), third.alias("headers"), "tag")
    return full.unionByName(same).unionByName(last).withColumn("digest", F.when(F.col("kind") == "response", F.col("tag")))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve_revisits(captures(read(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return done.select(F.expr("record_id div 3").alias("page_id"), "record_id", "url_key", "at", "kind", "outcome", "source_record_id", "source_at", "status", shown.alias("headers"), "digest")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.score_texts(read(spark, sf_dir, "documents"), held_out=automaton.fold("doc_id", 7) == 2)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read(spark, sf_dir, "documents"), seed="7", percent=100, spm_percent=50)
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (op1_pack, op2_toxicity, op3_top_k, op4_quality, op5_url_filter, op6_quality_rules, op7_near_duplicates, op8_shards, op9_mix, op10_revisits, op11_lm_scores, op12_fill_in_middle, op13_ranked_search)}


def _trust_sql(rounds: int = 60) -> str:
    """Rules, seeds and both propagations of url_trust, a step a common table expression."""
    part = lambda k, u: f"coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', {k}), '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '{r.path}%')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in ordered) + " END"
    steps = "".join(
        f""", s{k} AS MATERIALIZED (SELECT s.host, s.good, s.bad, 0.15 * s.good + 0.85 * coalesce(t, 0) AS trust, 0.15 * s.bad + 0.85 * coalesce(d, 0) AS distrust FROM s{k - 1} s
        LEFT JOIN (SELECT dst AS host, sum(trust * w) AS t FROM e JOIN s{k - 1} ON src = host GROUP BY 1) USING (host) LEFT JOIN (SELECT src AS host, sum(distrust * w) AS d FROM e JOIN s{k - 1} ON dst = host GROUP BY 1) USING (host))"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH p AS (SELECT page_id, html, {lower.format(part(1, "url"))} AS host, {part(2, "url")} AS path FROM pages), j AS (SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS by_rule FROM p),
      l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS u FROM p),
      c AS (SELECT src, {lower.format(part(1, "CASE WHEN u LIKE '//%' THEN 'http:' || u ELSE u END"))} AS dst, count(*) AS n FROM l GROUP BY ALL),
      e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM c WHERE src <> '' AND dst <> '' AND src <> dst),
      h AS (SELECT host, (2 * count(*) FILTER (by_rule = 'allow') > count(*))::DOUBLE AS good, (2 * count(*) FILTER (by_rule = 'block') > count(*))::DOUBLE AS bad FROM j WHERE host <> '' GROUP BY host),
      s0 AS MATERIALIZED (SELECT host, max(good) AS good, max(bad) AS bad, 0.15 * max(good) AS trust, 0.15 * max(bad) AS distrust FROM (SELECT * FROM h UNION ALL SELECT src, 0, 0 FROM e UNION ALL SELECT dst, 0, 0 FROM e) GROUP BY host){steps}
      SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > trust AND distrust >= 0.05 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN s{rounds} USING (host)"""


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS t FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.t), len(c.t)) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_MIX = """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM c),
  k AS (SELECT source, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT + 1)) AS k, rate FROM r), f AS (SELECT source, sum(exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
  d AS (SELECT *, (CAST('0x' || substr(md5('13|' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
  m AS (SELECT d.*, (SELECT count(*) FROM f WHERE f.source IS NOT DISTINCT FROM d.source AND f.cdf <= d.u) AS times FROM d)
  SELECT doc_id, text, lang, source, n_chars, mix_copy, CAST('0x' || substr(md5('13 order|' || coalesce(doc_id::VARCHAR, '') || '|' || mix_copy), 1, 13) AS BIGINT) AS mix_key FROM (SELECT * EXCLUDE (u, times), CAST(unnest(range(1, times + 1)) AS INT) AS mix_copy FROM m)"""

_REVISITS = """WITH b AS (SELECT page_id, url, 1700000000 + (page_id * 7919) % 2592000 AS ts, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, coalesce(strlen(html), 0) AS size, page_id % 3 AS kase,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS h FROM pages),
  w AS (SELECT *, CASE WHEN h <> '' THEN regexp_replace(regexp_replace(lower(h), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) END AS url_key FROM b),
  r AS (SELECT page_id, page_id * 3 AS record_id, url_key, ts, 'response' AS kind, tag AS digest, 'time ' || ts AS since, tag, size, kase FROM w
    UNION ALL SELECT page_id, page_id * 3 + 1, url_key, ts + 86400, 'revisit', NULL, NULL, 'W/' || tag, size, kase FROM w
    UNION ALL SELECT page_id, page_id * 3 + 2, url_key, ts + CASE WHEN kase = 1 THEN -86400 ELSE 172800 END, 'revisit', NULL, CASE WHEN kase <> 0 THEN 'time ' || ts END, CASE WHEN kase = 0 THEN '"other"' END, size, kase FROM w),
  a AS (SELECT r.*, (SELECT max((o.ts, o.record_id)) FROM r o WHERE o.kind = 'response' AND o.url_key = r.url_key AND o.ts < r.ts) AS found FROM r),
  f AS (SELECT a.*, o.record_id AS oid, o.ts AS oat, o.tag AS otag, o.since AS osince, o.size AS osize FROM a LEFT JOIN r o ON o.kind = 'response' AND o.record_id = a.found[2]),
  g AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN url_key IS NULL OR ts IS NULL THEN 'invalid' WHEN oid IS NULL THEN 'no_earlier_response' WHEN CASE WHEN tag IS NOT NULL THEN replace(tag, 'W/', '') = otag ELSE since = osince END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM f)
  SELECT page_id, record_id, url_key, ts AS "at", kind, outcome, CASE WHEN outcome = 'resolved' THEN oid END AS source_record_id, CASE WHEN outcome = 'resolved' THEN oat END AS source_at, CASE WHEN kind = 'response' OR outcome = 'resolved' THEN 200 ELSE 304 END AS status,
    CASE WHEN kind = 'response' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || size, 'etag: ' || tag, 'last-modified: ' || since)
      WHEN outcome = 'resolved' AND tag IS NOT NULL THEN concat_ws(chr(10), 'cache-control: max-age=90', 'content-length: ' || osize, 'etag: ' || tag, 'last-modified: ' || osince)
      WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || osize, 'etag: ' || otag, 'last-modified: ' || since, 'x-seen: again')
      WHEN record_id % 3 = 1 THEN concat_ws(chr(10), 'cache-control: max-age=90', 'content-length: 0', 'etag: ' || tag) WHEN kase = 0 THEN 'etag: ' || tag ELSE concat_ws(chr(10), 'last-modified: ' || since, 'x-seen: again') END AS headers,
    CASE WHEN kind = 'response' THEN digest WHEN outcome = 'resolved' THEN otag END AS digest FROM g"""

_FIM = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
  c AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y, ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 AS spm FROM d),
  p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:least(x, y)], ''), '') AS a, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS b, coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS c FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_SEARCH = r"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l), f AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM f JOIN l USING (doc_id) JOIN w USING (term) JOIN q USING (term), g GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op12_fill_in_middle": _FIM, "op13_ranked_search": _SEARCH, "op3_top_k": _TOP_K, "op5_url_filter": _trust_sql(), "op9_mix": _MIX, "op10_revisits": _REVISITS}
