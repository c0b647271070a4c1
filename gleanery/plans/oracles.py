"""DuckDB SQL for the registered queries: the same rows, written independently of the Spark expressions."""

from __future__ import annotations

from . import landed
from .samples import ITEMS_ORACLE

# The pieces of a URL u, as SQL.
RE = r"'(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"
P = {k: f"regexp_extract(u, {RE}, {n})" for k, n in (("scheme_", 1), ("scheme", 2), ("auth_", 3), ("auth", 4), ("path", 5), ("query", 6))}
NAME = f"regexp_replace(regexp_replace({P['auth']}, '^.*@', ''), ':[0-9]*$', '')"
PATH_CUT = f"CASE WHEN {P['path']} = '/' THEN '/' ELSE regexp_replace({P['path']}, '/$', '') END"
CANONICAL = f"lower({P['scheme_']} || {P['auth_']} || {PATH_CUT})"
CACHE = f"lower({P['scheme_']}) || lower({P['auth_']}) || {PATH_CUT} || {P['query']}"
SOURCE = f"lower({P['scheme_']}) || lower({P['auth_']}) || regexp_replace(lower({P['path']}), '/$', '') || {P['query']}"
BARE = f"regexp_replace(lower({P['path']}), '^/+|/+$', '', 'g')"
TEMPLATE = f"'url::' || lower({NAME}) || '/' || CASE WHEN {BARE} = '' THEN '_root' ELSE {BARE} END"
HOST = f"lower(regexp_replace({NAME}, '^www\\.', ''))"
PAGE = r"coalesce(nullif(greatest(coalesce(try_cast(regexp_extract(u, '\?(?:[^#]*&)?PageNumber=([^&#]*)', 1) AS INT), 0), 0), 0), greatest(coalesce(try_cast(regexp_extract(u, '\?(?:[^#]*&)?page=([^&#]*)', 1) AS INT), 0), 0))"
SCORE = f"""CASE WHEN lower(u) = '' OR lower(u) = '#' OR regexp_matches(lower(u), '^(javascript:|mailto:|tel:)') OR contains(lower(u), 'google.com/maps') OR contains(lower(u), 'api=1&destination=') THEN -100 ELSE
  CASE WHEN regexp_matches(lower(u), '/pre-owned-cars/detail/|/vehicle-details/|/inventory/|/viewdetails/') THEN 10 ELSE 0 END + CASE WHEN lower(u) LIKE '/%' THEN 2 ELSE 0 END
  + CASE WHEN contains(lower({P['auth']}), 'google.') THEN -10 ELSE 0 END + CASE WHEN regexp_matches(lower(u), 'compare|schedule|finance|service') THEN -3 ELSE 0 END END"""

SPACE = r"'^[\s\p{Z}\x{0085}\x0B]+|[\s\p{Z}\x{0085}\x0B]+$'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {SPACE}, '', 'g')"


def clean(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '[\t\n\f\r ]+', ' ', 'g')"


LEAD = r"'(?i)^\s*(?:engine(?:\s*type|\s*description)?|transmission(?:\s*type)?|trans|drive\s*type|drive\s*line|drive\s*train|driveline|drivetrain|fuel\s*type|body\s*(?:type|style)|exterior\s*color|interior\s*color|ext\s*color|color|cylinders?|horsepower|torque)\s*:\s*'"
FOLLOW = r"'(?is)^(.+?)(?:miles|mileage|odometer|engine|transmission|drive\s*(?:type|train|line)|stock|vin|price|exterior\s*color|interior\s*color|color)\s*:.*$'"
TOKEN = r"'(?i)\bstock\s*#?[:\-]?\s*([a-z0-9\-]+)\b'"
BARE_LABEL = r"'(?i)^\s*(?:stock\s*(?:number|no\.?|#)?)?\s*[#:\-]*\s*$'"


def stock(x: str) -> str:
    s = clean(x)
    tok = f"regexp_extract({s}, {TOKEN}, 1)"
    rest = clean(f"regexp_replace({s}, '^#', '')")
    return f"CASE WHEN {s} = '' THEN '' WHEN {tok} <> '' AND lower(trim({tok}, ' .:#-')) NOT IN ('', 'number', 'num', 'no') THEN upper({tok}) WHEN regexp_matches({rest}, {BARE_LABEL}) THEN '' ELSE upper({rest}) END"


def vin(x: str) -> str:
    v = f"upper({trim(x)})"
    return f"CASE WHEN strlen({v}) = 17 AND NOT regexp_matches({v}, '[IOQ]') AND regexp_matches({v}, '[0-9]') THEN {v} ELSE '' END"


def missing(x: str) -> str:
    return f"upper({clean(x)}) IN ('', 'N/A', 'NA', 'NONE', '—', '-')"


def mileage(x: str) -> str:
    return clean(rf"regexp_replace({clean(x)}, '(?i)^\s*(?:mileage|miles|odometer)\s*[:#\-]?\s*', '')")


def image(x: str) -> str:
    hint = r"'-([0-9]+)x([0-9]+)\.(?:jpg|jpeg|png|webp)(?:[?#]|$)'"
    side = lambda k: f"coalesce(try_cast(regexp_extract(lower({x}), {hint}, {k}) AS INT), 0)"
    return rf"""({x} <> '' AND lower({x}) NOT LIKE 'data:image/%' AND NOT ({side(1)} BETWEEN 1 AND 299 OR {side(2)} BETWEEN 1 AND 299)
      AND NOT regexp_matches(lower({x}), '/logo|logo_|seal|icon-|icon_|favicon|sprite|dealerrater|calendly|/css/|/js/|\.svg')
      AND regexp_matches(lower({x}), 'vehicle|inventory|wp-content/uploads|stock|vin=|new-arrival|new_arrival|coming-soon|no-photo|\.jpg|\.jpeg|\.png|\.webp|/fit-in/|filters:|/resize/|cloudfront\.net|/photos/|cloudflareimages\.dealereprocess\.com'))"""


def style(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'sedan') THEN 'sedan' WHEN contains(lower({x}), 'coupe') THEN 'coupe' WHEN contains(lower({x}), 'hatch') THEN 'hatchback' WHEN contains(lower({x}), 'truck') OR contains(lower({x}), 'pickup') THEN 'truck' WHEN contains(lower({x}), 'suv') OR contains(lower({x}), 'crossover') THEN 'suv' WHEN contains(lower({x}), 'van') THEN 'van' ELSE '' END"


def absolute(base: str, x: str) -> str:
    """For the sample's references: absolute, rooted or empty."""
    return rf"CASE WHEN {x} = '' OR regexp_matches({x}, '^[a-z]+:') THEN {x} ELSE regexp_extract({base}, '^[a-z]+://[^/]*') || {x} END"


def pages(value: str) -> str:
    return f"SELECT page_id, {value} AS value FROM (SELECT page_id, url AS u FROM pages)"


ITEMS = f"items AS ({ITEMS_ORACLE})"
YEAR = r"'\b(19[0-9]{2}|20[0-9]{2})\b'"
#: The sample's items in normal form.
NORMAL = f"""{ITEMS}, n1 AS (SELECT *, {clean('title')} AS t, {stock('stock_id')} AS s, upper({clean('vin')}) AS v, {absolute('source_url', 'url')} AS link, {absolute('source_url', 'primary_image')} AS img FROM items),
n2 AS (SELECT *, CASE WHEN {missing('s')} THEN CASE WHEN {vin('v')} <> '' THEN {vin('v')} ELSE regexp_extract(regexp_extract(link, {RE}, 5), '/([0-9]+)/*$', 1) END ELSE s END AS sid, CASE WHEN {image('img')} THEN img ELSE '' END AS pic, string_split(t, ' ') AS w FROM n1),
n3 AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches(x, {YEAR})), true) AS ypos FROM n2),
n4 AS (SELECT *, CASE WHEN coalesce(ypos, 0) > 0 THEN ypos ELSE 1 END AS st FROM n3),
norm AS (SELECT seq, dealer_id, source_url, t AS title, sid AS "stockId", v AS vin, link AS url, {clean('price')} AS price, {mileage('mileage')} AS mileage, pic AS "primaryImage", regexp_extract(t, {YEAR}, 1) AS year,
  CASE WHEN len(w) > st + 1 THEN w[st + 1] ELSE '' END AS make,
  CASE WHEN len(w) > st + 1 THEN CASE WHEN len(w) > st + 2 AND upper(w[st + 2]) IN ('MODEL', 'GRAND', 'SANTA') THEN w[st + 2] || ' ' || w[st + 3] ELSE w[st + 2] END ELSE '' END AS model FROM n4)"""
KEY = f"""CASE WHEN upper("stockId") <> '' THEN 'stock:' || upper("stockId") WHEN upper(vin) <> '' THEN 'vin:' || upper(vin) WHEN url <> '' THEN 'url:' || {CANONICAL.replace('(u,', '(url,')}
  WHEN "primaryImage" <> '' AND contains(regexp_extract(regexp_extract("primaryImage", {RE}, 5), '[^/]*$'), '.') THEN 'img:' || {CANONICAL.replace('(u,', '("primaryImage",')}
  WHEN trim(lower(title || '|' || year || '|' || make || '|' || model || '|' || mileage || '|' || price), '|') <> '' THEN 'content:' || lower(trim(title || '|' || year || '|' || make || '|' || model || '|' || mileage || '|' || price)) ELSE '' END"""
CREDIBLE = f"""({vin('vin')} <> '' OR (NOT ({missing(stock('stock_id'))}) AND (trim(url) <> '' OR trim(title || price || mileage || primary_image) <> '')) OR (trim(url) <> '' AND trim(title || price || mileage || primary_image) <> ''))"""
SIGNALS = "(title <> '')::INT + (stock_id <> '')::INT + (price <> '')::INT + (mileage <> '')::INT + (primary_image <> '')::INT + (vin <> '')::INT"
CACHED = "(SELECT url AS source_url, to_timestamp(1705276800 + (page_id * 3571) % 432000) AT TIME ZONE 'UTC' AS updated_at, page_id % 40 AS items FROM pages WHERE page_id % 3 <> 0)"
MARKERS = ("sorry, you have been blocked", "cf-chl-", "captcha-delivery.com", "access denied", "just a moment", "verify you are human")
MARKER = "CASE " + " ".join(f"WHEN contains(lower(x), '{m}') THEN '{m}'" for m in MARKERS) + " ELSE '' END"
REDACT = r"""regexp_replace(regexp_replace(regexp_replace(x, '(?i)((?:https?|socks5?|ftp)://)(?:[^\s<>"''/?#@]*@)?([^\s<>"''/?#]+)([^\s<>"''?#]*)(?:[?#][^\s<>"'']*)?', '\1\2\3', 'g'),
  '(?i)(authorization|proxy-authorization|cookie|set-cookie|api[_-]?key|service[_-]?key|access[_-]?token|refresh[_-]?token|token|datadome|password|secret)(["'']?[\t\n\f\r ]*[:=][\t\n\f\r ]*)([^\r\n]+)', '\1\2[redacted]', 'g'), '(?i)bearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g')"""


def at_most(x: str, limit: int, more: str = "") -> str:
    """The longest prefix of whole characters within so many bytes."""
    return f"CASE WHEN strlen({x}) <= {limit} THEN {x} ELSE (SELECT substr({x}, 1, max(i)) FROM (SELECT unnest(range({limit // 4}, {limit + 1})) AS i) WHERE strlen(substr({x}, 1, i)) <= {limit}) || '{more}' END"


ORACLE_SQL = {
    "url_key_canonical": pages(CANONICAL),
    "url_key_cache": pages(CACHE),
    "url_key_source": pages(SOURCE),
    "url_key_template": pages(TEMPLATE),
    "url_host": pages(HOST),
    "diagnostic_url": pages(f"{P['scheme_']} || '//' || regexp_replace({P['auth']}, '^.*@', '') || {P['path']}"),
    "page_number_param": pages(PAGE),
    "score_listing_url": pages(SCORE),
    "paging_url": pages(r"regexp_matches(lower(u), '/page/|page=|offset=|pagenum=|pagesize=|[?&]p=|/inventory|/used-cars|/cars-for-sale') AND NOT contains(lower(u), '/vehicle-details/')"),
    "template_file_name": pages(f"'urlkey_' || rtrim(translate(base64(encode({TEMPLATE})), '+/', '-_'), '=')"),
    "template_key_round_trip": pages(TEMPLATE),
    "url_valid_unsafe": pages(f"({P['scheme']} <> '' AND {P['auth']} <> '')::VARCHAR || ',' || ({NAME} = '' OR lower({NAME}) = 'localhost')::VARCHAR"),
    "resolve_relative": pages(f"{P['scheme_']} || {P['auth_']} || coalesce(nullif(regexp_replace(regexp_replace({P['path']}, '[^/]*$', ''), '[^/]+/$', ''), ''), '/') || 'next/page?p=2#top'"),
    "bare_self_link": pages("true"),
    "page_diagnostics": rf"SELECT page_id, strlen(html) AS bytes, sha256(html) AS body_sha256, {at_most('title', 200)} AS title, {MARKER} AS block_marker FROM (SELECT page_id, html, html AS x, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)",
    "page_dedupe_by_key": f"SELECT key, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {CANONICAL} AS key FROM (SELECT page_id, url AS u FROM pages)) GROUP BY key",
    "host_counts": f"SELECT host, count(DISTINCT key) AS pages FROM (SELECT {HOST} AS host, {CANONICAL} AS key FROM (SELECT url AS u FROM pages)) GROUP BY host",
    "anchor_candidates": rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>', 1), 1) AS pos FROM pages),
      b AS (SELECT page_id, pos, {absolute('url', 'href')} AS link, {clean("regexp_replace(label, '<[^>]*>', '', 'g')")} AS label FROM a), c AS (SELECT page_id, link, label, min(pos) AS pos FROM b GROUP BY ALL)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, link, {at_most('label', 280)} AS label FROM c QUALIFY place <= 120""",
    "next_page_urls": rf"SELECT page_id, regexp_replace(u, '([?&]page=)[0-9]+', '\1' || n) AS next_url FROM (SELECT page_id, u, {PAGE} AS cur FROM (SELECT page_id, url AS u FROM pages)), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE cur > 0 AND n > cur",
    "redact_text": f"SELECT doc_id, md5({at_most('y', 3000, ' [truncated]')}) AS redacted_md5 FROM (SELECT doc_id, {REDACT} AS y FROM (SELECT doc_id, text AS x FROM documents))",
    "block_predicate": f"SELECT kind, id, contains(lower(x), 'captcha-delivery.com') OR (strlen(x) < 4000 AND contains(lower(x), 'datadome')) AS challenge, {MARKER} AS marker FROM (SELECT 'page' AS kind, page_id AS id, html AS x FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)",
    "clean_text": f"SELECT doc_id, md5({clean('text')}) AS cleaned_md5 FROM documents",
    "first_number": r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM documents",
    "strip_label": f"SELECT p_partkey, CASE WHEN regexp_matches(v, {FOLLOW}) THEN {clean(f'regexp_extract(v, {FOLLOW}, 1)')} ELSE v END AS value FROM (SELECT p_partkey, {clean(f'regexp_replace({clean('x')}, {LEAD}, {chr(39)}{chr(39)})')} AS v FROM (SELECT p_partkey, ' Engine : ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN 'Miles: 43K' ELSE '' END AS x FROM part))",
    "mileage_norm": f"WITH {ITEMS} SELECT seq, {mileage('mileage')} AS value FROM items",
    "stock_norm": f"WITH {ITEMS}, s AS (SELECT seq, {stock('stock_id')} AS value FROM items) SELECT seq, value, {missing('value')} AS missing, CASE WHEN value = '' OR lower(trim(value, ' .:#-')) IN ('', 'number', 'num', 'no') OR regexp_matches(value, '^(?:19|20)[0-9]{{2}}$') OR NOT regexp_matches(value, '[0-9]') THEN '' ELSE value END AS plausible FROM s",
    "vin_valid": f"WITH {ITEMS} SELECT seq, {vin('vin')} AS valid, CASE WHEN regexp_matches(upper(substr(vin, 1, 13)), '^[A-Z0-9]{{11,16}}$') AND regexp_matches(substr(vin, 1, 13), '[0-9]') THEN upper(substr(vin, 1, 13)) ELSE '' END AS short, CASE WHEN regexp_matches(upper(vin), '^[A-HJ-NPR-Z0-9]{{17}}$') THEN {vin('vin')} ELSE '' END AS in_text FROM items",
    "vin_from_path": f"WITH {ITEMS} SELECT seq, CASE WHEN regexp_matches(upper(vin), '^[A-HJ-NPR-Z0-9]{{17}}$') THEN {vin('vin')} ELSE '' END AS value FROM items",
    "listing_id": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS value FROM orders",
    "mpg_conversion": "SELECT p_partkey, p_size || ' MPG' AS mpg, CASE WHEN p_size > 0 THEN printf('%.2f', p_size / 3.785411784::DOUBLE) || ' mi/L' ELSE '' END AS mpl FROM part",
    "image_likely": f"WITH {ITEMS} SELECT seq, {image('primary_image')} AS likely, NOT ((seq % 700) BETWEEN 1 AND 299) AS sized FROM items",
    "image_filter_size": "SELECT p_partkey, '/img/' || p_partkey || '.jpg' AS url FROM part WHERE p_partkey % 5 = 0 OR (p_size * 20 >= 300 AND p_size * 15 >= 300)",
    "normalize_items": f'WITH {NORMAL} SELECT seq, title, "stockId", vin, url, price, mileage, "primaryImage", year, make, model FROM norm',
    "title_make_model": f"WITH {NORMAL} SELECT year, make, model, count(*) AS n FROM norm GROUP BY ALL",
    "infer_style": f"WITH {ITEMS} SELECT seq, {style('title')} AS style FROM items",
    "item_aliases": f"""WITH {ITEMS} SELECT seq, stock_id AS stock, source_url AS website, dealer_id AS "dealerId", price AS "vehicleListPrice", {style('title')} AS style, (primary_image <> '')::INT AS photos FROM items""",
    "dedupe_keys": f"WITH {NORMAL} SELECT seq, {KEY} AS key FROM norm",
    "dedupe_items": f"""WITH {NORMAL}, k AS (SELECT *, {KEY} AS key FROM norm), f AS (SELECT *, arg_min(vin, seq) FILTER (vin <> '') OVER (PARTITION BY dealer_id, key) AS fv FROM k WHERE key <> ''),
      g AS (SELECT *, CASE WHEN vin <> '' AND vin <> fv THEN 'vin:' || vin ELSE key END AS grp FROM f)
      SELECT dealer_id, grp, min(seq) AS seq, count(*) AS n, {", ".join(f'coalesce(arg_min("{c}", seq) FILTER ("{c}" <> {chr(39)}{chr(39)}), {chr(39)}{chr(39)}) AS "{c}"' for c in ("vin", "url", "price", "mileage", "primaryImage"))} FROM g GROUP BY dealer_id, grp""",
    "merge_fill_missing": f"WITH {ITEMS} SELECT seq, CASE WHEN trim(price) = '' THEN coalesce('$' || floor(s_acctbal)::BIGINT, price) ELSE price END AS price, CASE WHEN trim(mileage) = '' THEN coalesce(s_name, mileage) ELSE mileage END AS mileage FROM items LEFT JOIN supplier ON dealer_id = s_suppkey::VARCHAR",
    "valid_items": f"""WITH {ITEMS}, s AS (SELECT *, {SIGNALS} AS sig, {SCORE.replace('(u)', '(url)').replace('(u,', '(url,')} AS score FROM items) SELECT seq, {CREDIBLE} AS credible, (score >= 8 OR (score >= 3 AND sig >= 2) OR (stock_id <> '' AND sig >= 2) OR (title <> '' AND (price <> '' OR primary_image <> ''))) AS useful,
      trim(title) <> '' AND url <> '' AND vin <> '' AND trim(stock_id) <> '' AND price <> '' AND mileage <> '' AND primary_image <> '' AS complete FROM s""",
    "invalid_count": f"WITH {ITEMS} SELECT dealer_id, 'INVALID_ITEMS_FILTERED' AS code, 'filtered ' || count(*) || ' invalid items' AS message FROM items WHERE NOT {CREDIBLE} GROUP BY dealer_id",
    "inventory_counts": f"""WITH {NORMAL}, c AS (SELECT dealer_id, nullif(upper(vin), '') AS v, nullif(upper("stockId"), '') AS s FROM norm), d AS (SELECT dealer_id, count(DISTINCT v) AS unique_vins, count(DISTINCT s) AS unique_stocks, count(DISTINCT coalesce('vin:' || v, 'stock:' || s)) AS identities, count(*) AS n FROM c GROUP BY dealer_id)
      SELECT dealer_id, unique_vins, unique_stocks, identities, CASE WHEN identities > 0 THEN identities ELSE n END AS inventory FROM d""",
    "details_needed": f"""WITH {ITEMS}, f AS (SELECT dealer_id, url, min(seq) AS seq FROM items WHERE url <> '' AND NOT (trim(title) <> '' AND vin <> '' AND trim(stock_id) <> '' AND price <> '' AND mileage <> '' AND primary_image <> '') GROUP BY ALL)
      SELECT dealer_id, url, row_number() OVER (PARTITION BY dealer_id ORDER BY seq) AS place, greatest(count(*) OVER (PARTITION BY dealer_id) - 100, 0) AS cut FROM f QUALIFY place <= 100""",
    "detail_join": "SELECT 'V' || l_partkey AS own, CASE WHEN p_partkey % 2 = 0 THEN '/car/' || p_name ELSE '/vehicle/v' || l_partkey || '/' END AS url, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "strict_snapshot": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_partkey) AND count(*) = count(DISTINCT l_suppkey) AND count(*) = max(l_linenumber))",
    "listing_post_join": "WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 20 AS run FROM orders), p AS (SELECT * FROM customer WHERE c_custkey % 50 <> 0), bad AS (SELECT DISTINCT run FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM p)) SELECT o_orderkey, run, n_name FROM o JOIN p ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE run NOT IN (SELECT run FROM bad)",
    "json_pick": "SELECT event_id, '' AS page, coalesce(nullif(trim(props->>'$.k'), ''), '') AS other FROM events",
    "regex_extract_rows": r"""SELECT doc_id, (unnest(range(len(f))))::INT AS pos, unnest(f) AS value FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:key|token|secret)\s*[:=]\s*"?([A-Za-z0-9]+)', 1) AS f FROM documents)""",
    "run_status": "SELECT user_id, items, errors, CASE WHEN items = 0 THEN 'failed' WHEN errors > 0 THEN 'partial_success' ELSE 'success' END AS status, first_error FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS items, count(*) FILTER (event_type = 'error') AS errors, arg_min(event_id, ts) FILTER (event_type = 'error') AS first_error FROM events GROUP BY user_id)",
    "ring_bound": "SELECT log, event_id, place, dropped FROM (SELECT user_id % 5 AS log, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS place, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) AS back, greatest(count(*) OVER (PARTITION BY user_id % 5) - 160, 0) AS dropped FROM events) WHERE place <= 16 OR back <= 144",
    "latest_per_host": f"SELECT host, source_url, updated_at, items FROM (SELECT {HOST} AS host, * FROM (SELECT *, source_url AS u FROM {CACHED})) QUALIFY row_number() OVER (PARTITION BY host ORDER BY updated_at DESC, source_url DESC) = 1",
    "cache_lookup": f"""WITH c AS (SELECT {CACHE} AS key, {HOST} AS host, source_url, updated_at FROM (SELECT *, source_url AS u FROM {CACHED})), e AS (SELECT key, arg_max(source_url, (updated_at, source_url)) AS eu FROM c GROUP BY key), h AS (SELECT host, arg_max(source_url, (updated_at, source_url)) AS hu FROM c GROUP BY host)
      SELECT u AS request_url, coalesce(eu, hu) AS cached_url, CASE WHEN eu IS NOT NULL THEN 'exact' WHEN hu IS NOT NULL THEN 'host' ELSE 'none' END AS how FROM (SELECT u, {CACHE} AS key, {HOST} AS host FROM (SELECT url AS u FROM pages)) LEFT JOIN e USING (key) LEFT JOIN h USING (host)""",
    "cache_fresh_24h": "SELECT event_id, coalesce(event_type <> 'error' AND floor(value) > 0 AND ts <= TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20' < ts + INTERVAL 24 HOURS, false) AS fresh FROM events",
    "pending_sync": f"""WITH c AS (SELECT {CACHE} AS key, max(updated_at) AS updated_at, arg_max(items, (updated_at, source_url)) AS items FROM (SELECT *, source_url AS u FROM {CACHED}) GROUP BY 1), b AS (SELECT url AS u, 0 AS r FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT url, 1 FROM pages WHERE page_id % 6 <= 1),
      o AS (SELECT {CACHE} AS key, arg_min(u, (r, u)) AS source_url FROM b GROUP BY 1) SELECT key, source_url, age_hours, coalesce(items, 0) AS items FROM (SELECT key, source_url, (epoch(TIMESTAMP '2024-01-20') - epoch(updated_at)) / 3600.0::DOUBLE AS age_hours, items FROM o LEFT JOIN c USING (key)) WHERE age_hours IS NULL OR age_hours >= 12""",
    "shrink_guard": "SELECT l_suppkey, old, new, old = 0 OR new >= old * 0.6 AS kept FROM (SELECT l_suppkey, count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS old, count(*) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') AS new FROM lineitem GROUP BY l_suppkey)",
    "schedule_match": """SELECT c_custkey, kind = 'daily' AS daily, kind = 'weekly' AS weekly, c_custkey % 3 = 0 AS ftp, c_custkey % 4 <> 1 AS scrape, c_custkey % 5 = 0 AND c_custkey % 2 = 1 AS sheet FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'weekly' ELSE 'daily' END END AS kind FROM customer)""",
    "keyed_upsert": "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "keyed_delete": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "elided_pages": "WITH l AS (SELECT l_orderkey, max(l_linenumber) * 2 AS top FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, unnest(range(2, top + 1))::INT AS page FROM l) SELECT l_orderkey, page FROM p ANTI JOIN (SELECT l_orderkey, (l_linenumber * 2)::INT AS page FROM lineitem) USING (l_orderkey, page)",
    "metrics_rollup": "SELECT event_type AS status, count(*) AS runs, count(*) AS items, sum(floor(value)::BIGINT)::BIGINT AS seconds FROM events GROUP BY 1",
    "scoped_keys": f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'k' || page_id || '|d1|' || {SOURCE} ELSE '' END AS scoped, 'scrape-once-cache|d1|' || {SOURCE} AS once FROM (SELECT page_id, url AS u FROM pages)",
    "error_predicates": "SELECT doc_id, regexp_matches(lower(text), 'datadome|captcha-delivery|blocked|all strategies failed') AS block, regexp_matches(lower(text), 'deadline exceeded|client\\.timeout|timeout|temporary|connection reset|eof') AS timeout FROM documents",
    "run_errors": "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS items FROM events GROUP BY 1), e AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'FALLBACK_EMPTY' ELSE 'OTHER' END AS code, event_id::VARCHAR AS message FROM events WHERE event_type = 'error') SELECT user_id, code, message FROM e JOIN c USING (user_id) WHERE NOT (code = 'FALLBACK_EMPTY' AND items > 0) UNION ALL SELECT user_id, 'NO_ITEMS', 'no items found' FROM c WHERE items = 0",
    "dom_extract": f"WITH p AS (SELECT {HOST} AS run_id, page_id, html FROM (SELECT page_id, html, url AS u FROM pages)), q AS (SELECT run_id, html, row_number() OVER (PARTITION BY run_id ORDER BY page_id)::INT AS page_seq FROM p) SELECT run_id, page_seq, 0::INT AS pos, {clean(r"replace(replace(replace(regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS title FROM q WHERE contains(html, '<article>')",
    "platform_imotor": "SELECT p_partkey::VARCHAR AS \"stockId\", (1990 + p_size) || ' ' || p_brand || ' ' || p_type AS title, '/' || CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'used' END || '-trucks/for-sale/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '/' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') || '/' || (1990 + p_size) || '/' || p_partkey || '/' AS url FROM part WHERE p_partkey > 0",
    "platform_dealer_sync": "SELECT DISTINCT 'v' || p_partkey % 90 AS vin, 1 AS n FROM part",
    "platform_space_auto": "SELECT p_brand AS title, CASE WHEN p_partkey % 3 = 0 THEN '/car/' || p_partkey ELSE '/vehicle/v' || p_partkey || '/' END AS url, '$' || format('{:,}', floor(p_retailprice)::BIGINT) AS price, CASE WHEN p_partkey > 0 THEN format('{:,}', p_partkey * 7) ELSE '' END AS mileage FROM part",
    "paging_urls": f"SELECT page_id, greatest(n - greatest(p, 1), 0)::INT AS counted, greatest(ceil(n * 1.5)::INT - 1, 0)::INT AS offsets, greatest(n - 1, 0)::INT AS stated FROM (SELECT page_id, (page_id % 4)::INT AS n, greatest(coalesce(try_cast(regexp_extract(u, '[?&]page=([^&#]*)', 1) AS INT), 0), 0) AS p FROM (SELECT page_id, url AS u FROM pages))",
    "inventory_total": "SELECT p_partkey, (p_partkey * 7)::INT AS total FROM part",
    "capped_items": f"WITH {ITEMS} SELECT dealer_id, seq FROM items QUALIFY row_number() OVER (PARTITION BY dealer_id ORDER BY seq) <= 20",
    "template_resolution": f"WITH p AS (SELECT page_id, {HOST} AS host FROM (SELECT page_id, url AS u FROM pages)) SELECT page_id, host FROM p WHERE host IN (SELECT host FROM p GROUP BY host HAVING min(page_id) % 2 = 0)",
}

ORACLE_SQL["cache_routing"] = """WITH p AS (SELECT page_id, page_id % 97 AS k, CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || page_id % 97 || '?' || page_id % 5 AS u FROM pages)
  SELECT page_id, k = 50 OR k IN (SELECT k FROM p WHERE k < 10 AND page_id % 5 = 0) OR u IN (SELECT u FROM p WHERE k >= 90 AND page_id % 5 = 1) AS from_cache FROM p"""
ORACLE_SQL["cache_answers"] = f"""WITH l AS ({ORACLE_SQL["cache_lookup"]}), c AS (SELECT source_url, arg_max(items, (updated_at, items)) AS n FROM {CACHED} GROUP BY source_url)
  SELECT request_url, cached_url, CASE WHEN cached_url IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN cached_url IS NULL THEN 'CACHE_NOT_FOUND' ELSE '' END AS code,
  CASE WHEN cached_url IS NULL THEN '' ELSE 'completed_from_cache' END AS progress_stage, coalesce(n, 0) AS total_items, coalesce(n, 0) AS success_items, (cached_url IS NOT NULL)::INT AS attempts
  FROM l LEFT JOIN c ON cached_url = source_url"""
ORACLE_SQL["failure_retries"] = """SELECT user_id, count(*) FILTER (event_type = 'purchase' AND user_id % 3 = 0) = 0 AND count(*) FILTER (event_type = 'error' AND event_id % 7 = 0) = 0 AS retry,
  count(*) FILTER (event_type = 'error' AND event_id % 7 <> 0 AND event_id % 3 = 0) AS transient FROM events GROUP BY user_id"""
ORACLE_SQL["shown_counts"] = """SELECT event_id, CASE WHEN event_type = 'purchase' AND event_id % 4 = 1 THEN 0 WHEN event_id % 3 > 0 THEN event_id % 3 WHEN event_id % 5 = 0 THEN event_id % 7 ELSE event_id % 5 END AS shown FROM events"""
ORACLE_SQL["site_freshness"] = """WITH i AS (SELECT l_orderkey AS o, l_partkey AS p, '1HGCM82633A' || lpad((l_partkey % 1000000)::VARCHAR, 6, '0') AS v FROM lineitem),
  s AS (SELECT o, p, v, CASE WHEN p % 11 = 0 THEN '' WHEN p % 13 = 0 THEN v WHEN p % 17 = 0 THEN 'N/A' ELSE 'S' || p END AS s FROM i),
  c AS (SELECT o, bool_or(p % 11 = 0 OR p % 13 = 0) AS poor, bool_or(p % 19 = 0 OR s = 'N/A') OR count(*) > count(DISTINCT s) OR count(*) > count(DISTINCT v) AS odd FROM s GROUP BY o)
  SELECT o_orderkey, o_orderkey % 5 <> 0 AND CASE o_orderkey % 3 WHEN 0 THEN NOT coalesce(poor OR odd, false) WHEN 1 THEN NOT coalesce(poor, false) ELSE true END AS fresh FROM orders LEFT JOIN c ON o = o_orderkey"""
ORACLE_SQL["idempotency_lookup"] = """SELECT c_custkey, max(o_orderkey) AS o_orderkey, max(o_orderkey) % 3 <> 0 AS same FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 7 <> 0 GROUP BY c_custkey"""
ORACLE_SQL["idempotency_release"] = """SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN '' ELSE 'k' || o_custkey END AS "idempotencyKey" FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def _dedupe_sql() -> str:
    """Each group folded in order by the rule for two rows, then rows without identity into the first with one of their URL."""
    first = lambda n: f"'{n}': CASE WHEN a.\"{n}\" = '' THEN b.\"{n}\" ELSE a.\"{n}\" END"
    priced = lambda x: f"regexp_matches(trim({x}), '^\\$?\\s*[0-9][0-9,]*(?:\\.[0-9]{{2}})?$')"
    longer = "trim(a.model) <> '' AND length(trim(b.model)) > length(trim(a.model)) AND lower(substr(trim(b.model), 1, length(trim(a.model)))) = lower(trim(a.model)) AND substr(trim(b.model), length(trim(a.model)) + 1, 1) = ' '"
    images = "list_concat(a.images, list_filter(b.images, lambda x: NOT list_contains(a.images, x)))"
    fold = f"""list_reduce(rows, lambda a, b: {{'seq': a.seq, 'stockId': a."stockId", {", ".join(map(first, ("vin", "url", "price", "mileage")))}, 'title': CASE WHEN a.title = '' OR ({priced("a.title")} AND NOT {priced("b.title")}) THEN b.title ELSE a.title END,
      'model': CASE WHEN a.model = '' OR ({longer}) THEN b.model ELSE a.model END, 'primaryImage': CASE WHEN a."primaryImage" <> '' THEN a."primaryImage" WHEN b."primaryImage" <> '' THEN b."primaryImage" ELSE coalesce(({images})[1], '') END, 'images': {images}}})"""
    names = ("seq", "stockId", "vin", "url", "price", "mileage", "title", "model", "primaryImage", "images")
    row = "{" + ", ".join(f"'{n}': \"{n}\"" for n in names) + "}"
    return f"""WITH {NORMAL}, k AS (SELECT *, {KEY} AS key, CASE WHEN "primaryImage" = '' THEN []::VARCHAR[] ELSE ["primaryImage"] END AS images FROM norm), f AS (SELECT *, arg_min(vin, seq) FILTER (vin <> '') OVER (PARTITION BY dealer_id, key) AS fv FROM k WHERE key <> ''),
      g AS (SELECT dealer_id, CASE WHEN vin <> '' AND vin <> fv THEN 'vin:' || vin ELSE key END AS grp, list({row} ORDER BY seq) AS rows FROM f GROUP BY ALL), m AS (SELECT dealer_id, unnest({fold}) FROM g),
      s AS (SELECT *, "stockId" <> '' OR vin <> '' AS strong, CASE WHEN url = '' THEN '' ELSE {CANONICAL.replace('(u,', '(url,')} END AS link FROM m), t AS (SELECT dealer_id, link, min(seq) AS target FROM s WHERE strong AND link <> '' GROUP BY ALL),
      h AS (SELECT s.dealer_id, CASE WHEN strong THEN seq ELSE coalesce(target, seq) END AS home, list({row} ORDER BY strong DESC, seq) AS rows FROM s LEFT JOIN t ON t.dealer_id = s.dealer_id AND t.link = s.link GROUP BY ALL), w AS (SELECT dealer_id, unnest({fold}) FROM h)
      SELECT dealer_id, seq, "stockId", vin, url, title, model, price, mileage, "primaryImage", len(images)::INT AS n_images FROM w"""


ORACLE_SQL["dedupe_items_full"] = _dedupe_sql()
ORACLE_SQL |= landed.SQL
