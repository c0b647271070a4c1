"""URL expressions: the four keys, hosts, predicates, resolution. URLs are split by one pattern and never raise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import byte_prefix, trim

#: The generic splitter of RFC 3986: scheme 2, authority 4, path 5, query 6 with its mark, fragment 8 with its mark.
PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
#: What ``PARTS`` gives as scheme and authority, with their marks.
ROOT = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?"
# Words of paging links, and listing-link scores.
PAGING_WORDS = ("/page/", "page=", "offset=", "pagenum=", "pagesize=", "?p=", "&p=", "/inventory", "/used-cars", "/cars-for-sale")


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return part(url, 2)


def authority(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    """The query with its question mark, or ''."""
    return part(url, 6)


def hostname(url: Column) -> Column:
    """The authority without credentials and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":[0-9]*$", "")


def _cut_slash(p: Column, root: bool = True) -> Column:
    cut = F.regexp_replace(p, "/$", "")
    return F.when(p == "/", p).otherwise(cut) if root else cut


def canonical_key(url: Column) -> Column:
    """For duplicates: everything in lower case, no query and fragment, one last slash cut unless the path is ``/``."""
    bare = F.substring_index(F.substring_index(trim(url), "?", 1), "#", 1)
    has_path = F.length(bare) > F.length(F.regexp_extract(bare, ROOT, 0)) + 1
    return F.lower(F.when(has_path, F.regexp_replace(bare, "/$", "")).otherwise(bare))


def cache_key(url: Column) -> Column:
    """For caches and flags: scheme and host in lower case, path and query kept, no fragment, one last slash cut."""
    u = trim(url)
    return F.concat(F.lower(part(u, 1)), F.lower(part(u, 3)), _cut_slash(path(u)), query(u))


def source_key(url: Column) -> Column:
    """For runs: everything but the query in lower case, one last slash cut even from a root."""
    u = trim(url)
    return F.concat(F.lower(part(u, 1)), F.lower(part(u, 3)), _cut_slash(F.lower(path(u)), root=False), query(u))


def template_key(url: Column) -> Column:
    """For templates: ``url::`` host without port and path in lower case without outer slashes, ``_root`` for an empty one."""
    p = F.regexp_replace(F.lower(path(trim(url))), "^/+|/+$", "")
    return F.concat(F.lit("url::"), F.lower(hostname(trim(url))), F.lit("/"), F.when(p == "", "_root").otherwise(p))


def host_key(url: Column) -> Column:
    """``www.`` is cut before lower-casing, so ``WWW.`` stays."""
    return F.lower(F.regexp_replace(hostname(trim(url)), r"^www\.", ""))


def template_file(key: Column) -> Column:
    """``urlkey_`` and the unpadded URL-safe base64 of the key."""
    return F.concat(F.lit("urlkey_"), F.rtrim(F.translate(F.base64(key.cast("binary")), "+/", "-_"), F.lit("=")))


def template_key_of_file(name: Column) -> Column:
    coded = F.translate(F.regexp_replace(name, "^urlkey_", ""), "-_", "+/")
    padded = F.rpad(coded, F.ceil(F.length(coded) / 4).cast("int") * 4, F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def diagnostic_url(url: Column) -> Column:
    """Without credentials, query and fragment, cut at 600 bytes; without a host ``[invalid URL]``."""
    bare = F.concat(part(url, 1), F.lit("//"), F.regexp_replace(authority(url), "^.*@", ""), path(url))
    return F.when(url == "", "").when(authority(url) == "", "[invalid URL]").otherwise(byte_prefix(bare, 600))


def is_valid(url: Column) -> Column:
    return (scheme(url) != "") & (authority(url) != "")


def is_unsafe(url: Column) -> Column:
    """No host, this machine, or a loopback, private or link-local address."""
    h = F.lower(hostname(url))
    private = r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$)|^\[?(::1|::|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)\]?$"
    return (h == "") | (h == "localhost") | h.endswith(".localhost") | h.rlike(private)


def same_host(a: Column, b: Column) -> Column:
    return F.lower(hostname(a)) == F.lower(hostname(b))


def is_paging(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike("|".join(re.escape(w) for w in PAGING_WORDS)) & ~low.contains("/vehicle-details/")


def is_bare_self_link(page: Column, url: Column) -> Column:
    bare = lambda u: F.lower(F.regexp_replace(path(u), "^/+|/+$", ""))
    return (F.regexp_extract(url, r"\?([^#]*)", 1) == "") & (bare(url) == bare(page))


def query_int(url: Column, name: str) -> Column:
    """A query parameter as a non-negative number, else 0."""
    raw = F.regexp_extract(query(url), rf"[?&]{name}=([^&]*)", 1)
    return F.greatest(F.coalesce(F.nullif(F.trim(raw), F.lit("")).try_cast("int"), F.lit(0)), F.lit(0))


def page_number(url: Column) -> Column:
    return F.coalesce(F.nullif(query_int(url, "PageNumber"), F.lit(0)), query_int(url, "page"))


def resolve(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of a reference; an absolute one is returned as it is, an empty one stays empty.

    The common references need no splitting: those of the web's schemes stay, and a path from the root without dot segments
    follows the base's root as it is.
    """
    root = F.regexp_extract(base, ROOT, 0)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.concat(folder, path(ref))
    target = F.when(path(ref) == "", F.when(query(ref) == "", F.concat(path(base), query(base))).otherwise(F.concat(path(base), query(ref)))).when(path(ref).startswith("/"), F.concat(remove_dots(path(ref)), query(ref))).otherwise(F.concat(remove_dots(joined), query(ref)))
    whole = (ref == "") | ref.startswith("https://") | ref.startswith("http://")
    plain = ref.startswith("/") & ~ref.startswith("//") & ~ref.contains("/.")
    return F.when(whole, ref).when(plain, F.concat(root, ref)).when(scheme(ref) != "", ref).when(ref.startswith("//"), F.concat(part(base, 1), ref)).otherwise(F.concat(root, target, part(ref, 8)))


def remove_dots(p: Column) -> Column:
    """Dot segments of an absolute path, folded left to right."""
    steps = F.split(p, "/")
    last = F.element_at(steps, -1)

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array(F.lit("")), step)
    out = F.array_join(kept, "/")
    return F.when(last.isin(".", ".."), F.concat(out, F.lit("/"))).when(p.contains("/."), F.when(out == "", "/").otherwise(out)).otherwise(p)
