"""Text expressions: cleaning, labels, numbers, style words, redaction. All take and give Columns; '' means missing."""

from __future__ import annotations

import json
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (fixed value): what is trimmed at either end.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Field labels that values arrive with, and how redaction finds URLs and secrets.
LEADING_LABEL = r"(?i)^[\t\n\f\r ]*(?:engine(?:[\t\n\f\r ]*type|[\t\n\f\r ]*description)?|transmission(?:[\t\n\f\r ]*type)?|trans|drive[\t\n\f\r ]*type|drive[\t\n\f\r ]*line|drive[\t\n\f\r ]*train|driveline|drivetrain|fuel[\t\n\f\r ]*type|body[\t\n\f\r ]*(?:type|style)|exterior[\t\n\f\r ]*color|interior[\t\n\f\r ]*color|ext[\t\n\f\r ]*color|color|cylinders?|horsepower|torque)[\t\n\f\r ]*:[\t\n\f\r ]*"
FOLLOWING_LABEL = r"(?i)(?:miles|mileage|odometer|engine|transmission|drive[\t\n\f\r ]*(?:type|train|line)|stock|vin|price|exterior[\t\n\f\r ]*color|interior[\t\n\f\r ]*color|color)[\t\n\f\r ]*:"
MILEAGE_LABEL = r"(?i)^[\t\n\f\r ]*(?:mileage|miles|odometer)[\t\n\f\r ]*[:#\-]?[\t\n\f\r ]*"
SECRET_FIELD = r"""(?i)(authorization|proxy-authorization|cookie|set-cookie|api[_-]?key|service[_-]?key|access[_-]?token|refresh[_-]?token|token|datadome|password|secret)(["']?[\t\n\f\r ]*[:=][\t\n\f\r ]*)([^\r\n]+)"""
BEARER = r"(?i)bearer[\t\n\f\r ]+[a-z0-9._~+/=-]+"
TEXT_LIMIT = 3000
STYLES = (("sedan", ("sedan",)), ("coupe", ("coupe",)), ("hatchback", ("hatch",)), ("truck", ("truck", "pickup")), ("suv", ("suv", "crossover")), ("van", ("van", "minivan")))
LITRES_PER_GALLON = 3.785411784


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def clean(c: Column) -> Column:
    """Trimmed, runs of ASCII white space as one space."""
    return F.regexp_replace(trim(c), r"[\t\n\f\r ]+", " ")


def strip_label(c: Column) -> Column:
    """Without a leading ``Label:`` and without what a following label begins, unless it begins the value."""
    v = clean(F.regexp_replace(clean(c), LEADING_LABEL, ""))
    at = F.regexp_instr(v, F.lit(FOLLOWING_LABEL))
    return F.when(at > 1, clean(v.substr(F.lit(1), at - 1))).otherwise(v)


def mileage(c: Column) -> Column:
    return clean(F.regexp_replace(clean(c), MILEAGE_LABEL, ""))


def first_number(c: Column) -> Column:
    """The first decimal literal, as a double; null without one."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def two_decimals(c: Column) -> Column:
    """Half-even at two decimals, as C's printf."""
    return F.format_string("%.2f", F.bround(c, 2))


def mpg_value(c: Column) -> Column:
    n = first_number(c)
    short = F.regexp_replace(n.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    return F.when(n.isNull(), c).otherwise(F.concat(short, F.lit(" MPG")))


def miles_per_litre(c: Column) -> Column:
    n = first_number(c)
    return F.when(n > 0, F.concat(two_decimals(n / LITRES_PER_GALLON), F.lit(" mi/L"))).otherwise("")


def infer_style(title: Column) -> Column:
    t, out = F.lower(title), F.lit("")
    for style, words in reversed(STYLES):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, style).otherwise(out)
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def byte_prefix(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes of the text; bytes that no longer form a character are dropped."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), 1, limit).cast("string")), "�+$", ""))


def byte_suffix(c: Column, limit: int) -> Column:
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), -limit, limit).cast("string")), "^�+", ""))


def redact(c: Column) -> Column:
    """URLs without credentials, query and fragment, secret fields and bearer tokens blanked, cut at 3,000 bytes."""
    v = F.regexp_replace(c, r"""(?i)((?:https?|socks5?|ftp)://)(?:[^\s<>"'/?#@]*@)?([^\s<>"'/?#]+)([^\s<>"'?#]*)(?:[?#][^\s<>"']*)?""", "$1$2$3")
    v = F.regexp_replace(v, SECRET_FIELD, "$1$2[redacted]")
    v = F.regexp_replace(v, BEARER, "Bearer [redacted]")
    return F.when(F.octet_length(v) > TEXT_LIMIT, F.concat(byte_prefix(v, TEXT_LIMIT), F.lit(" [truncated]"))).otherwise(v)


def split_and_trim(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim), lambda x: x != "")


def or_else(c: Column, default: Column | str) -> Column:
    """``default`` where the text is blank."""
    return F.when(trim(c) == "", default).otherwise(c)


#: Pieces of a text: a reference to a character with or without its end, text between, a lone mark.
_REFERENCES = "&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z0-9]+;?|[^&]+|&"
_LONGEST_BARE = 6


def html_unescape(c: Column) -> Column:
    """HTML's character references as characters: decimal, hexadecimal and named ones, of the old names also those without
    their end, or that begin a longer word. References to no character become U+FFFD, unknown names stay."""
    names = F.from_json(F.lit(json.dumps(entities.html5)), "map<string,string>")  # of the standard library, folded to a literal
    windows = F.from_json(F.lit(json.dumps({str(n): chr(n) if n in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([n]).decode("cp1252") for n in range(0x80, 0xA0)})), "map<string,string>")

    def numbered(t: Column) -> Column:
        hexed = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1)
        digits = F.when(hexed != "", hexed).otherwise(F.regexp_extract(t, "^&#([0-9]+)", 1))
        plain = F.regexp_replace(digits, "^0+(?=.)", "")
        code = F.when(F.length(plain) > 8, F.lit("2000000000")).otherwise(F.when(hexed != "", F.conv(plain, 16, 10)).otherwise(plain)).cast("long")
        bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(code.between(0x80, 0x9F), F.try_element_at(windows, code.cast("string"))).otherwise(made)

    def named(t: Column) -> Column:
        name, body = F.substring(t, 2, 1 << 20), F.regexp_extract(t, "^&([A-Za-z0-9]+)", 1)
        begun = [F.when(F.length(body) > k, F.concat(F.try_element_at(names, F.substring(body, 1, k)), F.substring(name, k + 1, 1 << 20))) for k in range(_LONGEST_BARE, 1, -1)]
        bare = F.when(name.endswith(";") & (F.length(body) <= _LONGEST_BARE), F.concat(F.try_element_at(names, body), F.lit(";")))
        return F.coalesce(F.try_element_at(names, name), bare, *begun, t)

    pieces = F.regexp_extract_all(c, F.lit(_REFERENCES), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, lambda t: F.when(t.startswith("&#") & (F.length(t) > 2), numbered(t)).when(t.startswith("&") & (F.length(t) > 1), named(t)).otherwise(t)), "")).otherwise(c)
