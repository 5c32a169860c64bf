"""Scalar functions (FN-1..22) as Spark columns; null in, null out unless stated. Missing is unknown, never zero."""

import re
from functools import lru_cache
from html import unescape
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

DEFAULT_PORTS = {"http": 80, "https": 443}
PACIFIC = "America/Los_Angeles"
SAFE = 2**53 - 1


# URLs that are their own serialisation: lower-case letters in a host without numbers at its end, and a path and query of
# characters that stay as they are, no segment of which begins with a dot.
_HOST = r"https?://(?:(?!xn--)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?!xn--)[a-z](?:[a-z-]*[a-z])?"
_PATH = r"/[A-Za-z0-9_~!$&()*+,;=:@./-]*"
_REST = r"(?:\?[A-Za-z0-9_~!$&()*+,;=:@./?%-]*)?(?:#[A-Za-z0-9_~!$&()*+,;=:@./?%-]*)?\z"
_DOTS = r"^[^?#]*/\."


@lru_cache(maxsize=1024)
def _base(text):
    return urls.parse(text)


def resolve_text(raw, base, keep_fragment=False, http_only=True):
    """An absolute URL as the URL standard serialises it, or None; `http_only` takes http and https without user only."""
    if raw is None or base is None:
        return None
    against = _base(base)
    u = against and urls.parse(raw, against)
    if not u or http_only and (u.scheme not in DEFAULT_PORTS or u.user or u.password):
        return None
    return u.href(keep_fragment)


def resolve_url(raw: Column, base: Column, keep_fragment=False, http_only=True) -> Column:
    """FN-1 and, with keep_fragment and not http_only, FN-2.

    Plain absolute references, and plain ones from the root of a plain base, are columns; only the others go to Python.
    """
    @F.pandas_udf("string")
    def run(raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([resolve_text(r, b, keep_fragment, http_only) for r, b in zip(raw, base)], dtype=object)

    sound = base.rlike(rf"^{_HOST}(?:{_PATH})?{_REST}") & ~base.rlike(_DOTS)
    whole, rooted = raw.rlike(rf"^{_HOST}{_PATH}{_REST}"), raw.rlike(rf"^(?!//){_PATH}{_REST}")
    plain = F.when(sound & (whole | rooted) & ~raw.rlike(_DOTS), F.when(whole, raw).otherwise(F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), raw)))
    plain = plain if keep_fragment else F.substring_index(plain, "#", 1)
    return F.coalesce(plain, run(F.when(F.isnull(plain), raw), base))


def resolve_first(base: Column, url: Column, raws: Column, keep_fragment=False, http_only=True) -> Column:
    """FN-1 or FN-2 of `base` against `url`, and of the first of `raws` that can be resolved against the outcome, or against `url`
    without one: a struct (base, first) from one pass through Python."""
    @F.pandas_udf("base string, first string")
    def run(base: pd.Series, url: pd.Series, raws: pd.Series) -> pd.DataFrame:
        rows = []
        for b, u, some in zip(base, url, raws):
            at = resolve_text(b, u, keep_fragment, http_only)
            rows.append((at, next((t for r in (() if some is None else some) if (t := resolve_text(r, at or u, keep_fragment, http_only)) is not None), None)))
        return pd.DataFrame(rows, columns=["base", "first"], dtype=object)

    return run(base, url, raws)


def origin(url: Column) -> Column:
    """FN-3: scheme, host and non-default port."""
    port = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1)
    scheme, host = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1)), F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port))))


def same_origin(a: Column, b: Column) -> Column:
    return origin(a) == origin(b)


def path_query(url: Column) -> Column:
    """FN-4: the path, and ?query only when there is a non-empty one."""
    rest = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^#]*)", 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*(\?.+)$", 1)
    return F.when(url.isNotNull(), F.concat(F.when(path == "", F.lit("/")).otherwise(path), query))


def is_http_url(url: Column) -> Column:
    """FN-5: an absolute http(s) URL without credentials."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#@\s]+([/?#]\S*)?$"), F.lit(False))


def configured_path(url: Column, site: Column) -> Column:
    """FN-6: path and query if the URL has the site's origin and serialises to itself without fragment."""
    return F.when((resolve_url(url, site) == url) & same_origin(url, site) & ~F.contains(url, F.lit("#")), path_query(url))


def robots_norm_text(path):
    """FN-9: only unreserved escapes are decoded, other escapes upper-cased, non-ASCII percent-encoded."""
    if path is None:
        return None
    path = quote(path.encode("utf-8", "replace"), safe="".join(map(chr, range(33, 127))) + " ")

    def one(m):
        c = chr(int(m.group(1), 16))
        return c if re.match(r"[A-Za-z0-9._~-]", c) else m.group().upper()

    return re.sub(r"%([0-9A-Fa-f]{2})", one, path)


def robots_norm(path: Column) -> Column:
    @F.pandas_udf("string")
    def run(path: pd.Series) -> pd.Series:
        return pd.Series([robots_norm_text(p) for p in path], dtype=object)

    return run(path)


def robots_regex(pattern: Column) -> Column:
    """FN-10 on normalised text: * is any run, a last $ anchors, else a prefix match; an empty pattern gives null."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.\\+?^{}()|\[\]$])", r"\\$1")
    return F.when(pattern != "", F.concat(F.lit("^"), F.regexp_replace(body, r"\*+", ".*"), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit(""))))


def robots_match(pattern: Column, path: Column) -> Column:
    return F.coalesce(F.regexp_like(path, robots_regex(pattern)), F.lit(False))


def safe_number(raw: Column, is_number: Column | None = None) -> Column:
    """FN-11: a double of a text `-?digits[.digits][e[+-]digits]`, null beyond what a double holds exactly.

    Texts other than integers hold at most 15 significant digits. Where `is_number` is true the value was no text in its
    source, and only the range is asked for.
    """
    value = raw.try_cast("double")
    integer, mantissa = raw.rlike(r"^-?[0-9]+\z"), F.regexp_replace(F.regexp_extract(raw, r"^([-0-9.]*)", 1), r"[-.]", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(mantissa, "^0+", ""), "0+$", ""))
    sound = raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z") & (integer | (digits <= 15) & ~((value == 0) & mantissa.rlike("[1-9]")))
    sound = sound if is_number is None else sound | F.coalesce(is_number, F.lit(False))
    return F.when(sound & (F.abs(value) <= SAFE) & ~F.isnan(value), value)


def canonical_json(v: Column) -> Column:
    """FN-12: JSON text with sorted object keys; `v` is a VARIANT."""
    return F.to_json(v)


def sha256(text: Column) -> Column:
    """FN-13: hash of the UTF-8 bytes."""
    return F.sha2(text, 256)


def byte_len(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def code_points(text: Column) -> Column:
    """FN-14."""
    return F.char_length(text).cast("long")


def has_directive(values: Column, header: Column, word: str) -> Column:
    """FN-15: the word or `none` with word boundaries in any value or in the header."""
    rx = rf"(?i)\b({word}|none)\b"
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(rx), F.lit(False))) | F.coalesce(header.rlike(rx), F.lit(False))


def has_noindex(values: Column, header: Column) -> Column:
    return has_directive(values, header, "noindex")


def has_nofollow(values: Column, header: Column) -> Column:
    return has_directive(values, header, "nofollow")


def mentions_noindex(text: Column) -> Column:
    """FN-16: a plain substring test, without `none`."""
    return F.coalesce(text.rlike("(?i)noindex"), F.lit(False))


def pacific_date(ts: Column) -> Column:
    """FN-17: the Pacific calendar date of an instant of a session in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, PACIFIC))


def pacific_days_ago(n, ts: Column) -> Column:
    return F.date_sub(pacific_date(ts), n)


def default_window(ts: Column) -> Column:
    """FN-18: 28 days that end three Pacific days ago."""
    return F.struct(pacific_days_ago(30, ts).alias("start_date"), pacific_days_ago(3, ts).alias("end_date"))


def valid_date(text: Column) -> Column:
    """FN-19: a real calendar date written as YYYY-MM-DD."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False)) & F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def norm_property(text: Column) -> Column:
    """FN-20: properties/123 of 123 or properties/123, else null."""
    n = F.regexp_extract(text, r"^(?:properties/)?([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.lit("properties/"), n))


def decode_entities(text: Column) -> Column:
    """FN-21."""
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(unescape, na_action="ignore")

    return run(text)


def valid_json(text: Column) -> Column:
    """FN-22: duplicate keys count as not valid."""
    return F.try_parse_json(text).isNotNull()
