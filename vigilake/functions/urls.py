"""URL functions over built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 4096
#: Two-label public suffixes (a part of the public list; other hosts
#: take their last two labels).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "com.br", "com.cn", "com.mx",
    "com.tr", "co.za", "github.io", "blogspot.com")
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often the body uses it.
    The body is evaluated as a lambda, so it adds nothing to the generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def host(url: Column) -> Column:
    """Lower-case host without port, userinfo or trailing dots."""
    authority = F.regexp_replace(part(url, 2), r"^.*@", "")
    return F.rtrim(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), F.lit("."))


def canonical(url: Column) -> Column:
    """Canonical URL, version 1; null where it is refused (FN-13).

    Refused: over-long, white space, control characters or backslash inside,
    other schemes than http(s), userinfo, no host, a colon without a port. Scheme
    and host are lowered, trailing dots and the default port go, an empty path is
    `/`; query and fragment stay as they are. ASCII hosts only: others are null
    here (they need an IDNA library).
    """
    parts = once(F.trim(url), lambda u: F.struct(u.alias("u"), *[part(u, n).alias(f"p{n}") for n in range(1, 6)]))
    return once(parts, lambda p: assembled(p["u"], *[p[f"p{n}"] for n in range(1, 6)]))


def assembled(u: Column, scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """The canonical form of a URL from its parts; null where it is refused."""
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    h = F.rtrim(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), F.lit("."))
    known = F.lower(scheme)
    usual = ((known == "http") & (port == "80")) | ((known == "https") & (port == "443")) | (port == "")
    good = (
        (F.length(u) <= MOST) & ~u.rlike(r"[\s\\\x00-\x1f\x7f]") & known.isin("http", "https") & ~authority.contains("@")
        & ~authority.endswith(":") & (h != "") & (F.length(h) <= 253) & h.rlike(r"^[\x21-\x7e]+$")
    )
    return F.when(good, F.concat(known, F.lit("://"), h, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "",
        "/").otherwise(path), query, fragment))


def value_hash(canonical_url: Column) -> Column:
    return F.sha2(canonical_url, 256)


def group_key(h: Column) -> Column:
    """IP address, else registrable domain by the suffix table, else the host (FN-16)."""
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(h.rlike(IPV4), h).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def projection(url: Column) -> Column:
    """Path, query and fragment with private values hidden (FN-17)."""
    segment = lambda s: (
        F.when(s.rlike(r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), "<uuid>").when(s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
            "<email>").when(s.rlike(r"^[A-Za-z0-9_-]{24,}$"), "<token>").otherwise(s)
    )
    path = F.array_join(F.transform(F.split(part(url, 3), "/"), segment), "/")
    query = F.regexp_replace(F.substring(part(url, 4), 2, MOST), r"([^&=]+)=[^&]*", "$1=<value>")
    hidden = F.concat(path, F.when(part(url, 4) != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(part(url, 5) != "", "#<fragment>").otherwise(""))
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), hidden)


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, in bits (FN-19)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    p = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c)))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def product(x: Column, y: Column) -> Column:
    """x / (1 + |x|) * y / (1 + |y|) (FN-20)."""
    return x / (1 + F.abs(x)) * (y / (1 + F.abs(y)))


def features(url: Column) -> list[Column]:
    """The 13 features of a canonical URL (FN-18)."""
    count = lambda what: F.length(url) - F.length(F.replace(url, F.lit(what), F.lit("")))
    special = F.regexp_count(url, F.lit(r"[^\p{L}\p{N}]"))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    h, special_ratio = host(url), ratio(special, F.length(url))
    labels = F.filter(F.split(h, r"\."), lambda s: s != "")
    mean_label = ratio(F.length(F.replace(h, F.lit("."), F.lit(""))), F.size(labels))
    return [
        F.length(url).alias("url_length"), F.length(h).alias("hostname_length"), count(".").alias("dot_count"), count("-").alias("hyphen_count"),
        F.regexp_count(url, F.lit(r"\p{Nd}")).alias("digit_count"), special.alias("special_char_count"), segments.alias("path_segment_count"),
        entropy(h).alias("hostname_entropy"), mean_label.alias("mean_hostname_label_length"),
            ratio(F.length(path), F.length(url)).alias("path_to_url_length_ratio"),
        special_ratio.alias("special_char_ratio"), product(F.length(path), special_ratio).alias("path_special_product"),
            product(segments, special_ratio).alias("segment_special_product"),
    ]


def longest_run(url: Column, pattern: str) -> Column:
    """Length of the longest match of a run pattern (FN-21)."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit(f"({pattern})"), 1), F.length)), F.lit(0))
