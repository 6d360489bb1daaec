"""Forms that built-in expressions do not have: IDNA hosts, IPv6, NFKC.

Each is an Arrow-batched function that sees a value only for rows that need it;
the others pass a null. Plain ASCII stays on the native path.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions import text, urls


def _host_form(host: str | None) -> str | None:
    if host is None:
        return None
    try:
        if host.startswith("["):
            return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]"
        return host.rstrip(".").encode("idna").decode().lower() or None
    except (UnicodeError, ValueError):
        return None


def has_odd_host(url: Column) -> Column:
    """Whether a URL's host needs `canonical` here: outside ASCII, or IPv6."""
    return F.coalesce(F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*[^\x00-\x7f/?#]|\[)"), F.lit(False))


def canonical(url: Column) -> Column:
    """`urls.canonical`, and also of URLs with an IDNA or IPv6 host (FN-13). A table with
    few of these does better to send only them here, as `canonical_pages` does."""

    @F.pandas_udf("string")
    def form(hosts: pd.Series) -> pd.Series:
        return hosts.map(_host_form)

    u, odd = F.trim(url), has_odd_host(url)
    bare = urls.once(F.when(odd, u), lambda x: F.regexp_replace(urls.part(x, 2), r":[0-9]*$", ""))
    both = F.struct(u.alias("u"), odd.alias("odd"), form(bare).alias("host"))

    def body(v: Column) -> Column:
        # The same rules on the URL with its host replaced; an IPv6 host is put back at the end.
        six = v["host"].startswith("[")
        stand_in = F.when(six, F.lit("ipv6.invalid")).otherwise(v["host"])
        authority = urls.part(v["u"], 2)
        tail = F.concat(F.regexp_extract(authority, r"(:[0-9]*)$", 1), urls.part(v["u"], 3), urls.part(v["u"], 4), urls.part(v["u"], 5))
        rebuilt = F.concat(urls.part(v["u"], 1), F.lit("://"), stand_in, tail)
        plain = urls.canonical(F.when(v["odd"] & ~authority.contains("@"), rebuilt).otherwise(v["u"]))
        return F.when(F.coalesce(v["odd"] & six, F.lit(False)), F.replace(plain, F.lit("ipv6.invalid"), v["host"])).otherwise(plain)

    return urls.once(both, body)


def software_name(c: Column) -> Column:
    """`text.software_name` after NFKC (FN-23)."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    odd = c.rlike(r"[^\x00-\x7f]")
    return text.software_name(F.coalesce(nfkc(F.when(odd, c)), c))


def package_name(name: Column, of: Column) -> Column:
    """`text.package_name` after NFKC, outside of array functions (FN-23)."""
    return text.package_name(software_name(name), of)


def network(c: Column) -> Column:
    """IP addresses and networks in canonical form, host bits of a network cleared;
    null for anything else (FN-36). IPv4 addresses and text that cannot be one stay
    on the native path."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(_network_form)

    t = F.trim(c)
    special = t.rlike(r"^[0-9A-Fa-f:.]+(/[0-9]{1,3})?$") & (t.contains(":") | t.contains("/"))
    return F.when(special, form(F.when(special, t))).when(t.rlike(urls.IPV4), t)


def _network_form(value: str | None) -> str | None:
    if value is None:
        return None
    try:
        return str(ipaddress.ip_network(value, strict=False)) if "/" in value else str(ipaddress.ip_address(value))
    except ValueError:
        return None
