"""Cleaning and parsing of feed fields: Column in, Column out, null for a reject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, most: int | None = None) -> Column:
    """NBSP to space, trimmed, empty to null; over-long to null (FN-06)."""
    t = F.nullif(F.trim(F.replace(c, F.lit(" "), F.lit(" "))), F.lit(""))
    return t if most is None else F.when(F.length(t) <= most, t)


def strict(c: Column, most: int) -> Column:
    """What is wrong with a field that must be there and fit, null if nothing (FN-06)."""
    t = clean(c)
    return F.when(t.isNull(), "missing").when(F.length(t) > most, "too_long")


def cve(c: Column) -> Column:
    """CVE identifier (FN-01)."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"^CVE-[0-9]{4}-[0-9]{4,19}$"), t)


def ghsa(c: Column, storage: bool = False) -> Column:
    """Advisory identifier; upper case, or with a lower-case body for storage (FN-02)."""
    t = F.upper(F.trim(c))
    ok = t.rlike(r"^GHSA(-[23456789CFGHJMPQRVWX]{4}){3}$")
    return F.when(ok, F.concat(F.lit("GHSA-"), F.lower(F.substring(t, 6, 100))) if storage else t)


def cwe(c: Column) -> Column:
    """`CWE-<n>` without leading zeros, n >= 1 (FN-03)."""
    digits = F.regexp_extract(F.upper(F.trim(c)), r"^(?:CWE-)?([0-9]{1,18})$", 1)
    n = digits.try_cast("bigint")
    return F.when(n >= 1, F.concat(F.lit("CWE-"), n.cast("string")))


def cwe_list(c: Column) -> Column:
    """Normal forms in order, without rejects and repeats."""
    return F.array_distinct(F.filter(F.transform(c, cwe), lambda x: x.isNotNull()))


#: Words that stand for no weakness.
CWE_PLACEHOLDERS = ("CWE-NOINFO", "CWE-OTHER", "NVD-CWE-NOINFO", "NVD-CWE-OTHER")


def cwe_from_text(c: Column) -> Column:
    """A weakness in any form of a feed: an identifier, a number, or the first token of
    free text that is one; placeholders are none (FN-04)."""
    tokens = F.filter(F.transform(F.split(c, r"[\s,:()\[\]]+"), cwe), lambda x: x.isNotNull())
    found = F.coalesce(cwe(c), F.get(tokens, F.lit(0)))
    return F.when(~F.upper(clean(c, 500)).isin(*CWE_PLACEHOLDERS), found)


def catalog_id(c: Column, prefix: str) -> Column:
    """`CWE-` or `CAPEC-` identifiers of the catalog, leading zeros gone (FN-05)."""
    digits = F.regexp_extract(F.upper(F.trim(c)), rf"^(?:{prefix}-)?0*([1-9][0-9]*)$", 1)
    return F.when(digits != "", F.concat(F.lit(f"{prefix}-"), digits))


def flag(c: Column) -> Column:
    """Tri-state boolean of yes/no words (FN-10)."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("yes", "y", "1", "true"), True).when(t.isin("no", "n", "0", "false"), False)


def positive_id(c: Column) -> Column:
    """Positive ASCII integer (FN-11)."""
    n = F.when(c.rlike(r"^[0-9]+$"), c).try_cast("bigint")
    return F.when(n > 0, n)


def bounded(c: Column, low: float, high: float) -> Column:
    """A number within bounds (FN-09)."""
    x = c.try_cast("double")
    return F.when(x.between(low, high), x)


def strict_date(c: Column) -> Column:
    """A date that reads back as it was written (FN-08)."""
    d = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(F.date_format(d, "yyyy-MM-dd") == c, d)


def iso_utc(c: Column) -> Column:
    """ISO-8601 with an offset or Z, as UTC; without an offset null (FN-07)."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def feed_timestamp(c: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss UTC`, or ISO with an offset (FN-42)."""
    plain = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: UTC)?$", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(plain, F.lit(""))), iso_utc(c))


def tags(c: Column, most: int = 50) -> Column:
    """Cleaned, deduplicated in order, bounded (FN-43)."""
    kept = F.filter(F.transform(c, lambda x: clean(x, 100)), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(kept), 1, most)


def named_statuses(c: Column) -> Column:
    """A name -> status map as an array of (name, status) in name order (FN-44)."""
    return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("status"))))


def software_name(c: Column) -> Column:
    """Trimmed, inner white space as one space, lower case (FN-24)."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))


#: Names of ecosystems and what they stand for.
ECOSYSTEMS = {"pip": "pypi", "pypi": "pypi", "npm": "npm"}
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def ecosystem(c: Column) -> Column:
    """The name under which components and advisories of an ecosystem meet; null for
    one that is not matched."""
    t = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for alias, name in ECOSYSTEMS.items():
        out = F.when(t == alias, name).otherwise(out)
    return out


def package_name(name: Column, of: Column) -> Column:
    """PyPI names fold `-_.` runs to `-`; others are software names. Full-width forms
    are folded here; other compatibility forms take `unicode.software_name` (FN-23)."""
    t = software_name(F.translate(name, _FULL_WIDTH, _ASCII))
    return F.when(ecosystem(of) == "pypi", F.regexp_replace(t, r"[-_.]+", "-")).otherwise(t)


REDACTED = "[REDACTED]"
#: Names whose assigned values are secret, in messages and in logs of jobs.
SECRET_NAMES = ("github_token", "access_token", "refresh_token", "session_token", "id_token", "api_token", "token", "api_key", "auth_key", "client_secret", "password",
    "passwd", "secret")
LOG_SECRET_NAMES = ("password", "passwd", "pwd", "token", "api_key", "api-key", "apikey", "secret", "authorization")
#: A value ends at white space or where a list or a query goes on; in quotes, at the quote.
VALUE = r"""("[^"]*"|'[^']*'|[^\s,;&#]+)"""


def _assigned(c: Column, names: tuple[str, ...], to: str, before: str = "") -> Column:
    """`name = value` and `name: value` with the value replaced; `before` may stand
    between the two. $1 is the name, $2 the sign with its white space."""
    return F.regexp_replace(c, rf"(?i)\b({'|'.join(names)})\b(\s*[:=]\s*){before}{VALUE}", to)


def redacted(c: Column, most: int = 500) -> Column:
    """Text without the passwords of URIs, authorization values, secrets that are
    assigned to a name, and vulnerability identifiers, cut to a length (FN-37)."""
    without = F.regexp_replace(c, r"(?<=://)([^\s:/@]+):\S+?@", rf"$1:{REDACTED}@")
    without = F.regexp_replace(without, r"(?i)(?<=\bauthorization)(\s*:\s*)(basic|bearer|token)\s+\S+", rf"$1{REDACTED}")
    without = F.substring(_assigned(without, SECRET_NAMES, rf"$1$2{REDACTED}"), 1, most)
    return F.regexp_replace(without, r"(?i)\bcve-\d[\w.-]*", "[CVE_REDACTED]")


def log_summary(c: Column, most: int = 1_000) -> Column:
    """An error for the log of a job: no URL at all, no secret, no bearer token, no
    control characters, cut to a length (FN-37)."""
    line = F.regexp_replace(c, r"\p{Cntrl}+", " ")
    line = F.regexp_replace(line, r"\b\p{Alpha}[\w+.-]*://\S+", "[redacted-url]")
    line = _assigned(line, LOG_SECRET_NAMES, "$1=***", before=r"(?:[Bb][Ee][Aa][Rr][Ee][Rr]\s+)?")
    return F.substring(F.regexp_replace(line, r"(?i)\bbearer\s+(?!\*)\S+", "Bearer ***"), 1, most)
