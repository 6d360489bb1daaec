"""Deterministic scoring policies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: The frozen list of the most dangerous weaknesses, edition 2025.
TOP_WEAKNESSES = (
    "CWE-20", "CWE-22", "CWE-77", "CWE-78", "CWE-79", "CWE-89", "CWE-94", "CWE-120", "CWE-121", "CWE-122", "CWE-125",
    "CWE-200", "CWE-284", "CWE-306", "CWE-352", "CWE-416", "CWE-434", "CWE-476", "CWE-502", "CWE-639", "CWE-770",
    "CWE-787", "CWE-862", "CWE-863", "CWE-918",
)
ELEVATED_PERCENTILE, ELEVATED_SCORE = 0.90, 0.04


def rank(level: Column, levels: tuple[str, ...] = LEVELS) -> Column:
    """Position of a level; -1 for null or unknown."""
    out = F.lit(-1)
    for n, name in enumerate(levels):
        out = F.when(level == name, n).otherwise(out)
    return out


def named(n: Column, levels: tuple[str, ...] = LEVELS) -> Column:
    return F.get(F.array(*map(F.lit, levels)), n)


def severity(score: Column, version: Column) -> Column:
    """CVSS score -> severity; version 2.0 has no NONE and no CRITICAL (FN-30)."""
    two = F.when(score < 4.0, "LOW").when(score < 7.0, "MEDIUM").when(score <= 10.0, "HIGH")
    three = F.when(score == 0.0, "NONE").when(score < 4.0, "LOW").when(score < 7.0, "MEDIUM").when(score < 9.0, "HIGH").when(score <= 10.0, "CRITICAL")
    return F.when(score.isNull() | (score < 0), F.lit(None).cast("string")).when(version == "2.0", two).when(version.isin("3.0", "3.1", "4.0"), three)


def source_severity(label: Column) -> Column:
    """A feed's severity word; unknown is null (FN-26)."""
    t = F.upper(F.trim(label))
    return F.when(t == "MODERATE", "MEDIUM").when(t.isin(*LEVELS), t)


def cvss_version(label: Column) -> Column:
    """`CVSS:3.1/AV:N/...`, `cvss_v4`, `3.1` -> version number (FN-27)."""
    t = F.lower(F.trim(label))
    found = F.regexp_extract(t, r"^(?:cvss[:_]?v?)?(2(?:\.0)?|3(?:\.[01])?|4(?:\.0)?)(?:/.*)?$", 1)
    return F.when(found.isin("2", "2.0"), "2.0").when(found == "3.1", "3.1").when(found.isin("3", "3.0"), "3.0").when(found.isin("4", "4.0"), "4.0")


def priority(severity_: Column, kev: Column, percentile: Column, score: Column, weaknesses: Column) -> Column:
    """Known exploited is CRITICAL. Else the severity (null and NONE as LOW), one
    level up for an elevated exploit forecast, and one level up, never to
    CRITICAL, for a top weakness (FN-31)."""
    base = F.greatest(rank(severity_), F.lit(1))
    elevated = F.coalesce(percentile >= ELEVATED_PERCENTILE, F.lit(False)) | F.coalesce(score >= ELEVATED_SCORE, F.lit(False))
    once = F.least(base + F.when(elevated, 1).otherwise(0), F.lit(4))
    top = F.coalesce(F.arrays_overlap(weaknesses, F.array(*map(F.lit, TOP_WEAKNESSES))), F.lit(False))
    return F.when(F.coalesce(kev, F.lit(False)), "CRITICAL").otherwise(named(F.when(top, F.greatest(once, F.least(once + 1, F.lit(3)))).otherwise(once)))


def alert_types(applicability: Column, known: Column, kev_before: Column, kev_now: Column, before: Column, now: Column) -> Column:
    """The alerts that a transition raises, in order (FN-32)."""
    said = lambda c: F.coalesce(c, F.lit(False))
    new = said(~known & (now == "CRITICAL"))
    entered = said(known & ~said(kev_before) & said(kev_now))
    raised = said(known & before.isin("LOW", "MEDIUM", "HIGH") & (now == "CRITICAL"))
    each = F.array(F.when(new, "new_confirmed_critical_exposure"), F.when(entered, "confirmed_exposure_entered_kev"),
        F.when(raised, "priority_transition_to_critical"))
    return F.when(applicability == "confirmed", F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def verdict(threat_class: Column) -> Column:
    """What a class of the URL classifier says of the URL (FN-40)."""
    return F.when(threat_class.isNotNull(), F.when(threat_class == "benign", "benign").otherwise("malicious"))
