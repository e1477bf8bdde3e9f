"""Value checks, score, severity and confidence, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..options import DEFAULT_OPTIONS, ScanOptions
from . import regex
from .text import col, strip


def round2(x: Column) -> Column:
    """Two decimals, ties to even on the exact binary value.

    Spark's ``round`` goes half-up on the decimal text; the two only part where
    the binary value is an exact tie, that is a multiple of 1/8.
    """
    return F.when(x * 8 == F.floor(x * 8), F.bround(x, 2)).otherwise(F.round(x, 2))


def shannon_entropy(value: Column | str) -> Column:
    """Bits per character over code points; 0 for an empty text."""
    v = col(value)
    n = F.length(v)

    def add(total, ch):
        p = (n - F.length(F.replace(v, ch, F.lit("")))) / n
        return total + p * F.log2(p)

    bits = F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), add)
    return F.when(n == 0, F.lit(0.0)).otherwise(-bits)


def is_likely_hash(value: Column | str) -> Column:
    shapes = "|".join(f"[a-f0-9]{{{n}}}" for n in fv.HASH_HEX_LENGTHS)
    return strip(value).rlike(rf"(?i)\A(?:{shapes})\z")


def is_false_positive(value: Column | str, opts: ScanOptions = DEFAULT_OPTIONS) -> Column:
    """Placeholder wording, or too few different characters."""
    v = col(value)
    few = F.size(F.array_distinct(F.split(v, ""))) < fv.MIN_DISTINCT_CHARS
    return few | v.rlike(regex.any_of(opts.placeholders, "(?iu)"))


def validate_structure(secret_type: Column | str, value: Column | str) -> Column:
    t, v = col(secret_type), col(value)
    return (
        F.when(t == "JWT Token", v.rlike(r"\A[^.]+\.[^.]+\.[^.]+\z"))
        .when(t == "AWS Access Key", v.rlike(r"\AAKIA[0-9A-Z]{16}\z"))
        .when(t == "Yandex Cloud Service Account Key", v.rlike(r"\AAQ[A-Za-z0-9_-]{38,}\z"))
        .when(
            t == "Private Key",
            v.contains("BEGIN") & (v.contains("PRIVATE KEY") | v.contains("RSA")),
        )
        .when(
            t.contains("UUID") | t.contains("HubSpot") | t.contains("Ozon Client ID"),
            v.rlike(r"(?i)\A[a-f0-9\-]{36}\z"),
        )
        .when(t == "Connection String", v.contains("://") & v.contains("@"))
        .otherwise(F.lit(False))
    )


def score(base: Column, likely_hash: Column, entropy: Column, context: Column, ext: Column,
          structural: Column) -> Column:
    """Rule weight adjusted for hash shape, raw entropy, context, file type and structure."""
    (high, high_bonus), (mid, mid_bonus) = fv.ENTROPY_STEPS
    def bonus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    return (
        base
        - bonus(likely_hash, fv.HASH_PENALTY)
        + F.when(entropy > high, high_bonus).when(entropy > mid, mid_bonus).otherwise(0)
        + bonus(context, fv.CONTEXT_BONUS)
        + bonus(ext.isin(fv.CONFIG_EXTENSIONS), fv.CONFIG_BONUS)
        + bonus(ext == ".env", fv.ENV_BONUS)
        + bonus(structural, fv.STRUCTURE_BONUS)
    )


def severity(points: Column | str, opts: ScanOptions = DEFAULT_OPTIONS) -> Column:
    s = col(points)
    return (
        F.when(s >= opts.threshold_critical, "CRITICAL")
        .when(s >= opts.threshold_high, "HIGH")
        .when(s >= opts.threshold_medium, "MEDIUM")
        .otherwise("LOW")
    )


def severity_rank(level: Column | str) -> Column:
    """0 (LOW) to 3 (CRITICAL); unknown names rank as LOW."""
    lv = col(level)
    rank = F.lit(0)
    for i, name in enumerate(fv.SEVERITY_ORDER):
        rank = F.when(lv == name, i).otherwise(rank)
    return rank


def confidence(points: Column | str, entropy2: Column | str, structural: Column | str,
               tainted: Column) -> Column:
    """Confidence from the final score and the *rounded* entropy."""
    cap = F.lit(fv.CONFIDENCE_CAP)

    def term(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    base = F.least(cap, F.lit(fv.CONFIDENCE_BASE) + col(points) / F.lit(fv.CONFIDENCE_SCORE_SCALE))
    total = (
        base
        + term(col(entropy2) > fv.ENTROPY_STEPS[0][0], fv.CONFIDENCE_ENTROPY_TERM)
        + term(col(structural), fv.CONFIDENCE_STRUCTURE_TERM)
        + term(tainted, fv.CONFIDENCE_TAINT_TERM)
    )
    return round2(F.least(total, cap))
