"""Risk-score expressions (R5, R7, R10, R11) and the alert-rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (ALERT_RULES, BAND_CRITICAL, BAND_HIGH, BAND_MEDIUM, FALLBACK_CAP,
                         FALLBACK_DOMAIN_TLDS, FALLBACK_URL_WORDS, HASH_LOW, HASH_MEDIUM)
from .text import col, flag


def risk_band(c) -> Column:
    """critical >= 0.9, high >= 0.7, medium >= 0.4, low otherwise; NULL stays NULL."""
    c = col(c)
    return (F.when(c >= BAND_CRITICAL, "critical").when(c >= BAND_HIGH, "high")
            .when(c >= BAND_MEDIUM, "medium").when(c.isNotNull(), "low"))


def fallback_score(type_col, value_col) -> Column:
    """Score from the indicator text alone, in exact tenths, capped at 0.8,
    as decimal(3,2)."""
    t, v = col(type_col), F.lower(col(value_col))
    n = F.length(v)
    tenths = F.when(n > 100, 3).when(n < 5, 1).otherwise(0)
    url = sum((flag(F.contains(v, F.lit(w))) for w in FALLBACK_URL_WORDS), F.lit(0)) \
        + F.when(v.rlike(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), 2).otherwise(0)
    dom = sum((flag(v.endswith(s)) for s in FALLBACK_DOMAIN_TLDS), F.lit(0)) * 3 \
        + F.when(F.size(F.split(v, r"\.", -1)) > 3, 2).otherwise(0)
    hsh = F.when(n == 32, 1).when(n == 64, 2).otherwise(0)
    tenths = tenths + F.when(t == "url", url).when(t == "domain", dom).when(t == "hash", hsh).otherwise(0)
    return (F.least(tenths, F.lit(int(FALLBACK_CAP * 10))) / 10).cast(T.DecimalType(3, 2))


def score_from_prediction(pred, conf) -> Column:
    """malicious -> 0.6 + 0.4 c; benign -> 0.4 (1 - c); otherwise 0.5."""
    p, c = col(pred), col(conf)
    return (F.when(p == "malicious", 0.6 + 0.4 * c).when(p == "benign", 0.4 * (1 - c))
            .otherwise(F.lit(0.5)))


def hash_risk_level(score) -> Column:
    s = col(score)
    return F.when(s < HASH_LOW, "LOW").when(s < HASH_MEDIUM, "MEDIUM").otherwise("HIGH")


def to_stored(score) -> Column:
    """Stored precision of a risk score: decimal(3,2), rounded half-up.
    Floating noise is removed first (0.7 + 0.095 is 0.79499999... in binary
    but 0.795 in intent) and the tie is rounded in decimal arithmetic, so
    the result does not depend on an engine's double rounding."""
    exact = F.round(col(score).cast("double"), 6).cast(T.DecimalType(12, 6))
    return F.round(exact, 2).cast(T.DecimalType(3, 2))


def alert_rules(spark: SparkSession) -> DataFrame:
    """The rule table (a few rows; broadcast by construction)."""
    schema = "rule_name string, type string, min_risk double, severity string, message string"
    return spark.createDataFrame([tuple(r) for r in ALERT_RULES], schema)


def hash_risk(probability) -> tuple[Column, Column]:
    """(score rounded to 4 places, LOW / MEDIUM / HIGH level) from
    a malicious-class probability."""
    s = F.round(col(probability).cast("double"), 4)
    return s, hash_risk_level(s)
