"""Dashboard aggregates, filters, ordering and paging (G1, G2, G28, F1-F5,
T1-T6).  Each dashboard is one conditional aggregate per table instead of a
scan per number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BAND_CRITICAL, BAND_HIGH, BAND_MEDIUM, SEVERITIES


def band_filter(df: DataFrame, band: str, score: str = "risk_score") -> DataFrame:
    """critical >= 0.9; high [0.7, 0.9); medium [0.4, 0.7); low < 0.4; all."""
    s = F.col(score)
    cond = {"critical": s >= BAND_CRITICAL, "high": (s >= BAND_HIGH) & (s < BAND_CRITICAL),
            "medium": (s >= BAND_MEDIUM) & (s < BAND_HIGH), "low": s < BAND_MEDIUM}.get(band)
    return df if cond is None else df.where(cond)


def band_counts(iocs: DataFrame, score: str = "risk_score") -> DataFrame:
    """Total and per-band counts in one pass (a NULL score is in no band)."""
    s = F.col(score)
    return iocs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s >= BAND_CRITICAL).alias("critical"),
        F.count_if((s >= BAND_HIGH) & (s < BAND_CRITICAL)).alias("high"),
        F.count_if((s >= BAND_MEDIUM) & (s < BAND_HIGH)).alias("medium"),
        F.count_if(s < BAND_MEDIUM).alias("low"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Total, active (unacknowledged) and acknowledged alerts."""
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      F.count_if(~F.col("acknowledged")).alias("active_alerts"),
                      F.count_if(F.col("acknowledged")).alias("acknowledged_alerts"))


def dashboard_metrics(iocs: DataFrame, alerts: DataFrame) -> DataFrame:
    """G1: the dashboard numbers as (metric, value) rows: one aggregate per
    table, unpivoted and unioned (no join between the two)."""
    b = band_counts(iocs).selectExpr(
        "stack(5, 'total_iocs', total, 'critical_risk_iocs', critical, 'high_risk_iocs', high, "
        "'medium_risk_iocs', medium, 'low_risk_iocs', low) AS (metric, value)")
    a = alert_counts(alerts).selectExpr(
        "stack(2, 'active_alerts', active_alerts, 'acknowledged_alerts', acknowledged_alerts) AS (metric, value)")
    return b.unionByName(a)


def severity_rank(c: str = "severity") -> Column:
    """Enum position (low < medium < high < critical) for ordering."""
    m = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return m[F.col(c)]


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """Deterministic offset/limit paging (order ends with a key)."""
    return df.orderBy(*order).offset(skip).limit(limit)
