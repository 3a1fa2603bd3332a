"""Column functions for scores, grades, risks and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a finding of each severity takes from the quality score.
PENALTY = {"critical": 3.0, "high": 1.5, "medium": 0.5, "low": 0.1}
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _case(c: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other))


def severity_rank(severity: Column, unknown: int = 1) -> Column:
    return _case(F.lower(severity), RANK, unknown)


def penalty(severity: Column) -> Column:
    return _case(F.lower(severity), PENALTY, 0.0)


def decayed(base: float, total: Column) -> Column:
    """base x 20 / (penalty + 20), between 0.1 and base."""
    return F.greatest(F.lit(0.1), F.least(F.lit(base), F.lit(base) * 20.0 / (total + 20.0)))


def grade(score: Column) -> Column:
    return F.when(score >= 9.5, "A+").when(score >= 9, "A").when(score >= 8, "B+").when(score >= 7, "B").when(score >= 6, "C").when(score >= 5, "D").otherwise("F")


def metric_grade(score: Column) -> Column:
    return F.when(score >= 9, "A").when(score >= 8, "B").when(score >= 7, "C").when(score >= 6, "D").otherwise("F")


def debt_text(hours: Column) -> Column:
    """Minutes below one hour, hours and minutes up to 24, else 8-hour days."""
    whole = F.floor(hours)
    return (
        F.when(hours < 1, F.concat(F.floor(hours * 60).cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(whole.cast("string"), F.lit("h "), F.floor((hours - whole) * 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(hours / 8).cast("string"), F.lit("d "), F.floor(hours % 8).cast("string"), F.lit("h")))
    )


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(F.floor(ms / 1000).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor(ms % 60000 / 1000).cast("string"), F.lit("s")))


def lane(risk: Column) -> Column:
    return F.when(risk <= 3.5, "fast").when(risk <= 7.5, "middle").otherwise("deep")


def normalized_risk(value: Column) -> Column:
    """Numbers over 10 count as percent; what is no number is 5."""
    v = value.try_cast("double")
    v = F.when((v > 10) & (v <= 100), v / 10).otherwise(v)
    return F.when(v.isNull(), 5.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(10.0)))


def cvss_severity(vector: Column) -> Column:
    high = sum((F.when(vector.contains(f"/{k}:H"), 1).otherwise(0) for k in "CIA"), F.lit(0))
    return F.when(high >= 2, "critical").when(high == 1, "high").when(vector.contains("/C:L") | vector.contains("/I:L"), "medium").otherwise("low")


def file_timeout(size: Column, low: float = 10.0, high: float = 300.0, rate: float = 5000.0) -> Column:
    return F.greatest(F.lit(low), F.least(size / rate, F.lit(high)))


def adjusted_severity(severity: Column, context: Column, is_entry: Column) -> Column:
    """One level down in tests, one up at entry points of production code."""
    down = _case(severity, {"critical": "high", "high": "medium", "medium": "low"}, "low")
    up = _case(severity, {"low": "medium", "medium": "high", "high": "critical"}, "critical")
    return F.when(context == "TEST", down).when((context == "PRODUCTION") & is_entry, up).otherwise(severity)


def maintainability_index(volume: Column, complexity: Column, loc: Column) -> Column:
    raw = F.lit(171.0) - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(loc, F.lit(1.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def deduction(severity: Column) -> Column:
    """What an issue takes from a score of a hundred."""
    return F.when(severity == "critical", 10.0).when(severity == "high", 5.0).when(severity == "medium", 2.0).when(severity == "low", 0.5).otherwise(0.0)


def hundred(lost: Column, trend: Column) -> Column:
    """100 less the deductions, 5 more if things improve and 10 less if they get worse, from 0 to 100."""
    change = F.when(trend == "IMPROVING", 5.0).when(trend == "DEGRADING", -10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - lost + change))


def debt_level(age: Column) -> Column:
    """The warning that debt of so many days is worth: none before a week."""
    return F.when(age >= 30, "critical").when(age >= 14, "warning").when(age >= 7, "info")
