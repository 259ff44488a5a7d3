"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import SCORES


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits; adding 0.0 turns a negative zero into zero."""
    cols = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols}) if cols else df


def curve_sql(source: str = SCORES.sql, score: str = "p", by: str = "", label: str = "y") -> str:
    """CTE ``c``: one row per key and distinct score with inclusive counts from the top."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    h AS (SELECT {key}{score}, CAST(sum({label}) AS DOUBLE) AS pos, CAST(sum(1 - {label}) AS DOUBLE) AS neg
          FROM {source} t WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER ({part} ORDER BY {score} DESC) AS tp, sum(neg) OVER ({part} ORDER BY {score} DESC) AS fp,
                 sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn FROM h)"""


AUC_SQL = "sum(pos * (nn - fp + neg / 2)) / (max(np) * max(nn))"
AP_SQL = "sum(pos * tp / (tp + fp)) / max(np)"


def normal_p_sql(z: str) -> str:
    """Two-sided normal p: 1 less the error function's series of positive terms."""
    x = f"greatest(least(abs({z}) / sqrt(2::DOUBLE), 6), 1e-12)"
    term = f"exp(2 * k * ln(2::DOUBLE) + lgamma(k + 1) + (2 * k + 1) * ln({x}) - lgamma(2 * k + 2))"
    return f"(1 - 2 / sqrt(pi()) * exp(-pow({x}, 2)) * list_sum(list_transform(range(0, 140), lambda k: {term})))"


def chi_square_p_sql(statistic: str, dof: str) -> str:
    """Upper tail of chi-square: 1 less the series of the lower incomplete gamma function."""
    term = f"exp(({dof} / 2 + k) * ln({statistic} / 2) - {statistic} / 2 - lgamma({dof} / 2 + k + 1))"
    return f"(1 - list_sum(list_transform(range(0, 2000), lambda k: {term})))"
