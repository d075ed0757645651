"""Row-wise and group statistics with the null rules that results depend on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sum0(x: Column) -> Column:
    """Sum that is 0.0 for a group without values."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def n_unique(x: Column) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("bigint")), F.lit(0))


def row_values(*cols: Column) -> Column:
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull())


def row_stddev(*cols: Column) -> Column:
    """Population deviation over the columns of a row; null with fewer than two values."""
    v = row_values(*cols)
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(n >= 2, F.sqrt(var))


def share_pct(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100.0)


def snake_pick(adp: Column, teams: int = 12) -> Column:
    """``round.pick`` text of an overall position."""
    at = F.floor(adp - 1)
    return F.format_string("%d.%02d", (F.floor(at / teams) + 1).cast("bigint"), (F.pmod(at, F.lit(teams)) + 1).cast("bigint"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def p_available(adp: Column, position: Column, rank: Column, pick: Column, beta: list[float], gamma: list[float], last: int = 216) -> Column:
    """Chance that a player is still there at ``pick``: a logistic law of location ``beta`` and log scale ``gamma``, truncated to the draft."""
    f = [
        F.lit(1.0), adp / last, F.log(F.greatest(adp, F.lit(1.0))) / F.log(F.lit(float(last))), rank / 50.0,
        (position == "QB").cast("double"), (position == "RB").cast("double"), (position == "TE").cast("double"),
    ]
    mu = sum((x * b for x, b in zip(f, beta)), F.lit(0.0))
    s = F.exp(sum((x * g for x, g in zip(f, gamma)), F.lit(0.0)))
    cdf = lambda y: 1 / (1 + F.exp(-(y - adp - mu) / s))
    width = cdf(F.lit(float(last))) - cdf(F.lit(1.0))
    p = F.when(width < 1e-12, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cdf(F.lit(float(last))) - cdf(pick)) / width)))
    return F.when(pick <= 0, 1.0).when(pick > last, 0.0).otherwise(p)


def exact_round(x: Column, digits: int) -> Column:
    """Round the binary value itself, ties to even, as 2.675 to 2.67; for the plain half-up rule use ``F.round``."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if pd.isna(v) else round(v, digits))

    return rounded(x.cast("double"))
