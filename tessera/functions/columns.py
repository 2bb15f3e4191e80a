"""Column expressions over correlations, and p-value functions as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import special


def partial_1(xy, xz, yz) -> Column:
    """Correlation of x and y given z, from the three correlations."""
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def fisher_statistic(r, n, k: int = 0) -> Column:
    """sqrt(n - k - 3) * |atanh r|."""
    return F.sqrt(n - k - 3) * F.abs(F.atanh(r))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of |z|."""
    return pd.Series(special.erfc(z.abs().to_numpy() / 2**0.5))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x.to_numpy(), dof.to_numpy()))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(special.t_two_sided(t.to_numpy(), dof.to_numpy()))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(special.normal_quantile(p.to_numpy()))
