"""Numeric functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import lexicon as L


# Coefficients, highest power first, of the rational approximation of the normal tail over exp(-x*x/2) (Hart and others, 1968, no. 5666).
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: From here on a continued fraction is better; beyond LAST_TAIL the tail is 0.
FIRST_FRACTION, LAST_TAIL = 7.07106781186547, 37.0


def norm_tail(x: Column) -> Column:
    """1 - the standard normal distribution function, for x >= 0, to 1e-15; null for null. Stays in generated code."""
    def polynomial(factors):
        out = F.lit(factors[0])
        for c in factors[1:]:
            out = out * x + c
        return out

    fraction = F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = k / (x + fraction)
    bell = F.exp(-x * x / 2)
    return F.when(x > LAST_TAIL, 0.0).when(x < FIRST_FRACTION, bell * polynomial(TAIL_ABOVE) / polynomial(TAIL_BELOW)).otherwise(bell / (x + fraction) / 2.506628274631)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    return F.when(x <= 0, norm_tail(-x)).otherwise(1 - norm_tail(x))


def py_round(digits: int):
    """Rounding of the exact binary value, half to even, as an Arrow function (round() rounds half up)."""
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else float(round(v, digits)))

    return run


def tenths(x: Column) -> Column:
    """x to one digit, half up. Weighted sums that are exactly halfway miss it by their rounding in doubles; 1e-9 is more than that."""
    return F.round(x + 1e-9, 1)


def volume_score(volume: Column, reference: int = 100_000) -> Column:
    """Logarithmic share of a reference volume, 0 to 100; null without volume."""
    return F.when(volume > 0, F.least(F.lit(100.0), 100 * F.log10(volume.cast("double")) / F.log10(F.lit(float(reference)))))


def position_score(position: Column) -> Column:
    """Piecewise score of a rank; null without one."""
    return (
        F.when(position == 1, 100.0).when(position <= 3, 90.0).when(position <= 10, 80.0 - (position - 4) * 5).when(position <= 20, 50.0 - (position - 11) * 3)
        .when(position <= 50, F.greatest(F.lit(5.0), 25.0 - (position - 21) * 0.5)).when(position.isNotNull(), 5.0)
    )


def intent_score(intent: Column, use: str) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in L.INTENT_SCORE[use].items() for x in (k, float(v))))
    return F.coalesce(F.element_at(table, intent), F.lit(50.0 if use == "main" else 40.0))


def ctr(rank: Column) -> Column:
    """Click-through rate of a rank; the table's last rank beyond it."""
    return F.element_at(F.array(*(F.lit(v) for v in L.CTR.values())), F.greatest(F.lit(1), F.least(rank.cast("int"), F.lit(20))))


def ctr_provenance(rank: Column) -> Column:
    return F.when(rank.isNull(), "unranked").when(rank.isin(*L.CTR_CONFIRMED), "confirmed").when(rank <= L.CTR_MEASURED_TO, "interpolated").otherwise("extrapolated")


def suppression(features: Column) -> Column:
    """The strongest of the present features' click factors."""
    return F.least(F.lit(1.0), *(F.when(F.array_contains(features, k), v).otherwise(1.0) for k, v in L.CLICK_FACTORS.items()))


def effective_ctr(rank: Column, features: Column, recovery: Column) -> Column:
    """Click-through rate under suppressing features and an AI overview, of which citations recover a part."""
    plain = ctr(rank) * suppression(features)
    return F.when(F.array_contains(features, "ai_overview"), plain * L.AI_MULTIPLIER * (1 + recovery * (L.AI_RECOVERY - 1))).otherwise(plain)
