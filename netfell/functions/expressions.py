"""Column expressions shared by the operators. Missing observations are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def subject_of(path: Column) -> Column:
    """The file name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def subject_prefix(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def source_file(name: Column, converged: str = "_broadband_psi_adj_ConvHW.mat", plain: str = "_broadband_psi_adj.mat", short: str = "_ConvHW.mat") -> Column:
    """The adjacency file that a converged result was made from."""
    out = name
    for end in (short, converged):
        out = F.when(F.endswith(name, F.lit(end)), F.concat(F.substring(name, F.lit(1), F.length(name) - len(end)), F.lit(plain))).otherwise(out)
    return out


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def number_or(text: Column, default: float) -> Column:
    """The text as a number, or the default where it isn't one; NaN counts as 0."""
    parsed = F.coalesce(text.try_cast("double"), F.lit(float(default)))
    return F.when(F.isnan(parsed), F.lit(0.0)).otherwise(parsed)


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def binarised(w: Column, above: Column | float) -> Column:
    return (w > above).cast("double")


def rounded(x: Column, rule: str = "half_up") -> Column:
    return (F.round(x, 0) if rule == "half_up" else F.bround(x, 0)).cast("long")


def wilson_half_width(k: Column, n: Column, z: float = Z95) -> Column:
    """Half the width of the Wilson interval of k hits in n; NULL for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    return F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / (1 + F.lit(z * z) / n)


def hazen(values: Column, q: float) -> Column:
    """The q-quantile of an array's values that are not NULL, by interpolation at (k - 0.5) / n."""

    def of(s: Column) -> Column:
        n = F.size(s)
        x = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(q) * n + 0.5))
        low = F.floor(x).cast("int")
        a, b = F.get(s, low - 1), F.get(s, F.least(low + 1, n) - 1)
        return F.when(n > 0, a + (b - a) * (x - low))

    return F.transform(F.array(F.sort_array(F.filter(values, lambda v: v.isNotNull()))), of)[0]


def early_weight(p: Column, place: Column, steps: Column) -> Column:
    """p weighted from 1 for place 0 down to 1 / steps for the last."""
    return p * (steps - place) / steps


def flattened_weight(p: Column, place: Column, steps: Column) -> Column:
    """p less its place's share of the steps, weighted as ``early_weight``, and 0 at least."""
    return F.greatest(F.lit(0.0), (p - (place + 1) / steps) * (steps - place) / steps)


def tilted(p: Column, place: Column, steps: Column, tau_factor: float = 1 / 6, clip_negative: bool = True) -> Column:
    """p damped by exp(-s / tau) for s = place + 1, tau a share of the steps but 2 at least."""
    tau = F.greatest(F.lit(2.0), steps * F.lit(tau_factor))
    base = F.greatest(p, F.lit(0.0)) if clip_negative else p
    return base * F.exp(-(place + 1) / tau)


def simpson_weight(place: Column, n: Column) -> Column:
    """The weight of a sample in Simpson's rule at unit spacing over n samples: composite for odd n; for even n the
    composite rule over the first n - 1 and a parabola through the last three for the last interval; n = 2 is the
    trapezoid, n = 1 has no area."""
    odd = n - F.when(n % 2 == 0, F.lit(1)).otherwise(F.lit(0))
    inner = F.when(place >= odd, F.lit(0.0)).when((place == 0) | (place == odd - 1), F.lit(1.0)).when(place % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)) / 3
    tail = F.when(n % 2 == 1, F.lit(0.0)).when(place == n - 1, F.lit(5.0)).when(place == n - 2, F.lit(8.0)).when(place == n - 3, F.lit(-1.0)).otherwise(F.lit(0.0)) / 12
    return F.when(n <= 1, F.lit(0.0)).when(n == 2, F.lit(0.5)).otherwise(inner + tail)


def linspace(low: Column, high: Column, i: Column, steps: int) -> Column:
    return low + i * (high - low) / (steps - 1)
