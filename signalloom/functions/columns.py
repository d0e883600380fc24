"""Column expressions that the operators share. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def day(column: Column | str) -> Column:
    """Days since 1970-01-01: the numeric order key of time frames."""
    return F.datediff(F.col(column) if isinstance(column, str) else column, F.lit(EPOCH).cast("date"))


def over_days(keys: Sequence[str], date: str, days: int, closed: str = "right") -> WindowSpec:
    """The rows of a key within `days` days: right (t-N, t], left [t-N, t), both [t-N, t], none (t-N, t)."""
    low, high = {"right": (1 - days, 0), "left": (-days, -1), "both": (-days, 0), "none": (1 - days, -1)}[closed]
    return Window.partitionBy(*keys).orderBy(day(date)).rangeBetween(low, high)


def up_to_now(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def safe_div(left, right) -> Column:
    """Quotient, null where the divisor is 0 or null."""
    return F.try_divide(left, right)


def last_rows(value: Column, window: WindowSpec, n: int, how=F.avg) -> Column:
    """A statistic of the last n rows, null unless all n hold a value. `window` is ordered and has no frame."""
    frame = window.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, how(value).over(frame))


def fill_forward(value: Column | str, window: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(value: Column | str, window: WindowSpec) -> Column:
    return F.first(value, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))


def average_rank(value: str, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank with ties averaged; nulls have none."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2)


def zscore(value: str, keys: Sequence[str], epsilon: float | None = None) -> Column:
    """(x - mean) / (sample std + epsilon) within the keys; without epsilon, null where the std is 0."""
    over = Window.partitionBy(*keys)
    gap, spread = F.col(value) - F.avg(value).over(over), F.stddev_samp(value).over(over)
    return safe_div(gap, spread) if epsilon is None else gap / (spread + F.lit(epsilon))


def at_least(value: Column, low) -> Column:
    """Clip from below; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def at_most(value: Column, high) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(high)))


def quantile_edges(value: str, keys: Sequence[str], n: int) -> Column:
    """The n + 1 linear-interpolated quantile edges of a group."""
    return F.percentile(value, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(Window.partitionBy(*keys))


def bucket_by_edges(value: Column, edges: Column) -> Column:
    """0-based bucket: interior edges strictly below the value (right-closed, lowest included)."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNotNull(), F.size(F.filter(inner, lambda e: e < value)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of an aggregate, null for constant or single inputs (where the built-in raises)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    cov = F.sum(a * b) - safe_div(F.sum(a) * F.sum(b), n)
    va, vb = F.sum(a * a) - safe_div(F.sum(a) * F.sum(a), n), F.sum(b * b) - safe_div(F.sum(b) * F.sum(b), n)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, safe_div(cov, F.sqrt(va * vb)))


def entropy_of(counts: DataFrame, keys: Sequence[str], n: str, out: str) -> DataFrame:
    """Shannon entropy in bits of the counts `n` within the keys; 0 for a single value. One aggregation:
    H = log2(T) - sum(n log2 n) / T."""
    total = F.sum(n)
    plain = F.log2(total.cast("double")) - safe_div(F.sum(F.col(n) * F.log2(F.col(n).cast("double"))), total)
    return counts.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, plain).otherwise(F.lit(0.0)).alias(out))
