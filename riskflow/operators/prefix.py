"""Running totals in value order, without sending all rows to one task.

Ranking metrics, calibration, distribution distances and exact-share sampling all
need a cumulative sum over a global order. A window without a partition would put
every row into one task, so the order is cut into ranges:

1. equal values collapse into one row (a hash aggregate, combined before the
   shuffle, so a value that holds a third of the rows is still one row);
2. every row gets the number of its value range, from boundaries that are literals
   in the plan: a retried task finds the same range again;
3. a window runs inside (group, range);
4. the totals of the ranges, a handful of rows per group, give each range its
   starting point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.session import shuffle_width

_RANGE = "_range"


def range_bounds(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Boundaries that cut ``value`` into ranges of about the same number of rows.

    One pass over one column with a mergeable sketch. The boundaries only balance
    the work, results do not depend on them, so any frame with a similar
    distribution will do, and one list can serve several calls.
    """
    ranges = ranges or shuffle_width(df.sparkSession)
    probs = [i / ranges for i in range(1, ranges)]
    numbers = df.select(_number(df, value).alias(value))
    return sorted(set(numbers.approxQuantile(value, probs, 1.0 / (4 * ranges))))


def _number(df: DataFrame, value: str) -> Column:
    """Any orderable column as a double that keeps the order."""
    kind = dict(df.dtypes)[value]
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind.startswith("timestamp"):
        return F.col(value).cast("timestamp").cast("double")
    return F.col(value).cast("double")


def with_range(df: DataFrame, value: str, bounds: Sequence[float], name: str = _RANGE) -> DataFrame:
    """Number of the range that holds ``value``: binary search over literal boundaries."""
    cuts = sorted(set(bounds))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    staged = df.withColumn("_number", _number(df, value))
    # NaN sorts last, into a range of its own. Never null: a null check on one side of
    # the join below would keep Spark from reading the folded cells only once.
    cutter = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_number",
        outputCol="_cut",
        handleInvalid="keep",
    )
    return (
        cutter.transform(staged)
        .withColumn(name, F.coalesce(F.col("_cut").cast("int"), F.lit(0)))
        .drop("_number", "_cut")
    )


def _by_range(df: DataFrame, groups: Sequence[str], descending: bool):
    order = F.col(_RANGE).desc() if descending else F.col(_RANGE).asc()
    # Runs over range totals only: at most one row per group and range.
    return Window.partitionBy(*groups).orderBy(order)


def ordered_prefix(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (by, value) with every sum, its running and its overall total.

    Adds ``<name>``, ``cum_<name>`` (up to and including this value) and
    ``all_<name>`` for each entry of ``sums``, and ``next_<value>``, the value that
    follows in the chosen order. Rows without a value are left out.
    """
    by = list(by)
    rows = df.where(as_column(value).isNotNull())
    if bounds is None:
        bounds = range_bounds(rows, value)
    cells = rows.groupBy(*by, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return prefix_of_cells(cells, value, list(sums), by, descending, bounds)


def prefix_of_cells(
    cells: DataFrame,
    value: str,
    names: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: Sequence[float] = (),
) -> DataFrame:
    """``ordered_prefix`` for rows that are unique per (by, value) already."""
    by = list(by)
    if _RANGE not in cells.columns:
        cells = with_range(cells, value, bounds)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inner = Window.partitionBy(*by, _RANGE).orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.select(
        "*",
        *[F.sum(n).over(upto).alias(f"_run_{n}") for n in names],
        F.lead(value).over(inner).alias("_next_inside"),
    )

    first = F.max(value) if descending else F.min(value)
    totals = cells.groupBy(*by, _RANGE).agg(
        *[F.sum(n).alias(f"_tot_{n}") for n in names], first.alias("_first")
    )
    ranges = _by_range(totals, by, descending)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        _RANGE,
        *[F.sum(f"_tot_{n}").over(before).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_tot_{n}").over(everything).alias(f"all_{n}") for n in names],
        F.lead("_first").over(ranges).alias("_next_range"),
    )
    if not by:
        # As many rows as there are ranges, a number fixed in the plan.
        offsets = F.broadcast(offsets)
    joined = run.join(offsets, [*by, _RANGE])
    return joined.select(
        *by,
        value,
        *names,
        *[
            (F.col(f"_run_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(f"cum_{n}")
            for n in names
        ],
        *[f"all_{n}" for n in names],
        F.coalesce("_next_inside", "_next_range").alias(f"next_{value}"),
    )


def row_positions(
    df: DataFrame,
    by: Sequence[str],
    uniform: Column,
    tie: Sequence[str],
    position: str = "position",
    size: str = "group_size",
) -> DataFrame:
    """``row_number`` and group size inside ``by``, for an order by a uniform number.

    Groups may be few and huge (two classes of a label), so each is cut into
    ranges of the uniform number, which are even by construction.
    """
    by = list(by)
    width = shuffle_width(df.sparkSession)
    marked = df.withColumn("_u", uniform).withColumn(
        _RANGE, F.coalesce(F.floor(F.col("_u") * width).cast("int"), F.lit(0))
    )
    inner = Window.partitionBy(*by, _RANGE).orderBy("_u", *tie)
    run = marked.withColumn("_run", F.row_number().over(inner))
    totals = marked.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = _by_range(totals, by, False).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        _RANGE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*by)).alias(size),
    )
    return (
        run.join(offsets, [*by, _RANGE])
        .withColumn(position, F.col("_run") + F.col("_off"))
        .drop("_u", "_run", "_off", _RANGE)
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    counts: Column | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one row per group, one column per entry of ``probs``.

    The built-in exact percentile keeps all distinct values of a group in one
    buffer; here the two neighbours of each position are picked from the prefix.
    """
    number = F.lit(1) if counts is None else counts
    cells = ordered_prefix(df, value, {"n": number}, by, bounds=bounds)
    picks, final = [], []
    for name, q in probs.items():
        place = F.lit(float(q)) * (F.col("all_n") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{name}_{side}"))
        place = F.lit(float(q)) * (F.col("_all") - 1)
        low = F.col(f"{name}_lo")
        final.append((low + (F.col(f"{name}_hi") - low) * (place - F.floor(place))).alias(name))
    found = cells.groupBy(*by).agg(*picks, F.max("all_n").alias("_all"))
    return found.select(*by, *final)
