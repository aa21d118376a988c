"""How far the columns of a current table have moved from a reference table.

All columns are judged in one job: the two tables are melted to (column, value)
rows, equal values fold into one cell with two counts, and every distance is an
aggregate over those cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import count_where, hash_uniform, only_row, ratio, within
from riskflow.functions.tails import p_value
from riskflow.operators.prefix import _RANGE, prefix_of_cells, with_range
from riskflow.session import shuffle_width

# Fixed value: the least spread that a distance is divided by.
MIN_SPREAD = 0.001


def both(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The two tables as one, marked 0 (reference) and 1 (current)."""
    old = reference.select(*columns, F.lit(0).alias("_side"))
    return old.unionByName(current.select(*columns, F.lit(1).alias("_side")))


def sides(rows: DataFrame, current: Column, columns: Sequence[str]) -> DataFrame:
    """One table whose rows are current where the condition holds: read once, not once per side."""
    return rows.select(*columns, F.when(current, 1).otherwise(0).alias("_side"))


def _sides() -> list[Column]:
    return [
        F.count(F.when(F.col("_side") == 0, 1)).alias("r"),
        F.count(F.when(F.col("_side") == 1, 1)).alias("k"),
    ]


@dataclass(frozen=True)
class Profile:
    """What one pass over the numbers tells: the spread of the reference side of each
    column, and boundaries that cut its values into even ranges."""

    spread: Mapping[str, float | None]
    bounds: Mapping[str, Sequence[float]]


def profile(rows: DataFrame, columns: Sequence[str]) -> Profile:
    """One row of results. The boundaries only balance the work."""
    ranges = shuffle_width(rows.sparkSession)
    probs = [i / ranges for i in range(1, ranges)]
    row = rows.agg(
        *[F.stddev_pop(F.when(F.col("_side") == 0, F.col(c))).alias(f"s_{c}") for c in columns],
        *[
            F.percentile_approx(F.col(c).cast("double"), probs, 4 * ranges).alias(f"q_{c}")
            for c in columns
        ],
    ).first()
    return Profile(
        {c: row[f"s_{c}"] for c in columns},
        {c: sorted(set(row[f"q_{c}"] or [])) for c in columns},
    )


def numeric_cells(
    rows: DataFrame, columns: Sequence[str], bounds: Mapping[str, Sequence[float]]
) -> DataFrame:
    """(column, value) cells with the counts of both sides and their running totals."""
    marked = rows
    for c in columns:
        marked = with_range(marked, c, bounds[c], f"_range_{c}")
    melted = marked.select(
        "_side",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(c).cast("double").alias("x"),
                        F.col(f"_range_{c}").alias(_RANGE),
                    )
                    for c in columns
                ]
            )
        ),
    ).where("x is not null")
    cells = melted.groupBy("column", "x", _RANGE).agg(*_sides())
    return prefix_of_cells(cells, "x", ["r", "k"], ["column"])


def numeric_distances(
    rows: DataFrame, columns: Sequence[str], known: Profile | None = None
) -> DataFrame:
    """Wasserstein distance, the same per reference spread, and the KS distance, per column.

    The measures for codes come from the same cells, for columns with few values.
    """
    known = known or profile(rows, columns)
    cells = numeric_cells(rows, columns, known.bounds)
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_k") / F.col("all_k"))
    found = cells.groupBy("column").agg(
        F.sum(gap * (F.col("next_x") - F.col("x"))).alias("wasserstein"),
        F.max(gap).alias("ks"),
        *_code_measures(F.col("all_r"), F.col("all_k")),
    )
    spread = F.lit(None).cast("double")
    for c, value in known.spread.items():
        spread = F.when(F.col("column") == c, F.lit(value)).otherwise(spread)
    return found.withColumn(
        "normed", F.col("wasserstein") / F.greatest(spread, F.lit(MIN_SPREAD))
    )


def _code_measures(n: Column, m: Column) -> list[Column]:
    """Jensen-Shannon distance and chi-square statistic over cells with counts r and k."""
    r, k = F.col("r"), F.col("k")
    a, b, half = r / n, k / m, F.lit(0.5)
    part = F.when(r > 0, half * a * F.log(2 * a / (a + b))).otherwise(0.0) + F.when(
        k > 0, half * b * F.log(2 * b / (a + b))
    ).otherwise(0.0)
    expect_r, expect_k = (r + k) * n / (n + m), (r + k) * m / (n + m)
    chi = (r - expect_r) * (r - expect_r) / expect_r + (k - expect_k) * (k - expect_k) / expect_k
    return [
        F.sqrt(F.greatest(F.sum(part), F.lit(0.0))).alias("js"),
        F.sum(chi).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("dof"),
        F.sum("r").alias("reference_rows"),
        F.sum("k").alias("current_rows"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min_by("r", "x").alias("_first_r"),
        F.min_by("k", "x").alias("_first_k"),
    ]


def categorical_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) cells with the counts of both sides."""
    melted = rows.select(
        "_side",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x"))
                    for c in columns
                ]
            )
        ),
    ).where("x is not null")
    return melted.groupBy("column", "x").agg(*_sides())


def categorical_distances(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance and the chi-square statistic per column."""
    cells = categorical_cells(rows, columns)
    totals = cells.groupBy("column").agg(
        F.sum("r").alias("_all_r"), F.sum("k").alias("_all_k")
    )
    shares = cells.join(F.broadcast(totals), "column")  # one row per column
    return shares.groupBy("column").agg(*_code_measures(F.col("_all_r"), F.col("_all_k")))


def psi(rows: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Population stability index over fixed edges, an empty bin counted as one row."""
    cuts = sorted(edges)
    bin_ = sum((F.col(column) >= e).cast("int") for e in cuts)
    sides, bins = ((0, "r"), (1, "k")), range(len(cuts) + 1)
    counts = rows.where(F.col(column).isNotNull()).agg(
        *[
            count_where((F.col("_side") == side) & (bin_ == i)).alias(f"{name}{i}")
            for side, name in sides
            for i in bins
        ]
    )

    def share(name: str, i: int) -> Column:
        return F.greatest(F.col(f"{name}{i}"), F.lit(1)) / sum(F.col(f"{name}{j}") for j in bins)

    terms = [
        (share("k", i) - share("r", i)) * F.log(share("k", i) / share("r", i)) for i in bins
    ]
    return counts.select(sum(terms[1:], terms[0]).alias("psi"))


def bin_cube(
    rows: DataFrame, time: str, column: str, edges: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Counts per (day, bin) summed up to each day: (day, bin, upto), days without rows included.

    The only pass over the rows. A span of days is the difference of two rows a bin, so
    any two spans compare without the rows; the cube grows with days and bins. Null and
    NaN values stay out. Days are numbers since the epoch.
    """
    x = F.col(column).cast("double")
    bin_ = sum(((x >= float(e)).cast("int") for e in sorted(edges)), F.lit(0))
    bins = range(len(edges) + 1)
    daily = (
        rows.where(x.isNotNull() & ~F.isnan(x) & F.col(time).isNotNull())
        .groupBy(*by, F.unix_date(F.to_date(time)).alias("day"))
        .agg(*[count_where(bin_ == i).alias(f"_n{i}") for i in bins])
    )
    cells = [F.struct(F.lit(i).alias("bin"), F.col(f"_n{i}").alias("_n")) for i in bins]
    order = Window.partitionBy(*by, "bin").orderBy("day")
    running = daily.select(*by, "day", F.inline(F.array(*cells))).select(
        *by,
        "bin",
        "day",
        F.sum("_n").over(order).alias("upto"),
        F.coalesce(F.lead("day").over(order) - 1, F.col("day")).alias("_until"),
    )
    dense = F.explode(F.sequence("day", "_until")).alias("day")
    return running.select(*by, "bin", "upto", dense).select(*by, "day", "bin", "upto")


def psi_between(cube: DataFrame, spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stability index of two spans of days per row of ``spans``, with their row counts.

    ``spans`` has r_first, r_last, k_first and k_last (dates, both ends included) and
    any columns to carry, without nulls and without repeated rows. With ``by`` spans name
    their group and read its counts. Store the cube first: it is read twice here.
    Days outside the cube count as empty, an empty bin of a span as one row, as in ``psi``.
    A span without rows has no index; a pair that touches no day of the cube has no row.
    """
    ends = cube.groupBy(*by).agg(F.max("day").alias("_z"))
    last = F.col("_z") if by else only_row(ends)["_z"]
    marked = spans.join(ends, list(by)) if by else spans

    def day(edge: str) -> Column:
        at = F.unix_date(F.col(edge).cast("date"))
        return at - 1 if edge.endswith("first") else at

    edges = {"r_first": ("r", -1), "r_last": ("r", 1), "k_first": ("k", -1), "k_last": ("k", 1)}
    points = [
        F.struct(
            F.least(day(edge), last).alias("day"),
            F.lit(sign if side == "r" else 0).alias("_r"),
            F.lit(sign if side == "k" else 0).alias("_k"),
        )
        for edge, (side, sign) in edges.items()
    ]
    # A day before the cube finds no row and adds nothing.
    keys = spans.columns
    asked = marked.select(*keys, F.inline(F.array(*points)))
    counted = (
        asked.join(cube, [*by, "day"])
        .groupBy(*keys, "bin")
        .agg(F.sum(F.col("_r") * F.col("upto")).alias("r"), F.sum(F.col("_k") * F.col("upto")).alias("k"))
    )
    folded = counted.groupBy(*keys).agg(
        F.collect_list(F.struct("r", "k")).alias("_bins"),  # one entry per bin
        F.sum("r").alias("reference_rows"),
        F.sum("k").alias("current_rows"),
    )

    def term(cell: Column) -> Column:
        a = F.greatest(cell["r"], F.lit(1)) / F.col("reference_rows")
        b = F.greatest(cell["k"], F.lit(1)) / F.col("current_rows")
        return (b - a) * F.log(b / a)

    index = F.aggregate(F.transform("_bins", term), F.lit(0.0), lambda total, x: total + x)
    filled = (F.col("reference_rows") > 0) & (F.col("current_rows") > 0)
    return folded.select(*keys, "reference_rows", "current_rows", F.when(filled, index).alias("psi"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    method: str = "distance",
    limit: float = catalog.DRIFT_LIMIT,
    p_limit: float = catalog.P_VALUE_LIMIT,
) -> DataFrame:
    """``report_of`` for two tables."""
    rows = both(reference, current, [*numeric, *categorical])
    return report_of(rows, numeric, categorical, method, limit, p_limit)


def report_of(
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    method: str = "distance",
    limit: float = catalog.DRIFT_LIMIT,
    p_limit: float = catalog.P_VALUE_LIMIT,
) -> DataFrame:
    """One row per column: method, score, threshold and verdict.

    ``distance`` judges numbers by the Wasserstein distance per spread and codes by the
    Jensen-Shannon distance, ``test`` numbers by the Kolmogorov-Smirnov test and codes
    by a z test (two values) or chi-square. The lists alone say what a column is and
    the parameter alone how it is judged, whatever the size of the tables. A distance
    drifts above its limit, a p-value below.
    """
    if method not in ("distance", "test"):
        raise ValueError(f"method {method!r} is neither distance nor test")
    two = F.col("distinct_values") <= 2
    shared = ["column", "reference_rows", "current_rows", F.col("dof").cast("double").alias("dof")]
    found = []
    if categorical:
        codes = categorical_distances(rows, categorical)
        found.append(
            codes.select(
                *shared,
                F.lit("jensen_shannon").alias("distance_method"),
                F.col("js").alias("distance"),
                F.when(two, F.lit("z")).otherwise(F.lit("chi2")).alias("test_method"),
                F.when(two, _proportion_z()).otherwise(F.col("chi2")).alias("statistic"),
            )
        )
    if numeric:
        found.append(
            numeric_distances(rows, numeric).select(
                *shared,
                F.lit("wasserstein_normed").alias("distance_method"),
                F.col("normed").alias("distance"),
                F.lit("ks").alias("test_method"),
                F.col("ks").alias("statistic"),
            )
        )
    frames = reduce(DataFrame.unionByName, found)
    if method == "test":
        p = p_value("test_method", "statistic", "dof", "reference_rows", "current_rows")
        judged = frames.withColumns({"method": F.col("test_method"), "score": p})
        verdict, threshold = F.col("score") < p_limit, p_limit
    else:
        judged = frames.withColumns({"method": F.col("distance_method"), "score": F.col("distance")})
        verdict, threshold = F.col("score") > limit, limit
    return judged.select(
        "column",
        "method",
        "score",
        F.lit(threshold).alias("threshold"),
        verdict.alias("drifted"),
        "reference_rows",
        "current_rows",
    )


def _proportion_z() -> Column:
    """Difference of two proportions, from the counts of the first of two values."""
    n, m = F.col("reference_rows"), F.col("current_rows")
    a, b = F.col("_first_r") / n, F.col("_first_k") / m
    pooled = (F.col("_first_r") + F.col("_first_k")) / (n + m)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return F.coalesce(ratio(a - b, spread, None), F.lit(0.0))


def drift_summary(report: DataFrame, max_share: float = catalog.MAX_DRIFTED_SHARE) -> DataFrame:
    """Verdict on the table: it passes while the share of drifted columns is within the limit."""
    drifted = F.count(F.when(F.col("drifted"), 1))
    found = report.agg(
        drifted.alias("drifted_columns"),
        F.count(F.lit(1)).alias("monitored_columns"),
        ratio(drifted, F.count(F.lit(1))).alias("drifted_share"),
        F.max("reference_rows").alias("reference_rows"),
        F.max("current_rows").alias("current_rows"),
    )
    return found.withColumns(
        {
            "threshold": F.lit(float(max_share)),
            "passed": F.col("drifted_share") <= F.lit(float(max_share)),
        }
    )


def retrain_decision(summary: DataFrame, force: bool = False) -> DataFrame:
    """Whether to retrain. Promotion stays a person's decision, whatever the drift."""
    return summary.withColumns(
        {"retrain": ~F.col("passed") | F.lit(force), "promote": F.lit(False)}
    )


def stress(
    df: DataFrame,
    key: str,
    severity: float,
    statuses: Sequence[str] = (),
    limits: Sequence[str] = (),
    payments: Sequence[str] = (),
    limit_floor: int = 10_000,
    seed: int = catalog.SEED,
) -> DataFrame:
    """A what-if downturn: statuses slip by one or two, limits and payments shrink.

    The share of rows that slip is the severity, chosen by a hash of the key, and
    each status column slips by the same step for all of them.
    """
    slips = hash_uniform(key, seed) < F.lit(float(severity))
    changed = {}
    for i, c in enumerate(statuses):
        step = 1 + (seed + i) % 2
        changed[c] = F.when(slips, within(F.col(c) + step, -2, 9).cast("int")).otherwise(F.col(c))
    for c in limits:
        cut = F.floor(F.col(c) * F.lit(1 - 0.35 * severity))
        changed[c] = F.greatest(cut, F.lit(limit_floor)).cast("bigint")
    for c in payments:
        cut = F.floor(F.col(c) * F.lit(1 - 0.5 * severity))
        changed[c] = F.greatest(cut, F.lit(0)).cast("bigint")
    return df.withColumns(changed)


def shift_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column before and after."""
    rows = both(before, after, columns)
    means = rows.agg(
        *[F.avg(F.when(F.col("_side") == 0, F.col(c))).alias(f"{c}_0") for c in columns],
        *[F.avg(F.when(F.col("_side") == 1, F.col(c))).alias(f"{c}_1") for c in columns],
    )
    named = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}_0").alias("mean_before"),
            F.col(f"{c}_1").alias("mean_after"),
        )
        for c in columns
    ]
    return means.select(F.inline(F.array(*named)))
