"""Statistics taken from one part of the data and applied to another, as one lazy plan.

A table of statistics has one row, whatever the input, and so is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import stored

#: Accuracy of approximate percentiles: exact up to a few hundred thousand distinct values, within 1 in 1e6 beyond.
ACCURACY = 1_000_000
#: Accuracy of percentiles that only fence a value in.
COARSE = 10_000


def percentile(column: Column | str, share: float | Sequence[float]) -> Column:
    return F.percentile_approx(column, share if isinstance(share, float) else list(share), ACCURACY)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return discrete_quantiles(df, columns, [0.5]).select(*[F.col(c)[0].alias(c) for c in columns])


def bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """{c}_lo and {c}_hi."""
    found = discrete_quantiles(df, columns, [low, high])
    return found.select(*[F.col(c)[i].alias(f"{c}_{end}") for c in columns for i, end in enumerate(("lo", "hi"))])


def discrete_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row: for each column the exact values at its shares, each a value of the column; null without values. Nulls
    don't count; NaN is the largest value.

    Coarse percentiles, whose sketches stay small however many rows there are and so are merged at once, fence each
    value in; those below the fence are counted, and the few within are ranked, equal ones as one. df is read three times.
    """
    slack = 4 / COARSE
    sides = [min(1.0, max(0.0, p + side)) for side in (-slack, slack) for p in shares]
    values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    # Sketches put no NaN in its place: to fences it is infinite, and an infinite fence lets it in.
    number = lambda i: F.when(F.isnan(f"_v{i}"), float("inf")).otherwise(F.col(f"_v{i}"))
    fences = values.agg(*[f for i in range(len(columns)) for f in (F.count(f"_v{i}").alias(f"_n{i}"), F.percentile_approx(number(i), sides, COARSE).alias(f"_f{i}"))])

    fenced, each = values.join(F.broadcast(fences)), [(i, k) for i in range(len(columns)) for k in range(len(shares))]
    fence = {(i, k): (F.col(f"_f{i}")[k], F.col(f"_f{i}")[len(shares) + k]) for i, k in each}
    before = fenced.agg(*[F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))], *[F.count_if(F.col(f"_v{i}") < fence[i, k][0]).alias(f"_b{i}_{k}") for i, k in each])

    def rank(i: int, k: int) -> Column:
        n = F.col(f"_n{i}")
        return F.greatest(F.lit(1), n - F.floor(n - n * F.lit(float(shares[k])))).cast("long")

    asked = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), F.when(F.col(f"_n{i}") > 0, rank(i, k)).alias("rank"), F.col(f"_b{i}_{k}").alias("before")) for i, k in each])
    asked = before.select(F.explode(asked).alias("x")).select("x.*").where("rank IS NOT NULL")
    within = lambda v, low, high: (v >= low) & ((v <= high) | (high == float("inf")))
    inside = F.array(*[F.when(within(F.col(f"_v{i}"), *fence[i, k]), F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), F.col(f"_v{i}").alias("v"))) for i, k in each])
    counted = fenced.select(F.explode(F.array_compact(inside)).alias("x")).groupBy("x.c", "x.k", "x.v").agg(F.count("*").alias("m"))
    ranked = counted.withColumn("upto", F.sum("m").over(Window.partitionBy("c", "k").orderBy("v")))
    first = F.min(F.when(F.col("before") + F.col("upto") >= F.col("rank"), F.col("v")))
    missed = F.raise_error(F.lit("a quantile lies outside its fence")).cast("double")
    found = asked.join(ranked, ["c", "k"], "left").groupBy("c", "k", "rank", "before").agg(F.when((F.col("before") < F.col("rank")) & first.isNotNull(), first).otherwise(missed).alias("q"))
    at = lambda i, k: F.max(F.when((F.col("c") == i) & (F.col("k") == k), F.col("q")))
    kinds = dict(df.dtypes)
    return found.agg(*[F.array(*[at(i, k).cast(kinds[c]) for k in range(len(shares))]).alias(c) for i, c in enumerate(columns)])


def fill_with(df: DataFrame, row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the one row's values."""
    row = row.select(*[F.col(c).alias(f"_fill_{c}") for c in columns])
    return df.join(F.broadcast(row)).withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in columns}).select(*df.columns)


def clip(df: DataFrame, row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values moved to the nearer bound. greatest() and least() skip nulls: a null becomes the upper bound."""
    clipped = {c: F.greatest(F.col(f"{c}_lo"), F.least(F.col(f"{c}_hi"), F.col(c))) for c in columns}
    return df.join(F.broadcast(row)).withColumns(clipped).select(*df.columns)


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN as zero."""
    return df.fillna(0.0, subset=list(columns))


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float], keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """{c}_q: the exact, interpolated quantiles of each column by group, in the order of shares; null for a group without
    values. Nulls don't count; null keys are a group.

    No group's values are ever held together. Approximate percentiles, of bounded memory, close each quantile in from
    both sides; values below are counted, and only the few in between are ranked, equal ones as one. The values asked
    for are read three times: `keep` stores them, and may do nothing where df is stored already.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    keys = [f"_by{i}" for i in range(len(by))]
    long = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.explode(cells).alias("x")).select(*keys, F.col("x.c").alias("_c"), F.col("x.v").alias("_v")).where("_v IS NOT NULL")
    values, group = keep(long), [*keys, "_c"]

    slack = 4 / ACCURACY
    sides = [min(1.0, max(0.0, p + side)) for side in (-slack, slack) for p in shares]
    fences = values.groupBy(*group).agg(F.count("*").alias("_n"), percentile("_v", sides).alias("_f"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on{c}")) for c in group])
    fenced = values.join(fences.withColumnsRenamed({c: f"_on{c}" for c in group}), same).drop(*[f"_on{c}" for c in group])
    fence = [(F.col("_f")[k], F.col("_f")[len(shares) + k]) for k in range(len(shares))]
    sums = [a for k, (low, high) in enumerate(fence) for a in (
        F.count_if(F.col("_v") < low).alias(f"_below{k}"), F.max(F.when(F.col("_v") < low, F.col("_v"))).alias(f"_prior{k}"), F.min(F.when(F.col("_v") > high, F.col("_v"))).alias(f"_next{k}"),
    )]
    around = fenced.groupBy(*group, "_n").agg(*sums)
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), *[F.col(f"_{n}{k}").alias(n) for n in ("below", "prior", "next")]) for k, p in enumerate(shares)])
    asked = around.select(*group, "_n", F.explode(asked).alias("a")).select(*group, F.col("a.k").alias("_k"), ((F.col("_n") - 1) * F.col("a.p")).alias("_at"), "a.below", "a.prior", "a.next")

    inside = F.array_compact(F.array(*[F.when((F.col("_v") >= low) & (F.col("_v") <= high), F.lit(k)) for k, (low, high) in enumerate(fence)]))
    ranked = fenced.select(*group, "_v", F.explode(inside).alias("_k")).groupBy(*group, "_k", "_v").agg(F.count("*").alias("_m"))
    ranked = ranked.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*group, "_k").orderBy("_v")))
    placed = [*group, "_k"]
    both = asked.join(ranked.withColumnsRenamed({c: f"_on{c}" for c in placed}), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on{c}")) for c in placed]), "left")

    def value(rank: Column) -> Column:
        """The value of a rank from 0: within, or the neighbour outside on either side."""
        within = F.min(F.when(F.col("_upto") > rank - F.col("below"), F.col("_v")))
        return F.when(rank < F.first("below"), F.first("prior")).otherwise(F.coalesce(within, F.first("next")))

    low, high = F.floor("_at"), F.ceil("_at")
    ends = both.groupBy(*placed, "_at").agg(value(low).alias("_low"), value(high).alias("_high"))
    part = F.col("_at") - F.floor("_at")
    made = ends.select(*group, F.struct("_k", F.when(part == 0, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high")).alias("q")).alias("_q"))
    lists = made.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("_q")), lambda x: x["q"]).alias("_q"))
    wide = [F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(f"{c}_q") for i, c in enumerate(columns)]
    return lists.groupBy(*keys).agg(*wide).withColumnsRenamed(dict(zip(keys, by)))


def with_quantiles(aggregates: DataFrame, quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Aggregates of groups with their quantiles; null keys meet."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by], F.lit(True))
    return aggregates.join(quantiles.withColumnsRenamed({c: f"_on_{c}" for c in by}), same, "left").drop(*[f"_on_{c}" for c in by])


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def quantile_edges(df: DataFrame, by: Sequence[str], columns: Sequence[str], bins: int, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """{c}_edges: sorted, distinct, interpolated quantiles of each group."""
    found = exact_quantiles(df, by, columns, [i / bins for i in range(bins + 1)], keep)
    return found.select(*by, *[F.array_distinct(f"{c}_q").alias(f"{c}_edges") for c in columns])


def quantile_grid(df: DataFrame, by: str, x: str, y: str, value: str, bins: int = 5, least: int = 0) -> DataFrame:
    """by, x_bin, y_bin, median of value and rows, for groups of `least` rows or more, over quantile bins of x and y."""
    from drillframe.functions import nearest_bin

    rows = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, y, value))
    edges = quantile_edges(rows, [by], [x, y], bins, as_it_is).join(rows.groupBy(by).agg(F.count("*").alias("_n")), by).where(F.col("_n") >= least)
    placed = rows.join(edges, by)
    placed = placed.select(by, value, nearest_bin(F.col(x), F.col(f"{x}_edges")).alias("x_bin"), nearest_bin(F.col(y), F.col(f"{y}_edges")).alias("y_bin"))
    cells, key = stored(placed), [by, "x_bin", "y_bin"]
    found = with_quantiles(cells.groupBy(*key).agg(F.count("*").alias("n_rows")), exact_quantiles(cells, key, [value], [0.5], as_it_is), key)
    return found.select(*key, F.col(f"{value}_q")[0].alias("median"), "n_rows")
