"""Ordered operators: row numbers, forward fill, rolling statistics, lags, warm-up, splits by position.

One key may hold a large share of all rows. Where a `block` is given (a column that never falls along the order, such
as the day of a timestamp), rows are numbered by block with the counts of earlier blocks added. No task then holds more
than a block or a chunk, and results are the same. Without a block, one window per key numbers the rows.

Frames of n rows run over chunks of consecutive rows, each with the n rows before it. Running counts, sums and sums of
squares are taken once a chunk, and a frame's are those of its end less those of its beginning: the time doesn't depend
on n. Subtracting sums may lose what direct sums keep, so that

- values that aren't finite are counted apart, and only frames that hold one are NaN or infinite;
- so are outliers, a million times as large as nine tenths of a chunk's values or more: a spike spoils no later frame;
- another value is split into a multiple of a power of two, small enough against the chunk's largest value that sums of
  such multiples are exact, and a rest: a frame's sum errs by about 1e-22 of that largest value;
- squares are those of distances to the chunk's median, and a frame's sum of squares below its own rounding counts as
  none: the deviation of equal values is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk; frames of more rows take chunks of as many.
CHUNK = 8192


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _joined(df: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal values; nulls are equal to each other, as in windows and groups."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], F.lit(True))
    return df.join(right.withColumnsRenamed({c: f"_on_{c}" for c in on}), same).drop(*[f"_on_{c}" for c in on])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", block: Column | None = None) -> DataFrame:
    """Row number by key and order, from 1."""
    if block is None:
        return df.withColumn(name, F.row_number().over(_by(keys, order)).cast("long"))
    df = df.withColumn("_block", block)
    counts = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return _joined(df, counts, [*keys, "_block"]).withColumn(name, F.col("_before") + F.row_number().over(_by([*keys, "_block"], order))).drop("_block", "_before")


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], context: int, block: Column | None) -> tuple[DataFrame, list[str], int]:
    """Rows with number _rn, chunk _chunk and _own; each chunk also has the `context` rows before it, not its own. Also
    the columns that tell chunks apart, and the most rows that one holds."""
    df, size = numbered(df, keys, order, "_rn", block), max(CHUNK, context)
    at = F.floor((F.col("_rn") - 1) / size)
    own, next_one = F.struct(at.alias("c"), F.lit(True).alias("o")), F.struct((at + 1).alias("c"), F.lit(False).alias("o"))
    shares = F.when((F.col("_rn") - 1) % size >= size - context, F.array(own, next_one)).otherwise(F.array(own))
    df = df.withColumn("_share", F.explode(shares))
    return df.withColumns({"_chunk": F.col("_share.c"), "_own": F.col("_share.o")}).drop("_share"), [*keys, "_chunk"], size + context


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], block: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The last value that isn't null, up to the row itself; values never pass from key to key. `keep` may store the last
    values of the blocks: their size is then known, and where it is small they are sent to all tasks instead of dealing
    all rows out once more."""
    if block is None:
        upto = _by(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    df = df.withColumn("_block", block)
    row = F.struct(*order)
    lasts = df.groupBy(*keys, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), row)).alias(f"_last_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_block", *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns])
    upto = _by([*keys, "_block"], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from drillframe.operators.intervals import sized

    out = _joined(df, sized(keep(carried)), [*keys, "_block"])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{c}")) for c in columns}).select(*[c for c in df.columns if c != "_block"])


def prior_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], means: dict[str, tuple[str, int]] | None = None, spreads: dict[str, tuple[str, int]] | None = None, lags: dict[str, tuple[str, int]] | None = None, number: str | None = None, block: Column | None = None) -> DataFrame:
    """Features of the n rows before each row, all in one pass: name -> (column, n) for means, sample deviations and
    lags; `number` names a column for the row number."""
    means, spreads, lags = means or {}, spreads or {}, lags or {}
    context = max([n for _, n in [*means.values(), *spreads.values(), *lags.values()]], default=0)
    # A frame's beginning is the running sum up to the row before it: one row more.
    rows, by, most = _chunked(df, keys, order, context + 1, block)
    w = _by(by, order)
    summed, squared = sorted({c for c, _ in [*means.values(), *spreads.values()]}), {c for c, _ in spreads.values()}
    rows = _with_running(rows, by, w, summed, squared, most)
    ends = {(c, k) for c, n in [*means.values(), *spreads.values()] for k in (1, n + 1)}
    rows = rows.withColumns({f"_upto_{c}_{k}": F.lag(f"_run_{c}", k).over(w) for c, k in sorted(ends)} | {name: F.lag(c, n).over(w) for name, (c, n) in lags.items()})
    made = {name: _mean(c, n) for name, (c, n) in means.items()} | {name: _spread(c, n) for name, (c, n) in spreads.items()}
    if number:
        made[number] = F.col("_rn")
    return rows.withColumns(made).where("_own").select(*df.columns, *means, *spreads, *lags, *([number] if number else []))


#: Times the size of nine tenths of a chunk's values from which a value is summed apart.
OUTLIER = float(1 << 20)
#: Counts of NaN, infinity and minus infinity in one whole number, so many bits each.
_ODD_BITS = 20


def _with_running(rows: DataFrame, by: Sequence[str], w, summed: Sequence[str], squared: set[str], most: int) -> DataFrame:
    """_run_{c}: sums over the chunk's rows up to the row itself: n (values), odd (those that aren't finite), s, t and u
    (exact part and rest of values, outliers), and of squared columns p, q and r (the same of squares)."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    rows = rows.withColumns({f"_x_{c}": finite(c) for c in summed})
    whole, upto = Window.partitionBy(*by), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = {f"_top_{c}": F.max(F.abs(f"_x_{c}")).over(whole) for c in summed}
    measured |= {f"_most_{c}": OUTLIER * F.percentile_approx(F.abs(f"_x_{c}"), 0.9, 100).over(whole) for c in summed}
    measured |= {f"_mid_{c}": F.percentile_approx(f"_x_{c}", 0.5, 100).over(whole) for c in squared}
    rows = rows.withColumns(measured)
    bits = 52 - most.bit_length()

    def split(value: Column, top: Column) -> tuple[Column, Column]:
        """value as a multiple of a unit, and the rest; as many multiples as a chunk has rows add up without rounding."""
        power = F.greatest(F.least(F.ceil(F.log2(top)) - bits, F.lit(1000)), F.lit(-1000))
        unit = F.coalesce(F.pow(F.lit(2.0), power), F.lit(1.0))
        exact = F.rint(value / unit) * unit
        return exact, value - exact

    runs = {}
    for c in summed:
        x, y = F.col(f"_x_{c}"), F.col(c).cast("double")
        odd = F.when(F.isnan(y), 1).when(y == float("inf"), 1 << _ODD_BITS).when(y == float("-inf"), 1 << 2 * _ODD_BITS).otherwise(0)
        top, outlier = F.least(f"_top_{c}", f"_most_{c}"), F.abs(x) > F.col(f"_most_{c}")
        parts = dict(zip("stu", (*split(F.when(~outlier, x), top), F.when(outlier, x))))
        if c in squared:
            square = (x - F.col(f"_mid_{c}")) ** 2
            parts |= dict(zip("pqr", (*split(F.when(~outlier, square), 4 * top**2), F.when(outlier, square))))
        sums = [F.count(x).over(upto).alias("n"), F.sum(odd.cast("long")).over(upto).alias("odd"), *[F.coalesce(F.sum(v).over(upto), F.lit(0.0)).alias(k) for k, v in parts.items()]]
        runs[f"_run_{c}"] = F.struct(*sums)
    return rows.withColumns(runs)


def _within(c: str, n: int, name: str) -> str:
    """A sum over the frame, as SQL: that up to its end less that up to its beginning. Frames are written as SQL because
    a column object costs a call to the JVM for each of the many operators."""
    upto = lambda k: f"coalesce(`_upto_{c}_{k}`.{name}, 0)"
    return f"({upto(1)} - {upto(n + 1)})"


def _odd(c: str, n: int) -> list[str]:
    """The frame's numbers of NaN, infinity and minus infinity."""
    packed = _within(c, n, "odd")
    return [f"(shiftright({packed}, {i * _ODD_BITS}) % {1 << _ODD_BITS})" for i in range(3)]


def _mean(c: str, n: int) -> Column:
    """Null for no value; of values that aren't all finite, what adding them gives."""
    count, (nans, up, down) = _within(c, n, "n"), _odd(c, n)
    total = " + ".join(_within(c, n, k) for k in "stu")
    return F.expr(f"""CASE WHEN {nans} = 0 AND {up} = 0 AND {down} = 0 THEN CASE WHEN {count} > 0 THEN ({total}) / {count} END
      WHEN {nans} > 0 THEN double('NaN') WHEN {down} = 0 THEN double('Infinity') WHEN {up} = 0 THEN double('-Infinity') ELSE double('NaN') END""")


def _spread(c: str, n: int) -> Column:
    """The sample deviation, null for fewer than two values, NaN for values that aren't all finite."""
    count, odd = _within(c, n, "n"), " + ".join(_odd(c, n))
    # The sum of distances to the median: its multiple is taken off the exact part first.
    away = f"(({_within(c, n, 's')} - `_mid_{c}` * {count}) + {_within(c, n, 't')} + {_within(c, n, 'u')})"
    squares = f"({' + '.join(_within(c, n, k) for k in 'pqr')})"
    rest = f"({squares} - {away} * {away} / {count})"
    value = f"CASE WHEN {rest} > {squares} * 1e-14D THEN sqrt({rest} / ({count} - 1)) ELSE 0.0D END"
    return F.expr(f"CASE WHEN {count} + {odd} > 1 THEN CASE WHEN {odd} > 0 THEN double('NaN') ELSE {value} END END")


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], short: int = 10, long: int = 60, block: Column | None = None) -> DataFrame:
    """{c}_r{short}_mean, {c}_r{long}_mean and {c}_r{long}_std over rows before the row."""
    means = {f"{c}_r{n}_mean": (c, n) for c in columns for n in (short, long)}
    return prior_rows(df, keys, order, means, {f"{c}_r{long}_std": (c, long) for c in columns}, block=block)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], offsets: Sequence[int] = (1, 5), block: Column | None = None) -> DataFrame:
    return prior_rows(df, keys, order, lags={f"{c}_lag{n}": (c, n) for c in columns for n in offsets}, block=block)


def drop_warmup(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = 60, block: Column | None = None) -> DataFrame:
    """Without the first rows of each key, whose frames aren't full."""
    return numbered(df, keys, order, "_warm", block).where(F.col("_warm") > rows).drop("_warm")


def split_by_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = 0.8, name: str = "split", block: Column | None = None) -> DataFrame:
    """`train` for the first whole share of each key's rows, `test` for the rest."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    placed = _joined(numbered(df, keys, order, "_at", block), totals, keys)
    cut = (F.col("_total") * share).cast("long")
    return placed.withColumn(name, F.when(F.col("_at") <= cut, F.lit("train")).otherwise(F.lit("test"))).drop("_at", "_total")


def tiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 4, name: str = "quartile", block: Column | None = None) -> DataFrame:
    """ntile(n), from row numbers and counts: the first (count mod n) tiles have one row more."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    placed = _joined(numbered(df, keys, order, "_at", block), totals, keys)
    size, more = F.floor(F.col("_total") / n), F.col("_total") % n
    large = more * (size + 1)
    at = F.col("_at") - 1
    tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
    return placed.withColumn(name, tile.cast("long")).drop("_at", "_total")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; Spark cuts each partition to one row a key before the shuffle."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def lead_intervals(df: DataFrame, key: str, start: str, end: str, last: float, ties: Sequence[str] = ()) -> DataFrame:
    """Half-open intervals from a key's sorted starts; the last one ends at `last`. Of equal starts all but the last by
    `ties` are empty."""
    return df.withColumn(end, F.lead(start, 1, last).over(Window.partitionBy(key).orderBy(start, *ties)))
