"""Operators on literal rows: edges, nulls, ties, skew."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from drillframe import functions as fn
from drillframe.operators import audits, intervals, stats, windows
from drillframe.plans import benchmarks, features, model, retrospective
from drillframe.plans import tops as tops_plan


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("", None), ("null", None), ("NULL", None), ("abc", None), (" 1.5 ", 1.5), (None, None)])
def test_cell(spark, text, want):
    line = None if text is None else f"t,{text}"
    assert one(spark, line, lambda x: fn.cell(F.split(x, ","), 1)) == want
    assert one(spark, line, lambda x: fn.cell(F.split(x, ","), 9)) is None


@pytest.mark.parametrize("text, want", [("2007", dt.datetime(2007, 1, 1)), ("2007.87", None), ("2007-05-01T10:00:00.000Z", dt.datetime(2007, 5, 1, 10))])
def test_parse_time(spark, text, want):
    assert one(spark, text, lambda x: fn.parse_time(x).cast("timestamp_ntz")) == want


def test_window_and_month_start(spark):
    rows = [(dt.datetime(2007, 1, 1, 0, 0, 1), True, False), (dt.datetime(2010, 1, 1), False, True), (dt.datetime(2008, 3, 1), True, True), (dt.datetime(2008, 3, 1, 0, 0, 0, 1000), True, False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, w boolean, m boolean")
    assert df.where((fn.in_window("ts", "2007-01-01", "2010-01-01") != F.col("w")) | (fn.is_month_start("ts") != F.col("m"))).count() == 0


def test_bucket_edges_and_means(spark):
    base = dt.datetime(2008, 1, 1, 10, 0, 29, 999000)
    df = spark.createDataFrame([("a", base, 1.0), ("a", base, None), ("a", base, 3.0), ("a", base + dt.timedelta(milliseconds=1), None)], "k string, ts timestamp_ntz, v double")
    got = {r.ts: r.v for r in audits.resample(df, "k", "ts", ["v"]).collect()}
    assert got == {dt.datetime(2008, 1, 1, 10): 2.0, dt.datetime(2008, 1, 1, 10, 0, 30): None}


def test_sum_as_zero_and_scale(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    assert [r.s for r in df.select(fn.sum_as_zero("a", "b", "c").alias("s")).collect()] == [3.0, 0.0]
    assert one(spark, 10_000.0, fn.scale_of, "double") == 1.0
    assert one(spark, 10_000.1, fn.scale_of, "double") == pytest.approx(1 / 3.28084)
    assert one(spark, None, fn.scale_of, "double") == 1.0


@pytest.mark.parametrize("name, want", [("T. Sleipner Fm", "Skagerrak"), ("Bl&#xF8;d&#xF8;ks", "Chalk"), ("Hordaland", None), ("", None), (None, None), ("TOR FM", "Chalk"), ("Ty Fm", "Ty")])
def test_first_match(spark, name, want):
    assert one(spark, name, tops_plan.canonical_formation) == want


@pytest.mark.parametrize("name, want", [("15/9-F-15S", "F-15"), ("F-12", "F-12"), ("X", None), (None, None)])
def test_bridge_name(spark, name, want):
    assert one(spark, name, fn.bridge_name) == want


def test_interval_edges_without_and_with_key(spark):
    tops = spark.createDataFrame([("w", 10.0, 20.0, "A", 1), ("w", 20.0, 20.0, "Z", 9), ("w", 20.0, 99.0, "B", 2)], "well string, lo double, hi double, formation string, formation_id int")
    rows = spark.createDataFrame([("w", 10.0), ("w", 20.0), ("w", 5.0), ("w", None), ("v", 15.0)], "well string, d double")
    got = intervals.interval_label(rows, tops, "well", "d", "lo", "hi", {"formation": "Unknown", "formation_id": 0})
    want = {("w", 10.0): 1, ("w", 20.0): 2, ("w", 5.0): 0, ("w", None): 0, ("v", 15.0): 0}
    assert {(r.well, r.d): r.formation_id for r in got.collect()} == want
    free = intervals.range_label(rows, tops, "d", "lo", "hi", 7.0, ["formation"])
    assert {(r.well, r.d): r.formation for r in free.collect()} == {("w", 10.0): "A", ("w", 20.0): "B", ("w", 5.0): None, ("w", None): None, ("v", 15.0): "A"}


def test_large_intervals_join_by_key(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_BYTES", 0)
    tops = spark.range(1000).selectExpr("CAST(id % 7 AS STRING) AS well", "id * 1D AS lo", "id + 1D AS hi", "id AS n")
    assert not intervals.small_enough(tops, 0)
    rows = spark.range(500).selectExpr("CAST(id % 7 AS STRING) AS well", "id + 0.5D AS d")
    assert intervals.interval_label(rows, tops, "well", "d", "lo", "hi", {"n": -1}).where("n < 0").count() == 0


def rows_of(spark, n_hot=2500, n_cold=70):
    made = [("hot", i, float(i % 13) if i % 7 else None) for i in range(n_hot)] + [("cold", i, float(i)) for i in range(n_cold)]
    return spark.createDataFrame(made, "k string, t int, v double").repartition(5)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 100)


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_blocks_and_chunks_change_nothing(spark, small_chunks):
    df, block = rows_of(spark).cache(), F.floor(F.col("t") / 333)
    keys, order = ["k"], ["t"]
    assert same(windows.numbered(df, keys, order), windows.numbered(df, keys, order, block=block))
    assert same(windows.forward_fill(df, keys, order, ["v"]), windows.forward_fill(df, keys, order, ["v"], block))
    for f in (windows.rolling, windows.lagged):
        assert same(f(df, keys, order, ["v"]), f(df, keys, order, ["v"], block=block))
    assert same(windows.split_by_position(df, keys, order), windows.split_by_position(df, keys, order, block=block))
    assert same(windows.tiles(df, keys, order), windows.tiles(df, keys, order, block=block))
    # Frames longer than a chunk were refused; chunks grow with them now.
    assert same(windows.rolling(df, keys, order, ["v"], long=101), windows.rolling(df, keys, order, ["v"], long=101, block=block))


def test_forward_fill_keeps_to_its_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 2.0), ("b", 1, None)], "k string, t int, v double")
    for block in (None, F.col("t")):
        got = {(r.k, r.t): r.v for r in windows.forward_fill(df, ["k"], ["t"], ["v"], block).collect()}
        assert got == {("a", 1): None, ("a", 2): 1.0, ("a", 3): 1.0, ("a", 4): 2.0, ("b", 1): None}


def test_rolling_first_rows(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 6.0), ("a", 3, 8.0)], "k string, t int, v double")
    got = [tuple(r)[3:] for r in windows.rolling(df, ["k"], ["t"], ["v"]).orderBy("t").collect()]
    assert got == [(None, None, None), (4.0, 4.0, None), (5.0, 5.0, pytest.approx(2**0.5))]


@pytest.mark.parametrize("n, left", [(60, 0), (61, 1)])
def test_warmup(spark, n, left):
    assert windows.drop_warmup(spark.range(n).selectExpr("'a' AS k", "id AS t"), ["k"], ["t"]).count() == left


@pytest.mark.parametrize("n, train", [(5, 4), (9, 7), (1, 0)])
def test_split(spark, n, train):
    assert windows.split_by_position(spark.range(n).selectExpr("'a' AS k", "id AS t"), ["k"], ["t"]).where("split = 'train'").count() == train


def test_tiles_sizes(spark):
    got = windows.tiles(spark.range(5).selectExpr("'a' AS k", "id AS t"), ["k"], ["t"]).groupBy("quartile").count().orderBy("quartile").collect()
    assert [r["count"] for r in got] == [2, 1, 1, 1]
    assert windows.tiles(spark.range(2).selectExpr("'a' AS k", "id AS t"), ["k"], ["t"]).orderBy("t").select("quartile").collect() == [(1,), (2,)]


def test_clip_turns_null_to_upper_bound(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (5.0,), (50.0,)], "v double")
    bounds = spark.createDataFrame([(0.0, 10.0)], "v_lo double, v_hi double")
    assert sorted(r.v for r in stats.clip(df, bounds, ["v"]).collect()) == [0.0, 5.0, 10.0, 10.0]


def test_fill_zero_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert tuple(stats.zero_fill(df, ["a", "b"]).first()) == (0.0, 0.0)
    assert tuple(stats.nan_to_null(df, ["b"]).first()) == (None, None)
    assert stats.fill_with(df, stats.medians(df, ["a"]), ["a"]).first().a is None


def test_bins_include_both_ends(spark):
    df = spark.range(101).selectExpr("id * 1D AS v")
    edges = F.array(*[F.lit(float(x)) for x in (0, 20, 40, 60, 80, 100)])
    got = {r.v: r.b for r in df.select("v", fn.nearest_bin(F.col("v"), edges).alias("b")).collect()}
    assert [got[x] for x in (0.0, 20.0, 20.0, 21.0, 100.0)] == [0, 0, 0, 1, 4]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 5.0)], "k string, y double, p double")
    r = audits.regression_metrics(df.where("k = 'a'"), "y", "p").first()
    assert (r.n_rows, r.rmse, r.mae, r.r2) == (2, pytest.approx(0.5**0.5), 0.5, 0.5)
    assert [r.k for r in audits.regression_metrics(df, "y", "p", ["k"], 2).collect()] == ["a"]
    assert audits.regression_metrics(df.where("k = 'b'"), "y", "p").first().r2 is None


def test_efficiency_floor_and_bands(spark):
    df = spark.createDataFrame([(2.0, 0.1), (None, 1.0)], "rop double, pred_rop double")
    assert [r.efficiency for r in retrospective.efficiency(df).collect()] == [4.0, None]
    label = lambda x: fn.band(x, [1.1, 0.85, 0.7], ["a", "b", "c", "d"], "none")
    assert [one(spark, v, label, "double") for v in (1.1, 1.0, 0.7, 0.1, None)] == ["a", "b", "c", "d", "none"]


def test_key_against_field_support(spark):
    rows = spark.range(99).selectExpr("CASE WHEN id < 49 THEN 'few' ELSE 'enough' END AS w", "1 AS g", "id * 1D AS rop")
    assert [r.w for r in benchmarks.key_against_field(rows, "w", ["g"]).collect()] == ["enough"]


def test_null_key_falls_in_neither_part(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "well_name string")
    train, test = features.split_by_key(df, ["b"])
    assert (train.count(), test.count()) == (1, 1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert windows.rolling(df, ["k"], ["t"], ["v"], block=F.col("t")).count() == 0
    assert windows.forward_fill(df, ["k"], ["t"], ["v"], F.col("t")).count() == 0


def test_feature_matrix_has_thirty_features(spark, sf):
    from drillframe import catalogue

    train, test = catalogue.matrices(spark, sf)
    names = [c for c in train.columns if c not in ("event_id", "well_name", "ts", "rop")]
    assert len(names) == 30 and train.columns == test.columns
    assert train.select([F.count_if(F.col(c).isNull()).alias(c) for c in names]).first() == tuple([0] * 30)


def boosting_rows(spark, n=4000):
    return spark.range(n).selectExpr("'a' AS well_name", "id AS ts", "CAST(id % 40 AS DOUBLE) AS x", "id % 40 + IF(hash(id) % 2 = 0, 50D, -50D) AS rop")


def test_trees_go_on_from_the_residual_and_none_is_fitted_twice(spark, monkeypatch):
    """Each round gains less than 1 % here, where the learner's own early stopping ends at once."""
    made, fit = [], model.RandomForestRegressor.fit

    def counted(self, rows):
        left = rows.agg(F.avg(F.col("_left") ** 2)).first()[0]
        made.append((self.getSeed(), self.getNumTrees(), left))
        return fit(self, rows)

    monkeypatch.setattr(model.RandomForestRegressor, "fit", counted)
    settings = {"maxIter": 33, "maxDepth": 2, "minInstancesPerNode": 5, "validation": 0.2, "patience": 15}
    df = boosting_rows(spark)
    fitted = model.fit(df, ["x"], settings=settings)
    assert sum(n for _, n, _ in made) == fitted.fitted <= 33 and len({seed for seed, _, _ in made}) == len(made)
    assert all(a > b for (_, _, a), (_, _, b) in zip(made, made[1:]))
    assert model.n_trees(fitted) > 2 and model.n_trees(fitted) == min(33, fitted.errors.index(min(fitted.errors)) * model.AT_ONCE)
    top = model.importances(fitted).collect()
    assert [(r.place, r.feature) for r in top] == [(1, "x")] and top[0].importance == pytest.approx(1)
    rows = fitted.assembler.transform(df.limit(5)).collect()
    want = [fitted.mean + model.RATE * sum(t.predict(r.features) for t in fitted.trees.trees) for r in rows]
    assert [r.pred_rop for r in model.predict(fitted, df.limit(5)).collect()] == pytest.approx(want)
    kept = model.holdout(df, 0.2).where("is_validation")
    error = model.predict(fitted, kept).agg(F.avg((F.col("rop") - F.col("pred_rop")) ** 2)).first()[0]
    assert error == pytest.approx(min(fitted.errors), rel=0.2)


def test_fit_without_validation_rows_or_any(spark):
    settings = {"maxIter": 7, "maxDepth": 2, "minInstancesPerNode": 5, "validation": 0.0, "patience": 5}
    df = boosting_rows(spark, 300)
    assert model.n_trees(model.fit(df, ["x"], settings=settings)) == 7
    none = model.fit(df.limit(0), ["x"], settings=settings)
    assert model.n_trees(none) == 0 and model.predict(none, df.limit(1)).first().pred_rop == 0.0


def test_trees_are_the_same_whatever_the_partitions(spark):
    settings = {"maxIter": 10, "maxDepth": 3, "minInstancesPerNode": 5, "validation": 0.2, "patience": 10}
    df = boosting_rows(spark)
    one, many = (model.fit(df.repartition(n, "ts"), ["x"], settings=settings) for n in (1, 7))
    assert one.errors == pytest.approx(many.errors, rel=1e-6) and len(one.errors) == 3
    assert [t.toDebugString.split("\n")[1:] for t in one.trees.trees][0] == [t.toDebugString.split("\n")[1:] for t in many.trees.trees][0]


def test_a_tree_splits_where_all_splits_tried_are_best(spark):
    from drillframe.plans import forest

    rows = [(float(i % 13), float(i % 7), i, 3.0 * (i % 13 > 4) + (i % 7 > 2) + 0.1 * (i % 5), False) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, _draw long, _left double, is_validation boolean")
    edges = forest.cuts(df, ["a", "b"], 32)
    made = forest.binned(df, ["a", "b"], edges)
    tree = forest.RandomForestRegressor(2, 32, 2, 20, 1, 42, subsamplingRate=1.0, featureShare=1.0).fit(made)[0]

    def best(some):
        """Sum of squares, feature and cut of the best split."""
        square = lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for x in xs)
        tried = [(f, c, [r[3] for r in some if r[f] <= c], [r[3] for r in some if r[f] > c]) for f in (0, 1) for c in edges[f]]
        return min((square(low) + square(high), f, c) for f, c, low, high in tried if min(len(low), len(high)) >= 20)[1:]

    assert (tree.feature[0], edges[0][tree.cut[0]]) == best(rows) == (0, 4.0)
    for side, some in ((1, [r for r in rows if r[0] <= 4]), (2, [r for r in rows if r[0] > 4])):
        assert (tree.feature[side], edges[tree.feature[side]][tree.cut[side]]) == best(some)
        assert tree.rows[side] == len(some) and tree.value[side] == pytest.approx(sum(r[3] for r in some) / len(some))


def test_a_feature_that_is_null_is_an_error(spark):
    settings = {"maxIter": 5, "maxDepth": 2, "minInstancesPerNode": 5, "validation": 0.0, "patience": 5}
    with pytest.raises(Exception, match="null or NaN"):
        model.fit(boosting_rows(spark, 100).withColumn("x", F.when(F.col("ts") > 5, F.col("x"))), ["x"], settings=settings)


def test_importances_rank_by_what_features_tell(spark):
    df = spark.range(3000).selectExpr("'a' AS well_name", "id AS ts", "CAST(id % 7 AS DOUBLE) AS much", "CAST(id % 11 AS DOUBLE) AS some", "rand(1) AS none", "10D * (id % 7) + (id % 11) AS rop")
    settings = {"maxIter": 20, "maxDepth": 4, "minInstancesPerNode": 5, "validation": 0.1, "patience": 10}
    top = model.importances(model.fit(df, ["none", "some", "much"], settings=settings)).collect()
    assert [r.feature for r in top] == ["much", "some", "none"] and sum(r.importance for r in top) == pytest.approx(1)
    assert len(model.importances(model.fit(df, ["none", "some", "much"], settings=settings), 2).collect()) == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_share_takes_the_same_rows_whatever_the_partitions(spark, parts):
    from drillframe.operators.sampling import exact_share

    df = spark.range(1000).selectExpr("id", "id % 3 AS k", "CAST(NULL AS STRING) AS n")
    got = {r.id for r in exact_share(df.repartition(parts), 0.15, ["id"]).where("is_validation").collect()}
    assert len(got) == 150 and got == {r.id for r in exact_share(df.orderBy(F.desc("id")), 0.15, ["id"]).where("is_validation").collect()}
    tied = {r.id for r in exact_share(df.repartition(parts), 0.5, ["k"]).where("is_validation").collect()}
    assert len(tied) == 500 and tied == {r.id for r in exact_share(df, 0.5, ["k"]).where("is_validation").collect()}
    same = exact_share(spark.range(100).selectExpr("1 AS a", "'x' AS b").repartition(parts), 0.37, ["a"])
    assert same.count() == 100 and same.where("is_validation").count() == 37
    assert exact_share(df.limit(0), 0.5, ["k"]).count() == 0 and exact_share(df, 0.0, ["id"]).where("is_validation").count() == 0
    assert exact_share(df, 1.0, ["n"]).where("is_validation").count() == 1000


def test_kth_smallest(spark):
    from drillframe.operators.sampling import kth_smallest

    values = [-(1 << 63), -5, -5, -1, 0, 3, 3, 3, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    for k in range(1, len(values) + 1):
        v = values[k - 1]
        assert kth_smallest(df, "v", k) == (v, sum(x < v for x in values), values.count(v))


def test_long_and_open_ended_intervals_without_key(spark):
    """Dealt to every cell of their own, these would be 10 million rows and more than an array can hold."""
    spans = spark.createDataFrame([(0.0, 5.0, "A"), (5.0, 1e8, "B"), (2.0, float("inf"), "C"), (float("-inf"), 1.0, "D"), (9.0, 9.0, "E")], "lo double, hi double, f string")
    rows = [-1e300, -1.0, 0.0, 1.0, 2.0, 4.9, 5.0, 9.0, 99_999_999.0, 1e8, 1e300, None]
    got = intervals.range_label(spark.createDataFrame([(x,) for x in rows], "d double"), spans, "d", "lo", "hi", 10.0, ["f"]).collect()
    want = [(x, f) for x in rows for f in ([s.f for s in spans.collect() if x is not None and s.lo <= x < s.hi] or [None])]
    assert sorted(map(str, got)) == sorted(f"Row(d={x!r}, f={f!r})" for x, f in want)


def test_null_keys_and_null_order_values_stay(spark, small_chunks):
    made = [(k, None if i == 3 else i, float(i) if i % 3 else None) for k in ("a", None) for i in range(250)]
    df, block, by = spark.createDataFrame(made, "k string, t int, v double").repartition(3).cache(), F.floor(F.col("t") / 60), (["k"], ["t"])
    assert windows.numbered(df, *by, block=block).count() == windows.split_by_position(df, *by).count() == windows.tiles(df, *by).count() == len(made)
    assert same(windows.numbered(df, *by), windows.numbered(df, *by, block=block))
    assert same(windows.forward_fill(df, *by, ["v"]), windows.forward_fill(df, *by, ["v"], block))
    assert same(windows.lagged(df, *by, ["v"]), windows.lagged(df, *by, ["v"], block=block))
    for f in (windows.split_by_position, windows.tiles):
        assert same(f(df, *by), f(df, *by, block=block))


@pytest.mark.parametrize("accuracy", [1_000_000, 100])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Equal to Spark's own, which holds a group's values in one task; also where the approximation is coarse."""
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    made = [(k, 1, None if i % 11 == 0 else float((i * 7919) % 5003) / 7, float(i % 3)) for k, n in (("a", 4000), ("b", 3), ("c", 2), ("d", 1), (None, 57)) for i in range(n)] + [("e", 1, None, None), ("f", 1, 2.0, None)]
    df, shares = spark.createDataFrame(made, "k string, j int, v double, w double"), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.k: (r.v_q, r.w_q) for r in stats.exact_quantiles(df, ["k", "j"], ["v", "w"], shares).collect()}
    want = {r.k: (r.v, r.w) for r in df.groupBy("k", "j").agg(F.percentile("v", shares).alias("v"), F.percentile("w", shares).alias("w")).collect() if r.v or r.w}
    assert set(got) == set(want)
    for k, pair in want.items():
        for mine, theirs in zip(got[k], pair):
            assert mine == (None if theirs is None else pytest.approx(theirs))
    whole = stats.exact_quantiles(df, [], ["v"], [0.3]).first().v_q[0]
    assert whole == pytest.approx(df.agg(F.percentile("v", 0.3)).first()[0])


def test_no_plan_holds_a_group_of_values(spark, sf):
    from drillframe import catalogue

    for name in ("q_describe", "q_residual_quantiles", "q_key_summary", "q_qcut_heatmap"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert stats.exact_quantiles(df, ["k"], ["v"], [0.5]).count() == 0
    r = audits.describe(df, "v").first()
    assert (r.n_rows, r.mean, r.p50) == (0, None, None)


class Settings(dict):
    """As much of a session as tells where to store."""

    @property
    def conf(self):
        return self


def test_no_temporary_folder_on_a_cluster():
    from drillframe.operators import durable

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_folder(Settings({"spark.master": "spark://host:7077"}))
    assert durable.shared_folder(Settings({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    local = Settings({"spark.master": "local[2]", "spark.app.id": "one"})
    assert durable.shared_folder(local) == durable.shared_folder(local)


def test_stored_rows_are_cleared(spark):
    import os

    from drillframe.operators import durable

    assert durable.stored(spark.range(3)).count() == 3
    assert os.listdir(durable.own_folder(spark))
    durable.clear(spark)
    assert not os.path.exists(durable.own_folder(spark))


def test_steps_of_a_stage_are_deleted_and_its_rows_stay(spark):
    import os

    from drillframe.operators import durable

    before = durable.stored(spark.range(4))
    start = durable.mark(spark)
    step = durable.stored(before.selectExpr("id + 1 AS id"))
    result = durable.stored(step.selectExpr("id + 1 AS id"))
    durable.discard_since(spark, start, result)
    assert not os.path.exists(step.inputFiles()[0].removeprefix("file://")) and before.count() == result.count() == 4
    durable.discard(before)
    durable.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert durable.mark(spark) == start and result.count() == 4 and spark.read.parquet("/root/testdata/sf0.001/region.parquet").count() == 5
    assert not os.path.exists(before.inputFiles()[0].removeprefix("file://"))


def test_medians_and_bounds_are_exact_with_small_sketches(spark, monkeypatch):
    """Sketches nearly as large as the rows were merged by one task, and missed by ranks beyond a million rows."""
    monkeypatch.setattr(stats, "COARSE", 20)
    rows = [(float((i * 7919) % 10_007), i % 3, None if i % 4 else float(i), float("nan") if i % 2 else float(i), None) for i in range(10_007)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(7)
    columns = ["a", "b", "c", "d", "e"]
    got, shares = stats.discrete_quantiles(df, columns, [0.0, 0.01, 0.5, 0.99, 1.0]).first(), [0.0, 0.01, 0.5, 0.99, 1.0]
    for i, c in enumerate(columns[:3]):
        held = sorted(r[i] for r in rows if r[i] is not None)
        assert got[c] == [held[max(1, len(held) - int(len(held) - len(held) * p)) - 1] for p in shares], c
    assert got.d[:3] == [0.0, 200.0, 10_006.0] and all(x != x for x in got.d[3:]) and got.e == [None] * 5 and isinstance(got.b[0], int)
    assert stats.medians(df.where("a < 0"), columns).first() == (None,) * 5 and stats.bounds(df, ["a"]).first() == (100.0, 9906.0)
    plan = stats.medians(df, columns)._jdf.queryExecution().optimizedPlan().toString()
    assert str(stats.ACCURACY) not in plan


def test_stored_blocks_spare_forward_fill_a_shuffle(spark):
    from drillframe.operators.durable import stored

    df = spark.range(1000).selectExpr("'k' AS k", "id AS t", "if(id % 5 = 0, id, null) AS v")
    fill = lambda **kw: windows.forward_fill(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / 100), **kw)
    made = fill(keep=stored)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(made.collect()) == sorted(fill().collect()) == [("k", i, i // 5 * 5) for i in range(1000)]
