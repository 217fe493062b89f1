"""Ordered operators on streams against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from drillframe.operators import windows
from drillframe.streaming import ordered_stream, with_open_rows

START = dt.datetime(2020, 1, 1)
SCHEMA = "id long, k string, t timestamp, v double, w string, n long"
ASKED = {"fill": ["v", "w"], "lags": {"v_lag1": ("v", 1), "n_lag3": ("n", 3)}, "number": "rn"}


def made_rows(n, seed=1):
    """Rows up to a minute out of order, with nulls, equal times and one key that is rare."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "rare" if i % 97 == 5 else rng.choice("abb")
        at = START + dt.timedelta(seconds=i * 10 - rng.randint(0, 5) * 10)
        rows.append((i, key, at, None if rng.random() < 0.4 else rng.random(), rng.choice([None, None, "x", "y"]), (1 << 60) + i))
    return rows


def batch(df):
    by = ["k"], ["t", "id"]
    lagged = windows.prior_rows(df, *by, lags=ASKED["lags"], number="rn")
    return windows.forward_fill(lagged, *by, ASKED["fill"])


def run(spark, tmp_path):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = ordered_stream(rows, "k", "t", ties=["id"], **ASKED)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_equals_batch_after_each_file_and_restart(spark, tmp_path, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = made_rows(600)
        for part in range(3):
            spark.createDataFrame(rows[part * 200 : part * 200 + 200], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
            emitted = run(spark, tmp_path)  # each run starts anew from the checkpoint
            so_far = spark.createDataFrame(rows[: part * 200 + 200], SCHEMA)
            want = {tuple(r) for r in batch(so_far).select(*emitted.columns).collect()}
            got = [tuple(r) for r in emitted.collect()]
            assert len(set(got)) == len(got) > part * 190 and set(got) <= want
            whole = with_open_rows(emitted, so_far, "k", "t", "id", ties=["id"], **ASKED)
            assert sorted(map(tuple, whole.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_keys_and_times_are_left_out(spark, tmp_path):
    rows = [(1, None, START, 1.0, "x", 1), (2, "a", None, 1.0, "x", 1), (3, "a", START, None, None, 1), (4, "a", START + dt.timedelta(hours=1), 2.0, None, 2), (5, "a", START + dt.timedelta(hours=2), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in0")
    emitted = run(spark, tmp_path)
    assert {r.id for r in emitted.collect()} == {3, 4}
    whole = with_open_rows(emitted, spark.createDataFrame(rows, SCHEMA), "k", "t", "id", ties=["id"], **ASKED)
    assert {(r.id, r.v, r.w, r.v_lag1, r.rn) for r in whole.collect()} == {(3, None, None, None, 1), (4, 2.0, None, None, 2), (5, 2.0, None, 2.0, 3)}


def test_late_rows_are_dropped(spark, tmp_path):
    hour = lambda i, h: (i, "a", START + dt.timedelta(hours=h), float(i), None, i)
    for part, rows in enumerate(([hour(1, 5)], [hour(2, 9)], [hour(3, 1), hour(4, 12)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
        emitted = run(spark, tmp_path)
    assert sorted((r.id, r.rn, r.v_lag1) for r in emitted.collect()) == [(1, 1, None), (2, 2, 1.0)]


def test_rows_are_given_out_some_at_a_time_and_only_asked_columns_are_state(spark, sf, tmp_path, monkeypatch):
    from drillframe import catalogue, streaming
    from drillframe.streaming import ordered

    assert ordered.EMITTED < 1_000_000
    monkeypatch.setattr(ordered, "EMITTED", 7)
    rows = made_rows(300)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in0")
    emitted = run(spark, tmp_path)
    want = {tuple(r) for r in batch(spark.createDataFrame(rows, SCHEMA)).select(*emitted.columns).collect()}
    got = [tuple(r) for r in emitted.collect()]
    assert len(set(got)) == len(got) > 280 and set(got) <= want

    seen, made = [], streaming.ordered_stream
    monkeypatch.setattr(streaming, "ordered_stream", lambda df, *a, **k: seen.append(df.columns) or made(df, *a, **k))
    catalogue.QUERIES["q_lags_stream"](spark, sf)
    assert seen == [["event_id", "ts", "well_name", "wob", "rpm"]]


class Held:
    """State of one key, in memory, as the processor of ordered_stream asks for it."""

    def __init__(self):
        self.rows, self.value, self.timers, self.most = {}, None, set(), 0

    getMapState = getValueState = lambda self, *_: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.remove(ms)

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.rows[key] = value

    def getValue(self, key):
        return self.rows[key]

    def removeKey(self, key):
        del self.rows[key]


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("ties", [["id"], []])
def test_open_rows_are_read_in_pieces(monkeypatch, ties):
    import pandas as pd

    from drillframe.streaming import ordered

    for name, n in (("EMITTED", 20), ("RUN", 40), ("PIECE", 5), ("MERGED", 3)):
        monkeypatch.setattr(ordered, name, n)
    held, most, parted = Held(), [], ordered._Ordered._parted
    monkeypatch.setattr(ordered._Ordered, "_parted", lambda self, frames, *a: most.append(sum(map(len, frames))) or parted(self, frames, *a))
    made = ordered._Ordered("k", ["k", "id", "v", "x"], ["id", "v", "_us"], ["_us", *ties], ["v"], {"id_lag2": ("id", 2)}, "rn")
    made.columns[-1] = "_us"
    rng = random.Random(3)
    # Times from a few, so that many are equal; far more runs than are merged at once, in no order.
    rows = [("a", i, rng.choice([None, float(i)]), rng.randrange(1, 50) * 1_000_000) for i in range(1000)]
    rng.shuffle(rows)
    out = []
    for part, watermark in ((rows[:700], 0), ([], 20_000), ([r for r in rows[700:] if r[3] > 20_000_000], 20_000), ([], 30_500), ([], 60_000)):
        made = ordered._Ordered(made.by, made.columns, made.kept, made.order, made.fill, made.lags, made.number)
        made.init(held)
        if part:
            given = made.handleInputRows(("a",), (pd.DataFrame(part[k : k + 15]) for k in range(0, len(part), 15)), Now(watermark))
        else:
            held.timers.remove(min(held.timers))
            given = made.handleExpiredTimer(("a",), Now(watermark), None)
        out += [r for frame in given for r in frame.to_dict("records")]
        assert all(r["_us"] <= watermark * 1000 for r in out) and (not held.timers or min(held.timers) > watermark)
    want = sorted(rows[:700] + [r for r in rows[700:] if r[3] > 20_000_000], key=lambda r: (r[3], r[1] if ties else 0))
    assert [r["_us"] for r in out] == [r[3] for r in want] and [r["rn"] for r in out] == list(range(1, len(want) + 1))
    assert sorted(r["id"] for r in out) == sorted(r[1] for r in want) and not held.rows and not held.timers
    if ties:
        assert [r["id"] for r in out] == [r[1] for r in want] and [r["id_lag2"] for r in out[2:]] == [r[1] for r in want[:-2]]
        last, filled = None, []
        for r in want:
            last = last if r[2] is None else r[2]
            filled.append(last)
        assert [None if pd.isna(r["v"]) else r["v"] for r in out] == filled
    # What is sorted at once has a bound: a run and a frame, or a piece of each run and what is given out together.
    assert max(most) <= 55, max(most)


def test_state_is_pieces_of_wide_rows(spark, tmp_path, monkeypatch):
    from drillframe.streaming import ordered

    for name, n in (("EMITTED", 30), ("RUN", 50), ("RUN_BYTES", 4_000), ("MERGED", 2)):
        monkeypatch.setattr(ordered, name, n)
    rows = made_rows(300)
    random.Random(4).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in0")
    emitted = run(spark, tmp_path)
    want = {tuple(r) for r in batch(spark.createDataFrame(rows, SCHEMA)).select(*emitted.columns).collect()}
    got = [tuple(r) for r in emitted.collect()]
    assert len(set(got)) == len(got) > 280 and set(got) <= want
    read = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "pieces")
    first = read.option("batchId", 0).load().select(F.col("key._key"), F.length("user_map_value.rows").alias("n")).collect()
    assert len(first) >= 10 and max(r.n for r in first) < 4_000
    assert 0 < read.load().count() < 20


def test_repeated_hour_and_odd_names(spark, tmp_path):
    """Times in the hour that a zone's clocks repeat, a lag of them, a name with a space and a key that is no text."""
    schema = "`k y` int, t timestamp, `a-b` string, id long"
    asked = {"fill": ["a-b"], "lags": {"prev t": ("t", 1), "k1": ("k y", 1)}, "number": "rn"}
    start = dt.datetime(2024, 11, 3, 5, tzinfo=dt.timezone.utc)
    rows = [(i % 3, start + dt.timedelta(seconds=37 * i), None if i % 4 else f"x{i}", i) for i in range(200)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/in0")
        out = ordered_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in*"), "k y", "t", ties=["id"], **asked)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        by = ["k y"], ["t", "id"]
        want = windows.forward_fill(windows.prior_rows(df, *by, lags=asked["lags"], number="rn"), *by, asked["fill"]).select(*out.columns)
        whole = lambda d: {tuple(r) for r in d.withColumn("t", F.unix_micros("t")).withColumn("prev t", F.unix_micros("prev t")).collect()}
        got = whole(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"))
        assert len(got) > 190 and got <= whole(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
