"""Ordered operators on streams: forward fill, lags and row numbers by key, in the order of time.

A row comes out once the watermark has passed its time, as no earlier one can come then: results are those of the batch
operators, row by row. The rows that the watermark hasn't passed are kept as sorted pieces, which are merged when it does;
besides them a key's state is what the next row needs: the last values, the last few rows and the number of rows so far.
Pieces are read one by one, so that a task's memory has a bound however many rows of a key are open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from drillframe.operators import windows

# Spark plans this state in a Python process beside the driver, which doesn't get the files that executors do.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that are given out together.
EMITTED = 50_000
#: Rows of a key that are sorted together when they come, a run, and rows of it that are stored together, a piece. Of
#: wide rows there are fewer: a run has about RUN_BYTES, a piece RUN_BYTES / MERGED.
RUN, PIECE, RUN_BYTES = 200_000, 4_000, 64 << 20
#: Runs that are merged at once; of each, one piece is in memory.
MERGED = 64


def _packed(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas() if data else pd.DataFrame()


def _size(frame: pd.DataFrame) -> int:
    return int(frame.memory_usage(index=False, deep=True).sum())


def _joined(frames: Sequence[pd.DataFrame]) -> pd.DataFrame:
    some = [x for x in frames if len(x)]
    return pd.concat(some, ignore_index=True) if some else pd.DataFrame()


class _Ordered(StatefulProcessor):
    """A key's rows in order. columns: of the rows that come; kept: those of the state; order: what sorts them."""

    def __init__(self, key: str, columns: Sequence[str], kept: Sequence[str], order: Sequence[str], fill: Sequence[str], lags: dict[str, tuple[str, int]], number: str | None):
        self.by, self.columns, self.kept, self.order, self.fill, self.lags, self.number = key, list(columns), list(kept), list(order), fill, lags, number
        self.back = max((n for _, n in lags.values()), default=0)
        self.emitted, self.run, self.piece, self.run_bytes, self.merged = EMITTED, RUN, PIECE, RUN_BYTES, MERGED

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "id long", "rows binary")
        # passed: the watermark up to which rows are out; next: the next piece's and run's number; open: the first row of each piece.
        self.state = handle.getValueState("state", "count long, passed long, next long, timer long, open binary, tail binary, last binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        waiting, n, size = [], 0, 0
        for frame in rows:
            frame.columns = self.columns
            frame = frame.loc[frame["_us"] > self.passed, self.kept] if self.passed is not None else frame[self.kept]
            waiting, n, size = [*waiting, frame], n + len(frame), size + _size(frame)
            if n >= self.run or size >= self.run_bytes:
                self._keep(waiting)
                waiting, n, size = [], 0, 0
        if n:
            self._keep(waiting)
        del waiting
        yield from self._give_out(key, timerValues.getCurrentWatermarkInMs())
        self._save()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self.timer = None  # Spark deletes it
        yield from self._give_out(key, timerValues.getCurrentWatermarkInMs())
        self._save()

    def close(self) -> None:
        pass

    def _load(self) -> None:
        known = self.state.get() if self.state.exists() else (0, None, 0, None, None, None, None)
        self.count, self.passed, self.next, self.timer = known[:4]
        self.open, self.tail, carried = map(_unpacked, known[4:])
        self.last = {c: carried[c].iloc[0] for c in carried.columns}

    def _save(self) -> None:
        """Stores what the next call needs, and has Spark call once the first open row can come out."""
        timer = -(-int(self.open["_us"].min()) // 1000) if len(self.open) else None
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        frames = self.open, self.tail, pd.DataFrame([self.last]) if self.last else pd.DataFrame()
        self.state.update((self.count, self.passed, self.next, timer, *[_packed(x) if len(x) else None for x in frames]))

    def _keep(self, frames: Sequence[pd.DataFrame]) -> None:
        """Rows as they come become a run."""
        self.open = _joined([self.open, self._stored([self._parted(frames)[0]])])

    def _parted(self, frames: Sequence[pd.DataFrame], first: pd.DataFrame | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows in order: those that are not behind `first`, and those that are."""
        rows = pd.concat(frames, ignore_index=True)
        # Columns of the order alone are sorted, and rows then taken once.
        by = rows[self.order] if first is None else pd.concat([rows[self.order], first[self.order]], ignore_index=True)
        at = by.sort_values(self.order, kind="stable").index.to_numpy()
        cut = len(rows) if first is None else int((at == len(rows)).argmax())
        return rows.iloc[at[:cut]], rows.iloc[at[cut + 1 :]]

    def _stored(self, ordered: Iterable[pd.DataFrame]) -> pd.DataFrame:
        """Stores rows that come in order as a run, and returns the first row of each piece."""
        run, firsts = self.next, []
        for rows in ordered:
            n = max(1, min(self.piece, self.run_bytes // self.merged * len(rows) // max(1, _size(rows))))
            first = rows[self.order].iloc[::n]
            firsts.append(first.assign(_run=run, _id=range(self.next, self.next + len(first))))
            for k in range(len(first)):
                self.pieces.updateValue((self.next + k,), (_packed(rows.iloc[k * n : (k + 1) * n]),))
            self.next += len(first)
        return _joined(firsts)

    def _taken(self, firsts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All rows of these pieces in order; pieces leave the state. Rows can go once they are not behind the first row
        of any piece that isn't read yet: at most one piece of each run stays."""
        firsts = firsts.sort_values(self.order, kind="stable")
        rest, k = [], 0
        while k < len(firsts):
            n = 0
            while k < len(firsts) and n < self.emitted and len(rest) < 2 * self.merged:
                number = (int(firsts["_id"].iloc[k]),)
                rest.append(_unpacked(self.pieces.getValue(number)[0]))
                self.pieces.removeKey(number)
                n, k = n + len(rest[-1]), k + 1
            rows, behind = self._parted(rest, firsts.iloc[[k]] if k < len(firsts) else None)
            rest = [behind] if len(behind) else []
            yield rows

    def _give_out(self, key: tuple, watermark_ms: int) -> Iterator[pd.DataFrame]:
        us = watermark_ms * 1000
        self.passed = us if self.passed is None else max(us, self.passed)
        if not len(self.open):
            return
        is_ready = self.open["_us"] <= us
        ready, self.open = self.open[is_ready], self.open[~is_ready]
        while len(runs := ready["_run"].unique()) > self.merged:
            ready = _joined([self._stored(self._taken(ready[ready["_run"].isin(runs[k : k + self.merged])])) for k in range(0, len(runs), self.merged)])
        later = []  # of pieces that begin before the watermark
        for rows in self._taken(ready):
            n = int((rows["_us"] <= us).sum())
            later += [rows.iloc[n:]] if n < len(rows) else []
            for k in range(0, n, self.emitted):
                yield self._emit(rows.iloc[k : min(k + self.emitted, n)]).assign(**{self.by: key[0]})
        self.open = _joined([self.open, self._stored(later)])

    def _emit(self, ready: pd.DataFrame) -> pd.DataFrame:
        """Ready rows in order, with what the rows before them leave behind."""
        whole = pd.concat([self.tail, ready], ignore_index=True) if len(self.tail) else ready.reset_index(drop=True)
        out = ready.reset_index(drop=True).copy()
        for name, (c, n) in self.lags.items():
            # As objects: whole numbers with a gap among them would become floats.
            out[name] = pd.Series([None] * n + whole[c].tolist(), dtype=object).iloc[len(self.tail) : len(whole)].to_numpy()
        for c in self.fill:
            filled = out[c].ffill()
            out[c] = filled.where(filled.notna(), self.last[c]) if self.last.get(c) is not None else filled
            if len(out) and pd.notna(out[c].iloc[-1]):
                self.last[c] = out[c].iloc[-1]
        if self.number:
            out[self.number] = range(self.count + 1, self.count + 1 + len(out))
        self.count, self.tail = self.count + len(out), whole.tail(self.back)
        return out


def ordered_stream(rows: DataFrame, key: str, ts: str, fill: Sequence[str] = (), lags: dict[str, tuple[str, int]] | None = None, number: str | None = None, ties: Sequence[str] = (), late: str = "2 minutes") -> DataFrame:
    """rows with the columns of `fill` carried forward, lags (name -> (column, n)) and the row's number by key, for rows
    that come up to `late` out of order. Equal times go by `ties`. A null key or time is left out, as a watermark can't
    pass it, and so is a row that comes when its key's rows up to a later watermark are out. Whole numbers of columns that
    hold nulls are exact up to 2^53, and NaN counts as null. Sets the session's state store to RocksDB, which state in
    pieces needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    kinds = {f.name: f.dataType.simpleString() for f in known.schema} | {"_us": "long"}
    # Times go as whole numbers, as those of pandas depend on the session's zone; not every name can be that of a state's key.
    times = [ts, *[name for name, (c, _) in (lags or {}).items() if c == ts]]
    lags = {name: ("_us" if c == ts else c, n) for name, (c, n) in (lags or {}).items()}
    kept = [c for c in known.columns if c != ts and (c != key or c in {c for c, _ in lags.values()})] + ["_us"]
    sent = known.withColumn("_us", F.unix_micros(ts)).select(F.col(key).alias("_key"), *kept)
    extra = {name: kinds[c] for name, (c, _) in lags.items()} | ({number: "long"} if number else {})
    made = ", ".join(f"`{c}` {k}" for c, k in ({"_key": kinds[key]} | {c: kinds[c] for c in kept} | extra).items())
    processor = _Ordered("_key", sent.columns, kept, ["_us", *ties], [c for c in fill if c not in (key, ts)], lags, number)
    out = sent.groupBy("_key").transformWithStateInPandas(processor, made, "append", "eventTime").withColumn(ts, F.col("_us"))
    return out.withColumns({key: F.col("_key")} | {c: F.timestamp_micros(c).cast(kinds[ts]) for c in times}).select(*known.columns, *extra)


def with_open_rows(emitted: DataFrame, rows: DataFrame, key: str, ts: str, row_id: str, fill: Sequence[str] = (), lags: dict[str, tuple[str, int]] | None = None, number: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """What a stream over `rows` has emitted, and the rows that it still holds, done in batch from the last ones emitted
    before them. row_id tells rows apart."""
    lags = lags or {}
    back = max([n for _, n in lags.values()] + [1])
    missing = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).join(emitted.select(row_id), row_id, "left_anti").withColumn("_open", F.lit(True))
    recent = _last_of(emitted, key, [ts, *ties], back)
    # Emitted rows have their columns filled; lags need them as they came.
    raw = rows.join(recent.select(row_id, *[F.col(c).alias(f"_filled_{c}") for c in fill], *([F.col(number).alias("_number")] if number else [])), row_id)
    both = raw.withColumn("_open", F.lit(False)).unionByName(missing, allowMissingColumns=True)
    by = [key], [ts, *ties]
    out = windows.prior_rows(both, *by, lags=lags) if lags else both
    for c in fill:
        out = out.withColumn(c, F.coalesce(f"_filled_{c}", c)).drop(f"_filled_{c}")
    out = windows.forward_fill(out, *by, list(fill)) if fill else out
    if number:
        start = out.groupBy(F.col(key).alias("_key")).agg(F.coalesce(F.max("_number"), F.lit(0)).alias("_start"))
        own = windows.numbered(out.where("_open"), *by, number)
        out = own.join(start, F.col(key) == F.col("_key")).withColumn(number, F.col(number) + F.col("_start")).drop("_key", "_start", "_number")
    return emitted.unionByName(out.where("_open").select(*emitted.columns))


def _last_of(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_last", F.row_number().over(last)).where(F.col("_last") <= n).drop("_last")
