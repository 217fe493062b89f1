"""Scalar functions of sensor logs, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a foot, as a divisor; and the largest value taken for metres.
FEET_PER_METRE, LARGEST_METRES = 3.28084, 10_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts: Column | str, size: str = "30 seconds") -> Column:
    """Start of the time bucket; keeps the type of ts and depends on no time zone."""
    return F.window(_col(ts), size)["start"]


def hour(ts: Column | str) -> Column:
    return bucket(ts, "1 hour")


def parse_time(text: Column | str) -> Column:
    """A timestamp, or null where the text is none."""
    return _col(text).try_cast("timestamp")


def in_window(ts: Column | str, first: str, before: str) -> Column:
    """first <= ts < before."""
    return (_col(ts) >= F.lit(first).cast("timestamp_ntz")) & (_col(ts) < F.lit(before).cast("timestamp_ntz"))


def is_month_start(ts: Column | str) -> Column:
    """Midnight on the first of a month: a placeholder in the sources rather than a time."""
    ts = _col(ts)
    return (F.dayofmonth(ts) == 1) & (F.date_trunc("DAY", ts).cast("timestamp_ntz") == ts.cast("timestamp_ntz"))


def cell(cells: Column, position: Column | int) -> Column:
    """A number out of split cells; out of range, empty, null or not a number gives null."""
    return F.btrim(F.get(cells, position if isinstance(position, Column) else F.lit(position)), F.lit(" \t\n\x0b\f\r")).try_cast("double")


def sum_as_zero(*columns: Column | str) -> Column:
    """The sum with nulls as zero."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(_col(c), F.lit(0.0))
    return total


def scale_of(highest: Column | str) -> Column:
    """What to multiply a depth by: a key whose highest depth can't be metres is in feet."""
    return F.when(_col(highest) > LARGEST_METRES, F.lit(1 / FEET_PER_METRE)).otherwise(F.lit(1.0))


def lookup(key: Column | str, values: dict[str, int], default: int = 0) -> Column:
    """A literal table looked up, with a default for other keys and null."""
    found = F.lit(default)
    for k, v in values.items():
        found = F.when(_col(key) == k, F.lit(v)).otherwise(found)
    return found


#: Entities and what stands for them once lower-cased.
ENTITIES = (("&#xf8;", "o"), ("&#xc5;", "a"), ("&#xe6;", "ae"), ("&#xf6;", "o"), ("&oslash;", "o"), ("&aring;", "a"))


def decode_entities(text: Column | str, entities: Sequence[tuple[str, str]] = ENTITIES) -> Column:
    """Lower-cased text with entities replaced, in order."""
    text = F.lower(_col(text))
    for entity, plain in entities:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def first_match(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the text contains, else null. Order decides where several do."""
    return F.coalesce(*[F.when(_col(text).contains(pattern), F.lit(name)) for pattern, name in rules])


def bridge_name(text: Column | str, pattern: str = r"F-(\d+)") -> Column:
    """The part of a name that both sources share, or null."""
    found = F.regexp_extract(_col(text), pattern, 0)
    return F.when(found != "", found)


def keyword_hit(text: Column | str, keyword: str) -> Column:
    """Contains the keyword, in any case."""
    return F.upper(_col(text)).contains(keyword.upper())


def band(value: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """The label of the first edge that value reaches, edges falling; one label more than edges, for the rest."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(_col(value) >= edge, F.lit(label)).otherwise(out)
    return F.when(_col(value).isNull(), F.lit(missing)).otherwise(out)


def nearest_bin(value: Column, edges: Column) -> Column:
    """Which of the bins (lo, hi] between sorted edges value lies in, the lowest edge included."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0))


def object_at(path: Column | str, level_from_end: int) -> Column:
    """A segment of a path, counted from its end, the name being 1."""
    return F.element_at(F.split(_col(path), "/"), -level_from_end)


def on_bottom(wob: str = "wob", rpm: str = "rpm", rop: str = "rop") -> Column:
    """Drilling: weight, rotation and progress all above idle."""
    return (F.col(wob) > 2) & (F.col(rpm) > 20) & (F.col(rop) > 1)


def on_bottom_any_speed(wob: str = "wob", rpm: str = "rpm", rop: str = "rop") -> Column:
    """Drilling, at whatever rotation, as long as it is known."""
    return (F.col(wob) > 2) & (F.col(rop) > 1) & F.col(wob).isNotNull() & F.col(rpm).isNotNull() & F.col(rop).isNotNull()


def thousands(value: Column | str, digits: int = 0) -> Column:
    """A number as reports print it: thousands apart by commas, so many decimal places."""
    return F.format_number(_col(value), digits)
