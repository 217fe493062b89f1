"""Column functions: everything takes and gives a Column."""

from .scalars import band, bridge_name, bucket, cell, decode_entities, first_match, hour, in_window, is_month_start, keyword_hit, lookup, nearest_bin, object_at, on_bottom, on_bottom_any_speed, parse_time, scale_of, sum_as_zero, thousands

__all__ = ["band", "bridge_name", "bucket", "cell", "decode_entities", "first_match", "hour", "in_window", "is_month_start", "keyword_hit", "lookup", "nearest_bin", "object_at", "on_bottom", "on_bottom_any_speed", "parse_time", "scale_of", "sum_as_zero", "thousands"]
