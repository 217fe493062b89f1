"""Resampling, audits and ordered operators on streams, with watermarks."""

from .ordered import ordered_stream, with_open_rows
from .resample import hourly_stream, resample_stream, with_open_tail

__all__ = ["hourly_stream", "ordered_stream", "resample_stream", "with_open_rows", "with_open_tail"]
