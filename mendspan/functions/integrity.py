"""Column functions on integrity: end marker and quality score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendspan.functions.names import suffix


def jpeg_end(path: Column, tail: Column) -> Column:
    """Null for other files than JPEGs; otherwise whether the last two bytes (``tail``: binary, at least those) are FF D9."""
    return F.when(suffix(path).isin("jpg", "jpeg"), F.coalesce(F.upper(F.hex(tail)).endswith("FFD9"), F.lit(False)))


def quality_score(decode_ok: Column, valid_rows: Column, height: Column, size: Column, full: Column, capture: Column, end_ok: Column) -> Column:
    """Rank of a version: decodable ones from 10000, by share of live rows, size, metadata and end marker."""
    bytes_ = F.coalesce(size, F.lit(0)).cast("double")
    share = F.when(valid_rows.isNull() | height.isNull() | (height == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(valid_rows.cast("double"), height.cast("double")))))
    score = F.lit(10000.0) + F.lit(5000.0) * share + F.least(bytes_ / 1024.0, F.lit(50000.0)) / 50.0
    score = score + F.when(full, 500.0).otherwise(0.0) + F.when(capture.isNotNull() & (capture != ""), 200.0).otherwise(0.0) - F.when(~end_ok, 1000.0).otherwise(0.0)
    return F.when(decode_ok, score).otherwise(bytes_ / 1e6)
