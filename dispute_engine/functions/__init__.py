"""Column-level helpers built from ``pyspark.sql.functions``."""

from .columns import (contains_any, lower_coalesce, nan_to_null, norm_channel, norm_code, norm_title,
                      owner_for, parse_date, run_ts, to_double, to_int)
from .joins import broadcast_if_small, estimated_size_bytes

__all__ = [
    "broadcast_if_small", "contains_any", "estimated_size_bytes", "lower_coalesce", "nan_to_null",
    "norm_channel", "norm_code", "norm_title", "owner_for", "parse_date", "run_ts", "to_double", "to_int",
]
