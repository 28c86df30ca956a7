"""Column-level functions: all return ``pyspark.sql.Column`` built from
built-in expressions, so they stay inside whole-stage codegen."""

from .parse import parse_currency, parse_unit, parse_percent, try_numeric, try_long, try_timestamp
from .columns import (
    binary_target,
    flag,
    structural_zero,
    composite_key,
    null_flag,
    safe_ratio,
    utilisation_ratio,
    sentinel_to_null,
    cyclical,
    decade,
    slug,
    sigmoid,
)
from .rng import hash_uniform, uniform

__all__ = [
    "parse_currency", "parse_unit", "parse_percent", "try_numeric", "try_long", "try_timestamp",
    "binary_target", "flag", "structural_zero", "composite_key", "null_flag", "safe_ratio",
    "utilisation_ratio", "sentinel_to_null", "cyclical", "decade", "slug", "sigmoid",
    "uniform", "hash_uniform",
]
