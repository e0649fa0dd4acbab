"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_RANGES = {
    "uint8": (0, 255, "int"), "int8": (-128, 127, "int"), "uint16": (0, 65535, "int"), "int16": (-32768, 32767, "int"),
    "uint32": (0, 4294967295, "bigint"), "int32": (-2147483648, 2147483647, "int"), "int64": (-(2**63), 2**63 - 1, "bigint"), "uint64": (0, 2**64 - 1, "decimal(20,0)"),
}


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def scale_of(low: Column, high: Column, eps: float) -> Column:
    return F.greatest(high - low, F.lit(eps))


def normalize(value: Column, low: Column, high: Column, eps: float) -> Column:
    return (value - low) / scale_of(low, high, eps)


def denormalize(value: Column, low: Column, high: Column, eps: float) -> Column:
    return value * scale_of(low, high, eps) + low


def saturate(value: Column, dtype: str) -> Column:
    """Cast to an output type.  Integers are clipped in double and cut toward zero; NaN becomes 0."""
    if dtype in ("float32", "float64"):
        return value.cast("float" if dtype == "float32" else "double")
    low, high, kind = INTEGER_RANGES[dtype]
    number = F.when(F.isnan(value), F.lit(0.0)).otherwise(value)
    if kind == "decimal(20,0)":
        # the bounds of 64 bits are no doubles: cut first, then clip exactly
        whole = F.when(number >= 2.0**64, F.lit(str(high)).cast(kind)).when(number <= 0, F.lit(0).cast(kind))
        # doubles from 2^53 on are whole, and may be beyond what floor can give
        return whole.when(number >= 2.0**53, number.cast(kind)).otherwise(F.floor(number).cast(kind))
    if dtype == "int64":
        return F.when(number >= 2.0**63, F.lit(high)).when(number <= -(2.0**63), F.lit(low)).otherwise(number.cast("bigint"))
    return clip(number, float(low), float(high)).cast(kind)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def probability(value: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return clip(sigmoid(value), low, high)


def sample_id(uri: Column) -> Column:
    """The first path component after the bucket."""
    return F.element_at(F.split(F.ltrim(F.parse_url(uri, F.lit("PATH")), F.lit("/")), "/"), 1)


def base_sample(sample: Column) -> Column:
    """Without the mark of a processing run."""
    return F.regexp_replace(sample, r"_processed_\d{4}-\d{2}-\d{2}.*$", "")


def downscale_factor(ratio: Column) -> Column:
    """Ratios round half to even, and are 1 at least."""
    return F.greatest(F.lit(1.0), F.bround(ratio)).cast("int")


def hex_color(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 6, "0")


def wall_clock(text: Column) -> Column:
    """Sampler timestamps, with or without a fraction."""
    bare = F.trim(text)
    known = bare.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    return F.when(known, F.try_to_timestamp(F.replace(bare, F.lit("/"), F.lit("-"))))


def unitless(text: Column, unit: str) -> Column:
    return F.trim(F.replace(text, F.lit(unit), F.lit(""))).cast("double")


def is_cuda(device: Column) -> Column:
    return F.startswith(F.lower(device), F.lit("cuda"))


def decoder_weights(state: Column) -> Column:
    """Entries of a state map under ``model.decoder.`` or else ``decoder.``, with the prefix removed."""
    long, short = "model.decoder.", "decoder."

    def under(prefix: str) -> Column:
        mine = F.map_filter(state, lambda k, v: F.startswith(k, F.lit(prefix)))
        return F.transform_keys(mine, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))

    return F.when(F.size(F.map_keys(under(long))) > 0, under(long)).otherwise(under(short))
