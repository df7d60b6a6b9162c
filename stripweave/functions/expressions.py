"""Column expressions for geometry, names and text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and ordinals of the enumerations, as signatures spell them.
EXTENSIONS = {"PNG": ".png", "JPEG": ".jpg", "WebP": ".webp"}
FORMAT_ORDINALS = {"PNG": 0, "JPEG": 1, "WebP": 2}
POLICY_ORDINALS = {"PadWhite": 0, "Crop": 1, "KeepAsIs": 2}


def lookup(value: Column, table: dict, default=None) -> Column:
    """The entry of a small constant table."""
    out = F.lit(default)
    for key, entry in table.items():
        out = F.when(value == key, F.lit(entry)).otherwise(out)
    return out


def half_up(value: Column) -> Column:
    """Nearest whole number as long, halves upwards."""
    return F.floor(value + 0.5).cast("long")


def scaled_height(height: Column, width: Column, target: Column) -> Column:
    """Height of a page scaled to the target width, at least 1."""
    return F.greatest(F.lit(1).cast("long"), half_up(height * target.cast("double") / width))


def slice_name(number: Column, extension: Column) -> Column:
    """``output_001.png``: at least three digits, larger numbers keep all of theirs."""
    digits = number.cast("string")
    # formatting a row is slow, so it is left to what is not a plain number with an extension
    plain = F.concat(F.lit("output_"), F.when(number < 1000, F.lpad(digits, 3, "0")).otherwise(digits), extension)
    return F.when((number >= 0) & extension.isNotNull(), plain).otherwise(F.format_string("output_%03d%s", number, extension))


def shortest_decimal(value: Column) -> Column:
    """A double without a trailing ``.0``."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def joined(*parts) -> Column:
    """Concatenation of columns and literal strings."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def extension_of(path: Column) -> Column:
    """Lower-case extension with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def minted_id(prefix: str, *key: Column) -> Column:
    """Deterministic id: the prefix and 32 hex digits of a hash of the key."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256), F.lit(32)))
