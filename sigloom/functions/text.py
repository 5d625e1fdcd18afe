"""Column expressions on names, labels and export metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic capitals that look like Latin ones, and their Latin twins.
CYRILLIC = "АВЕКМНОРСТХ"
LATIN = "ABEKMHOPCTX"


def normalize_stem(c: Column) -> Column:
    """Canonical file stem: trimmed, upper case, look-alike letters unified."""
    return F.translate(F.upper(F.trim(c)), CYRILLIC, LATIN)


def age_from_name(name: Column, is_control: Column | None = None) -> Column:
    """Two-digit age at the end of a control folder name (``<code>_<age>``), NULL where absent."""
    digits = F.regexp_extract(name, r"_(\d{2})[^\d_]*$", 1)
    age = F.when(digits != "", digits.cast("double"))
    return age if is_control is None else F.when(is_control, age)


def export_family(step_uv: Column, physical_max: Column) -> Column:
    """Export format of a file from its quantisation step and physical range, '' where unknown."""
    return (
        F.when(step_uv.isNull() | F.isnan(step_uv), "").when(step_uv == 1.0, "A").when(physical_max == 2000.0, "B").otherwise("C")
    )


def at_least(c: Column, bound: float) -> Column:
    """``c >= bound`` with NULL and NaN counting as no."""
    return F.coalesce(F.when(F.isnan(c), None).otherwise(c) >= bound, F.lit(False))
