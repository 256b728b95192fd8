"""Name and key expressions used by score and data-preparation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelith.operators.sampling import unit_hash


def setup_name(model_path: Column) -> Column:
    """``<first 20 characters of the directory>__<thousands>k``; null when the step does not parse.

    The step is the last ``_`` part of the file stem and must be a multiple of 1000.
    """
    directory = F.regexp_extract(model_path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(model_path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    step = F.element_at(F.split(stem, "_"), -1)
    name = F.concat(F.substring(directory, 1, 20), F.lit("__"), F.regexp_replace(step, "000$", ""), F.lit("k"))
    return F.when(step.rlike("^[0-9]*000$"), name)


def full_setup_name(model_path: Column) -> Column:
    """Long form: whole directory and file name."""
    return F.concat(
        F.regexp_extract(model_path, r"([^/]+)/[^/]+$", 1), F.lit("__"), F.regexp_extract(model_path, r"([^/]+)$", 1)
    )


def run_name(path: Column) -> Column:
    """Parent directory of a checkpoint path."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def strip_chars(value: Column, chars: str) -> Column:
    """Strip any of ``chars`` from both ends, as a set of characters."""
    return F.btrim(value, F.lit(chars))


def strip_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 1 << 30)).otherwise(value)


def cube_id_from_stem(stem: Column) -> Column:
    """Last two characters as a number, null when they are not digits."""
    tail = F.right(stem, F.lit(2))
    return F.when(tail.rlike("^[0-9]{2}$"), tail.cast("int"))


def cube_id_from_name(name: Column) -> Column:
    """Characters 41..43 of the original file name, which must follow a zero."""
    digits = F.substring(name, 42, 2)
    return F.when(digits.rlike("^[0-9]{2}$") & (F.substring(name, 41, 1) == "0"), digits)


def model_part(setup: Column) -> Column:
    """All but the last ten characters."""
    return F.substring(setup, F.lit(1), F.greatest(F.length(setup) - 10, F.lit(0)))


def roi_part(setup: Column) -> Column:
    """The last nine characters."""
    return F.right(setup, F.lit(9))


def last_token(value: Column) -> Column:
    return F.element_at(F.split(value, "_"), -1)


def ends_with_any(value: Column, suffixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(value, s))


def run_time(seconds: Column) -> Column:
    """``h:mm:ss`` of whole seconds."""
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def threshold_key(threshold: Column) -> Column:
    """Hundredths by rounding; truncation would map 0.29 to 28."""
    return F.round(threshold * 100).cast("int")


def prefix_keys(mapping: Column, prefix: str) -> Column:
    return F.transform_keys(mapping, lambda k, v: F.concat(F.lit(prefix), k))


def non_zero_terms(mapping: Column) -> Column:
    """Loss terms that take part: weight present and not zero."""
    return F.map_filter(mapping, lambda k, v: v.isNotNull() & (v != 0))


def merge_sections(*sections: Column) -> Column:
    """Flatten config sections; keys of later sections win, whatever the session's map policy."""
    def override(earlier: Column, later: Column) -> Column:
        kept = F.map_filter(earlier, lambda k, v: ~F.map_contains_key(later, k))
        return F.map_concat(kept, later)

    return reduce(override, sections)


def config_hash(*values: Column) -> Column:
    return F.md5(F.concat_ws("", *values))


def label_color(label: Column) -> list[Column]:
    """Stable pseudo-random RGBA of a label; background is fully transparent."""
    channels = [
        F.when(label == 0, 0).otherwise(F.floor(unit_hash(label, seed) * 255)).cast("int").alias(name)
        for seed, name in enumerate(("r", "g", "b"))
    ]
    return [*channels, F.when(label == 0, 0).otherwise(255).cast("int").alias("a")]
