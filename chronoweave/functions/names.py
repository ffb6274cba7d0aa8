"""Identifiers, slugs and asset references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slugs of so few characters are made from the part of a text that they show.
SHORT = 100


def slugify(value: Column, max_len: int = 80) -> Column:
    """Runs of characters other than letters, digits, `_.-` become `_`; trimmed and cut; never empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if max_len <= SHORT:
        # what trimming leaves out, as many characters or runs as the slug has, and whether more than trimming would leave out follows
        text = F.regexp_extract(text, f"^[^A-Za-z0-9.-]*(?:[A-Za-z0-9_.-]|[^A-Za-z0-9_.-]++){{0,{max_len}}}+[^A-Za-z0-9.-]*[A-Za-z0-9.-]?", 0)
    text = F.trim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    text = F.substring(text, 1, max_len)
    return F.when(text == "", "unknown").otherwise(text)


def asset_id(subject: Column, run: Column, device: Column, role: Column) -> Column:
    return F.concat_ws("_", F.lit("asset"), *(slugify(c) for c in (subject, run, device, role)))


def version_id(*parts: tuple[Column, int]) -> Column:
    """Slugs cut to their lengths, joined by two underscores; a hash tells cut ones apart."""
    cut = F.concat_ws("__", *(slugify(c, n) for c, n in parts))
    whole = F.concat_ws("__", *(slugify(c, 1000) for c, _ in parts))
    return F.when(cut == whole, cut).otherwise(F.concat(cut, F.lit("__"), F.substring(F.md5(whole.cast("binary")), 1, 8)))


def normalise_asset_ref(value: Column) -> Column:
    """Forward slashes, single, without `.` parts or one at the end; `.` and nothing become empty."""
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[\\/]+", "/")
    text = F.regexp_replace(F.regexp_replace(text, r"(^|(?<=/))\.(/|$)", ""), r"(?<=[^/])/+$", "")
    return F.when(text == ".", "").otherwise(text)


def is_absolute_path(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")).rlike(r"^([A-Za-z]:[\\/]|[\\/])")


def artifact_ref(subject: Column, device: Column, run: Column, file: Column) -> Column:
    return F.concat_ws("/", F.lit("subjects"), subject, device, run, file)


def path_for_ref(root: Column, ref: Column) -> Column:
    return F.when(is_absolute_path(ref), ref).otherwise(F.concat_ws("/", root, ref))
