"""Text and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slugify(text: Column, maxlen: int = 40) -> Column:
    """Runs of anything but letters and digits become one hyphen, none at the ends; `text` where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(slug == "", "text").otherwise(F.substring(slug, 1, maxlen))


def short_name(path: Column, prompt: Column, index: Column, ext: str = ".jpg") -> Column:
    return F.concat(F.format_string("%02d_", index.cast("int")), F.substring(F.md5(path), 1, 8), F.lit("_"), slugify(prompt, 36), F.lit("_poetry" + ext))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def resolve(path: Column, root: str) -> Column:
    return F.when(is_absolute(path), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def quote(path: Column) -> Column:
    """URL quoting of a path; slashes stay."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def scenes(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """Lines of a text, trimmed, blank ones left out, numbered from 0 in order."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(*keep, F.posexplode(lines).alias("scene", "line"))


def cache_key(version: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(version), *[p.cast("string") for p in parts]))
