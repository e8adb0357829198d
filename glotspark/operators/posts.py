"""Localised posts: front matter between ``---`` lines, a body, and fields that only the base post has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_MATTER = r"\A---\n((?s:.*?))\n---\n?((?s:.*))\z"


def front_matter(raw: Column) -> Column:
    """A map of the ``key: value`` lines of the first block; a later line of a key wins. Empty without a block; null for null."""
    block = F.regexp_extract(raw, _MATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.locate(":", x) > 0)
    keys = F.transform(lines, lambda x: X.strip(F.substring_index(x, ":", 1)))
    parted = F.transform(lines, lambda x: F.struct(X.strip(F.substring_index(x, ":", 1)).alias("key"), X.strip(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")))
    last = F.filter(parted, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["key"]) == 0)
    return F.when(raw.isNotNull(), F.map_from_entries(last))


def body(raw: Column) -> Column:
    """What follows the front matter; the whole text without one."""
    return F.when(raw.rlike(_MATTER), F.regexp_extract(raw, _MATTER, 2)).otherwise(raw)


def without_blanks(data: Column) -> Column:
    """The entries whose value is not blank."""
    return F.map_filter(data, lambda _, v: X.filled(v))


def first_image(content: Column) -> Column:
    """The address of the first Markdown image, or null."""
    return F.nullif(F.regexp_extract(content, r"!\[[^\]]*\]\(([^)]+)\)", 1), F.lit(""))


def parsed(files: DataFrame) -> DataFrame:
    """(slug, data, content, thumbnail) of base posts (name, raw); the slug is the name without ``.mdx``."""
    content = body(F.col("raw"))
    return files.select(F.regexp_replace("name", r"\.mdx$", "").alias("slug"), front_matter(F.col("raw")).alias("data"), content.alias("content"), first_image(content).alias("thumbnail"))


def localised(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Parsed posts with the entries and body of the variant (slug, raw) of the same slug on top.

    A variant's blank entries give way to the base; its body replaces the base's whole, blank or not; the thumbnail is
    always the base's. ``variants`` has one row for each slug at most; one without raw text is none.
    """
    v = variants.select("slug", without_blanks(front_matter(F.col("raw"))).alias("own"), body(F.col("raw")).alias("text"))
    both = base.join(v, "slug", "left")
    kept = F.map_filter("data", lambda k, _: ~F.coalesce(F.map_contains_key("own", k), F.lit(False)))
    data = F.when(F.col("own").isNull(), F.col("data")).otherwise(F.map_concat(kept, "own"))
    return both.select("slug", data.alias("data"), F.coalesce("text", "content").alias("content"), "thumbnail")


def listing(files: DataFrame, locales: tuple[str, ...] = ("en", "ja", "zh")) -> DataFrame:
    """Parsed posts of (name, raw), base files only: names in ``.mdx`` that don't end in a locale."""
    return parsed(files.where(F.endswith("name", F.lit(".mdx")) & ~F.col("name").rlike(rf"\.({'|'.join(locales)})\.mdx$")))
