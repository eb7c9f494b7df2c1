"""Page discovery: the links of index pages, each once, in the order the source calls for."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Discovery:
    """How the links of a family of index pages are told: a pattern whose first group is the link, and whose last is its slug."""

    pattern: str
    by_slug: bool = False


# The link shapes of three page families.
DISCOVERIES = {
    "quoted-path": Discovery(r"""(?i)<a\b[^>]*\bhref\s*=\s*"(/[^"#?]*?([^"#/?]+))(?:[#?][^"]*)?\""""),
    "upper-htm": Discovery(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?((__P[0-9A-Z]+)\.HTM)"""),
    "numbered-html": Discovery(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?([^"'\s>#]*?([a-z]+\d{4})\.html)""", by_slug=True),
    "any-path-sorted": Discovery(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?(/[^"'\s>#?]*?([^"'\s>#?/]+))["'#?\s>]""", by_slug=True),
    "any-path": Discovery(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?(/[^"'\s>#?]*?([^"'\s>#?/]+))["'#?\s>]"""),
}


def discovery(name: str) -> Discovery:
    if name not in DISCOVERIES:
        raise ValueError(f"unknown discovery {name}; there are {', '.join(sorted(DISCOVERIES))}")
    return DISCOVERIES[name]


@F.pandas_udf(StringType())
def _resolved(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(bases, links, strict=True)])


def page_links(pages: DataFrame, how: Discovery, key: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """(key, position, slug, link[, url]) of the distinct links of every index page; the first of a slug counts.

    Positions run from 1, in order of appearance or by slug. Fragments are dropped. Pages without links give no rows; a null page has none.
    """
    found = pages.select(
        key,
        *([base] if base else []),
        F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(how.pattern), F.lit(1)).alias("link"), F.regexp_extract_all(html, F.lit(how.pattern), F.lit(2)).alias("slug"))).alias("_pos", "_l"),
    )
    keys = [key, *([base] if base else [])]
    first = found.groupBy(*keys, F.col("_l.slug").alias("slug")).agg(F.min(F.struct("_pos", F.col("_l.link").alias("link"))).alias("_f"))
    order = Window.partitionBy(key).orderBy("slug" if how.by_slug else "_f._pos")
    out = first.withColumn("position", F.row_number().over(order))
    url = [_resolved(F.col(base), F.col("_f.link")).alias("url")] if base else []
    return out.select(key, "position", "slug", F.col("_f.link").alias("link"), *url)


def require_pages(links: DataFrame) -> DataFrame:
    """links, or an error if there are none: an empty discovery is never a success."""
    if links.isEmpty():
        raise ValueError("discovery found no pages")
    return links

