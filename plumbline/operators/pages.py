"""Extraction from web pages: meta tags, links, images, contrast, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tag(html: Column, rx: str) -> Column:
    return F.when(html.rlike(rx), F.regexp_extract(html, rx, 1))


def title(html: Column) -> Column:
    return _tag(html, r"(?is)<title[^>]*>(.*?)</title>")


def meta(html: Column, name: str) -> Column:
    return _tag(html, rf"(?is)<meta\s+(?:name|property)=[\"']{name}[\"']\s+content=[\"']([^\"']*)[\"']")


def canonical(html: Column) -> Column:
    return _tag(html, r"(?is)<link\s+rel=[\"']canonical[\"']\s+href=[\"']([^\"']*)[\"']")


def seo(df: DataFrame, id: str, html: str) -> DataFrame:
    """Title and description with validity, presence of canonical, robots, viewport, and a score."""
    h = F.col(html)
    p = df.select(id, title(h).alias("title"), meta(h, "description").alias("description"), canonical(h).alias("canonical"), F.coalesce(F.lower(meta(h, "robots")).contains("noindex"), F.lit(False)).alias("noindex"), meta(h, "viewport").isNotNull().alias("has_viewport"))
    between = lambda c, lo, hi: F.coalesce(F.length(c).between(lo, hi), F.lit(False))
    p = p.withColumn("title_ok", between("title", 30, 60)).withColumn("description_ok", between("description", 50, 160))
    penalty = F.when(F.col("title").isNull(), 25).when(~F.col("title_ok"), 15).otherwise(0) + F.when(F.col("description").isNull(), 25).when(~F.col("description_ok"), 15).otherwise(0) + F.when(F.col("canonical").isNull(), 10).otherwise(0)
    return p.withColumn("score", (100 - penalty).cast("double"))


def links(df: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """One row a link: id, place, href, link_type."""
    rx = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"
    l = df.filter(F.col(html).isNotNull()).select(id, F.col(url).alias("__u"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rx), F.lit(1))).alias("place", "href"))
    return l.select(id, "place", "href", link_type(F.col("__u"), F.col("href")).alias("link_type"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:https?)://([^/?#]+)", 1)


def link_type(base: Column, href: Column) -> Column:
    low = F.lower(href)
    absolute = low.rlike(r"^https?://")
    return F.when(href.startswith("#"), "anchor").when(low.startswith("mailto:"), "mailto").when(low.startswith("tel:"), "tel").when(low.startswith("javascript:"), "javascript").when(~absolute & ~low.rlike(r"^[a-z][a-z0-9+.-]*:"), "internal").when(absolute & (host(href) == host(base)), "internal").when(absolute, "external").otherwise("other")


def normalized_url(base: Column, href: Column) -> Column:
    """Absolute http(s) address without query, fragment and one trailing slash; else null."""
    root = F.regexp_extract(base, r"^((?i:https?)://[^/?#]+)", 1)
    whole = F.when(href.rlike(r"^(?i:https?)://"), href).when(href.startswith("/"), F.concat(root, href)).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(F.regexp_extract(base, r"^((?i:https?)://[^?#]*/)", 1), href))
    bare = F.regexp_replace(F.regexp_replace(whole, r"[?#].*$", ""), "/$", "")
    return F.when(bare.rlike(r"^(?i:https?)://"), bare)


def images(df: DataFrame, id: str, html: str) -> DataFrame:
    """One row an image: src, missing alt, missing size, lazy loading, legacy format."""
    i = df.filter(F.col(html).isNotNull()).select(id, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))).alias("place", "tag"))
    src = F.regexp_extract("tag", r"(?i)src=[\"']([^\"']*)", 1)
    has = lambda a: F.col("tag").rlike(rf"(?i)\s{a}=")
    return i.select(id, "place", src.alias("src"), (~has("alt")).alias("alt_missing"), (~(has("width") & has("height"))).alias("size_missing"), F.col("tag").rlike(r"(?i)loading=[\"']lazy").alias("lazy"), src.rlike(r"(?i)\.(?:jpe?g|png|gif|bmp)(?:\?|$)").alias("legacy_format"))


def robots(df: DataFrame, text: str) -> DataFrame:
    """Directives of robots.txt texts: place, field, value."""
    l = df.select(F.posexplode(F.split(F.col(text), r"\r?\n")).alias("place", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    return l.filter(F.col("line").contains(":")).select("place", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    f = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * f(r) + 0.7152 * f(g) + 0.0722 * f(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def budget(value: Column, soft: float, hard: float) -> Column:
    return F.when(value.isNull(), "skipped").when(value > hard, "fail").when(value > soft, "warn").otherwise("pass")


def headroom(value: Column, soft: float, hard: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (value - soft) / (hard - soft)))
