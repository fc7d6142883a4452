"""Search payloads and pages into one row shape: url, title, source, width, height, thumbnail, license, author, page_url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import strip_html

_DDG = "results ARRAY<STRUCT<image: STRING, title: STRING, thumbnail: STRING, url: STRING, width: INT, height: INT>>, next STRING"
_WIKI = (
    "query STRUCT<pages: MAP<STRING, STRUCT<title: STRING, imageinfo: ARRAY<STRUCT<url: STRING, thumburl: STRING, width: INT, height: INT, mime: STRING, "
    "descriptionurl: STRING, extmetadata: MAP<STRING, STRUCT<value: STRING>>>>>>>"
)
_OPENVERSE = "results ARRAY<STRUCT<url: STRING, title: STRING, width: INT, height: INT, thumbnail: STRING, license: STRING, creator: STRING, foreign_landing_url: STRING>>"
_PEXELS = "photos ARRAY<STRUCT<src: STRUCT<original: STRING, medium: STRING>, alt: STRING, width: INT, height: INT, photographer: STRING, url: STRING>>"
_PIXABAY = "hits ARRAY<STRUCT<largeImageURL: STRING, tags: STRING, imageWidth: INT, imageHeight: INT, previewURL: STRING, user: STRING, pageURL: STRING>>"
_UNSPLASH = "results ARRAY<STRUCT<urls: STRUCT<full: STRING, thumb: STRING>, description: STRING, width: INT, height: INT, user: STRUCT<name: STRING>, links: STRUCT<html: STRING>>>"

COLUMNS = ("url", "title", "source", "width", "height", "thumbnail", "license", "author", "page_url")


def _row(source: str, url: Column, title: Column, width: Column, height: Column, thumbnail: Column, license_: Column, author: Column, page: Column) -> list[Column]:
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return [
        url.alias("url"),
        text(title).alias("title"),
        F.lit(source).alias("source"),
        F.coalesce(width, F.lit(0)).alias("width"),
        F.coalesce(height, F.lit(0)).alias("height"),
        text(thumbnail).alias("thumbnail"),
        text(license_).alias("license"),
        text(author).alias("author"),
        text(page).alias("page_url"),
    ]


def _parsed(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Payloads that are no JSON of the expected shape give no rows."""
    return df.select(F.from_json(F.col(payload), schema).alias("j"))


def duckduckgo(df: DataFrame, payload: str) -> DataFrame:
    x = _parsed(df, payload, _DDG).select(F.explode("j.results").alias("r"))
    return x.select(*_row("duckduckgo", F.col("r.image"), F.col("r.title"), F.col("r.width"), F.col("r.height"), F.col("r.thumbnail"), F.lit(""), F.lit(""), F.col("r.url")))


def wikimedia(df: DataFrame, payload: str) -> DataFrame:
    """Pages of images only; the ``File:`` prefix goes, author and licence lose their markup."""
    x = _parsed(df, payload, _WIKI).select(F.explode(F.map_values("j.query.pages")).alias("p")).select("p.title", F.col("p.imageinfo")[0].alias("i"))
    x = x.filter(F.col("i.mime").startswith("image/"))
    meta = lambda key: strip_html(F.col("i.extmetadata")[key]["value"])
    return x.select(*_row("wikimedia", F.col("i.url"), F.regexp_replace("title", "^File:", ""), F.col("i.width"), F.col("i.height"), F.col("i.thumburl"), meta("LicenseShortName"), meta("Artist"), F.col("i.descriptionurl")))


def openverse(df: DataFrame, payload: str) -> DataFrame:
    x = _parsed(df, payload, _OPENVERSE).select(F.explode("j.results").alias("r"))
    return x.select(*_row("openverse", F.col("r.url"), F.col("r.title"), F.col("r.width"), F.col("r.height"), F.col("r.thumbnail"), F.col("r.license"), F.col("r.creator"), F.col("r.foreign_landing_url")))


def pexels(df: DataFrame, payload: str) -> DataFrame:
    x = _parsed(df, payload, _PEXELS).select(F.explode("j.photos").alias("r"))
    return x.select(*_row("pexels", F.col("r.src.original"), F.col("r.alt"), F.col("r.width"), F.col("r.height"), F.col("r.src.medium"), F.lit(""), F.col("r.photographer"), F.col("r.url")))


def pixabay(df: DataFrame, payload: str) -> DataFrame:
    x = _parsed(df, payload, _PIXABAY).select(F.explode("j.hits").alias("r"))
    return x.select(*_row("pixabay", F.col("r.largeImageURL"), F.col("r.tags"), F.col("r.imageWidth"), F.col("r.imageHeight"), F.col("r.previewURL"), F.lit(""), F.col("r.user"), F.col("r.pageURL")))


def unsplash(df: DataFrame, payload: str) -> DataFrame:
    x = _parsed(df, payload, _UNSPLASH).select(F.explode("j.results").alias("r"))
    return x.select(*_row("unsplash", F.col("r.urls.full"), F.col("r.description"), F.col("r.width"), F.col("r.height"), F.col("r.urls.thumb"), F.lit(""), F.col("r.user.name"), F.col("r.links.html")))


#: Source, parser and most rows of one answer.
SOURCES = {
    "duckduckgo": (duckduckgo, 100),
    "wikimedia": (wikimedia, 50),
    "openverse": (openverse, 20),
    "pexels": (pexels, 80),
    "pixabay": (pixabay, 200),
    "unsplash": (unsplash, 30),
}


def search_rows(df: DataFrame, payload: str, source: str) -> DataFrame:
    """Rows of a source's payloads; an unknown source is read as duckduckgo."""
    return SOURCES.get(source, SOURCES["duckduckgo"])[0](df, payload)


def primary_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows of ``primary``, or those of ``fallback`` if it has none."""
    n = primary.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return primary.unionByName(fallback.filter(n.scalar() == 0))


def page_images(df: DataFrame, key: str, html: str) -> DataFrame:
    """Images of a page: key, place, url, width, height; small and non-http ones go, the first of a url stays."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))
    x = df.select(key, F.posexplode(tags).alias("place", "tag"))
    number = lambda a: F.coalesce(F.regexp_extract("tag", rf'(?i)\b{a}\s*=\s*["\']?(\d+)', 1).try_cast("int"), F.lit(0))
    x = x.select(key, "place", F.regexp_extract("tag", r'(?i)\bsrc\s*=\s*["\']([^"\']+)', 1).alias("url"), number("width").alias("width"), number("height").alias("height"))
    fine = F.col("url").rlike("(?i)^https?://") & ~F.col("width").between(1, 49) & ~F.col("height").between(1, 49)
    best = x.filter(fine).groupBy(key, "url").agg(F.min("place").alias("place"), F.min_by(F.struct("width", "height"), "place").alias("s"))
    return best.select(key, "place", "url", "s.width", "s.height")


def page_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """Addresses of the links of a page, in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\b[^>]*\bhref\s*=\s*["\']([^"\']*)'), F.lit(1))).alias("place", "url"))
