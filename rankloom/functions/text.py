"""Title, genre, tag and payload expressions; all of them are columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_GENRES = "(no genres listed)"  # fixed value: the marker of missing genres
YEAR = r"^(.*?)\s*\((\d{4})\)\s*$"  # fixed value: a year at the end of a title
ALSO_KNOWN = r"(?i)\s*\(a\.k\.a\.[^)]+\)"  # fixed value: how other names are marked
# fixed values: articles that a catalogue moves behind the title
ARTICLES = ["The", "A", "An", "Les", "Le", "La", "Los", "Las", "Der", "Die", "Das", "De", "El", "Il", "L'"]
IMAGE_BASE = "https://image.tmdb.org/t/p/"  # fixed value: the default base of poster paths


def title_year(raw: Column) -> Column:
    """The year in brackets at the end of a title, or null."""
    return F.when(raw.rlike(YEAR), F.regexp_extract(raw, YEAR, 2).cast("int"))


def clean_title(raw: Column) -> Column:
    """The title without its year, trimmed."""
    return F.when(raw.rlike(YEAR), F.trim(F.regexp_extract(raw, YEAR, 1))).otherwise(F.trim(raw))


def genre_list(genres: Column) -> Column:
    """The parts between bars, trimmed; none for the marker of missing genres."""
    parts = F.filter(F.transform(F.split(F.coalesce(genres, F.lit("")), r"\|"), lambda g: F.trim(g)), lambda g: g != "")
    return F.when(F.trim(genres) == NO_GENRES, F.array().cast("array<string>")).otherwise(parts)


def display_title(raw: Column) -> Column:
    """A title as it is shown: without its year and also-known-as parts, an article that
    stands behind the last comma back in front."""
    shown = clean_title(F.regexp_replace(raw, ALSO_KNOWN, ""))
    comma = F.length(shown) - F.locate(",", F.reverse(shown)) + 1
    tail = F.trim(F.substring(shown, comma + 1, F.length(shown)))
    moved = F.contains(shown, F.lit(",")) & F.lower(tail).isin([a.lower() for a in ARTICLES])
    return F.when(moved, F.concat(tail, F.lit(" "), F.trim(F.substring(shown, F.lit(1), comma - 1)))).otherwise(shown)


def fold(text: Column) -> Column:
    """Lower case, compared without regard to accents: for predicates, not for output."""
    return F.collate(F.lower(text), "UNICODE_CI_AI")


def folded(text: Column) -> Column:
    """Lower case, compatibility forms taken apart, accents dropped: the stored text that searches
    look into. Spark has no such function, so an Arrow-batched one calls Python's."""
    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        apart = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
        return texts.map(lambda x: x if x is None else x.lower() if x.isascii() else apart(x))

    return plain(text)


def clean_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(tag, F.lit(""))), r"(?U)[^\w\s-]", ""))


def tokens(text: Column) -> Column:
    """Word tokens of at least two characters; hyphens may stand inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\b\w[\w-]+\b)"), 1)


def image_url(path: Column, size: Column, base: str = IMAGE_BASE) -> Column:
    """base/size/path with single slashes; null where there is no path."""
    plain = F.regexp_replace(F.trim(path), "^/+", "")
    return F.when(F.coalesce(plain, F.lit("")) != "", F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.trim(size), "^/+|/+$", ""), F.lit("/"), plain))


def top_cast(cast: Column, n: int = 8) -> Column:
    """The first n of the cast by billing order; those without an order come last."""
    numbered = F.transform(cast, lambda c, i: F.struct(F.coalesce(c["order"], F.lit(999)).alias("o"), i.alias("i"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(numbered), 1, n), lambda x: x["c"])


def directors(crew: Column) -> Column:
    return F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"])


def feature_type(raw: Column) -> Column:
    return F.when(raw.startswith("genre:"), "genre").when(raw.startswith("year"), "release_era").when(raw.startswith("genome:"), "genome_tag").otherwise("tag")


def feature_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "^(genre:|genome:|tag:)", "")


def iso_seconds(epoch: Column) -> Column:
    """An epoch second as UTC text, whatever the session's time zone is."""
    moment = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
