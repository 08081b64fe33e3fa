import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T

TITLES = [
    ("Harbour Lights (1983)", "Harbour Lights", 1983),
    ("Harbour Lights (1983)  ", "Harbour Lights", 1983),
    ("Colony (2140) (2011)", "Colony (2140)", 2011),
    ("  Untitled ", "Untitled", None),
    ("Lost Reel (Undated)", "Lost Reel (Undated)", None),
    ("1812: The Long March (1974)", "1812: The Long March", 1974),
    (None, None, None),
]


def test_titles_and_years(spark):
    df = spark.createDataFrame([(n, t[0]) for n, t in enumerate(TITLES)], "n int, raw string")
    rows = df.select("n", T.clean_title(F.col("raw")), T.title_year(F.col("raw"))).orderBy("n").collect()
    assert [(r[1], r[2]) for r in rows] == [t[1:] for t in TITLES]


@pytest.mark.parametrize(("raw", "shown"), [("Lantern, The (1991)", "The Lantern"), ("Salt Road (a.k.a. The White Path) (1968)", "Salt Road"), ("Étoiles, Les (2003)", "Les Étoiles"), ("Plain (2000)", "Plain"), ("Red, White and Blue (1999)", "Red, White and Blue"), ("One, Two, A", "A One, Two")])
def test_display_title(spark, raw, shown):
    assert spark.createDataFrame([(raw,)], "raw string").select(T.display_title(F.col("raw"))).first()[0] == shown


def test_genres(spark):
    df = spark.createDataFrame([("Drama| Sci-Fi ||",), ("(no genres listed)",), ("",), (None,)], "g string")
    assert [r[0] for r in df.select(T.genre_list(F.col("g"))).collect()] == [["Drama", "Sci-Fi"], [], [], []]


def test_tags_and_tokens_keep_accents(spark):
    row = spark.createDataFrame([(" Film-Noir: Amélie! ",)], "t string").select(T.clean_tag(F.col("t")), T.tokens(F.col("t"))).first()
    assert row[0] == "film-noir amélie"
    assert row[1] == ["film-noir", "amélie"]


def test_image_url(spark):
    df = spark.createDataFrame([("/a.jpg",), ("b.jpg",), ("  ",), ("/",), (None,)], "p string")
    assert [r[0] for r in df.select(T.image_url(F.col("p"), F.lit("/w500/"), "https://x/t/")).collect()] == ["https://x/t/w500/a.jpg", "https://x/t/w500/b.jpg", None, None, None]


def test_cast_order_defaults_last(spark):
    df = spark.createDataFrame([([("a", 2), ("b", None), ("c", 1)],)], "people array<struct<name: string, order: int>>")
    assert [c["name"] for c in df.select(T.top_cast(F.col("people"), 2)).first()[0]] == ["c", "a"]
