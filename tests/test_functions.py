"""Column functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagevault import functions as fn


@pytest.fixture
def one(spark):
    """Apply a column function to a list of values, keeping their order."""

    def get(f, values, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r["o"] for r in df.withColumn("o", f(F.col("v"))).orderBy("i").collect()]

    return get


def test_normalize_url(one):
    cases = {
        "https://www.Example.COM/Path/": "example.com/Path",
        "http://example.com": "example.com",
        "  https://example.com///  ": "example.com",
        "ftp://example.com": None,
        "example.com/A?b=C": "example.com/A?b=C",
        "file:///home/a/../b/./c": "file:///home/b/c",
        "file://localhost/etc//hosts": "file:///etc/hosts",
        "file://share/dir\\sub": "file:///share/dir/sub",
        "file://": "file:///",
        "https://example.com/é": "example.com/é",
    }
    assert one(fn.normalize_url, list(cases)) == list(cases.values())


def test_urls(one):
    assert one(fn.base_url, ["https://a.b/c?d", "ftp://a", None]) == ["https://a.b", None, None]
    base = F.lit("https://a.b")
    links = ["/x", "x/y", "../z", "./w", "#t", "mailto:a@b", "//cdn/x", "https://c.d/", "", "?q", None]
    assert one(lambda c: fn.absolute_url(c, base), links) == [
        "https://a.b/x", "https://a.b/x/y", "https://a.b/z", "https://a.b/w", "#t", "mailto:a@b", "//cdn/x",
        "https://c.d/", "https://a.b", "https://a.b?q", None,
    ]
    assert one(fn.is_url, ["http://a", "file:/x", "no", "http://"]) == [True, True, False, False]
    assert one(fn.strip_query, ["http://a/b?c=1?d", "x"]) == ["http://a/b", "x"]
    paths = ["/a/b.png", "./c.png", "http://h/d", "e"]
    assert one(lambda c: fn.resolve_image_path(c, F.lit("/base/")), paths) == ["/base/a/b.png", "/base/c.png", "http://h/d", "e"]


def test_text(one):
    assert one(fn.slugify, ["https://A.com/x_y?z=1", "", None, "!!!", "a" * 200]) == ["https-a-com-x-y-z-1", "unknown", "unknown", "unknown", "a" * 150]
    assert one(fn.strip, [" \t\na b\xa0  ", "", "  "]) == ["a b", "", ""]
    assert one(fn.clean_whitespace, [" a\t\tb\xa0c \n d ", None]) == ["a b c \n d", ""]
    assert one(fn.normalize_text, [" a\n\n b\tc "]) == ["a b c"]
    assert one(lambda c: fn.clip_text(c, 3), ["·abcd·", "ab", None]) == ["abc...", "ab", ""]
    assert one(fn.dedup_words, ["b a b c a"]) == ["b a c"]
    assert one(fn.trim_code_head, ["\n \nvar x;\nfoo\n# T\nbody", "\n\nText", "", "let y = 1"]) == ["# T\nbody", "Text", "", "let y = 1"]
    assert one(lambda c: fn.drop_banner(c, "(?i)<< reading.*?pages"), ["x << Reading 3 pages y"]) == ["x  y"]
    captions = ["ab", "No photo description available", "A fine long text Puede ser una imagen de x", "Photo by A B on May 4, 2024", "nice ·day·"]
    assert one(fn.caption_clean, captions) == [None, "Image", "A fine long text", "Image", "nice day"]


def test_numbers(one):
    values = ["123", "2.6K", "1.1M", " 1,234 ", "", "abc", "K", "1.5", "-3"]
    assert one(fn.parse_metric, values) == [123, 2600, 1100000, 1234, 0, 0, 0, 1, -3]
    text = "1,234 replies, 5 reposts, 1 like"
    assert one(lambda c: fn.counts_from_text(c, "repl(?:y|ies)"), [text, "none"]) == [1234, None]


def test_dates(one):
    got = one(lambda c: fn.parse_date(c, 2024), ["2023-01-15T10:30:00Z", "On January 15, 2023", "JAN 15", "Feb 30, 2023", "soon", "", "may 5"])
    assert got == [
        dt.datetime(2023, 1, 15, 10, 30), dt.datetime(2023, 1, 15), dt.datetime(2024, 1, 15), None, None, None, dt.datetime(2024, 5, 5),
    ]
    assert one(fn.date_candidates, ["on Mar 21, 2024", "at 10:45 PM", "3 days ago", "2024-01-02"]) == ["Mar 21, 2024", "10:45 PM", "3 days ago", "2024-01-02"]
    assert one(fn.is_relative_time, ["5m", "1 h", "now", "3 minutes ago", "5 miles"]) == [True, True, True, True, False]
    assert one(fn.month_day_clean, ["Apr 8 Apr 8", "Apr 8, 2024 x", "hello there"]) == ["Apr 8", "Apr 8,", "hello there"]
    assert one(fn.founded_year, ["Founded in 1999", "2005", "sold 1999"]) == ["1999", "2005", None]


def test_json_and_points(one):
    assert one(fn.split_keywords, ["a, ,b ,", ""]) == [["a", "b"], []]
    got = one(
        fn.jsonld_fields,
        ['{"author":{"name":" A "},"keywords":["x"," ","y"],"datePublished":"2024-01-02"}', '[{"q":1},{"author":"B","keywords":"m, n"}]', "{broken", "[]", "3"],
    )
    assert [(g["author"], g["keywords"]) for g in got] == [("A", ["x", "y"]), ("B", ["m", "n"]), (None, None), (None, None), (None, None)]
    assert got[0]["published_at"] == dt.datetime(2024, 1, 2)
    points = one(fn.from_wkt, ["POINT (1.5 -2)", "POINT (1)", "x", None])
    assert points[0] == (1.5, -2.0) and points[1:] == [None, None, None]


def test_social(one):
    assert one(fn.extract_urls, ["see https://a.b/c, and www.x y http"]) == [["https://a.b/c", "www.x"]]
    assert one(fn.linkify, ["go https://a.b/c. now", "[x](https://a.b)"]) == ["go [a.b](https://a.b/c). now", "[x](https://a.b)"]
    long_host = "h" * 40 + ".com"
    assert one(fn.linkify, [f"https://{long_host}/p"]) == [f"[{'h' * 27}...](https://{long_host}/p)"]
    assert one(fn.extract_hashtags, ["#a b#été_1 # x"]) == [["#a", "#été_1"]]
    got = one(fn.name_handle, ["Ann Lee@annFollow x", "@solo and Bob", "none"])
    assert got[0] == ("Ann Lee", "ann") and got[1]["handle"] == "solo"
    assert one(fn.bio_after_action, ["X@h Follow handle1 makes things", "nothing", "Follow 12"]) == ["makes things", "", ""]
    header = one(lambda c: fn.chunk_header(title=c, source=F.lit(None).cast("string"), keywords=F.array(F.lit("a"), F.lit("b"))), ["T", ""])
    assert header == ["Title: T\nSource: None\nKeywords: a, b", "Source: None\nKeywords: a, b"]


def test_classify(one):
    assert one(fn.classify_person, ["Ana Maria Lopez", "Ana", "ana lopez", "Jo Wu Manager", "Greater Paris"]) == [True, False, False, False, False]
    assert one(fn.classify_title, ["Engineer", "Dog at Sea", "blue"]) == [True, True, False]
    assert one(fn.classify_connection, ["2nd", "12 followers", "followers", "blue"]) == [True, True, False, False]
    noise = ["", " Follow ", "...", "123", "1.25x, selected", "0:56", "23h", "Loaded: 3%", "real text"]
    assert one(fn.is_noise, noise) == [True] * 8 + [False]
