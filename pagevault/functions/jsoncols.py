"""Array, JSON and point columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions import fixed
from pagevault.functions.text import strip

ITEM_TYPE = "struct<type:string,text:string,image_url:string>"
ITEMS_TYPE = f"array<{ITEM_TYPE}>"


def item(kind: str, value: Column) -> Column:
    """One content item; the field that does not apply is NULL (and so left out of JSON)."""
    return F.struct(
        F.lit(kind).alias("type"),
        (value if kind == "text" else F.lit(None).cast("string")).alias("text"),
        (value if kind == "image_url" else F.lit(None).cast("string")).alias("image_url"),
    ).cast(ITEM_TYPE)


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def json_or_default(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, the default when the text is NULL, empty, broken or of another shape."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), schema), default)


def array_or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def text_items(items: Column) -> Column:
    return F.filter(items, lambda x: x["type"] == "text")


def image_items(items: Column) -> Column:
    return F.filter(items, lambda x: x["type"] == "image_url")


def items_concat(header: Column, items: Column) -> Column:
    """Header as first text item, then the well-formed items in order."""
    good = F.filter(
        items,
        lambda x: ((x["type"] == "text") & x["text"].isNotNull())
        | ((x["type"] == "image_url") & x["image_url"].isNotNull()),
    )
    return F.concat(F.array(item("text", header)), F.coalesce(good, F.array().cast(ITEMS_TYPE)))


def _ld_items(text: Column) -> Column:
    """Every object of a JSON-LD text as VARIANT, whether it is one object or a list of them."""
    parsed = F.try_parse_json(text)
    listed = F.try_variant_get(parsed, "$", "array<variant>")
    return F.when(F.schema_of_variant(parsed).startswith("ARRAY"), listed).when(parsed.isNotNull(), F.array(parsed))


def jsonld_fields(text: Column) -> Column:
    """STRUCT(author, keywords, published_at) of a JSON-LD text; broken JSON gives NULL fields."""
    items = _ld_items(text)

    def first_of(values: Column) -> Column:
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))

    author = first_of(
        F.transform(
            items,
            lambda v: F.coalesce(
                F.when(
                    F.schema_of_variant(F.try_variant_get(v, "$.author", "variant")) == "STRING",
                    strip(F.try_variant_get(v, "$.author", "string")),
                ),
                strip(F.try_variant_get(v, "$.author.name", "string")),
            ),
        )
    )
    # a list wins over its own text form, so look at it first
    keywords = first_of(
        F.transform(
            items,
            lambda v: F.coalesce(
                F.filter(
                    F.transform(F.try_variant_get(v, "$.keywords", "array<string>"), strip), lambda k: k != ""
                ),
                split_keywords(F.try_variant_get(v, "$.keywords", "string")),
            ),
        )
    )
    dated = first_of(
        F.transform(
            items,
            lambda v: F.coalesce(
                *[F.try_variant_get(v, f"$.{d}", "string").try_cast("timestamp") for d in fixed.JSONLD_DATES]
            ),
        )
    )
    return F.struct(author.alias("author"), keywords.alias("keywords"), dated.alias("published_at"))


def to_wkt(lon: Column, lat: Column) -> Column:
    """`POINT (lon lat)`, NULL when a coordinate is missing."""
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def from_wkt(wkt: Column) -> Column:
    """STRUCT(lon, lat) of a point text, NULL when it is not one."""
    number = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return F.when(
        wkt.rlike(pattern),
        F.struct(
            F.regexp_extract(wkt, pattern, 1).try_cast("double").alias("lon"),
            F.regexp_extract(wkt, pattern, 2).try_cast("double").alias("lat"),
        ),
    )
