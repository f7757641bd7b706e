"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from pagevault.functions.jsoncols import ITEMS_TYPE

BASE_FIELDS = [
    "url", "title", "description", "contact_name", "contact_identifier", "source",
    "source_location_identifier", "source_location_name", "created_at", "ingested_at",
]
ARRAY_FIELDS = ["participant_names", "participant_identifiers", "keywords"]
JSON_FIELDS = {"metadata": "{}", "contact_metadata": "{}", "participant_metadatas": "[]"}
JSON_TYPES = {
    "metadata": "map<string,string>",
    "contact_metadata": "map<string,string>",
    "participant_metadatas": "array<map<string,string>>",
}
DOC_FIELDS = [
    "id", *BASE_FIELDS, "participant_names", "participant_identifiers", "participant_metadatas", "geolocation",
    "keywords", "contact_metadata", "metadata", "last_updated",
]

STORED_DOC = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [
        T.StructField(
            c,
            T.TimestampType()
            if c in ("created_at", "ingested_at", "last_updated")
            else T.ArrayType(T.StringType())
            if c in ARRAY_FIELDS
            else T.StringType(),
        )
        for c in DOC_FIELDS[1:]
    ]
)
STORED_CHUNK = "id string, doc_id string, chunk_index int, chunk_total int, content string"
PAGE = "page_id long, url string, html string"
PLAIN_DOC = "doc_id long, text string, lang string, source string, n_chars long"
CONTENT_ITEMS = ITEMS_TYPE
