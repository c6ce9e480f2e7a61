"""The item table and its vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: The sources that items come from.
SOURCE_TYPES = ("github", "hackernews", "rss", "reddit", "telegram", "twitter", "openbb", "ossinsight", "gdelt", "google_news", "video", "fourpda")

#: One row an item. ``ord`` is its place in the input, which "first wins" rules and ties go by.
#: ``metadata`` holds JSON-encoded values by key; ``profile`` is the requested route, null for automatic.
ITEM = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("profile", T.ArrayType(T.StringType())),
        T.StructField("ord", T.LongType(), False),
    ]
)

#: What scoring adds.
ANALYSIS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])

BLOCK = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("source_refs", T.ArrayType(T.StringType())), T.StructField("primary", T.BooleanType())])
REFERENCE = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType())])
ARTIFACT = T.StructType([T.StructField("language", T.StringType()), T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("sources", T.ArrayType(REFERENCE))])
