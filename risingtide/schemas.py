"""Explicit schemas of the inputs and outputs. Nothing is inferred."""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """Flat ``name type, ...`` text to a schema; needs no running session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


# One row per (video, country, trending day).
VIDEOS = _struct(
    "video_id string, title string, publishedAt timestamp, channelId string, "
    "channelTitle string, categoryId int, trending_date timestamp, tags string, "
    "view_count bigint, likes bigint, dislikes bigint, comment_count bigint, "
    "thumbnail_link string, comments_disabled boolean, ratings_disabled boolean, "
    "description string"
)

CATEGORY = _struct("id int, title string")

_SNIPPET = T.StructType([T.StructField("title", T.StringType(), True)])
_ITEM = T.StructType(
    [T.StructField("id", T.StringType(), True), T.StructField("snippet", _SNIPPET, True)]
)
CATEGORY_JSON = T.StructType([T.StructField("items", T.ArrayType(_ITEM), True)])

CHANNEL_STATS = _struct(
    "Username string, Suscribers double, Visits double, Likes double, Comments double"
)

TRANSLATIONS = _struct("country string, video_id string, field string, text string")

TOP_RANK = _struct("date string, type string, name string, rank_count bigint")

DURATION_FEATURES = _struct(
    "video_id string, title string, becomeTrendingDuration double, "
    "endTrendingDuration double, channelTitle string, channelSuscribers double, "
    "category string, region string, view_count bigint, likes bigint, "
    "dislikes bigint, comment_count bigint, channelAvgVisits double, "
    "channelAvgLikes double, channelAvgComments double"
)


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns, all read as text, for sources that are cast later."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
