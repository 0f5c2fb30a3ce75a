"""Sources, sinks, joins, splits and snapshot operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from risingtide.catalogue.base import query, table
from risingtide.functions.keys import hash_threshold, in_sample
from risingtide.functions.times import calendar_days
from risingtide.operators.durations import duration_features
from risingtide.operators.enrich import drop_keys, keep_keys, untranslated, with_match
from risingtide.operators.ranking import max_per_key, top_overall
from risingtide.operators.snapshots import (
    before,
    first_per_key,
    first_values,
    latest_per_key,
    typed_snapshot,
    with_bounds,
)
from risingtide.operators.split import sample_rows, split_by_key
from risingtide.plans.durations import with_channel_stats
from risingtide.plans.preprocess import (
    all_countries,
    country_rows,
    preprocess,
    sample_and_translate,
    split_channels,
)
from risingtide.plans.top_rank import category_totals, monthly_totals, top_rank, top_rank_sql
from risingtide.schemas import CATEGORY_JSON
from risingtide.session import work_path
from risingtide.sinks.writers import write_csv, write_dictionary, write_parquet
from risingtide.sources.readers import categories_from, dictionary_from, read_csv
from risingtide.sources.records import read_records
from risingtide.streaming.ingest import ingest_new_files

# ---------------------------------------------------------------- top rank


def _ranked_facts(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    makers = table(spark, folder, "supplier")
    return items.join(makers, items["l_suppkey"] == makers["s_suppkey"]).select(
        "l_partkey", "l_shipdate", "s_nationkey", "l_extendedprice", "l_returnflag"
    )


_RANK_COLUMNS = dict(
    item="l_partkey", day="l_shipdate", category="s_nationkey", value="l_extendedprice",
    category_id="n_nationkey", category_name="n_name",
)


def _rank_ctes(n: int, flag: str = "") -> str:
    """SQL of the daily top ``n``, optionally split by return flag."""
    part = "l_returnflag, " if flag else ""
    return f"""
WITH best AS (
  SELECT {part}l_partkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS day,
         s_nationkey AS type, max(l_extendedprice) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {part}day ORDER BY value DESC, id, type) AS rk FROM best
), report AS (
  SELECT {part}substr(day, 1, 7) AS date, cast(type AS varchar) AS type, n_name AS name,
         count(*) AS rank_count
  FROM ranked JOIN nation ON type = n_nationkey WHERE rk <= {n} GROUP BY ALL
)"""


@query(_rank_ctes(10) + " SELECT date, type, name, rank_count FROM report")
def topn_monthly_category(spark, folder):
    return top_rank(_ranked_facts(spark, folder), table(spark, folder, "nation"), 10, **_RANK_COLUMNS)


@query(_rank_ctes(5) + " SELECT date, type, name, rank_count FROM report")
def topn_monthly_category_sql(spark, folder):
    return top_rank_sql(
        spark, _ranked_facts(spark, folder), table(spark, folder, "nation"), 5, **_RANK_COLUMNS
    )


@query(
    _rank_ctes(10, "l_returnflag")
    + """
SELECT name, sum(rank_count) FILTER (l_returnflag = 'A') AS flag_a,
       sum(rank_count) FILTER (l_returnflag = 'N') AS flag_n,
       sum(rank_count) FILTER (l_returnflag = 'R') AS flag_r
FROM report GROUP BY name"""
)
def category_totals_by_region(spark, folder):
    facts, names = _ranked_facts(spark, folder), table(spark, folder, "nation")
    flag = F.concat(F.lit("flag_"), F.lower("l_returnflag"))
    report = top_rank(facts.withColumn("flag", flag), names, 10, **_RANK_COLUMNS, by=["flag"])
    return category_totals(report, country="flag", countries=["flag_a", "flag_n", "flag_r"])


@query(
    _rank_ctes(10)
    + """
SELECT date, name, type, sum(rank_count) AS rank_count FROM report
WHERE type IN ('3', '7', '11', '15') GROUP BY ALL"""
)
def monthly_totals_selected(spark, folder):
    return monthly_totals(topn_monthly_category(spark, folder), ["3", "7", "11", "15"])


@query(
    "SELECT l_partkey, l_shipdate::date AS day, max(l_extendedprice) AS l_extendedprice "
    "FROM lineitem GROUP BY ALL"
)
def max_per_item_day(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return max_per_key(items, ["l_partkey", "day"], "l_extendedprice")


@query(
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"
)
def top_overall_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return top_overall(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


# ---------------------------------------------------------------- sources and sinks


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def csv_roundtrip(spark, folder):
    """Written once into four CSV folders and read back as a list of paths."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    root = work_path(spark, "csv")
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)).cast("int")
    write_csv(docs.withColumn("part", part), root, partition_by=["part"])
    parts = sorted(r["part"] for r in docs.select(part.alias("part")).distinct().collect())
    paths = [f"{root}/part={p}" for p in parts]
    back = read_csv(spark, paths, docs.schema, multi_line=True)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    f"""
SELECT doc_id, CASE WHEN bad THEN 'bad' ELSE 'good' END AS status,
       CASE WHEN bad THEN NULL ELSE n_chars END AS n_chars,
       CASE WHEN bad THEN NULL ELSE md5(text) END AS text_md5
FROM (SELECT *, substr(md5('arity' || doc_id), 1, 8) < '{hash_threshold(0.1)}' AS bad FROM documents)"""
)
def csv_multiline_bad_rows(spark, folder):
    """Multi-line records of which a tenth have one field too many."""
    docs = table(spark, folder, "documents")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(
        ",", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), quoted,
        F.when(in_sample("doc_id", 0.1, "arity"), F.lit("extra")),
    )
    path = work_path(spark, "records")
    docs.select(record.alias("value")).write.text(path)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
         T.StructField("text", T.StringType())]
    )
    good, bad = read_records(spark, path, schema, header=False)
    return good.select(
        "doc_id", F.lit("good").alias("status"), "n_chars", F.md5("text").alias("text_md5")
    ).unionByName(
        bad.select(
            F.substring_index("text", ",", 1).try_cast("bigint").alias("doc_id"),
            F.lit("bad").alias("status"),
            F.lit(None).cast("bigint").alias("n_chars"),
            F.lit(None).cast("string").alias("text_md5"),
        )
    )


@query(
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS price, "
    "o_orderstatus AS status FROM orders"
)
def parquet_roundtrip(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    ).withColumnsRenamed(
        {"o_orderkey": "order_id", "o_custkey": "customer_id",
         "o_totalprice": "price", "o_orderstatus": "status"}
    )
    path = work_path(spark, "parquet")
    write_parquet(orders, path, partition_by=["status"])
    return spark.read.schema(orders.schema).parquet(path)


@query(
    """
SELECT 'category' AS kind, cast(p_partkey AS varchar) AS id, p_name AS value FROM part
UNION ALL SELECT 'category', 'b' || p_partkey, p_brand FROM part
UNION ALL SELECT 'dictionary', cast(event_id AS varchar), json_extract_string(props, '$.k') FROM events
UNION ALL SELECT 'cache', cast(c_custkey AS varchar), c_name FROM customer"""
)
def nested_json_categories(spark, folder):
    """Nested items, JSON object dictionaries and a JSON-lines cache, all read back."""
    parts = table(spark, folder, "part")

    def item(key, title):
        return F.struct(key.alias("id"), F.struct(title.alias("title")).alias("snippet"))

    path = work_path(spark, "items")
    parts.select(
        F.array(
            item(F.col("p_partkey").cast("string"), F.col("p_name")),
            item(F.concat(F.lit("b"), F.col("p_partkey")), F.col("p_brand")),
        ).alias("items")
    ).write.json(path)
    nested = categories_from(spark.read.schema(CATEGORY_JSON).json(path))
    entries = dictionary_from(table(spark, folder, "events"), "props", "event_id")
    cache_path = work_path(spark, "cache")
    people = table(spark, folder, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    write_dictionary(people, cache_path, "id", "c_name")
    cache = spark.read.schema("id string, c_name string").json(cache_path)
    return (
        nested.select(F.lit("category").alias("kind"), "id", F.col("category").alias("value"))
        .unionByName(
            entries.select(
                F.lit("dictionary").alias("kind"), F.col("event_id").cast("string").alias("id"), "value"
            )
        )
        .unionByName(cache.select(F.lit("cache").alias("kind"), "id", F.col("c_name").alias("value")))
    )


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def incremental_ingest(spark, folder):
    """Two file drops, each taken in exactly once by its own run."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    root = work_path(spark, "ingest")
    first, second = split_by_key(events, "event_id", 0.5, "drop")
    for drop in (first, second):
        drop.write.mode("append").parquet(f"{root}/in")
        ingest_new_files(
            spark, f"{root}/in", f"{root}/out", f"{root}/progress", events.schema, fmt="parquet"
        )
    return spark.read.schema(events.schema).parquet(f"{root}/out")


# ---------------------------------------------------------------- joins and splits


@query(
    """
SELECT c_custkey, n_name AS category_name,
       coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, '') AS description
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey"""
)
def category_enrich_left(spark, folder):
    """Left lookup with misses, and missing text filled."""
    people = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("categoryId"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("description"),
    )
    names = table(spark, folder, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("category")
    )
    return preprocess(people, names).select("c_custkey", "category_name", "description")


@query(
    """
SELECT p_partkey, p_name, s.suscribers AS "channelSuscribers", s.visits AS "channelAvgVisits"
FROM part JOIN (
  SELECT lower(replace(p_name, ' ', '')) AS k, cast(count(*) AS double) AS suscribers,
         cast(max(p_size) AS double) AS visits FROM part WHERE p_size > 5 GROUP BY 1
) s ON lower(replace(p_name, ' ', '')) = s.k"""
)
def normalised_key_join(spark, folder):
    """Names joined to a differently typed copy of themselves."""
    parts = table(spark, folder, "part")
    stats = parts.where("p_size > 5").groupBy(
        F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("Username")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("Suscribers"),
        F.max("p_size").cast("double").alias("Visits"),
        F.lit(0.0).alias("Likes"),
        F.lit(0.0).alias("Comments"),
    )
    rows = parts.select("p_partkey", "p_name", F.col("p_name").alias("channelTitle"))
    return with_channel_stats(rows, stats).select(
        "p_partkey", "p_name", "channelSuscribers", "channelAvgVisits"
    )


_TRANSLATED = f"substr(md5('dict' || doc_id), 1, 8) < '{hash_threshold(0.4)}'"


@query(
    f"""
WITH picked AS (
  SELECT * FROM documents WHERE (lang, source) IN (
    SELECT (lang, source) FROM documents
    WHERE substr(md5(source), 1, 8) < '{hash_threshold(0.5)}' GROUP BY lang, source HAVING count(*) > 5)
)
SELECT doc_id, source AS title,
       CASE WHEN lang = 'en' THEN '[None]' WHEN {_TRANSLATED} THEN 'T&<' || source ELSE lang || '|' || source END AS tags,
       md5(CASE WHEN {_TRANSLATED} THEN 'T&"' || md5(text) ELSE text END) AS description_md5
FROM picked"""
)
def dictionary_translate(spark, folder):
    """Rows of sampled frequent sources, with dictionary texts where there are any."""
    docs = table(spark, folder, "documents").select(
        F.col("lang").alias("country"),
        "doc_id",
        "source",
        F.col("source").alias("title"),
        F.when(F.col("lang") == "en", "[None]").otherwise(F.concat_ws("|", "lang", "source")).alias("tags"),
        F.col("text").alias("description"),
    )
    known = docs.where(in_sample("doc_id", 0.4, "dict"))
    fields = F.map_from_arrays(
        F.array(F.lit("tags"), F.lit("description")),
        F.array(
            F.concat(F.lit("T&amp;&lt;"), F.col("source")),
            F.concat(F.lit("T&amp;&quot;"), F.md5("description")),
        ),
    )
    dictionary = known.select("country", "doc_id", F.explode(fields).alias("field", "text"))
    return sample_and_translate(
        docs, dictionary, fraction=0.5, keys=("country", "doc_id"), item="source"
    ).select("doc_id", "title", "tags", F.md5("description").alias("description_md5"))


@query(f"SELECT lang AS country, doc_id FROM documents WHERE NOT ({_TRANSLATED})")
def untranslated_keys(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("lang", "country")
    known = docs.where(in_sample("doc_id", 0.4, "dict"))
    return untranslated(docs, known, ("country", "doc_id"))


_HELD_OUT = f"substr(md5(source), 1, 8) < '{hash_threshold(0.3)}'"


@query(f"SELECT doc_id, source, CASE WHEN {_HELD_OUT} THEN 'test' ELSE 'train' END AS part FROM documents")
def group_split(spark, folder):
    """Whole sources held out, decided per row from the hash of the source."""
    train, test = split_channels(table(spark, folder, "documents"), 0.3, "source")
    return train.select("doc_id", "source", F.lit("train").alias("part")).unionByName(
        test.select("doc_id", "source", F.lit("test").alias("part"))
    )


@query(
    f"""SELECT doc_id, source, CASE WHEN {_HELD_OUT} THEN 'test' ELSE 'train' END AS part,
               CASE WHEN {_HELD_OUT} THEN 'both' ELSE 'left_only' END AS "_merge" FROM documents"""
)
def group_split_joins(spark, folder):
    """The same split by joins with a key list: flagged, semi and anti."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    keys = docs.select("source").distinct().where(in_sample("source", 0.3))
    flagged = with_match(docs, keys, ["source"])
    test = keep_keys(flagged, keys, ["source"]).withColumn("part", F.lit("test"))
    train = drop_keys(flagged, keys, ["source"]).withColumn("part", F.lit("train"))
    return test.unionByName(train)


@query(
    f"""SELECT event_id, CASE WHEN substr(md5('split' || event_id), 1, 8) < '{hash_threshold(0.2)}'
                              THEN 'test' ELSE 'train' END AS part
        FROM events WHERE substr(md5('pick' || event_id), 1, 8) < '{hash_threshold(0.5)}'"""
)
def row_split(spark, folder):
    """A repeatable half of the rows, split 80/20."""
    picked = sample_rows(table(spark, folder, "events"), "event_id", 0.5, "pick")
    train, test = split_by_key(picked, "event_id", 0.2, "split")
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part"))
    )


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def frequent_keys(spark, folder):
    return (
        table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")
    )


# ---------------------------------------------------------------- snapshots

_CUTOFF = "2024-01-20"


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return before(events, "day", _CUTOFF)


_DAYS = f"(SELECT *, ts::date AS day FROM events WHERE ts < timestamp '{_CUTOFF}')"


@query(
    f"""SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id) AS rk FROM {_DAYS}) WHERE rk = 1"""
)
def latest_one(spark, folder):
    rows = latest_per_key(_snapshots(spark, folder), ["user_id"], "day", "first", ["event_id"])
    return rows.select("user_id", "event_id", "value")


@query(
    f"""SELECT user_id, event_id, value FROM (
  SELECT *, max(day) OVER (PARTITION BY user_id) AS latest FROM {_DAYS}) WHERE day = latest"""
)
def latest_ties(spark, folder):
    rows = latest_per_key(_snapshots(spark, folder), ["user_id"], "day", "all")
    return rows.select("user_id", "event_id", "value")


@query(
    f"""SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS rk FROM {_DAYS}) WHERE rk = 1"""
)
def first_one(spark, folder):
    rows = first_per_key(_snapshots(spark, folder), ["user_id"], "day", ["event_id"])
    return rows.select("user_id", "event_id", "value")


@query(
    """
SELECT user_id, arg_min(event_type, event_id) AS event_type,
       arg_min(value, event_id) FILTER (value > 50) AS high_value
FROM events GROUP BY 1"""
)
def first_values_per_key(spark, folder):
    events = table(spark, folder, "events").withColumn("high_value", F.when(F.col("value") > 50, F.col("value")))
    return first_values(events, ["user_id"], ["event_type", "high_value"], ["event_id"])


@query(
    """
SELECT event_id, user_id, strftime(min(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS first_date,
       strftime(max(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS last_date
FROM events WINDOW w AS (PARTITION BY user_id)"""
)
def key_bounds(spark, folder):
    rows = with_bounds(table(spark, folder, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts")
    return rows.select(
        "event_id", "user_id",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_date", "last_date")],
    )


@query(
    f"""
WITH t AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT00:00:00Z') AS trending,
         ts, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN 'TRUE' ELSE 'FALSE' END AS flag,
         CASE WHEN event_type = 'click' THEN '' ELSE cast(user_id AS varchar) END AS cat, value
  FROM events
), l AS (SELECT *, max(trending) OVER (PARTITION BY user_id) AS latest FROM t WHERE trending < '{_CUTOFF}')
SELECT event_id, CASE flag WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END AS comments_disabled,
       try_cast(cat AS integer) AS "categoryId", try_cast(round(value * 100) AS bigint) AS view_count,
       date_diff('day', date '2024-01-01' + cast(user_id % 10 AS integer), ts::date) AS days_since_published
FROM l WHERE trending = latest"""
)
def typed_snapshot_text(spark, folder):
    """Snapshots given as text: cut off, latest kept with ties, cast without failing."""
    kind = F.col("event_type")
    published = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("user_id", F.lit(10)).cast("int"))
    raw = table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("video_id"),
        F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("trending_date"),
        F.concat(published.cast("string"), F.lit("T12:30:00Z")).alias("publishedAt"),
        F.when(kind == "error", "n/a").when(kind == "view", "TRUE").otherwise("FALSE").alias("comments_disabled"),
        F.when(kind == "click", "").otherwise(F.col("user_id").cast("string")).alias("categoryId"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("view_count"),
    )
    return typed_snapshot(raw, _CUTOFF).select(
        "event_id", "comments_disabled", "categoryId", "view_count",
        F.col("days_since_published").cast("bigint").alias("days_since_published"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       date_diff('day', o_orderdate::date, l_shipdate::date) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def calendar_day_difference(spark, folder):
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        calendar_days("o_orderdate", "l_shipdate").cast("bigint").alias("days"),
    )


_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"


@query(
    f"""
SELECT doc_id, lang AS region, CASE WHEN source <> 'src3' THEN upper(source) END AS category,
       CASE WHEN lang = 'en' THEN '' ELSE lang || ';' || source END AS tags,
       strftime(timestamp '2024-01-01' + to_days(cast(doc_id % 28 AS integer)), '%Y-%m-%d') AS day,
       md5(array_to_string({_WORDS}, ' ')) AS words_md5
FROM documents"""
)
def region_union_regularised(spark, folder):
    """Each language as a region: tokenised, dated, given its category, and stacked."""
    docs = table(spark, folder, "documents")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("doc_id", F.lit(28)).cast("int"))
    raw = docs.select(
        F.col("doc_id").alias("video_id"),
        F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("publishedAt"),
        F.col("source").alias("categoryId"),
        F.when(F.col("lang") == "en", "[None]").otherwise(F.concat_ws(" | ", "lang", "source")).alias("tags"),
        F.col("text").alias("description"),
        F.col("lang"),
    )
    names = (
        docs.where("source <> 'src3'").select(F.col("source").alias("id"), F.upper("source").alias("category")).distinct()
    )
    columns = ("video_id", "publishedAt", "categoryId", "tags", "description")
    # Two inputs, as from two files, with all languages told apart by a column.
    half = F.pmod(F.coalesce("video_id", F.lit(0)), F.lit(2)) == 0
    parts = [country_rows(raw.where(part), names, F.col("lang"), (*columns, "lang")) for part in (half, ~half)]
    return all_countries(parts).select(
        F.col("video_id").alias("doc_id"),
        "region",
        "category",
        F.array_join("tags", ";").alias("tags"),
        F.date_format("publishedAt", "yyyy-MM-dd").alias("day"),
        F.md5(F.array_join("description", " ")).alias("words_md5"),
    )


def duration_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as snapshots of parts, and figures per market segment."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    people = table(spark, folder, "customer")
    # Lines, the most rows by far, are joined once.
    bought = orders.join(people, orders["o_custkey"] == people["c_custkey"])
    rows = (
        items.join(bought, items["l_orderkey"] == orders["o_orderkey"])
        .select(
            F.col("l_partkey").alias("video_id"),
            F.col("o_orderstatus").alias("title"),
            F.col("o_orderdate").alias("publishedAt"),
            F.initcap("c_mktsegment").alias("channelTitle"),
            F.col("o_orderpriority").alias("category"),
            F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("at"),
            F.col("l_shipdate").alias("trending_date"),
            F.col("l_quantity").cast("bigint").alias("view_count"),
            F.col("l_linenumber").cast("bigint").alias("likes"),
            F.when(F.col("l_tax") < 0.07, (F.col("l_tax") * 100).cast("bigint")).alias("dislikes"),
            F.col("l_suppkey").alias("comment_count"),
            F.col("l_returnflag").alias("region"),
        )
    )
    stats = (
        people.where("c_mktsegment <> 'MACHINERY'")
        .groupBy(F.col("c_mktsegment").alias("Username"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("Suscribers"),
            F.max("c_acctbal").alias("Visits"),
            F.min("c_acctbal").alias("Likes"),
            F.max("c_nationkey").cast("double").alias("Comments"),
        )
    )
    return rows, stats


@query(
    """
WITH stats AS (
  SELECT c_mktsegment AS seg, cast(count(*) AS double) AS sub, max(c_acctbal) AS vis, min(c_acctbal) AS lik,
         cast(max(c_nationkey) AS double) AS com
  FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1
), j AS (
  SELECT l_partkey AS video_id, l_returnflag AS region, o_orderstatus AS title, o_orderdate AS pub, l_shipdate AS tr,
         o_orderpriority AS category, c_mktsegment AS seg, sub, vis, lik, com, l_orderkey, l_linenumber, l_suppkey,
         cast(l_quantity AS bigint) AS view_count, cast(l_linenumber AS bigint) AS likes,
         CASE WHEN l_tax < 0.07 THEN cast(trunc(l_tax * 100) AS bigint) END AS dislikes, l_suppkey AS comment_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN stats ON seg = c_mktsegment
), w AS (
  SELECT *, min(tr) OVER (PARTITION BY video_id) AS t0, max(tr) OVER (PARTITION BY video_id) AS t1,
         row_number() OVER (PARTITION BY video_id, region ORDER BY tr, l_orderkey, l_linenumber, l_suppkey) AS rn
  FROM j
)
SELECT video_id, region, max(title) FILTER (rn = 1) AS title, max(seg) FILTER (rn = 1) AS segment,
       max(category) FILTER (rn = 1) AS category,
       round((epoch(min(t0)) - epoch(max(pub) FILTER (rn = 1))) / 3600, 4) AS become,
       round((epoch(max(t1)) - epoch(min(t0))) / 3600, 4) AS stay,
       max(sub) FILTER (rn = 1) AS subscribers, max(vis) FILTER (rn = 1) AS visits,
       max(view_count) AS view_count, max(likes) AS likes, max(dislikes) AS dislikes, max(comment_count) AS comment_count
FROM w GROUP BY video_id, region HAVING max(dislikes) IS NOT NULL"""
)
def duration_feature_table(spark, folder):
    """Durations over all regions of a part, one row per (part, region)."""
    rows, stats = duration_rows(spark, folder)
    found = duration_features(
        with_channel_stats(rows, stats), tiebreak=["at.l_orderkey", "at.l_linenumber", "at.l_suppkey"]
    )
    return found.select(
        "video_id", "region", "title", F.upper("channelTitle").alias("segment"), "category",
        F.round("becomeTrendingDuration", 4).alias("become"),
        F.round("endTrendingDuration", 4).alias("stay"),
        F.col("channelSuscribers").alias("subscribers"), F.col("channelAvgVisits").alias("visits"),
        "view_count", "likes", "dislikes", "comment_count",
    )
