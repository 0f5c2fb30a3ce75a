"""The jobs from file to file, on CSV and JSON files that the queries write themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from risingtide.catalogue.base import query, table
from risingtide.functions.keys import hash_threshold
from risingtide.plans.preprocess import preprocess_file, split_file
from risingtide.plans.top_rank import generate_top_rank
from risingtide.schemas import TOP_RANK, VIDEOS
from risingtide.session import work_path
from risingtide.sinks.writers import write_csv_file
from risingtide.sources.readers import read_countries, read_csv, read_stopwords
from risingtide.sources.records import read_records

# The snapshot rows as the files hold them: descriptions with quotes and line breaks, some empty, some missing.
_VIDEOS = """
videos AS (
  SELECT l_returnflag AS flag, 'v' || l_partkey AS video_id, l_shipdate::timestamp AS published, 's' || l_suppkey AS channel,
         s_nationkey AS category, CAST(round(l_extendedprice * 100) AS BIGINT) AS views,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''
              ELSE 'first "line"' || chr(10) || chr(10) || 'order ' || l_orderkey END AS description
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as snapshot rows, one per item and day, with the return flag as country."""
    items, makers = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    text = F.concat(F.lit('first "line"\n\norder '), F.col("l_orderkey").cast("string"))
    values = {
        "video_id": F.concat(F.lit("v"), F.col("l_partkey").cast("string")),
        "title": F.concat(F.lit('Part, "'), F.col("l_partkey").cast("string"), F.lit('"')),
        "publishedAt": F.col("l_shipdate").cast("timestamp"), "channelId": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
        "channelTitle": F.col("s_name"), "categoryId": F.col("s_nationkey"), "trending_date": F.col("l_shipdate").cast("timestamp"),
        "tags": F.lit("a|b c"), "view_count": F.round(F.col("l_extendedprice") * 100), "likes": F.col("l_linenumber"),
        "dislikes": F.lit(0), "comment_count": F.lit(1), "thumbnail_link": F.lit("http://t"), "comments_disabled": F.lit(False),
        "ratings_disabled": F.lit(True),
        "description": F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") != 7, text),
    }
    rows = items.join(makers, items["l_suppkey"] == makers["s_suppkey"])
    return rows.select("l_returnflag", *[values[f.name].cast(f.dataType).alias(f.name) for f in VIDEOS])


def _country_files(spark: SparkSession, folder: str) -> str:
    """One file, or folder of files, per return flag, named after it twice: AA_videos.csv, NN_videos.csv, RR_videos.csv."""
    root, videos = work_path(spark, "countries"), _videos(spark, folder)
    for flag in ("A", "N", "R"):
        write_csv_file(videos.where(F.col("l_returnflag") == flag).drop("l_returnflag"), f"{root}/{flag}{flag}_videos.csv", large=True)
    return root


@query(f"WITH {_VIDEOS} SELECT flag || flag AS country, category, count(*) AS n, sum(views) AS views, "
       "count(nullif(description, '')) AS described FROM videos GROUP BY ALL")
def country_files_glob(spark, folder):
    """Files told apart by their names, read by one glob. An empty description comes back as a missing one."""
    root = _country_files(spark, folder)
    read = read_countries(spark, f"{root}/*_videos.csv")
    return read.groupBy("country", F.col("categoryId").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("view_count").alias("views"), F.count("description").alias("described"))


@query(f"""
WITH {_VIDEOS},
best AS (SELECT video_id AS id, strftime(published, '%Y-%m-%d') AS day, category AS type, max(views) AS value FROM videos GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, id, type) AS rk FROM best)
SELECT substr(day, 1, 7) AS date, CAST(type AS varchar) AS type, n_name AS name, count(*) AS rank_count
FROM ranked JOIN nation ON type = n_nationkey WHERE rk <= 10 GROUP BY ALL""")
def top_rank_files(spark, folder):
    """The report as one CSV file from CSV files; a second run replaces the first one's."""
    root, out = _country_files(spark, folder), work_path(spark, "report")
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    write_csv_file(names, f"{root}/categories.csv")
    generate_top_rank(spark, f"{root}/categories.csv", f"{root}/AA_videos.csv", out)
    generate_top_rank(spark, f"{root}/categories.csv", f"{root}/*_videos.csv", out)
    return read_csv(spark, out, TOP_RANK)


@query(f"""WITH {_VIDEOS} SELECT video_id, category, views, n_name AS category_name, md5(coalesce(description, '')) AS description_md5
           FROM videos LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON category = n_nationkey WHERE flag = 'R'""")
def preprocess_files(spark, folder):
    """A country's file and its nested category file to the processed CSV; a second run keeps it."""
    root, out = _country_files(spark, folder), work_path(spark, "processed")
    item = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.struct(F.col("n_name").alias("title")).alias("snippet"))
    names = table(spark, folder, "nation").where("n_nationkey < 20")
    names.agg(F.collect_list(item).alias("items")).coalesce(1).write.json(f"{root}/RR_category_id")
    preprocess_file(spark, f"{root}/RR_videos.csv", f"{root}/RR_category_id", out)
    preprocess_file(spark, f"{root}/AA_videos.csv", f"{root}/RR_category_id", out)
    read = read_csv(spark, out, T.StructType([*VIDEOS.fields, T.StructField("category_name", T.StringType())]), multi_line=True)
    return read.select("video_id", F.col("categoryId").alias("category"), F.col("view_count").alias("views"), "category_name",
                       F.md5(F.coalesce("description", F.lit(""))).alias("description_md5"))


@query(f"""WITH {_VIDEOS} SELECT CASE WHEN substr(md5(channel), 1, 8) < '{hash_threshold(0.1)}' THEN 'test' ELSE 'train' END AS part,
           video_id, channel, views FROM videos WHERE flag = 'N'""")
def split_files(spark, folder):
    """One processed file to a train and a test CSV, whole channels apart."""
    root, out = _country_files(spark, folder), work_path(spark, "split")
    split_file(spark, f"{root}/NN_videos.csv", f"{out}/train", f"{out}/test")
    parts = [read_records(spark, f"{out}/{part}", VIDEOS)[0].select(
        F.lit(part).alias("part"), "video_id", F.col("channelId").alias("channel"), F.col("view_count").alias("views"))
        for part in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("""SELECT status, count(*) AS n, sum(doc_id) AS ids, sum(CASE WHEN status = 'good' THEN n_chars END) AS chars
          FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'few' WHEN doc_id % 7 = 1 THEN 'many' ELSE 'good' END AS status FROM documents)
          GROUP BY status""")
def csv_single_line_bad_rows(spark, folder):
    """Lines with too few or too many fields, set apart from the good ones by the corrupt-record column."""
    docs, path, odd = table(spark, folder, "documents"), work_path(spark, "lines"), F.pmod("doc_id", F.lit(7))
    ids, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    fields = F.when(odd == 0, F.array(ids, chars)).when(odd == 1, F.array(ids, chars, "lang", F.lit("x"))).otherwise(F.array(ids, chars, "lang"))
    docs.select(F.array_join(fields, ",").alias("value")).write.text(path)
    good, bad = read_records(spark, path, docs.select("doc_id", "n_chars", "lang").schema, header=False, multi_line=False)
    cut = F.split("text", ",")
    found = good.select("doc_id", "n_chars", F.lit("good").alias("status")).unionByName(bad.select(
        cut[0].cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_chars"), F.when(F.size(cut) < 3, "few").otherwise("many").alias("status")))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


@query("SELECT DISTINCT lower(trim(word)) AS word FROM (SELECT unnest(string_split(c_name || '#' || c_mktsegment, '#')) AS word FROM customer) WHERE trim(word) <> ''")
def stopword_file(spark, folder):
    """A word list as a text file: spaces, cases, repeats and empty lines are evened out."""
    path = work_path(spark, "words")
    words = table(spark, folder, "customer").select(F.explode(F.split(F.concat_ws("#", "c_name", "c_mktsegment"), "#")).alias("value"))
    words.select(F.concat(F.lit(" "), "value", F.lit(" \r"))).union(words.limit(1).select(F.lit(""))).write.text(path)
    return read_stopwords(spark, path)
