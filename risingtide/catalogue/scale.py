"""Forms for large tables: indexes of terms and labels, sketches, exact samples, partitions replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.catalogue.base import ORACLES, query, table
from risingtide.catalogue.models import _text_rows
from risingtide.catalogue.reports import _user_series
from risingtide.catalogue.texts import STOPWORDS, _WORDS
from risingtide.functions.text import word_tokens
from risingtide.operators.enrich import keep_keys
from risingtide.operators.indexing import label_index, scaled_entries, sparse_vectors, tfidf_entries
from risingtide.operators.kmeans import euclidean_clusters, squares_by_centroid
from risingtide.operators.sketches import RANK_ERROR, merged_sketches, quantile_sketches, rank_errors, sketch_quantiles
from risingtide.operators.split import exact_sample
from risingtide.session import materialise, work_path
from risingtide.sinks.writers import write_csv, write_parquet


@query(ORACLES["scaled_features"])
def scaled_features_indexed(spark, folder):
    """The vectors of ``scaled_features`` with the labels as tables instead of lists."""
    found = scaled_entries(_text_rows(spark, folder), "doc_id", ("lang_id", "view_count"), ("lang", "channelId"))
    return found.withColumn("value", F.round("value", 6))


@query("""SELECT source, count(*) AS "count", row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS "index", count(*) OVER () AS size
          FROM documents WHERE source IS NOT NULL GROUP BY source""")
def label_positions(spark, folder):
    return label_index(table(spark, folder, "documents"), "source")


@query(f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY ALL),
v AS (SELECT term, row_number() OVER (ORDER BY sum(c) DESC, term) - 1 AS pos,
             ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) AS idf FROM c GROUP BY term)
SELECT doc_id, count(*) AS n_terms, min(pos) AS first, max(pos) AS last, md5(string_agg(pos, ',' ORDER BY pos)) AS positions_md5,
       round(sum(c * idf), 4) AS weight
FROM c JOIN v USING (term) GROUP BY doc_id""")
def tfidf_indexed(spark, folder):
    """The sparse TF-IDF vector of every document, positions by falling count over the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", word_tokens("text", STOPWORDS).alias("tokens"))
    vectors = sparse_vectors(tfidf_entries(docs, "doc_id", "tokens"), "doc_id")
    return vectors.select(
        "doc_id", F.size("positions").cast("long").alias("n_terms"), F.array_min("positions").alias("first"),
        F.array_max("positions").alias("last"), F.md5(F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")).alias("positions_md5"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("weight"))


_PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@query(f"""SELECT l_linestatus, l_returnflag, count(*) AS "rows", min(l_extendedprice) AS least, max(l_extendedprice) AS most, true AS within
           FROM lineitem GROUP BY ALL""")
def sketched_quantiles(spark, folder):
    """Quantiles per group from sketches of its years, and whether all their ranks lie within the stated error."""
    items = table(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    by = ["l_linestatus", "l_returnflag"]
    yearly = materialise(quantile_sketches(items, "l_extendedprice", [*by, "year"]), "sketches")
    found = materialise(sketch_quantiles(merged_sketches(yearly, by), _PROBS), "quantiles")
    errors = rank_errors(items, "l_extendedprice", found, _PROBS, by).drop("rows")
    return found.join(errors, by).select(
        *by, "rows", F.col("quantiles")[0].alias("least"), F.col("quantiles")[len(_PROBS) - 1].alias("most"),
        (F.col("error") <= RANK_ERROR).alias("within"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('sample' || o_orderkey), o_orderkey LIMIT 777")
def exact_size_sample(spark, folder):
    """Exactly 777 rows, found by narrowing down the hash where they end."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return exact_sample(orders, "o_orderkey", 777, "sample", end_rows=10)


@query("""SELECT kind, doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN 10 * n_chars ELSE n_chars END AS n_chars
          FROM documents, (VALUES ('csv'), ('parquet')) k(kind)""")
def rerun_replaces_partitions(spark, folder):
    """A second run with two languages replaces their partitions and leaves the others."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    again = docs.where("lang IN ('de', 'fr')").withColumn("n_chars", 10 * F.col("n_chars"))
    parts = []
    for kind, write in (("csv", write_csv), ("parquet", write_parquet)):
        path = work_path(spark, f"languages-{kind}")
        for rows in (docs, again):
            write(rows, path, partition_by=["lang"], replace_partitions=True)
        reader = spark.read.option("header", "true") if kind == "csv" else spark.read
        read = reader.schema(docs.schema).format(kind).load(path)
        parts.append(read.select(F.lit(kind).alias("kind"), "doc_id", "lang", "n_chars"))
    return parts[0].unionByName(parts[1])


@query("""
WITH d AS (SELECT user_id, ts::date AS day, avg(value) AS m FROM events GROUP BY ALL),
span AS (SELECT unnest(generate_series(min(day)::timestamp, max(day)::timestamp, INTERVAL 1 DAY))::date AS day FROM d),
f AS (SELECT u.user_id, s.day, coalesce(m, 0) AS v
      FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN span s LEFT JOIN d USING (user_id, day)),
z AS (SELECT user_id, day, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM f WINDOW w AS (PARTITION BY user_id)),
a AS (SELECT user_id, z - avg(z) OVER (PARTITION BY day) AS x FROM z)
SELECT count(DISTINCT user_id) AS series, round(sum(x * x), 2) AS squares, 0 AS moved FROM a""")
def series_kmeans(spark, folder):
    """Euclidean clusters of the users' series: squares within and between them, and series nearer to another centroid."""
    found = squares_by_centroid(euclidean_clusters(_user_series(spark, folder), "user_id", "z"), "z")
    return found.select("series", F.round(F.col("within") + F.col("between"), 2).alias("squares"), "moved")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
          WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 7)""")
def keys_screened(spark, folder):
    """Rows of listed keys, screened by a Bloom filter before they are shuffled."""
    wanted = table(spark, folder, "orders").where("o_custkey % 50 = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    return keep_keys(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), wanted, ["l_orderkey"], screen=True)
