"""Tokenising, cleaning and term weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.catalogue.base import query, table
from risingtide.functions.text import (
    TERM_FRAGMENTS,
    alpha_term,
    alpha_tokens,
    joined,
    letter_digit_runs,
    lower_words,
    remove_stopwords,
    spaced_tokens,
    tag_list,
    tag_tokens,
    unescape_html,
    word_term,
    word_tokens,
)
from risingtide.operators.distribution import quartile_bins
from risingtide.operators.features import hashed_tfidf_vectors
from risingtide.operators.indexing import tfidf_entries
from risingtide.operators.ranking import top_overall
from risingtide.operators.terms import (
    lowest_idf_by_group,
    stack_texts,
    term_stats,
    tfidf_top_terms,
    top_words_by_group,
)
from risingtide.plans.reports import top_words, top_words_by_quartile

# Stop words of the examples, in the languages of the documents.
STOPWORDS = ("the", "and", "of", "to", "in", "is", "le", "la", "de", "der", "die", "und", "el", "los")
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _digest(tokens, name: str):
    return [F.size(tokens).alias(f"{name}_n"), F.md5(joined(tokens)).alias(f"{name}_md5")]


def _sql_digest(expr: str, name: str) -> str:
    return f"len({expr}) AS {name}_n, md5(array_to_string({expr}, ' ')) AS {name}_md5"


def _runs(text: str) -> str:
    return f"string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"


def _alpha(text: str) -> str:
    barred = "|".join(TERM_FRAGMENTS)
    return (
        f"list_filter({_runs(text)}, lambda t: regexp_full_match(t, '\\p{{L}}+') "
        f"AND NOT regexp_matches(t, '{barred}') AND NOT list_contains({_STOP}, t))"
    )


_LOWER = "list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 1)"
_LOWER_STOP = f"list_filter({_LOWER}, lambda t: NOT list_contains({_STOP}, t))"
_WORDS = f"list_filter({_runs('text')}, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"
_SPACED = (
    "CASE WHEN text <> '' AND regexp_replace(text, '\\s+$', '') = '' THEN []::varchar[] "
    "ELSE string_split_regex(regexp_replace(lower(text), '\\s+$', ''), '\\s') END"
)


@query(f"SELECT doc_id, {_sql_digest(_LOWER_STOP, 'plain')}, {_sql_digest(_WORDS, 'words')} FROM documents")
def tokens_text(spark, folder):
    return _docs(spark, folder).select(
        "doc_id",
        *_digest(remove_stopwords(lower_words("text"), STOPWORDS), "plain"),
        *_digest(word_tokens("text", STOPWORDS), "words"),
    )


@query(f"SELECT doc_id, {_sql_digest(_SPACED, 'spaced')} FROM documents")
def tokens_spaced(spark, folder):
    """Split at every white-space character, empty tokens kept."""
    return _docs(spark, folder).select("doc_id", *_digest(spaced_tokens("text"), "spaced"))


_URL = "list_filter(string_split(lower(url), '/'), lambda t: length(t) >= 1 AND t <> '[none]')"
_NAMES = "list_transform(string_split(p_name, ' '), lambda t: trim(t))"


@query(
    f"SELECT 'page' AS kind, page_id AS id, {_sql_digest(_URL, 'tags')} FROM pages "
    f"UNION ALL SELECT 'part', p_partkey, {_sql_digest(_NAMES, 'tags')} FROM part"
)
def tokens_tags(spark, folder):
    """Lower-cased tags of page addresses, and part names as tag lists."""
    pages = table(spark, folder, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), *_digest(tag_tokens("url", "/"), "tags")
    )
    parts = table(spark, folder, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), *_digest(tag_list("p_name", " "), "tags")
    )
    return pages.unionByName(parts)


@query(f"SELECT doc_id, {_sql_digest(_alpha('text'), 'alpha')} FROM documents")
def tokens_alpha(spark, folder):
    return _docs(spark, folder).select("doc_id", *_digest(alpha_tokens("text", STOPWORDS), "alpha"))


@query(
    """
SELECT word, count(*) AS n FROM (
  SELECT unnest(list_filter(string_split_regex(lower(source || ' ' || lang || ' ' || text), '\\s+'),
                            lambda t: length(t) >= 1)) AS word FROM documents) GROUP BY 1"""
)
def tokens_joined(spark, folder):
    """Columns put together as one text, split, joined again, and counted by word."""
    text = joined(lower_words(F.concat_ws(" ", "source", "lang", "text")))
    words = _docs(spark, folder).select(F.explode(F.split(text, " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'),
       '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS html_md5 FROM pages"""
)
def html_unescape(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(unescape_html("html")).alias("html_md5"))


# ---------------------------------------------------------------- term weights


def _tfidf_sql(docs: str, n: int) -> str:
    """``docs`` gives (id, tokens), one row per document."""
    return f"""
WITH docs AS ({docs}),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {n}),
w AS (
  SELECT id, term, idf, tf * idf AS w FROM tf JOIN (
    SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1 AS idf FROM vocab) USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT term, round(max(idf), 6) AS idf, round(sum(w / norm), 4) AS score
FROM w JOIN nrm USING (id) GROUP BY term"""


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.select("term", F.round("idf", 6).alias("idf"), F.round("score", 4).alias("score"))


@query(
    _tfidf_sql(
        f"SELECT doc_id || 't' AS id, {_alpha('text')} AS tokens FROM documents "
        f"UNION ALL SELECT doc_id || 's', {_alpha('lang')} FROM documents",
        10,
    )
)
def tfidf_top_terms_stacked(spark, folder):
    """Two text columns stacked into twice as many documents."""
    docs = stack_texts(_docs(spark, folder).select("text", "lang"), ["text", "lang"])
    docs = docs.select(letter_digit_runs("document").alias("tokens"))
    found = tfidf_top_terms(docs, "tokens", 10, alpha_term(STOPWORDS))
    top = top_overall(found, [F.desc("score"), F.asc("term")], 10)
    return _rounded_scores(top)


@query(_tfidf_sql(f"SELECT doc_id AS id, {_alpha('text')} AS tokens FROM documents", 200))
def tfidf_wide_vocabulary(spark, folder):
    docs = _docs(spark, folder).select(letter_digit_runs("text").alias("tokens"))
    return _rounded_scores(tfidf_top_terms(docs, "tokens", 200, alpha_term(STOPWORDS)))


@query(
    _tfidf_sql(
        f"""WITH latest AS (
              SELECT * FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last
                             FROM conversations WHERE turn < 4) WHERE turn = last)
            SELECT conv_id || 't' AS id, {_alpha('text')} AS tokens FROM latest
            UNION ALL SELECT conv_id || 'r', {_alpha('role')} FROM latest""",
        10,
    )
)
def top_words_latest(spark, folder):
    """Top words of the latest turn before a cutoff, over two text columns."""
    talks = table(spark, folder, "conversations")
    return _rounded_scores(top_words(talks, "conv_id", "turn", "4", ("text", "role"), STOPWORDS))


@query(
    f"""
SELECT term, sum(c) AS "count", count(*) AS doc_count FROM (
  SELECT doc_id, term, count(*) AS c FROM (
    SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term"""
)
def term_counts(spark, folder):
    docs = _docs(spark, folder).select(letter_digit_runs("text").alias("tokens"))
    return term_stats(docs, "tokens", word_term(STOPWORDS))


_QUARTILE = """
(SELECT *, 1 + (n_chars > q[1])::int + (n_chars > q[2])::int + (n_chars > q[3])::int AS quartile
 FROM documents, (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents))"""


@query(
    f"""
WITH d AS (SELECT doc_id, quartile, {_alpha('text')} AS tokens FROM {_QUARTILE}),
c AS (SELECT quartile, term, count(*) AS doc_count FROM (
        SELECT DISTINCT quartile, doc_id, term FROM (SELECT quartile, doc_id, unnest(tokens) AS term FROM d))
      GROUP BY ALL),
s AS (SELECT quartile, count(*) AS n FROM d GROUP BY 1)
SELECT quartile, rank, term, doc_count, round(ln((1.0 + n) / (1.0 + doc_count)) + 1, 6) AS idf
FROM (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY doc_count DESC, term) AS rank FROM c)
JOIN s USING (quartile) WHERE rank <= 30"""
)
def tfidf_terms_by_quartile(spark, folder):
    docs = quartile_bins(_docs(spark, folder), "n_chars")
    docs = docs.select("quartile", letter_digit_runs("text").alias("tokens"))
    found = lowest_idf_by_group(docs, "tokens", "quartile", 30, alpha_term(STOPWORDS))
    return found.withColumn("idf", F.round("idf", 6))


@query(
    f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lang DESC, doc_id) AS rk
                 FROM documents WHERE lang < 'zz') WHERE rk = 1),
d AS (SELECT doc_id, ntile(4) OVER (ORDER BY n_chars, doc_id) AS quartile, {_alpha('text')} AS tokens FROM latest),
c AS (SELECT quartile, term, count(*) AS doc_count FROM (
        SELECT DISTINCT quartile, doc_id, term FROM (SELECT quartile, doc_id, unnest(tokens) AS term FROM d))
      GROUP BY ALL),
s AS (SELECT quartile, count(*) AS n FROM d GROUP BY 1)
SELECT quartile, rank, term, doc_count, round(ln((1.0 + n) / (1.0 + doc_count)) + 1, 6) AS idf
FROM (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY doc_count DESC, term) AS rank FROM c)
JOIN s USING (quartile) WHERE rank <= 10"""
)
def top_words_equal_quartiles(spark, folder):
    """Latest row per document, four equal parts by length, words of each part."""
    found = top_words_by_quartile(
        _docs(spark, folder), "doc_id", "lang", "zz", "n_chars", "text", STOPWORDS, 10,
        tiebreak=["doc_id"], equal_counts=True,
    )
    return found.withColumn("idf", F.round("idf", 6))


@query(
    f"""
WITH c AS (SELECT quartile, term, count(*) AS "count" FROM (
  SELECT quartile, unnest({_WORDS}) AS term FROM {_QUARTILE}) GROUP BY ALL)
SELECT quartile, term, "count", rank FROM (
  SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY "count" DESC, term) AS rank FROM c) WHERE rank <= 10"""
)
def words_by_quartile(spark, folder):
    docs = quartile_bins(_docs(spark, folder), "n_chars")
    docs = docs.select("quartile", letter_digit_runs("text").alias("tokens"))
    return top_words_by_group(docs, "tokens", "quartile", 10, word_term(STOPWORDS))


@query(
    f"""
SELECT term, round(sum(c) * ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))), 4) AS score
FROM (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL)
GROUP BY term ORDER BY score DESC, term LIMIT 10"""
)
def tfidf_ml(spark, folder):
    """Counts times IDF, listed by summed weight; the vocabulary is a table."""
    docs = _docs(spark, folder).select("doc_id", word_tokens("text", STOPWORDS).alias("tokens"))
    sums = tfidf_entries(docs, "doc_id", "tokens").groupBy("term").agg(F.sum("weight").alias("score"))
    return top_overall(sums, [F.desc("score"), F.asc("term")], 10).withColumn("score", F.round("score", 4))


@query()
def tfidf_ml_hashed(spark, folder):
    docs = _docs(spark, folder).select("doc_id", word_tokens("text", STOPWORDS).alias("tokens"))
    return hashed_tfidf_vectors(docs, "tokens").select("doc_id", F.col("tfidf").cast("string").alias("tfidf"))
