from pyspark.sql import functions as F

from risingtide.functions import text


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr.alias("y")).first()["y"]


def test_lower_words_drops_empty_tokens(spark):
    assert one(spark, "  Hello  big\tWorld ", text.lower_words("x")) == ["hello", "big", "world"]


def test_spaced_tokens_keeps_inner_empty_tokens(spark):
    from pyspark.ml.feature import Tokenizer

    for value in ["a  b ", " a", "", "   ", "x\ty\n"]:
        df = spark.createDataFrame([(value,)], "x string")
        expected = Tokenizer(inputCol="x", outputCol="y").transform(df).first()["y"]
        assert one(spark, value, text.spaced_tokens("x")) == expected, repr(value)


def test_lower_words_and_tags_equal_spark_ml(spark):
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    df = spark.createDataFrame([("The cat AND the Hat",), ("[None]",), ("a|B b||c",), ("",)], "x string")
    df = RegexTokenizer(inputCol="x", outputCol="w").transform(df)
    df = StopWordsRemover(inputCol="w", outputCol="ml", stopWords=["the", "and"]).transform(df)
    df = RegexTokenizer(inputCol="x", outputCol="t", pattern="\\|").transform(df)
    df = StopWordsRemover(inputCol="t", outputCol="ml_tags", stopWords=["[None]"]).transform(df)
    df = df.select(
        "ml", "ml_tags",
        text.remove_stopwords(text.lower_words("x"), ["The", "AND"]).alias("own"),
        text.tag_tokens("x").alias("own_tags"),
    )
    for r in df.collect():
        assert r["own"] == r["ml"] and r["own_tags"] == r["ml_tags"]


def test_stopwords_keep_repeats(spark):
    assert one(spark, "b a b", text.remove_stopwords(text.lower_words("x"), ["a"])) == ["b", "b"]


def test_tag_list_keeps_case_and_handles_none(spark):
    assert one(spark, " Foo |Bar Baz", text.tag_list("x")) == ["Foo", "Bar Baz"]
    assert one(spark, "[None]", text.tag_list("x")) == []
    assert one(spark, "", text.tag_list("x")) == []
    assert one(spark, None, text.tag_list("x")) == []


def test_word_and_alpha_tokens(spark):
    assert one(spark, "It's a 4K Été, été!", text.word_tokens("x", ["it"])) == ["4k", "été", "été"]
    assert one(spark, None, text.word_tokens("x")) == []
    assert one(spark, "Newest cats2 cats LIKED dogs", text.alpha_tokens("x", ["dogs"])) == ["cats"]
    assert one(spark, "new dogs", text.alpha_tokens("x", fragments=())) == ["new", "dogs"]


def test_unescape_decodes_ampersand_last(spark):
    assert one(spark, "&lt;b&gt; &quot;&#39; &amp;lt;", text.unescape_html("x")) == "<b> \"' &lt;"


def test_joined_and_names(spark):
    assert one(spark, "a b", text.joined(F.split("x", " "), "-")) == "a-b"
    assert one(spark, "My Name X", text.normalised_name("x")) == "mynamex"
