"""Mixing to a caller's weights, and what happens when targets can't be met."""

import pytest
from pyspark.sql import functions as F

from habitrace.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, counts):
    rows = [(lang, source, i) for (source, lang), n in counts.items() for i in range(n)]
    return spark.createDataFrame([(k, "word " * (1 + i % 3), lang, source, 0) for k, (lang, source, i) in enumerate(rows)], DOC)


def _reached(plan, dim):
    p = plan.toPandas()
    now = (p.n_tokens * p.probability).groupby(p[dim]).sum()
    return dict(now / now.sum())


def test_weights_of_the_caller(spark):
    df = _docs(spark, {("a", "en"): 60, ("a", "de"): 2, ("b", "en"): 2, ("b", "de"): 60, (None, "en"): 9})
    source = spark.createDataFrame([("a", 7.0), ("b", 1.0), (None, 2.0)], "source string, weight double")
    lang = spark.createDataFrame([("en", 1.0), ("de", 1.0)], "lang string, weight double")
    plan = mixing.plan(df, targets={"source": source, "lang": lang})
    assert _reached(plan, "source") == pytest.approx({"a": 0.7, "b": 0.1, "(none)": 0.2}, abs=2e-5)
    assert _reached(plan, "lang") == pytest.approx({"en": 0.5, "de": 0.5}, abs=2e-5)
    assert mixing.mixed(df, targets={"source": source, "lang": lang}).count() == plan.filter("chosen").count()


def test_contradicting_targets(spark):
    df = _docs(spark, {("s1", "A"): 10, ("s2", "A"): 10, ("s3", "A"): 10, ("s4", "B"): 30})
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.plan(df)
    lang = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "lang string, weight double")
    with pytest.raises(ValueError, match="targets not met"):
        mixing.plan(df, targets={"lang": lang})
    absent = spark.createDataFrame([("A", 1.0), ("C", 1.0)], "lang string, weight double")
    with pytest.raises(ValueError, match="targets not met"):
        mixing.plan(df, targets={"lang": absent})


@pytest.mark.parametrize("weights", [[("A", -1.0), ("B", 2.0)], [("A", 0.0)], [("A", float("nan"))]])
def test_bad_weights(spark, weights):
    with pytest.raises(ValueError, match="weights of lang"):
        mixing.plan(_docs(spark, {("s", "A"): 3}), targets={"lang": spark.createDataFrame(weights, "lang string, weight double")})


def test_topic_of_the_caller(spark):
    """A caller's topic column is raked to the caller's weights, in the plan and in the draw."""
    df = _docs(spark, {("a", "en"): 60, ("a", "de"): 20, ("b", "en"): 20, ("b", "de"): 60}).withColumn("theme", F.when(F.col("doc_id") % 3 == 0, "law").when(F.col("doc_id") % 3 == 1, "art"))
    weights = spark.createDataFrame([("law", 1.0), ("art", 2.0), (None, 1.0)], "topic string, weight double")
    plan = mixing.plan(df, topic=F.col("theme"), targets={"topic": weights})
    assert _reached(plan, "topic") == pytest.approx({"law": 0.25, "art": 0.5, "(none)": 0.25}, abs=2e-5)
    kept = mixing.mixed(df, topic=F.col("theme"), targets={"topic": weights})
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in plan.filter("chosen").collect())


def test_registers(spark):
    texts = ["Plain words, as they come; nothing else.", "A | b | c | d | e", "SHOUTED WORDS EVERYWHERE", "12 34 56 words", "a\nb\nc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.t for r in df.select(mixing.topic_of(F.coalesce("text", F.lit(""))).alias("t")).collect()] == ["prose", "symbols", "capitals", "numbers", "lines", "prose", "prose"]
