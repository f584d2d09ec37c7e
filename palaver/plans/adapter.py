"""Comment, prediction and evaluation tables derived from the driver's tables.

The driver has documents, orders and events but no comments.  Each document becomes
a comment; its order and event supply times, scores and the post.  Plain documents
hold no link, emoji or deletion marker, so some get one, chosen by document id; all
documents stay in, with their whole text.

Column rules are SQL that Spark and DuckDB read alike; :mod:`palaver.plans.oracle`
uses the same rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.fixed import EMOTIONS
from palaver.functions.labels import encode, sentiment_of, string_array
from palaver.operators.common import dealt
from palaver.sources.comments import with_text_metrics

# Rules over: doc_id, text, lang, source (document); comment_at, value (its own
# order and event); post_key, post_at, post_price (the post's order); copy_no.
RULES = {
    "doc_id": "doc_id",
    "ingest_order": "doc_id + copy_no * 1000000000000",
    "comment_id": "concat('c', cast(doc_id as string))",
    "post_id": "concat('p', cast(post_key as string))",
    "post_title": "concat('post p', cast(post_key as string))",
    "post_hint": (
        "case doc_id % 4 when 0 then 'image' when 1 then 'rich:video' "
        "when 2 then 'hosted:video' else 'link' end"
    ),
    # Comments of a post disagree on its score, and some do not know it.
    "post_score": (
        "case when doc_id % 13 = 3 then null "
        "else cast(floor(post_price / 100) as bigint) + doc_id % 3 end"
    ),
    "post_created_at": "post_at",
    "comment_created_at": "comment_at",
    "comment_score": (
        "case when doc_id % 97 = 6 then 5000 else cast(floor(value) as bigint) - 5 end"
    ),
    "comment_author": (
        "case when doc_id % 19 = 7 then 'AutoModerator' "
        "when doc_id % 37 = 8 then null else source end"
    ),
    "subreddit": "lang",
    "comment_body": (
        "case when doc_id % 23 = 1 then '[deleted]' "
        "when doc_id % 29 = 2 then ' [REMOVED] ' "
        "when doc_id % 31 = 3 then ' https://example.com/only ' "
        "when doc_id % 11 = 4 then "
        "concat(text, ' see [my label](https://example.com/a) and www.example.org/x now') "
        "when doc_id % 13 = 5 then "
        "concat(text, ' Love great fake midjourney prompt \U0001f600\U0001f600') "
        # Runs of several lengths, a CJK run, and marks that no emoji range covers.
        "when doc_id % 17 = 6 then concat(text, ' \U0001f680\U0001f680\U0001f680 "
        "\u4f60\u597d \U0001f600 \u00a9\u2192 \U0001f680') "
        "else text end"
    ),
}
COPIES = "case when doc_id % 10 = 9 then 2 else 1 end"
NO_LABEL = "doc_id % 9 = 4"
SECOND_LABEL = "doc_id % 3 = 0"
ODD_LABEL = "doc_id % 41 = 0"


# Declared, so that no file has to be opened to plan a query.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_comments(
    spark: SparkSession, sf_dir: str, measure: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The loaded comment table.

    ``measure`` replaces the bodies by columns of its own next to the scan, so that no text is
    shuffled, unless few tasks scan most of the documents.

    The narrow tables are joined first, so the text is shuffled once, by document id;
    the join is a sort-merge join on that key because both sides grow with the data.
    The shuffle also spreads a file that arrives as one row group.  Copies come from
    expanding rows, not from a second scan.
    """
    orders = table(spark, sf_dir, "orders")
    own = orders.select(
        "o_orderkey",
        (F.col("o_orderkey") - F.col("o_orderkey") % 7).alias("post_key"),
        F.col("o_orderdate").alias("comment_at"),
    )
    post = orders.select(
        F.col("o_orderkey").alias("post_key"),
        F.col("o_orderdate").alias("post_at"),
        F.col("o_totalprice").alias("post_price"),
    )
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), "value")
    facts = own.join(events, "o_orderkey").join(post, "post_key")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rules = dict(RULES)
    if measure:
        body = F.expr(rules.pop("comment_body")).alias("comment_body")
        plain = ["doc_id", "lang", "source"]
        documents = measure(dealt(documents, "doc_id").select(*plain, body))
        rules |= {c: f"`{c}`" for c in documents.columns if c not in plain}
    joined = documents.hint("merge").join(facts, documents["doc_id"] == facts["o_orderkey"])
    copies = F.expr(f"sequence(0L, cast({COPIES} - 1 as bigint))")
    rows = joined.withColumn("copy_no", F.explode(copies))
    rows = rows.select(*[F.expr(sql).alias(n) for n, sql in rules.items()])
    return rows if measure else with_text_metrics(rows)


def conflicting_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw comments, where a copy's body says which copy it is."""
    return raw_comments(spark, sf_dir).withColumn(
        "comment_body",
        F.concat(F.lit("v"), F.col("ingest_order").cast("string"), F.lit(" "), "comment_body"),
    )


def _emotion(multiplier: int, offset: int) -> Column:
    index = (F.col("doc_id") * multiplier + offset) % len(EMOTIONS)
    return F.element_at(string_array(EMOTIONS), (index + 1).cast("int"))


def _labels(shift_every: int | None, odd: bool) -> Column:
    """A label list per document; every ``shift_every``-th has another first label."""
    first = _emotion(5, 0)
    if shift_every is not None:
        first = F.when(F.col("doc_id") % shift_every == 1, _emotion(5, 1)).otherwise(first)
    nothing = string_array([])
    listed = F.concat(
        F.array(first),
        F.when(F.expr(SECOND_LABEL), F.array(_emotion(11, 3))).otherwise(nothing),
    )
    labels = F.when(F.expr(NO_LABEL), nothing).otherwise(listed)
    if odd:
        extra = F.when(F.expr(ODD_LABEL), F.array(F.lit("weird"))).otherwise(nothing)
        labels = F.concat(labels, extra)
    return labels


def predictions(comments: DataFrame) -> DataFrame:
    """The prediction table over cleaned comments."""
    labelled = comments.withColumn("emotions", _labels(None, odd=True))
    return labelled.withColumns(
        {
            "predicted_emotions": encode(F.col("emotions")),
            "predicted_sentiment": sentiment_of(F.col("emotions")),
        }
    )


def evaluation_rows(comments: DataFrame) -> DataFrame:
    """``(model, model_label, id, truth, predicted)`` for two models."""
    models = F.array(
        F.struct(
            F.lit("model_a").alias("model"),
            F.lit("Model A").alias("model_label"),
            _labels(None, odd=True).alias("predicted"),
        ),
        F.struct(
            F.lit("model_b").alias("model"),
            F.lit("Model B").alias("model_label"),
            _labels(5, odd=True).alias("predicted"),
        ),
    )
    return comments.select(
        F.col("doc_id").alias("id"), _labels(4, odd=False).alias("truth"), F.inline(models)
    )


def guesses(shift_every: int | None) -> Column:
    """A toy model's labels of a ``doc_id``."""
    return _labels(shift_every, odd=True)


def truth_and_prediction(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as two tables, for one model."""
    ids = F.col("doc_id").alias("id")
    return (
        comments.select(ids, _labels(4, odd=False).alias("truth")),
        comments.select(ids, _labels(None, odd=True).alias("predicted")),
    )


def replies(comments: DataFrame) -> DataFrame:
    """``(comment_id, raw_response)``: model replies in ten styles."""
    one, two = _emotion(5, 0), _emotion(11, 3)

    def say(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    styles = [
        say(' {"emotions": ["', F.upper(one), ' ", "x", "', one, '", "', two, '"]}\n'),
        say('{"labels":"', one, '"}'),
        say('ok: {"emotions": ["', one, '"]} end'),
        say("I feel ", one, ", and ", two, ". ", F.col("comment_body")),
        say('["', one, '", 5]'),
        say('{"emotions": []}'),
        say('{"labels": ["', two, '"], "emotions": null, "note": "', one, '"}'),
        say('"', one, '"'),
        say('{"emotions": ["', two, '"], "note": {"emotions": 1}, "emotions": ["', one, '"]}'),
        say('so {"emotions": "', two, '", "emotions": ["x", "', one, '"]} end'),
    ]
    style = F.element_at(F.array(*styles), (F.col("doc_id") % len(styles) + 1).cast("int"))
    return comments.select("comment_id", style.alias("raw_response"))
