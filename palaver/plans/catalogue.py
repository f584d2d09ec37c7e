"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.fixed import NEGATIVE_WORDS, POSITIVE_WORDS
from palaver.functions import labels as L
from palaver.functions.text import strip_urls
from palaver.functions.values import epoch_seconds
from palaver.operators import cleaning as C
from palaver.operators import evaluation as E
from palaver.operators import predictions as P
from palaver.operators import profile as A
from palaver.operators import sampling as G
from palaver.operators import scoring as S
from palaver.operators import terms as T
from palaver.operators import training as M
from palaver.operators import vocabulary as V
from palaver.operators.ledger import fill_ledger, score_with_ledger
from palaver.operators.multilabel import fit_multilabel, optimality
from palaver.operators.quantiles import exact_quantiles
from palaver.operators.reply_cache import ReplyCache, score_with_reply_cache
from palaver.operators.term_index import TermIndex
from palaver.plans import adapter, toys
from palaver.plans.jobs import benchmark
from palaver.session import shared_folder
from palaver.sources.comments import read_comments_csv
from palaver.sources.examples import load_splits, prepare_examples
from palaver.sources.predictions import read_predictions_csv
from palaver.sources.sinks import export_csv, list_runs, read_run, write_run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_LENGTH = 200
TERM = "prompt"
SAMPLE = 300
WEEKLY_TARGET = 502
PERIOD = (datetime(2024, 1, 1), datetime(2024, 1, 31))
EVENT_HINTS = ("view", "click")
SCORE_THRESHOLD = 0.05
# Custom keyword patterns: label, pattern, and the same in RE2 over spelled-out sets.
PATTERNS = (
    ("two marks", r"\W\W", "[^{W}][^{W}]"),
    ("number end", r"\d+\D", r"\p{{Nd}}+\P{{Nd}}"),
    ("long run", r"\S{12,}", "[^{WS}]{{12,}}"),
    ("optional edge", r"\b?the", "(?i)the"),
)
# Patterns enough for their literals to be looked for together.
MANY_PATTERNS = tuple(
    (w, rf"\b{w}\b")
    for w in (*POSITIVE_WORDS, *NEGATIVE_WORDS, "the", "of the", "and the", "der", "que", "les")
)
SEARCHED = (TERM, "the", "of the", "und der", "not in any comment")
QUARTILES = (0.25, 0.5, 0.75)
TEST_SAMPLES = 100
STEPS = 4
WIDE = ("joy", "anger", "pride", "fear")
# One sampled row has no id.
NO_ID = "c42"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def on_clean(operator: Callable[[DataFrame], DataFrame], name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(cleaned(spark, sf_dir))


def on_predictions(operator: Callable[[DataFrame], DataFrame], name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(predicted(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(adapter.raw_comments(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.predictions(cleaned(spark, sf_dir))


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, worked out once and read from a shared folder."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- cleaning ------------------------------------------------------------------


@query
def clean_comments(spark, sf_dir):
    return cleaned(spark, sf_dir).drop("ingest_order", "doc_id")


@query
def clean_min_length(spark, sf_dir):
    options = C.CleaningOptions(min_comment_length=MIN_LENGTH)
    rows = C.clean(adapter.raw_comments(spark, sf_dir), options)
    return rows.select("comment_id", "comment_length", "comment_word_count")


@query
def cleaning_funnel(spark, sf_dir):
    options = C.CleaningOptions(min_comment_length=MIN_LENGTH)
    return C.cleaning_funnel(adapter.raw_comments(spark, sf_dir), options)


@query
def removed_rows(spark, sf_dir):
    return C.removed_rows(C.cleaning_funnel(adapter.raw_comments(spark, sf_dir)))


@query
def dedupe_keep_first(spark, sf_dir):
    rows = C.dedupe_comments(adapter.conflicting_comments(spark, sf_dir), ["ingest_order"])
    return rows.select("comment_id", "comment_body")


@query
def stripped_urls(spark, sf_dir):
    rows = adapter.raw_comments(spark, sf_dir)
    return rows.select(
        "ingest_order", "comment_length", strip_urls(F.col("comment_body")).alias("stripped")
    )


# --- profile -------------------------------------------------------------------


@query
def dataset_summary(spark, sf_dir):
    return A.dataset_summary(adapter.raw_comments(spark, sf_dir))


on_clean(A.monthly_volume, "monthly_volume")
on_clean(A.weekday_volume, "weekday_volume")
on_clean(A.length_bins, "length_bins")
on_clean(A.score_bins, "score_bins")
on_clean(A.length_histogram, "length_histogram")
on_clean(A.top_authors, "top_authors")
on_clean(A.post_stats, "post_stats")
on_clean(A.top_posts, "top_posts")

# --- text ----------------------------------------------------------------------

on_clean(T.word_frequencies, "word_frequencies")
on_clean(T.cloud_terms, "cloud_terms")
on_clean(T.bigram_frequencies, "bigram_frequencies")
on_clean(T.emoji_frequencies, "emoji_frequencies")
on_clean(lambda df: T.comments_containing_term(df, TERM), "comments_containing_term")
on_clean(T.keyword_frequencies, "keyword_frequencies")
on_clean(
    lambda df: T.keyword_frequencies(df, [(label, java) for label, java, _ in PATTERNS]),
    "keyword_frequencies_custom",
)
on_clean(lambda df: T.keyword_frequencies(df, MANY_PATTERNS), "keyword_frequencies_many")
on_clean(T.lexicon_word_counts, "lexicon_word_counts")
on_clean(T.lexicon_summary, "lexicon_summary")


@query
def term_index_search(spark, sf_dir):
    """Several terms looked up in one index of the comments."""
    index = TermIndex(spark, shared_folder(spark, "terms"))
    index.build(cleaned(spark, sf_dir))
    found = [index.search(t).select(F.lit(t).alias("term"), "*") for t in SEARCHED]
    return reduce(DataFrame.unionByName, found)


# --- predictions ---------------------------------------------------------------

on_predictions(P.emotion_frequency, "emotion_frequency")
on_predictions(P.headline_emotions, "headline_emotions")
on_predictions(P.emotion_frequency_all, "emotion_frequency_all")
on_predictions(P.emotions_with_group, "emotions_with_group")
on_predictions(P.group_hits, "group_hits")
on_predictions(P.monthly_emotion_trend, "monthly_emotion_trend")
on_predictions(
    lambda df: P.monthly_emotion_share(df, ["joy", "anger", "pride"]), "monthly_emotion_share"
)
on_predictions(P.emotion_cooccurrence, "emotion_cooccurrence")
on_predictions(P.emotion_cooccurrence_matrix, "emotion_cooccurrence_matrix")
on_predictions(
    lambda df: P.matrix_wide(P.emotion_cooccurrence_matrix(df, len(L.EMOTIONS) + 1), WIDE),
    "cooccurrence_wide",
)
on_predictions(P.labels_per_comment, "labels_per_comment")
on_predictions(
    lambda df: P.with_percent(P.sentiment_distribution(df), 1), "sentiment_distribution"
)
on_predictions(P.monthly_sentiment_share, "monthly_sentiment")
on_predictions(P.monthly_sentiment_table, "monthly_sentiment_table")
on_predictions(P.sentiment_by_score_bucket, "sentiment_by_score_bucket")
on_predictions(P.avg_score_by_sentiment, "avg_score_by_sentiment")
on_predictions(P.score_spread_by_sentiment, "score_spread_by_sentiment")


@query
def score_quartiles(spark, sf_dir):
    """Exact quartiles of a score that is nearly never the same twice."""
    per_length = F.col("comment_score") / (F.col("comment_length") + 0.5)
    comments = C.clean_measured(adapter.raw_comments(spark, sf_dir, C.measure_bodies))
    rows = adapter.predictions(comments).withColumn("score_per_length", per_length)
    found = exact_quantiles(rows, ["predicted_sentiment"], "score_per_length", QUARTILES)
    quartiles = [F.round(F.get("q", F.lit(i)), 9).alias(f"q{i + 1}") for i in range(3)]
    return found.select("predicted_sentiment", "n", *quartiles)


@query
def avg_post_score_by_sentiment(spark, sf_dir):
    comments = cleaned(spark, sf_dir)
    scored = adapter.predictions(comments).drop("post_score")
    posts = adapter.raw_comments(spark, sf_dir).select("post_id", "post_score", "ingest_order")
    return P.avg_post_score_by_sentiment(scored, posts)


@query
def attached_post_scores(spark, sf_dir):
    scored = predicted(spark, sf_dir).drop("post_score")
    posts = adapter.raw_comments(spark, sf_dir).select("post_id", "post_score", "ingest_order")
    return G.attach_post_scores(scored, posts).select("comment_id", "post_id", "post_score")


@query
def filter_predictions(spark, sf_dir):
    rows = P.filter_predictions(predicted(spark, sf_dir), "positive", "joy")
    return P.preview(rows, P.PREDICTION_PREVIEW)


@query
def preview_comments(spark, sf_dir):
    return P.preview(cleaned(spark, sf_dir))


@query
def sentiment_from_emotions(spark, sf_dir):
    return predicted(spark, sf_dir).select(
        "comment_id", "predicted_emotions", "predicted_sentiment"
    )


# --- labels --------------------------------------------------------------------


@query
def index_labels_to_names(spark, sf_dir):
    documents = adapter.table(spark, sf_dir, "documents")
    indices = F.transform(
        F.array("doc_id", F.col("doc_id") * 11 + 3), lambda i: (i % 28).cast("int")
    )
    rows = documents.select(F.col("doc_id").alias("id"), "text", indices.alias("labels"))
    return prepare_examples(rows).select("id", "text", L.encode(F.col("labels")).alias("labels"))


@query
def label_indices(spark, sf_dir):
    rows = predicted(spark, sf_dir)
    indices = F.transform(L.indices_of(F.col("emotions")), lambda i: i.cast("string"))
    return rows.select("comment_id", F.array_join(indices, "|").alias("indices"))


def _examples(spark, sf_dir) -> DataFrame:
    """Documents as benchmark examples with label indices."""
    documents = adapter.table(spark, sf_dir, "documents")
    truth, _ = adapter.truth_and_prediction(documents)
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    indices = F.transform(L.indices_of(F.col("truth")), lambda i: i.cast("int"))
    return texts.join(truth, "id").select("id", "text", indices.alias("labels"))


def _write_splits(spark, sf_dir) -> tuple[str, str]:
    """Train and test examples as JSON lines; every third is a test example."""
    root = shared_folder(spark, "examples")
    paths = f"{root}/train.jsonl", f"{root}/test.jsonl"
    rows, is_test = _examples(spark, sf_dir), F.col("id") % 3 == 0
    for path, part in zip(paths, (rows.where(~is_test), rows.where(is_test)), strict=True):
        part.write.json(path)
    return paths


@query
def example_splits(spark, sf_dir):
    train, test = load_splits(spark, *_write_splits(spark, sf_dir), max_test_samples=TEST_SAMPLES)
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    return both.select("split", "id", "text", L.encode(F.col("labels")).alias("labels"))


@query
def threshold_decode(spark, sf_dir):
    # All values count: score i is the sum of the values at i, i + 28, i + 56.
    value = F.transform("embedding", lambda x: x.cast("double"))

    def at(i):
        return F.coalesce(F.get(value, i), F.lit(0.0))

    scores = F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: at(i) + at(i + 28) + at(i + 56))
    labels = L.above_threshold(scores, threshold=SCORE_THRESHOLD)
    return adapter.table(spark, sf_dir, "embeddings").select(
        "vec_id", L.encode(labels).alias("labels")
    )


@query
def parse_model_replies(spark, sf_dir):
    rows = adapter.replies(cleaned(spark, sf_dir))
    return rows.select(
        "comment_id", L.encode(L.parse_reply(F.col("raw_response"))).alias("labels")
    )


@query
def prompt_and_digest(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select(
        "doc_id", L.digest(F.col("text")).alias("text_sha256"), L.prompt(F.col("text")).alias("prompt")
    )


# --- evaluation ----------------------------------------------------------------


def _evaluated(spark, sf_dir):
    return E.align(*adapter.truth_and_prediction(cleaned(spark, sf_dir)))


@query
def per_label_metrics(spark, sf_dir):
    return E.emotion_labels(_evaluated(spark, sf_dir))


@query
def weakest_sentiment_labels(spark, sf_dir):
    return E.weakest_labels(E.sentiment_labels(_evaluated(spark, sf_dir)))


@query
def evaluate_emotions(spark, sf_dir):
    # Rounded because a sum of fractions depends on its order in other engines.
    row = E.evaluate_emotions(_evaluated(spark, sf_dir))
    return P.rounded(row, 9, ("macro_f1", "mean_jaccard"))


@query
def evaluate_sentiment(spark, sf_dir):
    row = E.evaluate_sentiment(_evaluated(spark, sf_dir))
    return P.rounded(row, 9, ("macro_f1",)).select("task", "macro_f1", "micro_f1", "accuracy")


@query
def benchmark_summary(spark, sf_dir):
    table = E.benchmark_summary(adapter.evaluation_rows(cleaned(spark, sf_dir)))
    return table.drop("runtime_sec")


# --- samples and assembly ------------------------------------------------------


@query
def weekly_quota_sample(spark, sf_dir):
    posts = adapter.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"),
        F.col("ts").alias("post_created_at"),
        F.col("event_type").alias("post_hint"),
    )
    rows = G.weekly_sample(posts, *PERIOD, target=WEEKLY_TARGET, hints=EVENT_HINTS)
    return rows.select("week", "post_id", "post_hint")


@query
def cap_comments_per_post(spark, sf_dir):
    turns = adapter.table(spark, sf_dir, "conversations")
    comments = turns.select(
        F.col("conv_id").alias("post_id"),
        F.col("turn").alias("comment_id"),
        F.length("text").alias("comment_score"),
        F.col("text").alias("comment_body"),
    )
    posts = turns.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("post_id"), F.col("role").alias("post_title")
    )
    return G.assemble(posts, comments, limit=3, period="2024", subreddit="talk")


@query
def seeded_sample(spark, sf_dir):
    rows = cleaned(spark, sf_dir).withColumn("comment_id", F.nullif("comment_id", F.lit(NO_ID)))
    return G.seeded_sample(rows, "comment_id", SAMPLE).select(
        "comment_id", "comment_body"
    )


@query
def scatter_points(spark, sf_dir):
    rows = predicted(spark, sf_dir).withColumn(
        "comment_id", F.nullif("comment_id", F.lit(NO_ID))
    )
    rows = G.scatter_points(rows, max_points=SAMPLE)
    return rows.select("comment_id", "post_score", "predicted_sentiment")


@query
def first_comments(spark, sf_dir):
    return G.first_rows(cleaned(spark, sf_dir), SAMPLE, "comment_id").select("comment_id")


# --- models --------------------------------------------------------------------


@query
def score_comments(spark, sf_dir):
    rows = S.score_comments(cleaned(spark, sf_dir), toys.letter_scores)
    return rows.drop("comment_body")


@query
def resumed_scoring(spark, sf_dir):
    """A run that ends early, and one that goes on from its ledger; no text is scored twice."""
    path = shared_folder(spark, "ledger")
    # Both runs read the comments several times; they are cleaned once.
    comments = _stored(cleaned(spark, sf_dir), "cleaned")
    scores, key = toys.letter_scores, "roberta_samlowe"
    fill_ledger(comments, "comment_body", scores, key, path, steps=STEPS, most_steps=STEPS // 2)

    def from_ledger(rows):
        return score_with_ledger(rows, scores, key, path, "comment_id", steps=STEPS)

    scored = S.score_comments(comments, scores, key, scorer=from_ledger)
    stored = spark.read.parquet(path)
    texts = stored.agg(F.count(F.lit(1))).scalar()
    distinct = stored.agg(F.count_distinct("text_sha256")).scalar()
    counts = scored.groupBy("predicted_sentiment", "model_label").agg(
        F.count(F.lit(1)).alias("comments"),
        F.count_if(F.col("predicted_emotions") == "").alias("without_label"),
    )
    return counts.select(
        "*", texts.alias("texts_scored"), (texts - distinct).alias("scored_twice")
    )


def _cache(texts: DataFrame) -> DataFrame:
    """Stored answers for about half of the texts, derived from their digests."""
    sha = F.col("text_sha256")
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(sha, 2, 1))
    return texts.where(F.substring(sha, 1, 1) < "8").select(
        F.lit("toy").alias("model_key"),
        "text_sha256",
        F.array(F.element_at(L.string_array(L.EMOTIONS), digit)).alias("emotions"),
    )


def _answers(spark, sf_dir) -> DataFrame:
    texts = S.distinct_texts(adapter.table(spark, sf_dir, "documents"), "text")
    hits, misses = S.split_by_cache(texts, _cache(texts), "toy")
    asked = S.ask(misses, toys.parity_replies)
    return hits.withColumn("cached", F.lit(True)).unionByName(
        asked.withColumn("cached", F.lit(False))
    )


@query
def cached_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "text_sha256", "copies", "cached", L.encode(F.col("emotions")).alias("labels")
    )


@query
def cached_scoring(spark, sf_dir):
    documents = adapter.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = S.attach_answers(documents, "text", _answers(spark, sf_dir), spread_by="doc_id")
    return rows.select("doc_id", L.encode(F.col("emotions")).alias("labels"))


def _labelled_documents(spark, sf_dir) -> DataFrame:
    """Documents with quality/toxic labels; a hash of the id decides train or test."""
    marks = adapter.table(spark, sf_dir, "labels")
    names = F.array_compact(
        F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    )
    return (
        adapter.table(spark, sf_dir, "documents")
        .repartition("doc_id")
        .join(marks, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            names.alias("labels"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"),
        )
    )


@query
def tfidf_logreg(spark, sf_dir):
    rows = _labelled_documents(spark, sf_dir)
    train, test = rows.where(~F.col("held_out")), rows.where("held_out")
    vocabulary = ("quality", "toxic")
    model = fit_multilabel(train, vocabulary)
    judged = model.predict(test).withColumnRenamed("labels", "truth")
    return E.emotion_labels(judged.select("id", "truth", "predicted"), vocabulary)


def _train_rows(spark, sf_dir) -> DataFrame:
    documents = adapter.table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = adapter.table(spark, sf_dir, "labels")
    names = F.array_compact(
        F.array(
            F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "toxic"),
            F.lit("every"),
        )
    )
    return documents.join(marks, "doc_id").select("text", names.alias("labels"))


@query
def tfidf_weights(spark, sf_dir):
    rows = M.tfidf_weights(adapter.table(spark, sf_dir, "documents"))
    return rows.withColumn("idf", F.round("idf", 9))


@query
def frequent_terms(spark, sf_dir):
    """The same terms, from hashed counters and an exact count of what they leave."""
    rows = V.frequent_terms(adapter.table(spark, sf_dir, "documents"))
    return rows.withColumn("idf", F.round("idf", 9))


@query
def logreg_optimality(spark, sf_dir):
    rows = _train_rows(spark, sf_dir)
    model = fit_multilabel(rows, ("quality", "toxic", "every", "none"))
    judged = optimality(model, rows)
    return judged.withColumn("optimal", F.col("gradient") < 1e-3).drop("gradient")


@query
def benchmark_job(spark, sf_dir):
    """Both toy models through the whole benchmark job; the written summary, read back."""

    def answers(shift_every):
        def run(train, test):
            labelled = test.select("id", F.col("id").alias("doc_id"))
            return labelled.select("id", adapter.guesses(shift_every).alias("predicted"))

        return run

    runners = {"roberta_samlowe": answers(None), "bert_monologg": answers(5)}
    root = shared_folder(spark, "benchmark")
    summary = benchmark(spark, runners, *_write_splits(spark, sf_dir), root, run_id="run")
    written = spark.read.csv(f"{root}/run/benchmark_summary", header=True, schema=summary.schema)
    return written.drop("runtime_sec")


@query
def stored_cache(spark, sf_dir):
    """The second run finds all answers of the first; nothing is stored twice."""
    path = shared_folder(spark, "cache")
    documents = adapter.table(spark, sf_dir, "documents").select("doc_id", "text")
    S.score_with_cache(documents, "text", "toy", toys.parity_replies, path, "doc_id")
    labelled = S.score_with_cache(documents, "text", "toy", toys.parity_replies, path, "doc_id")
    stored = spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
    return labelled.select(
        "doc_id", L.encode(F.col("emotions")).alias("labels"), stored.alias("answers_stored")
    )


@query
def compacted_cache(spark, sf_dir):
    """Three runs over a bucketed cache, compacted between them; the last asks nothing."""
    cache = ReplyCache(spark, shared_folder(spark, "replies"))
    documents = adapter.table(spark, sf_dir, "documents").select("doc_id", "text")
    half = documents.where(F.pmod("doc_id", F.lit(2)) == 0)
    for rows in (half, documents):
        score_with_reply_cache(rows, "text", "toy", toys.parity_replies, cache, "doc_id")
        cache.compact()
    labelled = score_with_reply_cache(
        documents, "text", "toy", toys.parity_replies, cache, "doc_id"
    )
    stored = cache.rows().agg(F.count(F.lit(1))).scalar()
    return labelled.select(
        "doc_id", L.encode(F.col("emotions")).alias("labels"), stored.alias("answers_stored")
    )


# --- sources and sinks ---------------------------------------------------------


@query
def csv_round_trip(spark, sf_dir):
    path = shared_folder(spark, "comments")
    rows = adapter.raw_comments(spark, sf_dir)
    for kind in ("post", "comment"):
        rows = rows.withColumn(f"{kind}_created_utc", epoch_seconds(F.col(f"{kind}_created_at")))
    derived = ("comment_length", "comment_word_count", "doc_id", "ingest_order")
    times = ("post_created_at", "comment_created_at")
    export_csv(rows.drop(*derived, *times), path)
    loaded = read_comments_csv(spark, path)
    return loaded.drop("ingest_order", "post_created_utc", "comment_created_utc")


@query
def predictions_round_trip(spark, sf_dir):
    path = shared_folder(spark, "predictions")
    scored = S.score_comments(cleaned(spark, sf_dir), toys.letter_scores)
    export_csv(scored, path)
    return P.emotion_frequency(read_predictions_csv(spark, path))


@query
def run_registry(spark, sf_dir):
    root = shared_folder(spark, "experiments")
    comments = cleaned(spark, sf_dir)
    for key, threshold in (("roberta_samlowe", 0.5), ("bert_monologg", 0.7)):
        scored = S.score_comments(comments, toys.letter_scores, key, threshold=threshold)
        label = S.model_label(key)
        write_run(scored, root, f"run_{key}", "comments", key, label, threshold=threshold)
    counted = (
        read_run(spark, root, "run_bert_monologg")
        .unionByName(read_run(spark, root, "run_roberta_samlowe"))
        .groupBy("experiment")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("predicted_sentiment").alias("last_sentiment"))
    )
    runs = list_runs(spark, root).select(
        "experiment", "model_key", "model_label", "comments_scored", "threshold"
    )
    return runs.join(counted, "experiment")
