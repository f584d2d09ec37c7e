"""Cleaning, profile and term operators on hand-written rows."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palaver import fixed
from palaver.operators import cleaning as C
from palaver.operators import profile as A
from palaver.operators import terms as T
from palaver.operators import vocabulary
from palaver.sources.comments import prepare_comments

EPOCH_2025 = 1735689600
SCHEMA = (
    "ingest_order bigint, comment_id string, post_id string, post_title string, "
    "post_score bigint, comment_author string, comment_score bigint, comment_body string, "
    "post_created_utc bigint, comment_created_utc bigint"
)
# comment_id, author, body, seconds after 2025-01-01 UTC
ROWS = [
    ("a", "ann", "Love this great idea", 0),
    ("a", "ann", "[deleted]", 1),  # later copy loses
    ("b", "ann", " [DELETED]\n", 2),
    ("b", "ann", "a later copy of a deleted first", 3),  # first copy counts
    ("c", "ann", "[deleted] by user", 4),
    ("d", None, "no author", 5),
    ("e", "automoderator", "I am a bot", 6),
    ("f", "AUTOMODERATOR", "not a known spelling", 7),
    ("g", "AutoModerator", "I am a bot", 8),
    (None, "bob", "first without id", 9),
    (None, "bob", "second without id", 10),
    ("h", "bob", None, 11),
    ("i", "bob", "\xa0\t\x1c", 12),
    ("j", "bob", " https://example.com/only ", 13),
    ("k", "bob", "see [label](http://x.y) now", -1),
    ("l", "cat", "None", 14),
]
STEPS = [16, 12, 10, 9, 9, 6, 5, 5]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (n, c, f"p{n % 3}", f"title {n % 3}", 10 * (n % 3), a, n - 3, b, EPOCH_2025, EPOCH_2025 + s)
        for n, (c, a, b, s) in enumerate(ROWS)
    ]
    return prepare_comments(spark.createDataFrame(rows, SCHEMA)).persist()


OPTIONS = C.CleaningOptions(min_comment_length=5)


def bodies(df):
    return sorted(row["comment_body"] for row in df.select("comment_body").collect())


def test_load(raw):
    rows = {r["ingest_order"]: r for r in raw.collect()}
    assert rows[11]["comment_body"] == "" and rows[11]["comment_word_count"] == 0
    assert rows[0]["comment_created_at"] == datetime(2025, 1, 1)
    assert rows[14]["comment_created_at"] == datetime(2024, 12, 31, 23, 59, 59)
    assert rows[0]["comment_length"] == 20 and rows[0]["comment_word_count"] == 4


def test_clean(raw):
    cleaned = C.clean(raw)
    assert bodies(cleaned) == sorted(
        [
            "Love this great idea",
            "[deleted] by user",
            "no author",
            "not a known spelling",
            "first without id",
            "see label now",
            "None",
        ][:7]
    )
    row = cleaned.where("comment_id = 'k'").first()
    assert (row["comment_length"], row["comment_word_count"]) == (13, 3)


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"min_comment_length": 10},
        {"remove_deleted": False, "remove_empty": False},
        {"strip_urls": False},
        {"dedupe_comments": False, "remove_automoderator": False},
    ],
)
def test_measured_rows_are_the_clean_ones(raw, options):
    options = C.CleaningOptions(**options)
    expected = C.clean(raw, options).drop("comment_body")
    found = C.clean_measured(C.measure_bodies(raw, options), options).select(*expected.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert found.count() > 2


def test_clean_is_idempotent(raw):
    cleaned = C.clean(raw)
    assert bodies(C.clean(cleaned)) == bodies(cleaned)


def test_funnel_matches_step_by_step_counts(raw):
    options = C.CleaningOptions(min_comment_length=5)
    funnel = [tuple(r) for r in C.cleaning_funnel(raw, options).orderBy("step_no").collect()]
    deduped = C.dedupe_comments(raw)
    human = C.remove_bots(deduped)
    shown = C.remove_deleted(human)
    stripped = C.strip_body_urls(shown)
    filled = C.remove_empty(stripped)
    long = C.remove_short(filled, 5)
    counts = [d.count() for d in (raw, deduped, human, shown, stripped, filled, long, long)]
    assert [rows for _, _, rows in funnel] == counts
    assert [step for _, step, _ in funnel] == [
        fixed.FUNNEL_RAW,
        fixed.FUNNEL_DEDUPE,
        fixed.FUNNEL_BOTS,
        fixed.FUNNEL_DELETED,
        fixed.FUNNEL_URLS,
        fixed.FUNNEL_EMPTY,
        "After min length (5)",
        fixed.FUNNEL_FINAL,
    ]
    assert counts == sorted(counts, reverse=True)


def test_funnel_lists_only_enabled_steps(raw):
    options = C.CleaningOptions(
        remove_automoderator=False, strip_urls=False, dedupe_comments=False, remove_empty=False
    )
    rows = C.cleaning_funnel(raw, options).orderBy("step_no").collect()
    assert [(r["step"], r["rows"]) for r in rows] == [
        (fixed.FUNNEL_RAW, 16),
        (fixed.FUNNEL_DELETED, C.remove_deleted(raw).count()),
        (fixed.FUNNEL_FINAL, C.remove_deleted(raw).count()),
    ]
    assert C.clean(raw, options).count() == rows[-1]["rows"]


def test_removed_rows(raw):
    row = C.removed_rows(C.cleaning_funnel(raw)).first()
    assert row["removed"] == row["raw_rows"] - row["clean_rows"]
    assert row["removed_pct"] == pytest.approx(row["removed"] / 16 * 100)
    nothing = C.removed_rows(C.cleaning_funnel(raw.limit(0))).first()
    assert (nothing["removed"], nothing["removed_pct"]) == (0, 0.0)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(raw, partitions):
    spread = raw.repartition(partitions)
    assert bodies(C.clean(spread)) == bodies(C.clean(raw))
    for operator in (A.top_authors, T.word_frequencies, T.bigram_frequencies, A.dataset_summary):
        assert operator(spread).collect() == operator(raw).collect()


def test_summary(raw):
    row = A.dataset_summary(raw).first()
    assert row["comments"] == 16 and row["posts"] == 3 and row["authors"] == 6
    assert row["comment_start"] == datetime(2024, 12, 31, 23, 59, 59)
    lengths = sorted(r["comment_length"] for r in raw.collect())
    assert row["median_comment_length"] == (lengths[7] + lengths[8]) / 2
    assert row["mean_comment_length"] == pytest.approx(sum(lengths) / 16)
    assert row["median_comments_per_post"] == 5.0
    assert row["mean_post_score"] == pytest.approx(150 / 16)
    assert row["automod_share"] == pytest.approx(1 / 16)
    nothing = A.dataset_summary(raw.limit(0)).first()
    assert nothing["comments"] == 0 and nothing["median_words"] == 0.0
    assert nothing["automod_share"] == 0.0 and nothing["post_start"] is None


def test_summary_without_optional_columns(raw):
    row = A.dataset_summary(raw.select("comment_length", "comment_word_count")).first()
    assert row["comments"] == 16 and row["posts"] == 0 and row["mean_post_score"] == 0.0


def test_months_under_another_session_zone(spark, raw):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        months = {r["month"]: r["comments"] for r in A.monthly_volume(raw).collect()}
        days = [r["weekday"] for r in A.weekday_volume(raw).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # The two rows without an id do not count as comments.
    assert months == {"2024-12": 1, "2025-01": 13}
    assert days == ["Tuesday", "Wednesday"]


def test_bins(spark):
    lengths = [0, 20, 21, 50, 10000, 10001]
    df = spark.createDataFrame([(n,) for n in lengths], "comment_length int")
    assert [r["count"] for r in A.length_bins(df).collect()] == [2, 2, 0, 0, 0, 0, 1]
    scores = [-100, -99, -1, 0, 1, 5, 6, 20, 21, 1000, 1001, None]
    df = spark.createDataFrame([(n,) for n in scores], "comment_score bigint")
    got = {r["bin"]: r["count"] for r in A.score_bins(df).collect()}
    assert got == {"<-1": 2, "-1 to 0": 1, "1": 1, "2-5": 1, "6-20": 2, "20+": 2}


def test_histogram(spark):
    import numpy as np

    for values in ([3, 3, 7, 11, 90, 400, 403], [5, 5, 5], [1, 2]):
        df = spark.createDataFrame([(v,) for v in values], "comment_length int")
        rows = A.length_histogram(df).orderBy("bin").collect()
        counts, edges = np.histogram(values, bins=40)
        assert [r["count"] for r in rows] == counts.tolist()
        assert [r["bin_start"] for r in rows] == pytest.approx(edges[:-1].tolist())
        assert rows[-1]["bin_end"] == pytest.approx(edges[-1])
    assert A.length_histogram(df.limit(0)).count() == 0


def test_authors_and_posts(raw):
    top = A.top_authors(raw, 2).collect()
    assert [(r["comment_author"], r["comments"]) for r in top] == [("ann", 5), ("bob", 4)]
    assert A.post_stats(raw).count() == 3
    best = A.top_posts(raw, 1).first()
    assert (best["post_id"], best["comments"], best["post_score"]) == ("p0", 5, 0)


def bodies_df(spark, *texts):
    rows = [(str(i), t, "t", 1, "a") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "comment_id string, comment_body string, post_title string, comment_score int, "
        "comment_author string",
    )


def test_word_share_is_of_all_terms(spark):
    df = bodies_df(spark, "red red blue", "green", "the and")
    rows = T.word_frequencies(df, 1).collect()
    assert [tuple(r) for r in rows] == [("red", 2, 0.5)]
    assert T.word_frequencies(df.limit(0)).collect() == []


def test_bigrams_stay_within_comments(spark):
    df = bodies_df(spark, "red and blue", "red", "blue red blue", "")
    got = {r["bigram"]: r["count"] for r in T.bigram_frequencies(df).collect()}
    assert got == {"red blue": 2, "blue red": 1}


def test_rare_bigrams_are_not_all_counted(spark, monkeypatch):
    """Only pairs that may be among the first reach the exact count."""
    counted = []
    plain = vocabulary.top

    def watched(df, *args):
        if "df" in df.columns:
            counted.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(vocabulary, "top", watched)
    bodies = ["often said " * 3] * 500 + [f"rare{i} common" for i in range(20_000)]
    got = {r["bigram"]: r["count"] for r in T.bigram_frequencies(bodies_df(spark, *bodies), 2).collect()}
    assert got == {"often said": 1_500, "said often": 1_000}
    assert 0 < counted[-1] < 200


def test_term_search_returns_total(spark):
    df = bodies_df(spark, "prompt one", "a Prompt", "prompts", "prompt again")
    rows = T.comments_containing_term(df, "prompt", limit=2).collect()
    assert [r["comment_body"] for r in rows] == ["prompt one", "a Prompt"]
    assert {r["total_matches"] for r in rows} == {3}
    assert T.comments_containing_term(df, "").collect() == []


def test_keywords(spark):
    df = bodies_df(spark, "fake fake real", "Real dall-e", "nothing", "x")
    got = {r["keyword"]: tuple(r)[1:] for r in T.keyword_frequencies(df).collect()}
    assert got["fake"] == (1, 2, 25.0) and got["real"] == (2, 2, 50.0)
    assert got["dall-e"] == (1, 1, 25.0) and got["sora"] == (0, 0, 0.0)
    own = T.keyword_frequencies(df, [("any", r"no\w+")]).first()
    assert (own["keyword"], own["total_mentions"]) == ("any", 1)
    assert T.keyword_frequencies(df.limit(0)).collect() == []


def test_lexicon(spark):
    df = bodies_df(spark, "loveé love love's FAKE", "hate", "thank you, thanks", "plain")
    got = Counter({r["word"]: r["count"] for r in T.lexicon_word_counts(df).collect()})
    assert got == {"love": 2, "fake": 1, "hate": 1, "thank": 1, "thanks": 1}
    row = T.lexicon_summary(df).first()
    assert tuple(row) == (4, 2, 2, 2, 50.0, 50.0)
    assert tuple(T.lexicon_summary(df.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0.0)


def test_hot_key_is_cut_before_the_shuffle(raw):
    plan = C.dedupe_comments(raw)._jdf.queryExecution().explainString(
        raw.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


def test_columns_are_evaluated_once(raw):
    plan = C.clean(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(comment_body") <= 1


def test_hot_comment_id(spark):
    hot = spark.range(30_000).select(
        F.col("id").alias("ingest_order"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("comment_id"),
        F.concat(F.lit("body "), "id").alias("comment_body"),
    )
    kept = C.dedupe_comments(hot.repartition(16))
    assert kept.count() == 20_001
    assert kept.where("comment_id = 'hot'").first()["comment_body"] == "body 0"
