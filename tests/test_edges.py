"""Rows at the edges: missing ids, repeats, conflicts, empty runs, odd numbers and patterns."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators import cleaning as C
from palaver.operators import evaluation as E
from palaver.operators import predictions as P
from palaver.operators import profile as A
from palaver.operators import sampling as G
from palaver.operators import scoring as S
from palaver.operators import training as M
from palaver.plans.toys import letter_scores
from palaver.session import shared_folder
from palaver.sources import sinks
from palaver.sources.comments import read_comments_csv

COMMENTS = "comment_id string, post_id string, comment_body string, comment_score bigint"


def test_alignment_refuses_repeats_and_missing_keys(spark):
    kind = "id int, {} array<string>"
    truth = spark.createDataFrame([(1, []), (2, [])], kind.format("truth"))
    for ids, bad in (((1, 2, 2), 2), ((1,), 2), ((1, 2, 3), 3), ((1, 2, None), "null")):
        guess = spark.createDataFrame([(i, []) for i in ids], kind.format("predicted"))
        with pytest.raises(Exception, match=f"one to one at {bad}"):
            E.align(truth, guess).collect()
    with pytest.raises(Exception, match="one to one at 1"):
        E.align(truth.union(truth), guess.where("id < 3")).collect()


def test_an_incomplete_model_run_raises(spark, tmp_path):
    schema = "id int, text string, labels array<string>"
    test = spark.createDataFrame([(i, "t", ["joy"]) for i in range(3)], schema)

    def one_of_three(train, test):
        return test.where("id = 0").select("id", F.col("labels").alias("predicted"))

    def none(train, test):
        return one_of_three(train, test).where("false")

    for runner in (one_of_three, none):
        runners = {"roberta_samlowe": runner}
        _, summary = M.run_models(runners, test, test, str(tmp_path / runner.__name__))
        with pytest.raises(Exception, match="one to one at roberta_samlowe"):
            summary.collect()


@pytest.mark.parametrize("heap", [100_000, 1])
def test_samples_keep_rows_without_an_id(spark, monkeypatch, heap):
    monkeypatch.setattr(G, "HEAP_ROWS", heap)
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), (None, 4)], "id string, x int")
    assert sorted(r["x"] for r in G.seeded_sample(df, "id", 10).collect()) == [1, 2, 3, 4]
    assert G.seeded_sample(df, "id", 3).count() == 3
    many = spark.range(3_000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit(1).alias("x"))
    drawn = {r["id"] for r in G.seeded_sample(many.repartition(5), "id", 700).collect()}
    ranked = many.orderBy(F.md5(F.concat("id", F.lit("42"))), "id").limit(700).collect()
    assert drawn == {r["id"] for r in ranked}


def test_one_rule_for_a_posts_score(spark):
    rows = [("c1", "p", 5, 1), ("c2", "p", 9, 2), ("c3", "p", 3, 3), ("c4", "q", None, 4), ("c5", "q", 7, 5)]
    df = spark.createDataFrame(
        rows, "comment_id string, post_id string, post_score bigint, ingest_order bigint"
    ).withColumn("post_title", F.lit("t"))
    assert {r["post_id"]: r["post_score"] for r in A.post_stats(df).collect()} == {"p": 5, "q": 7}
    assert {r["post_id"]: r["post_score"] for r in A.top_posts(df).collect()} == {"p": 5, "q": 7}
    scored = G.attach_post_scores(df.drop("post_score"), df)
    assert {(r["post_id"], r["post_score"]) for r in scored.collect()} == {("p", 5), ("q", None)}


def test_average_post_scores_by_either_way(spark):
    rows = [(f"c{i}", f"p{i % 5}" if i % 7 else None, 10 * (i % 5), i) for i in range(60)]
    df = spark.createDataFrame(
        rows, "comment_id string, post_id string, post_score bigint, ingest_order bigint"
    )
    guesses = df.drop("post_score").withColumn(
        "predicted_sentiment", F.when(F.col("ingest_order") % 2 == 0, "negative").otherwise("positive")
    )
    attached = P.avg_post_score_by_sentiment(G.attach_post_scores(guesses, df)).collect()
    assert P.avg_post_score_by_sentiment(guesses, df).collect() == attached


def test_runs_without_rows_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.list_runs(spark, root).count() == 0
    with pytest.raises(ValueError, match="no run of"):
        sinks.read_run(spark, root, "x")
    comments = spark.createDataFrame([("c", "p", "aaaa", 1)], COMMENTS)
    comments = comments.withColumn("comment_author", F.lit("a")).withColumn(
        "comment_created_at", F.lit(None).cast("timestamp_ntz")
    )
    scored = S.score_comments(comments, letter_scores)

    def write(rows):
        return sinks.write_run(rows, root, "x", "d", "roberta_samlowe", "R")

    assert write(scored.where("false")) == 0 and sinks.list_runs(spark, root).count() == 0
    assert write(scored.union(scored)) == 2 and write(scored.where("false")) == 0
    assert sinks.read_run(spark, root, "x").count() == 2
    assert sinks.list_runs(spark, root).first()["comments_scored"] == 2
    assert write(scored) == 1 and sinks.read_run(spark, root, "x").count() == 1


def test_funnel_and_pipeline_agree_on_missing_bodies(spark):
    df = spark.createDataFrame([("a", "p", None, 1), ("b", "p", "text", 1)], COMMENTS)
    df = df.withColumn("comment_author", F.lit("x"))
    for options in (C.CleaningOptions(), C.CleaningOptions(remove_empty=False, min_comment_length=2)):
        steps = C.cleaning_funnel(df, options).orderBy("step_no").collect()
        assert steps[-1]["rows"] == C.clean(df, options).count() == 1


def test_whole_numbers_keep_every_digit(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("comment_id,comment_body,comment_score\na,x,9007199254740993\nb,y,5.0\nc,z,\n")
    rows = read_comments_csv(spark, str(path)).collect()
    assert {r["comment_id"]: r["comment_score"] for r in rows} == {
        "a": 9007199254740993, "b": 5, "c": None,
    }
    path.write_text("comment_id,comment_body,comment_score\na,x,7.9\n")
    with pytest.raises(Exception, match="comment_score is not a whole number"):
        read_comments_csv(spark, str(path)).collect()


@pytest.mark.parametrize(
    "pattern,text,hits",
    [
        (r"\W", "é x", 2),
        (r"\D", "1a2", 1),
        (r"\S+", "a b\x1cc", 3),
        (r"\b?c", "abc c", 2),
        (r"\bc\b", "abc c", 1),
    ],
)
def test_patterns(one, pattern, text, hits):
    assert one(lambda x: X.pattern_hits(x, X.fold_case(x), pattern), text) == [hits]


def test_weekly_ties_do_not_depend_on_partitions(spark):
    from datetime import datetime

    start, end = datetime(2025, 1, 1), datetime(2025, 1, 15)
    rows = [(f"q{i % 40}", start, ("image", "link", "rich:video")[i % 3]) for i in range(120)]
    posts = spark.createDataFrame(
        rows, "post_id string, post_created_at timestamp_ntz, post_hint string"
    )
    drawn = [
        sorted(map(tuple, G.weekly_sample(posts.repartition(n), start, end, 30, None).collect()))
        for n in (1, 5)
    ]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 15


def test_scratch_folders_are_below_shared_ones(spark):
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", warehouse))


def test_models_run_from_another_working_directory(tmp_path):
    repository = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "from palaver.session import build_session\n"
        "from palaver.operators.scoring import score_texts\n"
        "from palaver.plans.toys import letter_scores\n"
        "spark = build_session('t', 'local[1]', spark__ui__enabled='false')\n"
        "rows = spark.createDataFrame([('aaaa',)], 'comment_body string')\n"
        "print('scores', len(score_texts(rows, letter_scores).first()['probs']))\n"
    )
    env = os.environ | {"PYTHONPATH": repository}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "scores 28" in done.stdout, done.stderr[-2000:]
