"""Batch scoring, the reply cache, training, sinks and sources."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.fixed import EMOTIONS
from palaver.operators import evaluation as E
from palaver.operators import scoring as S
from palaver.operators import training as M
from palaver.plans.toys import letter_scores, parity_replies
from palaver.sources import sinks
from palaver.sources.comments import read_comments_csv, read_comments_parquet
from palaver.sources.examples import load_splits, read_examples
from palaver.sources.predictions import read_predictions_csv, read_predictions_parquet

COMMENTS = (
    "comment_id string, post_id string, comment_body string, comment_score bigint, "
    "comment_author string, comment_created_at timestamp_ntz"
)


def comments_df(spark, *texts):
    rows = [(f"c{i}", "p", t, None if i == 1 else i, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COMMENTS)


def test_score_comments(spark):
    df = comments_df(spark, "aaaa", "zzz", "ccab", "")
    rows = {r["comment_id"]: r for r in S.score_comments(df, letter_scores, batch_size=2).collect()}
    assert rows["c0"]["predicted_emotions"] == EMOTIONS[0]
    assert rows["c1"]["comment_score"] is None and rows["c1"]["post_score"] is None
    assert rows["c2"]["predicted_emotions"] == "admiration|amusement|anger"
    assert rows["c2"]["predicted_sentiment"] == "negative"
    assert rows["c3"]["predicted_emotions"] == "" and rows["c3"]["predicted_sentiment"] == "neutral"
    assert rows["c0"]["model_label"] == S.model_label("roberta_samlowe")


def test_wrong_models_are_rejected(spark):
    df = comments_df(spark, "a")
    with pytest.raises(ValueError, match="unknown model"):
        S.score_comments(df, letter_scores, "nope")
    with pytest.raises(ValueError, match="kind 'classical'"):
        S.score_comments(df, letter_scores, "tfidf_logreg")


def test_a_model_must_answer_every_text(spark):
    df = comments_df(spark, "a", "b").coalesce(1)
    short = S.score_comments(df, lambda: lambda texts: [[0.0] * 28])
    with pytest.raises(Exception, match="one result per text"):
        short.collect()


def counting_replies(folder):
    """Replies that leave one file per question asked."""

    def factory():
        reply = parity_replies()

        def answer(prompts):
            for prompt in prompts:
                name = str(abs(hash(prompt)))
                with open(os.path.join(folder, name), "a") as handle:
                    handle.write("x")
            return reply(prompts)

        return answer

    return factory


def test_cached_scoring_asks_each_text_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    cache = str(tmp_path / "cache")
    factory = counting_replies(str(asked))

    def run(df):
        rows = S.score_with_cache(df, "text", "toy", factory, cache, spread_by="id").collect()
        return {r["id"]: r["emotions"] for r in rows}

    df = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(20)], "id int, text string")
    first = run(df)
    assert len(first) == 20 and {tuple(v) for v in first.values()} <= {("joy",), ("anger",)}
    assert sum(p.stat().st_size for p in asked.iterdir()) == 11
    assert run(df) == first
    more = df.union(spark.createDataFrame([(99, "new")], "id int, text string"))
    assert len(run(more)) == 21
    assert sum(p.stat().st_size for p in asked.iterdir()) == 12
    other = S.score_with_cache(df, "text", "second", factory, cache, spread_by="id")
    assert other.count() == 20


def test_prompts_are_built_once_per_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    rows = S.prompts(df).collect()
    assert len(rows) == 2 and all("Valid labels" in r["prompt"] for r in rows)


# --- training ------------------------------------------------------------------

TEXTS = ["good good film", "bad film", "good day", "a bad bad day", "Good film day", "bad"]
LABELS = [["pos"], ["neg"], ["pos"], ["neg"], ["pos", "neg"], ["neg"]]


def examples_df(spark):
    rows = list(zip(range(6), TEXTS, LABELS))
    return spark.createDataFrame(rows, "id int, text string, labels array<string>")


def tfidf_by_hand():
    grams = []
    for text in TEXTS:
        words = [w for w in text.lower().split() if len(w) > 1]
        grams.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = {g: sum(g in row for row in grams) for g in {g for row in grams for g in row}}
    vocabulary = sorted(g for g in df if df[g] >= 2)
    x = np.array(
        [[row.count(g) * (np.log(7 / (df[g] + 1)) + 1) for g in vocabulary] for row in grams]
    )
    return vocabulary, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_tfidf_weights(spark):
    model = M.fit_tfidf(examples_df(spark))
    vocabulary, expected = tfidf_by_hand()
    names = model.stages[3].vocabulary
    assert sorted(names) == vocabulary
    rows = model.transform(examples_df(spark)).orderBy("id").collect()
    got = np.array([r["features"].toArray() for r in rows])
    order = [names.index(name) for name in vocabulary]
    assert np.allclose(got[:, order], expected)


def logistic_by_hand(x, y, steps=20000, rate=0.3):
    """Minimise sum of losses + |w|^2 / 2 by plain gradient descent."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ error + w) / len(y), b - rate * error.sum() / len(y)
    return w, b


def test_label_models_by_brute_force(spark):
    vocabulary = ("pos", "neg", "never")
    models = M.fit_label_models(examples_df(spark), vocabulary)
    assert models.models["never"] is False
    grams, x = tfidf_by_hand()
    names = models.features.stages[3].vocabulary
    order = [names.index(g) for g in grams]
    predicted = []
    for label in ("pos", "neg"):
        y = np.array([label in row for row in LABELS], dtype=float)
        w, b = logistic_by_hand(x, y)
        fitted = models.models[label]
        assert np.allclose(fitted.coefficients.toArray()[order], w, atol=0.02)
        assert fitted.intercept == pytest.approx(b, abs=0.02)
        predicted.append(x @ w + b > 0)
    rows = models.predict(examples_df(spark)).orderBy("id").collect()
    expected = [[n for n, p in zip(vocabulary, flags) if p] for flags in zip(*predicted)]
    assert [r["predicted"] for r in rows] == expected


def test_run_models(spark, tmp_path):
    df = examples_df(spark).withColumn("labels", F.array(F.lit("joy")))

    def right(train, test):
        return test.select("id", F.col("labels").alias("predicted"))

    def wrong(train, test):
        return test.select("id", F.array(F.lit("fear")).alias("predicted"))

    runners = {"tfidf_logreg": right, "bert_monologg": wrong}
    predictions, summary = M.run_models(runners, df, df, str(tmp_path))
    rows = {r["model"]: r for r in summary.collect()}
    assert predictions.count() == 12
    assert rows["tfidf_logreg"]["emotion_subset_accuracy"] == 1.0
    assert rows["bert_monologg"]["emotion_at_least_one_match"] == 0.0
    assert rows["bert_monologg"]["runtime_sec"] > 0
    with pytest.raises(ValueError, match="unknown models"):
        M.run_models({"nope": right}, df, df, str(tmp_path))


# --- sources and sinks ---------------------------------------------------------


def test_csv_comments(spark, tmp_path):
    path = tmp_path / "comments.csv"
    path.write_text(
        "post_id,comment_id,comment_body,comment_score,comment_created_utc,mood\n"
        'p1,c1,"He said ""hi"",\nthen left\\",5.0,1735689600,calm\n'
        "p1,c2,,,1735689599.0,\n"
        'p2,c1,"  padded  ",-3,,\n'
        "p2,c4,None,1,0,\n",
        encoding="utf-8",
    )
    rows = read_comments_csv(spark, str(path)).orderBy("ingest_order").collect()
    assert [r["comment_body"] for r in rows] == ['He said "hi",\nthen left\\', "", "  padded  ", "None"]
    assert [r["comment_score"] for r in rows] == [5, None, -3, 1]
    assert str(rows[1]["comment_created_at"]) == "2024-12-31 23:59:59"
    assert rows[2]["comment_created_at"] is None and rows[0]["mood"] == "calm"
    nulled = read_comments_csv(spark, str(path), null_tokens=("None",))
    assert nulled.where("comment_id = 'c4'").first()["comment_body"] == ""
    out = str(tmp_path / "parquet")
    spark.read.options(header=True, multiLine=True, escape='"').csv(str(path)).withColumn(
        "comment_created_utc", F.col("comment_created_utc").cast("double")
    ).write.parquet(out)
    assert read_comments_parquet(spark, out).where("comment_id = 'c2'").first()["comment_length"] == 0


def test_predictions_round_trip(spark, tmp_path):
    path = tmp_path / "predictions.csv"
    path.write_text(
        "comment_id,comment_created_at,predicted_emotions,predicted_sentiment\n"
        "a,2025-01-01 00:00:00+00:00,joy|anger,negative\n"
        "b,2024-12-31T19:00:00-05:00,,\n"
        "c,2025-11-02 06:30:00,joy,positive\n",
        encoding="utf-8",
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = read_predictions_csv(spark, str(path)).orderBy("comment_id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [str(r["comment_created_at"]) for r in rows] == [
        "2025-01-01 00:00:00",
        "2025-01-01 00:00:00",
        "2025-11-02 06:30:00",
    ]
    assert rows[1]["predicted_sentiment"] == "neutral" and rows[1]["emotions"] == []
    out = str(tmp_path / "parquet")
    read_predictions_csv(spark, str(path)).drop("predicted_emotions").write.parquet(out)
    assert read_predictions_parquet(spark, out).orderBy("comment_id").first()["emotions"] == ["joy", "anger"]


def test_examples(spark, tmp_path):
    path = str(tmp_path / "examples.json")
    os.mkdir(path)
    with open(f"{path}/part.json", "w") as handle:
        for i in range(20):
            handle.write(json.dumps({"id": i, "text": f" t{i}\n", "labels": [i % 28, 27]}) + "\n")
    rows = read_examples(spark, path).orderBy("id").collect()
    assert rows[2]["text"] == "t2" and rows[2]["labels"] == ["anger", "neutral"]
    train, test = load_splits(spark, path, path, max_test_samples=5)
    assert train.count() == 20 and test.count() == 5
    assert sorted(test.collect()) == sorted(load_splits(spark, path, path, 5)[1].collect())


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    scored = S.score_comments(comments_df(spark, "aaaa", "zzz"), letter_scores)
    for name in ("one", "two", "one"):  # the repeated run replaces the first
        sinks.write_run(scored, root, name, "d.csv", "roberta_samlowe", "R")
    assert sinks.read_run(spark, root, "one").count() == 2
    runs = sinks.list_runs(spark, root).collect()
    assert [r["experiment"] for r in runs] == ["one", "two"]
    assert runs[0]["comments_scored"] == 2 and runs[0]["cleaning"]["strip_urls"] is True
    assert sinks.run_metadata(spark, root).count() == 2


def test_evaluation_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ["joy"], ["joy"])], "id int, truth array<string>, predicted array<string>")
    root = str(tmp_path)
    sinks.write_evaluation(root, "m", "emotions", E.evaluate_emotions(df), E.emotion_labels(df))
    summary = spark.read.json(f"{root}/model=m/emotions_summary").first()
    assert summary["micro_f1"] == 1.0 and "hamming_loss" in summary
    table = spark.read.csv(f"{root}/model=m/emotions_per_class", header=True)
    assert table.columns == ["label", "precision", "recall", "f1", "support"] and table.count() == 28
    sinks.write_benchmark(root, E.evaluate_sentiment(df))
    assert spark.read.csv(f"{root}/benchmark_summary", header=True).count() == 1


# --- jobs ----------------------------------------------------------------------


def test_score_dataset(spark, tmp_path):
    from palaver.plans.jobs import experiment_name, score_dataset

    path = tmp_path / "comments.csv"
    path.write_text(
        "comment_id,post_id,comment_body,comment_score,comment_author,comment_created_utc\n"
        "c1,p1,aaaa,1,ann,0\nc1,p1,zzzz,1,ann,0\nc2,p1,[deleted],1,ann,0\nc3,p1,zzzz,1,ann,0\n",
        encoding="utf-8",
    )
    root = str(tmp_path / "runs")
    rows = score_dataset(spark, str(path), root, letter_scores, experiment="e").collect()
    assert {r["comment_id"]: r["predicted_emotions"] for r in rows} == {
        "c1": EMOTIONS[0],
        "c3": EMOTIONS[25],
    }
    one = score_dataset(spark, str(path), root, letter_scores, experiment="f", max_samples=1)
    assert [r["comment_id"] for r in one.collect()] == ["c1"]
    assert sinks.list_runs(spark, root).count() == 2
    assert experiment_name("bert_monologg").startswith("reddit_bert_20")
    with pytest.raises(ValueError, match="no comments left"):
        score_dataset(spark, str(path), root, letter_scores, experiment="g", max_samples=0)


def test_benchmark_job(spark, tmp_path):
    from palaver.plans.jobs import benchmark

    path = str(tmp_path / "examples")
    rows = [(i, f"text {i}", [i % 28]) for i in range(30)]
    spark.createDataFrame(rows, "id bigint, text string, labels array<int>").write.parquet(path)

    def right(train, test):
        return test.select("id", F.col("labels").alias("predicted"))

    out = str(tmp_path / "out")
    runners = {"roberta_samlowe": right}
    summary = benchmark(spark, runners, path, path, out, max_test_samples=10, run_id="r").first()
    assert summary["emotion_subset_accuracy"] == summary["sentiment_accuracy"] == 1.0
    base = f"{out}/r/model=roberta_samlowe"
    assert spark.read.json(f"{base}/sentiment_summary").first()["macro_f1"] <= 1.0
    assert spark.read.csv(f"{base}/emotions_per_class", header=True).count() == 28
    assert spark.read.csv(f"{out}/r/benchmark_summary", header=True).count() == 1


def test_a_task_holds_a_bounded_number_of_texts(spark):
    """Texts of like length meet among some batches, not among all that Arrow brings."""

    def factory():
        calls = []

        def predict(texts):
            calls.append(len(texts))
            return [[float(sum(calls) - calls[-1])] for _ in texts]

        return predict

    rows = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    found = {r.id: r.probs[0] for r in S.score_texts(rows, factory, "t", batch_size=4).collect()}
    # The longest of the first 32 batches of 4 texts is seen first.
    assert found[127] == 0 and found[299] >= 256
