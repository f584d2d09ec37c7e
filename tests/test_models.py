"""Models held by workers, batches by length, and scoring that can be resumed."""

from __future__ import annotations

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from palaver.operators import models
from palaver.operators.ledger import fill_ledger, read_ledger, score_with_ledger
from palaver.operators.models import by_length, factory_key, model_of, predictions
from palaver.operators.scoring import score_texts


def test_batches_by_length():
    texts = ["aaa", None, "a", "aaaaa", "", "aa", "bbb"]
    assert list(by_length(texts, 3)) == [[3, 0, 6], [5, 2, 1], [4]]
    assert list(by_length([], 3)) == []
    seen = []

    def predict(batch):
        seen.append([len(t or "") for t in batch])
        return [len(t or "") for t in batch]

    assert predictions(predict, texts, 3) == [3, 0, 1, 5, 0, 2, 3]
    # Padded to the longest of each batch: 5 * 3 + 2 * 3 + 0 instead of 3 * 3 + 5 * 3 + 3.
    assert sum(max(s) * len(s) for s in seen) == 21
    with pytest.raises(ValueError, match="one result per text"):
        predictions(lambda batch: [1], texts, 3)


def test_models_are_kept_by_content():
    models.forget_models()
    loads = []

    def make(name):
        def factory():
            loads.append(name)
            return name

        return factory

    one, same, other = make("a"), make("a"), make("b")
    assert factory_key(one) == factory_key(same) != factory_key(other)
    keys = {f: factory_key(f) for f in (one, other)}
    for factory in (one, one, other, one):
        model_of(keys[factory], factory)
    assert loads == ["a", "b"]
    for key in "cdef":
        model_of(key, same, held=2)
    assert len(models._held) == 2

    def broken():
        raise OSError("no weights")

    with pytest.raises(OSError):
        model_of("broken", broken)
    assert "broken" not in models._held
    models.forget_models()


def test_one_load_per_worker_process(spark, tmp_path):
    """Forty tasks on eight cores: no more loads than processes, and every row scored."""
    folder, name = str(tmp_path), uuid.uuid4().hex

    def factory():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w") as file:
            file.write(name)
        return lambda texts: [[float(len(t or ""))] for t in texts]

    rows = [(i, "x" * (i * 37 % 101) if i % 50 else None) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id int, comment_body string").repartition(40)
    found = score_texts(df, factory, batch_size=16).collect()
    assert {r["id"]: r["probs"] for r in found} == {i: [float(len(t or ""))] for i, t in rows}
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 8
    # A second job finds the models in place.
    score_texts(df.repartition(24), factory, batch_size=16).agg(F.count("probs")).collect()
    again = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(again) == len(set(again)) <= 8


# --- scoring that can be resumed -------------------------------------------------


def logging_factory(folder, broken):
    """Scores a text by its length; notes every text it is asked about; may break down."""

    def factory():
        def predict(texts):
            for text in texts:
                if os.path.exists(broken) and text.startswith("poison"):
                    raise RuntimeError("model broke down")
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                file.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return predict

    return factory


def asked(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as file:
            out += file.read().split("\n")
    return out


def comments(spark):
    rows = [(i, f"text {i % 300}" if i % 41 else None) for i in range(1_000)]
    rows += [(1_000 + i, f"poison {i}") for i in range(4)]
    return spark.createDataFrame(rows, "comment_id int, comment_body string").repartition(5), rows


def test_a_killed_run_resumes(spark, tmp_path):
    folder, broken, path = tmp_path / "asked", str(tmp_path / "broken"), str(tmp_path / "ledger")
    folder.mkdir()
    open(broken, "w").close()
    factory = logging_factory(str(folder), broken)
    df, rows = comments(spark)
    with pytest.raises(Exception, match="broke down"):
        score_with_ledger(df, factory, "toy", path, "comment_id", texts_per_step=40)
    done = {r["text_sha256"] for r in read_ledger(spark, path, "toy").collect()}
    first = asked(folder)
    assert 0 < len(done) < 300
    os.remove(broken)
    # Other partitions, as after a restart on another cluster.
    scored = score_with_ledger(
        df.repartition(3), factory, "toy", path, "comment_id", texts_per_step=40
    )
    found = {r["comment_id"]: r["probs"] for r in scored.collect()}
    assert scored.columns == ["comment_id", "comment_body", "probs"]
    assert found == {i: [float(len(t)), 1.0] if t is not None else None for i, t in rows}
    second = asked(folder)
    for text in first:
        second.remove(text)
    hashes = {hashlib.sha256(t.encode()).hexdigest() for t in second}
    assert not hashes & done and len(second) == len(set(second))
    stored = spark.read.parquet(path)
    distinct = {t for _, t in rows if t is not None}
    assert stored.count() == len(distinct) == len(done) + len(second)
    # A third run asks nothing.
    before = len(asked(folder))
    score_with_ledger(df, factory, "toy", path, "comment_id").count()
    assert len(asked(folder)) == before


def test_ledgers_of_models_are_apart(spark, tmp_path):
    df, rows = comments(spark)
    path = str(tmp_path / "ledger")
    (tmp_path / "asked").mkdir()
    factory = logging_factory(str(tmp_path / "asked"), "")
    texts = {t for _, t in rows if t is not None}
    assert fill_ledger(df, "comment_body", factory, "one", path, steps=6, most_steps=2) < len(texts)
    assert fill_ledger(df, "comment_body", factory, "two", path, steps=6) == len(texts)
    assert fill_ledger(df, "comment_body", factory, "two", path) == 0
    assert read_ledger(spark, path, "two").count() == len(texts)
    assert 0 < read_ledger(spark, path, "one").count() < len(texts)
    nothing = df.where("false")
    assert fill_ledger(nothing, "comment_body", factory, "none", path) == 0
    assert score_with_ledger(nothing, factory, "none", path, "comment_id").count() == 0


def test_hot_texts_are_spread(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "comment_id int, comment_body string")
    (tmp_path / "asked").mkdir()
    factory = logging_factory(str(tmp_path / "asked"), "")
    scored = score_with_ledger(
        df, factory, "toy", str(tmp_path / "ledger"), "comment_id", rows_per_task=50
    )
    assert {r[0]: r[2][0] for r in scored.collect()} == {i: float(len(t)) for i, t in rows}
    assert sorted(asked(str(tmp_path / "asked"))) == sorted({t for _, t in rows})


def test_score_job_resumes(spark, tmp_path):
    from palaver.plans.jobs import score_dataset

    df, _ = comments(spark)
    rows = df.where("comment_body is not null").select(
        F.col("comment_id").cast("string"), "comment_body", F.lit("p").alias("post_id"),
        F.lit(1).cast("bigint").alias("comment_score"), F.lit("a").alias("comment_author"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("comment_created_at"),
    )
    rows.write.parquet(str(tmp_path / "comments"))
    folder, broken = tmp_path / "asked", str(tmp_path / "broken")
    folder.mkdir()
    open(broken, "w").close()

    logging = logging_factory(str(folder), broken)

    def factory():
        inner = logging()
        return lambda texts: [[1.0] + [0.0] * 27 for _ in inner(texts)]

    def job():
        return score_dataset(
            spark, str(tmp_path / "comments"), str(tmp_path / "runs"), factory,
            experiment="run", ledger=str(tmp_path / "ledger"),
        )

    with pytest.raises(Exception, match="broke down"):
        job()
    os.remove(broken)
    assert job().where("predicted_emotions = 'admiration'").count() == rows.count()
    assert job().count() == rows.count()
    texts = asked(folder)
    assert len(texts) <= len(set(texts)) + 300


def test_finished_models_are_not_run_again(spark, tmp_path):
    from palaver.operators.training import run_models

    test = spark.createDataFrame([(i, f"t{i}", ["joy"]) for i in range(8)],
                                 "id int, text string, labels array<string>")
    calls = []

    def runner(name, fail=False):
        def run(train, test):
            calls.append(name)
            if fail:
                raise RuntimeError("stopped")
            return test.select("id", F.col("labels").alias("predicted"))

        return run

    folder = str(tmp_path)
    with pytest.raises(RuntimeError):
        run_models({"tfidf_logreg": runner("a"), "bert_monologg": runner("b", True)}, test, test, folder)
    good = {"tfidf_logreg": runner("a"), "bert_monologg": runner("b")}
    predictions, summary = run_models(good, test, test, folder, resume=True)
    assert calls == ["a", "b", "b"] and predictions.count() == 16
    assert summary.where("runtime_sec >= 0").count() == 2
    # Other examples, or no wish to resume, and all run.
    run_models(good, test, test.limit(4), folder, resume=True)
    run_models(good, test, test, folder)
    assert calls == ["a", "b", "b", "a", "b", "a", "b"]
