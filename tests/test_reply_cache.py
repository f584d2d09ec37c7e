"""The reply cache: probes, filter, appends and compaction."""

from __future__ import annotations

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from palaver.operators.reply_cache import (
    ReplyCache,
    bits_for,
    bloom_filter,
    passes,
    score_with_reply_cache,
)

ANSWERS = "model_key string, text_sha256 string, emotions array<string>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def answers(spark, model, texts, label="joy"):
    return spark.createDataFrame([(model, sha(t), [label]) for t in texts], ANSWERS)


def digests(spark, texts):
    return spark.createDataFrame([(sha(t),) for t in texts], "text_sha256 string")


def probed(cache, spark, texts, model="m"):
    return {r["text_sha256"]: r["emotions"] for r in cache.probe(digests(spark, texts), model).collect()}


def test_probe_finds_what_is_stored(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    assert probed(cache, spark, ["a"]) == {} and cache.rows().count() == 0
    texts = [f"text {i}" for i in range(500)]
    cache.append(answers(spark, "m", texts[:300]))
    cache.append(answers(spark, "m", texts[200:400]))
    cache.append(answers(spark, "other", texts[400:]))
    asked = texts[100:450] + ["new"]
    assert probed(cache, spark, asked) == {sha(t): ["joy"] for t in texts[100:400]}
    assert probed(cache, spark, []) == {}
    assert set(probed(cache, spark, asked, "other")) == {sha(t) for t in texts[400:450]}


def test_filter_has_no_false_negatives(spark):
    texts = [f"t{i}" for i in range(3_000)]
    bits = bits_for(1_000)
    words = bloom_filter(digests(spark, texts[:1_000]), bits)
    marked = digests(spark, texts).select(
        "text_sha256", passes(F.col("text_sha256"), words, bits).alias("p")
    )
    found = {r["text_sha256"]: r["p"] for r in marked.collect()}
    assert all(found[sha(t)] for t in texts[:1_000])
    assert sum(found[sha(t)] for t in texts[1_000:]) < 60
    assert bits_for(0) == 4096 and bits_for(10**12) == 1 << 26


def test_large_filter_is_filled_in_linear_time(spark):
    asked = spark.range(150_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"))
    bits = bits_for(150_000)
    start = time.perf_counter()
    words = asked.select(bloom_filter(asked, bits).alias("words")).first()["words"]
    assert time.perf_counter() - start < 12
    assert len(words) == bits // 64
    again = asked.where(passes(F.col("text_sha256"), bloom_filter(asked, bits), bits))
    assert again.count() == 150_000


def test_a_bucket_is_one_file_of_a_folder(spark, tmp_path):
    """However many tasks the answers come from, and after compaction too."""
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    cache.append(answers(spark, "m", [f"text {i}" for i in range(2_000)]).repartition(7))
    cache.compact()
    for folder in ("append-*", "base-*"):
        files = list((tmp_path / "cache").glob(f"{folder}/*/*/*.parquet"))
        assert len(files) == len({f.parent for f in files}) == 256


def test_shuffled_rows_follow_the_question(spark, tmp_path):
    """With ten times the cache, hardly more of its rows pass the filter."""
    passed = []
    for size in (2_000, 20_000):
        cache = ReplyCache(spark, str(tmp_path / f"cache{size}"))
        cache.append(answers(spark, "m", [f"text {i}" for i in range(size)]))
        asked = digests(spark, [f"text {i}" for i in range(50)])
        words = bloom_filter(asked, bits_for(50))
        passed.append(cache.rows("m").where(passes(F.col("text_sha256"), words, bits_for(50))).count())
        plan = cache.probe(asked, "m")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "bucket" in plan
    assert 50 <= passed[0] <= passed[1] <= 60


def test_compaction(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    texts = [f"text {i}" for i in range(60)]
    for start in (0, 20, 30):
        cache.append(answers(spark, "m", texts[start : start + 30]))
    before = probed(cache, spark, texts)
    assert cache.rows().count() == 90
    assert cache.compact() == 60
    assert cache.rows().count() == 60 and probed(cache, spark, texts) == before
    cache.append(answers(spark, "m", ["later"], "fear"))
    assert probed(cache, spark, ["later", texts[0]]) == {sha("later"): ["fear"], sha(texts[0]): ["joy"]}
    assert cache.compact() == 61 and cache.compact() == 61 and cache.rows().count() == 61


def test_failed_work_changes_nothing(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    cache.append(answers(spark, "m", ["a", "b"]))
    # An append and a compaction that were cut off leave folders without a mark of success.
    for name in ("append-x", "base-x"):
        os.makedirs(tmp_path / "cache" / name)
    assert cache.rows().count() == 2 and cache.compact() == 2


def test_scoring_asks_only_for_misses(spark, tmp_path):
    folder = str(tmp_path / "asked")
    os.makedirs(folder)

    def factory():
        def reply(prompts):
            for p in prompts:
                open(os.path.join(folder, hashlib.md5(p.encode()).hexdigest() + os.urandom(4).hex()), "w").close()
            return ['{"emotions": ["joy"]}' if len(p) % 2 else '{"emotions": ["fear"]}' for p in prompts]

        return reply

    rows = [(i, f"text {i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    first = score_with_reply_cache(df.where("id < 20"), "text", "m", factory, cache, "id")
    assert first.count() == 20 and len(os.listdir(folder)) == 20
    found = score_with_reply_cache(df, "text", "m", factory, cache, "id").collect()
    assert len(found) == 200 and len(os.listdir(folder)) == 40
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"], set()).add(tuple(r["emotions"]))
    assert all(len(v) == 1 for v in by_text.values())
    cache.compact()
    score_with_reply_cache(df, "text", "m", factory, cache, "id").count()
    assert len(os.listdir(folder)) == 40 and cache.rows().count() == 40


def test_null_texts_match_nothing(spark, tmp_path):
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    cache.append(answers(spark, "m", ["a"]))
    asked = spark.createDataFrame([(None,), (sha("a"),)], "text_sha256 string")
    assert [r["text_sha256"] for r in cache.probe(asked, "m").collect()] == [sha("a")]


@pytest.mark.parametrize("digits", [1, 3])
def test_other_bucket_sizes(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr("palaver.operators.reply_cache.DIGITS", digits)
    cache = ReplyCache(spark, str(tmp_path / "cache"))
    cache.append(answers(spark, "m", ["a", "b", "c"]))
    assert set(probed(cache, spark, ["a", "c", "x"])) == {sha("a"), sha("c")}
