"""Rendezvous sharding: the law, few moves, gapless slots."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.llm.sharding import assign_shards, number_rows, shard_of, shard_table

DOCS = "doc_id bigint, text string, shard string, slot string"


def corpus() -> list[tuple]:
    rows = [(i, f"text é {i % 11}" * (i % 5), None, "x") for i in range(600)]
    rows += [(None, None, "a", "b"), (None, "x", None, None), (3, "", None, None)]
    return rows + [rows[7]] * 40


def test_table_of_every_document(spark):
    rows = corpus()
    found = shard_table(spark.createDataFrame(rows, DOCS), 24).collect()
    own = Counter((r.doc_id, r.size, r.text_crc32) for r in found)
    assert own == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    shards, slots = defaultdict(set), defaultdict(list)
    for r in found:
        assert r.law == "key" and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        shards[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_few_keys_move(spark):
    keys = spark.range(20_000).select("id")
    grown = keys.select(
        shard_of(F.col("id"), [1.0, 2.0, 3.0]).alias("old"),
        shard_of(F.col("id"), [1.0, 2.0, 3.0, 6.0]).alias("new"),
        shard_of(F.col("id"), [1.0, 2.0]).alias("fewer"),
    ).collect()
    sizes = Counter(r.old for r in grown)
    for shard, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
        assert sizes[shard] / 20_000 == pytest.approx(share, abs=0.015)
    assert all(r.new in (r.old, 3) for r in grown)
    assert sum(r.new == 3 for r in grown) / 20_000 == pytest.approx(0.5, abs=0.015)
    assert all(r.fewer == r.old for r in grown if r.old < 2)


def test_one_scan_and_no_python(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(corpus(), DOCS).write.parquet(path)
    table = shard_table(spark.read.parquet(path), 24)
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "Python" not in plan and "Arrow" not in plan


def test_extra_columns_stay_and_empty_tables_pass(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    placed = assign_shards(docs, "doc_id", [1.0] * 4)
    assert placed.columns == docs.columns and placed.count() == docs.count()
    empty = docs.where("false")
    assert shard_table(empty, 3).count() == 0
    assert number_rows(placed.select("doc_id", "shard"), "shard", ["doc_id"]).count() == len(corpus())
    with pytest.raises(ValueError):
        shard_of(F.col("doc_id"), [])
