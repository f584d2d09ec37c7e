"""Exact quantiles against the built-in percentile and numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import quantiles
from palaver.operators.quantiles import exact_quantiles

ROWS = "g string, x double, y int"
WANTED = (0.0, 0.25, 0.5, 0.9, 1.0)


def corpus():
    rng = random.Random(3)
    rows = [("spread", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), 1) for _ in range(3_000)]
    rows += [("narrow", 5.0 + rng.random() * 1e-9, 1) for _ in range(3_000)]
    rows += [("equal", 7.25, 1)] * 2_000 + [("few", float(i), 1) for i in range(4)] + [("one", -0.5, 1)]
    rows += [("heavy", 1.0 if i % 3 else rng.random(), 1) for i in range(3_000)]
    rows += [("edge", x, 1) for x in (0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308)] * 50
    rows += [(None, rng.gauss(0, 1), 1) for _ in range(2_000)]
    rows += [("none", None, 1), ("nan", float("nan"), 1), ("few", None, 1), ("few", float("nan"), 1)]
    return rows


@pytest.mark.parametrize("limit, bins", [(1, 4), (50, 16), (100_000, 4096)])
def test_quantiles_are_exact(spark, monkeypatch, limit, bins):
    monkeypatch.setattr(quantiles, "SORTED_ROWS", limit)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows = corpus()
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    found = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", WANTED).collect()}
    groups: dict = {}
    for g, x, _ in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert found.keys() == groups.keys()
    for g, values in groups.items():
        assert found[g]["n"] == len(values)
        ranked = sorted(values)
        for q, got in zip(WANTED, found[g]["q"], strict=True):
            at = (len(values) - 1) * q
            low, high = ranked[int(np.floor(at))], ranked[int(np.ceil(at))]
            assert got == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=0), (g, q)


def test_as_percentile_without_groups(spark):
    df = spark.createDataFrame(corpus(), ROWS).where("g = 'heavy'")
    (row,) = exact_quantiles(df, [], "x", [0.5]).collect()
    assert row["q"] == [df.agg(F.percentile("x", F.lit(0.5))).first()[0]]
    (row,) = exact_quantiles(df, ["g", "y"], "y", [0.5]).collect()
    assert (row["g"], row["y"], row["n"], row["q"]) == ("heavy", 1, 3_000, [1.0])


def test_many_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", 3)
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 5)
    rows = [(f"g{i % 40}", float((i * 7919) % 1009), 1) for i in range(4_000)]
    found = {r["g"]: r["q"][0] for r in exact_quantiles(spark.createDataFrame(rows, ROWS), ["g"], "x", [0.5]).collect()}
    for g, got in found.items():
        assert got == np.median([x for h, x, _ in rows if h == g])


def test_bins_stay_few(spark, monkeypatch):
    """However many distinct values a group has, a task gets its bins or a bin's rows."""
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 1_000)
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(4).alias("x"), F.lit(1).alias("y"))
    sizes = []
    plain = quantiles._stored

    def watched(table):
        out = plain(table)
        sizes.append(out.agg(F.max("inside")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_stored", watched)
    df = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df
    exact_quantiles(df, ["g"], "x", [0.5]).collect()
    assert sizes[0] == 200_000 and sizes[-1] <= 1_000 and len(sizes) <= 4


def test_nothing(spark):
    df = spark.createDataFrame([("g", None, 1)], ROWS)
    assert exact_quantiles(df, ["g"], "x", [0.5]).collect() == []


def test_rows_are_derived_once(spark):
    """However many rounds the ranks take."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(5_000).selectExpr("cast(id % 2 as int) as g", "sqrt(id) as v")
    rows = rows.mapInArrow(count, "g int, v double")
    exact_quantiles(rows, ["g"], "v", [0.5]).collect()
    assert seen.value == 5_000
