"""Samples, quotas, caps, assembly and salted joins."""

import hashlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palaver.operators import sampling as G
from palaver.operators.skew import join_unique

START = datetime(2025, 1, 1)


def place(identifier, seed=42):
    return hashlib.md5(f"{identifier}{seed}".encode()).hexdigest()


def posts_df(spark, n=900, days=24):
    rows = []
    for i in range(n):
        # A third of all posts fall into the second week.
        day = 8 if i % 3 == 0 else i % days
        hint = ("image", "link", "rich:video")[i % 3 if i % 3 else (i // 3) % 3]
        rows.append((f"q{i}", START + timedelta(days=day, hours=i % 24), hint))
    rows += rows[:50]  # repeated posts count once
    return spark.createDataFrame(
        rows, "post_id string, post_created_at timestamp_ntz, post_hint string"
    )


def test_weekly_quota_by_brute_force(spark):
    posts = posts_df(spark)
    end = START + timedelta(days=24)
    assert G.week_count(START, end) == 4
    assert G.week_count(START, datetime(2026, 1, 1)) == 53
    for target, hints in ((202, ("image", "rich:video")), (41, None), (4000, None)):
        weeks = defaultdict(set)
        for r in posts.collect():
            if hints is None or r["post_hint"] in hints:
                weeks[(r["post_created_at"] - START).days // 7].add(r["post_id"])
        base, extra = divmod(target, 4)
        expected = {
            w: set(sorted(ids, key=place)[: base + (w < extra)]) for w, ids in weeks.items()
        }
        got = defaultdict(set)
        for r in G.weekly_sample(posts, START, end, target, hints).collect():
            assert r["post_id"] not in got[r["week"]]
            got[r["week"]].add(r["post_id"])
        assert got == expected


def test_weeks_start_at_the_period_not_at_midnight(spark):
    start = datetime(2025, 3, 29, 18, 30)
    moments = [start, start + timedelta(days=7, microseconds=-1), start + timedelta(days=7)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert [r[0] for r in df.select(G.week_of(F.col("t"), start)).collect()] == [0, 0, 1]


def test_seeded_sample(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(100)], "comment_id string")
    got = [r[0] for r in G.seeded_sample(df.repartition(7), "comment_id", 10).collect()]
    assert got == sorted((f"c{i}" for i in range(100)), key=place)[:10]
    assert G.seeded_sample(df, "comment_id", 1000).count() == 100
    other = [r[0] for r in G.seeded_sample(df, "comment_id", 10, seed=7).collect()]
    assert set(other) != set(got)


def test_scatter_points_need_score_and_sentiment(spark):
    data = [("a", 1, "neutral"), ("b", None, "neutral"), ("c", 3, None)]
    df = spark.createDataFrame(data, "comment_id string, post_score int, predicted_sentiment string")
    assert [r["comment_id"] for r in G.scatter_points(df).collect()] == ["a"]


def comments_df(spark):
    data = [("hot", f"c{i:03}", i % 5, "x") for i in range(90)]
    data += [("p1", "c1", 2, "y"), ("p2", "c2", None, "z"), ("gone", "c3", 1, "w")]
    return spark.createDataFrame(
        data, "post_id string, comment_id string, comment_score int, comment_body string"
    )


def test_cap_and_assembly(spark):
    comments = comments_df(spark)
    capped = G.cap_comments(comments, 4).collect()
    assert Counter(r["post_id"] for r in capped) == {"hot": 4, "p1": 1, "p2": 1, "gone": 1}
    assert {r["comment_id"] for r in capped if r["post_id"] == "hot"} == {
        "c004",
        "c009",
        "c014",
        "c019",
    }
    posts = spark.createDataFrame(
        [("hot", "t", None), ("p1", "u", "body"), ("quiet", "v", None)],
        "post_id string, post_title string, post_selftext string",
    )
    for bound in (None, 3):
        rows = G.assemble(posts, comments, 4, "2025", "art", max_posts=bound).collect()
        assert Counter(r["post_id"] for r in rows) == {"hot": 4, "p1": 1}
        assert {r["post_selftext"] for r in rows} == {"", "body"}
        assert {(r["period"], r["subreddit"]) for r in rows} == {("2025", "art")}


def test_hot_post_is_cut_before_the_shuffle(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = G.cap_comments(comments_df(spark), 4)._jdf.queryExecution().explainString(mode)
    assert plan.count("WindowGroupLimit") == 2


def test_salted_join_spreads_a_hot_key(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
        F.col("id").alias("row"),
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), (None, 9)], "key string, v int")
    for how in ("left", "inner"):
        plain = left.join(right, "key", how).select("row", "v").orderBy("row").collect()
        salted = join_unique(left, right, "key", spread_by="row", how=how, rows_per_task=100)
        assert salted.columns == ["key", "row", "v"]
        assert salted.select("row", "v").orderBy("row").collect() == plain


def test_salted_join_spreads_rows_without_a_key(spark):
    left = spark.range(2000).select(F.lit(None).cast("string").alias("key"), F.col("id").alias("row"))
    right = spark.createDataFrame([("a", 1)], "key string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_unique(left, right, "key", spread_by="row")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 2000 and len(sizes) == 8
    assert max(r["count"] for r in sizes) < 500
