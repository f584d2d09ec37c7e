"""The pipeline against a plain version of its stages; the registered queries."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql.functions import lit
from test_decontaminate import best_similarity
from test_mixing import size_of, targets
from test_quality import plain
from test_similar_texts import slow_groups

import __spark_entry__ as entry
import corpus_pipeline
from palaver.llm.oracle import ORACLE
from palaver.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_DIR = "/root/testdata/sf0.001"


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(4)]
    rows, labels = [], []
    for i in range(240):
        chosen = rng.choices(words, k=rng.randint(55, 150))
        if i % 17 == 3:
            at = rng.randint(0, len(chosen))
            chosen[at:at] = items[i % 4][1].split()
        text = " | ".join(chosen) if i % 11 == 0 else " ".join(chosen)
        rows.append((i, text, "en", f"s{i % 3}" if i % 5 else None, len(text)))
        labels.append((i, int(i % 11 != 0), 0))
        if i % 13 == 0:
            rows.append((1000 + i, text, "en", "s1", len(text)))
        if i % 29 == 0:
            rows.append((2000 + i, text + " extra", None, "s2", None))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (None, "few words", None, None, 1)]
    return [*rows, rows[5], rows[5]], labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = corpus()
    made = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
    }
    for name, frame in made.items():
        frame.write.parquet(f"{root}/{name}.parquet")
    return root


def mixed(rows: list[tuple]) -> Counter:
    """How often each row is taken, by prefix sums inside its source."""
    sizes, parts, out = defaultdict(int), defaultdict(list), Counter()
    for row in rows:
        sizes[row[3]] += size_of(row[1])
    target = targets(sizes)
    for row in rows:
        key = hashlib.md5(f"{row[0] or ''}|{row[3] or ''}|{row[1] or ''}".encode()).hexdigest()
        parts[row[3]].append((size_of(row[1]), key, row))
    for source, part in parts.items():
        seed = f"{corpus_pipeline.MIX_SEED}|{source or ''}"
        offset = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) / 2**32
        rate = target[source] / sizes[source]
        for place, (_, _, row) in enumerate(sorted(part, key=lambda x: x[:2])):
            taken = math.floor((place + 1) * rate + offset) - math.floor(place * rate + offset)
            out[row] += taken
    return +out


def test_pipeline_matches_plain_stages(spark, tables):
    rows, _, items = corpus()
    good = []
    for row in rows:
        n, _, _, _, repeats = plain(row[1])
        if n >= 50 and 2 * repeats <= n and " | " not in (row[1] or ""):
            good.append(row)
    labels = slow_groups([r[1] for r in good])
    single = [
        min((r for r, x in zip(good, labels, strict=True) if x == label), key=lambda r: r[0])
        for label in sorted(set(labels))
    ]
    clean = [r for r in single if all(best_similarity(r[1], i[1]) < 0.8 for i in items)]
    assert len(rows) > len(good) > len(single) > len(clean) > 100
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    result = found.collect()
    assert Counter(tuple(r)[:5] for r in result) == mixed(clean)
    shards = defaultdict(set)
    for r in result:
        shards[r.doc_id].add(r.shard)
    assert all(len(s) == 1 and s <= set(range(24)) for s in shards.values())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "mixing", "sharding",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


CLASHES = (
    "_text", "_key", "_size", "_source", "_copies", "_no", "_base_failed", "_kept", "_row", "row",
    "node", "n", "fp", "bands", "key", "group", "words", "extra_0", "Text", "h", "k", "_hash",
)


def test_columns_of_any_name_pass_through(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    marks = [lit(f"own {name}").alias(name) for name in CLASHES]
    wide = docs.select(*docs.columns, *marks)
    for name, stage in corpus_pipeline.STAGES:
        narrow = stage(spark, docs, tables).collect()
        found = stage(spark, wide, tables)
        assert found.columns[: len(wide.columns)] == wide.columns, name
        rows = found.collect()
        for i, column in enumerate(wide.columns[len(docs.columns) :], len(docs.columns)):
            assert {r[i] for r in rows} == {f"own {column}"}, name
        kept = Counter(tuple(r)[: len(docs.columns)] for r in rows)
        # Equal rows but for the added columns are drawn alike only by their own hash.
        assert set(kept) == {tuple(r)[: len(docs.columns)] for r in narrow}, name


def test_long_texts_pass_the_stages(spark, tables):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30_000)]
    long = " ".join(rng.choices(words, k=60_000))
    rows = [(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, "x" * 300_000, "en", "b", 1)]
    rows += [(4, " ".join(rng.choices(words, k=100)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, tables).collect()}
    assert kept == {1, 3, 4}
    for name in ("decontamination", "sharding"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables)
        assert {r.doc_id: len(r.text) for r in out.collect()} == {r[0]: len(r[1]) for r in rows}
    mixed_rows = corpus_pipeline.mixing(spark, docs, tables).collect()
    assert {r.doc_id for r in mixed_rows} <= {1, 2, 3, 4} and mixed_rows


def test_operators_and_the_pipeline_are_registered():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(
            f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'"
        )
    frame = QUERIES[name](spark, SF_DIR)
    relation = connection.sql(ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    found = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert found == sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=repr)
