"""Every operator, and every stage, on very long texts, nulls, ties, repeated rows, clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import exact_dedup, licenses, mixing, near_dedup, packing, quality, secrets, sharding, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, and a column that differs from another by case only.
NAMES = ("rid", "row", "score", "digest", "key", "size", "shard", "position", "visits", "tree", "node", "__rid", "__tie", "__null", "__text", "path", "predicted", "Text")


def long_text() -> str:
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return "\n".join(" ".join(word() for _ in range(20)) for _ in range(3000)) + "\nReleased under the MIT License. token=" + "a1B2" * 8


@pytest.fixture(scope="module")
def rows():
    long = long_text()  # over 400 000 characters
    return [(1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, long + " end", None, None, None), (4, "x" * 300_000, "en", "b", 1), (5, None, None, None, None), (5, None, None, None, None), (None, "", "en", "a", 0), (2**60 + 1, "tie", "en", "b", 3), (7, "tie", "en", "b", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (5, 0), (7, 1), (2, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))


def operators(labels):
    return {
        "toxicity": lambda d: toxicity.toxicity(d, labels), "mixing": mixing.training_order, "exact": exact_dedup.exact_groups, "tokens": token_output.token_digest,
        "quality": quality.judge, "licences": licenses.scan_licenses, "secrets": secrets.scan_secrets, "sharding": sharding.shard_by_bytes, "near": near_dedup.near_groups,
    }


def test_operators(docs, rows, labels):
    ids = sorted(str(r[0]) for r in rows)
    for name, f in operators(labels).items():
        got = f(docs).collect()
        assert sorted(str(r.doc_id) for r in got) == ids, name
        if name == "near":
            of = {r.doc_id: r.component_id for r in got}
            assert of[1] == of[2] == of[3] == 1 and of[7] == of[2**60 + 1] == 7 and of[5] == 5
        if name == "exact":
            assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, None: 5, 2**60 + 1: 7, 7: 7}
        if name == "licences":
            assert {r.doc_id for r in got if r.own_license == "MIT"} == {1, 2, 3}
        if name == "secrets":
            assert {r.doc_id for r in got if r.n_assign} == {1, 2, 3}
    pieces = packing.pack_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()
    assert {str(r.doc_id) for r in pieces} == set(ids) and all(r.n >= r.ids / 2048 for r in pieces)


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    for name, f in operators(labels).items():
        assert f(none).count() == 0, name
    assert packing.pack_documents(none).count() == 0
    nothing = labels.limit(0)
    assert toxicity.toxicity(docs, nothing).filter("predicted = 1").count() == 0
    for f in (lambda d: toxicity.drop_toxic(d, nothing), exact_dedup.drop_exact_copies, near_dedup.drop_near_copies, mixing.mix):
        assert f(none).columns == none.columns and f(none).count() == 0


def test_stages(spark, docs, rows, labels):
    kept = exact_dedup.drop_exact_copies(toxicity.drop_toxic(docs, labels.limit(0)))
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted(map(str, (1, 3, 4, 5, 7)))
    apart = near_dedup.drop_near_copies(docs)
    assert apart.columns == docs.columns and sorted(str(r[0]) for r in apart.collect()) == sorted(map(str, (1, 4, 5, 5, 7, None)))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r["rid"] for r in mixed.collect()} == {"clash"}


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
