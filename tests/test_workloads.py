"""Queries against SQL on the smallest tables; similarity against brute force."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakewarden import workloads
from lakewarden.functions import similarity
from lakewarden.operators import content, overlap

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    import pandas as pd

    return sorted(tuple("" if pd.isna(v) else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(workloads.ORACLES))
def test_oracle(name, spark, con):
    got = workloads.QUERIES[name](spark, DIR).toPandas()
    want = con.sql(workloads.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [[c.removesuffix(".0") for c in r] for r in rows(got)] == [[c.removesuffix(".0") for c in r] for r in rows(want)]


def test_similarity_against_brute_force(spark):
    texts = ["the cat sat on the mat today", "the cat sat on the mat todax", "a wholly other sentence", "", "!!!", "the cat sat on the mat today!"]
    df = spark.createDataFrame([("p", i, ["training_dataset"], str(i), None, t) for i, t in enumerate(texts)], "path string, row_num long, roles array<string>, row_hash string, discriminator string, sim_text string")
    got = {(r["source"]["row_num"], r["target"]["row_num"]) for r in overlap.candidate_pairs(overlap.similarity_items(df), 0.7).collect()}
    sets = {i: similarity.shingle_set(similarity.normal_form(t), 3) for i, t in enumerate(texts) if t}
    sigs = {i: similarity.signature(s, 64) for i, s in sets.items()}
    want = {(i, j) for i in sets for j in sets if i < j and any(sigs[i][b : b + 4] == sigs[j][b : b + 4] for b in range(0, 64, 4)) and similarity.jaccard(sets[i], sets[j]) >= 0.7}
    assert got == want and (0, 1) in got


def test_pairs_are_listed_by_similarity_then_ids(spark):
    df = spark.createDataFrame([("b", "c", 0.9), ("a", "d", 0.9), ("a", "c", 0.9), ("x", "y", 0.95)], "src string, tgt string, jaccard double")
    assert [(r["src"], r["tgt"]) for r in overlap.ranked_pairs(df).collect()] == [("x", "y"), ("a", "c"), ("a", "d"), ("b", "c")]


def test_bucket_limit_drops_large_families(spark):
    n = overlap.BUCKET_LIMIT + 1
    df = spark.createDataFrame([("p", i, ["training_dataset"], str(i), None, "one and the same text") for i in range(n)], "path string, row_num long, roles array<string>, row_hash string, discriminator string, sim_text string")
    items = overlap.similarity_items(df)
    assert overlap.candidate_pairs(items, 0.85).count() == 0
    assert overlap.candidate_pairs(items.limit(n - 1), 0.85).count() == (n - 1) * (n - 2) // 2


def test_probe_against_brute_force_with_a_large_bucket(spark):
    n = overlap.BUCKET_LIMIT + 1
    texts = ["one and the same text of a family"] * n + ["one and the same text of a familx", "a wholly other sentence", "!!!"]
    df = spark.createDataFrame([("p", i, ["training_dataset"], str(i), None, t) for i, t in enumerate(texts)], "path string, row_num long, roles array<string>, row_hash string, discriminator string, sim_text string")
    asked = {"a": "One and the same text of a family!", "b": "a wholly other sentences", "c": "", "d": "???", "e": None, "f": "nothing like it"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    got = {(r["query_id"], r["id"]): round(r["jaccard"], 9) for r in overlap.probe(overlap.similarity_items(df), queries, 0.3).collect()}
    facts = lambda t: (s := similarity.shingle_set(similarity.normal_form(t or ""), 3), similarity.signature(s, 64))
    indexed, want = [facts(t) for t in texts], {}
    for q, text in asked.items():
        own, sig = facts(text)
        for i, (held, other) in enumerate(indexed):
            if own and any(sig[b : b + 4] == other[b : b + 4] for b in range(0, 64, 4)) and (score := similarity.jaccard(own, held)) >= 0.3:
                want[q, f"p:{i}"] = round(score, 9)
    assert got == want and sum(q == "a" for q, _ in got) >= n


def test_leakage_with_and_without_inner_words(spark):
    found = spark.createDataFrame([("e", 1, "answer", "abcdefghijklmnopqrst"), ("e", 2, "answer", "part of a longer wordxx")], "path string, row_num long, field string, answer string")
    corpus = spark.createDataFrame([("r", 1, "zzabcdefghijklmnopqrstzz"), ("r", 2, "some_part of a longer wordxxy"), ("s", 3, "none")], "rag_artifact string, rag_row long, rag_text string")
    assert {(r["evaluation_row"], r["rag_row"]) for r in content.answer_leakage(found, corpus).collect()} == {(1, 1), (2, 2)}


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    base = docs.select(F.lit("p").alias("path"), F.col("doc_id").alias("row_num"), F.array(F.lit("training_dataset")).alias("roles"), F.sha2("text", 256).alias("row_hash"))
    one, many = (sorted(map(str, overlap.exact_duplicates(base.repartition(k), ("training_dataset",)).collect())) for k in (1, 13))
    assert one == many


def test_streaming(spark, tmp_path):
    from lakewarden.streaming.duplicates import first_seen, repeated_counts

    schema = "k string, ts timestamp"
    spark.sql("SELECT explode(array('a', 'b', 'a')) AS k, timestamp'2024-01-01 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("firsts", first_seen(stream, "k", "ts"), "append"), ("repeats", repeated_counts(stream, "k", "ts"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == ["a", "b"]
    assert [(r["k"], r["n"]) for r in spark.table("repeats").collect()] == [("a", 2)]
