"""Each stage against a plain version of it, on the smallest tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakewarden.llm import queries
from lakewarden.llm.common import read_table, written
from tests.llm.test_small_cases import brute_components, brute_hits

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, DIR, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "deduplication", "decontamination", "mixing", "tokens"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(written(stage(spark, frames[-1], DIR), name))
        assert frames[-1].columns == docs.columns
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in f.collect()] for f in frames]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in read_table(spark, DIR, "labels").collect()}
    clean = [i for i, _, _ in rows[0] if labels.get(i) == (1, 0)]
    assert len({i for i, _, _ in rows[1]} & set(clean)) >= 0.9 * len(clean)  # 200 documents are few to learn from
    want = {i for i, _, c in brute_components([(i, t) for i, t, _ in rows[1]]) if i == c}
    assert {i for i, _, _ in rows[2]} == want
    items = [(r["item_id"], r["text"]) for r in read_table(spark, DIR, "benchmark").collect()]
    assert {i for i, _, _ in rows[3]} == {i for i, t, _ in rows[2] if brute_hits(t, items)[1] == 0}
    size = lambda t: len(t.split())
    total = sum(size(t) for _, t, _ in rows[3])
    longest = max(size(t) for _, t, _ in rows[3])
    sources = sorted({s for *_, s in rows[3]})
    taken = {s: sum(size(t) for _, t, x in rows[4] if x == s) for s in sources}
    assert abs(sum(taken.values()) - total) <= longest * len(sources)
    final = corpus_pipeline.STAGES[-1][1](spark, frames[-1], DIR).orderBy("start").collect()
    assert len(final) == len(rows[4]) and final[0]["start"] == 0
    assert [b["start"] for b in final[1:]] == np.cumsum([r["n_tokens"] for r in final])[:-1].tolist()


def test_run_and_queries_are_registered(spark):
    import __spark_entry__

    assert corpus_pipeline.run(spark, DIR).where(F.col("n_tokens") < 1).count() == 0
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_queries_against_sql(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(DIR, name)}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, DIR)
        want = con.sql(sql).fetchall()
        columns = [c[0] for c in con.sql(sql).description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want)), name
