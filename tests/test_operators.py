"""Operators on small relations against plain Python, ties and large groups."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakewarden.functions.canon import canonical_json, record_view, trimmed
from lakewarden.functions.text import json_string, stripped
from lakewarden.operators import content, identity, overlap, results
from lakewarden.sources.formats import EVENTS, ReadLimits, read_artifacts

VIEW = "path string, row_num long, roles array<string>, kind string, canon string, row_hash string, top map<string,string>, types map<string,string>, texts map<string,string>, lists map<string,array<string>>, context string, discriminator string"


def relation(spark, records, path="eval.jsonl", roles=("evaluation_dataset",)):
    names = [c.split()[0] for c in VIEW.split(", ")]
    rows = [{"path": path, "row_num": i, "roles": list(roles), **record_view(r)} for i, r in enumerate(records, 1)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], VIEW)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_json_string_is_canonical(spark):
    texts = ["plain", 'a "quoted" \\ one', "tab\t line\n return\r", "".join(map(chr, range(32))) + "\\u001F", "é – 漢字 \x7f ", ""]
    got = [r["j"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_string(F.col("t")).alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_stripped_removes_all_white_space(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() and not 0xD800 <= c < 0xE000]
    texts = ["".join(spaces) + "a b" + "".join(spaces), "\u200b x", "", "  ", "\u3000é\u2003", "in\n side"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stripped(F.col("t")).alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_label_conflicts_trim_context_and_hash_the_case(spark):
    records = [
        {"prompt": "Which  one?", "context": " The river. ", "label": "a"}, {"prompt": "Which one?", "context": "The river.", "label": "b"},  # one case: only outer white space differs
        {"prompt": "Which one?", "context": "The lake.", "label": "c"}, {"question": "Other", "answer": ["y", "x", "x"]}, {"prompt": "Other", "answer": "x"}, {"prompt": 'say "it"\t', "docs": [{"t": " a"}], "label": 1}, {"prompt": 'say "it"', "docs": [{"t": "a "}], "label": "1"},
    ]
    got = {r["normalized_input_hash"]: r for r in identity.label_conflicts(relation(spark, records)).collect()}
    first = "sha256:" + sha(canonical_json({"input": "Which one?", "context": {"context": "The river."}}))
    second = "sha256:" + sha(canonical_json({"input": "Other", "context": {}}))
    assert set(got) == {first, second}
    assert got[first]["target_hashes"] == sorted([sha("a"), sha("b")]) and got[first]["row_locations"] == [("eval.jsonl", 1), ("eval.jsonl", 2)]
    assert got[second]["target_hashes"] == sorted([sha("x"), sha('["x","y"]')]) and got[second]["input_field"] == "question" and got[second]["target_fields"] == ["answer"]
    assert trimmed(records[5]["docs"]) == trimmed(records[6]["docs"])  # one label in two types is no conflict


def test_interpolation_hashes_the_line_without_its_margin(spark):
    lines = ["intro", "  Use {context} here\t", "a", "b", "c", "d", "```", "{docs}"]
    df = spark.createDataFrame([("p.md", i, ["prompt_template"], line) for i, line in enumerate(lines, 1)], "path string, line_num long, roles array<string>, line string")
    (r,) = content.unfenced_interpolations(df).collect()
    assert r.asDict() == {"prompt_artifact": "p.md", "variable_name": "context", "line_number": 2, "snippet": "sha256:" + sha("Use {context} here")}


@pytest.mark.parametrize(("named", "rows", "ratio"), [(1, 32, 0.0312), (3, 32, 0.0938), (1, 3, 0.3333), (2, 3, 0.6667)])
def test_coverage_rounds_half_to_even(spark, named, rows, ratio):
    records = [{"id": i, "prompt": "p"} for i in range(named)] + [{"prompt": "p"}] * (rows - named)
    (r,) = identity.partial_sample_ids(relation(spark, records)).collect()
    assert r["coverage_ratio"] == ratio and round(named / rows, 4) == ratio


def test_answers_without_inner_words(spark):
    found = spark.createDataFrame([("e", 1, "answer", "unbrokenanswertext"), ("e", 2, "answer", "two-worded answerhere"), ("e", 3, "answer", "with some inner words"), ("e", 4, "answer", "漢字" * 9)], "path string, row_num long, field string, answer string")
    texts = ["it holds an unbrokenanswertext2 inside", "xtwo-worded answerherex", "with some inner words", "with some inne", "short", "前" + "漢字" * 9 + "後", "with another inner words", ""]
    corpus = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)] + [("c", 9, texts[0])], "rag_artifact string, rag_row long, rag_text string")
    got = sorted((r["evaluation_row"], r["rag_row"]) for r in content.answer_leakage(found, corpus).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 5)]
    assert sorted((r["evaluation_row"], r["rag_row"]) for r in content.answer_leakage(found.where("row_num = 3"), corpus).collect()) == [(3, 2)]


def test_evidence_of_very_large_groups_is_ranked_not_gathered(spark):
    """10^5 members of one group: samples are the first ones, and no plan gathers the group."""
    n = 100_000
    types, texts = F.create_map(F.lit("text"), F.lit("string")), F.create_map(F.lit("text"), F.substring(F.concat(F.lit("the same chunk"), "id"), 1, 14))
    rows = spark.range(n).select(F.lit("corpus").alias("path"), F.col("id").alias("row_num"), F.array(F.lit("rag_document")).alias("roles"), F.concat(F.lit("h"), "id").alias("row_hash"), types.alias("types"), texts.alias("texts"))
    found = identity.duplicate_chunks(rows)
    (r,) = found.collect()
    assert r["duplicate_count"] == n and [x["row"] for x in r["row_locations"]] == list(range(20)) and r["row_hashes"][:2] == ["h0", "h1"] and r["evidence_truncated"]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    ids = spark.range(n).select(F.col("id").cast("string").alias("sample_id"))
    (a,) = results.alignment(ids, ids.where("sample_id LIKE '%7'")).collect()
    assert a["missing_ids"] == 90_000 and a["unexpected_ids"] == 0 and a["missing_id_hashes"] == ["sha256:" + sha(x) for x in sorted(str(i) for i in range(n) if i % 10 != 7)[:20]] and a["unexpected_id_hashes"] == []
    held = rows.select("path", "row_num", "roles", "row_hash", F.lit(None).cast("string").alias("discriminator"))
    side = lambda x, i: F.struct(F.lit("p").alias("path"), i.alias("row_num"), F.array(F.lit("training_dataset")).alias("roles"), F.concat(F.lit(x), i).alias("row_hash"), F.lit(None).cast("string").alias("discriminator"))
    pairs = held.select(side("s", F.col("row_num")).alias("source"), side("t", F.col("row_num") + 1).alias("target"), F.lit(0.9).alias("jaccard"))
    (d,) = overlap.near_duplicates(pairs, ("training_dataset",), 0.85, False).collect()
    assert d["near_duplicate_pair_count"] == n and d["affected_row_count"] == n + 1 and len(d["sample_pairs"]) == 20


def test_texts_and_rows_are_events_of_a_file(spark):
    """A file's text is an event of its own; a profile reads only the fields that it measures."""
    data = [("a.jsonl", "jsonl", ["evaluation_dataset"], b'{"id": 1, "prompt": "p", "docs": ["d"], "other": {"x": 1.0}}\r\nno json\n'), ("b.md", "markdown", ["rag_document"], b"one\r\ntwo"), ("c.md", "markdown", ["unknown"], b"text"), ("d.csv", "csv", ["training_dataset"], b"")]
    files = spark.createDataFrame([(p, k, r, bytearray(c)) for p, k, r, c in data], "path string, kind string, roles array<string>, content binary")
    whole = read_artifacts(files, ReadLimits(10, ("user",), ("prompt",))).collect()
    assert {(r["path"], r["payload"]) for r in whole if r["event"] == "text"} == {("a.jsonl", data[0][3].decode().replace("\r\n", "\n")), ("b.md", "one\ntwo")}
    (row,) = [r for r in whole if r["event"] == "row"]
    assert row["context"] == '{"docs":["d"]}' and row["sim_text"] == "p" and row["lists"] == {"docs": ["d"]} and row["top"]["other"] == '{"x":1.0}'
    assert not any("one" in (r["payload"] or "") for r in whole if r["event"] == "document")
    lean = read_artifacts(files, ReadLimits(10, ("user",), ("prompt",), frozenset({"id"}))).collect()
    assert not [r for r in lean if r["event"] == "text"]
    (short,) = [r for r in lean if r["event"] == "row"]
    assert short["row_hash"] == row["row_hash"] and short["texts"] == {"id": "1"} and short["canon"] is None and short["lists"] is None
    assert {(json.loads(r["payload"])["path"], json.loads(r["payload"])["fingerprint"]) for r in whole if r["event"] == "document"} == {(json.loads(r["payload"])["path"], json.loads(r["payload"])["fingerprint"]) for r in lean if r["event"] == "document"}
    assert EVENTS.startswith("event string")
