import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.functions import canon, similarity
from lakewarden.sources.card import license_state
from lakewarden.sources.config import ConfigError, ScanConfig, local_ref, parse_config
from lakewarden.sources.discovery import artifact_at, fits_any, roles_of
from lakewarden.sources.formats import ReadLimits, audit, read_file

LIMITS = ReadLimits(3, ("user",), ("prompt",))


def test_hash_family_and_jaccard():
    a, b = similarity.hash_family(64)
    assert (a[0], b[0]) == (1373158607, 239081663)
    assert similarity.jaccard(set(), set()) == 1.0 and similarity.jaccard({"a"}, set()) == 0.0
    assert similarity.signature(set(), 4) == [0, 0, 0, 0]
    assert similarity.shingle_set("ab", 3) == {"ab"}
    assert similarity.normal_form("Héllo,  Wörld!") == "héllo wörld"


@given(st.text(max_size=60), st.text(max_size=60), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_codes_stand_for_shingles(a, b, k):
    x, y = similarity.shingle_codes(a, k), similarity.shingle_codes(b, k)
    s, t = similarity.shingle_set(a, k), similarity.shingle_set(b, k)
    assert len(x) == len(s) and len(set(x) & set(y)) == len(s & t)
    assert similarity.code_signature(a, x, k, 8) == similarity.signature(s, 8)


def test_canonical_values():
    assert canon.row_hash({"b": " x ", "a": 7.0}) == canon.row_hash({"a": 7.0, "b": "x"}) != canon.row_hash({"a": 7, "b": "x"})
    assert [canon.type_name(v) for v in (None, True, 1, 1.5, float("nan"), "s", {}, [])] == ["null", "boolean", "integer", "number", "non_finite_number", "string", "object", "array"]
    assert canon.identifier(7) == canon.identifier(" 7 ") == "7" and canon.identifier(True) is None
    assert canon.focus_text({"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "system", "content": "no"}]}, ("user",), ()) == "hi"
    assert list(canon.string_leaves({"b": ["y"], "a": "x"})) == ["x", "y"]


@pytest.mark.parametrize("glob, path, fits", [("**/*", "a/b.txt", True), ("*.md", "x/y.md", True), ("dist/", "dist/a/b", True), ("a/*.py", "a/b/c.py", False), ("a/?.py", "a/b.py", True), ("**/t.json", "t.json", True), ("x.y", "xzy", False)])
def test_globs(glob, path, fits):
    assert fits_any(path, [glob]) is fits


def test_roles():
    assert roles_of("data/train.jsonl", "jsonl") == ("training_dataset",)
    assert roles_of("settings.json", "json") == ("configuration",)
    assert roles_of("docs/x.md", "markdown") == ("rag_document",)
    assert roles_of("x.md", "markdown") == ("unknown",)
    both = artifact_at("train/eval.csv", ScanConfig())
    assert both.notes[0]["code"] == "artifact.role_conflict"
    assert artifact_at("a.bin", ScanConfig()) is None


def test_readers():
    def rows(kind, data):
        events = read_file("p", kind, {"training_dataset"}, data, LIMITS)
        return [e["row_num"] for e in events if e["event"] == "row"], [e["payload"] for e in events if e["event"] == "diagnostic"]

    found, notes = rows("jsonl", '{"a":1}\r\n\nbad\r{"a":" "}\n'.encode())
    assert found == [1, 4] and len(notes) == 1
    found, notes = rows("jsonl", b'{"a":1}\n{"a":2}\n{"a":3}\n{"a":4}\n')
    assert found == [1, 2, 3] and "row_limit" in notes[0]
    assert rows("csv", b" a ,b\n1,2\n\n3,4,5\n")[0] == [2]
    assert rows("yaml", b"d: 2024-01-01\n")[1] and rows("json", b"{")[1]
    assert audit(b"ok") is None and audit(b"a\x00\xff")["nul_byte_count"] == 1


@pytest.mark.parametrize("bad", [[], {"x": 1}, {"include": "a"}, {"artifacts": [{"path": "a"}]}, {"ci": {"fail_on": "never"}}, {"limits": {"max_file_mb": 0}}, {"similarity": {"threshold": 2}}, {"rules": {"severity": {"a": "b"}}}, {"artifacts": [{"path": "a.csv", "roles": ["training_dataset"], "schema": {"fields": {"x": {"type": "integer"}}}}]}, {"artifacts": [{"path": "a.json", "roles": ["training_dataset"], "provenance": {"source": {"type": "local", "ref": "../x"}}}]}])
def test_bad_configurations(bad):
    with pytest.raises(ConfigError):
        parse_config(bad)


def test_configuration_and_references():
    assert parse_config(None).max_rows == 250_000
    assert local_ref("a/./b") == "a/b"
    for ref in ("/a", "c:x", "a/../b", "a\nb"):
        with pytest.raises(ConfigError):
            local_ref(ref)


def test_licence_states():
    assert license_state("license: mit") == "present"
    assert license_state("license: [mit, cc]") == "present"
    assert license_state("license:") == license_state("a: 1") == "missing"
    assert license_state("a: &x 1\nlicense: *x") == license_state("- a") == license_state("license: 3") == "unavailable"


def test_content_state_table(spark):
    from pyspark.sql import functions as F

    from lakewarden.functions.text import content_state

    options = {None: (None, None), "null": ("null", None), "blank": ("string", "  "), "filled": ("string", "x"), "number": ("integer", "1")}
    rows, expected = [], []
    for a, b in itertools.product(options, repeat=2):
        held = {n: options[o] for n, o in (("text", a), ("body", b)) if o is not None}
        rows.append(({n: t for n, (t, _) in held.items()}, {n: v for n, (_, v) in held.items() if v is not None}))
        kinds = {a, b} - {None}
        expected.append("nonempty" if "filled" in kinds else "empty" if kinds and kinds <= {"null", "blank"} else None)
    df = spark.createDataFrame(rows, "types map<string,string>, texts map<string,string>").coalesce(1)
    assert [r["s"] for r in df.select(content_state().alias("s")).collect()] == expected
    assert F is not None
