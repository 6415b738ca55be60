"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: defined results for each operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import decontamination, html_mincut, jaccard_join, lattice, mixing, quality, sharding, url_cascade, warc, wavelet
from lakewarden.llm.common import ascii_lower, written

DOCS = "doc_id long, text string, source string, `row` int, wh string, good boolean, doc_hash long, p int, size int, h int, _size int, own_id int"
EXTRA = (7, "x", True, 1, 2, 3, 4, 5, 6)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


TEN = "one two three four five six seven eight nine ten"


def brute_hits(text, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        n = min(10, len(i))
        grams = {tuple(i[a : a + n]) for a in range(len(i) - n + 1)} if n else set()
        for a in range(len(w) - n + 1) if n else []:
            if tuple(w[a : a + n]) in grams:
                hit.update(range(a, a + n))
                found.add(item)
    return len(w), len(hit), sorted(str(f) for f in found if f is not None)


def test_decontamination_against_brute_force(spark):
    texts = [None, "", "!!", TEN, f"a {TEN} b {TEN}", TEN.upper().replace(" ", "-"), "one two", f"x {TEN} ELEVEN twelve y", "É word", "é word", ("lorem ipsum " * 4000) + TEN, TEN]
    items = [(1, TEN + " eleven twelve"), (2, "two"), (3, None), (4, ""), (5, "É"), (6, TEN), (10, TEN), (None, "ipsum lorem")]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(3, TEN, "s"), (None, TEN, "s"), (0, "two", "s")])
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.contamination_report(docs, items_of(spark, items)).collect())
    every = [(i, t) for i, t in enumerate(texts)] + [(3, TEN), (-1, TEN), (0, "two")]
    assert got == sorted((i, *brute_hits(t, items)) for i, t in every)
    none = decontamination.contamination_report(docs, items_of(spark, []))
    assert none.where("contaminated").count() == 0 and none.count() == len(every)
    assert decontamination.contamination_report(docs.limit(0), items_of(spark, items)).count() == 0
    kept = decontamination.drop_contaminated(docs, items_of(spark, items))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 9}


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_GRAMS", 0)
    docs, items = docs_of(spark, [(1, f"a {TEN} b two", "s"), (2, "c", "s")]), items_of(spark, [(1, TEN), (2, "two")])
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontamination.contamination_report(docs, items).collect()}
    assert got == {1: (11, ["1", "2"]), 2: (0, [])}


def test_items_of_every_length(spark):
    """Short items of all lengths at once, beside a long one; a long text and one of a single word repeated."""
    words = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(words[3 * n : 4 * n])) for n in range(1, 10)] + [(20, " ".join(words[5:25]))]
    texts = [" ".join(words), " ".join(words[::-1]), "w3 " * 5000, " ".join(words * 300), "w3"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.contamination_report(docs, items_of(spark, items)).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k", [1, 5, 10])
def test_winnowing_guarantee_for_any_gram_size(spark, k):
    rng = np.random.default_rng(k)
    words = lambda n: " ".join(rng.choice(list("abc"), n))
    texts, items = [words(40) for _ in range(12)], [(i, words(12)) for i in range(6)]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.contamination_report(docs, items_of(spark, items), k=k).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_quality_cases(spark):
    good, bad = "plain words make good prose here ", "### spam $$$ junk ### "
    rows = [(i, good * (1 + i % 5) if i % 3 else bad * (1 + i % 5), "s") for i in range(300)] + [(1000, None, "s"), (1001, "", "s"), (None, good, "s"), (1, good * 2, "s")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    report = quality.resample_report(docs, labels).collect()
    assert len(report) == len(rows)
    kept = {r["doc_id"] for r in report if r["kept"]}
    assert {1000, 1001, None} <= kept and all((i in kept) == (i % 3 > 0) for i in range(300))
    out = quality.keep_sampled(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality.resample_report(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert quality.resample_report(docs.limit(0), labels).count() == 0


def test_quality_model_against_brute_force(spark):
    rows = [(i, ["alpha beta", "alpha gamma gamma", "beta beta alpha", "delta"][i % 4], "s") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 4 < 3), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    p = quality.QualityParameters(pseudo=1.0, dead_zone=0.1)
    model = quality.QualityModel(docs_of(spark, rows), labels, p)
    from lakewarden.llm.common import hash60

    hashes = {r["doc_id"]: r["h"] for r in labels.select("doc_id", hash60(F.lit(p.seed), F.col("doc_id")).alias("h")).collect()}
    sums = np.zeros((4, quality.bucket_count(0)))
    for i, text, _ in rows:
        target = i % 4 < 3 and hashes[i] % 5 > 0
        found = quality.feature_buckets(text.encode())
        for b in found:
            sums[0, b] += 1
            sums[1, b] += target
        for b in set(found.tolist()):
            sums[2, b] += 1
            sums[3, b] += target
    ratios = model.ratios.toPandas().set_index("bucket")
    for name, (raw, target) in (("by_count", sums[:2]), ("by_document", sums[2:])):
        want = np.log((target + 1) / (raw * target.sum() / raw.sum() + 1))
        np.testing.assert_allclose(ratios[name].to_numpy(), want[ratios.index], rtol=1e-5, atol=1e-6)
        assert set(np.flatnonzero(sums[0])) == set(ratios.index)
    weights = {r["doc_id"]: r["log_weight"] for r in model.weights.collect()}
    for i, text, _ in rows:
        found = quality.feature_buckets(text.encode())
        held = sum(min(float(ratios["by_document"][b]) + 0.1, 0) for b in set(found.tolist()))
        assert weights[i] == pytest.approx(100 * float(ratios["by_count"][found].mean()) + 2 * held, abs=1e-4)
    keys = sorted((r["key"] for r in model.weights.withColumn("key", model.sampling_key()).collect()), reverse=True)
    chosen = [r["key"] for r in model.weights.withColumn("key", model.sampling_key()).where(model.kept(F.col("key"))).collect()]
    assert sorted(chosen, reverse=True) == keys[: len(chosen)] and len(chosen) == model.k


def test_counts_of_a_very_long_text(spark):
    """A count of a batch beyond 16 bits, and two documents that share the feature."""
    rows = spark.createDataFrame([(bytearray(b"again " * 200_000), True), (bytearray(b"again"), False), (None, True)], "text binary, target boolean")
    one, two = sorted(set(quality.feature_buckets(b"again again").tolist()))
    got = {r["bucket"]: tuple(r)[1:] for r in quality.count_features(rows).collect()}
    assert got == {one: (200_001, 200_000, 2, 1), two: (199_999, 199_999, 1, 1)}


def test_the_sample_is_nearer_to_the_target(spark):
    """Documents of two mixed styles: the sampled set's words must be distributed more like the target's than the raw corpus's."""
    rng = np.random.default_rng(7)
    styles = [[f"w{i}" for i in range(60)], [f"w{i}" for i in range(40, 100)]]
    rows = [(i, " ".join(rng.choice(styles[0] if rng.random() < i % 5 / 4 else styles[1], 40)), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 4), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    report = quality.resample_report(docs_of(spark, rows), labels, quality.QualityParameters(emphasis=0.0, miss=0.3)).collect()
    kept = {r["doc_id"] for r in report if r["kept"]}

    def spread(ids):
        counts = np.zeros(100)
        for i, text, _ in rows:
            if i in ids:
                np.add.at(counts, [int(w[1:]) for w in text.split()], 1)
        return counts / counts.sum()

    target = spread({i for i in range(600) if i % 5 == 4})
    assert 60 < len(kept) < 500
    assert np.abs(spread(kept) - target).sum() < 0.5 * np.abs(spread(set(range(600))) - target).sum()


@pytest.mark.parametrize("texts", [1, 40_000, 1 << 28, 1 << 33, 1 << 50])
def test_models_grow_with_the_corpus(texts):
    growth = quality.growth_of(texts)
    assert growth == {1: 0, 40_000: 0, 1 << 28: 0, 1 << 33: 3, 1 << 50: quality.MOST_GROWTH}[texts]
    assert quality.feature_buckets(b"some words, here", growth).max() < quality.bucket_count(growth)


def test_warc_round_trip(spark):
    big = "ü" * 20_000 + "\r\n0\r\n\r\n"
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (5, "u", big), (7, "u", "y"), (None, "u", "y"), (8, "u", "z" * 4096)]
    pages = spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id long, url string, html string, sha1 int, record_id string")
    facts = warc.archive_and_read(pages, segment_bytes=1000)
    got = sorted((r["record_id"].split(":")[2], r["record_type"], r["status"], r["copies"], None if r["payload"] is None else bytes(r["payload"])) for r in facts.collect())
    assert all(g[2] == "ok" for g in got)
    b = lambda s: (s or "").encode()
    want = [("1", "response", "ok", 1, b"x"), ("2", "revisit", "ok", 1, None), ("3", "response", "ok", 1, b""), ("4", "revisit", "ok", 1, None), ("5", "response", "ok", 2, b(big)), ("6", "revisit", "ok", 1, None), ("7", "response", "ok", 1, b"y"), ("8", "response", "ok", 1, b"z" * 4096), ("null", "revisit", "ok", 1, None)]
    assert got == sorted(want)
    sizes = {r["record_id"].split(":")[2]: r["payload_bytes"] for r in warc.resolve_revisits(facts).collect()}
    assert sizes["2"] == 1 and sizes["6"] == len(b(big)) and sizes["4"] == 0
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    whole = warc.archive_and_read(pages.where("page_id IN (1, 2)"), least_bytes=2)
    assert {r["record_type"] for r in whole.collect()} == {"response"}


def test_warc_of_often_repeated_long_pages(spark, monkeypatch):
    """Copies of a page in many segments are gathered once; the join is the same with and without a broadcast."""
    long = "<p>" + "0123456789" * 9000 + "</p>"
    rows = [(1, "u", long)] * 60 + [(2, "v", long), (3, "w", "short"), (4, "w", "short"), (5, None, None), (6, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for most in (0, 1000):
        monkeypatch.setattr(warc, "MAX_BROADCAST_FIRST", most)
        facts = warc.resolve_revisits(warc.archive_and_read(pages, segment_bytes=5000)).collect()
        seen.append(sorted((r["record_id"].split(":")[2], r["record_type"], r["payload_bytes"], r["copies"], r["status"]) for r in facts))
    assert seen[0] == seen[1]
    assert [(i, kind, n) for i, kind, n, *_ in seen[0]] == sorted([("1", "response", 90_007), ("2", "revisit", 90_007), ("3", "response", 5), ("4", "revisit", 5), ("5", "response", 0), ("6", "revisit", 0)]) and seen[0][0][3:] == (60, "ok")


def test_warc_broken_records():
    frame = warc.frame_chunks(b"abcdef", 4)
    assert frame == b"4\r\nabcd\r\n2\r\nef\r\n0\r\n\r\n" and warc.unframe_chunks(frame) == b"abcdef"
    for bad in (b"", b"zz\r\n", frame[:-8], b"5\r\nabcd\r\n0\r\n\r\n"):
        assert warc.unframe_chunks(bad) is None
    assert warc.unframe_chunks(b"2;ext=1\r\nab\r\n0\r\nTrailer: x\r\n\r\n") == b"ab"
    segment = lambda n, total, block: {"segment": n, "total_bytes": total, "block": block}
    assert warc.join_segments([segment(2, 3, b"c"), segment(1, None, b"ab")]) == (b"abc", "ok")
    assert warc.join_segments([segment(1, None, b"ab")])[1] == "missing_segment"
    assert warc.join_segments([segment(1, None, b"ab"), segment(3, 3, b"c")])[1] == "missing_segment"
    assert warc.join_segments([segment(1, None, b"ab"), segment(2, 9, b"c")])[1] == "length_mismatch"
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest()[:4] == "da39"


def test_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(x)
    roots = lattice.minimal_vectors()
    assert len(roots) == 240 and set((roots**2).sum(1)) == {8}
    assert all((row % 2 == row[0] % 2).all() and row.sum() % 4 == 0 for row in near)
    own = ((2 * x - near) ** 2).sum(1)
    for r in roots:  # no neighbour is closer
        assert (((2 * x - near - r) ** 2).sum(1) >= own - 1e-9).all()


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [base[i % 40] + rng.normal(size=16) * (0.02 + 0.12 * (i % 5)) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [None] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] + [0.0] * 15, 1), (1006, rows[0][1], None), (1007, rows[0][1][:8], 0), (None, rows[0][1], 0), (1008, rows[1][1], 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, label int, node int, copies int")
    live = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows] + [(1007, np.array(rows[0][1][:8]), 0), (1008, np.array(rows[1][1]), 1), (1, np.array(rows[1][1]), 1)]
    links = {k: 0 for k in range(len(live))}
    root = list(range(len(live)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(live)):
        for b in range(a + 1, len(live)):
            (_, x, lx), (_, y, ly) = live[a], live[b]
            if lx == ly and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(live)):
        least[find(k)] = min(least.get(find(k), 10**9), live[k][0])
    want = sorted((live[k][0], links[k], least[find(k)]) for k in range(len(live)))
    got = lattice.near_duplicate_vectors(df, block=16).collect()
    assert len(got) == len(rows) + len(odd)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and (r["vec_id"] < 1000 or r["vec_id"] in (1007, 1008))) == want
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] is None or 1000 <= r["vec_id"] <= 1006)
    assert sum(links.values()) > 300
    assert lattice.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dimension", "noise"), [(64, 0.004), (64, 0.03), (32, 0.012)])
def test_lattice_recall_and_counts_of_families(spark, dimension, noise):
    """3,000 vectors in families of up to 1,200, tight and loose ones, and a chain: every link and component as by brute force."""
    rng = np.random.default_rng(int(noise * 1000))
    centres = rng.normal(size=(30, dimension))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    sizes = [1200, 700] + [15] * 20 + [100] * 8
    vectors = [centres[f] + rng.normal(size=dimension) * noise * (1 + f % 3) for f, size in enumerate(sizes) for _ in range(size)]
    step = rng.normal(size=(2, dimension))
    vectors += [np.cos(a) * step[0] + np.sin(a) * step[1] for a in np.linspace(0, 3, 60)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicate_vectors(df, block=64).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(links.sum(1).tolist()))
    least = list(range(len(rows)))
    for i in range(len(rows)):  # ids ascend: a flood from each least id
        if least[i] == i:
            edge = [i]
            while edge:
                near = [j for j in np.flatnonzero(links[edge.pop()]).tolist() if least[j] == j and j > i]
                for j in near:
                    least[j] = i
                edge += near
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(least))


def test_very_long_vectors_and_texts(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=30_000)
    df = spark.createDataFrame([(i, (base + rng.normal(size=30_000) * 0.05 * (i < 3)).tolist() if i < 4 else rng.normal(size=30_000).tolist(), 1) for i in range(6)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicate_vectors(df).collect()} == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}
    docs = docs_of(spark, [(i, "word " * (400_000 if i == 3 else i), f"s{i % 2}") for i in range(8)])
    mixed = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert mixed[3][0] == 400_000 and all(t <= 3 * n for n, t in mixed.values())
    shards = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_documents(docs, 3).collect()}
    assert shards[3] == (2_000_001, zlib.crc32(b"word " * 400_000)) and len(shards) == 8


def test_html_cases(spark):
    article = "<article><h1>T &amp; t</h1><p>First  long paragraph, with words.<p>Of.</p><aside>Related reading here</aside><ul><li>item one is fine.</li></ul></article>"
    page = f'<html><head><title>x</title><style>p{{}}</style></head><body class="has-sidebar"><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><script>var t="</p>";</script>{article}<section class="comments"><p>A reader wrote a long comment here, as readers do.</p></section><form><label>Mail</label></form><footer>&copy; 2024</footer></body></html>'
    expected = "T & t\nFirst long paragraph, with words.\nOf.\nitem one is fine."
    assert html_mincut.extract_text(page) == expected
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>open <!-- never closed"), (None, "u", page), (1, "u", page), (5, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (6, "u", '<p class="a>b" title=\'"\'>quoted</p>')]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_mincut.extract_pages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert by[1] == [(expected, len(expected))] * 2 and by[2] == by[3] == [("", 0)] and by[5][0][1] == 249_999
    assert html_mincut.extract_pages(df.limit(0)).count() == 0


def test_minimum_cut_against_enumeration():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        cost = lambda keep: sum(-g for g, k in zip(gain, keep, strict=True) if k) + sum(c for i, j, c in edges if keep[i] != keep[j])
        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert cost(html_mincut.minimum_cut(gain, edges)) == pytest.approx(best)


def test_held_out_accuracy_of_the_block_classifier():
    import random

    rng, right, total = random.Random(99), 0, 0
    for _ in range(200):
        text, truth = html_mincut.generated_page(rng)
        page = html_mincut.parse_page(text)
        assert len(page.blocks) == len(truth)
        labels = html_mincut.label_blocks(page, html_mincut.trained_weights())
        right += sum(a == b for a, b in zip(labels, truth, strict=True))
        total += len(truth)
    assert right / total > 0.95  # a quarter of the pages have no names at all, another invented ones


ODD_PAGES = [
    ("Just a plain text page without markup. It has sentences.", "Just a plain text page without markup. It has sentences."),
    ("<main><p>See <a href=1>this page</a>.</p><p>Another sentence follows here, with more words.</p></main>", "See this page.\nAnother sentence follows here, with more words."),
    ("<article><h1>Prices</h1><p>The table shows prices of bread by year.</p><table><tr><th>Year</th><th>Price</th></tr><tr><td>1990</td><td>2.10</td></tr></table><p>They rose.</p></article><footer>© x</footer>", "Prices\nThe table shows prices of bread by year.\nYear\nPrice\n1990\n2.10\nThey rose."),
    ("<article><p>Code follows here in a block.</p><pre>def f(x):\n    return x</pre></article>", "Code follows here in a block.\ndef f(x): return x"),
    ("<article><h1>T</h1><p>Body text goes here, it is long enough to read.</p><section class='comments'><h2>Comments</h2><div><p>Great article, thanks a lot for it!</p></div></section></article>", "T\nBody text goes here, it is long enough to read."),
    ("<article><h1>T</h1><p>Body text goes here, and goes on.</p><aside><p>Related: another story that you may like.</p></aside><p>More body text follows after it.</p></article>", "T\nBody text goes here, and goes on.\nMore body text follows after it."),
    ("<main><h1>T</h1><section><h2>One</h2><p>First section text is here.</p></section><section><h2>Two</h2><p>Second section text is here.</p></section></main>", "T\nOne\nFirst section text is here.\nTwo\nSecond section text is here."),
    ("<div><div><div>Menu</div><div>About us</div></div><div><div>A paragraph that stands in a div, with enough words to count as prose.</div><div>Another one stands in a div, and it also has enough words to count.</div></div><div>Imprint</div></div>", "A paragraph that stands in a div, with enough words to count as prose.\nAnother one stands in a div, and it also has enough words to count."),
]


@pytest.mark.parametrize(("page", "expected"), ODD_PAGES)
def test_sections_tables_and_plain_elements(page, expected):
    assert html_mincut.extract_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (
            '''<body><div class="zeitleiste"><a href="/">Start</a> <a href="/s">Sport</a> <a href="/p">Politik</a></div><div class="inhalt"><h1>Neue Brücke eröffnet</h1><p>Am Montag wurde in der Stadt die neue Brücke
            eröffnet, die beide Ufer verbindet.</p><p>Viele Menschen kamen, um sie zu sehen. Die Bauzeit betrug drei Jahre.</p></div><div class="kommentare"><p>Endlich ist sie fertig, das hat ja lange gedauert!</p></div>
            <div class="fuss"><p>© 2024 Stadtblatt. Alle Rechte vorbehalten.</p></div></body>''',
            "Neue Brücke eröffnet\nAm Montag wurde in der Stadt die neue Brücke eröffnet, die beide Ufer verbindet.\nViele Menschen kamen, um sie zu sehen. Die Bauzeit betrug drei Jahre.",
        ),
        (
            '''<table id="enveloppe"><tr><td class="gauche"><ul><li><a href=1>Accueil</a><li><a href=2>Culture</a></ul></td><td class="corps"><h1>Le marché</h1><p>Le marché du village ouvre chaque samedi matin, et les visiteurs
            viennent de loin.<p>On y trouve du fromage, du pain et des fleurs.<ul><li>Le pain est cuit au feu de bois.<li>Les fleurs viennent du sud.</ul></td></tr></table><div id="bas"><p>© Le Journal</p></div>''',
            "Le marché\nLe marché du village ouvre chaque samedi matin, et les visiteurs viennent de loin.\nOn y trouve du fromage, du pain et des fleurs.\nLe pain est cuit au feu de bois.\nLes fleurs viennent du sud.",
        ),
        (
            '<div class="ue"><a href=/>ホーム</a><a href=/n>ニュース</a></div><div class="honbun"><h1>新しい橋が開通</h1><p>月曜日に新しい橋が開通し、多くの人が集まりました。</p><p>市長は式典であいさつし、地域の発展に期待を示しました。</p></div><div class="shita">© 2024 新聞社</div>',
            "新しい橋が開通\n月曜日に新しい橋が開通し、多くの人が集まりました。\n市長は式典であいさつし、地域の発展に期待を示しました。",
        ),
        (
            "<div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div><div><h1>A plain page</h1><p>Nothing here has a name, yet the text is long enough to be told apart.</p><noscript><p>This part is for readers without scripts, and it is text like any other.</p></noscript><p>It ends here.</p></div>",
            "A plain page\nNothing here has a name, yet the text is long enough to be told apart.\nThis part is for readers without scripts, and it is text like any other.\nIt ends here.",
        ),
    ],
)
def test_pages_with_unknown_names_in_other_languages(page, expected):
    assert html_mincut.extract_text(page) == expected


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "</i>", "<a ", '<a ">" ', "<ul>", "<td></td>", "&", "<", "<!--", "<script></script ", "<table><tr><td>", "<li>a<p>"])
def test_a_megabyte_of_markup_takes_seconds(unit):
    import time

    page = "<b>x" * 20_000 + unit * (1_000_000 // len(unit)) + "</i>" * 20_000
    html_mincut.trained_weights()
    began = time.perf_counter()
    html_mincut.extract_text(page)
    assert time.perf_counter() - began < 5  # under 2 s on an idle core


def test_url_cases(spark):
    rules = [url_cascade.UrlRule("allow", "com", "/"), url_cascade.UrlRule("block", "example.com", "/en/"), url_cascade.UrlRule("allow", "www.example.com", "/en/")]
    urls = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/x?q#f", "http://a.example.com/en", "x://badexample.com/en/", None, "no scheme", "http://example.com", "a://b://c.com/", "http://com/\n", "", "http://example.com.evil.net/en/"]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)] + [(0, urls[0], "k", 1)], "page_id long, url string, key string, found int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages, rules).collect())

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        return host, path, best.key if best else None, best.verdict if best else "allow"

    assert got == sorted(((i, *judge(u)) for i, u in [*enumerate(urls), (0, urls[0])]), key=lambda x: (x[0],))
    assert url_cascade.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_cascade.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_cascade.build_cascade(universe, bits_per_key=4)
    assert len(levels) > 2
    assert universe.where(url_cascade.member(F.col("key"), levels) != F.col("listed")).count() == 0


def test_many_listed_keys_in_linear_time(spark, monkeypatch):
    """A test of a key must not read the whole filter: a million listed keys, a million urls."""
    import time

    n = 1_000_000
    rules = spark.range(n).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"), F.concat(F.lit("h"), F.col("id"), F.lit(".example.org")).alias("host"), F.lit("/a/").alias("path"))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), 3 * F.col("id"), F.lit(".example.org/a/b?c")).alias("url"))
    began = time.perf_counter()
    judged = written(url_cascade.judge_urls(pages, rules, default="none"), "many-urls")
    assert time.perf_counter() - began < 150
    want = F.when(3 * F.col("page_id") >= n, "none").when(F.col("page_id") % 2 == 0, "block").otherwise("allow")
    assert judged.count() == n and judged.where(F.col("verdict") != want).count() == 0
    # beyond the bound of one filter keys are judged slice by slice, with the same results
    monkeypatch.setattr(url_cascade, "MAX_LEVEL_BITS", 1000)
    few, some = rules.limit(0).unionByName(rules.where("substring(host, 2, 10) LIKE '__.%'")), pages.where("page_id < 60")
    assert some.count() == url_cascade.judge_urls(some, few, default="none").where(F.col("verdict") == F.when(~F.col("page_id").between(4, 33), "none").when(F.col("page_id") % 2 == 0, "block").otherwise("allow")).count()


def test_long_hosts_and_oversized_filters(spark):
    rules = [url_cascade.UrlRule("block", "b.c", "/"), url_cascade.UrlRule("allow", "b.c", "/")]
    urls = ["http://" + "a." * 20_000 + "b.c/x", "http://" + "a." * 20_000 + "c/x", "http://b.c/" + "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["verdict"] for r in url_cascade.judge_urls(pages, rules, default="none").orderBy("page_id").collect()] == ["block", "none", "block"]
    with pytest.raises(ValueError):
        url_cascade.judge_urls(pages, [url_cascade.UrlRule(str(i), "b.c", "/") for i in range(17)])


def test_wavelet_cases(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "Hello, wörld!! It's", "s"), (2, None, "s"), (9, "", "s"), (2, "repeat", "s"), (None, "no id", "s"), (7, "x" * 5000 + " É́ ñ| a|b <|endoftext|> A<|ENDOFTEXT|> 12ab\u00a0c\u2028d\x1ce don't. a-. b… c…. (d).) é., e'., f/.. 9. Á.", "s"), (8, "word " * 30_000, "s")]
    df = docs_of(spark, rows)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.tokenize_to_shards(df, vocabulary, 2).collect())
    tokenizer, start, want = Tokenizer.from_file(vocabulary), 0, []
    for i, text, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "") if r[1] is None else "\0" + r[1])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((-1 if i is None else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert wavelet.tokenize_to_shards(df.limit(0), vocabulary, 2).count() == 0


def test_words_with_decomposed_capitals():
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(vocabulary), wavelet.WordEncoder(vocabulary)
    pairs = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts = [*pairs, "Some J\u0331\u030c, (W\u030aords). J\u0591\u030c X\u2014Y \u00c9T\u0308A. J\u1dc4\u030c\u0301 PLAIN", "a < H\u0331", *[" ".join(chr(c) + chr(m) + "S." for m in range(0x2F0, 0x380)) for c in range(65, 91)]]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text[:60])


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (700, 1), (3000, 50), (5000, 40_000), (1 << 16, 9), (200_000, 30_000)])
def test_wavelet_matrix_against_arrays(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint16) + np.uint16(3)
    data = b"".join(wavelet.dump_shard(ids, [1, None], np.array([n // 2, n - n // 2])))
    asked = []
    shard = wavelet.ShardFile(lambda at, size: asked.append(size) or data[at : at + size])
    matrix = shard.matrix
    assert shard.docs == [1, None] and shard.lengths.sum() == n
    assert (matrix.decode() == ids).all()
    if n:
        at = np.arange(0, n, max(1, n // 200))
        assert (matrix.access(at) == ids[at]).all() and (matrix.access([n - 1]) == ids[-1:]).all()
        token = int(ids[n // 2])
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where) and matrix.rank(token, n // 3) == (where < n // 3).sum()
        assert [matrix.select(token, k) for k in range(min(3, len(where)))] == where[:3].tolist()
        assert matrix.occurrences(token) == where.tolist() and matrix.select(token, len(where)) == -1
    assert matrix.count(1) == 0 and matrix.select(1, 0) == -1


def test_queries_read_a_part_of_a_shard():
    ids = np.random.default_rng(3).integers(0, 40_000, 2_000_000).astype(np.uint16)
    data, asked = b"".join(wavelet.dump_shard(ids, [1], np.array([len(ids)]))), []
    matrix = wavelet.ShardFile(lambda at, size: asked.append(size) or data[at : at + size]).matrix
    assert matrix.access([1_234_567])[0] == ids[1_234_567]
    assert matrix.count(int(ids[5])) == (ids == ids[5]).sum()
    assert sum(asked) < len(data) / 5


def test_shards_close_at_a_bound(spark, tmp_path):
    """Files hold no more tokens than the bound, one long document aside; ids and starts stay the same."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    df = docs_of(spark, [(i % 90, f"word{i} " * (i % 17), "s") for i in range(300)] + [(45, "long " * 5000, "s")])
    manifest = wavelet.write_shards(df, f"file://{tmp_path}/shards", vocabulary, 2, shard_tokens=500)
    sizes = [r["tokens"] for r in manifest.collect()]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 500 and max(sizes) > 5000
    key = lambda frame: sorted(tuple(-1 if x is None else x for x in r) for r in frame.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert key(wavelet.read_shards(manifest)) == key(wavelet.tokenize_to_shards(df, vocabulary, 2))


def test_mixing_cases(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 4}") for i in range(400)] + [(1000, None, "s0"), (1001, "", None), (1002, "a b c", None), (1002, "a b c", None), (None, "x", "s1")]
    df = docs_of(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[3] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    total = sum(s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for size, stated, target, taken in by.values():
        assert size == stated and target <= 3 * size + 1e-6 and abs(taken - target) <= 17
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    shared = mixing.share_targets(spark.createDataFrame([("a", 10, 1.0), ("b", 10, 3.0)], "source string, n long, w double"), 1.2)
    assert {r["source"]: r["target"] for r in shared.collect()} == {"a": pytest.approx(8.0), "b": pytest.approx(12.0)}


def test_mixing_of_many_sources(spark, monkeypatch):
    """Joined instead of broadcast, the same rows; one source holds a third of all."""
    rows = [(i, "w " * (1 + i % 5), None if i % 11 == 0 else f"s{i % 700 if i % 3 else 0}") for i in range(3000)]
    df = docs_of(spark, rows)
    want = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 10)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == want and len(want) == 3000
    assert mixing.mixed_documents(df).count() == sum(r["copies"] for r in mixing.mix_sources(df).collect())


def brute_components(rows, n=5):
    sets = []
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[a : a + n]) for a in range(len(w) - n + 1)})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 10**9), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies(seed, families, members):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for f in range(families):
        base = list(rng.choice(vocabulary, rng.integers(20, 90)))
        for _ in range(members):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3 % 10_007, " ".join(w)))
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 3, "block": 4}, {"max_ranked": 0}, {"block": 2}])
def test_jaccard_against_brute_force(spark, options):
    rows = near_copies(5, 12, 12) + [(20_001, None), (20_002, ""), (20_003, " \t\n"), (20_004, "Same few words"), (20_005, "same  few\nwords"), (20_006, "few"), (20_007, "a b c d e"), (20_008, "A b c d e"), (20_009, "É b c d e"), (20_010, "é b c d e")]
    df = docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, **options).collect())
    assert got == brute_components(rows)


def test_jaccard_removal(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(3, text, "s"), (1, text + " more", "s"), (1, text + " more", "s"), (None, text, "s"), (7, "", "s"), (7, "", "s"), (8, "quite another text of words here", "s"), (None, "a text without id stays here", "s")]
    df = docs_of(spark, rows)
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"][:7]) for r in kept.collect()) == [(0, "a text "), (1, text[:7]), (7, ""), (7, ""), (8, "quite a")]
    assert jaccard_join.drop_near_duplicates(df.limit(0)).count() == 0


def test_jaccard_of_long_texts_in_bounded_blocks(spark, monkeypatch):
    """Families of long texts are cut by their shingles, not by their number; the components stay the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 3000)
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 1500)] for _ in range(3)]
    rows = []
    for i in range(45):
        words = list(base[i % 3])
        for at in rng.integers(0, 1500, i // 3):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, [(*r, "s") for r in rows])).collect())
    assert got == sorted((i, c) for i, _, c in brute_components(rows)) and len({c for _, c in got}) >= 3


def test_jaccard_links_through_null_ids(spark, monkeypatch):
    words = lambda start, letter="w": " ".join(f"{letter}{i}" for i in range(start, start + 100))
    # 10 and 11 are linked only through a text without id; 20 has a near copy without id; the last two have none
    rows = [(10, words(0)), (None, words(8)), (11, words(16)), (20, words(0, "x")), (None, words(4, "x")), (None, words(0, "y")), (None, words(4, "y"))]
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    for most in (jaccard_join.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", most)
        got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.jaccard_components(df).collect())
        assert got == [(0, 0), (0, 0), (0, 10), (0, 20), (10, 10), (11, 10), (20, 20)]


def test_jaccard_removal_of_texts_that_share_an_id(spark):
    words = lambda start, letter="w": " ".join(f"{letter}{i}" for i in range(start, start + 100))
    alone = [(5, words(0, "a")), (5, words(0, "b")), (5, ""), (5, None), (None, words(0, "c")), (None, words(0, "d"))]
    near = [(6, words(0, "e")), (6, words(4, "e"))], [(None, words(0, "f")), (None, words(4, "f")), (None, words(4, "f"))], [(7, words(0, "g")), (7, words(0, "g")), (None, words(4, "g"))]
    rows = [*alone, *sum(near, [])]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_duplicates(docs_of(spark, [(*r, "s") for r in rows]).repartition(3)).collect()]
    assert len(kept) == len(alone) + len(near) and set(alone) < set(kept)
    assert all(len(set(group) & set(kept)) == 1 for group in near) and near[2][0] in kept


def brute_shards(rows, shards=16, seed=10):
    """Every row's shard and slot from one sorted list; a null id sorts first and is shown as -1."""
    strata = {}
    for i, text, source in rows:
        data = (text or "").encode()
        h = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
        strata.setdefault("~" if source is None else "s" + source, []).append((h, -1 if i is None else i, zlib.crc32(data), len(data) + 1))
    line = sorted(((2 * r - 1) / (2 * len(held)), name, row) for name, held in strata.items() for r, row in enumerate(sorted(held), 1))
    total = len(line)
    return [(row[1] or -1, p * shards // total, p - -(-(p * shards // total) * total // shards), row[3]) for p, (_, _, row) in enumerate(line)]


def test_sharding_cases(spark):
    rows = [(i, "t" * (i % 50), f"s{i % 3}" if i % 7 else "hot") for i in range(500)] + [(1000, None, None), (1001, "é", None), (1001, "é", None), (None, "x", "s1")]
    df = docs_of(spark, rows)
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(16))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    totals = {}
    for r in got:
        totals[r["source"]] = totals.get(r["source"], 0) + 1
    for v in by.values():  # every shard matches the mixture to within a row or two
        for source, n in totals.items():
            assert abs(sum(r["source"] == source for r in v) - n / 16) <= 2
    facts = {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert (1000, 1, 0) in facts and (1001, 3, zlib.crc32("é".encode())) in facts
    assert sorted((r["doc_id"] or -1, r["shard"], r["slot"], r["size"]) for r in got) == sorted(brute_shards(rows))
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_documents(df.repartition(9)).collect()))
    assert sharding.shard_documents(df.limit(0)).count() == 0
    few = sharding.shard_documents(df.where("doc_id < 5")).collect()
    assert max(sum(r["shard"] == s for r in few) for s in range(16)) == 1


def test_ascii_lower(spark):
    assert spark.range(1).select(ascii_lower(F.lit("AZaz[É")).alias("x")).first()["x"] == "azaz[É"
