"""Near copies, repeats, archives, vectors and the pipeline against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from tilewright.llm import minhash, repeats, vectors, warc
from tilewright.llm.components import connected_components

DOCS = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30) + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 3 + g % 2, " ".join(own).upper() if rng.random() < 0.3 else "  ".join(own)))
    return [*rows, (1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "One\nTWO"), (None, rows[0][1]), rows[5], (1005, "one two three")]


def test_near_duplicates_brute(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(7).withColumns({"n": F.lit("x"), "component_id": F.lit("clash")})
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    want = brute_components(rows)
    sizes = {d: len(shingles(t)) for d, t in rows}
    for r in out:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.n_shingles == sizes[r.doc_id]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_links_that_a_star_misses(spark, monkeypatch):
    """A chain of neighbours in one bucket: only its middle links are over the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"t{i}" for i in range(400)]
    rows = [(100 + i, " ".join(base[14 * i : 14 * i + 150])) for i in range(10)] + [(i, " ".join(rng.choice(base) for _ in range(150))) for i in range(5)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == brute_components(rows)


def test_words_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["Ab", " ", "\n", "é", "longword"]) for _ in range(n)) for n in (400, 0, 3, 900, 50)] + ["x" * 300, " " * 200]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = minhash.shingle_sets(raw, offsets)
    monkeypatch.setattr(minhash, "PART_BYTES", 100)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, minhash.shingle_sets(raw, offsets), strict=True))
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    for share in (0.5, 0.9):
        b = np.unique(np.concatenate([a[: int(share * 400)], rng.integers(0, 2**64, 400 - int(share * 400), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.13
    assert (minhash.signature(a[:1]) == a[0]).all() and set(minhash.signature(a[::80])) == set(a[::80])


def test_components_brute(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if d is not None:
                first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if d is not None and first[b[k : k + 50]] < d:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = random.Random(2)
    base = "".join(rng.choice("ab c") for _ in range(300))
    return [
        (5, base), (3, base[40:140] + "xx" + base[100:290]), (None, base), (9, "The " * 500), (2, "The " * 30), (7, None), (8, ""), (5, base), (5, base[:120] + "é" * 60), (11, "é" * 70),
        (12, base[10:59]), (13, base[10:60]), (14, base[10:61]), (15, base[10:60]), (16, "q" + base[200:300] * 2), (17, base[250:300] + base[:49]),
    ]


def test_repeats_brute(spark):
    rows = repeat_rows()
    for n in (1, 5):
        df = spark.createDataFrame(rows, DOCS).repartition(n).withColumn("start", F.lit("clash"))
        assert sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_common_anchors(spark, monkeypatch):
    """Anchors dealt out window by window give the same result."""
    rows = repeat_rows()
    monkeypatch.setattr(repeats, "_common_cells", lambda docs, buckets: np.ones(repeats.CELLS, bool))
    assert sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()), key=str) == brute_repeats(rows)


def test_anchor_counts_cover_all_texts(spark):
    rows = [(i, "common words that stand in all of the texts of this small table, and then " + hashlib.sha256(bytes([i])).hexdigest() * 2, 0) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, tag int").select("doc_id", "tag", "text").repartition(5)
    before, repeats.MANY = repeats.MANY, 60
    try:
        cells = repeats._common_cells(texts, 1000)
    finally:
        repeats.MANY = before
    seen = {}
    for _, t, _ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        for c in repeats._cell(repeats.Suffixes(raw, np.array([0, len(raw)])).anchors()).tolist():
            seen[c] = seen.get(c, 0) + 1
    assert set(np.flatnonzero(cells)) == {c for c, n in seen.items() if n >= 60} and cells.any()


def test_repeats_of_long_texts_in_parts(spark, monkeypatch):
    """Parts, chunks of keys and Arrow batches may end anywhere."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcd ") for _ in range(6000))
    rows = [(1, base), (2, base[3000:] + base[:3100]), (3, base[:999] + "x" + base[1000:]), (4, "-" * 3000), (5, "-" * 120), (6, base[100:160] * 40), *((10 + i, base[50 * i : 50 * i + 400]) for i in range(30))]
    monkeypatch.setattr(repeats, "BLOCK", 700)
    monkeypatch.setattr(repeats, "CHUNK_WINDOWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str) == brute_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_without_repeats_keeps_whole_characters(spark):
    rows = [(1, "ä" * 40 + "b" * 40, None, "s", 80), (2, "x" + "ä" * 40 + "c", "en", None, 42), (3, "ä" * 40, "de", "s", 40), (4, "", "de", "s", 0), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long")
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "xc" and got[2].n_chars == 2 and got[5].text is None and got[1].text == rows[0][1]


def test_packed_columns():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 2**60, 7), rng.integers(0, 200, 7)]
    back = repeats.unpack(repeats.pack(cols, ("<i8", "u1")), ("<i8", "u1"))
    assert all((a == b).all() for a, b in zip(cols, back, strict=True))


PAGES = "page_id long, url string, html string"


def page_rows():
    return [(5, "http://a/1", "<p>é</p>"), (2, "http://a/2 x\n", "<p>é</p>"), (9, None, None), (4, "", ""), (7, "u", "<p>é</p>"), (None, "n", "z"), (8, "v", "x" * 5000), (8, "w", "y"), (10, "u", "y")]


def test_archive_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit("clash"))
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, shard_bytes=50, roll_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    out = warc.read(spark, folder).collect()
    first = {}
    for d, _, h in rows:
        if d is not None:
            first[h or ""] = min(d, first.get(h or "", d))
    assert len(out) == len(rows)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out)
    want = []
    for d, _, h in rows:
        b = (h or "").encode()
        revisit = d is not None and first[h or ""] < d
        want.append((d is None, d or 0, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else -1))
    assert got == sorted(want)
    assert {r.payload for r in out if r.record_type == "response" and r.page_id == 8} == {b"x" * 5000, b"y"}
    again = warc.write(pages.repartition(5), f"file://{tmp_path}/b", shard_bytes=50, roll_bytes=300)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))  # the same bytes in the same files
    assert not [p for p in (tmp_path / "a" / "_temporary").iterdir()]


def test_archive_shards_follow_bytes(spark):
    """One far id, null ids and a long payload do not crowd the shards."""
    rows = [(i, f"u{i}", "x" * 10) for i in range(400)] + [(10**15, "far", "y"), (None, "n", "z"), (500, "long", "w" * 40_000)]
    pages = spark.createDataFrame(rows, PAGES)
    hashed = warc._hashed(pages)
    sharded, n = warc._sharded(hashed, hashed.select("page_id", "n_bytes"), 6100)
    got = sharded.select("page_id", "shard").collect()
    of = {r.page_id: r.shard for r in got}
    sizes = {}
    for d, _, h in rows:
        sizes[of[d]] = sizes.get(of[d], 0) + len(h) + warc.RECORD_BYTES
    known = [of[d] for d in sorted(d for d in of if d is not None)]
    assert known == sorted(known) and of[None] == -1 and max(v for k, v in sizes.items() if k != of[500]) <= 6100 + 1220 and len(set(of.values())) >= 41 and n == -(-sum(len(h) + 600 for d, _, h in rows if d is not None) // 6100)


def test_archive_names_the_response(spark, tmp_path):
    import gzip

    warc.write(spark.createDataFrame(page_rows(), PAGES), f"file://{tmp_path}/a")
    heads = {}
    for path in (tmp_path / "a" / "data").glob("*.gz"):
        for part in gzip.open(path).read().decode("utf-8", "replace").split("WARC/1.1\r\n")[1:]:
            fields = dict(x.split(": ", 1) for x in part.partition("\r\n\r\n")[0].split("\r\n"))
            heads[fields["WARC-Record-ID"]] = fields
    revisits = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert revisits and all(heads[h["WARC-Refers-To"]]["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] and heads[h["WARC-Refers-To"]]["WARC-Type"] == "response" for h in revisits)


def test_archive_limits(spark):
    pages = spark.createDataFrame(page_rows(), PAGES)
    out = {(r.page_id, r.payload_bytes): r.record_type for r in warc.archive(pages, min_revisit_bytes=3).collect()}
    assert out[9, 0] == out[4, 0] == "response" and out[7, 9] == "revisit" and out[10, 1] == "response"
    assert warc.archive(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(warc.warcinfo("x")[:-4]))


def vector_rows():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 20] + 0.3 * rng.standard_normal(16))]) for i in range(600)]
    rows[40] = (40, rows[41][1])
    same = rows[0][1]
    rows += [(700 + i, same) for i in range(30)]
    return rows, [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (2100, [1.0, 2.0]), (None, same)]


def test_search_recall_and_ties(spark):
    rows, odd = vector_rows()
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "score": F.lit("clash")})
    out = vectors.search(df, every=20, k=20, rerank=120).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    hit = n = 0
    assert set(out.query_id) == {i for i in ids if i % 20 == 0}
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        top = np.lexsort((ids, -np.round(s, 12)))[:20]
        hit, n = hit + len(set(ids[top]) & set(g.vec_id)), n + 20
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [s[ids == v][0] for v in g.vec_id], rtol=1e-12)
        pairs = list(zip(-g.score, g.vec_id, strict=True))
        assert pairs == sorted(pairs)
    assert hit / n > 0.9
    assert vectors.search(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4] + odd, "vec_id long, embedding array<float>")
    assert vectors.search(few).count() == 3


def test_search_euclidean(spark):
    rng = np.random.default_rng(12)
    x = (rng.standard_normal((600, 16)) * rng.uniform(0.2, 5, (600, 1))).astype(np.float32)  # norms that reorder inner products
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = vectors.search(df, every=20, k=10, rerank=120, measure="euclidean").toPandas()
    assert set(out.query_id) == set(range(0, 600, 20)) and 7 in set(out.vec_id)
    hit = 0
    for q, g in out.groupby("query_id"):
        distance = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        hit += len(set(np.argsort(distance)[:10]) & set(g.vec_id))
        assert np.allclose(-g.score, distance[g.vec_id]) and g.sort_values("rank").score.is_monotonic_decreasing
    assert hit / len(out) > 0.9
    with pytest.raises(ValueError, match="measure"):
        vectors.search(df, measure="cosine")


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = pipeline.drop_near_copies(spark, docs, "")
    want = brute_components([(d, r.text) for d, r in rows.items()])
    assert {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c} and kept.columns == docs.columns
    cut = pipeline.cut_repeats(spark, docs, "")
    sizes = {d: n - gone for d, n, gone, *_ in brute_repeats([(d, r.text) for d, r in rows.items()])}
    got = {r.doc_id: len(r.text.encode()) for r in cut.collect()}
    assert cut.columns == docs.columns and all(sizes[d] <= n <= sizes[d] + 200 for d, n in got.items())
    clean = pipeline.drop_leaks(spark, docs, "/root/testdata/sf0.001")
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    leaked = {d for d, r in rows.items() if any(t in r.text for t in items)}
    assert leaked and not leaked & {r.doc_id for r in clean.collect()} and clean.count() > 0.9 * len(rows)
