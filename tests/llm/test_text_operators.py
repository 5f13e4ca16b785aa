"""Text operators on small fixtures: brute force, round trips and held-out accuracy."""

import os
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, language, packing, quality, tokencount, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TABLES = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "a", "a<|endoftext|>b", "  two  spaces \n\n x　y\x1c z", "it's they've I'LL", "é" * 40, "x" * 3000, "\t\tq\r\n", "<|endoftext|>"]


def odd_docs(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(1, ""), (5, ODD[5])]
    return spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit(7), "score": F.lit("clash"), "label": F.lit(1), "held_out": F.lit("x"), "lang": F.lit(None).cast("string")}), rows


def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string, source string")


# packing


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    e = packing.encoder_of(TOKENIZER)
    assert e.fast is not None
    rng = random.Random(4)
    texts = [x for x in ODD if x] + ["".join(rng.choice("ab 1.,!'éß\n\t 中") for _ in range(rng.randrange(80))) for _ in range(300)]
    for x in texts:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_encoder_takes_long_white_space(blank):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), packing.TextEncoder(TOKENIZER)
    for n in (packing.LONGEST_BLANK, packing.LONGEST_BLANK + 1, 2_000_000):
        x = "a b" + blank * n + "c  d"
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), n


def test_pack_long_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "c")], DOCS)
    out = packing.pack(docs, TOKENIZER, 1024).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = len(packing.encoder_of(TOKENIZER).encode("a" + " " * 2_000_000 + "b")) // 4 + 1
    assert {r.doc_id: r.n for r in out} == {1: want, 2: 2} and want > 1_000_000


def test_pack_odd(spark):
    docs, rows = odd_docs(spark)
    out = packing.pack(docs, TOKENIZER, 64).toPandas()
    e = packing.encoder_of(TOKENIZER)
    want = {}
    for d, t in rows:
        ids = e.encode(t) + packing.END
        want.setdefault(d, []).append(len(ids) // 4)
    assert out["length"].sum() == sum(sum(v) for v in want.values()) and out["length"].max() <= 64
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and (g.offset + g["length"]).iloc[-1] <= 64
        assert (g.offset.to_numpy()[1:] == (g.offset + g["length"]).to_numpy()[:-1]).all()
    long = out[out.doc_id == 8].sort_values("piece")
    ids = e.encode(ODD[8]) + packing.END
    for r in long.itertuples():
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert (long["length"].to_numpy()[1:] == 64).all()
    assert packing.pack(empty(spark), TOKENIZER, 64).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        budget = rng.randrange(5, 40)
        counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, budget + 1), rng.randrange(1, min(12, budget)))}
        plan, bins = packing.best_fit_decreasing(counts, budget)
        places = {}
        for length, rank, first, each, offset in plan.tolist():
            later = [r for n, r, *_ in plan.tolist() if n == length and r > rank]
            for i in range((min(later) if later else counts[length]) - rank):
                places.setdefault(first + i // each, []).append((offset + i % each * length, length))
        for own in places.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= budget
        assert sum(len(x) for x in places.values()) == sum(counts.values())
        left = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [x for x in left if x >= n]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(budget - n)
        assert len(places) == bins == len(left)


def test_capacity_tree():
    tree = packing.CapacityTree(20)
    assert tree.tightest(3) is None
    for c in (5, 9, 20):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 5, 6, 9, 10, 20)] == [5, 5, 9, 9, 20, 20]
    tree.add(9, -1)
    assert tree.tightest(6) == 20


# token counts


def test_longest_match_brute():
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"bc", b"bcde", b"cdef", b"aaaa", b"xyz"]
    automaton, known = tokencount.LongestMatch(vocabulary), set(vocabulary)
    rng = random.Random(1)
    for _ in range(400):
        x = bytes(rng.choice(b"abcdefxyz") for _ in range(rng.randrange(30)))
        at = n = 0
        while at < len(x):
            at += max(k for k in range(1, 5) if x[at : at + k] in known)
            n += 1
        assert automaton.count(x) == n
    with pytest.raises(ValueError):
        tokencount.LongestMatch([b"ab"])


def test_token_counts_table(spark):
    docs, rows = odd_docs(spark)
    out = tokencount.count_tokens(docs, TOKENIZER).collect()
    assert len(out) == len(rows) and all(r.n_tokens == 0 for r in out if r.doc_id in (0, 1))
    assert {r.n_bytes for r in out if r.doc_id == 8} == {3000}
    assert tokencount.count_tokens(empty(spark), TOKENIZER).count() == 0


# decontamination


ITEM = "The quick brown fox jumps over the lazy dog while seventeen zebras watch from the northern hill, and nobody at the station minds it."


def edit_distance(a, b):
    row = [0] * (len(b) + 1)  # free start
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)  # free end


def test_leaks_against_alignment(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta north south river stone light paper".split()
    rows, want = [], set()
    for i in range(60):
        body = " ".join(rng.choice(words) for _ in range(80))
        passage = list(ITEM)
        for _ in range(i % 12):
            k = rng.randrange(len(passage))
            passage[k : k + 1] = rng.choice([[], ["q"], [passage[k], "z"]])
        text = body + " " + "".join(passage).upper() + " " + body if i % 3 else body
        rows.append((i, text))
        low, item = text.lower(), ITEM.lower()
        for s in sorted({*range(0, len(item) - 100 + 1, 25), len(item) - 100}):
            if edit_distance(item[s : s + 100], low) <= 6:
                want.add(i)
    docs = spark.createDataFrame([*rows, (None, ITEM), (99, None), (98, "")], DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, ITEM), (None, "x" * 90), (8, None), (9, "short")], "item_id long, text string")
    for block in (8_000_000, 60):  # a benchmark in one block, and in several
        got = decontaminate.find_leaks(docs, bench, block_bytes=block).collect()
        assert {r.doc_id for r in got if r.doc_id is not None} == want and {r.item_id for r in got} == {7}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty(spark), bench).count() == 0


def test_leaks_of_short_items_and_parts(spark, monkeypatch):
    """Items from Q bytes on, one row a document and item whatever the blocks, and long texts in parts."""
    short = "What is the capital of Peru? Lima."
    bench = spark.createDataFrame([(1, short), (2, "2 + 2 = 4!!!"), (3, "short")] + [(4, f"{i} {ITEM[:60]} {i * 7919}") for i in range(6)], "item_id long, text string")
    rows = [(1, "Well: " + short.upper() + " Yes."), (2, "2 + 2 = 4!!!"), (3, "2 + 2 = 5!!!"), (4, "What is the capital of Chile? Santiago."), (6, " ".join(f"{i} {ITEM[:60]} {i * 7919}" for i in range(6))), (6, short), (6, short), (None, short), (None, short)]
    rows.append((5, "".join(random.Random(3).choice("abcdef ") for _ in range(9000)) + ITEM[:60] + short + "z" * 40))
    docs = spark.createDataFrame(rows, DOCS)
    seen = set()
    for block in (8_000_000, 60):
        for part in (2_000_000, 500):
            monkeypatch.setattr(decontaminate, "PART_BYTES", part)
            got = decontaminate.find_leaks(docs, bench, block_bytes=block).collect()
            assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 2), (5, 1), (6, 1), (6, 4)]
            seen.add(tuple(sorted(map(str, got))))
    assert len(seen) == 1 and {r.doc_id: r.start for r in got if r.item_id == 1}[5] == 9060


def test_leaks_of_common_grams(spark, monkeypatch):
    """q-grams with too many pairs of places lower the bound; windows of nothing else are aligned with what surrounds them."""
    rule = "=" * 60
    items = [f"question {i}: {rule} answer {i * 37}" for i in range(20)] + ["=" * 100, "-" * 90 + "end of it"]
    texts = [rule * 30, "a " + items[3] + " b", "a " + items[5].replace("answer", "anzwer") + rule * 8, "so " + "=" * 97 + " no", "question 7: " + "=" * 30 + "x" * 9 + "=" * 21 + " answer 259", "-" * 200, "x" + "-" * 89 + "end of it", "nothing here at all, really nothing"]
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            w = min(100, len(item))
            budget = min(int(0.06 * w), (w - 12) // 12)
            want |= {(d, k) for s in {*range(0, len(item) - w + 1, w // 4), len(item) - w} if edit_distance(item[s : s + w], t) <= budget}
    docs, bench = spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (100, 2_000_000):
        monkeypatch.setattr(decontaminate, "PAIRS", most)
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want
    assert (1, 3) in want and (2, 5) in want and (0, 20) in want


# classifiers


def prose(rng, syllables, n=60):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(3)
    sets = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "ein", "tz"], "cc": ["ção", "lh", "os", "que"]}
    rows = [(i, prose(rng, sets[k]), k) for i, k in enumerate(rng.choices(list(sets), k=240))]
    rows += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, prose(rng, sets["aa"]), "aa"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("clash"))
    out = {(r.doc_id, r.lang_pred): r for r in language.identify(docs).collect()}
    truth = {d: k for d, _, k in rows[:240]}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and sum((d, truth[d]) in out for d in held) / len(held) > 0.98
    assert all(out[d, "und"].rejected and out[d, "und"].score == 0 for d in (900, 901, 902))
    assert sum(r.rejected for (d, _), r in out.items() if d in truth) == 0
    foreign = spark.createDataFrame([(1, "xqzj wvkx " * 40)], DOCS)
    model = language.fit([(d, t, k) for d, t, k in rows[:240]])
    assert language.predict(foreign, model).first().rejected
    assert language.identify(docs.limit(0)).count() == 0
    assert language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
def test_language_left_out(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").where("lang is not null and n_chars > 300").select("doc_id", "text", "lang").toPandas()
    parts = {k: g.sort_values("doc_id").head(600) for k, g in docs.groupby("lang")}
    for left_out in parts:
        learned = [r for k, g in parts.items() if k != left_out for r in g.head(400).itertuples(index=False, name=None)]
        model = language.fit(learned)
        foreign = language.predict(spark.createDataFrame(parts[left_out].tail(200)[["doc_id", "text"]]), model)
        assert foreign.where("rejected").count() >= 0.9 * 200, left_out
        known = [r[:2] for k, g in parts.items() if k != left_out for r in g.tail(200).itertuples(index=False, name=None)]
        clean = language.predict(spark.createDataFrame(known, DOCS), model)
        assert clean.where("rejected").count() <= 0.01 * len(known), left_out


def test_language_limits_by_length():
    rng = random.Random(9)
    texts = [prose(rng, ["ka", "to", "mi", "ren", "so"], n) for n in (20, 40, 80, 160, 320) * 40]
    model = language.fit([(i, t, "aa") for i, t in enumerate(texts)])
    mean, between, within = model.limits[0]
    # texts of one source differ by chance only, however long they are
    assert between < 0.1 and 0.1 < within < 3 and 0 < mean < 3


def test_kneser_ney_sums_to_one():
    model = language.fit([(1, "abab abba baab aabb", "x"), (2, "abab", "x")])
    letters = sorted({c for c in "ab "})
    # every seen order-1 probability is interpolated with a uniform share, so the mass of seen characters stays below 1
    keys, values = model.grams[1]
    assert len(keys) == len(letters) and 0.5 < np.exp(values[:, 0]).sum() < 1


def test_quality_held_out(spark):
    rng = random.Random(8)
    good = lambda: "\n".join(prose(rng, ["ka", "to", "mi"], 12).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    bad = lambda: "\n".join(prose(rng, ["ka", "to", "mi"], 12).upper().replace(" ", "!! ") for _ in range(rng.randrange(1, 6)))
    rows = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(200)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(500, None), (501, ""), (502, "\n\n"), (None, "A b.")], DOCS).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(d, y, 0) for d, _, y in rows] + [(None, 1, 0), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(d, y) for d, _, y in rows if out[d].held_out]
    assert held and all(out[d].predicted == y for d, y in held)
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 204
    assert out[500].score == out[501].score == out[502].score
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_forward_backward_brute():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    odds, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, pairs = quality.chain(odds, trans, lines, np.ones(len(lines)))
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in lines:
        mass, marg, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            marg += w * np.array(y)
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += w
        want += list(marg / mass)
        expected += pair / mass
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, expected)


def test_toxicity_gradients():
    net = toxicity.Network(["ab", "cde"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, index = ["ab", "cde", "xyzw", "q"], np.array([[0, 1, 2, 3, 0, 0], [3, 2, 1, 0, 0, 0]])
    mask, y, w = np.array([[1, 1, 1, 1, 1, 0], [1, 0, 1, 0, 0, 0]], bool), np.array([1.0, 0.0]), np.array([0.7, 0.3])

    def loss():
        logit = net.windows(net.project(words)[0], index, mask)[0]
        return float((np.logaddexp(0, np.where(y == 1, -logit, logit)) * w).sum() / w.sum())

    g = net.gradients(words, index, mask, y, w)
    for k, at in {"word": (1, 3), "w": (20, 40), "uf": (2, 3), "ub": (5, 6), "cuf": (1, 2), "ow": (3, 0), "ob": (0,), "av": (2, 0)}.items():
        v = net.p[k]
        old = v[at]
        v[at] = old + 1e-2
        up = loss()
        v[at] = old - 1e-2
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-5 + 0.02 * abs(g[k][at]), k


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    words = [prose(rng, ["ka", "to", "mi", "ren", "so"], 1) for _ in range(120)]

    def text(bad):
        out = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if bad:
            for _ in range(1 + len(out) // 20):
                out[rng.randrange(len(out))] = rng.choice(["vilegrub", "badworm"])
        return " ".join(out)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(160)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(500, None), (501, ""), (502, "!!"), (None, "ka to")], DOCS).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(d, y) for d, _, y in rows if out[d].held_out]
    assert held and np.mean([out[d].predicted == y for d, y in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 164
    assert all(out[d].predicted == 0 for d in (500, 501, 502))
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).where("predicted <> 0").count() == 0


def test_windows_cover_whole_texts():
    owner, index, mask = toxicity.cut([5, 64, 65, 1000], [np.arange(5), np.arange(64), np.arange(65), np.arange(1000)])
    for d, n in enumerate((5, 64, 65, 1000)):
        own = owner == d
        assert set(index[own][mask[own]]) == set(range(n))
    assert not re.search("_", "".join(toxicity.WORDS.findall("a_b")))


def test_long_texts_in_parts(spark, monkeypatch):
    """Parts of long texts give what whole ones give: counts, languages, windows; lines but for the chain's start."""
    rng = random.Random(6)
    words = ["alpha", "beta", "x" * 60, "Gamma's", "1234", "\u3000", "d\u00e9j\u00e0", "\n", "  ", "."]
    long = "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(4000))
    docs = spark.createDataFrame([(1, long), (2, "z" * 9000), (3, long[:900]), (4, None)], DOCS)
    count = lambda: sorted(map(tuple, tokencount.count_tokens(docs, TOKENIZER).collect()))
    rows = [(i, " ".join(rng.choice(["good", "day", "to", "all"] if i % 2 else ["vile", "scum", "to", "all"]) for _ in range(90)), i % 2) for i in range(60)]
    net = toxicity.fit(rows, steps=20, pretraining=10)
    tox = lambda: [(r.doc_id, round(r.score, 5), r.n_windows) for r in toxicity.score(docs, net).orderBy("doc_id").collect()]
    model = language.fit([(i, t, "ab"[i % 2]) for i, t, _ in rows])
    lang = lambda: [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.predict(docs, model).orderBy("doc_id").collect()]
    field = quality.fit(rows)
    lines = lambda: [(r.doc_id, r.n_lines) for r in quality.score(docs, field).orderBy("doc_id").collect()]
    whole = count(), tox(), lang(), lines()
    before = tokencount.pieces
    for module in (tokencount, language, toxicity):
        monkeypatch.setattr(module, "pieces", lambda text, breaks: before(text, breaks, 300))
    monkeypatch.setattr(toxicity, "LONG", 1000)
    monkeypatch.setattr(toxicity, "PART_WORDS", 300)
    monkeypatch.setattr(quality, "PART_BYTES", 700)
    assert (count(), tox(), lang(), lines()) == whole and sum(n for *_, n in whole[0]) > 5000


def test_sample_reaches_the_driver_bounded(spark):
    """One id 20,000 times, and long texts: at most the limit and the bytes of a class arrive, whatever the partitions."""
    from tilewright.llm import samples

    many = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"))
    rows = spark.range(400).select((F.col("id") + 10).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    docs = many.unionByName(rows)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    got = samples.labelled(docs.repartition(7), labels, "toxic", 60)
    assert got == samples.labelled(docs.repartition(2), labels, "toxic", 60) and len({d for d, *_ in got}) == len(got) == 120
    assert samples.labelled(docs, labels, "toxic", 1000) and len(samples.labelled(docs, labels, "toxic", 1000)) == 401
    assert sum(len(t) for _, t, y in samples.labelled(docs, labels, "toxic", 1000, most_bytes=100) if y == 0) <= 100
    named = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    assert len(samples.by_class(named, "lang", 60)) == 120 and samples.by_class(named.limit(0), "lang", 60) == []
