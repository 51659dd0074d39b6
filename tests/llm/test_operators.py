"""Training-data operators against brute force, on small tables with nulls, ties, repeats, empty and long texts."""

import functools
import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechjobs.llm import ctw, fingerprints, hashing, langid, mixing, near_dedup, packing, queries, sharding, suffix_dedup, topk, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(vocabulary, size=n))


def corpus():
    base = words(120, 1)
    near = base.split()
    near[60] = "other"
    passage = words(40, 7)
    texts = [
        (3, base, "en", "b"), (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (4, None, None, None), (5, "", "fr", "b"), (6, " \t\n", "fr", "c"), (7, "Un Deux trois", "fr", "c"), (8, "un deux TROIS", "fr", None),
        (9, words(50, 2) + " " + passage, "en", "a"), (10, passage + ". É " + words(60, 3), "fr", "a"), (None, base, "en", "a"), (None, "no id here", None, "b"), (7, "Un Deux trois", "fr", "c"), (11, "x" * 5000, "en", "a"),
        (12, words(3000, 4) + "\n" + words(3000, 5), "en", "d"), (13, "é" * 130 + "è" * 130, "fr", "d"), (14, "é" * 130, "fr", "d"), (15, "12 34 !!", "en", "d"),
    ]
    return [(i, t, l, s, len(t or ""), 0.5, 1, "k") for i, t, l, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)] + [(7, [1.0] * 6), (150, None), (151, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (152, [float("nan")] * 6), (None, [1.0] * 6), (200, [1.0, 2.0]), (201, [2.0, 1.0]), (50, [0.0] * 6), (0, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=40, block_queries=2).collect()}
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = {}
    for q in {i for i, _ in good if i % 50 == 0}:
        pool = sorted(((-sum(a * b for a, b in zip(v, w)), i) for j, v in good if j == q for i, w in good if i != q and len(v) == len(w)))
        expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(pool[:5])}
    assert got == expected
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_large_and_repeated_ids(spark):
    """Neighbouring ids above 2^53, some of them repeated, with equal vectors."""
    base = 1 << 53
    rows = [(base + i, [1.0, 2.0]) for i in range(4)] + [(base, [1.0, 2.0]), (base + 1, [1.0, 2.0]), (-(1 << 63), [3.0, 1.0]), ((1 << 63) - 1, [0.5, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == base, 5, block_rows=3).collect()]
    one = 256 * 256
    ties = sorted([base + 1, base + 2, base + 3, -(1 << 63)])
    assert sorted(got) == [(base, k + 1, v, 5 * one) for k, v in enumerate(ties)] + [(base, 5, (1 << 63) - 1, one // 2)]


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-9, 9, (4000, 2)).astype(float)
    vectors[17] = [500, 500]
    lists = topk.SortedLists(np.arange(4000), vectors)
    ids, scores = lists.search(np.array([3.0, 2.0]), -1, 1)
    assert ids.tolist() == [17] and scores.tolist() == [2500.0]
    assert lists.search(np.array([3.0, 2.0]), -1, 5, 2500.0)[0].tolist() == [17] and not len(lists.search(np.array([3.0, 2.0]), -1, 5, 2501.0)[0])


def test_sharding(spark, docs, empty):
    rows = sharding.assign_shards(docs, 5, rows_per_task=2).collect()
    assert len(rows) == len(corpus())
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and len({r.shard for r in rows if r.doc_id == 7}) == 1
    many = spark.range(20000).select(*[sharding.jump_shard(F.xxhash64("id"), n).alias(f"s{n}") for n in (1, 24, 25, 500, 501)]).collect()
    assert all(r.s1 == 0 for r in many)
    for a, b in ((24, 25), (500, 501)):
        moved = [(r[f"s{a}"], r[f"s{b}"]) for r in many if r[f"s{a}"] != r[f"s{b}"]]
        assert all(y == a for _, y in moved) and 0.5 / b < len(moved) / 20000 < 2 / b
    counts = Counter(r.s24 for r in many)
    assert len(counts) == 24 and max(counts.values()) < 1.25 * 20000 / 24
    assert sharding.assign_shards(empty, 3).count() == 0


def test_jumps_equal_a_plain_walk(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("key"))
    draws = keys.select("key", F.array(*[F.xxhash64("key", F.lit(i)) for i in range(1, 41)]).alias("draws"), *[sharding.jump_shard(F.col("key"), n).alias(f"s{n}") for n in (1, 2, 24, 25, 40)])
    for r in draws.collect():
        for n in (1, 2, 24, 25, 40):
            at, last, i = 0, -1, 0
            while at < n:
                last = at
                at = math.floor((at + 1) * 2.0**31 / (((r.draws[i] % 2**64) >> 33) + 1))
                i += 1
            assert r[f"s{n}"] == last


def test_shards_of_columns_with_any_names(spark):
    df = spark.createDataFrame([(i % 40, f"text {i}") for i in range(90)], "doc_id long, text string")
    plain = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.assign_shards(df, 4, ties=("text",), rows_per_task=5).collect()}
    names = ("__key", "__before", "key", "before", "part", "nth", "row", "rows", "a.b")
    odd = df.select("*", *[F.lit(n).alias(n) for n in names], F.lit("replaced").alias("slot"))
    got = sharding.assign_shards(odd, 4, ties=("text",), rows_per_task=5)
    assert got.columns == ["doc_id", "text", *names, "shard", "slot", "grown_shard"]
    for r in got.collect():
        assert (r.shard, r.slot) == plain[r.doc_id, r.text] and all(r[n] == n for n in names)


def test_slots_are_the_same_again(spark):
    rows = [(i % 3, f"text {i}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    runs = [sorted(map(tuple, sharding.assign_shards(df.repartition(n), 4, ties=("size",), rows_per_task=5).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def targets_by_rounds(sizes, weights, share, most):
    """Shares by weight, capped, with the excess shared again until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows = [(i, words(int(rng.integers(1, 60)), i), None if (s := int(rng.choice(5, p=[0.4, 0.3, 0.2, 0.07, 0.03]))) == 4 else f"s{s}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    got = mixing.mix_sources(df, rows_per_task=100).collect()
    sizes = {i: len(WORD.findall(t)) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += sizes[i]
    target = targets_by_rounds(by_source, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.copies <= 2 and r.target == pytest.approx(target[r.source]) and r.source_size == by_source[r.source]
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in by_source)
    again = mixing.mix_sources(df.repartition(7), rows_per_task=100)
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in got}
    mix = mixing.Mix().fit(df, 100)
    assert Counter(r.doc_id for r in mixing.apply_mix(df, mix).collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    odd = mixing.mix_sources(docs).collect()
    assert len(odd) == len(corpus()) and all(r.copies <= 2 for r in odd)
    assert mixing.mix_sources(empty).count() == 0 and all(r.target == 0 for r in mixing.mix_sources(docs.filter("doc_id in (5, 6)")).collect())


def mixed_plainly(rows, targets, merit, most, numbers):
    """Copies by id: the level of a source by halving, then ranks of all its documents in one list."""
    copies = {}
    for source in {s for *_, s in rows}:
        own = [(i, n, 2 ** (round(math.log2(merit(n)) * mixing.MERIT_STEPS) / mixing.MERIT_STEPS)) for i, n, s in rows if s == source]
        low, high = 0.0, 1e9
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(n * min(most, level * m) for _, n, m in own) < targets[source] else (low, level)
        expected = {i: min(most, low * m) for i, _, m in own}
        copies |= {i: math.floor(expected[i] + 1e-7) for i, *_ in own}
        need = targets[source] - sum(n * copies[i] for i, n, _ in own)
        odds = lambda p: p / (1 - p)
        taken = 0
        for _, i, n in sorted((odds(numbers[i]) / odds(expected[i] - copies[i]), i, n) for i, n, _ in own if expected[i] - copies[i] > 1e-7):
            if taken + n / 2 > need:
                break
            taken += n
            copies[i] += 1
    return copies


@pytest.mark.parametrize("many", [False, True])
def test_mixing_equals_plain_pareto_sampling(spark, monkeypatch, many):
    if many:  # as if the sources were too many to be broadcast
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = np.random.default_rng(4)
    rows = [(i, words(int(rng.lognormal(3, 1)) + 1, i), None if (s := int(rng.choice(5, p=[0.5, 0.3, 0.1, 0.07, 0.03]))) == 4 else f"s{s}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_size = F.log2(F.regexp_count("text", F.lit(r"\S+")) + F.lit(1.0))
    got = {r.doc_id: r for r in mixing.mix_sources(df, rows_per_task=50, merit=by_size).collect()}
    numbers = {r.doc_id: r["__u"] for r in df.withColumns(mixing.Mix().facts(df)).collect()}
    sized = [(i, len(WORD.findall(t)), s) for i, t, s in rows]
    totals = Counter()
    for _, n, s in sized:
        totals[s] += n
    expected = mixed_plainly(sized, targets_by_rounds(totals, (3, 1, 2), 1.5, 2), lambda n: math.log2(n + 1), 2, numbers)
    assert {i: r.copies for i, r in got.items()} == expected
    assert {0, 1, 2} == set(expected.values())


@pytest.mark.parametrize("text", ["the same words in each row", None])
def test_mixing_takes_repeats_of_an_id_one_by_one(spark, monkeypatch, text):
    """All rows of a source have one id; its target is no multiple of their words."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 50)
    rows = [(1, text or words(100, i), "a") for i in range(300)] + [(i, words(100, i), "b") for i in range(1000, 1080)] + [(None, "no id", "c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, share=0.8, rows_per_task=50)
    found = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(found) == 3 and all(abs(r.taken - r.target) <= 7 * r.most for r in found) and all(0 <= r.copies <= 2 for r in got.collect())
    again = mixing.mix_sources(df.repartition(5), share=0.8, rows_per_task=50).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert all(abs({r.source: r.taken for r in found}[r.source] - r.taken) <= 7 * 100 for r in again)


def test_mixing_prefers_merit(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(2000)] + [(i, "d e f", "t") for i in range(2000, 4000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights=(1, 1), share=0.5, merit=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    kept = Counter(r.doc_id % 2 for r in got if r.copies)
    assert 2.3 < kept[0] / kept[1] < 3.9


def test_source_targets_of_many_sources(spark):
    rng = np.random.default_rng(5)
    sizes = {f"s{i:04d}": int(rng.integers(1, 1000)) for i in range(2000)} | {None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2).collect()}
    expected = targets_by_rounds(sizes, (3, 1, 2), 1.5, 2)
    assert len(got) == len(sizes) and all(got[s] == pytest.approx(expected[s]) for s in sizes)


def test_fingerprints(spark, docs, empty):
    got = fingerprints.fingerprint_edits(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), task_bytes=2000).collect()
    texts = {i: t or "" for i, t, *_ in corpus() if i is not None}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        r = next(x for x in got if x.doc_id == i)
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (t != edited or r.near_edited == 1.0)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[3] != prints[2] and prints[4] == prints[5]
    assert len(fingerprints.fingerprint_edits(docs).collect()) == len(corpus()) and fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(docs.filter("doc_id = 1")).first().near_next == 1.0


def test_fingerprints_are_homomorphic(spark):
    v, p = fingerprints.multiset_vector, fingerprints.paragraphs
    row = spark.createDataFrame([("one\ntwo\nthree", "three\none", "two", "three\none\ntwo")], "a string, b string, c string, d string").select(
        (v(F.col("a")) == v(F.col("d"))).alias("order"), (fingerprints.insert(v(F.col("b")), v(F.col("c"))) == v(F.col("a"))).alias("add"), (fingerprints.delete(v(F.col("a")), v(F.col("c"))) == v(F.col("b"))).alias("take"),
        fingerprints.likeness(v(F.col("a")), p(F.col("a")), v(F.col("b")), p(F.col("b"))).alias("near"), (v(F.col("a")) == v(F.col("b"))).alias("same"),
    ).first()
    assert row.order and row["add"] and row.take and not row.same and 0.6 < row.near < 1


def test_fingerprints_equal_plain_sums(spark):
    """Sums, prints and likeness again by hand; only the hashes of paragraphs are asked of Spark. Some lanes wrap."""
    rng = np.random.default_rng(12)
    texts = ["", "one. two! three", "one. two! three\r\n\nfour", "\n".join(f"p{i}" for i in rng.integers(30, size=80)), "a\n" * 40_000]
    split = [[x for x in re.split(fingerprints.PARAGRAPH_END, t) if x] for t in texts]
    paragraphs = sorted({p for ps in split for p in ps})
    hashed = {r.p: [x % 2**64 for x in r.h] for r in spark.createDataFrame([(p,) for p in paragraphs], "p string").select("p", F.array(*[F.xxhash64(F.lit(i), "p") for i in range(fingerprints.WIDTH)]).alias("h")).collect()}

    def lanes(ps):
        total = [0] * (2 * fingerprints.WIDTH)
        for p, times in Counter(ps).items():
            for i, h in enumerate(hashed[p]):
                total[2 * i] += times * (h & 0xFFFF)
                total[2 * i + 1] += times * (h >> 32 & 0xFFFF)
        return [x % fingerprints.MODULUS for x in total]

    def near(a, b):
        x, y = ([v - len(ps) * 32767.5 for v in lanes(ps)] for ps in (a, b))
        dot = lambda p, q: sum(u * w for u, w in zip(p, q))
        return 1.0 if lanes(a) == lanes(b) and len(a) == len(b) else max(0.0, min(1.0, dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)))) if a and b else 0.0

    v, p = fingerprints.multiset_vector, fingerprints.paragraphs
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumns({"v": v(F.col("t")), "n": p(F.col("t"))})
    for r in df.select("i", "n", fingerprints.fingerprint(F.col("v"), F.col("n")).alias("print")).collect():
        values = lanes(split[r.i])
        assert r.n == len(split[r.i]) and r.print == f"{r.n:08x}" + "".join(f"{values[2 * k + 1]:08x}{values[2 * k]:08x}" for k in range(fingerprints.WIDTH))
    pairs = df.crossJoin(df.select(F.col("i").alias("j"), F.col("v").alias("w"), F.col("n").alias("m")))
    for r in pairs.select("i", "j", fingerprints.likeness(F.col("v"), F.col("n"), F.col("w"), F.col("m")).alias("near")).collect():
        assert r.near == pytest.approx(near(split[r.i], split[r.j]), abs=1e-9)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_follow_any_ids(spark, kind):
    """Repeated and missing ids, of integers and strings, over many ranges: every row's next is the one that comes next."""
    rng = np.random.default_rng(13)
    ids = [int(x) for x in rng.integers(-(10**12), 10**12, 60)]
    rows = [(i, words(20, k)) for k, i in enumerate(ids + ids[:6] + [None] * 12)] + [(ids[0], words(20, 0)), (None, "")]
    rows = [(None if i is None else i if kind == "long" else f"d{i}", t) for i, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("range", F.lit("clash")).repartition(5)
    got = fingerprints.fingerprint_edits(df, task_bytes=300).collect()
    ties = {r.text: r.tie for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    line = sorted([r for r in rows if r[0] is not None], key=lambda r: ties[r[1]])
    line = sorted(line, key=lambda r: r[0], reverse=True) + sorted([r for r in rows if r[0] is None], key=lambda r: ties[r[1]])
    expected = []
    for k, (i, t) in enumerate(line):
        third = len(t) // 3
        expected.append((repr(i), len(t), hashlib.sha256((t[: len(t) - third] + line[(k + 1) % len(line)][1][:third]).encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(expected)


def test_url_filters(spark):
    assert spark.createDataFrame([("https://u@A.b.Example.org:80/p/q?x",)], "u string").select(url_filters.url_keys(F.col("u"))).first()[0] == ["a.b.example.org/p", "a.b.example.org", "b.example.org", "example.org"]
    pages = [(1, "http://a.x.org/p", "2024-03-05"), (2, "http://x.org", "2024-01-01"), (3, None, "2024-03-05"), (4, "nonsense", "2024-03-05"), (5, "http://a.x.org/p", None), (6, "http://a.x.org/p", "2024-05-01"), (6, "http://a.x.org/p", "2024-05-01"), (7, "http://a.x.org/p", "2024-06-01")]
    entries = [("l", "x.org", "add", "2024-02-01", 0), ("l", "x.org", "remove", "2024-05-01", 1), ("m", "a.x.org", "add", "2024-03-05", 0), ("m", "a.x.org", "remove", "2024-03-05", 1), ("k", "x.org", "add", "2024-06-01", 0), ("l", None, "add", "2024-01-01", 0)]
    captures = spark.createDataFrame(pages, "page_id int, url string, day string").select("page_id", "url", F.to_date("day").alias("fetched"), F.lit(1).alias("list"))
    dated = spark.createDataFrame(entries, "list string, pattern string, action string, day string, seq int").select("list", "pattern", "action", F.to_date("day").alias("dated"), "seq")
    got = sorted((r.page_id, r.blocked, r.pattern, r.list, r.matches) for r in url_filters.filter_captures(captures, dated, "page_id", "url", "fetched").collect())
    assert [g[:2] for g in got] == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (6, False), (7, True)]
    assert got[0][2:] == ("x.org", "l", 1) and got[-1][2:] == ("x.org", "k", 1)
    assert url_filters.filter_captures(captures.limit(0), dated, "page_id", "url", "fetched").count() == 0
    assert not any(r.blocked for r in url_filters.filter_captures(captures, dated.limit(0), "page_id", "url", "fetched").collect())


def test_packing(spark, docs, empty):
    lengths = (64, 128, 256)
    for group_words in (10**9, 500):
        rows = packing.pack_documents(docs, lengths, group_words=group_words).collect()
        pieces = Counter()
        for r in rows:
            pieces[r.doc_id] += r.words
        expected = Counter()
        for i, t, *_ in corpus():
            if n := len(WORD.findall(t or "")):
                expected[i] += n
        assert pieces == expected
        for b in {r.bin for r in rows}:
            mine = sorted((r.bin_start, r.words) for r in rows if r.bin == b)
            assert all(x[0] + x[1] == y[0] for x, y in zip(mine, mine[1:])) and mine[0][0] == 0
            total, length = sum(w for _, w in mine), next(r.bin_length for r in rows if r.bin == b)
            assert total <= length and length == min(x for x in lengths if x >= total)
    assert packing.pack_documents(empty).count() == 0
    full = packing.pack_documents(docs, lengths, with_text=True).collect()
    texts = Counter()
    for r in sorted(full, key=lambda r: r.piece):
        assert len(WORD.findall(r.text)) == r.words
        texts[r.row_id] += r.words
    assert len(texts) == sum(bool(WORD.findall(t or "")) for _, t, *_ in corpus())
    long = sorted((r for r in full if r.doc_id == 12), key=lambda r: r.piece)
    assert [w for r in long for w in WORD.findall(r.text)] == WORD.findall(dict((i, t) for i, t, *_ in corpus())[12])


def test_packing_keeps_texts_out_of_the_packer(spark, monkeypatch):
    """A group holds sizes only, and every piece is what stands between its first and last word."""
    long = "".join(f" w{k}" + "\n" * (k % 3) for k in range(150))
    rows = [(1, long), (1, long), (None, "\tno id "), (2, None), (3, " \n"), (4, "\u00e9t\u00e9 " * 64)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lengths=(16, 64), with_text=True)
    plan = got._jdf.queryExecution().logical().toString()
    assert not any("text" in line for line in plan.split("\n") if "FlatMapGroupsInArrow" in line)
    starts = [m.span() for m in WORD.finditer(long)]
    expected = [(1, k, long[starts[64 * k][0] : starts[min(64 * k + 63, 149)][1]]) for k in range(3)] * 2
    expected += [(None, 0, "\tno id "), (4, 0, "\u00e9t\u00e9 " * 64)]
    assert sorted(((r.doc_id, r.piece, r.text) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), with_text=True).count() == 0


def packed_plainly(sizes, lengths):
    """Every set of lengths in turn; bins and what is still to come are looked through one by one."""
    plans = []
    for n in range(1, len(lengths) + 1):
        for opened in itertools.combinations(sorted(lengths), n):
            if max(sizes) > max(opened):
                continue
            left, bins, where = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [], {}
            while left:
                i = left.pop(0)
                fits = [(c - sum(m), b) for b, (c, m) in enumerate(bins) if c - sum(m) >= sizes[i]]
                if fits:
                    b = min(fits)[1]
                else:
                    room = sum(c - sum(m) for c, m in bins)
                    worth = lambda x: sizes[i] + min(x - sizes[i], max(0, sum(sizes[j] for j in left if sizes[j] <= x - sizes[i]) - room))
                    bins.append((min((packing.cost(x) / worth(x), x) for x in opened if x >= sizes[i])[1], []))
                    b = len(bins) - 1
                bins[b][1].append(sizes[i])
                where[i] = b
            shrunk = [min(x for x in lengths if x >= sum(m)) for _, m in bins]
            plans.append((sum(map(packing.cost, shrunk)), len(plans), [where[i] for i in range(len(sizes))], shrunk))
    return min(plans)[2:]


@pytest.mark.parametrize("with_text", [False, True])
def test_packing_spreads_rows_of_one_id(spark, with_text):
    df = spark.createDataFrame([(1, "ten words " * 5)] * 400 + [(None, "no id here")] * 100, "doc_id long, text string")
    got = packing.pack_documents(df, lengths=(16, 64), group_words=400, with_text=with_text).collect()
    groups = Counter(r.bin.split("-")[0] for r in got)
    assert sum(r.words for r in got) == 4300 and len(groups) > 5 and max(groups.values()) < 120 and len({r.row_id for r in got}) == 500


def test_packing_equals_plain_best_fit():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        for _ in range(4):
            sizes = np.minimum(rng.lognormal(6, 1.3, n).astype(int) + 1, 8192).tolist()
            assert packing.pack_sizes(sizes) == packed_plainly(sizes, packing.LENGTHS)
    assert packing.pack_sizes([]) == ([], [])


def test_packing_weighs_the_cost():
    # plenty of small pieces: the overhead speaks against the shortest length, attention against the longest
    lengths = Counter(packing.pack_sizes([40] * 5000)[1])
    assert lengths.most_common(1)[0][0] in (1024, 2048)
    assert packing.pack_sizes([40])[1] == [512]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 8192, 400).tolist()
    where, shrunk = packing.pack_sizes(sizes)
    naive = sum(packing.cost(min(x for x in packing.LENGTHS if x >= s)) for s in sizes)
    assert sum(map(packing.cost, shrunk)) < 0.97 * naive and len(where) == 400


def test_language_id(spark, docs, empty):
    english, french = "the cat sat on the mat with another thing that they thought", "le chat est dans la maison avec une autre chose qui était là"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((english if i % 2 else french).split())), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(i, "это просто русский текст про кота", "ru") for i in range(40, 44)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, english.upper()), (2, french), (3, (english + " ") * 4 + french * 2), (4, None), (5, "123 ..."), (6, ""), (7, "кота текст"), (8, "\U0001d400")], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(tests, model, keep=("spans",)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 4, 5, 6, 7)] == ["en", "fr", "und", "und", "und", "ru"] and got[4].score == 0 and got[4].spans == []
    assert [s.lang for s in got[3].spans] == ["en", "fr"] and got[3].lang_pred == "en" and 0.5 < got[3].score < 1
    mixed = (english + " ") * 4 + french * 2
    assert mixed[got[3].spans[1].start :].startswith("le chat") and got[8].lang_pred in ("en", "fr", "ru")
    assert {r.lang_pred for r in langid.identify(tests, langid.train(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0 and langid.identify(docs, model).count() == len(corpus())


def test_language_model_refuses_too_many(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="40 values"):
        langid.train(df, most_languages=39)
    names, table, _ = langid.train(df, most_languages=40)  # more than a task holds at once
    assert len(names) == 40 and np.allclose(np.exp(table).sum(0), 1, atol=1e-3)


def test_language_id_equals_counting_by_hand(spark):
    """Word scores, spans and shares again from plain dictionaries of trigrams."""
    rng = np.random.default_rng(9)
    letters = {"aa": list("abcdefgh"), "bb": list("defghijk"), "cc": list("бвгдежз")}
    word = lambda lang: "".join(rng.choice(letters[lang], int(rng.integers(2, 8))))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(i, " ".join(word(lang) for lang, n in mix for _ in range(n))) for i, mix in enumerate([[("aa", 12)], [("aa", 9), ("bb", 14)], [("cc", 5), ("bb", 9)], [("bb", 1)]])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}

    def trigrams(w):
        padded = [0, *map(ord, w), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) % 2**64
            yield x * 0xD6E8FEB86659FD93 % 2**64 >> 48

    counts = {lang: Counter(f for _, t, l in rows if l == lang for w in t.split() for f in trigrams(w)) for lang in letters}
    chance = {lang: lambda f, c=c, n=sum(c.values()): math.log((c[f] + 0.5) / (n + 0.5 * langid.FEATURES)) for lang, c in counts.items()}
    for i, t in tests:
        best, words_ = {}, t.split()
        for k, w in enumerate(words_):
            allowed = ["cc"] if w[0] >= "а" else ["aa", "bb"]
            own = {lang: sum(chance[lang](f) for f in trigrams(w)) for lang in allowed}
            best = {lang: max(((v - langid.SWITCH_PENALTY * (lang != last[-1]) if last else v, [*last, lang]) for v, last in best.values()), key=lambda x: x[0]) if best else (0.0, [lang]) for lang in allowed}
            best = {lang: (v + own[lang], path) for lang, (v, path) in best.items()}
        path = max(best.values(), key=lambda x: x[0])[1]
        share = Counter()
        for w, lang in zip(words_, path):
            share[lang] += len(w)
        top, n = share.most_common(1)[0]
        assert (got[i].lang_pred, round(got[i].score, 9)) == (top, round(n / share.total(), 9))
        assert [s.lang for s in got[i].spans] == [k for k, _ in itertools.groupby(path)]


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(2)
    score, doc = rng.normal(size=(12, 3)) * 3, np.array([0] * 5 + [2] * 6 + [3])
    got = langid.viterbi(score, doc, 2.0)
    for d in (0, 2, 3):
        rows = np.flatnonzero(doc == d)
        value = lambda path: sum(score[r, x] for r, x in zip(rows, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(value(p) for p in np.ndindex(*[3] * len(rows)))
        assert value(got[rows].tolist()) == pytest.approx(best)


def linked_components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])))
    label = [i for i, _ in sets]
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(len(sets)):
                s, t = sets[a][1], sets[b][1]
                same = sets[a][0] is not None and sets[a][0] == sets[b][0]
                if s and t and (same or 100 * len(s & t) >= 75 * len(s | t)) and label[b] is not None and (label[a] is None or label[b] < label[a]):
                    label[a], changed = label[b], True
    return [(i, len(s), c) for (i, s), c in zip(sets, label)]


def test_near_duplicates(spark, docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(linked_components([(i, t) for i, t, *_ in corpus()]))
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    base = words(300, 11, 10**6).split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        t = list(base)
        for p in rng.integers(300, size=int(rng.integers(2, 12))):
            t[p] = f"z{rng.integers(10**6)}"
        rows.append((i * 7 % 150, " ".join(t)))
    rows += [(500 + i, words(80, 1000 + i, 10**6)) for i in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(linked_components(rows))


def test_near_duplicates_of_any_ids(spark):
    """Ids next to 2^63, negative ones and strings; many rows without an id but with one text."""
    base, other = words(80, 1, 10**6), words(80, 2, 10**6)
    big = (1 << 62) + 5
    rows = [(big, base), (big + 1, base), ((1 << 63) - 1, base + " more"), (-(1 << 63), other), (-3, other + " more"), (5, words(80, 3, 10**6))] + [(None, words(80, 4, 10**6))] * 50
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {big: (big, True), big + 1: (big, False), (1 << 63) - 1: (big, False), -(1 << 63): (-(1 << 63), True), -3: (-(1 << 63), False), 5: (5, True), None: (None, True)}
    assert len(got) == len(rows) and len({r.group for r in got if r.doc_id is None}) == 1
    named = [(f"d{i}", t) for i, (_, t) in enumerate(rows[:6])] + [("", base), (None, base)]
    got = near_dedup.near_duplicates(spark.createDataFrame(named, "name string, body string").withColumn("group", F.lit(1)), "name", "body").collect()
    assert {r["name"]: r.component_id for r in got} == {"d0": "", "d1": "", "d2": "", "": "", None: "", "d3": "d3", "d4": "d3", "d5": "d5"}


def test_near_duplicates_in_mixed_buckets(spark, monkeypatch):
    """Blocks of a few members: large groups have blocks of their own, and all links between groups are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):  # groups that are about 60 % to 80 % alike
        base = words(200, 21, 10**6).split()
        for p in range(g * 8):
            base[p * 8] = f"g{g}p{p}"
        for i in range(40 if g == 0 else 12):
            t = list(base)
            for p in rng.integers(200, size=int(rng.integers(1, 6))):
                t[p] = f"z{rng.integers(10**6)}"
            rows.append((int(rng.integers(10**9)), " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(linked_components(rows))


def test_bayes_keeps_links():
    assert near_dedup.least_matches(128) < 96 and near_dedup.LIMITS == sorted(near_dedup.LIMITS)
    rng = np.random.default_rng(0)
    left = rng.integers(1 << 16, size=(4000, 128)).astype(np.uint16)
    right = np.where(rng.random((4000, 128)) < 0.75, left, left ^ 1).astype(np.uint16)
    assert (near_dedup.bayes(left, right) >= 0).mean() > 0.999 and (near_dedup.bayes(left, left[::-1]) == -1).mean() > 0.99


def without_repeats(rows):
    """The contract, string by string."""
    def tie(i, t):
        return (i is None, i or 0)

    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: tie(*r)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            else:
                seen[w] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    unique = list(dict(rows).items())
    rng = np.random.default_rng(8)
    for k in range(40):  # texts made of a few letters and shared pieces have many overlapping repeats
        pieces = ["".join(rng.choice(list("ab"), int(rng.integers(20, 200)))) for _ in range(3)]
        unique += [(100 + 3 * k + j, pieces[j] + pieces[(j + 1) % 3] * int(rng.integers(1, 3)) + words(5, j)) for j in range(3)]
    df = spark.createDataFrame(unique, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, chunk_bytes=3000)).collect()}
    assert got == without_repeats(unique)
    odd = suffix_dedup.remove_repeats(docs).collect()
    assert len(odd) == len(corpus()) and len({bytes(r["kept"]) for r in odd if r.doc_id == 7}) == 1 and suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    """Rows that repeat id and text get the result of one document, in one partition or several; so do those without an id."""
    first, second = words(150, 31), words(90, 32)
    unique = [(1, first), (2, second + " " + first[100:400] + " " + second), (None, words(120, 33) + " " + second[:250])]
    expected = without_repeats(unique)
    for partitions in (1, 6):
        df = spark.createDataFrame(unique * 3, "doc_id long, text string").repartition(partitions)
        got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, chunk_bytes=2000)).collect()]
        assert sorted(got, key=repr) == sorted([*expected.items()] * 3, key=repr)


def test_suffix_dedup_tells_rows_without_an_id_apart(spark):
    """Two texts whose hashes share 32 bits, without ids and under one id."""
    line = words(40, 61)[:111]
    texts = spark.range(300_000).select(F.concat(F.lit(line), F.lit(" "), F.col("id")).alias("a"), F.concat(F.col("id"), F.lit(" another text of some length "), F.col("id")).alias("b"))
    low = lambda c: suffix_dedup.text_hash(F.col(c)).bitwiseAND(F.lit((1 << 32) - 1))
    pair = texts.select("a", low("a").alias("low")).join(texts.select("b", low("b").alias("low")), "low").first()
    for i in (None, 5):
        rows = [(1, line), (i, pair.a), (i, pair.b)]
        got = {r.text: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {line: 0, pair.a: 111, pair.b: 0}


def test_suffix_dedup_keeps_columns_of_any_name(spark):
    names = ("__id", "__tie", "__chunk", "id", "tie", "chunk", "row", "kind", "bucket", "data", "a.b")
    rows = [(1, words(60, 62)), (2, words(60, 62)[:150]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = suffix_dedup.remove_repeats(df.select("*", *[F.lit(n).alias(n) for n in names], F.lit("x").alias("n_spans")))
    assert odd.columns == ["doc_id", "text", *names, "kept", "kept_text", "n_bytes", "n_removed", "n_spans"]
    got = odd.collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(*rows[0], 0), (*rows[1], 150), (3, None, 0)} and all(r[n] == n for n in names for r in got)


def test_suffix_dedup_spreads_a_common_line(spark):
    """A line in many surroundings: no anchor keeps many fragments, and no window is lost."""
    line, longer = words(9, 41)[:40], words(40, 42)[:150]
    texts = [f"{words(30, 1000 + k)} {line} {words(30, 5000 + k)} {longer} {words(20, 9000 + k % 40)}" for k in range(300)]
    raw = [t.encode() for t in texts]
    plain = suffix_dedup.fragments(raw)
    slot = suffix_dedup.slot_of(plain["anchor"], 1 << 16)
    hot = np.flatnonzero(np.bincount(slot) > 50)
    # what is sent of them: one row for each different fragment
    most = lambda f: max(Counter(a for a, _ in set(zip(f["anchor"].tolist(), f["frag"].tolist()))).values())
    apart = suffix_dedup.fragments(raw, hot, 1 << 16)
    assert most(plain) > 50 >= most(apart) and apart["n"].sum() == plain["n"].sum()
    rows = [*enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, chunk_bytes=20000, hot_fragments=50)).collect()}
    assert got == without_repeats(rows)


def test_suffix_dedup_with_hashes_that_collide(spark, monkeypatch):
    """Hashes of two bits in tasks, and of a few bits in the sort: nothing is removed but what is equal."""
    real = suffix_dedup.fragments

    def poor(raw, hot=None, slots=1):
        found = real(raw, hot, slots)
        return found | {"frag": found["frag"] % np.uint64(4)}

    monkeypatch.setattr(suffix_dedup, "fragments", poor)
    shared = [words(60, 50 + k) for k in range(4)]
    rows = [(i, f"{words(20, 100 + i)} {shared[i % 4]} {words(20, 200 + i)} {shared[i % 3]}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, chunk_bytes=3000)).collect()}
    assert got == without_repeats(rows)

    of = suffix_dedup.PrimeHashes.of
    monkeypatch.setattr(suffix_dedup.PrimeHashes, "of", lambda self, start, length: of(self, start, length) % np.uint64(8))
    texts = [t.encode() for _, t in rows]
    found = real(texts)
    number = np.arange(len(found["doc"]))
    parts = [texts[d][s : s + n + suffix_dedup.WINDOW - 1] for d, s, n in zip(found["doc"].tolist(), found["start"].tolist(), found["n"].tolist())]
    columns = {"id": found["doc"], "tie": 0 * number, "chunk": 0 * number, "start": found["start"], "n": found["n"], "off": found["off"], "anchor": found["anchor"] & np.uint64(0xFFFFFFFF)}
    own = suffix_dedup.repeated_windows(columns, parts)
    gone = {(d, s + k) for d, s, n in zip(own["id"].tolist(), own["start"].tolist(), own["n"].tolist()) for k in range(n)}
    seen, expected = set(), set()
    for d, t in enumerate(texts):
        for s in range(len(t) - 99):
            expected |= {(d, s)} if t[s : s + 100] in seen else set()
            seen.add(t[s : s + 100])
    assert gone == expected


def test_prime_hashes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    hashes, text = suffix_dedup.PrimeHashes(data), data.tobytes()
    a, b = rng.integers(0, 4900, (2, 3000))
    for n in (1, 5, 9):
        assert ((hashes.of(a, n) == hashes.of(b, n)) == [text[x : x + n] == text[y : y + n] for x, y in zip(a.tolist(), b.tolist())]).all()


def test_merge_sort_of_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    suffix, group = rng.permutation(2900)[:700], np.sort(rng.integers(0, 40, 700))
    order, equal = suffix_dedup.merge_sort(suffix_dedup.PrefixHashes(data), data, suffix, group, 20)
    text = lambda s: bytes(data[s : s + 20])
    expected = sorted(range(700), key=lambda k: (group[k], text(suffix[k]), k))
    assert order.tolist() == expected
    assert equal.tolist() == [k > 0 and group[expected[k]] == group[expected[k - 1]] and text(suffix[expected[k]]) == text(suffix[expected[k - 1]]) for k in range(700)]


def ctw_plainly(texts, queries):
    """log10 probability of the last byte of each (context, byte), by recursion over lists of what followed each context."""
    met = {}
    for t in texts:
        padded = bytes([ctw.BEGIN]) * ctw.DEPTH + t + bytes([ctw.END])
        for i in range(ctw.DEPTH, len(padded)):
            for d in range(ctw.DEPTH + 1):
                for k in range(8):
                    met.setdefault((padded[i - d : i], k, padded[i] >> (8 - k)), []).append(padded[i] >> (7 - k) & 1)

    def log_own(bits):
        total, seen = 0.0, [0, 0]
        for b in bits:
            total += math.log((seen[b] + 0.5) / (sum(seen) + 1))
            seen[b] += 1
        return total

    @functools.cache
    def weigh(context, k, prefix):
        """(own, below): ln of the own estimate, and of the product of the children's mixtures."""
        bits = met[context, k, prefix]
        if len(context) == ctw.DEPTH or len(bits) == 1:
            return log_own(bits), None
        below = 0.0
        for c in range(256):
            if (bytes([c]) + context, k, prefix) in met:
                own, rest = weigh(bytes([c]) + context, k, prefix)
                below += own if rest is None else math.log((math.exp(own - max(own, rest)) + math.exp(rest - max(own, rest))) / 2) + max(own, rest)
        return log_own(bits), below

    def share(context, d, k, prefix, bit):
        node = context[len(context) - d :]
        if d > ctw.DEPTH or (node, k, prefix) not in met:
            return 0.5
        own, below = weigh(node, k, prefix)
        bits = met[node, k, prefix]
        mine = (bits.count(bit) + 0.5) / (len(bits) + 1)
        if below is None:
            return mine
        top = 1 / (1 + math.exp(below - own))
        return top * mine + (1 - top) * share(context, d + 1, k, prefix, bit)

    return [sum(math.log10(share(c, 0, k, x >> (8 - k), x >> (7 - k) & 1)) for k in range(8)) for c, x in queries]


CTW_TEXTS = ["the cat sat on the mat. the cat sat.", "a  b\n\nc\t d", "the mat sat on the cat", "", "é ü the", "the cat sat on the mat. the cat sat."]


def test_ctw_equals_recursive_weighting():
    """Bytes as they are; contexts met and not met; the nodes above the buckets cut off and given."""
    raw = [t.encode() for t in CTW_TEXTS]
    codes, counts = np.unique(ctw.byte_strings(raw)[0], return_counts=True)
    more = np.setdiff1d(ctw.byte_strings([b"the bat sat on a mat", b"zzz"])[0], codes)
    union, n = ctw.merged([codes, more], [counts, 0 * more.astype(np.int64)])
    levels = {d: ([], [], [], []) for d in range(ctw.NEAR)}
    for k in range(8):
        key, bit = ctw.decisions(codes, k)
        order = np.argsort(key)
        for d, at, zeros, ones, _, ahead in ctw.climb(key[order], (counts * (1 - bit))[order], (counts * bit)[order]):
            if d < ctw.NEAR:
                for column, x in zip(levels[d], (at, zeros, ones, ahead)):
                    column.append(x)
    upper = {d: tuple(np.concatenate(x) for x in columns) for d, columns in levels.items()}
    upper = {d: tuple(x[np.argsort(columns[0])] for x in columns) for d, columns in upper.items()}
    got = ctw.predict(union, n, upper)
    split = [(int(c).to_bytes(8, "big")[:7], int(c) & 255) for c in union]
    assert got == pytest.approx(ctw_plainly(raw, split), abs=1e-9)
    for context in (b"the cat", b"qqqqqqq"):
        whole = np.array([int.from_bytes(context, "big") << 8 | x for x in range(256)], np.uint64)
        every, n = ctw.merged([codes, whole], [counts, np.zeros(256, np.int64)])
        assert (10 ** ctw.predict(every, n, upper)[np.searchsorted(every, whole)]).sum() == pytest.approx(1.0, abs=1e-9)


def test_scores_equal_recursive_weighting(spark, monkeypatch):
    """Through Spark, with many chunks and buckets, some of them split."""
    monkeypatch.setattr(ctw, "ASKED", 12)
    rows = list(enumerate(CTW_TEXTS + ["the bat sat on a mat", "THE\tcat"]))
    held = F.col("doc_id") >= len(CTW_TEXTS)
    got = {r.doc_id: r for r in ctw.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), held, chunk_bytes=30).collect()}
    for i, t in rows:
        padded = bytes([ctw.BEGIN]) * 7 + t.translate(LOWER).encode() + bytes([ctw.END])
        expected = sum(ctw_plainly([x.encode() for x in CTW_TEXTS], [(padded[j - 7 : j], padded[j]) for j in range(7, len(padded))]))
        assert got[i].bytes == len(t.encode()) and got[i].score == pytest.approx(expected, rel=1e-6)
        assert got[i].bits_per_byte == pytest.approx(-got[i].score * math.log2(10) / (got[i].bytes + 1))
    assert got[1].score != pytest.approx(ctw_plainly([x.encode() for x in CTW_TEXTS], [(b"\xfe" * 7, ctw.END)])[0])


def test_ctw_of_a_bit_never_seen():
    """1e9 ones are told from certainty, and so are bits that are zero."""
    none = {d: (np.zeros(0, np.uint64), *[np.zeros(0)] * 3) for d in range(ctw.NEAR)}
    for seen, other in ((b"e", b"%"), (b"%", b"e")):  # they part at the second bit
        codes = np.array([int.from_bytes(b"abcdefg" + x, "big") for x in (seen, other)], np.uint64)
        order = np.argsort(codes)
        logs = np.empty(2)
        logs[order] = ctw.predict(codes[order], np.array([10**9, 0])[order], none)
        sent = ctw.expand_logs(ctw.squeeze_logs(logs))
        assert logs[0] == pytest.approx(8 * math.log10(1 - 0.5 / (10**9 + 1)), rel=1e-5)
        assert logs[1] == pytest.approx(math.log10(1 - 0.5 / (10**9 + 1)) + math.log10(0.5 / (10**9 + 1)) + 6 * math.log10(0.5), rel=1e-6)
        assert sent == pytest.approx(logs, abs=1e-5)
    tiny = np.array([-40.0, 0.0, -1e-12, -15.9, -16.1])
    assert ctw.expand_logs(ctw.squeeze_logs(tiny)) == pytest.approx(tiny, abs=1e-5) and len(ctw.expand_logs(ctw.squeeze_logs(tiny[:0]))) == 0


def test_scores(spark, docs, empty):
    held = F.col("doc_id").isin(2, 9)
    got = ctw.score_corpus(docs, held, chunk_bytes=4000).collect()
    rows = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, *_ in corpus()]
    c = Counter(w for i, ws in rows if i not in (2, 9) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((repr(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got) and all(r.held_out == (r.doc_id in (2, 9)) for r in got)
    near = next(r for r in got if r.doc_id == 2)  # held out, but a near copy of learned texts; with nothing learned it costs 8
    assert near.bits_per_byte < 4 and ctw.score_corpus(empty, held).count() == 0
    nothing = ctw.score_corpus(docs.filter("doc_id = 7"), F.lit(True)).collect()
    assert all(r.bits_per_byte == pytest.approx(8.0, rel=1e-5) and r.n_known == 0 for r in nothing)


def test_ctw_answers_are_computed_once(spark, monkeypatch):
    """The plan that sums up the chunks asks the tree once, and the figures of the words come with the sums."""
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    written = ctw.written
    monkeypatch.setattr(ctw, "written", kept)
    rows = list(enumerate(CTW_TEXTS))
    got = ctw.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), chunk_bytes=30).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {sum(len(WORD.findall(t)) + 1 for t in CTW_TEXTS)}
    assert plans["scores"].count("FlatMapCoGroupsInArrow") == 2


def test_ctw_counts_are_merged_in_steps(monkeypatch):
    rng = np.random.default_rng(0)
    parts = [(np.unique(rng.integers(0, 500, 300).astype(np.uint64)),) for _ in range(40)]
    parts = [(c, rng.integers(1, 9, len(c))) for (c,) in parts]
    whole = ctw.merged(*map(list, zip(*parts)))
    most, plain = [], ctw.merged
    monkeypatch.setattr(ctw, "merged", lambda codes, counts: most.append(sum(map(len, codes))) or plain(codes, counts))
    got = ctw.merged_in_steps(iter(parts), 600)
    assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all() and max(most) <= 500 + 600 + 300
    assert [len(x) for x in ctw.merged_in_steps(iter(()))] == [0, 0]


def test_ctw_places():
    """Codes that share slots are found all the same, also those left without one by every table."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 100_000):
        known = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        asked = rng.permutation(np.repeat(known, 2))
        assert (known[ctw.Places(known).of(asked)] == asked).all()
    apart = int(pow(ctw.SLOTS[0], -1, 1 << 64))
    same = np.unique(np.array([apart * i % (1 << 64) for i in range(5000)], np.uint64))  # all in slot 0 of the first table
    places = ctw.Places(same)
    for _, _, table in places.tables:
        table[:] = 0
    places.tables += places.tables[:1] * (len(ctw.SLOTS) - len(places.tables))
    assert (places.of(same[::-1]) == np.arange(len(same))[::-1]).all()


def test_powers_kept_by_a_worker_are_bounded(monkeypatch):
    monkeypatch.setattr(hashing, "_known", {})
    monkeypatch.setattr(hashing, "MOST_KEPT", 1000)
    prime, base = hashing.PRIMES[0]
    for n in (10, 900, 5000, 700):
        assert hashing.prime_powers(n, base, prime)[[0, 1, n]].tolist() == [pow(base, k, prime) for k in (0, 1, n)]
        assert hashing.powers(n, 3)[[0, 1, n]].tolist() == [pow(3, k, 1 << 64) for k in (0, 1, n)] and len(hashing.powers(n, 3)) == n + 1
    assert len(hashing._known[base, prime]) <= 1000 and len(hashing._known[3]) <= (1 << 18) + 1


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 14))


def test_ctw_nodes_reach_all_buckets_that_ask():
    """Every string's bucket has the node of two bytes of its context; a node goes to a bucket once."""
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
    key, _ = ctw.decisions(codes, 3)
    nodes = np.unique(key >> np.uint64(8 * (ctw.DEPTH - 2)))
    for buckets in (1, 7, 5000):
        node, bucket = ctw.extended(nodes, 2, buckets)
        assert np.all(np.diff(bucket) >= 0)
        sent = list(zip(nodes[node].tolist(), bucket.tolist(), strict=True))
        assert len(sent) == len(set(sent)) <= 256 * len(nodes)
        asked = zip((key >> np.uint64(8 * (ctw.DEPTH - 2))).tolist(), ctw.near_bucket(codes, buckets, 3).tolist(), strict=True)
        assert set(asked) <= set(sent)
