"""The pipeline keeps clean documents and its stages do what brute force says."""

from collections import Counter

import numpy as np

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=10**6):
    return " ".join(f"w{x}x" for x in np.random.default_rng(seed).integers(vocabulary, size=n))


def rows():
    clean = [(i, words(60 + i, i), "en", f"s{i % 3}") for i in range(30)]
    copied = [(100, clean[0][1], "en", "s0"), (101, clean[1][1].replace(clean[1][1].split()[30], "changed"), "en", "s1"), (None, clean[2][1], "en", "s2")]
    junk = [(200, None, "en", "s0"), (201, "12 34 56", "en", "s1"), (202, "", None, None)]
    passage = words(30, 999)
    shared = [(300, words(20, 301) + " " + passage, "en", "s0"), (301, passage + " " + words(20, 302), None, "s1")]
    return [(*r, len(r[1] or "")) for r in clean + copied + junk + shared], passage


def test_stages(spark):
    table, passage = rows()
    docs = spark.createDataFrame([(i, t, l, s, n) for i, t, l, s, n in table], DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in docs.collect()}
        assert set(range(30)) <= ids and not ids & {200, 201, 202}
        if name == "near_dedup":
            assert ids == {*range(30), 300, 301}
    last = {r.doc_id: r for r in docs.collect()}
    assert passage in last[300].text and passage not in last[301].text and last[301].n_chars == len(last[301].text) and last[301].lang == "en"
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = corpus_pipeline.packing(spark, mixed, "").collect()
    assert sum(r.words for r in packed) == sum(len(r.text.split()) for r in mixed.collect())


def test_empty_table_and_extra_columns(spark):
    """Columns of odd names and types, some of them called like the operators' own."""
    table, _ = rows()
    extra = "kept string, score double, row string, n_removed int, `my-col` string, `a.b` string, `size` int, tags map<string,int>, nested struct<`x-y`:int,tie:string>"
    docs = spark.createDataFrame([(*r, "x", 1.5, "r", 7, "-", "ab", 3, {"k": 1}, (4, "t")) for r in table], f"{DOCS}, {extra}")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns[5:] == ["kept", "score", "row", "n_removed", "my-col", "a.b", "size", "tags", "nested"]
        assert all(tuple(r)[5:] == ("x", 1.5, "r", 7, "-", "ab", 3, {"k": 1}, (4, "t")) for r in docs.collect())
    assert "my-col" not in corpus_pipeline.packing(spark, docs, "").columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_one_of_each_group_stays(spark):
    """Repeated rows, other columns apart; groups without an id; two texts under one id; texts without words."""
    a, b, c, d = (words(60, 400 + k) for k in range(4))
    table = [(1, a, "en", "s"), (1, a, "en", "s"), (1, a, "fr", "t"), (2, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "t"), (None, b + " more", "en", "s"), (3, c, "en", "s"), (3, d, "en", "s"), (4, "", "en", "s"), (5, "", "en", "s"), (None, None, "en", "s")]
    docs = spark.createDataFrame([(*r, 0) for r in table], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    ids = Counter(i for i, _ in got)
    assert ids == {1: 1, 3: 1, None: 2, 4: 1, 5: 1} and sum(t in (b, b + " more") for _, t in got) == 1


def test_texts_in_several_languages_stay(spark):
    parts = {"en": "the cat sat on the mat with another thing", "fr": "le chat est dans la maison avec une autre", "es": "el gato duerme sobre la mesa grande roja", "de": "der hund schläft unter dem alten tisch heute"}
    table = [(k * 10 + i, t, lang, "s") for k, (lang, t) in enumerate(parts.items()) for i in range(5)] + [(100, " ".join(parts.values()), None, "s"), (101, "1 2 3", None, "s")]
    docs = spark.createDataFrame([(*r, 0) for r in table], DOCS)
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {i for i, *_ in table if i != 101}


def test_sequences_hold_the_texts(spark):
    table, _ = rows()
    docs = spark.createDataFrame([(i, t, l, s, n) for i, t, l, s, n in table if t], DOCS)
    twice = docs.unionByName(docs)
    bins = {}
    for r in corpus_pipeline.packing(spark, twice, "").collect():
        bins.setdefault(r["bin"], []).append(r)
    texts = Counter()
    for rows_ in bins.values():
        rows_.sort(key=lambda r: r.bin_start)
        sequence = [w for r in rows_ for w in r.text.split()]
        assert len(sequence) == rows_[0].bin_words <= rows_[0].bin_length
        texts.update(r.text for r in rows_)
    assert texts == Counter(r.text for r in twice.collect() if r.text.split())
