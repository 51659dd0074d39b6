"""Removal of common lines against brute force: nulls, ties, repeats, empty and long texts, clashing names."""

from collections import defaultdict

import numpy as np
import pytest

from speechjobs.llm.line_dedup import HASH, LineCounts, PerfectHash, drop_common_lines
from test_operators import LOWER

BLANK = " \t\n\v\f\r"


def plain(rows, min_chars=20, min_docs=3):
    """{(id, text): (lines, dropped, rest)} by holding all lines."""
    me = {(i, t): (0, t) if i is None else (1, i) for i, t in rows}
    keys = {(i, t): [x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")] for i, t in rows}
    held = defaultdict(set)
    for r, own in keys.items():
        for k in own:
            if len(k) >= min_chars:
                held[k].add(me[r])
    known = defaultdict(set)
    out = {}
    for (i, t), own in keys.items():
        go = [len(k) >= min_chars and len(held[k]) >= min_docs and max(x for x in held[k] if x[0] == max(y[0] for y in held[k])) != me[i, t] for k in own]
        known[i].add(t)
        out[i, t] = (len(own), sum(go), None if t is None else "\n".join(x for x, g in zip(t.split("\n"), go, strict=True) if not g))
    return out


def lines_of(seed, n_docs=120):
    rng = np.random.default_rng(seed)
    pool = [f"A shared line of number {k}" for k in range(30)] + ["short", "", " " * 30, "é" * 20, "É" * 20, "é" * 19, "The Same With Capitals Inside", "\tthe same with capitals inside\r", "x" * 19 + " "]
    rows = []
    for i in range(n_docs):
        own = [pool[j] for j in rng.integers(len(pool), size=rng.integers(1, 12))] + [f"only here, in document {i}" for _ in range(2)]
        rows.append((i, "\n".join(rng.permutation(own))))
    return rows


@pytest.mark.parametrize("head", [0, 5, 1 << 16])
def test_common_lines(spark, head):
    rows = lines_of(1) + [(500, None), (501, ""), (502, "\n\n"), (503, ("a long line, again and again\n" * 5000)[:-1]), (504, "a long line, again and again"), (505, " A LONG LINE, again and again "), (-7, "\n".join(["A shared line of number 3"] * 4))]
    rows += [(7, "A shared line of number 5\nwith another text"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n_lines", "1 as chunk", "map(1, 2) as row", "doc_id as `a.b`", "2 as known", "3 as id")
    got = drop_common_lines(df, chunk_bytes=20_000, shard_lines=16, head_lines=head)
    assert got.columns == ["doc_id", "text", "chunk", "row", "a.b", "known", "id", "n_lines", "n_dropped"]
    expected = plain(rows)
    found = sorted((r.doc_id, str((r.n_lines, r.n_dropped, r.text))) for r in got.collect())
    assert found == sorted((i, str(expected[i, t])) for i, t in rows)
    assert all(r["a.b"] == r.doc_id and r.row == {1: 2} for r in got.collect())


def test_rows_without_an_id(spark):
    line = "the line that is in all of them"
    rows = [(None, line), (None, line), (None, line + "\nmore of it")]
    read = lambda rows: sorted((r.n_dropped, r.text) for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x for x, _ in read(rows)] == [0, 0, 0]  # two documents only
    assert read([*rows, (-3, line)]) == [(0, line), (1, ""), (1, ""), (1, "more of it")]  # one with an id comes last
    assert read(rows[:0]) == []


def test_lines_of_one_id_are_one_document(spark):
    rows = [(1, f"the line that repeats\n{k}") for k in range(5)] + [(2, "the line that repeats")]
    assert all(r.n_dropped == 0 for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 5000):
        keys = np.zeros(n, HASH)
        keys["one"], keys["two"] = rng.integers(1 << 63, size=(2, n)).astype(np.uint64)
        keys["one"][: n // 2] = 5  # equal in one half of the hash
        again = PerfectHash.unpacked(*PerfectHash.of(keys).packed())
        assert sorted(again.place(keys).tolist()) == list(range(n))
        assert sum(len(x) for x in again.levels) <= 5 * n + 64
        docs = rng.integers(1, 6, n)
        held = LineCounts(*LineCounts.built(keys, docs, np.ones(n, int), keys["two"].view(np.int64), 3))
        rows, known, largest = held.common(keys, 3)
        assert sorted(rows.tolist()) == np.flatnonzero(docs >= 3).tolist() and (known == 1).all() and (largest.view(np.uint64) == keys["two"][rows]).all()
        foreign = np.zeros(1000, HASH)
        foreign["one"], foreign["two"] = rng.integers(1 << 63, size=(2, 1000)).astype(np.uint64)
        assert not len(held.common(foreign, 1)[0])

