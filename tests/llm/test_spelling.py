"""Near words and their forms against brute force: ties, repeats, long words, empty tables, clashing names."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from speechjobs.llm import spelling
from speechjobs.llm.spelling import GramDictionary, count_words, group_spellings, lists_of, near_words
from test_operators import LOWER


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters)


def plain(counts):
    """{word: (form, root, n, n_near, form_n)} by trying all edits."""
    letters = sorted({c for w in counts for c in w})
    near = {w: sorted({e for e in edits(w, letters) if e != w and e in counts}, key=lambda e: (-counts[e], e)) for w in counts}
    form = {w: x[0] if x and counts[x[0]] >= 2 * counts[w] else None for w, x in near.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(rows, every=97):
    counts = Counter()
    for i, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def vocabulary(seed, n, letters, most=9):
    rng = np.random.default_rng(seed)
    found = {"".join(rng.choice(list(letters), rng.integers(5, most))) for _ in range(n)}
    return {w: int(x) for w, x in zip(sorted(found), rng.integers(3, 60, len(found)), strict=True)}


def run(spark, counts, **options):
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, near string, key int")
    return {r.word: tuple(r)[1:] for r in group_spellings(df, **options).collect()}


@pytest.mark.parametrize(("letters", "n", "options"), [("ab", 300, {"list_words": 4, "most_rows": 8}), ("abcdé", 900, {"list_words": 16, "bucket_bytes": 20_000}), ("abcdefgh", 700, {"list_words": 2, "most_grams": 40}), ("abc", 500, {})])
def test_forms_equal_all_edits(spark, letters, n, options):
    counts = vocabulary(n, n, letters)
    assert run(spark, counts, **options) == plain(counts)


def test_chains_ties_and_long_words(spark):
    long = "x" * 3000
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "single": 7, long: 4, long + "x": 9, long + "y": 9, long[1:] + "q": 100, "équipe": 3, "equipe": 40}
    assert run(spark, counts) == plain(counts)
    short = {w: n for w, n in counts.items() if len(w) < 10}
    assert run(spark, short, most_rows=1, list_words=1) == plain(short)
    assert run(spark, {}) == {}


def test_words_are_counted(spark):
    rows = [(i, f"Déjà VU, {'Ünder' * (i % 3 + 1)} écoleÉCOLE anOther_another don't ÀÉÎÕÜ×÷ 日本word {'y' * 5000}") for i in range(60)] + [(None, "another another"), (1, None), (2, ""), (3, "another"), (3, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as word", "'x' as n", "2 as id")
    assert {r.word: r.n for r in count_words(df, typo_every=7).collect()} == plain_counts(rows, 7)
    assert count_words(df.limit(0)).count() == 0 and count_words(df, typo_every=None).filter("word = 'another'").first().n == 124


def test_repeated_words_are_one(spark):
    df = spark.createDataFrame([("shape", 3), ("shape", 4), (None, 9), ("shapes", 3)], "word string, n long")
    assert sorted(tuple(r) for r in group_spellings(df).collect()) == [("shape", None, "shape", 7, 1, None), ("shapes", "shape", "shape", 3, 1, 7)]


def dictionary(words, most):
    """Grams as gram_dictionary() makes them."""
    counts = Counter(t[k : k + n] for t in (f"^{w}$" for w in words) for n in range(2, 6) for k in range(len(t) - n + 1))
    return GramDictionary({g for g in counts if len(g) > 2 and counts[g[:-1]] > most}, dict(counts))


@pytest.mark.parametrize("most", [0, 3, 20])
def test_an_edit_changes_no_more_grams_than_the_bound(most):
    """Grams that are not counted as changed stand at the same place, from the start or from the end, in the other word."""
    words = list(vocabulary(5, 300, "abc"))
    d = dictionary(words, most)
    pairs = GramDictionary(set(), d.counts)
    for w in words[:120]:
        text = f"^{w}$"
        own = d.grams(text)
        gone, come = d.changed(text, own)
        assert pairs.changed(text, pairs.grams(text)) == spelling.PAIRS_CHANGED
        for e in set(edits(w, "abcz")) - {w}:
            other = f"^{e}$"
            shift = len(other) - len(text)
            there = set(d.grams(other))
            # the edit is between the first characters and the last ones that both share
            left = next((k for k in range(min(len(text), len(other))) if text[k] != other[k]), min(len(text), len(other)))
            most_shared = max(
                sum((p, q) in there and q <= k or (p + shift, q + shift) in there and p >= k + (shift <= 0) for p, q in own)
                for k in range(1, left + 1) if text[:k] == other[:k] and text[k + (shift <= 0) :] == other[k + (shift >= 0) :]
            )
            assert len(own) - most_shared <= (come if shift > 0 else gone)
            assert lists_of(w, d, pairs) & lists_of(e, d, pairs) or e not in words


def test_all_pairs_share_a_list(spark):
    counts = vocabulary(9, 400, "abcd", 12)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r.word, r.near) for r in near_words(df, list_words=8).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(counts, 2) if abs(len(a) - len(b)) < 2 and b in set(edits(a, "abcd"))}
