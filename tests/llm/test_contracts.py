"""Every registered query of the training-data operators on the smallest tables: names, types and figures by plain Python."""

import hashlib
import math
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

from speechjobs.llm import queries
from test_hard_negatives import plain as plain_negatives
from test_line_dedup import plain as plain_lines
from test_operators import LOWER, WORD, linked_components, targets_by_rounds, without_repeats
from test_spelling import plain as plain_spellings
from test_spelling import plain_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def result(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return df.collect(), dict(df.dtypes)


def types(found, expected):
    """The contract's columns come first, in its order."""
    assert list(found.items())[: len(expected.split(", "))] == [tuple(x.split(" ")) for x in expected.split(", ")]


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


def test_op1(spark, table):
    rows, kinds = result(spark, "op1_ctw_scores")
    types(kinds, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), None] for r in table}
    c = Counter(w for i, ws in tokens.items() if not remainder(i, 7) for w in ws)
    n, v = c.total(), len(c)
    assert len(rows) == len(table)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_op2(spark, table):
    rows, kinds = result(spark, "op2_suffix_array_dedup")
    types(kinds, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    assert {r.doc_id: tuple(r)[1:] for r in rows} == without_repeats([(r.doc_id, r.text) for r in table])


def test_op3(spark, table):
    rows, kinds = result(spark, "op3_document_fingerprints")
    types(kinds, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    texts = {r.doc_id: r.text or "" for r in table}
    order = sorted(texts, reverse=True)
    for r in rows:
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (edited != t or r.near_edited == 1)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert len({t for t in texts.values() if t}) == len({prints[i] for i, t in texts.items() if t})


def test_op6(spark, table):
    rows, kinds = result(spark, "op6_source_mix")
    types(kinds, "doc_id bigint, size bigint, source_size bigint, target double, taken bigint")
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in table}
    totals, taken = Counter(), Counter()
    for r in table:
        totals[r.source] += sizes[r.doc_id]
    targets = targets_by_rounds(totals, (3, 1, 2), 1.5, 2)
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == totals[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    most = max(sizes.values())
    assert all(abs(taken[s] - targets[s]) <= most for s in totals)


def test_op7(spark, table):
    rows, kinds = result(spark, "op7_shards")
    types(kinds, "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
    texts = {r.doc_id: (r.text or "").encode() for r in table}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_op8(spark, table):
    rows, _ = result(spark, "op8_sequence_packing")
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.words
    assert words == Counter({r.doc_id: n for r in table if (n := len(WORD.findall(r.text or "")))})


def test_op9(spark, table):
    rows, kinds = result(spark, "op9_language_id")
    types(kinds, "doc_id bigint, held_out boolean, lang_pred string, score double")
    known = {r.doc_id: r for r in table}
    learned = {r.lang for r in table if r.lang and not remainder(r.doc_id, 4)}
    for r in rows:
        assert r.held_out == remainder(r.doc_id, 4) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id].text or "")) and r.lang_pred in learned | {"und"}
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and known[r.doc_id].lang]
    assert sum(r.lang_pred == known[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op9_of_a_row_without_an_id(spark, tmp_path):
    rows = [(None, "one two three four", "en"), (1, "un deux trois quatre", "fr"), (2, "one two three", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.held_out for r in queries.op9_language_id(spark, str(tmp_path)).collect()}
    assert got == {None: False, 1: remainder(1, 4), 2: remainder(2, 4)}


def test_op10(spark, table):
    rows, kinds = result(spark, "op10_minhash_near_dedup")
    types(kinds, "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean")
    expected = linked_components([(r.doc_id, r.text) for r in table])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op11(spark):
    rows, kinds = result(spark, "op11_hard_negatives")
    types(kinds, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    vectors = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, rows)) == plain_negatives(vectors, 100)


def test_op12(spark, table):
    rows, kinds = result(spark, "op12_spelling_variants")
    types(kinds, "word string, form string, root string, n bigint, n_near bigint, form_n bigint")
    assert {r.word: tuple(r)[1:] for r in rows} == plain_spellings(plain_counts([(r.doc_id, r.text) for r in table]))


def test_op13(spark, table):
    rows, kinds = result(spark, "op13_line_dedup")
    types(kinds, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
    expected = plain_lines([(r.doc_id, r.text) for r in table])
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows) == sorted((i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for (i, _), (n, d, t) in expected.items())


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the two folders and without the pipeline, and one that keeps the pipeline's file."""
    root = Path(__file__).resolve().parents[2]
    for name in ("speechjobs", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            for path in (root / name).rglob("*.py"):
                if "llm" not in path.parts:
                    to = tmp_path / path.relative_to(root)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(path.read_text())
        else:
            (tmp_path / name).write_text((root / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q) and len(q) > 40"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
    (tmp_path / "corpus_pipeline.py").unlink()
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
