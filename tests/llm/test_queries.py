"""Every query against its SQL twin or a brute-force form, on a whole small table."""

import zlib

import brute
import pytest
from oracle_compare import compare

from questloom.llm import queries  # noqa: F401
from questloom.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    ok, note = compare(spark, SMALL, QUERIES[name], ORACLES[name])
    assert ok, note


def test_token_counts(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    want = {i: (len(t.encode()), n := len(lib.encode(t)), n > 4096) for i, t, _ in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op1_token_counts")} == want


def test_personal_data(spark, docs):
    want = {}
    for i, t, _ in docs:
        spans = brute.personal(t)
        n = [sum(k == x for k, *_ in spans) for x in ("email", "ip", "card", "phone")]
        want[i] = (*n, brute.sha(brute.span_text(spans)))
    got = rows(spark, "op3_personal_data")
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == want


def test_quality(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_quality_rules")}
    for i, t, _ in docs:
        r, w = got[i], brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in QUERIES["op4_quality_rules"](spark, folder).collect() if labels.get(r.doc_id) and not r.base_failed]
    assert sum(r.kept for r in got) >= 0.99 * len(got)


def test_languages(spark, docs):
    truth = {i: x for i, _, x in docs}
    got = rows(spark, "op7_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_repeated_strings(spark, docs):
    want = brute.repeats([(i, t) for i, t, _ in docs])
    got = rows(spark, "op8_repeated_strings")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_near_duplicates(spark, docs):
    want = brute.near([(i, t) for i, t, _ in docs])
    got = rows(spark, "op9_ngram_jaccard_join")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_secrets(spark, docs):
    want = {}
    for i, t, _ in docs:
        spans = brute.secrets(t)
        want[i] = (*[sum(k == x for k, *_ in spans) for x in ("assign", "access", "hex")], brute.sha(brute.span_text(spans)))
    got = rows(spark, "op10_secret_scan")
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op6_decontamination")}
    whole = {(i, b.item_id) for i, t, _ in docs for b in bench if b.text in t}
    assert whole <= got
