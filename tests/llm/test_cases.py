"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names, planted cases."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from questloom.llm import decontam, langid, lines, mixing, neardup, pii, quality, queries, repeats, secret_scan, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k1 string, n_words string, dropped int"


def odd_rows():
    rnd = random.Random(3)
    prose = [" ".join(rnd.choice(["red", "blue", "green", "wide", "deep", "old"]) + str(rnd.randint(0, 99)) for _ in range(80)) for _ in range(6)]
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "\n\n", None, "a"), (None, prose[0], "en", "a"),
        (4, prose[1], "en", "b"), (4, prose[1], "en", "b"), (5, prose[1] + " tail", None, None),
        (6, "x" * 50_000, "de", "b"), (7, (prose[2] + "\n") * 40, "en", "a"), (8, prose[3] + "\x00\x01é漢🙂", "", "c"),
        (9, "😀 👍  ", "fr", "c"), (10, prose[4] + "\n" + prose[4], "en", "c"), (11, " ", "en", "c"),
    ]
    return [(*r, len(r[1] or ""), "k", "w", 1) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (None, "a b"), (3, "")], "item_id bigint, text string")


def operators(bench):
    return {
        "tokens": lambda d: tokens.token_counts(d, queries.tokenizer_file()),
        "mix": mixing.mix,
        "pii": pii.find_personal_data,
        "sanitise": pii.sanitise,
        "judge": quality.judge,
        "accept": quality.accept,
        "lines": lines.dedup_lines,
        "decontaminate": lambda d: decontam.decontaminate(d, bench),
        "find": lambda d: decontam.find_contaminated(d, bench),
        "langid": langid.identify,
        "repeats": repeats.cut_repeats,
        "near": neardup.near_duplicates,
        "secrets": secret_scan.find_secrets,
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_odd_rows(spark, odd, bench, name):
    got = operators(bench)[name](odd).collect()
    if name not in ("find", "accept"):
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", list(operators(None)))
def test_empty_table(spark, empty, bench, name):
    assert operators(bench)[name](empty).count() == 0


def test_no_benchmark(spark, odd, bench):
    none = bench.filter("item_id > 99")
    assert decontam.find_contaminated(odd, none).count() == 0
    assert decontam.decontaminate(odd, none).count() == odd.count()


def pipeline(spark, docs, bench, folder):
    path = str(folder)
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    bench.write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_odd_rows(spark, odd, empty, bench, tmp_path):
    path = pipeline(spark, odd, bench, tmp_path / "odd")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert out.count() <= docs.count()
    path = pipeline(spark, empty, bench, tmp_path / "empty")
    assert corpus_pipeline.run(spark, path).count() == 0


@given(st.text(alphabet="ab  ▁\n\té<s>漢", max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_chunk_maps_compose(text, size):
    assert MACHINE.count(text, size) == len(MACHINE.lib.encode(text))


MACHINE = tokens.Transducer(queries.tokenizer_file(), arcs=50)


def test_targets_are_filled_and_capped(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (50, "b"), (40, "c"), (900, "d"), (60, None), (0, "e")])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.doc_id: r for r in got}
    size = {i: len(t.split()) for i, t, _ in rows}
    assert math.isclose(sum(r.target for r in got), 1.5 * sum(size.values()))
    weights = {0: 5, 1: 2, 2: 1, 3: 5, 5: 2, 4: 1}
    level = max(by[i].target / weights[i] for i in weights)
    for i, w in weights.items():
        assert math.isclose(by[i].target, min(2 * size[i], level * w)) and by[i].taken <= 2 * size[i]


def test_mix_takes_near_target(spark):
    rows = [(i, "w " * (20 + i % 60), f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source_size").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) < 0.05 * r.t for r in got)


@given(st.text(alphabet="ab.@-_ %", max_size=40))
@settings(max_examples=400, deadline=None)
def test_emails_match_the_pattern(text):
    assert pii.base_spans(text) == brute.personal(text)


@given(st.text(alphabet="0159. -+()é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_numbers_match_the_patterns(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_long_runs_cost_little():
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1.1." * 50_000, "+1" * 50_000):
        pii.base_spans(t)


def test_revealing_terms(spark):
    rnd = random.Random(1)
    filler = [f"{a}{b}word" for a in ("red", "old", "wide") for b in ("sun", "sea", "hill", "road")]
    rows = [(i, " ".join(rnd.choices(filler, k=30)), "en") for i in range(300)]
    for i in range(6):
        rows.append((1000 + i, " ".join(rnd.choices(filler, k=9)) + f" Zanzotto ann.b@example.org {rnd.choice(filler)}", "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = pii.find_personal_data(docs).collect()
    hits = {(r.doc_id, t.start) for r in got for t in r.terms}
    assert hits == {(i, t.index("Zanzotto")) for i, t, _ in rows if "Zanzotto" in t}
    clean = pii.sanitise(docs).filter("doc_id >= 1000").collect()
    assert all("Zanzotto" not in r.text and "[EMAIL]" in r.text and "@" not in r.text for r in clean)


def test_kneser_ney_sums_to_one():
    rnd = np.random.default_rng(2)
    sym = rnd.choice(6, 4000, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]).astype(np.uint8) + 1
    model = quality.build_model(*np.unique(quality.ngram_codes(sym), return_counts=True))
    for ctx in ([1, 2, 3], [6, 6, 6], [9, 9, 9], [0, 0, 1]):
        base = (ctx[0] << 12) | (ctx[1] << 6) | ctx[2]
        p = np.exp(quality.log_probs((base << 6) + np.arange(64), model))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()


def test_languages_in_several_passes(spark, odd):
    docs = odd.select("doc_id", "text", "lang")
    one = quality.measure(docs).collect()
    many = quality.measure(docs, most=1).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, one)) == sorted(map(key, many))


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute.quality(b" ".join(words).decode())[4]


def test_line_dedup_keep_first(spark):
    rows = [(i, f"own line {i}\n  Shared LINE \nshared line") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, keep_first=True).collect()}
    assert got[0] == "own line 0\n  Shared LINE " and all(got[i] == f"own line {i}" for i in range(1, 12))


def test_line_in_nine_documents_stays(spark):
    rows = [(i, "nine\nmore") for i in range(9)] + [(9, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.dedup_lines(docs).agg(F.sum("_n_dropped")).first()[0] == 0


def test_edited_test_items_are_found(spark):
    rnd = random.Random(5)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "ere", "ion", "ust", "all")]
    item = " ".join(rnd.choices(vocab, k=40)).capitalize() + "."
    other = lambda k: " ".join(rnd.choices(vocab, k=k))
    words = item.split()
    edited = [w if i % 7 else rnd.choice(vocab) for i, w in enumerate(words)]
    shorter = words[:12] + words[15:]
    rows = [(1, other(200) + " " + item + " " + other(50)), (2, other(30) + " " + " ".join(edited) + " " + other(9)),
            (3, " ".join(shorter).upper()), (4, other(400)), (5, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, other(30))], "item_id long, text string")
    for size in (16 << 20, 100):  # one block, or one for each item
        got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs, bench, size=size).collect()}
        assert got == {(1, 7), (2, 7), (3, 7)}
        assert {r.doc_id for r in decontam.decontaminate(docs, bench, size=size).collect()} == {4, 5}


def test_edited_copies_alone_are_found(spark):
    rnd = random.Random(11)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "ere", "ion", "ust", "all")]
    item = rnd.choices(vocab, k=40)
    other = lambda k: " ".join(rnd.choices(vocab, k=k))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    copies = [[w if i % k else "changed" for i, w in enumerate(item)] for k in (5, 6, 7)]
    for copy in [*copies, item[:22]]:
        docs = spark.createDataFrame([(1, " ".join(copy)), (2, other(90))], "doc_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs, bench).collect()] == [(1, 7)]
        assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2]


def test_items_against_plain_alignment(spark):
    """Also where all n-grams of a copy are common ones and no seeds."""
    rnd = random.Random(12)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "ere", "ion", "ust", "all")]
    items = [(i, rnd.choices(vocab, k=rnd.randint(12, 50))) for i in range(6)]
    texts = []
    for _, words in items:
        texts += [words[: len(words) * 3 // 5]] * 3 + [words]
        for k in (2, 3, 5, 7, 9):
            copy = [w if rnd.randrange(k) else rnd.choice(vocab) for w in words]
            texts.append(rnd.choices(vocab, k=30) + copy[: rnd.randint(6, 50)] + ["between"] * rnd.randint(0, 9) + copy[20:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    number = {w: i + 1 for i, w in enumerate([*vocab, "between"])}
    coded = lambda words: np.array([number[w] for w in words])
    grams = lambda words: {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    want = {
        (d, i): decontam.align(coded(w), coded(t))[0] / (2 * len(w))
        for d, t in enumerate(texts) for i, w in items if grams(w) & grams(t)
    }
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_contaminated(docs, bench).collect()}
    assert got == {k: x for k, x in want.items() if x >= 0.5} and len(got) > 30


def test_alignment_against_a_plain_table():
    rnd = random.Random(8)
    for _ in range(60):
        a, b = ([rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_language_needs_letters(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "123 !?", "de"), (102, "", None), (None, "the cat", "en")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[None].held_out is False


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_repeats_in_every_way(spark, block):
    rnd = random.Random(4)
    make = lambda k: "".join(rnd.choices("abcde é", k=k))
    shared, other = make(700), make(420)
    rows = [(i, make(rnd.randint(0, 500)) + shared[i * 3 :] + make(200)) for i in range(8)]
    rows += [(20, other + make(30) + other), (21, "z" * 3000), (22, "z" * 399), (23, shared), (24, shared), (25, make(399)), (26, None),
             (27, "ab" * 900), (28, make(90) + other[:405])]
    got = repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    got = got.select("*", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.repeats(rows)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=30))
@settings(max_examples=200, deadline=None)
def test_sketches_never_differ_more_than_sets(a, b, common):
    a, b = a | common, b | common
    bits = [neardup.sketch(np.array(sorted(x), np.uint64)) for x in (a, b)]
    differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
    assert differ <= len(a ^ b)


@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_shingles_do_not_depend_on_the_batch(texts):
    together = neardup.Shingler()(texts)
    for t, s in zip(texts, together, strict=True):
        alone = neardup.Shingler()([t])[0]
        assert (s == alone).all() and len(s) == len(brute.shingles(t))


@pytest.mark.parametrize("few", [0, 64])
def test_near_duplicates_of_every_kind(spark, few):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    boiler = rnd.choices(vocab, k=60)

    def add(words):
        nonlocal k
        rows.append((k, " ".join(words)))
        k += 1

    for size in (1, 2, 4, 5, 6, 8, 9, 12, 30, 90):
        base = rnd.choices(vocab, k=size)
        add(base)
        add(base)
        for _ in range(4):  # chains of growing edits
            base = list(base)
            base[rnd.randrange(len(base))] = rnd.choice(vocab)
            add(base)
            add(base + rnd.choices(vocab, k=1))
    for _ in range(40):  # unlike documents that share most of their shingles
        add(boiler + rnd.choices(vocab, k=rnd.randint(10, 30)))
    for i in range(40):  # windows that drift along one text: linked in a chain
        add((boiler * 4)[i : i + 60])
    rows += [(900, None), (901, ""), (902, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = neardup.near_duplicates(docs, few=few).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)


def test_secret_places(spark):
    key = "q7Zr2LxV9bT4mK8sWc3NpHd6"
    rows = [
        (1, f'é🙂 PassWord = "{key}" and token: short'), (2, "AKIA" + "A1" * 8 + " AKIASHORT"), (3, "f" * 31 + " " + "0a" * 16),
        (4, f"see {key} here"), (5, "123e4567-e89b-12d3-a456-426614174000 aaaaaaaaaaaaaaaaaaaaaaa1"), (6, "\x01secret:abcdefgh\x01"),
        (7, "secret: token: abcdefghijk"), (8, "DEADBEEF0123456789ABCDEF"), (9, None),
    ]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(x.kind, x.start, x.end) for x in got[i].base] == brute.secrets(t)
    assert [(x.kind, x.start, x.end) for x in got[4].added] == [("entropy_text", 4, 4 + len(key))]
    assert [x.kind for x in got[8].added] == ["entropy_hex"]
    assert not got[5].added and not got[1].added


def test_secrets_beside_separators_names_and_base_matches(spark):
    key = "q7Zr2LxV9bT4mK8sWc3NpHd6"
    found = {1: "/" + key, 2: "_" + key, 3: "-" + key, 4: "--flag==" + key, 5: "example_" + key, 6: "EXAMPLE=" + key}
    found |= {7: f"{key}/password=abcdefgh1234"}
    allowed = {
        20: "/usr/local/share/python3/examples", 21: "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        22: "aws_secret=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", 23: "=123e4567-e89b-12d3-a456-426614174000",
        24: "sha256-" + "q7Zr2LxV9bT4mK8sWc3NpHd6q7Zr2LxV9bT4mK8sWc3" + "=",
    }
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in (found | allowed).items()], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end, x.hit) for x in r.added] for r in secret_scan.find_secrets(docs).collect()}
    assert all(len(got[i]) == 1 and key in got[i][0][2] for i in found)
    assert got[7] == [(4, 4 + len(key) + 1, key + "/")]
    assert not any(got[i] for i in allowed if i != 22)


def test_entropy_of_every_window(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abcdefgh0123", k=k)) for k in (19, 20, 21, 60, 3000)]

    def plain(s):
        best = None
        for i in range(len(s) - 19):
            bits = -sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values())
            best = bits if best is None else max(best, bits)
        return best

    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", secret_scan.top_entropy(F.col("s")).alias("b")).collect()
    for r in got:
        want = plain(texts[r.i])
        assert (r.b is None) == (want is None) and (want is None or abs(r.b - want) < 1e-9)
