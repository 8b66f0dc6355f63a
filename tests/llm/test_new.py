"""Spelling variants, nearest neighbours and conversation repair against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from questloom.llm import conversations as C
from questloom.llm import decontam, langid, quality
from questloom.llm import neighbours as A
from questloom.llm import secret_scan as X
from questloom.llm import spelling as S
from questloom.llm import queries  # noqa: F401
from questloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


# Spelling -----------------------------------------------------------------------

def as_words(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_spelling_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op11_spelling_variants"](spark, folder).collect()
    assert as_words(got) == brute.spelling(docs) and len(got) == len(as_words(got))


def spelling_cases():
    rnd = random.Random(5)
    base = ["alphabet", "ÀÉîõüñabc", "bananas", "aaaaaaa", "a" * 5000]
    texts = [None, "", "short", " ".join(base * 12)]
    for w in base:
        for _ in range(40):
            x = list(w)
            p = rnd.randrange(len(x))
            x[p : p + 1] = rnd.choice([[], ["q"], [x[p], "z"], [x[p], x[p]], ["Á"]])
            texts.append(" ".join(["".join(x)] * rnd.randint(1, 4)))
    # Anagrams: one class of letter counts, all in one cell.
    texts += ["".join(rnd.sample("abcdefgh", 8)) for _ in range(3000)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[5], "k", 2)]


def test_spelling_cases(spark):
    rows = spelling_cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = brute.spelling([(i, t) for i, t, *_ in rows])
    assert as_words(S.spelling_variants(docs).collect()) == want
    assert S.spelling_variants(docs.limit(0)).count() == 0


def test_many_small_cells(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in spelling_cases()], "doc_id long, text string")
    words = S.word_counts(docs, every=10**9).cache()
    whole = {tuple(r) for r in S.near_words(words).collect()}
    cut = {tuple(r) for r in S.near_words(words, sample=500, cell=20).collect()}
    assert whole == cut and len(whole) == words.count()


def test_form_chains_end(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(9)]
    got = S._roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "w9" for w, _ in rows}


# Neighbours ---------------------------------------------------------------------

def exact(ids, x, asks, k=20):
    out = {}
    for i in asks:
        score = np.einsum("ij,j->i", x, x[np.flatnonzero(ids == i)[0]])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("folder", [SMALL, MEDIUM, "/root/testdata/sf0.1"])
def test_neighbours_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = exact(ids, x, [i for i in ids if i % 20 == 0])
    got = answers(QUERIES["op12_nearest_neighbours"](spark, folder))
    assert recall(got, want) >= 0.9 and set(got) == set(want)
    place = {i: j for j, i in enumerate(ids)}
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        for v, score in found:
            assert abs(score - float(x[place[q]] @ x[place[v]])) < 1e-12


def test_neighbours_of_clusters_visit_few_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 32))
    x = centres[rng.integers(0, 64, 6000)] + rng.normal(scale=0.05, size=(6000, 32))
    (first, a), (second, b) = A._centroids(x[:, :16], 32, 12), A._centroids(x[:, 16:], 32, 12)
    books = A.Codebooks(first, second, (a, b))
    counts = np.bincount(books.cell_of(x), minlength=books.cells)
    visits = A.cells_to_visit(x[:50], books, counts, 20, 0.04, 320)
    assert np.mean([counts[v].sum() for v in visits]) < 0.25 * len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:3000])], "vec_id long, embedding array<double>")
    assert recall(answers(A.search(df)), exact(np.arange(3000), x[:3000], range(0, 3000, 20))) >= 0.95


def test_heap_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7).tolist(), rng.normal(size=5).tolist()
    sums = [a[i] + b[j] for i, j in A.by_falling_sum(a, b)]
    assert sums == sorted(sums, reverse=True) and len(set(A.by_falling_sum(a, b))) == 35


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0, 2.0]), (20, [1.0, 0.0, 2.0]), (20, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [-1.0, 0.0, 0.0]),
        (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [1.0, float("nan"), 1.0]), (7, [float("inf"), 1.0, 1.0]),
        (8, [1.0]), (9, []), (None, [3.0, 3.0, 3.0]), (40, None),
    ]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, id string, score double")
    got = answers(A.search(df))
    assert got == {0: [(1, 5.0), (20, 5.0), (2, -1.0)], 20: [(0, 5.0), (1, 5.0), (2, -1.0)]}
    assert A.search(df.limit(0)).count() == 0 and A.search(df.filter("vec_id = 4")).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(A.search(df, shard_rows=100))
    want = exact(np.arange(3000), x.astype(np.float64), range(0, 3000, 20))
    assert recall(got, want) >= 0.9
    for q, found in got.items():  # of equal ones the least ids, whatever part of the cell they are in
        equal = [v for v, _ in found if v % 3 == 0]
        assert equal == [v for v in range(0, 3000, 3) if v != q][: len(equal)]


def test_one_component(spark):
    df = spark.createDataFrame([(i, [float(i + 1)]) for i in range(50)], "vec_id long, embedding array<double>")
    assert [v for v, _ in answers(A.search(df))[40]] == [49, 48, 47, 46, 45, 44, 43, 42, 41, *range(39, 28, -1)]


# Conversations ------------------------------------------------------------------

FIELDS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def summaries(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_conversation_query(spark, folder):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert summaries(QUERIES["op13_conversation_repair"](spark, folder)) == brute.conversations(rows)


def odd_conversations(n=150, seed=7):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "So!  ", "fine", "Well.", "漢字。", "End. "]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t + rnd.choice([0, 0, 5]) * 100, rnd.choice(roles[: rnd.choice([2, 3, 6])]), rnd.choice(texts) + (str(t) + "." if rnd.random() < 0.5 else "")))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    return [*rows, (None, 1, "user", "Hm."), (9000, None, "user", "Hm."), (9001, 3, None, None), (9002, 4, "user", None)]


@pytest.mark.parametrize("block", [65_536, 16, 3, 1])
def test_conversations_in_blocks(spark, block):
    rows = odd_conversations()
    rnd = random.Random(1)
    rows += [(7777, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", "b", "C!"]) + str(t)) for t in range(160)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, pos int")
    assert summaries(C.repair_summary(C.damage(df), block)) == brute.conversations(rows)


def test_repaired_rows_give_the_hash(spark):
    df = spark.createDataFrame(odd_conversations(40), "conv_id long, turn long, role string, text string")
    digest = summaries(C.repair_summary(C.damage(df)))
    out = {}
    for r in sorted(C.repair(C.damage(df), 5).collect(), key=lambda r: r.seq):
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: brute.sha("\n".join(out.get(c, []))) for c in digest} == {c: d[-1] for c, d in digest.items()}


def test_conversation_edges(spark):
    schema = "conv_id string, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert C.repair_summary(C.damage(none)).count() == 0
    # The same row many times: all but the first are duplicates; a very long text.
    rows = [("a", 1, "user", "x" * 300_000 + ".")] * 500 + [("a", 2, "assistant", "Ok.")]
    got = summaries(C.repair_summary(C.damage(spark.createDataFrame(rows, schema)), 64))
    assert got == brute.conversations(rows)


def test_least_audit_among_equal_costs():
    runs = C._Runs(np.zeros(2, np.int64))
    # Two user rows: deleting either and putting one in costs 7; D then K then I is least.
    edits, _ = C.least_paths(np.array([1, 1]), np.array([0, 0]), runs, False, None)
    assert "".join(edits) == "KR"


# Mended operators -----------------------------------------------------------------

def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [x.hit for x in r.added] for r in X.find_secrets(docs).collect()}


def test_secret_candidates_of_any_length(spark):
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    path = "/".join("".join(rnd.choice(letters) for _ in range(7)) for _ in range(12))
    keys = ["".join(rnd.choice(letters + "0123456789") for _ in range(16)) + "7q", "".join(rnd.sample(letters, 30)), path]
    plain = ["ab-cd_" * 1000 + "q1", "some/Plain/path_of/httpRequestHandlers/words12", "x" * 1_000_000, "9" * 40, "UPPER_CASE_NAME_WITH_WORDS"]
    got = added(spark, [f"see {k} there" for k in keys + plain])
    assert [got[i] for i in range(3)] == [[k] for k in keys] and all(got[i] == [] for i in range(3, 8))


def test_secret_scan_is_linear(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1_000_000))
    assert added(spark, [long])[0] == [long]


def test_digits_in_other_scripts_are_no_letters(spark):
    rows = [(i, "the words of a text in one language", "en") for i in range(40)] + [(99, "²½ 123", None), (100, "漢", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99] == "und" and got[100] == "en"


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_item_ids_of_any_type(spark, kind):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("7", text)], "item_id string, text string").select(F.col("item_id").cast(kind), "text")
    docs = spark.createDataFrame([(1, f"a {text} b")], "doc_id long, text string")
    assert [str(r.item_id) for r in decontam.find_contaminated(docs, bench).collect()] == ["7"]


def test_thin_classes_have_bands(spark):
    rnd = random.Random(9)
    words = ["harbor", "lantern", "meadow", "river", "stone", "winter", "garden", "window", "market", "silver"]
    prose = lambda n: " ".join(rnd.choice(words) + str(rnd.choice("aeiou")) for _ in range(n))
    junk = lambda n: " ".join("".join(rnd.choice("qxzjkvwy") for _ in range(7)) for _ in range(n))
    rows = [(i, prose(60 + i % 20), "en") for i in range(200)] + [(900 + i, prose(900), "en") for i in range(3)]
    rows += [(950, junk(900), "en"), (951, junk(900), None), (960, prose(900), None)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[950] and sum(got[i] for i in range(200)) >= 198 and all(got[900 + i] for i in range(3))
