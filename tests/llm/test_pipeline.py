"""Each stage of the pipeline against a brute-force form, on what the stage before kept."""

import hashlib
import math

import brute
import pytest

import corpus_pipeline as P
from questloom.llm import decontam, quality
from questloom.llm.registry import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each."""
    docs, out = table(spark, SMALL, "documents"), []
    out.append(docs.collect())
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SMALL), name)
        out.append(docs.collect())
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]


def test_quality_stage(spark, kept):
    verdict = {r.doc_id: r.kept for r in quality.judge(table(spark, SMALL, "documents")).collect()}
    for r in kept[0]:
        n, *_, repeated = brute.quality(r.text)
        if n < 10 or 100 * repeated > 20 * n:
            assert not verdict[r.doc_id]
    assert ids(kept[1]) == {i for i, ok in verdict.items() if ok}
    assert {r.doc_id: r for r in kept[1]} == {r.doc_id: r for r in kept[0] if verdict[r.doc_id]}


def test_line_stage(kept):
    want = brute.shared_lines([(r.doc_id, r.text) for r in kept[1]])
    assert {r.doc_id: r.text for r in kept[2]} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_near_stage(kept):
    want = brute.near([(r.doc_id, r.text) for r in kept[2]])
    assert ids(kept[3]) == {i for i, (_, c) in want.items() if c == i} and len(kept[3]) == len(ids(kept[3]))


def test_benchmark_stage(spark, kept):
    """A plain alignment of every document with every item that shares a seed."""
    block = next(decontam.prepared(spark.createDataFrame(kept[3]), table(spark, SMALL, "benchmark"), 4, 16 << 20, "text", "item_id", "text"))
    gone = set()
    for r in kept[3]:
        numbers = block.number(r.text)
        for i, item in enumerate(block.items):
            seeds = set(block.grams[(block.owner == i) & block.seed].tolist())
            if seeds & set(block.hits(numbers)[1].tolist()) and decontam.align(item, numbers)[0] >= len(item):
                gone.add(r.doc_id)
    assert ids(kept[4]) == ids(kept[3]) - gone


def test_mix_stage(kept):
    size = {r.doc_id: len(brute.words(r.text)) for r in kept[4]}
    source = {r.doc_id: r.source for r in kept[4]}
    names = sorted(set(source.values()))
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        level = (budget - sum(2 * total[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] >= 2 * total[s]}
        if not more:
            break
        full |= more
    assert len(kept[5]) == len(kept[4])
    for r in kept[5]:
        s = source[r.doc_id]
        target = 2.0 * total[s] if s in full else level * weight[s]
        rate = target / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"17|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.size == size[r.doc_id] and math.isclose(r.target, target)
        assert r.taken == r.size * (int(rate) + (draw < rate - int(rate)))
