import collections

import __spark_entry__ as entry
import pytest
from helpers import documents, empty
from test_linededup import without_runs
from test_quality import verdicts
from test_similar import plain_groups

import corpus_pipeline as C
from weekwatch.llm.shared import store


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(store(f(spark, out[-1], sf)))
    return out


def test_quality_stage_against_brute_force(stages):
    rows = stages[0].collect()
    kept = [tuple(r) for r, v in zip(rows, verdicts([(r.lang, r.source, r.text) for r in rows])) if v[6]]
    assert sorted(map(tuple, stages[1].collect())) == sorted(kept)


def test_line_stage_against_brute_force(stages):
    from pyspark.sql import functions as F

    rows = stages[1].withColumn("h", F.xxhash64("text")).collect()
    left = without_runs([(r.doc_id, r.text, r.h) for r in rows], whole_texts=True)
    want = [(r.doc_id, t, r.lang, r.source, len(t)) for r in rows if (t := left[r.doc_id, r.text]).encode().split()]
    assert sorted(map(tuple, stages[2].collect())) == sorted(want)


def test_near_stage_against_all_pairs(stages):
    rows = sorted(stages[2].collect())
    groups, _ = plain_groups([r.text for r in rows])
    least = {g: r for r, g in reversed(list(zip(rows, groups)))}
    kept = {tuple(r) for r in stages[3].collect()}
    assert {tuple(r) for r in least.values()} <= kept <= set(map(tuple, rows))
    assert len(rows) - len(kept) >= 0.95 * (len(rows) - len(least))


def test_mix_stage(stages):
    before, after = {tuple(r) for r in stages[3].collect()}, collections.Counter(map(tuple, stages[4].collect()))
    assert set(after) <= before and max(after.values()) <= 2
    words = lambda rows: sum(len(r[1].split()) * n for r, n in rows)
    assert words(after.items()) == pytest.approx(1.5 * words((r, 1) for r in before), rel=0.1)


def test_pack_stage(stages):
    rows = stages[4].collect()
    once = {r.doc_id: r.text for r in rows}
    copies = collections.Counter(r.doc_id for r in rows)
    packed = stages[5].collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == copies
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    single = {i for i, n in copies.items() if n == 1}
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append(r)
    alone = [r for rs in by_sequence.values() for r in rs if r.doc_id in single]
    assert {r.doc_id for r in alone} == single and all(r.doc_id in once for r in packed)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_run_is_the_stages(spark, sf, stages):
    got = entry.queries()["pipeline"](spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, stages[5].select("doc_id", "start", "ids_crc32").collect()))


def test_each_stage_takes_awkward_rows(spark, sf):
    docs = documents(spark, extra=("removed", "fp", "copies", "kept"))
    for i, (name, f) in enumerate(C.STAGES):
        out, none = f(spark, docs, sf), f(spark, empty(spark), sf)
        if i < len(C.STAGES) - 1:
            assert tuple(out.columns) == C.COLUMNS, name
        assert out.count() > 0 and none.count() == 0, name




def test_exact_copies_end_as_one_document(spark, sf):
    # lines too short for chunks and runs, a text of 50 words among them
    text = lambda k, n, per: "\n".join(" ".join(f"k{k}n{i}x{j}" for j in range(per)) for i in range(n))
    shapes = [(5, 10), (2, 24), (20, 7), (9, 23), (40, 1)]
    rows = [(100 * k + c, text(k, *shape), "en", "s", 0) for k, shape in enumerate(shapes) for c in range(7)]
    docs = spark.createDataFrame(rows, documents(spark).schema).repartition(5)
    for f in (C.line_dedup, C.near_dedup):
        docs = f(spark, docs, sf)
    assert sorted(tuple(r) for r in docs.select("doc_id", "text").collect()) == [(100 * k, text(k, *shape)) for k, shape in enumerate(shapes)]
