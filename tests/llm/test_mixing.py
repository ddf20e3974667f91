import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from weekwatch.llm import mixing as X


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(docs, **k):
    rows = X.mix(docs, **k).collect()
    words = [(r.source, len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", r.text or "") if w])) for r in docs.select("source", "text").collect()]
    sizes = {}
    for s, n in words:
        sizes[s] = sizes.get(s, 0) + n
    assert sorted(((r.source, r.size) for r in rows), key=str) == sorted(words, key=str)
    targets, taken, largest = plain_targets(sizes), {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6
    return rows


def test_documents_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = check(docs)
    again = X.mix(docs.repartition(13)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_a_tree_of_small_buckets(spark, sf, monkeypatch):
    monkeypatch.setattr(X.dependent_rounding, "__defaults__", (17, 5, 3))
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_awkward_rows(spark):
    docs = documents(spark, extra=("size", "copies", "row_id"))
    check(docs)
    mixed = X.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 4  # two equal rows, each twice at most
    for none in (empty(spark), documents(spark).where("doc_id = 2")):
        assert X.mix(none).agg(F.sum("taken")).first()[0] in (None, 0)
        assert X.mixed_documents(none).count() == 0


def test_chance_follows_the_fraction(spark):
    rows = spark.range(400).selectExpr("cast(id as string) as row_id", "'s' as source", "1L as size", "0.3D as p")
    ups = [X.dependent_rounding(rows, seed, 50, 4).agg(F.sum("up")).first()[0] for seed in (1, 2)]
    assert all(abs(u - 120) <= 1 for u in ups)


def test_mixed_documents_are_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = X.mixed_documents(docs).groupBy("source").agg(F.sum(X.n_words(F.col("text"))).alias("n")).collect()
    targets = {r.source: r.target for r in X.source_targets(docs.select("source", X.n_words(F.col("text")).alias("size"))).collect()}
    assert all(abs(r.n - targets[r.source]) <= 20_000 for r in got) and len(got) == len(targets)


def test_sources_of_any_name(spark):
    names = [None, "null", "", "a", "a/b", '"', "{}", "\\N"]
    rows = [(i, "five words of one text", "en", s, 0) for i in (None, 1, 1, 2) for s in names for _ in range(2)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    got = check(docs)
    assert len(got) == len(rows) and len({r.source for r in got}) == len(names)
    counts = {(r.doc_id, r.source): r["count"] for r in X.mixed_documents(docs).groupBy("doc_id", "source").count().collect()}
    assert all(n <= (8 if i == 1 else 4) for (i, _), n in counts.items())
