import numpy as np
import pytest
import xxhash
from helpers import LONG, documents, empty
from pyspark.sql import functions as F

from weekwatch.llm import simhash as S


def plain_fingerprint(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most=4):
    """Root of each distinct fingerprint by comparing all pairs."""
    u = np.unique(np.array(fps, np.uint64))
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= most):
            parent[find(i)] = find(i + 1 + int(j))
    return {int(x): find(i) for i, x in enumerate(u)}


def expected(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root, least = plain_components([f for _, f in fps]), {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=str)


def got(df, **k):
    return sorted((tuple(r) for r in S.near_duplicates(df, **k).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_documents_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = documents(spark, extra=("fp", "mask", "component_id"))
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert S.near_duplicates(empty(spark)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "SHINGLE_BLOCK", 1000)
    assert S.fingerprint(LONG) == plain_fingerprint(LONG)


@pytest.fixture(scope="module")
def clustered():
    """Chains of near fingerprints, a dense group of them, and random ones."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    out = [*rng.integers(0, 2**63, 800, dtype=np.uint64)]
    for b in base:
        x = b
        for _ in range(12):
            for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x = x ^ (np.uint64(1) << np.uint64(bit))
            out.append(x)
    centre = base[0]
    for _ in range(400):
        x = centre
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x = x ^ (np.uint64(1) << np.uint64(bit))
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize(("bucket", "partitions"), [(20_000, (3,)), (13, (4,)), (40, (2,))])
def test_no_link_is_lost(spark, clustered, bucket, partitions):
    classes = spark.createDataFrame([(int(x),) for x in clustered.view(np.int64)], "fp long")
    links = S.links(classes, 4, bucket, S.plan_masks(classes, 4, partitions)).collect()
    a, b = (np.array(x, np.int64).view(np.uint64) for x in zip(*[(r.a, r.b) for r in links]))
    assert (np.bitwise_count(a ^ b) <= 4).all()
    root, want = {}, plain_components(clustered)

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    same = {}
    for x in clustered.tolist():
        assert same.setdefault(want[x], find(x)) == find(x)
    assert len(set(same.values())) == len(same)


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.random(64)
    both = bits.T.astype(float) @ bits
    for m in (2, 3, 4):
        parts = S.correlated_partitions(500, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, t = S.allocate(500, np.diag(both) / 500, parts, 4)
        assert sum(t) == 4 - m + 1 and min(t) >= -1


def test_one_of_each_group_stays(spark):
    docs = documents(spark, extra=("fp", "row_no"))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    for i, f, c in expected([(r.doc_id, r.text) for r in docs.collect()]):
        want.setdefault((f if c is None else "", c), []).append(i)
    assert kept.count() == len(want)
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(c) for _, c in want)
    assert S.keep_one(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    from weekwatch.llm.graph import components

    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")
    out = {r.node: r.root for r in components(df).collect()}
    assert out == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}
    assert components(df.where(F.lit(False))).count() == 0
