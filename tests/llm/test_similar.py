import random

import numpy as np
import pytest
from helpers import LONG, documents, empty

from weekwatch.llm import similar as S


def plain_shingles(text, words=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", w) if x]
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_groups(rows, similarity=0.8):
    """Position -> group, by the Jaccard similarity of all pairs that share a shingle; and the number of such pairs."""
    sets, parent, pairs, places = [plain_shingles(t) for t in rows], list(range(len(rows))), 0, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shared = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            for j in places.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            places[x].append(i)
    for (i, j), n in shared.items():
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= similarity * union:
            pairs += 1
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], pairs


def altered(text, rnd, share):
    w = text.split(" ")
    for i in rnd.sample(range(len(w)), max(1, round(share * len(w)))):
        w[i] = f"new{rnd.randint(0, 10**9)}"
    return " ".join(w)


def texts(rnd, n):
    return [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(30, 400))) for _ in range(n)]


def kept_rows(spark, rows, **k):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(rows)], documents(spark).schema).repartition(7)
    return {r.doc_id for r in S.keep_one(docs, **k).collect()}


@pytest.mark.parametrize("bucket", [S.BUCKET, 15])
def test_recall_against_all_pairs(spark, bucket):
    rnd = random.Random(11)
    rows = texts(rnd, 400)
    near = [altered(t, rnd, rnd.uniform(0.002, 0.03)) for t in rows[:250]]
    rows = rows + near + [altered(rows[7], rnd, 0.01) for _ in range(60)]
    groups, pairs = plain_groups(rows)
    least = {}
    for i, g in enumerate(groups):
        least[g] = min(i, least.get(g, i))
    want, got = set(least.values()), kept_rows(spark, rows, bucket=bucket)
    assert pairs > 200 and want <= got  # nothing goes that is not similar to what stays
    gone, found = len(rows) - len(want), len(rows) - len(got)
    assert found >= 0.97 * gone


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups, _ = plain_groups([t for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(i, least.get(g, i))
    got = {r.doc_id for r in S.keep_one(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(least.values()) <= got and len(rows) - len(got) >= 0.95 * (len(rows) - len(least))


def test_awkward_rows(spark):
    docs = documents(spark, extra=("fp", "id", "text_hash", "doc"))
    out = S.keep_one(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    # 3 and 4 and a null row have no words like 2, 6 is a copy of 1
    assert out.columns == docs.columns and out.count() == 6 and got == {i: text[i] for i in (1, 2, 5, 7, 8)} | {None: "text without an id"} and got[5] == LONG
    assert S.keep_one(empty(spark)).count() == 0


def test_fingerprint_bits():
    rnd = random.Random(2)
    h = S.shingles(" ".join(f"a{rnd.randint(0, 99)}" for _ in range(700)))
    fp = S.fingerprint(h)
    mixed = [(int(x) + (0x9E3779B97F4A7C15 * 3)) % 2**64 for x in h]
    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)
    want = sum(1 << b for b in range(64) if 2 * sum(mix(x) >> b & 1 for x in mixed) > len(h))
    assert int(fp[2]) == want and fp.dtype == np.uint64


def test_plan_reaches_its_chance():
    for n in (10**3, 10**6, 10**9):
        for width in (13, 32):
            cost, ts = S.allocate(n, [[0.5] * width] * (1024 // width), S.agreement(), 0.02)
            if ts:
                miss, q = 1.0, 1 - S.agreement()
                for t in ts:
                    miss *= 1 - sum(__import__("math").comb(width, k) * (1 - q) ** (width - k) * q**k for k in range(t + 1))
                assert miss <= 0.021 and cost > 0


@pytest.mark.parametrize("miss", [S.MISS, 1 - 1e-9])
def test_no_pair_is_left_out(spark, miss):
    """Pairs near the bound, chains over them and a large group of copies beside a text that only its rim reaches; with hardly any key as well."""
    rnd = random.Random(23)
    base = texts(rnd, 150)
    rows = base + [altered(t, rnd, rnd.uniform(0.005, 0.03)) for t in base for _ in range(3)]
    chain = [" ".join(f"c{i}" for i in range(120))]
    for k in range(12):
        chain.append(" ".join(chain[-1].split(" ")[8:] + [f"d{k}x{i}" for i in range(8)]))
    rows += chain[::-1] + [altered(base[3], rnd, 0.006) for _ in range(80)] + ["", " ", "a b", "a b c d e f g h", "a b c d e f g h i"]
    rnd.shuffle(rows)
    groups, pairs = plain_groups(rows)
    least = {}
    for i, g in enumerate(groups):
        least[g] = min(i, least.get(g, i))
    assert pairs > 300
    assert kept_rows(spark, rows, miss=miss) == set(least.values())
