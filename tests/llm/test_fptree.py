import math
import re
from collections import Counter

import pytest
from helpers import documents, empty

from weekwatch.llm import fptree as T

ITEMS = "item_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    """Every item against every document."""
    words = [(i, plain_terms(t)) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    total, df = sum(len(w) for _, w, _ in words), Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, w, c in words:
            m = 25 + (75 * len(w) * len(words)) // total
            score = sum(math.floor(1000 * math.log((2 * len(words) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def check(docs, items, **k):
    got = sorted((tuple(r) for r in T.search(docs, items, **k).collect()), key=str)
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()], k.get("top", 10))
    assert got == want
    return got


@pytest.mark.parametrize("sizes", [{}, {"block_entries": 3000, "leaf": 3}, {"top": 3, "leaf": 1, "item_bytes": 900}])
def test_documents_against_every_pair(spark, sf, sizes):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert check(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), items, **sizes)


def test_ties_copies_and_awkward_rows(spark):
    rows = [(900 - i, "alpha beta gamma", "en", "a", 0) for i in range(40)] + [(2000 + i, f"alpha beta gamma delta{i}", "en", "a", 0) for i in range(60)]
    rows += [(None, "alpha beta gamma", "en", "a", 0)] * 3 + [(7, "ALPHA-beta_gamma\x00É é ß", "en", "a", 0), (7, "ALPHA-beta_gamma\x00É é ß", "en", "a", 0)]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, documents(spark).schema)).selectExpr("*", "1 as rank", "2 as score", "'x' as terms")
    items = [(1, "Alpha alpha beta"), (1, "Alpha alpha beta"), (2, None), (3, ""), (4, "...,;"), (5, "unseen"), (None, "é gamma"), (6, "word5x5 Word6x6 words plain"), (7, "delta3 delta4"), (8, "É")]
    items = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' as doc_id")
    got = check(docs.repartition(5), items, leaf=4)
    assert [r[2] for r in sorted(r for r in got if r[0] == 1)][:3] == [861, 862, 863]
    check(docs.coalesce(1), items, block_entries=50, leaf=2)
    assert T.search(empty(spark), items).count() == 0 and T.search(docs, empty(spark, ITEMS)).count() == 0


def test_subtrees_are_left_out(monkeypatch):
    import random

    import numpy as np

    rnd = random.Random(5)
    docs = [(i, rnd.randint(30, 300), r := np.array(sorted(rnd.sample(range(40), rnd.randint(1, 12))), np.int32), np.array([rnd.randint(1, 4) for _ in r], np.int32)) for i in range(3000)]
    tree, seen, best = T.Tree(docs, 8), [], []
    reduceat = np.add.reduceat
    item = [(30, 900), (35, 4000), (38, 2500)]
    monkeypatch.setattr(T.np, "add", type("add", (), {"reduceat": staticmethod(lambda x, at: seen.append(len(at)) or reduceat(x, at))}))
    tree.search(item, np.zeros(40, np.int64), best, 10)
    monkeypatch.undo()
    want = sorted((-sum(w * T.impact(int(t[list(r).index(k)]), m) for k, w in item if k in r), False, i) for i, m, r, t in docs)[:10]
    assert best == want and sum(seen) < len(docs) / 2
