import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, empty

from weekwatch.llm import ppm as M


def plain(rows, order):
    """Scores by a trie and escapes with exclusion, symbol by symbol."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [M.lowered(t) for _, t in rows]
    trie, words, ends = defaultdict(Counter), Counter(), 0
    for h, t in zip(held, texts):
        if not h:
            ends += 1
            words.update(t.split())
            s = [M.START] * order + list(t) + [M.END]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    trie[tuple(s[i - k : i])][s[i]] += 1

    def lp(context, x):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = trie.get(tuple(context[order - k :]))
            left = {y: n for y, n in (seen or {}).items() if y not in excluded}
            if left:
                room = sum(left.values()) + len(left)
                if x in left:
                    return out + math.log10(left[x] / room)
                out += math.log10(len(left) / room)
                excluded |= set(left)
        return out - math.log10(M.SYMBOLS - len(excluded))

    tokens, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for (i, _), h, t in zip(rows, held, texts):
        s = [M.START] * order + list(t) + [M.END]
        c = [words[w] for w in t.split()] + [ends]
        base = sum(math.log10((n + 1) / (tokens + distinct + 1)) for n in c)
        out.append((i, h, len(c), sum(n > 0 for n in c), tokens, base, sum(lp(s[j - order : j], s[j]) for j in range(order, len(s)))))
    if ends:
        assert math.isclose(sum(10 ** lp(list(texts[0][:order]) if len(texts[0]) >= order else [M.START] * order, x) for x in range(M.SYMBOLS)), 1)
    return out


def check(df, order, **k):
    want = sorted(plain([(r.doc_id, r.text) for r in df.collect()], order), key=lambda r: (str(r[0]), r[5]))
    got = M.language_scores(df, order, **k).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_documents_against_a_plain_trie(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 5000)
    check(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60"), 3, block_bytes=50_000)


def test_awkward_rows(spark):
    docs = documents(spark, extra=("block", "gram", "score"))
    check(docs.where("doc_id is null or doc_id <> 5"), M.ORDER)


def test_a_long_text_is_scored_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 1000)
    docs = documents(spark)
    check(docs.selectExpr("doc_id", "substr(text, 1, 20000) as text"), 2)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = M.language_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0
    assert math.isclose(r.score, -3 * math.log10(257))
    assert M.language_scores(empty(spark)).count() == 0


def test_held_out_text_is_better_predicted_than_by_chance_or_shorter_contexts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_order = {}
    for order in (1, 3):
        held = M.language_scores(docs, order).where("held_out").selectExpr("sum(score) as s", "sum(n_tokens) as n").first()
        by_order[order] = held.s / held.n
    assert by_order[3] > by_order[1] > -14


def test_tables_find_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**54, 50_000))
    t = M._Table(keys, np.arange(len(keys), dtype=float))
    assert (t.of(keys[::-1].copy()) == np.arange(len(keys))[::-1]).all()
    with pytest.raises(KeyError):
        t.of(np.array([2**55 + 1]))
