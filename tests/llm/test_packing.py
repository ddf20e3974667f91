import random
import zlib

import numpy as np
import public_tokenizers
import tokenizers
from helpers import documents, empty
from pyspark.sql import functions as F

from weekwatch.llm import packing as P

TRICKY = [
    "", " ", "a  b", " x", "x ", "é b c", "hi!? it's 12,5 x' 's don't we'll", "a <|endoftext|> b", "a<|endoftext|>b", "a. b.\n c", "a .\nb", "\n\n a",
    "1a a1 ª² ǅ ʰ .", "中文。 ok", "a ! b", "x.y z,,", "tab\there", "no break a b", "ends.\n", "🙂 🙂🙂 a", "İ i̇ ß", "word. word! word? wo:rd;",
]


def reference():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def test_ids_are_those_of_the_tokenizers_file(spark, sf):
    enc, ref = P._Encoder(P.VOCABULARY, P.RANKS), reference()
    texts = TRICKY + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for t in texts + texts[::-1]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids, t[:80]


def test_few_kept_units_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHED_UNITS", 3)
    enc, ref = P._Encoder(P.VOCABULARY, P.RANKS), reference()
    text = " ".join(f"alpha{'bcdefgh'[i % 7]} next. {i}" for i in range(200))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 700):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        bins, room = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            bins.append(k)
        assert P.first_fit_decreasing(np.array(sizes), 100).tolist() == bins


def check(packed, texts, length):
    """Every id of every document in one piece, pieces without gaps in their sequences."""
    ref, ids = reference(), {}
    for key, t in texts.items():
        ids[key] = [*ref.encode(t or "", add_special_tokens=False).ids, P.END_ID]
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[key][r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[key]), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids[key])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and {(r.sequence_tokens, r.padding) for r in pieces} == {(at, 0 if at & (at - 1) == 0 else length - at)}


def test_all_documents_are_packed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(P.pack(docs).collect(), texts, 2048)
    small = P.pack(docs, length=64, group_pieces=300).collect()
    check(small, texts, 64)
    used = {r.sequence_id: r.sequence_tokens for r in small}
    assert sum(used.values()) > 0.95 * 64 * len(used)


def test_awkward_rows(spark):
    docs = documents(spark, extra=("sequence_id", "length", "deal"))
    packed = P.pack(docs)
    assert packed.where("doc_id = 1").count() == 2 and packed.where("doc_id is null").count() == 3
    texts = {r.doc_id: r.text for r in docs.where("doc_id > 1").collect()}
    check([r for r in P.pack(docs.where("doc_id > 1")).collect()], texts, 2048)
    assert packed.where(F.col("doc_id").isin(2, 3)).select("length", "doc_tokens").collect() == [(1, 1), (1, 1)]
    assert P.pack(empty(spark)).count() == 0
