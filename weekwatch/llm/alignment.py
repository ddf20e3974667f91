"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide counts of the linked id pairs.

A text with a space before it is encoded by the byte-level tokenizer A; the piece tokenizer B adds that space itself. The
ends of all tokens, counted in bytes, are keys of one table per side, end -> index, addressed by the end itself. The keys that
both tables hold, in order, slice both id lists into groups. Within a slice each stretch between two ends of either side lies in one
token of A and one of B, which is one link; so a slice of p and q tokens has p + q - 1 links.

Texts are aligned in blocks of about `block_tokens` tokens. A block keeps, packed, which of its own distinct id pairs each of its
documents links how often; its distinct pairs, with their sums, go into the corpus count, so the most frequent pair of
all sends one row per block. Counts come back to a block once per distinct pair of it, and are added up by document there.

Defined cases: a null or empty text, and one whose tokens of either side do not give back its bytes (such as one with U+2581),
has no tokens: zeros and an empty digest column. Repeated rows are documents of their own, and count each. A very long text is a block of its own. A text of white space is
encoded like any other. An empty table gives no row. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store

BLOCK_TOKENS = 1_000_000
SHIFT = 32  # an id pair is a << SHIFT | b
A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


class Byte:
    """The byte-level tokenizer from a file of ranks: its ids and how many bytes each has."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes, self.starts, self.lengths, *self.names = _by_id({i: t for t, i in ranks.items()}, "|")

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(" " + text)


class Piece:
    """The piece tokenizer: <0xHH> is the byte HH, U+2581 a space."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self._model
        pieces = ((i, m.id_to_piece(i)) for i in range(m.vocab_size()))
        self.bytes, self.starts, self.lengths, *self.names = _by_id({i: bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in pieces}, ";")

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


def _by_id(tokens: dict[int, bytes], last: str) -> tuple[np.ndarray, ...]:
    """Bytes of all tokens in a row; by id, where they start there, lengths, and decimal names with a comma and with the sign behind a group's last token."""
    every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(t) for t in every], np.int64)
    names = [np.array([f"{i}{sign}" for i in range(len(every))], "S8").view("<u8") for sign in (",", last)]  # ids of up to seven digits
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(lengths) - lengths, lengths, *names


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[Byte, Piece]:
    return Byte(a_path), Piece(b_path)


def align(text: str | None, a: Byte, b: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids, ends in bytes and cuts of A and of B: group g has the ids from cut g to cut g + 1. None if there are no tokens."""
    if not text:
        return None
    want = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
    sides = []
    for side in (a, b):
        ids = np.array(side.encode(text), np.int64)
        ends = np.cumsum(side.lengths[ids])
        if not len(ids) or ends[-1] != len(want) or not np.array_equal(_bytes_of(side, ids, ends), want):
            return None
        index = np.zeros(len(want) + 1, np.int32)
        index[ends] = np.arange(1, len(ids) + 1)
        sides.append((ids, ends, index))
    (ids_a, ends_a, index_a), (ids_b, ends_b, index_b) = sides
    common = np.flatnonzero((index_a > 0) & (index_b > 0))
    cuts_a, cuts_b = (np.concatenate([[0], index[common]]) for index in (index_a, index_b))
    return ids_a, ids_b, ends_a, ends_b, cuts_a, cuts_b


def _bytes_of(side: Byte | Piece, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all tokens, one after the other."""
    lengths = side.lengths[ids]
    at = np.repeat(side.starts[ids] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return side.bytes[at]


def links_of(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The linked id pairs of all slices: the stretch up to each end of either side lies in one token of A and one of B."""
    in_b, in_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    alone = ends_a[in_a] != ends_b  # a common end closes one stretch, not two
    return np.concatenate([ids_a << SHIFT | ids_b[in_b], ids_a[in_a[alone]] << SHIFT | ids_b[alone]])


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, names_a: list[np.ndarray], names_b: list[np.ndarray]) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the names of all tokens, eight bytes each with the sign behind, are laid at their places; bytes left zero go."""
    # a token of A comes after the tokens of B of earlier groups, one of B after those of A up to its own
    at_a = np.arange(cuts_a[-1]) + np.repeat(cuts_b[:-1], np.diff(cuts_a))
    at_b = np.arange(cuts_b[-1]) + np.repeat(cuts_a[1:], np.diff(cuts_b))
    out = np.empty(len(at_a) + len(at_b), "<u8")
    for at, ids, cuts, (within, last) in ((at_a, ids_a, cuts_a, names_a), (at_b, ids_b, cuts_b, names_b)):
        out[at] = within[ids[: len(at)]]
        ends = cuts[1:] - 1
        out[at[ends]] = last[ids[ends]]
    signs = out.view(np.uint8)
    return signs[signs != 0].tobytes()[:-1]


#: at, times, pairs and sums are compressed little-endian arrays
BLOCK = (
    "block string, doc_ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "n_pairs array<int>, at binary, times binary, pairs binary, sums binary"
)


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _block(name: str, docs: list[tuple], links: list[np.ndarray]) -> tuple:
    """One row: what each document links, as indices into the block's distinct pairs and how often."""
    lengths = np.array([len(x) for x in links], np.int64)
    seen, first = pd.factorize(np.concatenate(links) if links else np.zeros(0, np.int64))  # numbers by first sight, without a sort of all links
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    pairs, inverse, sums = first[order], rank[seen], np.bincount(seen, minlength=len(first))[order]
    by_doc, times = np.unique(np.repeat(np.arange(len(links)), lengths) << SHIFT | inverse, return_counts=True)
    n_pairs = np.bincount(by_doc >> SHIFT, minlength=len(links)) if len(links) else np.zeros(0, np.int64)
    columns = [list(x) for x in zip(*docs)]
    return (
        name, *columns, n_pairs.tolist(), _packed(by_doc & ((1 << SHIFT) - 1), "<u4"), _packed(times, "<u4"), _packed(pairs, "<i8"), _packed(sums, "<i8"),
    )


def blocks_of(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block of documents."""
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        a, b = tokenizers(a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE))
        done, links, size = [], [], 0
        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"]):
                got = align(text if isinstance(text, str) else None, a, b)
                if got is None:
                    done.append((doc_id, 0, 0, 0, 0, ""))
                    links.append(np.zeros(0, np.int64))
                    size += 1
                else:
                    ids_a, ids_b, ends_a, ends_b, cuts_a, cuts_b = got
                    links.append(links_of(ids_a, ids_b, ends_a, ends_b))
                    sha = hashlib.sha256(groups_text(ids_a, ids_b, cuts_a, cuts_b, a.names, b.names)).hexdigest()
                    done.append((doc_id, len(ids_a), len(ids_b), len(cuts_a) - 1, len(links[-1]), sha))
                    size += len(links[-1])
                if size >= block_tokens:
                    yield pd.DataFrame([_block(uuid.uuid4().hex, done, links)], columns=names, dtype=object)
                    done, links, size = [], [], 0
        if done:
            yield pd.DataFrame([_block(uuid.uuid4().hex, done, links)], columns=names, dtype=object)

    # ids travel as text: whole numbers with gaps would come as rounded floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, BLOCK)


def _pairs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for name, pairs, sums in zip(f["block"], f["pairs"], f["sums"]):
            pairs = _unpacked(pairs, "<i8")
            yield pd.DataFrame({"block": pd.Series([name] * len(pairs), dtype=object), "at": np.arange(len(pairs), dtype=np.int32), "pair": pairs, "n": _unpacked(sums, "<i8")})


DOCS = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _by_document(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r in f.itertuples(index=False):
            n = np.zeros(len(r.counts), np.int64)
            best = np.zeros(len(r.counts), np.int64)
            for c in r.counts:
                n[c["at"]], best[c["at"]] = c["n"], c["best"]
            at, times = _unpacked(r.at, "<u4"), _unpacked(r.times, "<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(r.doc_ids)), r.n_pairs)
            count_sum, n_best = np.zeros(len(r.doc_ids), np.int64), np.zeros(len(r.doc_ids), np.int64)
            np.add.at(count_sum, owner, times * n[at])
            np.add.at(n_best, owner, times * best[at])
            yield pd.DataFrame(
                {"doc_id": pd.Series(list(r.doc_ids), dtype=object), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links, "n_best": n_best, "count_sum": count_sum, "groups_sha256": pd.Series(list(r.groups_sha256), dtype=object)}
            )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in the whole corpus, and whether no other has more with the same id of B."""
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # one row per id of B, at most its vocabulary
    most = counts.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = store(blocks_of(docs, a_path, b_path, block_tokens))
    pairs = store(blocks.select("block", "pairs", "sums").mapInPandas(_pairs_of, "block string, at int, pair long, n long"))
    counts = store(pair_counts(pairs)).withColumnRenamed("pair", "counted")
    back = pairs.join(counts, F.col("pair") == F.col("counted")).groupBy("block").agg(F.collect_list(F.struct("at", F.col("total").alias("n"), "best")).alias("counts"))
    # a block of texts without tokens has no pairs
    joined = blocks.drop("pairs", "sums").join(back.withColumnRenamed("block", "counted"), F.col("block") == F.col("counted"), "left")
    none = F.array().cast("array<struct<at:int,n:bigint,best:int>>")
    return joined.withColumn("counts", F.coalesce("counts", none)).drop("counted").mapInPandas(_by_document, DOCS).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op13_align_tokenizers")
def op13(spark, sf_dir):
    """All documents, by the byte-level and the piece tokenizer."""
    return aligned(table(spark, sf_dir, "documents"))
