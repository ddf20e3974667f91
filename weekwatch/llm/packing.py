"""Packing documents into training sequences: first-fit decreasing in randomised groups.

A document becomes token ids and one end id. Ids are cut into pieces of the sequence length and a
remainder. Pieces are dealt at random into groups of about `group_pieces` rows; each group is packed
by first-fit decreasing, where a tournament tree over the free room of the open sequences finds the
first that a piece fits in. Only piece lengths are packed, so a group is small however long the
texts are, and the number of groups follows the number of pieces. Sequences of `length` ids are full,
and so are those whose filled length is a power of two; only the others are padded.

Defined cases: a null or empty text is the end id alone; equal rows (even with a null doc_id) are
packed each on its own; an empty table gives no piece. Only doc_id and text are read, so other columns
cannot clash. The same rows in the same files give the same sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from weekwatch.llm.registry import query, table
from weekwatch.session import cut_lineage

LENGTH, END_ID, GROUP_PIECES = 2048, 1, 20_000
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
CACHED_UNITS, MARKS = 300_000, ".,;:!?"

_loaded: dict[tuple[str, str], "_Encoder"] = {}
_NOT_PLAIN = re.compile(r" \s|\s ")


class _Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    In this vocabulary's splitting pattern a single space before another character always starts a
    piece, so the words between single spaces are encoded on their own and remembered. A word of letters
    is one piece, and one mark after it is the next. A text with any other white space next to a
    space is encoded whole. The same ids as the tokenizers file gives; tests compare them.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        self.whole = None
        if not ranks:
            import tokenizers

            self.whole = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
            return
        with open(public_tokenizers.path(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)
        self.piece = self.bpe._core_bpe.encode_single_piece
        self.marks = {m: self._ids(m) for m in MARKS}
        self.seen: dict[str, bytes] = {}

    def _remember(self, unit: str) -> bytes:
        """Ids of a word after a space, kept until there are too many."""
        word, mark = (unit[:-1], self.marks[unit[-1]]) if unit[-1] in self.marks else (unit, b"")
        if word.isalpha():
            ids = array("I", self.piece(b" " + word.encode())).tobytes() + mark
        else:
            ids = self._ids(" " + unit)
        if len(self.seen) >= CACHED_UNITS:
            self.seen.clear()
        self.seen[unit] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if self.whole else self.bpe.encode(text, allowed_special="all")
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole or not text:
            return self._ids(text)
        if text[-1] == " " or _NOT_PLAIN.search(text):
            return self._ids(text)
        units = text.split(" ")
        out = list(map(self.seen.get, units))
        out[0] = self._ids(units[0])
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    out[i] = self._remember(units[i])
        return b"".join(out)


def _encoder(vocabulary: str, ranks: str) -> _Encoder:
    if (vocabulary, ranks) not in _loaded:
        _loaded[vocabulary, ranks] = _Encoder(vocabulary, ranks)
    return _loaded[vocabulary, ranks]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def cut_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most `length` ids; `deal` is a number that deals equal rows apart."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, ordinal = _encoder(vocabulary, ranks), 0
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = enc.encode(text if isinstance(text, str) else "") + end
                n = len(ids) // 4
                ordinal += 1
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n, ordinal))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def first_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each size; sizes come in decreasing order. A tournament tree of free room finds the first fit."""
    n = len(sizes)
    leaves = 1 << max(1, (n - 1).bit_length())
    room = [length] * (2 * leaves)  # room[1] is the most room of any bin; leaf k is bin k
    bins = np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < size:
                k += 1
        bins[i] = k - leaves
        room[k] -= size
        k >>= 1
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            best = a if a >= b else b
            if room[k] == best:
                break
            room[k] = best
            k >>= 1
    return bins


def _pack_group(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "deal"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins = first_fit_decreasing(frame["length"].to_numpy(), length)
        frame["offset"] = frame.groupby(bins)["length"].cumsum() - frame["length"]
        frame["sequence_id"] = frame["packing_group"].astype("int64") * (1 << 32) + bins
        filled = frame.groupby(bins)["length"].transform("sum")
        frame["sequence_tokens"] = filled
        frame["padding"] = np.where((filled & (filled - 1)) == 0, 0, length - filled)
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padding"]]

    return run


PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padding long"
)


def pack(docs: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 29, **tokenizer) -> DataFrame:
    """One row per piece with its sequence, its offset there, and the ids and padding of that sequence."""
    pieces = cut_lineage(cut_pieces(docs, length, **tokenizer))
    groups = pieces.count() // group_pieces + 1
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", "deal", F.lit(seed)), F.lit(groups))
    return pieces.withColumn("packing_group", group).groupBy("packing_group").applyInPandas(_pack_group(length), PACKED)


@query("op1_pack_documents")
def op1(spark, sf_dir):
    """All documents in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
