"""Language-model scores by prediction by partial matching over bytes.

Training texts (ASCII capitals lowered) are read as bytes with an end symbol. The trie of the model holds, for each
context of up to `order` bytes, how often each symbol followed. A symbol is coded in the longest known
context: with probability n / (N + D) if it followed there (N symbols in all, D different ones), else an
escape of D / (N + D) goes on to the context without its first byte, where the symbols of the longer
context are excluded from all counts, and so on down to an even chance for the symbols left.
As the symbols of a context are among those of its shorter one, exclusion is the same for all symbols that
escape, so each (context, symbol) has one log probability, found by joins from order to order.

Texts are dealt into blocks of about `block_bytes`. A block gives its distinct grams (context and symbol) and
words with their training counts, once. These rows, summed, are the trie and the unigram counts;
joined back, they are what the block needs to be scored. So neither the model nor its counts are ever in
one place, and what is gathered grows with the input. Tasks read a block's rows in sorted order and hold
its distinct grams and words, never its texts together. Texts travel to their blocks in compressed parcels.

A document's training share is decided by crc32 of its id, so scores of the rest are held out. The base score
is the add-one unigram model over words and one end token.

Defined cases: a null text is empty and is scored as its end alone; a null doc_id is in training;
repeated rows count as often as they occur and get equal scores; without training rows symbols have even
chances; an empty table gives no row. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

ORDER, BLOCK_BYTES, SLICE = 5, 28 << 20, 1 << 19
END, START, BITS, SYMBOLS = 256, 257, 9, 257  # START only pads contexts, it is never coded
PARTS, HELD_OUT = 7, 2
PARCEL, PARCELS = 1 << 19, 16 << 20  # bytes of text in a parcel, and in all parcels that a task fills


def lowered(text) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""


def gram_slices(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, starts, docs): the grams of about SLICE symbols, where each text's share starts, and whose it is.

    A gram packs `order` symbols of context and the coded symbol, 9 bits each. Long texts are cut into
    several shares, each with the context before it.
    """
    head, tail = np.full(order, START, np.int64), np.array([END], np.int64)

    def grams(parts: list[np.ndarray], lengths: list[int], docs: list[int]):
        symbols = np.concatenate(parts)
        g = np.zeros(len(symbols) - order, np.int64)
        for k in range(order + 1):
            g = (g << BITS) | symbols[k : len(symbols) - order + k]
        # windows that reach over the start of a share belong to no text
        at = np.cumsum([0, *[n + order for n in lengths]])[:-1]
        keep = np.zeros(len(g) + order + 1, np.int32)
        np.add.at(keep, at, 1)
        np.add.at(keep, at + np.array(lengths), -1)
        return g[np.cumsum(keep)[: len(g)] > 0], np.cumsum([0, *lengths[:-1]]), np.array(docs)

    parts, lengths, docs, held = [], [], [], 0
    for d, text in enumerate(texts):
        symbols = np.concatenate((head, np.frombuffer(text, np.uint8), tail))
        for at in range(0, len(symbols) - order, SLICE):
            share = symbols[at : at + SLICE + order]
            parts.append(share)
            lengths.append(len(share) - order)
            docs.append(d)
            held += len(share)
            if held >= SLICE:
                yield grams(parts, lengths, docs)
                parts, lengths, docs, held = [], [], [], 0
    if parts:
        yield grams(parts, lengths, docs)


def _merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in pairs]) if pairs else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_block(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """Stretches of rows of one block, of batches that are sorted by block."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist() + [len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(blocks[a]), {c: batch.column(c).slice(a, b - a) for c in columns}


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, parcel): lowered texts of one block with their ids, compressed together."""
    held: dict[int, list] = {}
    size: Counter = Counter()
    pack = zstandard.ZstdCompressor(level=3)

    def sent(blocks: list[int]) -> pa.RecordBatch:
        out = [pack.compress(pickle.dumps(tuple(zip(*held.pop(b))), 5)) for b in blocks]
        for b in blocks:
            del size[b]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], names=["block", "parcel"])

    total = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "doc_id", "held_out", "text")]
        for block, doc_id, held_out, text in zip(*columns):
            text = lowered(text)
            held.setdefault(block, []).append((doc_id, held_out, text))
            size[block] += len(text)
            total += len(text)
            if size[block] >= PARCEL:
                total -= size[block]
                yield sent([block])
            if total >= PARCELS:
                yield sent(list(held))
                total = 0
    if held:
        yield sent(list(held))


def _opened(parcels: pa.Array, rows=None) -> Iterator[tuple[tuple, tuple, tuple]]:
    """(ids, held out, texts) of each parcel; they were packed by this job's own tasks."""
    unpack = zstandard.ZstdDecompressor()
    for i in range(len(parcels)) if rows is None else rows.tolist():
        yield pickle.loads(unpack.decompress(parcels[i].as_py()))


# No column is null, as nulls would turn packed grams into rounded floats on their way.
ASKED = "block int, gram long, word binary, n long"
NO_GRAM, NO_WORD = -1, b""
MERGE_AT, ROWS_OUT = 16, 1 << 17


def _gather(order: int):
    """Distinct grams and words of each block, each with its count in the block's training texts."""

    def rows_of(block: int, pairs: list, words: Counter) -> Iterator[pa.RecordBatch]:
        grams, n = _merged(pairs)
        for at in range(0, len(grams), ROWS_OUT):
            g = grams[at : at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(g), block, np.int32)), pa.array(g), pa.array([NO_WORD] * len(g), pa.binary()), pa.array(n[at : at + ROWS_OUT])],
                names=["block", "gram", "word", "n"],
            )
        keys = list(words)
        for at in range(0, len(keys), ROWS_OUT):
            w = keys[at : at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(w), block, np.int32)), pa.array(np.full(len(w), NO_GRAM, np.int64)),
                    pa.array(w, pa.binary()), pa.array([words[x] for x in w], pa.int64()),
                ],
                names=["block", "gram", "word", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, words = None, [], Counter()
        for block, columns in _by_block(batches, "parcel"):
            if block != now:
                if now is not None:
                    yield from rows_of(now, pairs, words)
                now, pairs, words = block, [], Counter()
                pa.default_memory_pool().release_unused()
            for _, held_out, texts in _opened(columns["parcel"]):
                for held in (False, True):
                    part = [t for t, h in zip(texts, held_out) if h == held]
                    for g, _, _ in gram_slices(part, order):
                        unique, counts = np.unique(g, return_counts=True)
                        pairs.append((unique, counts * (not held)))
                        if len(pairs) >= MERGE_AT:
                            pairs = [_merged(pairs)]
                    for t in part:
                        if held:
                            for w in t.split():
                                words.setdefault(w, 0)
                        else:
                            words.update(t.split())
        if now is not None:
            yield from rows_of(now, pairs, words)

    return run


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """(gram, n) with n training counts, 0 for grams only asked for -> (gram, lp), lp the log10 probability.

    One pass of joins an order: the counts of shorter grams are sums of the longest.
    """
    full = cut_lineage(grams)

    def gram(c: Column, k: int) -> Column:
        return c.bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))

    def context(c: Column, k: int) -> Column:
        return F.shiftright(gram(c, k), BITS)

    counts = {order: full.where("n > 0").select(F.col("gram").alias("g"), "n")}
    for k in range(order - 1, -1, -1):
        counts[k] = cut_lineage(counts[k + 1].groupBy(gram(F.col("g"), k).alias("g")).agg(F.sum("n").alias("n")))
    rows = full.select("gram", F.lit(0.0).alias("lp"), F.lit(False).alias("coded"), F.lit(0).cast("long").alias("out_n"), F.lit(0).cast("long").alias("out_d"))
    for k in range(order, -1, -1):
        with_shorter = counts[k]
        if k:
            shorter = counts[k - 1].select(F.col("g").alias("s"), F.col("n").alias("n_shorter"))
            with_shorter = counts[k].join(shorter, gram(F.col("g"), k - 1) == F.col("s"))
        # symbols in all, different ones, and how often those followed the shorter context
        contexts = with_shorter.groupBy(context(F.col("g"), k).alias("c")).agg(
            F.sum("n").alias("total"), F.count("*").alias("different"), (F.sum("n_shorter") if k else F.lit(0).cast("long")).alias("excluded")
        )
        rows = (
            rows.join(contexts, context(F.col("gram"), k) == F.col("c"), "left")
            .join(counts[k].select("g", F.col("n").alias("n_k")), gram(F.col("gram"), k) == F.col("g"), "left")
        )
        new = F.col("different") - F.col("out_d")
        room = F.col("total") - F.col("out_n") + new
        step = (
            F.when(F.col("coded") | F.col("c").isNull(), 0.0)
            .when(F.col("n_k").isNotNull(), F.log10(F.col("n_k") / room))
            .when(new > 0, F.log10(new / room))
            .otherwise(0.0)
        )
        seen = F.col("c").isNotNull()
        rows = rows.select(
            "gram", (F.col("lp") + step).alias("lp"), (F.col("coded") | F.col("n_k").isNotNull()).alias("coded"),
            F.when(seen, F.col("excluded")).otherwise(F.col("out_n")).alias("out_n"),
            F.when(seen, F.col("different")).otherwise(F.col("out_d")).alias("out_d"),
        )
    rest = -F.log10(F.lit(float(SYMBOLS)) - F.col("out_d"))
    return rows.select("gram", F.when(F.col("coded"), F.col("lp")).otherwise(F.col("lp") + rest).alias("lp"))


class _Table:
    """Values by whole number: open addressing in whole arrays, at most seven tenths full."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, math.ceil(math.log2(len(keys) / 0.7 + 1)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.FACTOR) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that must be there."""
        slot = self._home(keys)
        out, left = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        slot, keys = slot[left], keys[left]
        while len(left):
            if (self.keys[slot] == -1).any():
                raise KeyError("a key was not gathered")
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys
            out[left[hit]] = self.values[slot[hit]]
            left, slot, keys = left[~hit], slot[~hit], keys[~hit]
        return out


class _Counts:
    """Counts by word, held by the words' hashes where no two of the block's words share one."""

    def __init__(self, hashes: list[np.ndarray], counts: list[np.ndarray], words: list[pa.Array]):
        none = np.zeros(0, np.int64)
        h, c = np.concatenate([none, *hashes]), np.concatenate([np.zeros(0), *counts])
        self.plain = None
        if len(np.unique(h)) == len(h):
            self.table = _Table(h, c)
        else:
            self.plain = {w: n for part, n_part in zip(words, counts) for w, n in zip(part.to_pylist(), n_part.tolist())}

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.plain is not None:
            return np.array([self.plain[w] for w in words], np.float64)
        return self.table.of(np.fromiter(map(hash, words), np.int64, len(words)))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
GRAM, WORD, TEXT = 0, 1, 2


def _score(order: int, tokens: int, distinct: int, ends: int):
    """Scores of texts that come after the log probabilities and counts of their block."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    log_all, end = math.log10(tokens + distinct + 1), math.log10(ends + 1)

    def scored(parcel: tuple[tuple, tuple, tuple], lps: _Table, counts: _Counts) -> pa.RecordBatch:
        ids, held_out, texts = parcel
        score, rows = np.zeros(len(texts)), []
        for g, starts, owners in gram_slices(texts, order):
            np.add.at(score, owners, np.add.reduceat(lps.of(g), starts))
        for t in texts:
            c = counts.of(t.split())
            rows.append((len(c) + 1, int((c > 0).sum()) + (ends > 0), float(np.log10(c + 1).sum() + end - (len(c) + 1) * log_all)))
        columns = [ids, held_out, *zip(*rows), score]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for block, columns in _by_block(batches, "kind", "gram", "word", "value"):
            if block != now:
                now, grams, words, lps, counts = block, [], [], None, None
                pa.default_memory_pool().release_unused()
            kind, value = columns["kind"].to_numpy(), columns["value"].to_numpy()
            of_kind = [np.flatnonzero(kind == k) for k in (GRAM, WORD, TEXT)]
            if len(of_kind[GRAM]):
                grams.append((columns["gram"].to_numpy()[of_kind[GRAM]], value[of_kind[GRAM]]))
            if len(of_kind[WORD]):
                part = columns["word"].take(pa.array(of_kind[WORD]))
                words.append((np.fromiter(map(hash, part.to_pylist()), np.int64, len(part)), value[of_kind[WORD]], part))
            if len(of_kind[TEXT]):
                if lps is None:
                    lps, counts = _Table(*map(np.concatenate, zip(*grams))), _Counts(*(zip(*words) if words else ((), (), ())))
                    grams, words = [], []
                for parcel in _opened(columns["word"], of_kind[TEXT]):
                    yield scored(parcel, lps, counts)

    return run


def language_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    blocks, ends = (sizes["bytes"] or 0) // block_bytes + 1, sizes["ends"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    parcels = dealt.mapInArrow(_parcels, "block int, parcel binary")
    # all parcels of a block in one task, in order; a task streams them
    asked = store(parcels.repartition("block").sortWithinPartitions("block").mapInArrow(_gather(order), ASKED))
    grams = asked.where(F.col("gram") != NO_GRAM).select("block", "gram", "n")
    same_word = W.partitionBy("word")
    words = store(
        asked.where(F.col("gram") == NO_GRAM).select(
            "block", "word", F.sum("n").over(same_word).alias("n"), (F.row_number().over(same_word.orderBy("block")) == 1).alias("first")
        )
    )
    seen = words.where("first and n > 0").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
    tokens, distinct = (seen["tokens"] or 0) + ends, seen["words"] + (ends > 0)
    lps = gram_scores(grams.groupBy("gram").agg(F.sum("n").alias("n")), order)
    gram, none = F.lit(NO_GRAM).cast("long").alias("gram"), F.lit(NO_WORD).alias("word")

    def of_kind(kind: int) -> Column:
        return F.lit(kind).alias("kind")

    found = grams.join(lps, "gram").select("block", of_kind(GRAM), "gram", none, F.col("lp").alias("value"))
    counted = words.select("block", of_kind(WORD), gram, "word", F.col("n").cast("double").alias("value"))
    texts = parcels.select("block", of_kind(TEXT), gram, F.col("parcel").alias("word"), F.lit(0.0).alias("value"))
    in_order = found.unionByName(counted).unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    scored = in_order.mapInArrow(_score(order, tokens, distinct, ends), SCORES)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


@query("op8_language_scores")
def op8(spark, sf_dir):
    """All documents scored by a model of the training part."""
    return language_scores(table(spark, sf_dir, "documents"))
