"""Removal of repeated passages: content-defined chunks of lines, and every run of whole lines over `run_words` words.

The lines of a text are hashed; a rolling hash over the last two line hashes ends a chunk where it falls on one of
`divisor` values, so boundaries hang on the lines around them and come back after an insertion.
A line of at least `long_words` words is a chunk of its own. Chunks of at least two lines and `least_words` words, and
long lines, are counted by hash over all texts.

With `run_words`, runs of byte-equal lines of any place and length are found as well. From each line the shortest
window of lines down to over `run_words` words is taken, and up to each line the shortest such window before it. A
repeated run of over `run_words` words is covered by its downward windows and, at its end, by its upward ones; all
of these lie in it. Each window holds the downward window of its first line, and the line of most words in that one (by hash
among equals) is the window's seed. Seeds are counted by hash over all texts like chunks; windows are made for repeated seeds only.

Chunks that occur again are grouped by their bytes. Windows are grouped by the sequence of their lines' hashes, and the lines of
all candidate windows are compared by bytes once, as a dictionary of distinct lines: where no two lines share a hash, equal
sequences are equal bytes; where some do, windows are grouped by their bytes instead. Of equal ones the first (by doc_id, then by text and place) stays and the lines of all others are removed, but for windows that overlap
the first one in its own text. Each line that goes is in an earlier place, so of each passage one copy stays.

Only numbers and hashes of all texts are shuffled, and the bytes of repeated chunks, merged before they
are; a passage that a third of all documents share is one row per task from there on.

Defined cases: a null text stays null, a text without a repeated passage stays as it is; a text may become
empty; null doc_ids come first. Rows with equal doc_id and text are one document to the count and are treated alike. An empty
table gives no row. Only doc_id, text and the columns named in `carry` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.chat import let
from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

DIVISOR, LONG_WORDS, LEAST_LINES, LEAST_WORDS = 3, 50, 2, 25
RUN_WORDS = 50  # runs of more words than this are found wherever they begin and end
SALTS = 64  # a passage that a third of all documents share is joined in so many parts, one of two copies in two; a bit each
BASE = np.uint64(0x9E3779B97F4A7C15)
WHOLE = 0x5851F42D4C957F2D  # keeps the hashes of whole texts apart from those of chunks
CHUNK = "doc_id long, text_hash long, chunk_no int, hash long, first_line int, lines int, words int"
WINDOW = "doc_id long, text_hash long, first_line int, lines int, key binary"
LINE = "hash long, line binary"


def chunk_bounds(lines: list[bytes], divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> tuple[list[int], list[int]]:
    """First line of each chunk, and the words of each line."""
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    words = [len(x.split()) for x in lines]
    rolling = np.r_[np.uint64(0), h[:-1]] * BASE + h
    ends = (rolling >> np.uint64(32)) % np.uint64(divisor) == 0
    long = np.array(words) >= long_words
    ends = ends | long | np.r_[long[1:], False]
    return [0, *(np.flatnonzero(ends[:-1]) + 1).tolist()], words


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def windows_of(words: list[int], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Lines [a, b) of the shortest windows of over `run_words` words from each line down, and from each line up."""
    total = np.r_[0, np.cumsum(np.array(words, np.int64))]
    n, at = len(words), np.arange(len(words))
    down = np.searchsorted(total, total[:-1] + run_words, "right")
    up = np.searchsorted(total, total[1:] - run_words, "left") - 1
    out = {(int(a), int(b)) for a, b in zip(at, down) if b <= n}
    return sorted(out | {(int(a), int(e) + 1) for a, e in zip(up, at) if a >= 0})


def seeds_of(h: np.ndarray, words: list[int], run_words: int = RUN_WORDS) -> dict[int, int]:
    """First line of each downward window -> the window's line of most words, of the largest hash among equals."""
    total = np.r_[0, np.cumsum(np.array(words, np.int64))]
    down = np.searchsorted(total, total[:-1] + run_words, "right")
    out: dict[int, int] = {}
    queue: deque[int] = deque()  # lines of the window, best first
    end = 0
    for a in range(len(words)):
        b = int(down[a])
        if b > len(words):
            break
        for i in range(end, b):
            while queue and (words[queue[-1]], h[queue[-1]]) <= (words[i], h[i]):
                queue.pop()
            queue.append(i)
        end = b
        while queue[0] < a:
            queue.popleft()
        out[a] = queue[0]
    return out


def _line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)


def chunks_of(
    docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS,
    run_words: int | None = None, whole_texts: bool = False,
) -> DataFrame:
    """One row per chunk that is large enough to be removed if it occurs elsewhere, and per seed of windows (chunk_no < 0)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text_hash, text in zip(f["doc_id"], f["text_hash"], f["text"]):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                starts, words = chunk_bounds(lines, divisor, long_words)
                for no, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
                    n = sum(words[a:b])
                    if n >= long_words or (b - a >= least_lines and n >= least_words):
                        rows.append((doc_id, text_hash, no, _signed(xxhash.xxh64_intdigest(b"\n".join(lines[a:b]))), a, b - a, n))
                if whole_texts and 0 < sum(words) <= (run_words or sum(words)):
                    rows.append((doc_id, text_hash, len(starts), _signed(xxhash.xxh64_intdigest(b"\n".join(lines)) ^ WHOLE), 0, len(lines), sum(words)))
                if run_words is not None and sum(words) > run_words:
                    h = _line_hashes(lines)
                    for i in set(seeds_of(h, words, run_words).values()):
                        rows.append((doc_id, text_hash, -1 - i, _signed(int(h[i] ^ BASE)), i, 0, 0))
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "chunk_no", "hash", "first_line", "lines", "words"])
            yield out.astype({"text_hash": "int64", "hash": "int64"})

    # ids travel as text: whole numbers with gaps would come as rounded floats
    cols = [F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "text"]
    return docs.where("text is not null").select(*cols).mapInPandas(run, CHUNK.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _windows(text: str, seeds: set[int], run_words: int) -> tuple[list[bytes], np.ndarray, list[tuple[int, int]]]:
    """The lines of a text, their hashes, and the windows over its seeds."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    words, h = [len(x.split()) for x in lines], _line_hashes(lines)
    best = seeds_of(h, words, run_words)
    return lines, h, [(a, b) for a, b in windows_of(words, run_words) if best[a] in seeds]


def windows_at(found: DataFrame, run_words: int, by_bytes: bool = False) -> DataFrame:
    """One row per window over the seeds of each text (doc_id, text_hash, text, seeds); its key is the hashes of its lines, or their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text_hash, text, at in zip(f["doc_id"], f["text_hash"], f["text"], f["seeds"]):
                lines, h, windows = _windows(text, set(at.tolist()), run_words)
                for a, b in windows:
                    rows.append((doc_id, text_hash, a, b - a, b"\n".join(lines[a:b]) if by_bytes else h[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "first_line", "lines", "key"]).astype({"text_hash": "int64"})

    cols = [F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "text", "seeds"]
    return found.select(*cols).mapInPandas(run, WINDOW.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def window_lines(found: DataFrame, run_words: int) -> DataFrame:
    """(hash, line): the lines of all windows over the seeds, equal ones of a batch of texts once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = set()
            for text, at in zip(f["text"], f["seeds"]):
                lines, h, windows = _windows(text, set(at.tolist()), run_words)
                for i in {i for a, b in windows for i in range(a, b)}:
                    rows.add((_signed(int(h[i])), lines[i]))
            yield pd.DataFrame(list(rows), columns=["hash", "line"]).astype({"hash": "int64"})

    return found.select("text", "seeds").mapInPandas(run, LINE)


def shared_hashes(lines: DataFrame) -> DataFrame:
    """Hashes that lines of different bytes have."""
    return lines.distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")


def repeated_windows(found: DataFrame, run_words: int, by_bytes: bool | None = None) -> DataFrame:
    """(doc_id, text_hash, first_line, lines): windows that an earlier place has. Without `by_bytes` the lines decide the key."""
    seeds = F.transform(F.filter("spans", lambda s: s["chunk_no"] < 0), lambda s: s["first_line"])
    seeded = found.where("spans is not null").select("doc_id", "text_hash", "text", seeds.alias("seeds")).where(F.size("seeds") > 0)
    if by_bytes is None:
        by_bytes = not shared_hashes(window_lines(seeded, run_words)).isEmpty()
    windows = store(windows_at(seeded, run_words, by_bytes).distinct())
    place, salt = F.struct("doc_id", "text_hash", "first_line"), _salt("first_line")
    firsts = windows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"), _parts(salt)).where("n > 1")
    firsts = _every_part(firsts.select(F.col("key").alias("f_key"), "first", "parts"))
    later = windows.join(firsts, (F.col("key") == F.col("f_key")) & (salt == F.col("part")))
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return later.where(~(same_text & (F.col("first_line") < F.col("first.first_line") + F.col("lines")))).select("doc_id", "text_hash", "first_line", "lines")


CUT = "text string, lines long, words long"


def _without(text: Column, removed: Column) -> Column:
    """The text without the removed spans of lines, which may overlap, and what they had."""

    @F.pandas_udf(CUT)
    def run(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, removed):
            if spans is None:
                out.append((text, 0, 0))
                continue
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            gone = np.zeros(len(lines), bool)
            for s in spans:
                gone[s["first_line"] : s["first_line"] + s["lines"]] = True
            left = b"\n".join(x for x, g in zip(lines, gone) if not g)
            out.append((left.decode("utf-8", "surrogatepass"), int(gone.sum()), sum(len(x.split()) for x, g in zip(lines, gone) if g)))
        return pd.DataFrame(out, columns=["text", "lines", "words"])

    return run(text, removed)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _salt(no: str = "chunk_no") -> Column:
    """The part in which a row is joined with its group."""
    return F.pmod(F.xxhash64("doc_id", "text_hash", no), F.lit(SALTS)).cast("int")


def _parts(salt: Column) -> Column:
    """The parts that the rows of a group have, a bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("parts")


def _every_part(groups: DataFrame) -> DataFrame:
    """One row per group becomes one for each part that has rows of it."""
    taken = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("parts", i) == 1)
    return groups.withColumn("part", F.explode(taken)).drop("parts")


def remove_repeated(docs: DataFrame, carry: tuple[str, ...] = (), run_words: int | None = None, **limits) -> DataFrame:
    """One row per row of `docs`: doc_id, text, `carry`, lines_removed, words_removed, chunks_removed.

    Without `run_words` only chunks are looked for; chunks_removed counts these alone. With `whole_texts`, texts of at most
    `run_words` words count as one chunk each as well, so that an exact copy goes wholly; longer copies go as runs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # equal rows give equal chunk rows, which count once
    chunks = cut_lineage(store(chunks_of(rows, run_words=run_words, **limits)).distinct())
    repeated = chunks.groupBy("hash").agg(F.count("*").alias("n"), _parts(_salt())).where("n > 1")
    repeated = _every_part(repeated.select(F.col("hash").alias("r_hash"), "parts"))
    spans = (
        chunks.join(repeated, (F.col("hash") == F.col("r_hash")) & (_salt() == F.col("part")), "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "hash", "first_line", "lines", "words"))).alias("spans"))
    )
    found = store(_with(rows, spans, "spans"))

    def bytes_of(lines: Column) -> Column:
        return F.transform("spans", lambda s: F.struct(s.alias("s"), F.array_join(F.slice(lines, s["first_line"] + 1, s["lines"]), "\n").alias("bytes")))

    chunked = F.filter("spans", lambda s: s["chunk_no"] >= 0)
    cut = found.where("spans is not null").withColumn("spans", chunked).select("doc_id", "text_hash", F.explode(let(_lines(F.col("text")), bytes_of)).alias("c"))
    cut = cut.select("doc_id", "text_hash", "c.s.*", "c.bytes")
    place = F.struct("doc_id", "text_hash", "chunk_no")
    # grouping by the bytes compares them; the first of equal chunks stays. Digests name the groups, so that the join back is lean
    firsts = cut.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"), _parts(_salt()))
    firsts = _every_part(
        firsts.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("hash").alias("f_hash"), F.sha2("bytes", 256).alias("f_digest"), "first", "parts")
    )
    marked = cut.select("doc_id", "text_hash", "chunk_no", "hash", "first_line", "lines", "words", F.sha2("bytes", 256).alias("digest")).distinct()
    same = (F.col("hash") == F.col("f_hash")) & (F.col("digest") == F.col("f_digest")) & (_salt() == F.col("part"))
    gone = marked.join(firsts, same).where(~place.eqNullSafe(F.col("first")))
    spans = gone.select("doc_id", "text_hash", "first_line", "lines", F.lit(1).alias("chunk"))
    if run_words is not None:
        spans = spans.unionByName(repeated_windows(found, run_words).withColumn("chunk", F.lit(0)))
    removed = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first_line", "lines")).alias("removed"), F.sum("chunk").alias("chunks_removed")
    ).select("doc_id", "text_hash", F.struct("removed", "chunks_removed").alias("r"))
    out = _with(found.where("spans is not null").drop("spans"), removed, "r")
    out = out.withColumn("w", _without(F.col("text"), F.col("r.removed"))).select(
        "doc_id", F.col("w.text").alias("text"), *carry, F.col("w.lines").alias("lines_removed"), F.col("w.words").alias("words_removed"),
        F.coalesce("r.chunks_removed", F.lit(0)).cast("long").alias("chunks_removed"),
    )
    none = [F.lit(0).cast("long").alias(f"{x}_removed") for x in ("lines", "words", "chunks")]
    return out.unionByName(found.where("spans is null").select("doc_id", "text", *carry, *none))


def _with(rows: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """Joins a column of one row per (doc_id, text_hash)."""
    right = more.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), name)
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left").drop("m_id", "m_hash")


@query("op6_line_dedup")
def op6(spark, sf_dir):
    """All documents without passages that an earlier one has."""
    return remove_repeated(table(spark, sf_dir, "documents"), run_words=RUN_WORDS)
