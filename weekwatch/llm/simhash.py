"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Documents link
if their fingerprints differ in at most `most` bits; components of links are near-duplicate groups.

Equal fingerprints are merged first, so a group of copies is one row from there on. The 64 bits are put
into m partitions, correlated bits together, and partition i gets a threshold t_i >= -1 with
sum(t_i) = most - m + 1: two fingerprints within `most` bits are within t_i bits in some partition, or
else they would differ in more. m and the thresholds are chosen by dynamic programming on the expected
numbers of key rows and candidate pairs, from the bit frequencies of all fingerprints. Within t_i
bits in a partition means equal but for some t_i of its bits, so a fingerprint is probed under one key for
each choice of t_i bits left out. Rows of one key are verified against each other on all 64 bits, and only
a spanning forest of a key's links is kept. A key with more than `bucket` rows is not looked at as a whole: its
rows are dealt into blocks of about that size, and each two blocks are verified by a task of their own.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; repeated rows and null doc_ids stay, a component's id
is its smallest doc_id (null if it has none). Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.graph import components
from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

WORDS, MOST, SEED = 4, 4, 42
BUCKET, SMALL_BUCKET, SHINGLE_BLOCK = 20_000, 12, 1 << 16
PARTITIONS = (2, 3, 4)
KEY_COST, PAIR_COST = 1.0, 0.02


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    # bytes.split and bytes.lower know exactly the ASCII white space and letters that are meant
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = (ends - [len(x) for x in w]).tolist()
    k = min(words, len(w))
    stops = ends[k - 1 :].tolist()
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(stops), SHINGLE_BLOCK):
        part = stops[at : at + SHINGLE_BLOCK]
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + len(part)], part)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(stops), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column, as a signed long of the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        fps = np.array([fingerprint(t if isinstance(t, str) else None, words) for t in texts], np.uint64)
        return pd.Series(fps.view(np.int64))

    return run(text.cast("string"))


# --- partitions and thresholds -----------------------------------------------------------------------


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and a 64 x 64 table of how many have both bits; 4,096 rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(f)
        i, j = np.divmod(np.arange(4096), 64)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total.ravel(), n).astype(np.int64)})

    got = classes.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in got:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal size; each starts at a bit and takes the bits most correlated with it so far."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(m):
        size = -(-len(free) // (m - k))
        start = max(sorted(free), key=lambda b: sum(corr[b, x] for x in free if x != b))
        part = [start]
        free.remove(start)
        while len(part) < size:
            nxt = max(sorted(free), key=lambda b: sum(corr[b, x] for x in part))
            part.append(nxt)
            free.remove(nxt)
        out.append(sorted(part))
    return out


def allocate(n: int, p: np.ndarray, parts: list[list[int]], most: int) -> tuple[float, list[int]]:
    """Thresholds of least expected cost: key rows, and pairs that agree under some key."""
    same = p * p + (1 - p) * (1 - p)

    def cost(part: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        # agree[k]: sum over the choices of k bits left out of the chance that all others agree
        agree = [1.0] + [0.0] * t
        for b in part:
            agree = [agree[k] * same[b] + (agree[k - 1] if k else 0.0) for k in range(t + 1)]
        return KEY_COST * n * comb(len(part), t) + PAIR_COST * n * n / 2 * agree[t]

    # best[s]: least cost of the parts so far with thresholds that sum to s
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, min(most, len(part)) + 1):
                new = (c + cost(part, t), [*ts, t])
                if s + t not in step or new < step[s + t]:
                    step[s + t] = new
        best = step
    return best[most - len(parts) + 1]


def masks_of(parts: list[list[int]], thresholds: list[int]) -> list[int]:
    """The key masks: a partition's bits without each choice of as many bits as its threshold."""
    out = []
    for part, t in zip(parts, thresholds):
        if t >= 0:
            full = sum(1 << b for b in part)
            out += [full & ~sum(1 << b for b in s) for s in combinations(part, t)]
    return out


def plan_masks(classes: DataFrame, most: int = MOST, partitions: tuple[int, ...] = PARTITIONS) -> list[int]:
    n, both = bit_statistics(classes)
    p = np.diag(both) / max(n, 1)
    plans = []
    for m in partitions:
        parts = correlated_partitions(n, both, m)
        cost, thresholds = allocate(n, p, parts, most)
        plans.append((cost, m, masks_of(parts, thresholds)))
    return min(plans)[2]


# --- probing and verifying ---------------------------------------------------------------------------


def _small_links(fps: np.ndarray, run_id: np.ndarray, longest: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of at most `longest` rows: each row against the next ones of its run."""
    a, b = [], []
    for d in range(1, longest):
        hit = np.flatnonzero((run_id[:-d] == run_id[d:]) & (np.bitwise_count(fps[:-d] ^ fps[d:]) <= most)) if len(fps) > d else []
        if len(hit):
            a.append(fps[hit])
            b.append(fps[hit + d])
    empty = np.zeros(0, fps.dtype)
    return (np.concatenate(a) if a else empty), (np.concatenate(b) if b else empty)


def _forest(fps: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the links among the rows, breadth first."""
    rest, a, b = fps, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                hit = rest[near]
                a += [x] * len(hit)
                b += hit.tolist()
                queue += list(hit)
                rest = rest[~near]
    return a, b


def _verify(most: int, bucket: int | None):
    """Rows sorted by (mask, key) -> links (a, b), or rows of too large keys as (a = fingerprint, mask)."""
    bucket = bucket or sys.maxsize

    def frame(a, b, mask=None) -> pd.DataFrame:
        a = np.asarray(a, np.uint64).view(np.int64)
        if mask is None:
            return pd.DataFrame({"a": a, "b": pd.array(np.asarray(b, np.uint64).view(np.int64), "Int64"), "mask": pd.array([pd.NA] * len(a), "Int64")})
        return pd.DataFrame({"a": a, "b": pd.array([pd.NA] * len(a), "Int64"), "mask": pd.array(np.full(len(a), mask, np.int64), "Int64")})

    def whole_runs(mask, key, fps) -> Iterator[pd.DataFrame]:
        new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(fps)])
        run_id = np.repeat(np.arange(len(new)), sizes)
        size_of = sizes[run_id]
        small = (size_of > 1) & (size_of <= SMALL_BUCKET)
        a, b = _small_links(fps[small], run_id[small], SMALL_BUCKET, most)
        yield frame(a, b)
        for r in np.flatnonzero((sizes > SMALL_BUCKET) & (sizes <= bucket)):
            yield frame(*_forest(fps[new[r] : new[r] + sizes[r]], most))
        for r in np.flatnonzero(sizes > bucket):
            yield frame(fps[new[r] : new[r] + sizes[r]], None, mask[new[r]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # rows of the last, maybe unfinished key
        over = None  # the key whose rows are passed on, as there are too many of them
        for f in frames:
            mask, key, fps = f["mask"].to_numpy(np.int64), f["key"].to_numpy(np.int64), f["fp"].to_numpy(np.int64).view(np.uint64)
            if held is not None:
                mask, key, fps = (np.concatenate(x) for x in zip(held, (mask, key, fps)))
                held = None
            if over is not None:
                n = int(np.argmin(np.r_[(mask == over[0]) & (key == over[1]), False]))
                yield frame(fps[:n], None, over[0])
                mask, key, fps = mask[n:], key[n:], fps[n:]
                if not len(fps):
                    continue
                over = None
            if not len(fps):
                continue
            last = len(fps) - int(np.argmin(np.r_[((mask == mask[-1]) & (key == key[-1]))[::-1], False]))
            if last:
                yield from whole_runs(mask[:last], key[:last], fps[:last])
            if len(fps) - last > bucket:
                over = (mask[-1], key[-1])
                yield frame(fps[last:], None, over[0])
            else:
                held = (mask[last:], key[last:], fps[last:])
        if held is not None and len(held[2]):
            yield from whole_runs(*held)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(classes: DataFrame, most: int = MOST, bucket: int = BUCKET, masks: list[int] | None = None) -> DataFrame:
    """(a, b): a spanning forest, for each key, of the pairs of distinct fingerprints within `most` bits."""
    masks = plan_masks(classes, most) if masks is None else masks
    choice = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    probes = classes.select("fp", F.explode(choice).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    done = _verified(probes, most, bucket)
    # keys with too many rows: blocks by a hash of the row, one group for each two blocks
    large = done.where("b is null").select(F.col("a").alias("fp"), "mask", F.col("a").bitwiseAND(F.col("mask")).alias("key"))
    sizes = large.groupBy("mask", "key").agg(F.ceil(F.count("*") / bucket).cast("long").alias("blocks"))
    dealt = large.join(sizes, ["mask", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    paired = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    pairs = paired.select("fp", low.alias("mask"), F.xxhash64("mask", "key", low, high).alias("key"))
    found = done.where("b is not null").select("a", "b")
    return found.unionByName(_verified(pairs, most, None).select("a", "b"))


def _verified(probes: DataFrame, most: int, bucket: int | None) -> DataFrame:
    in_order = probes.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return cut_lineage(in_order.mapInPandas(_verify(most, bucket), "a long, b long, mask long"))


def classes_of(rows: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """(class_fp, root, component_id): one row per distinct fingerprint of rows with doc_id and fp."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes, most, bucket)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id."""
    fps = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), words).alias("fp")))
    # a fingerprint that a third of the rows share: AQE splits it, as nothing above needs its rows together
    return fps.join(classes_of(fps, most, bucket), F.col("fp") == F.col("class_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = WORDS, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest doc_id stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = store(docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), words).alias("fp"), F.monotonically_increasing_id().alias("row_no")))
    rooted = rows.select("doc_id", "fp", "row_no").join(classes_of(rows.select("doc_id", "fp"), most, bucket), F.col("fp") == F.col("class_fp"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no")))
    kept = rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.row_no").alias("kept_no"))
    return rows.join(kept, F.col("row_no") == F.col("kept_no"), "left_semi").select("doc.*")


@query("op4_simhash_groups")
def op4(spark, sf_dir):
    """All documents with fingerprint and near-duplicate group."""
    return near_duplicates(table(spark, sf_dir, "documents"))
