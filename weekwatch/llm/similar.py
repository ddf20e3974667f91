"""SimHash near-duplicates at a similarity of word shingles, for the stage of the pipeline.

A fingerprint of 64 bits cannot tell a Jaccard similarity of 0.8 from chance: about 15 % of the bits differ there. This form has
1,024 bits, set where more than half of the distinct shingles' derived hashes have them. As in `simhash`, correlated
bits are put into partitions and every partition gets its own threshold by dynamic programming on estimated candidate counts; here
the sum of the thresholds follows from a probability: two texts just at the similarity agree in a bit with 1 - acos(2 s / (1 + s)) / pi, so the plan is the
cheapest one by which such a pair shares no key with at most `miss`. More similar pairs are missed far less.

Rows of one key are compared on 128 other bits, up to 256 rows each with the next ones, and along a least spanning tree, which keeps what any bound connects, where
there are more rows or more close pairs than two a row. Pairs
that pass are compared on all bits, and then by the exact Jaccard similarity of their distinct shingles: in rounds, every
component proposes its closest pairs (1, then 4, 16 ...) to another component, those that hold merge, those that fail are out, until no pair is left between two
components, and a group of copies costs about one comparison a member.

Keys and trees leave out a few similar pairs. So an exact step follows: each class lists the shingles of its prefix, rare ones first, and
classes of different components that share one are compared, as far as their sizes, places and distances from the component's root allow a
similarity of the bound. No link between components is left out.

Defined cases: texts of equal shingle sets are one class from the start; texts without words (null, empty, white space) are such a
class. Texts shorter than a shingle are one shingle. Repeated rows and null doc_ids are rows like others; null doc_ids come last, so a group keeps a
row with an id if it has one. Any length: a text is hashed whole, in blocks. An empty table gives an empty one. All columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch.llm.graph import components
from weekwatch.llm.shared import store
from weekwatch.llm.simhash import SEED, masks_of

WORDS, SIMILARITY, MISS = 5, 0.8, 0.02
LONGS = 16  # of 64 bits
BUCKET, MIDDLE_BUCKET, BLOCK = 8_000, 256, 1 << 14
SLOTS = 1 << 16
SPLITS, MOST_LEFT_OUT = (2, 3, 4, 5, 6, 8), 3  # partitions of each long, bits left out of one
KEY_COST, PAIR_COST = 1.0, 0.02
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lowered."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = (ends - [len(x) for x in w]).tolist()
    stops, digest = ends[min(words, len(w)) - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """16 longs: each bit is 1 where more than half of the hashes, mixed anew for each long, have it."""
    count = np.zeros(64 * LONGS, np.int64)
    for at in range(0, len(h), BLOCK):
        x = h[at : at + BLOCK, None] + GOLD * np.arange(1, LONGS + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # one byte holds the sum of so many
            count += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(h), bitorder="little").view("<u8").astype(np.uint64)


def agreement(similarity: float = SIMILARITY) -> float:
    """Chance that two sets of this Jaccard similarity agree in a bit, for sets of equal size, where it is least."""
    return 1 - acos(2 * similarity / (1 + similarity)) / pi


def bound(bits: int, sigmas: float, similarity: float = SIMILARITY) -> int:
    """Differing bits that a pair at the similarity does not exceed but by so many standard deviations."""
    q = 1 - agreement(similarity)
    return round(bits * q + sigmas * (bits * q * (1 - q)) ** 0.5)


# --- the plan ----------------------------------------------------------------------------------------


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each long a 64 x 64 table of how many have both bits; 65,536 rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((LONGS, 64, 64)), 0
        for f in frames:
            fps = np.stack(f["fp"].to_list()).astype(np.int64) if len(f) else np.zeros((0, LONGS), np.int64)
            bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(f), LONGS, 8), axis=2, bitorder="little").astype(np.float32)
            total, n = total + np.einsum("nli,nlj->lij", bits, bits, optimize=True), n + len(f)
        at = np.arange(LONGS * 4096)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = classes.select("fp").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros(LONGS * 4096), 0
    for r in rows:
        if r["at"] < 0:
            n = r["n"]
        else:
            both[r["at"]] = r["n"]
    return n, both.reshape(LONGS, 64, 64)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits, of about equal size; each starts at a bit and takes the bits most correlated with it so far."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0.0)
    free, out = np.ones(64, bool), []
    for k in range(m):
        size = -(-int(free.sum()) // (m - k))
        near = np.where(free, corr[:, free].sum(axis=1), -1.0)
        part: list[int] = []
        while len(part) < size:
            part.append(int(np.argmax(near)))
            free[part[-1]] = False
            near = np.where(free, corr[:, part].sum(axis=1), -1.0)
        out.append(sorted(part))
    return out


def allocate(n: int, parts: list[list[float]], agree: float, miss: float) -> tuple[float, list[int]]:
    """Cheapest thresholds by which a pair with `agree` shares no key with at most `miss`; parts have each bit's chance to agree in any pair."""
    steps = 400
    unit = -log(miss) / steps
    best, chosen = np.full(steps + 1, np.inf), []  # least cost that reaches at least so many units of the way to `miss`
    best[0] = 0.0
    for same in parts:
        choices = [(0.0, 0, -1)]
        chance = [1.0] + [0.0] * MOST_LEFT_OUT  # that all bits agree but for k chosen ones, over all choices
        for s in same:
            chance = [chance[k] * s + (chance[k - 1] if k else 0.0) for k in range(MOST_LEFT_OUT + 1)]
        hit = 0.0
        for t in range(min(MOST_LEFT_OUT, len(same) - 1) + 1):
            hit += comb(len(same), t) * agree ** (len(same) - t) * (1 - agree) ** t
            choices.append((KEY_COST * n * comb(len(same), t) + PAIR_COST * n * n / 2 * chance[t], int(-log(max(1 - hit, 1e-300)) / unit), t))
        options = np.full((len(choices), steps + 1), np.inf)
        origins = np.zeros((len(choices), steps + 1), np.int64)
        for c, (cost, gain, _) in enumerate(choices):
            gain = min(gain, steps)
            options[c, gain:] = best[: steps + 1 - gain] + cost
            origins[c, gain:] = np.arange(steps + 1 - gain)
            last = steps - gain + int(np.argmin(best[steps - gain :]))  # all that goes beyond the end is at the end
            options[c, steps], origins[c, steps] = best[last] + cost, last
        pick = options.argmin(axis=0)
        chosen.append((pick, origins[pick, np.arange(steps + 1)], [t for _, _, t in choices]))
        best = options.min(axis=0)
    at, out = steps, []
    for pick, origin, ts in reversed(chosen):
        out.append(ts[pick[at]])
        at = origin[at]
    return float(best[steps]), out[::-1] if np.isfinite(best[steps]) else []


def plan_keys(classes: DataFrame, similarity: float = SIMILARITY, miss: float = MISS) -> list[tuple[int, int]]:
    """(long, mask) of each key."""
    n, both = bit_counts(classes)
    n = max(n, 1)  # keys cost something in an empty table too
    plans = []
    for k in SPLITS:
        parts = [(i, part) for i in range(LONGS) for part in correlated_partitions(n, both[i], k)]
        p = [[float(both[i][b, b]) / n for b in part] for i, part in parts]
        cost, thresholds = allocate(n, [[x * x + (1 - x) * (1 - x) for x in ps] for ps in p], agreement(similarity), miss)
        plans.append((cost, k, [(i, m) for (i, part), t in zip(parts, thresholds) for m in masks_of([part], [t])]))
    return min(plans)[2]


# --- candidates --------------------------------------------------------------------------------------

EDGE = "a long, b long, key_no int"


def _tree(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning tree of the rows that are within `most`."""
    n = len(ids)
    near, dist, left = np.zeros(n, np.int64), np.full(n, 1 << 20), np.ones(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(x ^ x[at]).sum(axis=1, dtype=np.int64)
        closer = left & (d < dist)
        dist[closer], near[closer] = d[closer], at
        at = int(np.argmin(np.where(left, dist, 1 << 21)))
        if dist[at] <= most:
            a.append(ids[near[at]])
            b.append(ids[at])
    return np.array(a, np.int64), np.array(b, np.int64)


def _pairs(most: int, bucket: int | None):
    """Rows sorted by (key_no, key) -> pairs (a, b), or rows of too large keys as (a, key_no)."""

    def frame(a, b, key_no=None) -> pd.DataFrame:
        low, high = (a, pd.array([None] * len(a), "Int64")) if b is None else (np.minimum(a, b), np.maximum(a, b))
        return pd.DataFrame({"a": low, "b": pd.array(high, "Int64"), "key_no": pd.array([key_no] * len(a), "Int32")})

    def runs(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        no, key, ids = f["key_no"].to_numpy(), f["key"].to_numpy(), f["id"].to_numpy()
        x = f[["s", "t"]].to_numpy(np.int64).view(np.uint64)
        new = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(ids)])
        run_id, size_of = np.repeat(np.arange(len(new)), sizes), np.repeat(sizes, sizes)
        # rows of chance: each against the next ones of its run; runs with more pairs than a few a row get a tree
        at, close = np.flatnonzero((size_of > 1) & (size_of <= MIDDLE_BUCKET)), []
        for d in range(1, int(size_of[at].max()) if len(at) else 0):
            i, j = at[:-d], at[d:]
            same = run_id[i] == run_id[j]
            i, j = i[same], j[same]
            hit = np.bitwise_count(x[i, 0] ^ x[j, 0]).astype(np.int64) + np.bitwise_count(x[i, 1] ^ x[j, 1]) <= most
            close.append((i[hit], j[hit]))
        i, j = (np.concatenate(c) for c in zip(*close)) if close else (at[:0], at[:0])
        dense = np.bincount(run_id[i], minlength=len(sizes)) > 2 * sizes
        sparse = ~dense[run_id[i]]
        yield frame(ids[i[sparse]], ids[j[sparse]])
        for r in np.flatnonzero(dense | (sizes > MIDDLE_BUCKET)):
            at = slice(new[r], new[r] + sizes[r])
            if bucket is not None and sizes[r] > bucket:
                yield frame(ids[at], None, int(no[at.start]))
            else:
                yield frame(*_tree(ids[at], x[at], most))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            last = (f["key_no"] == f["key_no"].iloc[-1]) & (f["key"] == f["key"].iloc[-1])
            start = len(f) - int(last[::-1].cumprod().sum())
            if start:
                yield from runs(f.iloc[:start])
            held = f.iloc[start:]
        if held is not None and len(held):
            yield from runs(held)

    return run


def candidates(classes: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, bucket: int = BUCKET) -> DataFrame:
    """(a, b, far): pairs of classes (id, fp) that share a key and are within the bound on all bits."""
    keys = plan_keys(classes, similarity, miss)
    choice = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(w).alias("w"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for i, (w, m) in enumerate(keys)])
    fp = lambda w: F.get("fp", w)
    probes = classes.select("id", "fp", F.explode(choice).alias("k")).select(
        F.col("k.no").alias("key_no"), fp(F.col("k.w")).bitwiseAND(F.col("k.m")).alias("key"), "id",
        # bits that the key does not hold
        fp((F.col("k.w") + 5) % LONGS).alias("s"), fp((F.col("k.w") + 11) % LONGS).alias("t"),
    )
    most = bound(128, 4, similarity)

    def paired(rows: DataFrame, bucket: int | None) -> DataFrame:
        return rows.repartition("key_no", "key").sortWithinPartitions("key_no", "key").mapInPandas(_pairs(most, bucket), EDGE)

    found = store(paired(probes, bucket))
    out = found.where("b is not null").select("a", "b")
    # keys of too many rows: blocks by a hash of the row, a group for each two blocks
    large = found.where("b is null").select(F.col("a").alias("id"), "key_no")
    if not large.isEmpty():
        rows = probes.join(large.distinct(), ["id", "key_no"])
        sizes = rows.groupBy("key_no", "key").agg(F.ceil(F.count("*") * 2 / bucket).cast("long").alias("blocks"))
        dealt = rows.join(sizes, ["key_no", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        out = out.unionByName(paired(dealt.select("key_no", group.alias("key"), "id", "s", "t"), None).select("a", "b"))
    a, b = (classes.select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    # the bits of two longs that differ
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    far = out.distinct().join(a, "a").join(b, "b").select("a", "b", apart.alias("far"))
    return far.where(F.col("far") <= bound(64 * LONGS, 4, similarity))


# --- exact similarity --------------------------------------------------------------------------------


def _holds(similarity: float, words: int):
    @F.pandas_udf("boolean")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out, seen, last = [], None, None
        for x, y in zip(xs, ys):
            if last is None or x != last:
                seen, last = shingles(x, words), x
            other = shingles(y, words)
            shared = len(np.intersect1d(seen, other, assume_unique=True))
            out.append(shared >= similarity * (len(seen) + len(other) - shared))
        return pd.Series(out)

    return run


def _with_links(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links (a, b), and one of each node to its root."""
    return links if roots is None else links.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def linked(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame | None:
    """(node, root) of the components of those edges (a, b, far) whose texts (id, text) are similar, or None without any."""
    rest, roots, width = store(edges.select("a", "b", "far", F.col("a").alias("ca"), F.col("b").alias("cb"))), None, 1
    # the rounds move the texts of candidates only
    texts = store(texts.join(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    while not rest.isEmpty():
        ends = rest.select("*", F.explode(F.array("ca", "cb")).alias("c"))
        # Spark keeps `width` rows of a component in each task before it shuffles them
        nearest = F.row_number().over(W.partitionBy("c").orderBy("far", "a", "b"))
        picks = ends.withColumn("r", nearest).where(F.col("r") <= width).select("a", "b").distinct()
        named = picks.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        tried = store(named.select("a", "b", _holds(similarity, words)(F.col("ta"), F.col("tb")).alias("ok")))
        held = tried.where("ok").select("a", "b")
        rest = rest.join(tried, ["a", "b"], "left_anti")
        if not held.isEmpty():
            roots = components(_with_links(held, roots))
        if roots is not None:
            ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
            rest = rest.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", "far", F.coalesce("ra", "a").alias("ca"), F.coalesce("rb", "b").alias("cb")).where("ca <> cb")
        rest, width = store(rest), width * 4
    return roots


# --- what the keys left out --------------------------------------------------------------------------


def _common(similarity: float, words: int):
    """Whether two texts are similar, and their Jaccard distance."""

    @F.pandas_udf("struct<ok: boolean, apart: double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out, seen, last = [], None, None
        for x, y in zip(xs, ys):
            if last is None or x != last:
                seen, last = shingles(x, words), x
            other = shingles(y, words)
            shared = len(np.intersect1d(seen, other, assume_unique=True))
            union = len(seen) + len(other) - shared
            out.append((shared >= similarity * union, 1 - shared / max(union, 1)))
        return pd.DataFrame(out, columns=["ok", "apart"])

    return run


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def slot_counts(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many shingles fall on each of 65,536 slots; only the order of a text's shingles hangs on it, so any counts are right."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for f in frames:
            total += np.bincount(_slots(np.concatenate([np.zeros(0, np.uint64), *[shingles(t, words) for t in f["text"]]])), minlength=SLOTS)
        yield pd.DataFrame({"slot": np.arange(SLOTS), "n": total})

    out = np.zeros(SLOTS, np.int64)
    for r in texts.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """Of two sets of at least this similarity, each has one of the shared elements among its first so many, in any one order of all elements."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def prefixes(texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(id, n, tokens): shingles of each text (id, text), and the first ones, those of rare slots first."""
    counts = slot_counts(texts, words)

    @F.pandas_udf("struct<n: int, tokens: array<long>>")
    def run(xs: pd.Series) -> pd.DataFrame:
        n, tokens = [], []
        for x in xs:
            h = shingles(x, words)
            n.append(len(h))
            tokens.append(h[np.lexsort((h, counts[_slots(h)]))[: prefix_length(len(h), similarity)]].view(np.int64))
        return pd.DataFrame({"n": n, "tokens": pd.Series(tokens, dtype=object)})

    return texts.withColumn("p", run(F.col("text"))).select("id", "p.n", "p.tokens")


SHARED = "token long, id long, root long, size long, n int, pos int"


def _between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by token, those of tokens that several components have."""

    def spanning(f: pd.DataFrame) -> pd.DataFrame:
        token, root = f["token"].to_numpy(), f["root"].to_numpy()
        new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        wide = np.minimum.reduceat(root, new) != np.maximum.reduceat(root, new)
        return f[np.repeat(wide, np.diff(np.r_[new, len(f)]))]

    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        token = f["token"].to_numpy()
        start = int(np.searchsorted(token, token[-1]))
        if not start and (not held or held[-1]["token"].iloc[-1] == token[-1]):
            held.append(f)  # one token only
            continue
        yield spanning(pd.concat([*held, f.iloc[:start]], ignore_index=True))
        held = [f.iloc[start:]]
    if held:
        yield spanning(pd.concat(held, ignore_index=True))


def _fit(n_x: Column, pos_x: Column, low: Column, high: Column, pos: Column, similarity: float) -> Column:
    """Whether a set of n_x elements and one of `low` to `high` elements can be similar if this is the first element they share."""
    shared = F.least(n_x - pos_x, high - pos)
    return (high >= similarity * n_x - 1e-6) & (similarity * low <= n_x + 1e-6) & (shared >= similarity / (1 + similarity) * (n_x + low) - 1e-6)


def _enough(shared: str, n: str, low: str, high: str, similarity: float) -> Column:
    """Whether so many elements shared in the prefixes can do: beyond the prefix that ends first, a set has less than `similarity` of its elements."""
    least = similarity / (1 + similarity) * (F.col(n) + F.col(low))
    return F.col(shared) >= least - similarity * F.greatest(n, high) - 1e-6


def completed(classes: DataFrame, texts: DataFrame, roots: DataFrame | None, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame | None:
    """(node, root) of the components of all similar classes, from those that were found: every similar pair between two of these is added.

    Similar sets share an element of their prefixes. A text that shares one with a larger component is compared
    with the component's root. As Jaccard distances keep the triangle inequality, a member can only be similar if its own distance from the root
    is at least the text's less 1 - similarity; these members are compared as well, if they share an element.
    """
    ids = classes.select("id")
    if roots is None:
        ids = ids.select("id", F.col("id").alias("root"), F.lit(1).cast("long").alias("size"))
    else:
        sizes = roots.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("size"))
        ids = ids.join(roots, F.col("id") == F.col("node"), "left").join(sizes, F.col("root") == F.col("r"), "left")
        ids = ids.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    listed = prefixes(texts, similarity, words).join(ids, "id").select("id", "root", "size", "n", F.posexplode("tokens").alias("pos", "token"))
    listed = listed.select("token", "id", "root", "size", "n", "pos")
    found = store(listed.repartition("token").sortWithinPartitions("token").mapInPandas(_between, SHARED))
    parts = found.groupBy("token", F.col("root").alias("c"), F.col("size").alias("c_size")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("at"))
    smaller = F.struct("size", "root") < F.struct(F.col("c_size").alias("size"), F.col("c").alias("root"))
    fits = _fit(F.col("n"), F.col("pos"), F.col("low"), F.col("high"), F.col("at"), similarity)
    asked = found.join(parts, "token").where(smaller).groupBy("id", "n", "c", "c_size").agg(
        F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(fits).alias("fits")
    )
    asked = store(asked.where(F.col("fits") & _enough("shared", "n", "low", "high", similarity)).select("id", "c", "c_size"))
    if asked.isEmpty():
        return roots
    grown = asked.where("c_size > 1").select("c").distinct()
    members = found.join(grown, F.col("root") == F.col("c"), "left_semi").where("id <> root").select("id", "root").distinct()
    needed = asked.select("id").union(asked.select("c")).union(members.select("id")).distinct()
    texts = store(texts.join(needed, "id", "left_semi"))

    def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
        ta, tb = texts.select(F.col("id").alias(a), F.col("text").alias("ta")), texts.select(F.col("id").alias(b), F.col("text").alias("tb"))
        return pairs.join(ta, a).join(tb, b).withColumn("j", _common(similarity, words)("ta", "tb")).select(*pairs.columns, "j.ok", "j.apart")

    tried = store(compared(asked, "id", "c"))
    links = tried.where("ok").select(F.col("id").alias("a"), F.col("c").alias("b"))
    open_ = tried.where("not ok and c_size > 1").select("id", "c", "apart")
    if not open_.isEmpty():
        reach = store(compared(members.withColumnRenamed("root", "c"), "id", "c").select(F.col("id").alias("y"), F.col("c").alias("c_y"), F.col("apart").alias("reach")))
        y = found.select("token", F.col("id").alias("y"), F.col("root").alias("c_y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y")).join(reach, ["y", "c_y"])
        x = open_.join(found.select("id", "token", "n", "pos"), "id").withColumnRenamed("c", "c_y")
        near = _fit(F.col("n"), F.col("pos"), F.col("n_y"), F.col("n_y"), F.col("pos_y"), similarity) & (F.col("reach") >= F.col("apart") - (1 - similarity) - 1e-9)
        pairs = x.join(y, ["token", "c_y"]).groupBy("id", "n", "y", "n_y").agg(F.count("*").alias("shared"), F.bool_or(near).alias("near"))
        pairs = pairs.where(F.col("near") & _enough("shared", "n", "n_y", "n_y", similarity)).select("id", "y")
        links = links.unionByName(compared(pairs, "id", "y").where("ok").select(F.col("id").alias("a"), F.col("y").alias("b")))
    links = store(links)
    if links.isEmpty():
        return roots
    return components(_with_links(links, roots))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, miss: float = MISS, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest doc_id stays."""

    @F.pandas_udf("struct<digest: string, fp: array<long>>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t if isinstance(t, str) else None, words) for t in texts]
        digests = [hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).hexdigest() for h in sets]
        return pd.DataFrame({"digest": pd.Series(digests, dtype=object), "fp": pd.Series([fingerprint(h).view(np.int64) for h in sets], dtype=object)})

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_no"))
    rows = store(rows.withColumn("h", hashed(F.col("text"))).select("doc", "doc_id", "row_no", "h.digest", "h.fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")
    # copies are one class: what follows sees each text once
    classes = store(rows.groupBy("digest").agg(first, F.first("fp").alias("fp")).select(F.col("first.row_no").alias("id"), "first", "fp"))
    texts = rows.select(F.col("row_no").alias("id"), F.col("doc.text").cast("string").alias("text"))
    roots = linked(candidates(classes, similarity, miss, bucket), texts, similarity, words)
    roots = completed(classes, texts, roots, similarity, words)
    group = F.col("id")
    if roots is not None:
        classes, group = classes.join(roots, classes["id"] == roots["node"], "left"), F.coalesce("root", "id")
    kept = classes.groupBy(group.alias("group")).agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("kept_no"))
    return rows.join(kept, F.col("row_no") == F.col("kept_no"), "left_semi").select("doc.*")
