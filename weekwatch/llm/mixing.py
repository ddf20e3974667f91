"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source gets the same fractional number of copies, target / words of the
source. The whole part is kept; the fractional parts are rounded by the pivotal method:
two rows meet, words move from one to the other by chance until one of them holds a
whole copy or none, and the other goes on to meet the next. The words a source takes
stay equal to its target until the last fractional row, which chance rounds. Rows are
dealt into buckets of bounded size; what a bucket leaves (one fractional row at most)
goes up a reduction tree until one row of each source is left.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own,
last in the order; a source without words has target 0. Repeated rows are rows of their
own: they are numbered apart, meet in an order that ties cannot change, and
equal rows are interchangeable. A source may have any name: one called "null" is not the null source. A table without words takes nothing. Only doc_id, text
and source are read, so other columns cannot clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2.0
BUCKET_ROWS, FAN_IN = 20_000, 64


def n_words(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target): one row per source of (source, size).

    Weights repeat over the sources in code-point order, null last. A source's target stops at
    `most` times its words and the excess goes to the others by weight, again until none is above.
    The work is on one row per source; only sums of sources reach the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, not per document
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_lineage(
        per_source.select("source", "source_size", F.get(choice, (order % len(weights)).cast("int")).alias("weight"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    left, per_weight, held = share * total, 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(per_weight) >= cap
        row = ranked.agg(
            F.sum(F.when(capped, cap)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["open"] is None or row["n"] == held:
            break
        held, per_weight = row["n"], max(per_weight, (left - (row["taken"] or 0.0)) / row["open"])
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(per_weight)).alias("target"))


_ROUND = T.StructType(
    [
        T.StructField("row_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("p", T.DoubleType()), T.StructField("settled", T.IntegerType()),
    ]
)
_NEAR = 1e-9


def _pivot(rows: Iterator[tuple], rng: random.Random) -> Iterator[tuple]:
    """Rounds (id, size, p) in order; yields (id, size, p, 0 or 1), and None in place of it for the one left."""
    held = None
    for key, size, p in rows:
        if p <= _NEAR or p >= 1 - _NEAR:
            yield key, size, p, int(p > 0.5)
            continue
        if held is None:
            held = (key, size, p)
            continue
        a_key, a_size, a_p = held
        # words that can go from the new row to the held one, and back
        up, down = min((1 - a_p) * a_size, p * size), min(a_p * a_size, (1 - p) * size)
        moved = up if rng.random() * (up + down) < down else -down
        a_p, p, held = a_p + moved / a_size, p - moved / size, None
        for row in ((a_key, a_size, a_p), (key, size, p)):
            if row[2] <= _NEAR or row[2] >= 1 - _NEAR:
                yield row[0], row[1], row[2], int(row[2] > 0.5)
            else:
                held = row
    if held is not None:
        yield (*held, None)


def _round_bucket(seed: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["row_id", "size", "p"], kind="stable")
        rng = random.Random(f"{seed}/{key}")
        done = list(_pivot(zip(rows["row_id"], rows["size"].tolist(), rows["p"].tolist()), rng))
        source = rows["source"].iloc[0]
        return pd.DataFrame(
            {
                "row_id": [r[0] for r in done], "source": [source] * len(done), "size": [r[1] for r in done],
                "p": [r[2] for r in done], "settled": pd.array([r[3] for r in done], dtype="Int32"),
            }
        )

    return run


def dependent_rounding(rows: DataFrame, seed: int = 17, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(row_id, source, size, p) -> (row_id, up) with up 0 or 1, sum of up * size near the sum of p * size.

    The number of buckets follows the number of rows; a tree over bucket numbers combines what they leave.
    """
    open_rows = rows.where((F.col("p") > _NEAR) & (F.col("p") < 1 - _NEAR) & (F.col("size") > 0))
    buckets = open_rows.count() // bucket_rows + 1
    bucket = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(buckets)).alias("bucket")
    level, parts = open_rows.select("row_id", "source", "size", "p", bucket), []
    while True:
        # sources with null keep their rows together: groupBy treats nulls as equal
        done = cut_lineage(level.groupBy("source", "bucket").applyInPandas(_round_bucket(seed + len(parts)), _ROUND))
        parts.append(done.where("settled is not null").select("row_id", F.col("settled").alias("up")))
        left = done.where("settled is null")
        if buckets == 1:
            break
        buckets = -(-buckets // fan_in)
        level = left.select("row_id", "source", "size", "p", F.pmod(F.xxhash64("row_id", F.lit(seed + len(parts))), F.lit(buckets)).alias("bucket"))
    # the last fractional row of each source is rounded by its own chance
    chance = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    parts.append(left.select("row_id", (chance < F.col("p")).cast("int").alias("up")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mix_rows(rows: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """`rows` with row_id (no two alike), source and size -> the same with source_size, target and copies."""
    targets = cut_lineage(source_targets(rows, **shares))
    # one row per source; Catalyst broadcasts it while it is small, else AQE splits the large sources
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", share.alias("fraction"))
    fractions = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    whole = F.floor(F.col("fraction") + F.lit(_NEAR))
    fractions = fractions.withColumn("whole", whole).withColumn("p", F.greatest(F.col("fraction") - whole, F.lit(0.0)))
    ups = dependent_rounding(fractions.select("row_id", "source", "size", "p"), seed)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("up"), F.lit(0))).otherwise(0).cast("long")
    return fractions.join(ups, "row_id", "left").withColumn("copies", copies).drop("row_id", "fraction", "whole", "p", "up")


def row_ids(rows: DataFrame, *same: str) -> DataFrame:
    """A row_id for rows of (doc_id, size) and the columns of `same`; equal rows are numbered apart."""
    # JSON leaves nulls out and escapes the rest, so a null differs from any text
    key = F.to_json(F.struct("doc_id", "size", *same))
    number = F.row_number().over(W.partitionBy("doc_id", "size", *same).orderBy(F.lit(0)))
    # the hash comes first, so that rows meet in an order that has nothing to do with their ids
    return rows.withColumn("copy_no", number).withColumn("row_id", F.concat_ws("/", F.hex(F.xxhash64(key, "copy_no")), "copy_no", key)).drop("copy_no")


def mix(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix_rows(cut_lineage(row_ids(sized, "source")), seed, **shares)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = store(docs.select(whole, F.monotonically_increasing_id().alias("row_no"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    sized = rows.select("row_no", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size", "text_hash")
    mixed = mix_rows(cut_lineage(row_ids(sized, "source", "text_hash")), seed, **shares).where("copies > 0").select(F.col("row_no").alias("taken_no"), "copies")
    taken = rows.join(mixed, F.col("row_no") == F.col("taken_no"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


@query("op10_mix_sources")
def op10(spark, sf_dir):
    """All documents mixed to 150 % of their words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
