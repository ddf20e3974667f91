"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all rows that its predecessor kept, decides on them and returns what stays, in the columns of
`documents`; the last returns the packed pieces. Between stages rows are written as Parquet and read again.

1. quality rules: rows that fail the base rules or lie far outside their language and source go
2. line dedup: passages that an earlier document has are cut out, whole texts of any length among them; a text that
   loses all its words goes
3. SimHash near-dedup: of each group of texts whose five-word shingles have a similarity of 0.8 or more the smallest doc_id stays
4. mixing: a row comes as often as the mix of its source takes it, 0 to 2 times
5. packing: all texts in sequences of at most 2048 ids

Defined cases, as the operators state them: a null text has no words and fails the first stage, an empty one as well; long
texts pass whole; repeated rows are judged alike by the first stage, cut to one text by the second and come as one row from the
third; nulls in lang, source and doc_id are values of their own; an empty table gives an empty one in each stage; other columns than those of
documents are left out, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwatch.llm import linededup, mixing, packing, quality, similar
from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.remove_repeated(docs, carry=("lang", "source"), run_words=linededup.RUN_WORDS, whole_texts=True)
    emptied = (F.col("lines_removed") > 0) & ~F.col("text").rlike("[^ \\t-\\r]")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_documents),
]

#: Robust estimates, rolling hashes, components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
