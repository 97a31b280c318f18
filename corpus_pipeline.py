"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all that its predecessor kept, is written as Parquet and
read again. All but the last return the columns of `documents`. Part of the
subpackage canopy.llm, though its place is here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, decontaminate, language, simhash, substrings
from canopy.llm.util import Scratch, closing_scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`); a null lang becomes the predicted one.

    Profiles are learned from the rows of docs that have a lang. A weak score is
    no reason to reject: of a text of a few words none better is to be had."""
    return language.keep_identified(docs, language.fit_prototypes(docs))


#: Words of a shingle in the near-duplicate stage. The links are op4's: RADIUS of 64 bits.
WIDTH = 5


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs, written with a number _row of each row. Decisions are carried by it, as a doc_id may be null or repeated."""
    return scratch.keep("rows", docs.withColumn("_row", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id, nulls last, then by a hash of the row.

    Shingles have WIDTH words. Null and wordless texts are near duplicates of each other, repeated rows of themselves."""
    scratch = Scratch(spark, "near-duplicates")
    rows = numbered(docs, scratch)
    with closing_scratch():
        labels = simhash.simhash_components(rows.select(F.col("_row").alias("doc_id"), "text"), WIDTH)
        labels = scratch.keep("labels", labels.select(F.col("doc_id").alias("_row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "_row")
    best = rows.select("_row", order.alias("order")).join(labels, "_row").groupBy("component_id").agg(F.min("order").alias("order"))
    gone = labels.select("_row").join(best.select(F.col("order._row").alias("_row")), "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated words out of the texts; every document stays, even if none of its words do.

    A null text stays null. A row with a null doc_id loses nothing and takes nothing; rows of one doc_id take nothing from each other."""
    return substrings.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows without any window of a benchmark item; a null text has none. Each row is judged by its own text."""
    scratch = Scratch(spark, "contaminated")
    rows = numbered(docs, scratch)
    with closing_scratch():
        found = decontaminate.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        gone = scratch.keep("gone", found.where("contaminated").select(F.col("doc_id").alias("_row")))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of what is left; a null text has no tokens, repeated rows stay."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify_language),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: SQL expresses none of hyperdimensional profiles, XXH64 fingerprints or merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared scratch folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with closing_scratch():
            docs = scratch.keep(str(i), stage(spark, docs, sf_dir))
        if i:
            scratch.drop(str(i - 1))
    return docs
