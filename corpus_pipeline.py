"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality classifier: documents above their language's perplexity threshold go;
2. language ID: documents that no learnt language claims go;
3. line dedup: lines that an earlier one equals or nearly equals go;
4. near-dedup: of each component of near copies (five-word shingles, Jaccard 0.8 or more; found by the SimHash tree, then by a prefix filter) the least ``doc_id`` stays;
5. best-fit packing: what is left becomes sequences of at most 4,096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import table
from siftstone.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, trained on what ``labels`` trusts among them."""
    from siftstone.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some learnt language claims."""
    from siftstone.llm.language_id import fit, held_out, keep_known_languages

    return keep_known_languages(docs, fit(docs.select("doc_id", "text", "lang").filter(~held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their copied lines; ``n_chars`` counts what is left."""
    from siftstone.llm.line_dedup import dedup_lines

    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the first row of the least id."""
    from siftstone.llm.near_copies import one_of_each

    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and place in a sequence."""
    from siftstone.llm.packing import packed_documents

    return packed_documents(docs)


STAGES = [("quality_classifier", quality), ("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("best_fit_packing", packing)]

#: Models and fingerprints are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
