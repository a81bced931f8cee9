"""From raw documents to packed sequences: quality, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.llm.common import table
from emberlattice.scratch import written
from emberlattice.llm.decontaminate import decontaminate, text_digest
from emberlattice.llm.ngram_join import jaccard_components
from emberlattice.llm.packing import pack_documents
from emberlattice.llm.quality import keep_good
from emberlattice.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least 0.3)."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Of an id with different texts those rows go whose own text is
    near one of a smaller id. Rows without words, with a null text or a null id stay; repeated rows stay or go together; an empty table stays
    empty. Other columns are carried along, whatever their names."""
    groups = jaccard_components(docs, width=5, with_text=True).filter("text_component <> doc_id")
    gone = groups.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    names = docs.columns
    own = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    matches = (F.col("row.doc_id") == F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_key"))
    return own.join(gone, matches, "left_anti").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that a smaller document's windows of 13 words cover; texts without such words stay as they are, null and
    empty ones and rows with a null id among them. Each text of a repeated id is cut by its own decisions; an empty table stays empty. Other
    columns are carried along, whatever their names; n_chars follows the text."""
    changed = (
        remove_repeats(docs, width=13, with_text=True)
        .filter("kept_text is not null and doc_id is not null")
        .select(F.col("doc_id").alias("changed_id"), F.col("text_key").alias("changed_key"), "kept_text")
        .dropDuplicates(["changed_id", "changed_key"])
    )
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    own = own.join(changed, (F.col("row.doc_id") == F.col("changed_id")) & (F.xxhash64("row.text") == F.col("changed_key")), "left")
    cut = F.col("kept_text").isNotNull()
    out = {"text": F.coalesce("kept_text", "row.text"), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return own.select(*((out[c] if c in out else F.col("row").getField(c)).alias(c) for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. A row goes for its own text, also where its id is null or repeated; null and empty texts
    stay; an empty table stays empty. Other columns are carried along, whatever their names."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10, with_key=True)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return own.join(hit, F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (text_digest("row.text") == F.col("hit_key")), "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packed),
]

#: SQL knows neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
