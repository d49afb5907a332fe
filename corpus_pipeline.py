"""A corpus cleaned step by step: every stage takes and returns the columns of documents, the last one
returns the token index. Each stage's rows are stored before the next one reads them."""

from __future__ import annotations

from tripfold.llm.common import crc_mod, lean, shared_folder, stored
from tripfold.llm.op1_decontamination import without_leaks
from tripfold.llm.op2_quality_mil import CUT, score, train
from tripfold.llm.op4_ngram_jaccard_join import one_of_each
from tripfold.llm.op5_source_mix import mixed_rows
from tripfold.llm.op9_token_index import read_index, write_index

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier accepts. It learns from labelled rows of the documents table."""
    lean(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(raw, labels, lambda c: crc_mod(c, 4) != 2)
    return score(docs, model, keep=COLUMNS).where(f"score >= {CUT}").select(COLUMNS)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    lean(spark)
    return one_of_each(docs.select(COLUMNS))


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    lean(spark)
    return without_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark, docs, sf_dir):
    """The mix of sources at target weights; a document that is taken k times is k rows."""
    lean(spark)
    return mixed_rows(docs.select(COLUMNS))


def token_stage(spark, docs, sf_dir):
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    lean(spark)
    return read_index(spark, write_index(docs, shared_folder(spark)))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]
ORACLE_SQL = None  # classifier, alignment and tokenizer can't be expressed in SQL


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
