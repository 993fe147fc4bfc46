"""A training-data pipeline over ``documents``: five stages, each calling one operator of ``blockloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; each works on everything its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import drop, materialize, scratch
from blockloom.llm.jaccard import one_of_each
from blockloom.llm.langid import keep_identified
from blockloom.llm.line_dedup import line_dedup, without_lines
from blockloom.llm.mixing import emit_mix
from blockloom.llm.packing import pack
from blockloom.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; a null lang is filled in.

    Null and empty texts, and texts without a letter, have no language and go. Repeated rows stay as often as they
    come; a null doc_id stays null. An empty table gives an empty one, as in all stages; columns beside those of
    ``documents`` go no further.
    """
    return keep_identified(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more are dropped; n_chars follows the text.

    Every document stays, if with an empty text; a null text stays null. Documents are counted by doc_id, those without
    one by their text; repeated rows count once and lose the same lines.
    """
    kept = without_lines(docs, line_dedup(docs, min_docs=10, min_chars=1))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity 0.8 or more) stays, the least doc_id.

    SimHash finds them: fingerprints of 1024 bits, blocks, Hamming distances; whole shingle sets decide. Null texts, and texts without a word, are one group. Texts of fewer than five words are near copies if their words are
    the same. Of rows with one doc_id the one whose text hashes least stays, of rows alike in both the one whose columns
    hash least; a null doc_id stays only if all of its group are null.
    """
    return one_of_each(docs, words=5, num=4, den=5).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for.

    Sources by code point, null last, weigh 3, 1, 2 in turn. Null and empty texts have no words; a source without any
    words gets no copies. Repeated rows draw alike; all copies have the same columns.
    """
    return emit_mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, or of a power of two.

    A null or empty text is the end token alone; copies are packed each for itself; a null doc_id stays null; a long text
    goes on over as many sequences as it takes.
    """
    return pack(docs, tokenizer_json(), with_ids=False, near_col="lang")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the language models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage returns is written to the shared folder.

    A stage's own tables, and what its predecessor kept, are deleted once its result is written.
    """
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = materialize(stage(spark, before, sf_dir), name)
            paths.remove(docs._blockloom_path)
        if name != STAGES[0][0]:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
