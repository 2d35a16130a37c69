"""The corpus pipeline: toxicity filter, near-dedup, passage dedup, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept; all but
the last return the columns of ``documents``.  ``run`` writes each stage's result to the folder that the
cluster shares and reads it again, so no stage is computed twice and a lost executor costs its tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import common
from roadpulse.llm.common import Scratch, load
from roadpulse.llm.mixing import mixed
from roadpulse.llm.packing import pack
from roadpulse.llm.simhash import one_of_each
from roadpulse.llm.suffix_dedup import remove_repeats
from roadpulse.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more, by an exact check of each
#: candidate.  A pair of similarity 0.8 is no candidate with a probability of some 10^-6 by the bands; its SimHash
#: fingerprints of 512 bits differ in 77 +- 8 bits (97 +- 9 for sets of five and four shingles, which get a quarter more).
NEAR = {"shingle": 5, "jaccard": 0.8, "words": 8, "radius": 122, "recall": 1 - 1e-6, "null_ids": True}

#: A repeated passage has over 50 words, so 101 bytes at least.
PASSAGE = {"length": 101, "least_words": 51}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7, learned from ``labels`` as ``op10_toxicity`` does.

    Null and empty texts score like a text without words and stay, as do rows with null ids; texts of any length are
    scored whole; repeated rows and rows with equal texts get the same score; labels that are null, missing or empty teach
    nothing (without labels of both kinds all texts score alike).  No rows give no rows; columns other than those of
    ``documents`` are not carried.
    """
    return without_toxic(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Texts without words (null, empty, white space) are copies of each other; texts of fewer than five words are one
    shingle.  Texts of any length are compared whole.  A row is told by id and set of shingles: unlike texts under one id
    each count for themselves, of equal rows one stays, and a row without an id yields to one with an id.  Ties of
    null ids go to the smaller digest.  No rows give no rows; other columns are not carried.
    """
    return one_of_each(docs.select(*COLUMNS), **NEAR)


def passage_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of over 50 words that also stand elsewhere; the rest of a parted character goes too.

    Every occurrence goes, in the same document too.  Null texts stay null and empty ones empty; texts of any length
    are searched whole; null ids and repeated ids are carried, and rows with equal texts of over 50 words lose all of
    them (the stage before leaves no such rows).  ``n_chars`` is that of the text that is left.  No rows give no rows;
    other columns are not carried.
    """
    texts, none = docs.select(*COLUMNS).where("text is not null"), docs.select(*COLUMNS).where("text is null")
    kept = remove_repeats(texts, with_text=True, decode=True, carry=["lang", "source"], **PASSAGE)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).unionByName(none)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times.

    Null and empty texts have no words; they stay once where their source is taken once at least, twice where twice.
    A null source is a source; null and repeated ids and equal rows are told apart or stand for each other
    (``mixed``); texts of any length count whole; a source without words is not taken.  No rows give no rows; other
    columns are not carried.
    """
    return mixed(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1,024 tokens.

    A null or empty text is its end token alone; null and repeated ids and repeated rows are packed like others; texts
    of any length are cut into as many pieces as they need.  No rows give no rows; other columns are not carried.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_size=80_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("passage_dedup", passage_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and draw; SQL can't state them.  Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again; what a stage wrote on its way
    is deleted then."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = len(common.OPEN)
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        common.close_scratch(since)
    return docs
