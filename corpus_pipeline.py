"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), works on all documents that the
stage before it kept, and returns the columns of ``documents`` (the last one: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm import decontaminate, packing, repeats, simhash, toxicity
from flightline.llm.storage import bounded_batches, stored


#: Rows that a worker takes at once: stages follow each other in the same workers, which keep what they once needed.
BATCH_ROWS = 500


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar calls toxic go.

    A null or empty text has no clause and scores the intercept; very long texts are read whole, in
    slices; repeated rows are judged alike; rows without an id are judged but not learned from.
    """
    bounded_batches(spark, BATCH_ROWS)
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id, null ids last, of rows that share it any one.

    Near copies share 80 % of their shingles of five words (wide fingerprints find them, their sets of
    shingles decide).  Null, empty and wordless texts are copies of each other; a text of fewer than
    five words is one shingle.
    """
    bounded_batches(spark, BATCH_ROWS)
    return simhash.keep_one(docs, shingle=5, scheme=simhash.WIDE, least_similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out; ``n_chars`` follows the text.

    Null texts and texts of fewer than 13 words stay as they are, and so do texts that lose nothing; of
    rows with equal ids neither is before the other, and a null id comes after all others.
    """
    bounded_batches(spark, BATCH_ROWS)
    cut = repeats.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    A text without words has no passage and stays; a contaminated row takes all rows of its id with
    it (those without an id too); items without words are in no document.
    """
    bounded_batches(spark, BATCH_ROWS)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is a piece of just the end id; longer texts than a sequence are cut; each row is
    packed by itself, whatever its id.  Every stage of an empty table is empty; further columns, whatever
    their names, are passed on by all stages but this one.
    """
    bounded_batches(spark, BATCH_ROWS)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express the model of the first stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
