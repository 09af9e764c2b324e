"""From raw documents to packed training sequences: five stages, each an operator of provender.llm.

Each stage takes and returns the columns of documents (COLUMNS), the last returns pieces; columns beyond those
are dropped by every stage and may have any names. Empty tables give empty ones, and very long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import prepare
from provender.llm import jaccard, lines, mixing, packing, quality
from provender.llm.common import settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more; it is fitted on labelled rows of the first table.

    Null texts count as empty and score as the average document; repeated rows score alike, and a
    score of exactly 0.7 stays.
    """
    model = quality.fit_on(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.classify(docs.select(*COLUMNS), model).where("score >= 0.7").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate in their source; n_chars is counted anew.

    Copies of a text count once here, as the next stage takes them out: else a source's largest group
    of copies would make boilerplate of itself and be left empty. Null texts become empty ones, null
    sources are a source; repeated rows stay, and lines that tie at the ratio do.
    """
    cleaned = lines.drop_boilerplate(docs.select(*COLUMNS), distinct=True)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that similar texts link, the one with the smallest doc_id; all others stay.

    Null and empty texts and null ids link with nothing and stay. Rows that repeat an id are one
    document: they stay or go together. A tie at the similarity is a link.
    """
    classes = jaccard.jaccard_classes(docs)
    gone = settled(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and those of rarer sources over again as their weights ask.

    Null sources are a source; documents without words come once for each whole round of their source.
    Repeated rows are documents of their own; ties in the order of a source go by id and text.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each row.

    Null and empty texts are a piece of one id, the end; repeated rows and null ids are pieces of
    their own; ties among lengths go by id and piece.
    """
    cuts = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(settled(cuts, "pieces"))


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to documents; each stage's rows are written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else settled(docs, name)
    return docs


#: The classifier and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
