"""From raw documents to token files: the stages in order, each on what the last one kept.

Each stage takes rows of documents with any further columns, which it drops, and acts by
row: ids may be null or stand on several rows. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planline.llm.shared import DOCUMENT_COLUMNS, documents, only, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon, learned from labels, scores 0.3 or more.

    Null and empty texts get the least score and stay; without labels of both kinds the
    lexicon is empty and all stay. Texts are scored whole; equal rows share their fate.
    """
    from planline.llm.toxicity import Lexicon, score_column, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon: Lexicon = train(docs.select("doc_id", "text").join(labels, "doc_id"))
    return only(docs, *DOCUMENT_COLUMNS).where(score_column(lexicon)(F.col("text")) < 0.3)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row: an id may be null or stand on several rows."""
    return written(only(docs, *DOCUMENT_COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


#: Words of 64 rows' bits that go to every task, 16 bytes each: what a hundred gigabytes of documents need.
MOST_WORDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered documents but for the rows ``gone`` (row), a bit for each, so that no text crosses a shuffle.

    Beyond ``MOST_WORDS`` the join is left to Spark.
    """
    word, bit = F.shiftright("row", 6), F.expr("shiftleft(1L, CAST(row & 63 AS INT))")
    bits = written(gone.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "gone")
    held = F.broadcast(bits) if bits.count() <= MOST_WORDS else bits
    kept = docs.withColumn("word", word).join(held, "word", "left")
    return kept.where(F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(bit) == 0).select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies: of the least id (null last), then by text.

    Equal rows are copies. Texts without words (null and empty ones too) are no copies
    of one another and stay, and so does all that is linked to nothing.
    """
    from planline.llm.jaccard_join import jaccard_join

    docs = _numbered(docs)
    classes = jaccard_join(docs.select(F.col("row").alias("doc_id"), "text")).where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.md5("text").alias("text"), "row")
    placed = docs.select("row", order.alias("place"))  # hashes go to the join, not texts
    linked = written(placed.join(classes, "row").select("row", "class_id", "place"), "linked")
    kept = linked.groupBy("class_id").agg(F.min("place").alias("place")).select("place.row")
    return _without(docs, linked.select("row").join(kept, "row", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark windows make up a twentieth of.

    Texts without words are clean, and so is everything where the benchmark is empty.
    """
    from planline.llm.decontaminate import decontaminate

    docs = _numbered(docs)
    found = decontaminate(docs.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("row")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says.

    Null and empty texts have no tokens and are never taken; null lang or source are a
    name of their own. Equal rows stand one after the other in the order of their leaf.
    """
    from planline.llm.mixing import mix
    from planline.llm.queries import DOMAIN_WEIGHTS, MIX, domain

    mixed = mix(only(docs, *DOCUMENT_COLUMNS), domain(), DOMAIN_WEIGHTS, **MIX).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy")
    return mixed.select(*DOCUMENT_COLUMNS, copies).select(*DOCUMENT_COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the ids and return what the files hold of each document: a row for each, null texts as empty ones."""
    from planline.llm.queries import tokenizer_path
    from planline.llm.token_files import write_token_files

    return write_token_files(docs, tokenizer_path()).documents()


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
