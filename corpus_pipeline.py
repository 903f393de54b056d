"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.  Null texts have no letter and go in the first stage.  Near-duplicates are told by
row, so that different texts under one id are different documents, and all rows but one of a copied row go.

Batches have the size that holds when a plan runs.  Language and benchmark passages, which send whole texts to
Python, therefore write the hashes of the texts that go, in small batches, and return the rows of the others.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontam, langid, mixing, nearcopies, pii
from wakeline.llm.common import Scratch, small_batches, table

#: A document in which this many benchmark items occur goes.
ITEMS = 2
#: So does one of whose words this share or more is benchmark text, a leaked item and little else.
HIT_SHARE = 0.5
#: So does one that holds this share or more of the words of one item, however long the document is.  An item
#: of fewer words than a window is a phrase that texts share by chance, and does not count here.
ITEM_SHARE = 0.5
#: Hashes of texts that go are broadcast up to this many; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def _without(docs: DataFrame, judged: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` but for those whose text is a ``kept.text`` of ``judged``; rows without text stay."""
    texts = judged.select(F.md5("kept.text").alias("key")).where("key is not null").distinct()
    gone = Scratch(docs.sparkSession, "pipeline").cut(texts, name)
    n = gone.count()
    if not n:
        return docs
    whole = docs.select(F.md5("text").alias("key"), F.struct(*docs.columns).alias("doc"))
    return whole.join(F.broadcast(gone) if n <= MAX_BROADCAST else gone, "key", "left_anti").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without text or without a letter."""
    with small_batches(spark):
        pred = langid.identify(docs, keep=("text",))
        return _without(docs.where("text is not null"), pred.where(F.col("lang_pred") == langid.UNKNOWN), "unknown")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike by ``nearcopies`` (five-word shingles, similarity 0.8) the row with the smallest id stays.

    Rows without an id answer to each other only: one of those alike stays, whatever stays of the others.  Rows
    of one id and text are one; of them stays the one whose columns hash lowest.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    gone = nearcopies.removed(docs.select(row, F.col("doc_id").alias("id"), F.isnull("doc_id").alias("alone"), "text"))
    whole = docs.select(row, F.struct(*docs.columns).alias("doc")).withColumn("hash", F.xxhash64("doc"))
    # Texts are not shuffled to be told apart, but for those of rows that share id and text.
    often = whole.groupBy("row").agg(F.count("*").alias("c"), F.min("hash").alias("least")).where("c > 1").drop("c")
    often = Scratch(spark, "pipeline").cut(often, "often")
    kept = whole.join(gone, "row", "left_anti")
    if not often.isEmpty():
        kept = kept.join(often, "row", "left")
        copied = kept.where("hash = least").dropDuplicates(["row"])
        kept = kept.where("least is null").unionByName(copied)
    return kept.select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    got = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text",))
    whole = F.exists("items", lambda i: (i["share"] >= ITEM_SHARE) & (i["words"] >= decontam.WIDTH))
    clean = (F.col("n_items") < ITEMS) & (F.col("n_hit") < F.greatest(F.col("n_words") * HIT_SHARE, F.lit(1))) & ~whole
    with small_batches(spark):
        return _without(docs, got.where(~clean), "contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their texts sanitised."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their copies in the mixture (0: left out) and the words it takes."""
    return mixing.mix(docs, extra=("text", "lang", "source", "n_chars"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Fingerprints, models and copies are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.cut(docs, name)
    return docs
