"""The corpus pipeline: documents to shards, one Spark job after another, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.llm import decontaminate, jaccard, language, mixing, shards
from trapline.llm.tables import kept
from trapline.session import configure, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be read; null and letterless texts go.

    Profiles are learned from the documents themselves, as in the operator's query. Where none can
    be learned, for want of documents of a known language, every text with a letter stays.
    """
    configure(spark)
    profiles = language.learn(docs.filter(language.trains()))
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.filter(language.identify(F.col("text"), profiles)["lang_pred"] != language.UNKNOWN)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share three quarters of their five-word shingles: the one of the smallest id.

    Of rows that repeat both id and text one stays; rows of one id whose texts differ are documents of
    their own. Documents without an id are in no group and stay.
    """
    configure(spark)
    mark = free_name(docs, "key")
    named = docs.filter("doc_id is not null").withColumn(mark, F.xxhash64("doc_id", "text"))
    found = jaccard.link_components(named.select(F.col(mark).alias("doc_id"), "text")).filter("n_shingles > 0").select(F.col("doc_id").alias(mark), "component_id").distinct()
    rows = named.groupBy(mark).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    told = kept(rows.join(found, mark, "left"), "members")
    stays = told.filter("component_id is not null").groupBy("component_id").agg(F.min(F.struct("id", mark)).alias("first"))  # map-side
    gone = told.join(stays, "component_id").filter(F.col(mark) != F.col("first")[mark]).select(mark)
    left = named.join(gone, mark, "left_anti")
    several = told.filter("rows > 1").select(mark)
    number = free_name(docs, "row")
    once = left.join(several, mark, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy(mark).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(number) == 1)
    return left.join(several, mark, "left_anti").select(*docs.columns).union(once.select(*docs.columns)).union(docs.filter("doc_id is null"))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    configure(spark)
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    configure(spark)
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left."""
    configure(spark)
    return shards.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Rank-order profiles and components of near duplicates have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read as the next one's input."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
