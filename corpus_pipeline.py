"""Corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed to their
target weights, and what is left is encoded. Every stage works on all that the one before it kept and reads it from Parquet.

Defined cases: an empty table gives an empty table at every stage. A null or empty text is scored by the bias alone, loses no lines, is near to
nothing, has size 0 and so is never taken by the mix. Rows equal in id and text are judged alike and stay or go together. Null ids and null
sources are values like any other. Further columns pass through under any name; the last stage adds ``ids`` and ``n_tokens`` and replaces
columns that are called so."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.line_dedup import dedup_lines
from pulsegrid.llm.near import near_duplicates
from pulsegrid.llm.registry import table
from pulsegrid.llm.sentencepiece_codec import encode
from pulsegrid.llm.slots import maybe, slots
from pulsegrid.llm.source_mixing import mix
from pulsegrid.llm.toxicity import below, fit
from pulsegrid.session import checkpointed


ROWS_A_BATCH = 1000           # rows of whole documents that a Python worker is sent at once; the default of ten thousand is made for narrow rows


def bounded(spark: SparkSession) -> None:
    """Keep what a task holds outside the heap to some megabytes, whatever columns the documents have. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a machine fitted on the labels."""
    bounded(spark)
    return below(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; a document all of whose lines are cut goes."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))                       # packed: names cannot clash
    got = dedup_lines(packed).where("n_removed < n_lines or n_removed = 0")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return got.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8); rows equal in id and text stay together."""
    bounded(spark)
    gone = checkpointed(near_duplicates(docs).where("not _keep").select(F.col("doc_id").alias("_id"), "_text").distinct())
    d = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("_hash"))
    marked = d.withColumn("_maybe", maybe(slots(gone.select(F.xxhash64("_id", "_text").alias("_row")), "_row", 24), F.xxhash64("doc_id", "_hash")))
    some = marked.where("_maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left_anti")
    return marked.where(~F.col("_maybe")).select("row.*").union(some.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time the mix takes them, dealt to output shards."""
    name = "_shard"
    while name in docs.columns:                                                             # the mix numbers its shards in a column of that name
        name = f"_{name}"
    got = mix(docs.withColumnRenamed("_shard", name))
    return got.select(*[F.col(f"`{name if c == '_shard' else c}`").alias(c) for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, the end id last, and their number."""
    bounded(spark)
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("source_mixing", mix_sources), ("sentencepiece", encode_texts)]

#: The toxicity machine and the encoder are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
