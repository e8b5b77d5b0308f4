"""Folder trees: listing without content, lines with their positions in files of any size, pinned content, and folders published at once.

A tree may be a plain one (``root/subject/video.avi``) or one that Spark wrote by partition columns (``root/folder=subject/name=video.avi/
part-...``): ``logical`` names a file alike in both.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SKIP = r"/(_[^/]*|\.[^/]*)$"                    # markers and hidden files that are not part of a table


class PinMismatch(ValueError):
    """Content is not what was pinned."""


def logical(path: Column, root: str) -> Column:
    """Path below ``root``: ``key=value`` folders give their value, Spark's part file names the folder it lies in."""
    below = F.regexp_replace(path, "^[a-z]+:/*(?=/)", "")
    plain = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    below = F.substring_index(below, plain.rstrip("/") + "/", -1)
    return F.regexp_replace(F.regexp_replace(below, r"(^|/)[^/=]+=([^/]*)", "$1$2"), r"/part-\d+[^/]*$", "")


def listed(spark: SparkSession, root: str, empty: bool = False) -> DataFrame:
    """``path``, ``length`` and ``modified`` of the files below ``root`` by one distributed listing; contents are not read.

    That listing leaves out files of no bytes. With ``empty`` they are added by walking the tree on the driver, a step per file: meant for
    trees of recordings, thousands of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    if empty:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        walk = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop.Path(root), True)
        none = []
        while walk.hasNext():
            f = walk.next()
            if not f.getLen():
                none.append((f.getPath().toString(), 0, f.getModificationTime()))
        if none:
            files = files.union(spark.createDataFrame(none, "path string, length long, ms long").select("path", "length", F.timestamp_millis("ms")))
    return files.where(~F.col("path").rlike(SKIP))


def write_documents(documents: DataFrame, root: str, by: list[str], content: str = "content") -> None:
    """One file per row of ``documents`` below folders named after the columns ``by``. A file ends with a line end that is not content."""
    documents.select(*by, content).write.mode("errorifexists").partitionBy(*by).option("maxRecordsPerFile", 1).text(root)


def documents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path`` (logical) and whole ``content`` of every file below ``root``: for documents of bounded size, not for tables."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return d.select(logical(F.col("_metadata.file_path"), root).alias("path"), F.regexp_replace("value", r"\r?\n$", "").alias("content"))


def write_archive(documents: DataFrame, root: str, by: list[str], content: str = "content") -> None:
    """Documents of a tree packed into few files: per row the path ``by`` names, its bytes and its content. For trees that grow with the data,
    where a file and a folder per document would cost a listing and a commit each."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) for c in by]
    body = F.coalesce(F.col(content), F.lit(""))
    documents.select(F.concat_ws("/", *named).alias("path"), F.octet_length(body).cast("long").alias("length"), body.alias("content")) \
        .write.mode("errorifexists").parquet(root)


def archived(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``length`` and ``content`` of the documents of an archive; a listing that selects path and length reads no content."""
    return spark.read.schema("path string, length long, content string").parquet(root)


def numbered_lines(spark: SparkSession, paths: str | list[str], unit: str = "file") -> DataFrame:
    """``path``, ``line_no`` (from one) and ``line`` of text files of any size; a file may be read in many splits.

    A row knows its split and its place in the task, so its place inside its split needs no shuffle; the lines of each split are counted
    and a running sum over the splits of a file, one small row each, gives where a split begins. With ``unit="folder"`` the files of a folder
    are one table whose lines go on from file to file in order of their names. A byte-order mark is removed.
    """
    paths = [paths] if isinstance(paths, str) else paths
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                      F.monotonically_increasing_id().alias("_id"), "value")
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    path = F.col("_file") if unit == "file" else F.regexp_replace("_file", r"/[^/]*$", "")
    before = Window.partitionBy("path").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("path", path).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.join(splits, ["_file", "_start"])
    number = F.col("_before") + F.col("_id") - F.col("_least") + 1
    return placed.select("path", number.alias("line_no"), F.when(number == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("line"))


def write_lines(lines: DataFrame, root: str, order: list[str], by: str = "path", line: str = "line", parts: int | None = None) -> None:
    """Text tables below folders named after ``by``, lines in ``order``; a large table becomes several files whose names keep the order."""
    dealt = lines.repartitionByRange(parts, by, *order) if parts else lines.repartitionByRange(by, *order)
    dealt.sortWithinPartitions(by, *order).select(by, line).write.mode("errorifexists").partitionBy(by).text(root)


def content_pin(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of the digests of a folder's files in order of their names. Files are hashed by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(SKIP))
    found = sorted((r["path"], r["digest"]) for r in files.select("path", F.sha2("content", 256).alias("digest")).toLocalIterator())
    return found[0][1] if len(found) == 1 else hashlib.sha256("\n".join(d for _, d in found).encode()).hexdigest()


def pinned_lines(spark: SparkSession, path: str, expected: str, unit: str = "folder") -> DataFrame:
    """Numbered lines of content that has to match its pin."""
    actual = content_pin(spark, path)
    if actual != expected:
        raise PinMismatch(f"{path} has {actual}, pinned is {expected}")
    return numbered_lines(spark, path, unit)


class Refused(FileExistsError):
    """Something is published there already."""


def publish(df: DataFrame, path: str, kind: str, **options) -> dict:
    """Write ``df`` below ``path`` so that readers see all of it or nothing, once: data go to a staging folder of their own, then a manifest that
    names it is created where none may exist. Returns the manifest. A second writer is refused, and its staging folder removed."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest, data = hadoop.Path(root, "manifest.json"), f"data-{uuid.uuid4().hex}"
    if store.exists(manifest):
        raise Refused(path)
    df.write.mode("errorifexists").options(**options).format(kind).save(f"{path}/{data}")
    found = {"folder": data, "format": kind, "columns": df.columns, "files": listed(spark, f"{path}/{data}").count(), "pin": content_pin(spark, f"{path}/{data}")}
    try:
        out = store.create(manifest, False)
    except Exception as taken:                      # another writer was first
        if not store.exists(manifest):
            raise
        store.delete(hadoop.Path(root, data), True)
        raise Refused(path) from taken
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    return found


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def published(spark: SparkSession, path: str, verify: bool = True) -> str:
    """Data folder of a published path, by its manifest alone; ``verify`` hashes the files again."""
    found = manifest_of(spark, path)
    folder = f"{path}/{found['folder']}"
    if verify and content_pin(spark, folder) != found["pin"]:
        raise PinMismatch(folder)
    return folder
