"""Readers for the text layouts of recordings, references and metadata, and the matching writers.

Parsers work on DataFrames of ``(path, content)`` or ``(path, line_no, line)``, so the
same plan serves whole files from ``read.text`` and text already held in a table.
Schemas are always explicit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.cols import reasons
from pulsegrid.sources.trees import manifest_of, numbered_lines, pinned_lines, publish, published

REFERENCE_JSON = "`/FullPackage` array<struct<Timestamp: double, Value: struct<waveform: double>>>"
MANIFEST_JSON = ("subject_id string, session_id string, recording_id string, video_path string, "
                 "references array<struct<measurement_index: int, sbp: double, dbp: double>>, "
                 "associations array<struct<reference_index: int, interval_start_sec: double, interval_end_sec: double>>")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def parse_contact_reference(files: DataFrame) -> DataFrame:
    """Rows PPG, HR, time in three-row, three-column or flat layout; other shapes get an error and no arrays."""
    rows = F.filter(F.transform(F.split(F.trim("content"), r"\s*\n\s*"),
                                lambda s: F.transform(F.split(s, r"\s+"), lambda v: v.try_cast("double"))), lambda r: F.size(r) > 0)
    d = files.withColumn("m", rows)
    cols = F.size(F.element_at("m", 1))
    ragged = F.exists("m", lambda r: F.size(r) != F.size(F.element_at("m", 1)))
    flat = F.flatten("m")
    third = F.floor(F.size(flat) / 3).cast("int")
    line = (F.size("m") == 1) | (cols == 1)
    cut = lambda k: F.slice(flat, third * k + 1, F.greatest(third, F.lit(1)))
    column = lambda k: F.transform("m", lambda r: r[k])
    ok_flat = line & (F.size(flat) % 3 == 0)
    by_row, by_col = ~line & (F.size("m") == 3), ~line & (F.size("m") != 3) & (cols == 3)
    pick = lambda k: F.when(~ragged & ok_flat, cut(k)).when(~ragged & by_row, F.col("m")[k]).when(~ragged & by_col, column(k))
    d = d.withColumns({"ppg": pick(0), "hr": pick(1), "t": pick(2)})
    return d.withColumn("error", F.when(F.col("t").isNull(), "unexpected_shape")).drop("m")


def parse_reference_json(files: DataFrame) -> DataFrame:
    """Record and waveform counts, and the state of the embedded clock."""
    d = files.withColumn("e", F.from_json("content", REFERENCE_JSON)["/FullPackage"])
    n = F.size("e")
    t = F.transform("e", lambda r: r["Timestamp"])
    steps = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: b - a)
    clock = F.when(F.col("e").isNull() | (n < 2), "invalid_reference_json") \
        .when(F.exists(t, lambda v: v.isNull()), "missing_timestamp").when(F.exists(t, lambda v: F.isnan(v)), "invalid_timestamp") \
        .when(F.exists(steps, lambda v: v < 0), "nonmonotonic").when(F.exists(steps, lambda v: v == 0), "duplicates").otherwise("strictly_increasing")
    good = F.size(F.filter("e", lambda r: r["Value"]["waveform"].isNotNull() & ~F.isnan(r["Value"]["waveform"])))
    bad = F.col("e").isNull() | (n < 2)
    return d.withColumns({"records": F.when(bad, 0).otherwise(n), "waveforms": F.when(bad, 0).otherwise(good), "clock_status": clock}).drop("e")


def discover(files: DataFrame, roles: dict[str, str]) -> DataFrame:
    """File roles per subject folder by exact name; missing, duplicate, empty and unrelated files are flagged.

    ``files`` has (path, length); ``roles`` maps a role to a pattern of the file name.
    """
    d = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    role = F.lit(None).cast("string")
    for r, pattern in roles.items():
        role = F.when(F.col("name").rlike(pattern), r).otherwise(role)
    d = d.withColumn("role", role)
    g = d.groupBy("folder").agg(F.count_if(F.col("role").isNull()).alias("unrelated"), F.count_if(F.col("length") == 0).alias("empty"),
                                *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles])
    why = reasons(*[(f"missing_{r}", F.col(f"n_{r}") == 0) for r in roles], *[(f"ambiguous_duplicate_{r}", F.col(f"n_{r}") > 1) for r in roles],
                  ("zero_sized_file", F.col("empty") > 0), ("unrelated_file", F.col("unrelated") > 0))
    return g.withColumn("issues", why)


def parse_csv_lines(lines: DataFrame, header_line: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows below an explicit header line (source row kept, blank rows skipped), and the duplicate headers.

    A table with a duplicate header gives no rows.
    """
    ddl = ", ".join(f"c{i} string" for i in range(width))
    d = lines.withColumn("v", F.from_csv("line", ddl))
    cells = F.array(*[F.col(f"v.c{i}") for i in range(width)])
    head = d.where(F.col("line_no") == header_line).select("path", F.posexplode(cells).alias("k", "header"))
    dup = head.groupBy("path", "header").agg(F.count("*").alias("n")).where("n > 1").select("path", "header")
    names = head.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "header"))).alias("names"))
    body = d.where(F.col("line_no") > header_line).where(F.exists(cells, lambda c: c.isNotNull() & (c != "")))
    body = body.join(dup.select("path").distinct(), "path", "left_anti").join(names, "path")
    keyed = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("names")[i]), cells)
    return body.select("path", F.col("line_no").alias("source_row"), keyed.alias("cells")), dup


def parse_manifest(files: DataFrame) -> DataFrame:
    """Nested manifest with its rejections: missing IDs, repeated reading index, unknown reference, overlapping associations."""
    d = files.withColumn("m", F.from_json("content", MANIFEST_JSON)).select("path", "m.*")
    index = F.transform("references", lambda r: r["measurement_index"])
    ordered = F.array_sort(F.transform("associations", lambda a: F.struct(a["interval_start_sec"].alias("s"), a["interval_end_sec"].alias("e"))))
    n = F.size(ordered)
    clash = F.exists(F.zip_with(F.slice(ordered, 1, F.greatest(n - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a["e"] > b["s"]), lambda v: v)
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    why = reasons(("missing_id", blank("subject_id") | blank("session_id") | blank("recording_id")),
                  ("duplicate_measurement_index", F.size(F.array_distinct(index)) < F.size(index)),
                  ("unknown_reference", F.exists("associations", lambda a: ~F.array_contains(index, a["reference_index"]))),
                  ("overlapping_associations", F.coalesce(clash, F.lit(False))))
    absolute = F.col("video_path").startswith("/")
    folder = F.regexp_replace("path", r"[^/]+$", "")
    return d.withColumns({"issues": why, "video_path": F.when(absolute, F.col("video_path")).otherwise(F.concat(folder, "video_path"))})


def parse_official_split(lines: DataFrame) -> DataFrame:
    """Recording, URL, split lines: ID pattern, URL ending in the ID, known split, no repeats."""
    f = F.split("line", ",")
    d = lines.select("line", F.size(f).alias("fields"), F.try_element_at(f, F.lit(1)).alias("recording"), F.try_element_at(f, F.lit(2)).alias("url"), F.try_element_at(f, F.lit(3)).alias("split"))
    counts = d.groupBy("recording").agg(F.count("*").alias("copies"))
    d = d.join(counts, "recording")
    why = F.when(F.col("fields") != 3, "wrong_field_count").when(~F.col("recording").rlike("^P[0-9]{6}$") | ~F.col("split").isin("Train", "Val", "Test"), "invalid_recording_or_split") \
        .when(~F.col("url").startswith("https://") | (F.substring_index("url", "/", -1) != F.concat("recording", F.lit(".mat"))), "url_mismatch") \
        .when(F.col("copies") > 1, "duplicate_recording").otherwise("")
    return d.withColumn("error", why).drop("copies", "fields")


SPLIT_HEADER = "nk,Split"        # fixed value: two names over three fields, as published


def read_official_split(spark: SparkSession, path: str, pin: str) -> DataFrame:
    """Parsed split file whose content has to match ``pin`` and whose first line has to be the published header."""
    lines = pinned_lines(spark, path, pin)
    head = lines.where("line_no = 1").select("line").distinct().collect()           # one row, or one per table of the path
    if [r["line"] for r in head] != [SPLIT_HEADER]:
        raise ValueError(f"unexpected header {head}")
    return parse_official_split(lines.where("line_no > 1"))


def fixed_csv_lines(df: DataFrame, columns: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """Fixed column order; list columns joined with a pipe; missing values empty."""
    cells = [F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in columns]
    return df.select(F.to_csv(F.struct(*cells), {"emptyValue": "", "nullValue": ""}).alias("line"))


def publish_fixed_csv(df: DataFrame, path: str, columns: list[str], lists: tuple[str, ...] = ()) -> dict:
    """Publish a CSV folder, each file with the header; missing values and empty texts are empty cells."""
    cells = [F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in columns]
    return publish(df.select(*cells), path, "csv", header=True, emptyValue="", nullValue="", escape='"')


def read_fixed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines below the header of every file of a published CSV folder; all headers have to name the manifest's columns."""
    lines = numbered_lines(spark, published(spark, path))
    want = ",".join(manifest_of(spark, path)["columns"])
    wrong = lines.where((F.col("line_no") == 1) & (F.col("line") != want)).first()
    if wrong:
        raise ValueError(f"{wrong['path']} has the header {wrong['line']}")
    return lines.where("line_no > 1")


def union_columns(*tables: DataFrame) -> DataFrame:
    """Union of all columns in sorted order; nested values become JSON text."""
    out = None
    for t in tables:
        flat = t.select(*[F.to_json(c).alias(c) if ty.startswith(("array", "struct", "map")) else F.col(c) for c, ty in t.dtypes])
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def null_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns become NULL."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if ty in ("double", "float") else F.col(c) for c, ty in df.dtypes])


def write_json(df: DataFrame, path: str) -> None:
    null_safe(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def publish_json(df: DataFrame, path: str) -> dict:
    """Publish a folder of JSON lines; missing and non-finite numbers are ``null``."""
    return publish(null_safe(df), path, "json", ignoreNullFields="false")


def publish_union_csv(path: str, *tables: DataFrame) -> dict:
    """Publish the union of tables as CSV with all their columns; quotes inside JSON cells are doubled, missing values are empty."""
    return publish(union_columns(*tables), path, "csv", header=True, nullValue="", emptyValue='""', escape='"')


def read_union_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(published(spark, path), header=True, nullValue="", escape='"', multiLine=False)


PAIR_LABELS = "cuff map<string,string>, subject_id string, session_id string"


def pair_features_labels(documents: DataFrame) -> DataFrame:
    """One row per folder of a ``features.json``: the features, both pressures, ids and why it is left out, if it is.

    ``documents`` has (path, content). Labels are the ``labels.json`` of the same folder. Reasons: ``missing_bp_label``, or
    ``invalid_bp_reference`` where a pressure is absent, no finite number, or not 0 < dbp < sbp. Ids come from the labels, else from the
    names of the folder above and the folder.
    """
    d = documents.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.substring_index("path", "/", -1).alias("name"), "content")
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("content")))
    g = d.where(F.col("name").isin("features.json", "labels.json")).groupBy("folder").agg(one("features.json").alias("features"), one("labels.json").alias("_labels"))
    g = g.where(F.col("features").isNotNull()).withColumn("_l", F.from_json("_labels", PAIR_LABELS))
    number = lambda k: F.try_element_at("_l.cuff", F.lit(k)).try_cast("double")
    g = g.withColumns({"sbp": number("sbp"), "dbp": number("dbp")})
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    good = finite("sbp") & finite("dbp") & (F.col("dbp") > 0) & (F.col("dbp") < F.col("sbp"))
    named = lambda c, back: F.coalesce(F.when(F.col(f"_l.{c}") != "", F.col(f"_l.{c}")), F.try_element_at(F.split("folder", "/"), F.lit(-back)))
    reason = F.when(F.col("_labels").isNull(), "missing_bp_label").when(~F.coalesce(good, F.lit(False)), "invalid_bp_reference").otherwise("")
    return g.select("folder", "features", "sbp", "dbp", named("subject_id", 2).alias("subject_id"), named("session_id", 1).alias("session_id"), reason.alias("reason"))


def numeric_features(pairs: DataFrame) -> DataFrame:
    """(folder, key, value) of the numbers among the features of kept folders; flags, quoted numbers, texts and nested values are none."""
    cells = pairs.where("reason = ''").select("folder", F.explode(F.from_json("features", "map<string,variant>")))
    number = F.schema_of_variant("value").rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    return cells.where(number).select("folder", "key", F.try_variant_get("value", "$", "double").alias("value"))


def read_tables(spark: SparkSession, paths: str | list[str], header_line: int, width: int, unit: str = "folder") -> tuple[DataFrame, DataFrame]:
    """``parse_csv_lines`` over real files of any size: header row and source row are line numbers of the file or folder."""
    return parse_csv_lines(numbered_lines(spark, paths, unit), header_line, width)


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless the output exists; tells whether it wrote."""
    from pyspark.errors import AnalysisException
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except AnalysisException as exc:
        if "PATH_ALREADY_EXISTS" not in str(exc):
            raise
        return False
