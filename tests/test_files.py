"""Real files: line positions across splits, published folders, pins, pairs of folders."""
import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import files as fl, trees as tr


def test_lines_of_a_file_larger_than_a_split(spark, tmp_path):
    """Many splits of one file, files of one folder in order, a byte-order mark, a missing last line end and blank lines."""
    a = ["﻿id,name,size", *[f"{k},{'x' * (k % 37)},{k}" if k % 11 else "" for k in range(4000)]]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("\n".join(a), encoding="utf-8")
    (tmp_path / "t" / "b.csv").write_text("first\r\nsecond\r\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        got = tr.numbered_lines(spark, str(tmp_path / "t"))
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 20
        lines = {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in got.collect()}
        whole = sorted((r["line_no"], r["line"]) for r in tr.numbered_lines(spark, str(tmp_path / "t"), "folder").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [a[0].lstrip("﻿"), *a[1:]]
    assert [lines["a.csv", k + 1] for k in range(len(want))] == want and lines["b.csv", 2] == "second" and len(lines) == len(want) + 2
    assert whole == list(enumerate([*want, "first", "second"], 1))


def test_tables_keep_their_source_rows(spark, tmp_path):
    """Lines written by many tasks under one name read back in order, the header wherever its line number says."""
    n = 3000
    body = spark.range(n).select(F.lit("big").alias("path"), F.col("id").alias("k"), F.concat_ws(",", F.col("id").cast("string"), F.lit("v")).alias("line"))
    head = spark.createDataFrame([("big", -2, "a title"), ("big", -1, "id,v"), ("twice", -1, "t"), ("twice", 0, "v,v"), ("twice", 1, "1,2")], "path string, k long, line string")
    tr.write_lines(head.union(body).repartition(9), str(tmp_path / "x"), ["k"], parts=4)
    assert len(list((tmp_path / "x" / "path=big").glob("part-*"))) > 1
    rows, dup = fl.read_tables(spark, str(tmp_path / "x"), 2, 2)
    got = sorted((r["source_row"], r["cells"]["id"]) for r in rows.collect())
    assert got == [(k + 3, str(k)) for k in range(n)]
    assert [r["header"] for r in dup.collect()] == ["v"]


def test_a_published_folder_is_whole_once(spark, tmp_path):
    df = spark.createDataFrame([(1, None, float("nan"), ["a", "b"]), (2, 'say "x", y', 2.5, [])], "id long, name string, v double, why array<string>")
    path = str(tmp_path / "out")
    fl.publish_fixed_csv(fl.null_safe(df), path, ["why", "id", "name", "v"], ("why",))
    assert {r["line"] for r in fl.read_fixed_csv(spark, path).collect()} == {"a|b,1,,", ',2,"say ""x"", y",2.5'}
    found = tr.manifest_of(spark, path)
    with pytest.raises(tr.Refused):
        fl.publish_fixed_csv(df, path, ["id"])
    assert tr.manifest_of(spark, path) == found and len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1
    part = next((tmp_path / "out" / found["folder"]).glob("part-*"))
    part.write_text(part.read_text() + "x")
    with pytest.raises((tr.PinMismatch, Exception)) as e:
        tr.published(spark, path)
    assert "data-" in str(e.value) or "checksum" in str(e.value).lower()


def test_a_second_writer_that_starts_at_once_is_refused(spark, tmp_path, monkeypatch):
    """Both find nothing published; the one whose manifest comes second loses, and its data go."""
    df, path, real = spark.range(3), str(tmp_path / "race"), tr.content_pin

    def slow(s, p):
        if not (tmp_path / "race" / "manifest.json").exists():
            (tmp_path / "race" / "manifest.json").write_text(json.dumps({"folder": "other"}))
        return real(s, p)

    monkeypatch.setattr(tr, "content_pin", slow)
    with pytest.raises(tr.Refused):
        tr.publish(df, path, "parquet")
    assert not list((tmp_path / "race").glob("data-*"))


def test_union_and_json_read_back(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    b = spark.createDataFrame([(3, ("u", 'quote " and, comma'))], "id long, nested struct<role:string,text:string>")
    fl.publish_union_csv(str(tmp_path / "u"), a, b)
    got = sorted(tuple(r) for r in fl.read_union_csv(spark, str(tmp_path / "u"), "id long, name string, nested string").fillna("", ["name", "nested"]).collect())
    assert got == [(1, "x", ""), (2, "", ""), (3, "", '{"role":"u","text":"quote \\" and, comma"}')]
    fl.publish_json(spark.createDataFrame([(1, float("inf")), (2, 1.5)], "id long, v double"), str(tmp_path / "j"))
    assert {r["line"] for r in tr.numbered_lines(spark, tr.published(spark, str(tmp_path / "j"))).collect()} == {'{"id":1,"v":null}', '{"id":2,"v":1.5}'}


def test_plain_trees_and_written_trees_are_named_alike(spark, tmp_path):
    for folder, files in {"s1": {"vid.avi": 3, "ground_truth.txt": 5}, "s2": {"video.mp4": 0, "notes": 1}}.items():
        (tmp_path / "plain" / folder).mkdir(parents=True)
        for name, n in files.items():
            (tmp_path / "plain" / folder / name).write_bytes(b"x" * n)
    (tmp_path / "plain" / "s1" / "_SUCCESS").write_text("")
    roles = {"video": r"^vid(eo)?\.(avi|mp4)$", "reference": r"^ground_truth\.txt$"}
    root = str(tmp_path / "plain")
    got = {r["folder"]: (r["n_video"], r["n_reference"], r["unrelated"], r["issues"]) for r in fl.discover(tr.listed(spark, root, empty=True).select(tr.logical(F.col("path"), root).alias("path"), "length"), roles).collect()}
    assert got == {"s1": (1, 1, 0, []), "s2": (1, 0, 1, ["missing_reference", "zero_sized_file", "unrelated_file"])}
    written = str(tmp_path / "written")
    tr.write_documents(spark.createDataFrame([("s1", "vid.avi", "a\nb"), ("s1", "vid.avi", "c"), ("s 3%", "x", "")], "folder string, name string, content string"), written, ["folder", "name"])
    assert sorted((r["path"], r["content"]) for r in tr.documents(spark, written).collect())[-2:] == [("s1/vid.avi", "a\nb"), ("s1/vid.avi", "c")]


def test_official_split_by_pin(spark, tmp_path):
    f = tmp_path / "split.csv"
    f.write_text("﻿nk,Split\nP000001,https://x.example/P000001.mat,Train\nP000002,https://x.example/P000003.mat,Test\n", encoding="utf-8")
    import hashlib
    pin = hashlib.sha256(f.read_bytes()).hexdigest()
    assert {r["recording"]: r["error"] for r in fl.read_official_split(spark, str(f), pin).collect()} == {"P000001": "", "P000002": "url_mismatch"}
    with pytest.raises(tr.PinMismatch):
        fl.read_official_split(spark, str(f), "0" * 64)
    f.write_text("recording,url,split\n")
    with pytest.raises(ValueError, match="header"):
        fl.read_official_split(spark, str(f), hashlib.sha256(f.read_bytes()).hexdigest())


def test_pairs_of_features_and_labels(spark):
    good = json.dumps({"cuff": {"sbp": 120, "dbp": "80"}, "subject_id": "P1"})
    docs = [("n1/s1/features.json", json.dumps({"a": 1, "b": 2.5, "c": True, "d": "3", "e": [1], "f": None})), ("n1/s1/labels.json", good), ("n1/s2/features.json", "{}"),
            ("n1/s3/features.json", "{}"), ("n1/s3/labels.json", json.dumps({"cuff": {"sbp": 70, "dbp": 80}})), ("n1/s4/features.json", "{}"), ("n1/s4/labels.json", "not json"),
            ("n1/s5/features.json", "{}"), ("n1/s5/labels.json", json.dumps({"cuff": {"sbp": "NaN", "dbp": 80}, "session_id": ""})), ("n1/s6/labels.json", good)]
    pairs = fl.pair_features_labels(spark.createDataFrame(docs, "path string, content string"))
    got = {r["folder"]: (r["reason"], r["subject_id"], r["session_id"]) for r in pairs.collect()}
    bad = "invalid_bp_reference"
    assert got == {"n1/s1": ("", "P1", "s1"), "n1/s2": ("missing_bp_label", "n1", "s2"), "n1/s3": (bad, "n1", "s3"), "n1/s4": (bad, "n1", "s4"), "n1/s5": (bad, "n1", "s5")}
    assert sorted((r["key"], r["value"]) for r in fl.numeric_features(pairs).collect()) == [("a", 1.0), ("b", 2.5)]


def test_an_archive_is_few_files_and_keeps_every_document(spark, tmp_path):
    root = str(tmp_path / "archive")
    docs = [(k // 3, f"f{k % 3}.txt", None if k == 5 else "é\n" * (k % 4)) for k in range(3000)]
    tr.write_archive(spark.createDataFrame(docs, "folder long, name string, content string").repartition(3), root, ["folder", "name"])
    assert len([f for f in (tmp_path / "archive").iterdir() if f.name.endswith(".parquet")]) <= 3                    # a file per document before
    got = sorted((r["path"], r["length"], r["content"]) for r in tr.archived(spark, root).collect())
    assert got == sorted((f"{a}/{b}", len((c or "").encode()), c or "") for a, b, c in docs)
    plan = tr.archived(spark, root).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
