"""Operator 12: the prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Conversations with the same turns are one class from the start. From the deepest level up, the
classes that end at a level meet the nodes that survived from below; one aggregate by prefix makes that level's nodes with all their sums, and
their last turn is stripped to give the rows of the next level. Each level is a written table that is read once.

Turns only one class has, beyond ``deep`` turns, need no meeting: those tails are emitted at once, so that the number of levels does not follow
the longest conversation.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.registry import query, table
from pulsegrid.session import checkpointed, shared_folder

DEEP = 16                # turns up to which every class is peeled level by level
PIECE_BITS = 8           # conversation ids are spelled in pieces of 2^PIECE_BITS possible ids

_PATH = "array<struct<key:binary,parent:binary,bytes:int>>"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order (null first; ties by role, then by a hash of the text) as digests and text lengths in bytes.

    Null role or text becomes empty. Rows without conv_id belong to no conversation and are left out. Texts are hashed before they are
    gathered, so a conversation costs a few dozen bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    one = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    return (turns.where("conv_id is not null").select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns")))


def regrafted(own: DataFrame) -> DataFrame:
    """Conversations rebuilt from the first h turns of the one of their five with the least id, and their own turns after their first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base", "left")
    head = F.coalesce("head", F.array().cast("array<struct<digest:binary,bytes:int>>"))
    return both.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def with_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, key of the whole sequence, and the path: key of each prefix, of the one before it, and bytes of the last text.

    A key is the MD5 of the key before and the turn's digest; the root's is empty.
    """
    kind = pa.list_(pa.struct([("key", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int32())]))

    def run(batches):
        for batch in batches:
            ids, turns = batch.column("conv_id"), batch.column("turns")
            flat = turns.flatten()
            digest, n = flat.field("digest").to_pylist(), turns.value_lengths().to_pylist()
            keys, parents, ends, at = [], [], [], 0
            for size in n:
                key = b""
                for d in digest[at:at + size]:
                    parents.append(key)
                    key = hashlib.md5(key + d).digest()
                    keys.append(key)
                ends.append(key)
                at += size
            steps = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), flat.field("bytes").cast(pa.int32())], fields=list(kind.value_type))
            offsets = [0]
            for size in n:
                offsets.append(offsets[-1] + size)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ends, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps).cast(kind)], ["conv_id", "ends", "path"])

    return conversations.select("conv_id", "turns").mapInArrow(run, f"conv_id long, ends binary, path {_PATH}")


def spelled_ends(paths: DataFrame) -> DataFrame:
    """``key``, ``ends_sha256``: hash of the ids that end at a node, ascending, joined by commas.

    Ids are spelled in pieces of a fixed range of ids before they meet, and a node's pieces are hashed as they stream by in order, so memory
    does not follow the number of copies.
    """
    pieces = (paths.groupBy("ends", F.shiftright("conv_id", PIECE_BITS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select("ends", "part", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("piece")))

    def run(batches):
        now, digest, out = None, None, ([], [])
        for batch in batches:
            for key, piece in zip(batch.column("ends").to_pylist(), batch.column("piece").to_pylist()):
                if key != now:
                    if now is not None:
                        out[0].append(now)
                        out[1].append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["key", "ends_sha256"])
            out = ([], [])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("ends").sortWithinPartitions("ends", "part").select("ends", "piece").mapInArrow(run, "key binary, ends_sha256 string")


def classes_of(paths: DataFrame, deep: int = DEEP) -> DataFrame:
    """One row per distinct sequence: members, least id, path, and the level it enters the peeling at: its depth, or where its tail
    beyond ``deep`` turns begins that no other class has."""
    classes = checkpointed(paths.groupBy("ends").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("path").alias("path"))
                           .withColumn("depth", F.size("path")))
    far = classes.where(F.col("depth") > deep).select("ends", F.posexplode("path").alias("at", "step")).where(F.col("at") >= deep).select("ends", (F.col("at") + 1).alias("at"), F.col("step.key").alias("key"))
    common = far.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = far.join(common, "key").groupBy("ends").agg(F.max("at").alias("shared"))
    return classes.join(shared, "ends", "left").withColumn("level", F.least("depth", F.greatest(F.coalesce("shared", F.lit(0)), F.lit(deep))))


def prefix_trie(paths: DataFrame, deep: int = DEEP) -> DataFrame:
    """One row per node: ``key``, ``parent``, ``depth``, ``conv_id`` (least member), ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No conversations, no nodes.
    """
    spark = paths.sparkSession
    paths = checkpointed(paths)
    folder = shared_folder(spark, "classes")
    made = classes_of(paths, deep)
    made.write.partitionBy("level").parquet(folder)
    classes = spark.read.schema(made.schema).parquet(folder)
    top = classes.agg(F.max("level")).first()[0]
    if top is None:
        return spark.createDataFrame([], "key binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    saved = F.aggregate(F.slice("path", F.col("level") + 1, F.greatest(F.col("depth") - F.col("level"), F.lit(0))), F.lit(0).cast("long"), lambda s, t: s + t["bytes"]) * (F.col("n_convs") - 1)
    tailed = F.col("depth") > F.col("level")
    entering = classes.select("level", F.slice("path", F.lit(1), F.col("level")).alias("path"), "conv_id", "n_convs", tailed.cast("long").alias("n_children"),
                              tailed.cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    levels = shared_folder(spark, "levels")
    below = None
    for level in range(top, -1, -1):
        rows = entering.where(F.col("level") == level).drop("level")
        if below is not None:
            rows = rows.union(below.select(F.slice("path", 1, level).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long"), "n_leaves", "saved_tokens"))
        last = F.element_at("path", -1) if level else F.lit(None).cast("struct<key:binary,parent:binary,bytes:int>")
        met = (rows.withColumn("key", F.coalesce(last["key"], F.lit(b""))).groupBy("key")
               .agg(F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
                    F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        nodes = met.select("key", last["parent"].alias("parent"), "path", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                           (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce(last["bytes"], F.lit(0))).alias("saved_tokens"))
        nodes.write.parquet(f"{levels}/depth={level}")
        below = spark.read.schema(nodes.schema).parquet(f"{levels}/depth={level}")
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    peeled = spark.read.parquet(levels).select(columns)
    backwards = F.aggregate(F.reverse(F.slice("path", F.col("level") + 1, F.col("depth") - F.col("level"))), F.struct(F.array().cast("array<long>").alias("sums"), F.lit(0).cast("long").alias("sum")),
                            lambda s, t: F.struct(F.array_append(s["sums"], s["sum"] + t["bytes"]).alias("sums"), (s["sum"] + t["bytes"]).alias("sum")), lambda s: F.reverse(s["sums"]))
    tails = (classes.where(tailed).select("depth", "level", "conv_id", "n_convs", F.posexplode(F.arrays_zip(F.slice("path", F.col("level") + 1, F.col("depth") - F.col("level")).alias("step"), backwards.alias("sum"))))
             .select(F.col("col.step.key").alias("key"), F.col("col.step.parent").alias("parent"), (F.col("level") + F.col("pos") + 1).alias("depth"), "conv_id", "n_convs",
                     (F.col("level") + F.col("pos") + 1 < F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                     (F.col("col.sum") * (F.col("n_convs") - 1)).alias("saved_tokens")))
    nodes = peeled.union(tails)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, "parent", "left").join(spelled_ends(paths), "key", "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


_CRC = """list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
          lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


@query("op12_truncation_peeling", f"""
    WITH own AS (SELECT conv_id, list({{'d': md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 'b': octet_length(encode(coalesce(text, '')))}}
                                      ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
                 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    cut AS (SELECT conv_id, t, xor({_CRC}, 4294967295) % 9 AS h FROM own),
    built AS (SELECT c.conv_id, coalesce(b.t[1:c.h], []) || c.t[c.h + 1:] AS t FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    pre AS (SELECT conv_id, d, len(t) AS depth, CASE WHEN d = 0 THEN 0 ELSE t[d].b END AS b, array_to_string(list_transform(t[1:d], lambda x: x.d), '') AS k,
                   CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.d), '') END AS up
            FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
    node AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
                    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = d), '')) AS ends FROM pre GROUP BY d, k),
    kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
    whole AS (SELECT node.*, coalesce(kids.n, 0) AS children FROM node LEFT JOIN kids USING (d, k)),
    below AS (SELECT a.d, a.k, sum(CASE WHEN x.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.b) AS saved
              FROM whole x, unnest(range(0, x.d + 1)) AS u(d), (SELECT DISTINCT d, k FROM whole) a WHERE a.d = u.d AND a.k = x.k[1:32 * u.d] GROUP BY ALL)
    SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.children AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
           CAST(below.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
    FROM whole w LEFT JOIN node p ON p.d = w.d - 1 AND p.k = w.up JOIN below ON below.d = w.d AND below.k = w.k""")
def op12(spark, sf_dir):
    own = checkpointed(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie(with_paths(regrafted(own))).select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
