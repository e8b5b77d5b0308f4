"""Operator 8: near duplicates by HyperMinHash.

A document's set holds its distinct word shingles. Each set is sketched into ``BUCKETS`` registers: a shingle's hash picks a bucket, and
the bucket keeps its smallest remainder as a count of leading zeros and the ``MANTISSA`` bits behind the first one. Documents with equal
sets are one class; classes are banded on compressed registers (``ROWS`` registers a band, empty bands skipped). At a similarity of
0.8 two sets share none of 32 bands of 4 with a chance below 1e-7.

Candidates are never all pairs of a band. First each class is held against the first class of its bands, the one with the best estimate
per class is verified, and links are joined into components. Then only bands that still hold several components are looked at, in cells
of at most ``BLOCK`` by ``BLOCK`` classes: a cell tells which components hold classes whose estimate could reach the threshold, as a spanning
forest. The full sets of the components so bridged meet in cells of the same size, and a cell's verified links leave it as a spanning forest
too. So what leaves a task grows with the classes, not with their pairs, and no link between components is lost.
The estimate takes the share of equal registers, less the share that unequal sets of these sizes would agree on by
chance; a pair is dropped if it is ``SIGMAS`` standard errors below the threshold. Verification counts the full sets.

Defined cases: a text without words has an empty set and links with nothing, its component is its own id; fewer words than a shingle make
one shingle of all; rows equal in doc_id and text are one document; a component's id is its smallest id that is not null; a document with a
null id is never the kept one of a component that has an id.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.components import components
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.slots import slots, within
from pulsegrid.llm.words import LOWER, U, Words, combine, mix, sequence_hashes, text_bytes
from pulsegrid.session import checkpointed

BUCKET_BITS, MANTISSA, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BLOCK = 1024
CELL_ROWS, PAIRS_AT_ONCE, STRIP, WIDE = 8_000, 20_000, 256, 1024
READ_BYTES = 1 << 20           # of text at once: the arrays of its words and shingles take some thirty times as much
SIGMAS = 5.0


def shingle_sets(column: pa.Array, words_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of each row's set, sorted, and the set sizes. A-Z count as a-z."""
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets)
    hashes, n = words.hashes(), np.diff(words.first)
    runs = sequence_hashes(hashes, words_each)
    at = np.flatnonzero(words.row[:len(runs)] == words.row[words_each - 1:]) if len(runs) else np.zeros(0, np.int64)
    row, shingle = [words.row[at]], [mix(runs[at] + U(words_each))]
    for short in range(1, words_each):                                   # fewer words than a shingle
        few = np.flatnonzero(n == short)
        if len(few):
            own = hashes[words.first[few]]
            for k in range(1, short):
                own = combine(own, hashes[words.first[few] + k])
            row.append(few)
            shingle.append(mix(own + U(short << 32)))
    row, shingle = np.concatenate(row), np.concatenate(shingle)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new], np.bincount(row[new], minlength=len(column))


def registers(row: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each row: leading zeros above ``MANTISSA`` bits (0: empty bucket). Rows come with sorted shingles."""
    out = np.zeros((rows, BUCKETS), np.uint16)
    bucket = (shingle >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])       # sorted: the smallest remainder of its bucket
    row, bucket, rest = row[first], bucket[first], shingle[first] << U(BUCKET_BITS)
    rest = np.maximum(rest, U(1))
    high = np.zeros(len(rest), np.int64)                                  # place of the first one
    left = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = left >= (U(1) << U(step))
        high[more] += step
        left[more] >>= U(step)
    zeros = np.minimum(63 - high, 62)
    behind = (rest << (U(63) - high.astype(np.uint64))) << U(1) >> U(64 - MANTISSA)
    out[row, bucket] = (((zeros + 1) << MANTISSA) | behind.astype(np.int64)).astype(np.uint16)
    return out


def bands(sketch: np.ndarray, rows_each: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row, band key) of the bands with a register."""
    parts = sketch.reshape(len(sketch), -1, rows_each).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for k in range(rows_each):
        key = mix(key + (parts[:, :, k] + U(1)) * U(0x9E3779B97F4A7C15))
    some = parts.any(axis=2)
    return np.nonzero(some)[0], key[some]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers on which unrelated sets of n and m shingles agree: both minima in one cell of the compressed scale."""
    cells = 1 << MANTISSA
    per_a, per_b = n / BUCKETS, m / BUCKETS
    total = np.zeros(np.broadcast(n, m).shape)
    for zeros in range(0, 24):
        low, width = 2.0 ** -(zeros + 1), 2.0 ** -(zeros + 1) / cells
        middle = low * 1.5
        total += cells * (per_a * width * np.exp(-per_a * middle)) * (per_b * width * np.exp(-per_b * middle))
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of sketches, corrected for chance agreement, and its standard error at 0.8."""
    told = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    by_chance = chance(n, m)
    share = same / np.maximum(told, 1)
    return np.maximum((share - by_chance) / (1 - by_chance), 0), np.sqrt(0.16 / np.maximum(told, 1))


def possible(a, b, n, m, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair may reach the threshold (percent), by size and by estimate; the estimate."""
    value, error = estimate(a, b, n, m)
    fits = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    return fits & (value >= threshold / 100 - SIGMAS * error), value


def sketch_of(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), BUCKETS)


def described(docs: DataFrame, words_each: int) -> DataFrame:
    """One row per document: its set as a class (two hashes), set size and sketch."""
    def run(batch):
        row, shingle, size = shingle_sets(batch.column("text"), words_each)
        begin = np.concatenate([[0], np.cumsum(size)])
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ U(salt)))]) for salt in (0x1234567, 0x7654321ABC)]
        one, two = (mix(s[begin[1:]] - s[begin[:-1]] + size.astype(np.uint64)) for s in sums)
        return {"doc_id": batch.column("doc_id"), "_text": batch.column("_text"), "_c1": one, "_c2": two, "n_shingles": size,
                "_sketch": [r.tobytes() for r in registers(row, shingle, batch.num_rows)]}

    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    return map_text(keyed, run, "doc_id long, _text long, _c1 long, _c2 long, n_shingles long, _sketch binary", limit=READ_BYTES)


def band_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            row, key = bands(sketch_of(batch.column("_sketch").to_pylist()) if batch.num_rows else np.zeros((0, BUCKETS), np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("node").take(pa.array(row))], names=["band", "node"])

    return classes.select("node", "_sketch").mapInArrow(run, "band long, node long")


def best_pairs(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b) that may link, the one with the best estimate for each b."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("_sketch").alias(f"s_{name}"))

    def run(batches):
        for batch in batches:
            d = batch.to_pandas()
            ok, value = possible(sketch_of(d["s_a"]), sketch_of(d["s_b"]), d["n_a"].to_numpy(), d["n_b"].to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(d["a"][ok]), pa.array(d["b"][ok]), pa.array(value[ok])], names=["a", "b", "value"])

    told = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, value double")
    return told.groupBy("b").agg(F.max_by("a", F.struct("value", F.col("a") * -1)).alias("a")).select("a", "b")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs that join two groups not joined before: at most one fewer than there are values."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
    return np.array(out, np.int64)


def in_cells(members: DataFrame, key: str, keep: list[str], rows: int, run, schema: str) -> DataFrame:
    """``run`` over the cells of every ``key``: keys of more than ``BLOCK`` members are cut into blocks, and each pair of blocks is a cell
    (column ``_cell``; ``_two``: of two blocks; ``_right``: member of the second). About ``rows`` members make a task's group."""
    size = members.groupBy(key).agg(F.count("*").alias("_size"))
    d = members.join(size, key).withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    d = d.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    d = d.select(*keep, F.xxhash64(key, F.least("_block", "_other"), F.greatest("_block", "_other")).alias("_cell"),
                 (F.col("_block") > F.col("_other")).alias("_right"), (F.col("_block") != F.col("_other")).alias("_two"))
    groups = max(1, members.count() // rows)
    return d.groupBy(F.pmod(F.col("_cell"), F.lit(groups)).alias("_group")).applyInPandas(run, schema)


def cells_of(d: pd.DataFrame):
    """Sorted members and, for each cell, its first place, the first place of its second block and its end."""
    d = d.sort_values(["_cell", "_right"], kind="stable").reset_index(drop=True)
    cell, right, two = (d[c].to_numpy() for c in ("_cell", "_right", "_two"))
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return d, [(a, a + int((~right[a:b]).sum()) if two[a] else None, b) for a, b in zip(begin.tolist(), np.append(begin[1:], len(d)).tolist())]


def bridges(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs of components (a, b) between which a pair of classes may link, from bands with several components.

    ``members``: band, node, root, n_shingles, _sketch. Pairs of classes exist only inside a task, some thousands at a time, until their
    estimate is known; a task reports a spanning forest of the components it finds bridged.
    """
    def judged(d: pd.DataFrame, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        node, root, n = d["node"].to_numpy(), d["root"].to_numpy(), d["n_shingles"].to_numpy().astype(float)
        low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        once = np.unique(combine(low.view(np.uint64), high.view(np.uint64)), return_index=True)[1]       # bands share pairs
        a, b = a[once], b[once]
        ok, _ = possible(sketch[a], sketch[b], n[a], n[b], threshold)
        return np.unique(np.column_stack([root[a[ok]], root[b[ok]]]), axis=0)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d, cells = cells_of(d)
        sketch, found, waiting, held = sketch_of(d["_sketch"]), [np.zeros((0, 2), np.int64)], [], 0
        root = d["root"].to_numpy()
        for a, cut, b in cells:
            two = cut is not None
            left, right = np.arange(a, cut if two else b), np.arange(cut if two else a, b)
            step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
            for first in range(0, len(left), step):                           # some rows of a cell against its columns
                some = left[first:first + step]
                x, y = np.nonzero(root[some, None] != root[None, right])
                x, y = some[x], right[y]
                waiting.append((x, y) if two else (x[x < y], y[x < y]))
                held += len(x)
                if held > PAIRS_AT_ONCE:
                    found.append(judged(d, sketch, *map(np.concatenate, zip(*waiting))))
                    waiting, held = [], 0
        if waiting:
            found.append(judged(d, sketch, *map(np.concatenate, zip(*waiting))))
        pairs = np.concatenate(found)
        return pd.DataFrame(pairs[forest(*pairs.T)], columns=["a", "b"])

    return in_cells(members, "band", ["node", "root", "n_shingles", "_sketch"], CELL_ROWS, run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a cell, from their incidence with the shingles that two or more hold."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[which] > 1
    row, which = row[shared], np.unique(which[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(which.max()) + 1 if len(which) else 0, WIDE):
        some = (which >= first) & (which < first + WIDE)
        held = np.zeros((len(sets), WIDE), np.float32)
        held[row[some], which[some] - first] = 1
        out += held @ held.T
    return out


def cell_links(sets: list[np.ndarray], root: np.ndarray, cut: int | None, threshold: int) -> np.ndarray:
    """Links (x, y) of a cell across components, as a spanning forest: of all its sets, or of those before ``cut`` with those from it on.
    Pairs are judged some rows at a time."""
    both, n, out = overlaps(sets), np.array([len(s) for s in sets]), np.zeros((0, 2), np.int64)
    last = len(sets) if cut is None else cut
    for first in range(0, last, STRIP):
        rows = slice(first, min(first + STRIP, last))
        x, y = np.nonzero(((100 + threshold) * both[rows].astype(float) >= threshold * (n[rows, None] + n[None, :])) & (root[rows, None] != root[None, :]))
        x += first
        some = y > x if cut is None else y >= cut
        out = np.concatenate([out, np.column_stack([x[some], y[some]])])
        out = out[forest(*root[out].T)]
    return out


def exact_links(members: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) across components, from the full sets of all classes of bridged components (``cluster``, node, root, _set): a spanning forest
    of each cell's links."""
    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d, cells = cells_of(d)
        sets = [np.frombuffer(x, np.uint64) for x in d["_set"]]
        node, root, out = d["node"].to_numpy(), d["root"].to_numpy(), [np.zeros((0, 2), np.int64)]
        for a, cut, b in cells:
            out.append(node[a + cell_links(sets[a:b], root[a:b], cut if cut is None else cut - a, threshold)])
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return in_cells(members, "cluster", ["node", "root", "_set"], BLOCK, run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = pairs.join(sets.select(F.col("node").alias("a"), F.col("_set").alias("set_a")), "a")
    return a.join(sets.select(F.col("node").alias("b"), F.col("_set").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, words_each: int) -> DataFrame:
    """The whole sets of the given classes, from the text of each class's first document."""
    wanted = classes.select("node", "_first.*")
    chosen = slots(wanted.select(F.xxhash64("doc_id", "_text").alias("_row")), "_row", 24)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").withColumn("_row", F.xxhash64("doc_id", "_text"))

    def run(batch):
        batch = batch.filter(pa.array(within(chosen, batch.column("_row").to_numpy())))      # here, not by a second Python worker for each task
        _, shingle, size = shingle_sets(batch.column("text"), words_each)
        begin = np.concatenate([[0], np.cumsum(size)])
        return {"doc_id": batch.column("doc_id"), "_text": batch.column("_text"), "_set": [shingle[a:b].tobytes() for a, b in zip(begin, begin[1:])]}

    got = map_text(rows, run, "doc_id long, _text long, _set binary", limit=READ_BYTES).alias("g")
    w = wanted.alias("w")
    return (got.join(w, F.col("g.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("g._text") == F.col("w._text"))).select("node", "_set")
            .groupBy("node").agg(F.first("_set").alias("_set")))


def near_classes(docs: DataFrame, words_each: int = 2, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """Documents with their class hashes, and classes with their component (``root``)."""
    rows = checkpointed(described(docs, words_each))
    classes = (rows.where("n_shingles > 0").groupBy("_c1", "_c2").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_text"))).alias("m"),
                                                                       F.first("n_shingles").alias("n_shingles"), F.first("_sketch").alias("_sketch")))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "_c1", "_c2", "n_shingles", "_sketch",
                                          F.struct("m.doc_id", "m._text").alias("_first")))        # ids hold once written
    banded = band_rows(classes)
    full = banded.groupBy("band").agg(F.count("*").alias("_n"), F.min("node").alias("a")).where("_n > 1")
    shared = checkpointed(banded.join(full.select("band", "a"), "band"))                        # bands with two classes or more
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    tried = checkpointed(best_pairs(stars, classes, threshold))

    def sets_of(some: DataFrame) -> DataFrame:
        return checkpointed(full_sets(docs, classes.join(some, "node"), words_each))

    first = verified(tried, sets_of(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()), threshold)
    links = checkpointed(first)
    roots = components(links)
    labelled = checkpointed(classes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    inside = shared.select("band", "node").join(labelled, "node")
    mixed = inside.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("band")
    members = checkpointed(inside.join(mixed, "band").join(classes.select("node", "n_shingles", "_sketch"), "node"))
    clusters = checkpointed(components(checkpointed(bridges(members, threshold))).select(F.col("node").alias("root"), F.col("root").alias("cluster")))
    apart = checkpointed(labelled.join(clusters, "root"))
    more = exact_links(apart.join(sets_of(apart.select("node")), "node"), threshold)
    roots = components(checkpointed(links.union(more)))
    return rows, classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, words_each: int = 5, threshold: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; ``_text`` (hash of the text) and ``_keep`` (the one row that stands for the component)."""
    rows, classes = near_classes(docs, words_each, threshold)
    heads = classes.groupBy("root").agg(F.min(F.struct(F.col("_first.doc_id").isNull().alias("no_id"), F.col("_first.doc_id").alias("doc_id"), F.col("_first._text").alias("_text"))).alias("_head"))
    told = classes.select("_c1", "_c2", "root").join(heads, "root")
    d = rows.drop("_sketch").join(told, ["_c1", "_c2"], "left")
    own = F.col("n_shingles") == 0
    component = F.when(own, F.col("doc_id")).otherwise(F.col("_head.doc_id"))
    stays = own | (F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("_text") == F.col("_head._text")))
    return d.select("doc_id", "_text", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), stays.alias("_keep"))


@query("op8_hyperminhash", oracle="""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select distinct doc_id, case when len(w) = 1 then w[1] else unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || ' ' || w[i + 1])) end as g from d where len(w) > 0),
    n as (select doc_id, count(*) as n from s group by 1),
    rare as (select g, count(*) as f from s group by 1),
    ranked as (select s.doc_id, s.g, row_number() over (partition by s.doc_id order by f, s.g) as r, n.n from s join rare using (g) join n using (doc_id)),
    head as (select doc_id, g, n from ranked where 5 * r <= n + 10),
    cand as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from head a join head b on a.g = b.g and a.doc_id < b.doc_id
      and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    inter as (select a, b, na, nb, count(*) as k from cand join s x on x.doc_id = a join s y on y.doc_id = b and y.g = x.g group by all),
    link as (select a, b from inter where 100 * k >= 80 * (na + nb - k)),
    e as (select a, b from link union select b, a from link),
    reach as (select doc_id as x, doc_id as y from d union select r.x, e.b from reach r join e on r.y = e.a)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.least as component_id, d.doc_id = c.least as kept
    from d left join n using (doc_id) join (select x, min(y) as least from reach group by 1) c on c.x = d.doc_id""")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words_each=2).select("doc_id", "n_shingles", "component_id", "kept")
