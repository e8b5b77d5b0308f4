"""Operator 9: repeated word passages by seed and extension.

A window is ``width`` consecutive words. Its seed is the smallest hash of its word ``gram``-s (winnowing), so equal windows have equal
seeds wherever they stand, and a repeated window has a seed that occurs at least twice. Consecutive windows with one seed form a
stretch. Stretches are first joined by seed and content: copies fall into one stretch with its smallest doc_id. Where the stretches
of a seed differ, each is extended from the seed's place one word at a time to the left and to the right; a window of it is as far
to the left and to the right as its key says, so stretches that share the key (seed, words to the left, words to the right) match over
the whole window. The smallest doc_id of a key decides; consecutive matching windows make up the maximal repeats.

No documents are paired and no seed's documents are gathered: copies meet as one stretch, a task takes the different stretches of
a seed only where there are at most ``MOST_STRETCHES``, and beyond that the windows' keys are aggregated with partial sums. The join back is
an inner join on a side with one row per stretch, which Spark splits where a stretch is frequent. Seeds that occur once are dropped at the
scan by a bit map of fixed size. Word hashes have 64 bits; keys have 128.

Defined cases: null and empty texts and texts of fewer than ``width`` words keep all words; rows equal in doc_id and text are one
document; a null doc_id is larger than any other, and among null ids nothing is removed.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.slots import maybe, slots, within
from pulsegrid.llm.words import U, Words, combine, mix, sequence_hashes, sliding_min, text_bytes
from pulsegrid.session import checkpointed

WIDTH, GRAM = 50, 12
MOST_STRETCHES = 2048
KEY = ["_id", "_text"]
LAST = 2 ** 63 - 1            # stands for a null id


class Stretches:
    """Runs of windows of one row with one seed."""

    def __init__(self, column: pa.Array, width: int, gram: int):
        self.words = Words(*text_bytes(column))
        self.hashes = self.words.hashes()
        grams = sequence_hashes(self.hashes, gram)
        place_bits = U(max(1, int(len(grams)).bit_length()))
        marked = (grams >> place_bits << place_bits) | np.arange(len(grams), dtype=np.uint64)      # ties: the leftmost
        best = sliding_min(marked, width - gram + 1) if len(grams) >= width - gram + 1 else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.words.row[:len(best)] == self.words.row[width - 1:]) if len(best) else np.zeros(0, np.int64)
        place = (best[at] & ((U(1) << place_bits) - U(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.start, self.count = at[first], np.diff(np.append(first, len(at)))
        self.place = place[first]
        self.seed = grams[self.place] if len(first) else np.zeros(0, np.uint64)
        self.row = self.words.row[self.start]
        self.width, self.gram = width, gram

    def contents(self) -> np.ndarray:
        """Hash of all words of each stretch, from sums of hashes that depend on the place in the stretch."""
        length = self.count + self.width - 1
        begin = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(begin, length)
        word = self.hashes[np.repeat(self.start, length) + inside]
        return mix(np.add.reduceat(mix(word + mix(inside.astype(np.uint64) + U(77))), begin) + length.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)

    def keys(self, some: np.ndarray) -> np.ndarray:
        """Keys of every window of the stretches ``some``: words left of the seed and right of it, extended word by word."""
        count = self.count[some]
        which = np.repeat(some, count)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        left = self.place[which] - (self.start[which] + nth)               # words of the window before the seed
        right = self.width - self.gram - left
        l_hash, r_hash = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
        for step in range(1, self.width - self.gram + 1):
            more = np.flatnonzero(left >= step)
            l_hash[more] = combine(l_hash[more], self.hashes[self.place[which[more]] - step])
            more = np.flatnonzero(right >= step)
            r_hash[more] = combine(r_hash[more], self.hashes[self.place[which[more]] + self.gram - 1 + step])
        return combine(combine(l_hash, r_hash), left.astype(np.uint64))


def seed_counts(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batch):
        seed, n = np.unique(Stretches(batch.column("text"), width, gram).seed, return_counts=True)
        return {"_seed": seed, "_n": n}

    return map_text(docs.select("text"), run, "_seed long, _n long").groupBy("_seed").agg(F.sum("_n").alias("_n"))


def stretches(docs: DataFrame, repeated, width: int, gram: int) -> DataFrame:
    """Stretches whose seed may occur again: document, first window, number of windows, seed, content hash."""
    def run(batch):
        s = Stretches(batch.column("text"), width, gram)
        some = np.flatnonzero(within(repeated, s.seed)) if len(s.seed) else np.zeros(0, np.int64)
        content = s.contents()[some]
        return {"_id": batch.column("_id").take(pa.array(s.row[some])), "_text": batch.column("_text").take(pa.array(s.row[some])),
                "_at": s.start[some] - s.words.first[s.row[some]], "_windows": s.count[some], "_seed": s.seed[some], "_content": content}

    return map_text(keyed(docs), run, "_id long, _text long, _at int, _windows int, _seed long, _content long")


def extended(docs: DataFrame, chosen, width: int, gram: int) -> DataFrame:
    """The chosen (seed, content, id): that id and the keys of the stretch's windows, 8 bytes each. The bit map may let later copies
    through, with larger ids, but never keeps the first document back: of each (seed, content) the caller takes the smallest id."""
    def run(batch):
        s = Stretches(batch.column("text"), width, gram)
        content, ids = s.contents(), batch.column("_id").fill_null(LAST).to_numpy()[s.row]
        some = np.flatnonzero(within(chosen, triple(s.seed, content, ids))) if len(s.seed) else np.zeros(0, np.int64)
        some = some[np.unique(triple(s.seed[some], content[some], ids[some]), return_index=True)[1]]
        key = s.keys(some)
        cut = np.concatenate([[0], np.cumsum(s.count[some])]).astype(np.int32) * 8
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(key.tobytes())])
        return {"_seed": s.seed[some], "_content": content[some], "_keys": packed, "_least": ids[some]}

    return map_text(keyed(docs).select("_id", "text"), run, "_seed long, _content long, _keys binary, _least long")


def triple(seed: np.ndarray, content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return combine(combine(seed, content), ids.view(np.uint64))


def triple_of(*columns: str):
    @F.pandas_udf("long")
    def hashed(seed: pd.Series, content: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(triple(*(x.to_numpy(np.int64).view(np.uint64) for x in (seed, content)), ids.to_numpy(np.int64)).view(np.int64))

    return hashed(*columns)


MATCHES = "_seed long, _content long, _runs array<struct<at:int,n:int>>"


def matched_runs(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Of some seeds' stretches: maximal runs of windows whose key a stretch with a smaller id has, as first window and words."""
    # A document may hold a stretch twice, or stand twice; a later copy is a wrong yes of the bit map.
    rows = rows.sort_values("_least").drop_duplicates(["_seed", "_content"])
    count = np.array([len(k) // 8 for k in rows["_keys"]])
    which = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    key, least = np.frombuffer(b"".join(rows["_keys"]), np.uint64), rows["_least"].to_numpy()[which]
    seed = rows["_seed"].to_numpy()[which]
    order = np.lexsort((least, key, seed))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (seed[order[1:]] != seed[order[:-1]])
    smallest = np.empty(len(order), np.int64)
    smallest[order] = least[order[new]][np.cumsum(new) - 1]
    hit = np.flatnonzero(smallest < least)
    begin = np.ones(len(hit), bool)
    begin[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])
    first = np.flatnonzero(begin)
    runs: dict[int, list] = {}
    for w, a, n in zip(which[hit[first]].tolist(), nth[hit[first]].tolist(), np.diff(np.append(first, len(hit))).tolist()):
        runs.setdefault(w, []).append({"at": a, "n": n - 1 + width})
    some = np.array(list(runs), np.int64)
    return pd.DataFrame({"_seed": rows["_seed"].to_numpy()[some], "_content": rows["_content"].to_numpy()[some], "_runs": pd.Series(list(runs.values()), dtype=object)})


def matches(docs: DataFrame, contents: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """Runs of matching windows for every stretch whose seed has others. Seeds go to tasks whole, many to a group; a seed with more than
    ``most`` different stretches has its windows aggregated one by one instead, with partial sums."""
    sizes = checkpointed(contents.groupBy("_seed").agg(F.count("*").alias("_k")).where("_k > 1"))
    chosen = contents.join(sizes, "_seed", "left_semi").select(triple_of("_seed", "_content", "_least").alias("_chosen"))
    rows = extended(docs, slots(chosen, "_chosen"), width, gram)
    crowded = checkpointed(sizes.where(F.col("_k") > most).select("_seed"))
    groups = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = rows.join(crowded, "_seed", "left_anti").groupBy(F.pmod(F.xxhash64("_seed"), F.lit(groups)).alias("_group")).applyInPandas(lambda g: matched_runs(g, width), MATCHES)
    if crowded.isEmpty():
        return usual

    @F.pandas_udf("array<long>")
    def unpacked(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: np.frombuffer(k, np.int64))

    own = rows.join(crowded, "_seed", "left_semi").groupBy("_seed", "_content").agg(F.min("_least").alias("_least"), F.min_by("_keys", "_least").alias("_keys"))
    each = own.select("_seed", "_content", "_least", F.posexplode(unpacked("_keys")).alias("_nth", "_key"))
    least = each.groupBy("_seed", "_key").agg(F.min("_least").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    hits = each.join(least, ["_seed", "_key"]).where("_first < _least")
    rare = hits.groupBy("_seed", "_content").agg(F.collect_set(F.struct(F.col("_nth").alias("at"), F.lit(width).alias("n"))).alias("_runs"))
    return usual.union(rare)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")


def removable(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST_STRETCHES) -> DataFrame:
    """Per document that loses words: ``_spans``, an array of (first word, words), each a run of windows that a smaller doc_id holds."""
    counts = seed_counts(docs, width, gram)
    found = checkpointed(stretches(docs, slots(counts.where("_n > 1"), "_seed"), width, gram))
    contents = checkpointed(found.groupBy("_seed", "_content").agg(F.min(F.coalesce("_id", F.lit(LAST))).alias("_least"), F.count("*").alias("_copies")))
    matched = checkpointed(matches(docs, contents, width, gram, most))
    # All of a stretch goes where a smaller document has it too; in its first document go the windows whose key a smaller one has.
    decided = contents.join(matched, ["_seed", "_content"], "left").where("_copies > 1 or _runs is not null").select("_seed", "_content", "_least", "_runs")
    hits = found.join(checkpointed(decided), ["_seed", "_content"])
    later = F.coalesce("_id", F.lit(LAST)) > F.col("_least")
    whole = F.array(F.struct(F.lit(0).alias("at"), (F.col("_windows") + (width - 1)).alias("n")))
    spans = hits.select(*KEY, "_at", F.explode(F.when(later, whole).otherwise(F.col("_runs"))).alias("r"))
    spans = spans.select(*KEY, (F.col("_at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("_spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) with their spans (null: none). Only texts that may have spans are shuffled."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    marked = d.withColumn("_maybe", maybe(slots(spans.select(F.xxhash64(*KEY).alias("_row")), "_row", 24), F.xxhash64("doc_id", "_text")))
    some = marked.where("_maybe").join(spans.withColumnRenamed("_text", "_t"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left")
    return some.select("doc_id", "text", "_spans").union(marked.where(~F.col("_maybe")).select("doc_id", "text", F.lit(None).cast(spans.schema["_spans"].dataType)))


def covered(spans: pa.Array, row: int, size: int) -> np.ndarray:
    """Marks of the positions that a row's spans (at, n) cover."""
    mark = np.zeros(size + 1, np.int64)
    values = spans[row].values
    at, n = (values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    return np.cumsum(mark[:-1]) > 0


def dedup_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST_STRETCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept words of every document."""
    both = with_spans(docs, checkpointed(removable(docs, width, gram, most)))

    def run(batch):
        n, gone, kept, spans = [], [], [], batch.column("_spans")
        for k, text in enumerate(batch.column("text").to_pylist()):
            words = (text or "").encode().split()                     # the same blanks as everywhere here
            n.append(len(words))
            if spans[k].is_valid:
                mark = covered(spans, k, len(words))
                words = [w for w, m in zip(words, mark.tolist()) if not m]
            gone.append(n[-1] - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": gone, "kept_sha256": kept}

    return map_text(both, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query("op9_seed_extend", oracle="""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select doc_id, unnest(range(0, greatest(len(w) - 49, 0))) as i, w from d),
    h as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as win from s),
    m as (select win, min(doc_id) as least from h group by win having count(*) > 1),
    hit as (select doc_id, i from h join m using (win) where least < doc_id),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from hit),
    word as (select doc_id, unnest(w) as x, unnest(range(0, len(w))) as j from d),
    kept as (select doc_id, string_agg(x, ' ' order by j) as text, count(*) as n from word anti join gone using (doc_id, j) group by 1)
    select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from d left join kept using (doc_id)""")
def op9(spark, sf_dir):
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
