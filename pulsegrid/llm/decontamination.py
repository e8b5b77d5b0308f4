"""Operator 11: benchmark passages in documents, by a generalised suffix automaton of the normalised test items.

Both sides are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII. The distinct items of a block go into one
automaton; a document's words stream through it, and at every word the state and the matched length name the longest passage of any item
that ends there. An item is leaked where a matched passage reaches ``length`` words or the share ``coverage`` of the item's words.

Only words that stand next to each other in some item can continue a match, so a run is streamed where every adjacent pair occurs in the items;
what lies outside cannot hold a passage. Words of a run are compared by their bytes, never by hash alone.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.words import LOWER, Words, text_bytes
from pulsegrid.session import checkpointed

BLOCK_BYTES = 4 << 20        # item text of one automaton: what the driver holds and broadcasts at once
BLOCKS_A_JOB = 4             # automata that one job streams its documents through, one after the other

#: Bytes after lower-casing: 0-9, a-z and all beyond ASCII are kept, the rest parts words.
NORMAL = LOWER.copy()
NORMAL[[b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20

LEAKS = T.StructType([T.StructField("n_words", T.LongType()),
                      T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "begin", "end")]))),
                      T.StructField("items", T.ArrayType(T.StringType()))])


def normal_words(column: pa.Array) -> Words:
    """Words of a text column; their byte positions are those of the text itself."""
    data, offsets = text_bytes(column)
    return Words(NORMAL[data], offsets)


class Automaton:
    """Suffix automaton of several word sequences. ``marks[state]``: (least length, class) of the items whose windows end in the state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: Iterable[int]) -> None:
        at = 0
        for w in words:
            at = self._extend(at, w)

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, w: int, whole: int) -> int:
        """The passages of ``whole`` of at most length(at) + 1 words become a state of their own."""
        part = self._state(self.length[at] + 1, dict(self.next[whole]), self.link[whole])
        self.link[whole] = part
        while at >= 0 and self.next[at].get(w) == whole:
            self.next[at][w] = part
            at = self.link[at]
        return part

    def _extend(self, at: int, w: int) -> int:
        known = self.next[at].get(w)
        if known is not None:
            return known if self.length[known] == self.length[at] + 1 else self._split(at, w, known)
        new = self._state(self.length[at] + 1, {}, 0)
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][w]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, w, known)
        return new

    def mark(self, items: list[tuple[list[int], int]]) -> None:
        """``items``: word sequences and the lengths from which a passage of them counts."""
        self.marks: list[list] = [[] for _ in self.next]
        for number, (words, least) in enumerate(items):
            at = have = 0
            for w in words:
                at, have = self.next[at][w], have + 1
                while self.length[self.link[at]] >= least:
                    at, have = self.link[at], self.length[self.link[at]]
                if have >= least and (not self.marks[at] or self.marks[at][-1][1] != number):
                    self.marks[at].append((least, number))
        self.above = [0] * len(self.next)                               # longest counting window among a state and the ones it links to
        self.marked = [0] * len(self.next)                              # the next state up the links, itself first, that has marks
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.above[s] = max(self.above[up], max((k for k, _ in self.marks[s]), default=0))
            self.marked[s] = s if self.marks[s] else self.marked[up]

    def stream(self, words: list[int], found: set[int]) -> list[tuple[int, int]]:
        """Covered intervals (first, past the last) of a run, merged; classes of the items are added to ``found``."""
        at = matched = 0
        out: list[tuple[int, int]] = []
        done: set[int] = set()
        follow, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while at and w not in follow[at]:
                at = link[at]
                matched = length[at]
            if w not in follow[at]:
                continue
            at, matched = follow[at][w], matched + 1
            reach = self.above[link[at]]
            for least, number in self.marks[at]:
                if least <= matched:
                    reach = max(reach, least)
                    found.add(number)
            up = self.marked[link[at]]
            while up and up not in done:                                # shorter passages that end here too
                done.add(up)
                found.update(number for _, number in self.marks[up])
                up = self.marked[link[up]]
            if reach:
                begin = i + 1 - reach
                if out and begin <= out[-1][1]:
                    begin = min(begin, out.pop()[0])
                    while out and begin <= out[-1][1]:
                        begin = min(begin, out.pop()[0])
                out.append((begin, i + 1))
        return out


class Items:
    """The test items of one block, ready to stream documents through."""

    def __init__(self, classes: dict[tuple[bytes, ...], list[str]], length: int, coverage: float):
        self.ids = list(classes.values())
        self.word = sorted({w for c in classes for w in c})
        number = {w: k for k, w in enumerate(self.word)}
        rows = [[number[w] for w in c] for c in classes]
        least = [max(1, min(length, math.ceil(coverage * len(r)))) for r in rows]
        self.least = min(least, default=1)
        self.automaton = Automaton()
        for r in rows:
            self.automaton.add(r)
        self.automaton.mark(list(zip(rows, least)))
        spelled = pa.array([w.decode() for w in self.word], pa.string())
        hashes = normal_words(spelled).hashes() if self.word else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of_hash = hashes[order], order
        self.pairs = np.unique(np.array([a * len(self.word) + b for r in rows for a, b in zip(r, r[1:])], np.int64))

    def numbers(self, words: Words) -> np.ndarray:
        """Vocabulary number of each word, -1 for words of no item."""
        if not self.word or not len(words.starts):
            return np.full(len(words.starts), -1)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.of_hash[at], -1)

    def runs(self, words: Words) -> list[tuple[int, int]]:
        """Intervals of words of one row in which all adjacent pairs occur in the items and which are long enough for a window."""
        n = self.numbers(words)
        known = n >= 0
        joined = np.zeros(len(n) + 1, bool)                             # joined[i]: word i goes on from word i - 1
        if len(n) > 1 and len(self.pairs):
            near = np.flatnonzero(known[1:] & known[:-1] & (words.row[1:] == words.row[:-1])) + 1
            pair = n[near - 1] * len(self.word) + n[near]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[near[self.pairs[at] == pair]] = True
        begins = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - begins >= self.least
        return [(b, n[b:e].tolist()) for b, e in zip(begins[long].tolist(), ends[long].tolist())]

    def search(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By row: covered intervals of word places (over all rows) and ids of the leaked items."""
        out: dict[int, tuple[list, set]] = {}
        spelled = words.data
        for begin, run in self.runs(words):
            run = [k if spelled[words.starts[begin + i]:words.ends[begin + i]].tobytes() == self.word[k] else -1 for i, k in enumerate(run)]
            found: set[int] = set()
            spans = self.automaton.stream(run, found)
            if spans:
                have = out.setdefault(int(words.row[begin]), ([], set()))
                have[0].extend((begin + a, begin + b) for a, b in spans)
                have[1].update(i for k in found for i in self.ids[k])
        return out


def item_blocks(items: DataFrame, length: int = 10, coverage: float = 1.0, item: str = "item_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of about ``block_bytes`` of item text: its automaton, built in a task. Equal texts share a block and a class."""
    plain = items.select(F.col(item).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        classes: dict[tuple[bytes, ...], set] = {}
        got = normal_words(pa.array(rows["text"], pa.large_string()))
        for r, name in enumerate(rows["id"]):
            spell = tuple(got.data[s:e].tobytes() for s, e in zip(got.starts[got.first[r]:got.first[r + 1]], got.ends[got.first[r]:got.first[r + 1]]))
            if spell:
                classes.setdefault(spell, set()).update([] if name is None else [name])
        return pd.DataFrame({"payload": [pickle.dumps(Items({c: sorted(i) for c, i in classes.items()}, length, coverage))]})

    dealt = plain.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    return checkpointed(dealt.groupBy("block").applyInPandas(lambda rows: build(rows[["id", "text"]]), "payload binary"))


def _through(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """Adds what the items of one block find to the column ``leaks``."""
    def run(batch: pa.RecordBatch) -> dict:
        items: Items = shared.value
        column = batch.column(text)
        words = normal_words(column)
        found = items.search(words)
        leaks = batch.column("leaks").to_pylist()
        first, n = words.first.tolist(), np.diff(words.first).tolist()
        base = words.offsets.tolist()
        for r, have in enumerate(leaks):
            have["n_words"] = n[r]
            if r in found:
                spans = [(s["first"] + first[r], s["last"] + 1 + first[r]) for s in have["spans"]] + found[r][0]
                have["spans"] = [{"first": a - first[r], "last": b - 1 - first[r], "begin": int(words.starts[a]) - base[r], "end": int(words.ends[b - 1]) - base[r]}
                                 for a, b in merged(spans)]
                have["items"] = sorted({*have["items"], *found[r][1]})
        return dict(zip(batch.schema.names, batch.columns)) | {"leaks": leaks}

    return map_text(docs, run, docs.schema, text)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals; ones that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def leaks(docs: DataFrame, items: DataFrame, length: int = 10, coverage: float = 1.0, text: str = "text", item: str = "item_id",
          item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``leaks`` (one of that name is replaced): number of words, covered spans (first and last word, begin and
    end byte), ids of the leaked items as sorted strings.

    Each row stands alone, so ties, repeated rows and extra columns of any name pass through; a null or empty text, or one without words,
    has no leaks. Items without words leak nowhere; a null item id covers words but is not listed; without items nothing is covered. No
    shuffle. Benchmarks beyond ``block_bytes`` of text make several automata, each broadcast by itself; every few of them a job ends
    with a written table, so memory does not grow with the benchmark.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "leaks"]
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(LEAKS["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
    out = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"), empty.alias("leaks"))
    out = spark.createDataFrame([], out.schema).union(out)              # all fields nullable, as Arrow hands them back
    blocks = item_blocks(items, length, coverage, item, item_text, block_bytes)
    n_blocks = blocks.count()
    if not n_blocks:
        return _through(out, spark.sparkContext.broadcast(Items({}, length, coverage)), "text").select("row.*", "leaks")
    for k, row in enumerate(blocks.toLocalIterator()):                  # one automaton at a time on the driver
        out = _through(out, spark.sparkContext.broadcast(pickle.loads(row["payload"])), "text")
        if (k + 1) % BLOCKS_A_JOB == 0 and k + 1 < n_blocks:
            out = checkpointed(out)
    return out.select("row.*", "leaks")


def decontaminate(docs: DataFrame, items: DataFrame, most_covered: float = 0.5, text: str = "text", **options) -> DataFrame:
    """Documents with covered spans cut from ``text``; one whose words are covered beyond the share ``most_covered`` is dropped. A null text stays null."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, cuts):
            if t is None or not len(cuts):
                return t
            raw, at, parts = t.encode(), 0, []
            for s in cuts:
                parts.append(raw[at:s["begin"]])
                at = s["end"]
            return b"".join([*parts, raw[at:]]).decode()
        return pd.Series([one(t, c) for t, c in zip(texts, spans)], dtype=object)

    found = leaks(docs, items, text=text, **options)
    covered = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    kept = found.where(covered <= F.lit(most_covered) * F.col("leaks.n_words"))
    return kept.withColumn(text, cut(F.col(text), F.col("leaks.spans"))).drop("leaks")


@query("op11_suffix_automaton", r"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
                        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                 FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
             FROM benchmark),
    win AS (SELECT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS s
            FROM item WHERE len(w) > 0),
    place AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM doc, (SELECT DISTINCT k FROM win)),
    hit AS (SELECT p.r, p.i, p.k, win.item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM place) p JOIN win USING (k, s)),
    covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
    named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM doc LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)""")
def op11(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", F.col("leaks.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leaks.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "leaks.items"), 256).alias("items_sha256"), (F.size("leaks.spans") > 0).alias("contaminated"))
