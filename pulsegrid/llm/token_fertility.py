"""Operator 1: quality rules from tokeniser fertility.

Public vocabularies measure each whole text: characters per token, share of tokens that are byte fallbacks, entropy of the
tokens. A document goes if a measure leaves the band of its language (its script where the language is null) and length class. A band
is fitted on all documents: ``REACH`` deviations around the median, the deviation told by the median distance from it, so that
neither a tail of junk nor its size moves the band much. A class of fewer than ``LEAST_GROUP`` documents takes in the nearest classes of
the same language until there are as many, or all of that language: never another language, and never no band. What it takes in is
moved along the language's trend by class. Longer texts vary less, so their distances count for more in a class of shorter ones; the band
of fewer documents is wider as their median is less sure.

Defined cases: a null or empty text has no words and no measures (null) and fails the base rules; texts of fewer than
``LEAST_TOKENS`` tokens are judged by the base rules alone; repeated rows are judged alike; other columns are not read.
"""
from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.arrow import map_text, rows_of
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.words import Words, mix, sequence_hashes, text_bytes
from pulsegrid.session import checkpointed

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANKS = " \t\n\x0b\x0c\r"
REPEAT_WINDOW = 5
LEAST_TOKENS, LEAST_GROUP = 64, 100
MOST_SHARED = 100_000       # rows of medians that are broadcast; more are joined by shuffle
REACH = 5.0                 # half of a band, in standard deviations as the median distance tells them
MEASURES = {"chars_per_token": 0.005, "chars_per_token_multi": 0.005, "token_entropy": 0.005, "byte_share": 0.01}       # least deviation
# First byte of a UTF-8 character to script, as (first, last, script).
SCRIPTS = [(0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD4, "cyrillic"),
           (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xE0, 0xE0, "indic"), (0xE3, 0xE9, "han"), (0xEA, 0xED, "hangul")]
NAMES = ["none", *dict.fromkeys(s for _, _, s in SCRIPTS)]
SCRIPT_OF = np.zeros(256, np.int64)
for _first, _last, _script in SCRIPTS:
    SCRIPT_OF[_first:_last + 1] = NAMES.index(_script)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_window_words(words: Words, hashes: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per row: words inside windows of ``width`` words that the same row holds twice or more."""
    n = len(hashes) - width + 1
    cover = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        at = np.flatnonzero(words.row[:n] == words.row[width - 1:])
        key = mix(sequence_hashes(hashes, width)[at] ^ mix(words.row[at].astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        starts = at[count[which] > 1]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + width, -1)
    return per_row(np.cumsum(cover[:-1]) > 0, words.first)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=2)
def byte_vocabulary(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def piece_vocabulary(path: str):
    """The library's encoder, which ids are byte fallbacks, and which of those is the line end."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return own, np.array([own.is_byte(i) for i in range(own.get_piece_size())]), own.piece_to_id("<0x0A>")


def entropies(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per row the entropy of its ids over that of as many different ones (no ids: 0); ``n`` ids a row, one row after the other."""
    rows = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(rows << 32 | ids, return_counts=True)
    row = key >> 32
    share = count / n[row]
    return np.bincount(row, -share * np.log2(share), len(n)) / np.log2(np.maximum(n, 2))


MEASURED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, "
            "chars_per_token double, chars_per_token_multi double, byte_share double, token_entropy double")


def measure(docs: DataFrame, pieces_path: str = PIECES, bytes_path: str = BYTES, group: str | None = "lang") -> DataFrame:
    """One row per document: ids, base counts and token measures. The text is read once and leaves no task."""
    docs = docs.select("doc_id", (F.col(group) if group else F.lit(None)).cast("string").alias("band_group"), "text")

    def run(batch):
        texts, (data, offsets) = rows_of(batch), text_bytes(batch.column("text"))
        words = Words(data, offsets)
        inside = per_row((data & 0xC0) != 0x80, np.arange(len(data) + 1)) if len(data) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(inside)])
        chars = total[words.ends] - total[words.starts]
        by_word = np.concatenate([[0], np.cumsum(chars)])
        all_chars = total[offsets[1:]] - total[offsets[:-1]]
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        scripts = np.bincount(rows * len(NAMES) + SCRIPT_OF[data], minlength=len(texts) * len(NAMES)).reshape(-1, len(NAMES))
        scripts[:, 0] = 0
        own, is_byte, newline = piece_vocabulary(pieces_path)
        encoded = own.encode(texts, num_threads=1)
        n = np.array([len(x) for x in encoded], np.int64)
        ids = np.fromiter(chain.from_iterable(encoded), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])
        share = per_row(is_byte[ids] & (ids != newline), ends) / np.maximum(n, 1)           # line ends have no piece in any text
        entropy = entropies(ids, n)
        other = byte_vocabulary(bytes_path).encode_ordinary
        multi = np.array([len(other(t)) for t in texts], np.int64)
        known = n > 0
        return {"doc_id": batch.column("doc_id"), "band_group": batch.column("band_group"),
                "n_words": np.diff(words.first), "word_chars": by_word[words.first[1:]] - by_word[words.first[:-1]],
                "n_symbols": per_row(SYMBOLS[data], offsets), "n_dup_lines": [duplicate_lines(t) for t in texts],
                "n_repeat_words": repeated_window_words(words, words.hashes()), "script": [NAMES[i] for i in scripts.argmax(axis=1)],
                "n_tokens": n, "chars_per_token": pa.array(all_chars / np.maximum(n, 1), mask=~known),
                "chars_per_token_multi": pa.array(all_chars / np.maximum(multi, 1), mask=multi == 0),
                "byte_share": pa.array(share, mask=~known), "token_entropy": pa.array(entropy, mask=~known)}

    return map_text(docs, run, "doc_id long, band_group string, " + MEASURED).withColumn("band_group", F.coalesce("band_group", "script"))


def length_class():
    """Texts of like length vary alike: the class is the whole part of the binary logarithm of the tokens (null: too short for a band)."""
    return F.when(F.col("n_tokens") >= LEAST_TOKENS, F.floor(F.log2("n_tokens"))).alias("_class")


def near_classes(rows: DataFrame) -> DataFrame:
    """Per group and class the classes its band is fitted on (``_class`` for ``_for``), of the same group: all whose nearer ones hold fewer
    than ``LEAST_GROUP`` documents. ``_n``: documents of the band. A group has at most some tens of classes."""
    sizes = checkpointed(rows.groupBy("band_group", "_class").agg(F.count("*").alias("_rows")))
    pairs = sizes.select("band_group", F.col("_class").alias("_for")).join(sizes, "band_group")
    pairs = pairs.withColumn("_apart", F.abs(F.col("_class") - F.col("_for")))
    nearer = Window.partitionBy("band_group", "_for").orderBy("_apart").rangeBetween(Window.unboundedPreceding, -1)
    taken = pairs.withColumn("_nearer", F.coalesce(F.sum("_rows").over(nearer), F.lit(0))).where(F.col("_nearer") < LEAST_GROUP)
    return taken.select("band_group", "_class", "_for", F.sum("_rows").over(Window.partitionBy("band_group", "_for")).alias("_n"))


def trends(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Per group the change of each measure from one class to the next, fitted on what lies inside ``bands``."""
    d = rows.join(bands, ["band_group", "_class"])
    inside = {m: F.when(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.col(m)) for m in MEASURES}
    return d.groupBy("band_group").agg(*[F.coalesce(F.regr_slope(x, F.col("_class")), F.lit(0.0)).alias(f"{m}_trend") for m, x in inside.items()])


def fit_bands(measured: DataFrame) -> DataFrame:
    """Bands per group and class: a first fit tells what the trends are fitted on, the second follows them."""
    rows = measured.where(F.col("_class").isNotNull()).select("band_group", "_class", *MEASURES)
    near = checkpointed(near_classes(rows))
    level = near.select("band_group").distinct().select("band_group", *[F.lit(0.0).alias(f"{m}_trend") for m in MEASURES])
    found = checkpointed(trends(rows, checkpointed(spread(rows, near, level))))
    return checkpointed(spread(rows, near, found))


def spread(rows: DataFrame, near: DataFrame, trend: DataFrame) -> DataFrame:
    """Low and high of each measure per group and class: median and median distance from it, from sketches that merge per partition, or
    exactly where the documents are few."""
    few, by = F.col("_n") < LEAST_GROUP, ["band_group", "_for", "_n"]
    moved = [(F.col(m) + F.col(f"{m}_trend") * (F.col("_for") - F.col("_class"))).alias(m) for m in MEASURES]
    rows = rows.join(near.join(trend, "band_group"), ["band_group", "_class"]).select("band_group", "_class", "_for", "_n", *moved)

    def middle(value):
        return F.coalesce(F.percentile(F.when(few, value), 0.5), F.percentile_approx(F.when(~few, value), 0.5, 10_000))

    mids = checkpointed(rows.groupBy(*by).agg(*[middle(F.col(m)).alias(f"{m}_mid") for m in MEASURES]))
    if mids.count() <= MOST_SHARED:                                     # one row per group and class: no shuffle of the documents to meet them
        mids = F.broadcast(mids)
    shorter = F.pow(F.lit(2.0), F.greatest(F.col("_class") - F.col("_for"), F.lit(0)) / 2)          # deviations fall with the root of the tokens
    away = rows.join(mids, by).groupBy(*by, *[f"{m}_mid" for m in MEASURES]).agg(
        *[middle(F.abs(F.col(m) - F.col(f"{m}_mid")) * shorter).alias(f"{m}_away") for m in MEASURES])
    unsure = F.sqrt(LEAST_GROUP / F.least("_n", F.lit(LEAST_GROUP)))
    reach = {m: REACH * unsure * F.greatest(1.4826 * F.col(f"{m}_away"), F.lit(least)) for m, least in MEASURES.items()}
    return away.select("band_group", F.col("_for").alias("_class"),
                       *[c for m in MEASURES for c in ((F.col(f"{m}_mid") - reach[m]).alias(f"{m}_low"), (F.col(f"{m}_mid") + reach[m]).alias(f"{m}_high"))])


def judge(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """Base rules, then the bands; ``reject`` names the first measure outside its band."""
    d = measured.join(bands, ["band_group", "_class"], "left")
    reject = F.lit(None).cast("string")
    for m in reversed(list(MEASURES)):
        reject = F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)).otherwise(reject)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (d.withColumn("base_failed", failed).withColumn("reject", F.when(failed, F.lit("base")).otherwise(reject))
            .withColumn("kept", F.col("reject").isNull()).drop("_class", *[f"{m}_{side}" for m in MEASURES for side in ("low", "high")]))


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """Measures and verdict per document. The measures are written once, as fitting and judging both read them."""
    measured = checkpointed(measure(docs, **parameters).withColumn("_class", length_class()))
    return judge(measured, fit_bands(measured))


@query("op1_token_fertility")
def op1(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band_group", "n_tokens",
        "chars_per_token", "chars_per_token_multi", "byte_share", "token_entropy", "reject")
