"""Operator 6: repeated windows of three consecutive lines, with DataFrame functions only.

Every run of three lines of a document is hashed (two 64-bit hashes). A window that starts more than once in the corpus keeps its
first start in the order of doc_id, then text hash, then line; each later start covers its three lines, and a document loses the
lines that any of its windows covers. Windows are judged on the input, not on what is left.

Defined cases: a null text stays null, an empty text is one empty line; documents of fewer than three lines are never changed; rows
equal in doc_id and text are one document, so repeats of a row keep what the row keeps; a null doc_id sorts first. Other columns
pass through, whatever their names.

The shuffles carry hashes and line numbers; a text moves once, to meet its document's covered lines. The count per window combines
before its shuffle; repeated windows are written, so that their join back is one of two shuffled tables that Spark splits where a window is frequent.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.registry import query, table
from pulsegrid.session import checkpointed

WINDOW = 3


def line_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per window: document (``_id``, ``_text``: hash of the text), first line ``_at``, window hashes."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("_lines"))
    lines = lines.where(F.size("_lines") >= width)
    at = F.sequence(F.lit(0), F.size("_lines") - width)

    def hashed(i):
        run = [F.get("_lines", i + k) for k in range(width)]
        return F.struct(i.alias("_at"), F.xxhash64(*run).alias("_h1"), F.xxhash64(F.lit(width), *reversed(run)).alias("_h2"))

    return lines.select("_id", "_text", F.explode(F.transform(at, hashed)).alias("w")).select("_id", "_text", "w.*")


def covered_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document that loses lines: ``_gone``, the line numbers, each once."""
    windows = line_windows(docs, width)
    repeated = (windows.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_text", "_at")).alias("_first"))
                .where("_n > 1").select("_h1", "_h2", "_first"))
    later = windows.join(checkpointed(repeated), ["_h1", "_h2"]).where(~F.struct("_id", "_text", "_at").eqNullSafe(F.col("_first")))
    spans = later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_starts"))
    return spans.select("_id", "_text", F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.sequence(i, i + width - 1)))).alias("_gone"))


def dedup_lines(docs: DataFrame, width: int = WINDOW, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the lines of later repeated windows cut from ``text``, and two counts, which replace columns of their names."""
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    d = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.xxhash64("text").alias("_key"))       # packed: names cannot clash
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))
    both = d.join(covered_lines(docs.select("doc_id", "text"), width), same, "left")
    lines = F.split("_row.text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in names],
                       F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(lines)).alias(n_lines), F.coalesce(F.size("_gone"), F.lit(0)).alias(n_removed))


@query("op6_line_windows", oracle="""
    with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
    w as (select doc_id, lines, unnest(range(0, len(lines) - 2)) as i from l where len(lines) >= 3),
    h as (select doc_id, i, [lines[i + 1], lines[i + 2], lines[i + 3]] as win from w),
    r as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as nth from h),
    gone as (select distinct doc_id, unnest([i, i + 1, i + 2]) as j from r where nth > 1),
    numbered as (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as j from l),
    kept as (select n.doc_id, string_agg(line, chr(10) order by n.j) as text from numbered n anti join gone g on n.doc_id = g.doc_id and n.j = g.j group by 1),
    cut as (select doc_id, count(*) as n from gone group by 1)
    select l.doc_id, coalesce(kept.text, '') as text, len(l.lines) as n_lines, coalesce(cut.n, 0) as n_removed
    from l left join kept using (doc_id) left join cut using (doc_id)""")
def op6(spark, sf_dir):
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))
