import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _row string, _key long, size string, n_removed string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use themselves."""
    def documents(pairs, source=lambda k: f"s{k % 3}" if k % 7 else None, parts=3):
        rows = [(i, t, ("en", "de", None)[k % 3], source(k), None if t is None else len(t), k, "x", "y", -k, "z", "w") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return documents


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, blank and very long texts, ties and repeated rows, wide characters."""
    long = " ".join(f"w{k * k % 9973}" for k in range(40_000))
    passage = " ".join(f"passage{k}" for k in range(90))
    return [(0, None), (1, ""), (2, "  \t\n "), (None, "a null id has a text"), (None, "a null id has a text"), (3, "one"), (4, "One"),
            (5, "two words"), (6, passage), (7, "before " + passage + " after"), (8, passage), (8, passage), (9, long), (10, "x " * 300),
            (11, "日本語 𝒳 ü " * 60), (12, "= " * 3 + "=" * 700), (13, "line\n" * 40), (14, "a\nb\nc\nd"), (15, "z\na\nb\nc\nd"), (16, None)]
