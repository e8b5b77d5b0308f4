"""Operators 5, 6, 8 and 9 against plain versions, with small windows so that small texts hold many repeats."""
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import brute
from pulsegrid.llm import byte_repeats, near, seeds, suffixes
from pulsegrid.llm.line_dedup import dedup_lines


def texts(seed, n, letters, size, joint=" "):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = joint.join(r.choice(letters) for _ in range(r.randint(0, size)))
        if out and r.random() < 0.5:                                       # a copied stretch, or a whole copy
            o = r.choice(out)
            a = r.randint(0, max(len(o) - 1, 0))
            t = o if r.random() < 0.3 else t + joint + o[a:a + r.randint(0, 120)]
        out.append(t)
    return out


@pytest.mark.parametrize("bound", [1, 64])
def test_suffix_array_and_common_prefixes(monkeypatch, bound):
    monkeypatch.setattr(suffixes, "LEAST_BUCKET", bound)
    r = np.random.default_rng(3)
    for k in range(400):
        t = np.append(np.tile(r.integers(1, 3, r.integers(1, 6)), 9) if k % 4 == 0 else r.integers(1, r.integers(2, 6), r.integers(0, 50)), 0)
        order, plain = suffixes.suffix_array(t), t.tolist()
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        prefix = suffixes.common_prefixes(t, order)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while plain[a + n] == plain[b + n]:
                n += 1
            assert prefix[b] == n


@pytest.mark.parametrize("most", [512, 2])
def test_bytes(spark, make, odd, most):
    """Also with every anchor dealt over several shards (most=2)."""
    docs = [*odd, *((100 + k, t) for k, t in enumerate(texts(1, 60, ["ab", "b", "ü", "aaaa"], 60)))]
    got = byte_repeats.dedup_bytes(make(docs), 20, 8, shard_bytes=2000, most=most).drop("doc_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute.bytes_removed([t for _, t in docs], 20))


def test_windows_of_a_dealt_anchor_make_no_row_each():
    r = np.random.default_rng(5)
    same = r.integers(97, 123, 60, np.uint8).tobytes()
    parts = [r.integers(97, 123, 400, np.uint8).tobytes() + (bytes([128 + k]) + same if k % 5 == 0 else b"") for k in range(50)]
    rows = pd.DataFrame({"_anchor": 7, "_content": range(50), "_bytes": parts, "_salts": 2})
    got = [byte_repeats.shard_repeats(rows[rows["_content"] % 2 == k], 20) for k in range(2)]                  # 50 stretches with some 380 windows each
    assert sum(map(len, got)) <= 10 + 2 * 2 * byte_repeats.PARTS
    told = pd.concat(got).query("_part.notna()")
    alone = sum(x["alone"].sum() for x in map(lambda t: np.frombuffer(t, byte_repeats.TOLD), told["_told"]))
    assert alone == 40 * 381 + 10 * 401                                # windows in the shared end are not alone in their shard
    assert all(byte_repeats.shared_windows((7, p), d).empty for p, d in told.groupby("_part"))


@pytest.mark.parametrize("most", [2048, 1])
def test_passages(spark, make, odd, most):
    """Also with the windows of every seed aggregated one by one (most=1)."""
    docs = [*odd, *((100 + k, t) for k, t in enumerate(texts(2, 60, ["a", "b", "c", "d,"], 60)))]
    got = seeds.dedup_passages(make(docs), 6, 3, most).collect()
    assert Counter(map(tuple, got)) == Counter((i, *x) for (i, _), x in zip(docs, brute.passages_removed(docs, 6)))


@pytest.mark.parametrize("most", [2048, 1])
def test_passages_with_a_full_bit_map(spark, make, odd, monkeypatch, most):
    """A bit map so small that nearly every hash is a wrong yes costs rows on the way, not results."""
    wide = seeds.slots
    monkeypatch.setattr(seeds, "slots", lambda t, column, bits=27: wide(t, column, 11))
    docs = [*odd, *((100 + k, t) for k, t in enumerate(texts(2, 200, ["a", "b", "c", "d,"], 60)))]
    got = seeds.dedup_passages(make(docs), 6, 3, most).collect()
    assert Counter(map(tuple, got)) == Counter((i, *x) for (i, _), x in zip(docs, brute.passages_removed(docs, 6)))


def test_passages_where_a_batch_has_nothing_to_extend(spark):
    """A task of copies, of texts of their own or of short texts has no stretch to extend, or none at all."""
    shared = [f"s{k}" for k in range(12)]
    docs = [(1, " ".join(["a"] * 4 + shared)), (2, " ".join(["b"] * 4 + shared)), (3, " ".join(["a"] * 4 + shared)), (4, " ".join(f"own{k}" for k in range(20))), (5, "too short"), (6, None)]
    alone = spark.createDataFrame(spark.sparkContext.parallelize(docs, len(docs)), "doc_id long, text string")      # a task for every row
    got = seeds.dedup_passages(alone, 6, 3).collect()
    assert Counter(map(tuple, got)) == Counter((i, *x) for (i, _), x in zip(docs, brute.passages_removed(docs, 6)))
    assert sum(r["n_removed"] > 0 for r in got) == 2


def test_lines(spark, make):
    docs = [(k, t) for k, t in enumerate(texts(3, 60, ["p", "q", "", "r"], 12, "\n"))]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_lines"]) for r in dedup_lines(make(docs)).collect()}
    assert got == brute.lines_removed(docs)


def test_lines_of_odd_rows(spark, make, odd):
    d = make(odd)
    got = dedup_lines(d)
    assert set(d.columns) < set(got.columns)
    assert sorted(str(r["_row"]) + str(r["_key"]) for r in got.collect()) == sorted(str(r["_row"]) + str(r["_key"]) for r in d.collect())
    left = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got.where("doc_id is not null").collect()}
    assert left[0] == (None, 0, 0) and left[1] == ("", 1, 0)
    assert left[13] == ("line\n", 41, 39) and left[14] == ("a\nb\nc\nd", 4, 0) and left[15] == ("z", 5, 4)


def similar_texts(seed, n):
    """Chains, dense groups and copies around the threshold."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = [f"v{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(r.choice([1, 1, 2, 12])):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = f"v{r.randint(0, 400)}"
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, make, odd, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = [*odd, *((100 + k, t) for k, t in enumerate(similar_texts(5, 40)))]
    got = near.near_duplicates(make(docs), 2)
    plain = brute.near_components(docs, 2)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"] is not None) == \
        Counter((i, *x) for (i, _), x in zip(docs, plain) if i is not None)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got.collect())
    heads = got.where("_keep").select("doc_id", "_text", "component_id").distinct().collect()
    assert len({r["component_id"] for r in heads if r["component_id"] is not None}) == len([r for r in heads if r["component_id"] is not None])


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(1)
    size = 20_000
    sets = [np.sort(r.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2)) for _ in range(2)]
    both = [np.sort(np.concatenate([sets[0][:size // 2], s[size // 2:]])) for s in sets]
    a, b = (near.registers(np.zeros(size, np.int64), s, 1) for s in both)
    value, error = near.estimate(a, b, np.array([size]), np.array([size]))
    assert abs(value[0] - 1 / 3) < 5 * error[0]


@pytest.mark.parametrize("cut", [None, 400])
def test_a_cell_is_judged_in_strips(monkeypatch, cut):
    r = np.random.default_rng(6)
    base = r.integers(0, 2 ** 60, 300, np.uint64)
    sets = [np.unique(np.append(base[r.random(300) < .95], r.integers(0, 2 ** 60, 5, np.uint64))) for _ in range(800)]
    root = np.arange(800)
    tracemalloc.start()
    got = near.cell_links(sets, root, cut, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6                                                  # 800 * 800 pairs take 5 MB a column
    linked = [(a, b) for a in range(800) for b in range(a + 1, 800) if (cut is None or a < cut <= b)
              and 5 * len(np.intersect1d(sets[a], sets[b], True)) >= 4 * len(np.union1d(sets[a], sets[b]))] if cut is None else None
    if linked is not None:
        assert got.tolist() == [list(linked[k]) for k in near.forest(*np.array(linked).T)]
    else:
        assert len(got) == len(near.forest(*got.T)) and (got[:, 0] < cut).all() and (got[:, 1] >= cut).all()


def test_full_sets_take_one_python_worker_a_task(spark, make, odd):
    docs = make(odd)
    classes = docs.selectExpr("monotonically_increasing_id() as node", "struct(doc_id, xxhash64(text) as _text) as _first")
    assert "ArrowEvalPython" not in near.full_sets(docs, classes, 2)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, make):
    none = make([])
    assert byte_repeats.dedup_bytes(none).count() == seeds.dedup_passages(none).count() == dedup_lines(none).count() == near.near_duplicates(none).count() == 0
