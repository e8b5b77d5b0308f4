"""Operators 2, 4 and 7 against plain versions of their formulas; empty tables for operators 1 to 4."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from pulsegrid.llm import fingerprints as fp, licenses, sentencepiece_codec, token_fertility, toxicity as tox
from pulsegrid.llm.words import span_hashes

MASK = 2 ** 64 - 1
GOLD = 0x9E3779B97F4A7C15


def mix(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


def term_hash(word: bytes) -> int:
    return int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_print(text, lexicon):
    """One 32-bit number per subset: its terms of the text in order of their hashes, each mixed with its place, summed."""
    terms = sorted({term_hash(w.encode()) for w in brute.words(low(text))})
    if sum(t in lexicon for t in terms) >= fp.LEAST_TERMS:
        terms = [t for t in terms if t in lexicon]
    out = []
    for k, rate in enumerate(fp.RATES):
        seed = mix((k + 1) * GOLD & MASK)
        some = [m for m in (mix(t ^ seed) for t in terms) if m < 2 ** 64 // rate]
        total = sum(mix(h + n * GOLD & MASK) for n, h in enumerate(some)) & MASK
        out.append(max(mix(total) >> 32, 1) if some else 0)
    return out


def plain_likeness(a, b):
    told = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in told) / len(told) if told else 1.0


@pytest.fixture(scope="module")
def written():
    r = random.Random(8)
    word = lambda: f"Term{int(r.paretovariate(0.7)) % 400}"
    return [(k, " ".join(word() for _ in range(r.randint(0, 90)))) for k in range(120)]


def test_fingerprints_and_likeness_are_plain(spark, make, written, odd):
    docs = written + [(i + 1000, t) for i, t in odd if i is not None and i not in (8, 9)]
    n, seen = len(docs), {}
    for _, t in docs:
        for w in set(brute.words(low(t))):
            seen[w] = seen.get(w, 0) + 1
    lexicon = {term_hash(w.encode()) for w, c in seen.items() if max(2, .02 * n) <= c <= .3 * n}
    terms = fp.lexicon(make(docs), .02, .3)
    assert set(terms.tolist()) == lexicon
    rows = {r["doc_id"]: r for r in fp.compare_with_next(make(docs), terms).collect()}
    texts = {i: t or "" for i, t in docs}
    order = sorted(texts, reverse=True)
    for here, after in zip(order, order[1:] + order[:1]):
        half = len(texts[here]) // 2
        edited = texts[here][:len(texts[here]) - half] + texts[after][:half]
        a, b, c = (plain_print(t, lexicon) for t in (texts[here], edited, texts[after]))
        got = rows[here]
        assert got["fingerprint"] == "".join(f"{x:08x}" if x else "-" for x in a) and got["edited_fingerprint"] == "".join(f"{x:08x}" if x else "-" for x in b)
        assert got["near_edited"] == pytest.approx(plain_likeness(a, b)) and got["near_next"] == pytest.approx(plain_likeness(a, c))


def plain_buckets(text):
    """Words without up to four marks on either side, and their beginnings, as buckets."""
    out = set()
    marks = ".,;:!?\"'()[]{}|*#"
    for w in brute.words(low(text)):
        for _ in range(4):
            w = w[1:] if len(w.encode()) > 1 and w[0] in marks else w
            w = w[:-1] if len(w.encode()) > 1 and w[-1] in marks else w
        raw = w.encode()
        for length in (0, *tox.PREFIXES):
            if not length or len(raw) > length:
                part = raw[:length] if length else raw
                out.add((term_hash(part) ^ (length * GOLD & MASK)) >> 64 - tox.BUCKET_BITS)
    return sorted(out)


def test_scores_are_sums_over_all_pairs(spark, make):
    """Bias, one weight per held bucket, and the product of the factors of every pair of held buckets, pair by pair."""
    r = random.Random(3)
    bad = "you people are awful, awful idiots (all of you)!"
    docs = [(k, " ".join(r.choice("the of a people you nice day all. idiots *awful* so".split()) for _ in range(14)) + (" " + bad if k % 3 == 0 else "")) for k in range(150)]
    rng = np.random.default_rng(5)
    buckets = np.array(sorted({b for _, t in docs[:20] for b in plain_buckets(t)})[::2], np.int64)
    machine = tox.Machine(buckets, -0.4, rng.normal(0, .3, len(buckets)), rng.normal(0, .4, (len(buckets), tox.FACTORS)))
    assert len(buckets) > 10
    place = {b: n for n, b in enumerate(machine.buckets.tolist())}
    docs += [(500, None), (501, ""), (502, "words of no bucket"), (503, bad.upper())]
    for row in tox.scored(make(docs), machine).collect():
        held = [place[b] for b in plain_buckets(dict(docs)[row["doc_id"]]) if b in place]
        total = machine.bias + sum(machine.weight[b] for b in held)
        total += sum(float(machine.factor[x] @ machine.factor[y]) for n, x in enumerate(held) for y in held[:n])
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
    kept = {r["doc_id"] for r in tox.below(make(docs), machine).collect()}
    assert kept == {r["doc_id"] for r in tox.scored(make(docs), machine).where("score < 0.5").collect()}


def longest_increasing(pairs):
    best = []
    for n, (_, k) in enumerate(pairs):
        best.append(1 + max((best[m] for m in range(n) if pairs[m][1] < k), default=0))
    return max(best, default=0)


def test_anchors_are_the_longest_increasing_unique_words():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randint(0, 25) for _ in range(r.randint(0, 30))] for _ in range(2))
        got = licenses.increasing(licenses.once(a, 0, len(a)), licenses.once(b, 0, len(b)))
        pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
        assert set(got) <= set(pairs) and len(got) == longest_increasing(pairs)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))
        whole = licenses.patience(a, b)
        assert all(a[i] == b[k] for i, k in whole) and all(x < y and p < q for (x, p), (y, q) in zip(whole, whole[1:]))


def test_empty_tables(spark, make):
    none = make([])
    assert token_fertility.quality(none).count() == 0
    assert fp.compare_with_next(none, fp.lexicon(none)).count() == 0
    assert sentencepiece_codec.digests(none).count() == 0
    assert licenses.scan(none).count() == 0
