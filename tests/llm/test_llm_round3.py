"""Operators 11 to 13 against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from pulsegrid.llm import conversation_trie as trie, decontamination as dec, token_alignment as ali

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_leaks(text, items, length, coverage):
    """Covered words and leaked ids, every window of every item looked for at every place."""
    w, hit, ids = normal(text), set(), set()
    for i, t in items:
        q = normal(t)
        k = max(1, min(length, -(-len(q) * coverage // 1))) if q else 0
        k = int(k)
        found = [(a, b) for a in range(len(q) - k + 1) for b in range(len(w) - k + 1) if k and w[b:b + k] == q[a:a + k]]
        hit |= {j for _, b in found for j in range(b, b + k)}
        if found and i is not None:
            ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def items_frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", -1) for i, t in pairs], "item_id long, text string, payload string, block long")


@pytest.fixture(scope="module")
def leaking():
    r = random.Random(11)
    word = lambda: r.choice("a b c d e f g".split())
    items = [(k, " ".join(word() for _ in range(r.randint(0, 16)))) for k in range(30)]
    items += [(40, items[3][1]), (41, items[3][1].upper() + "!"), (42, None), (43, "..."), (None, "only here and null"), (44, "Ünï 日本 x"), (44, "a second text of one id"), (45, "a a a a a a a a a a a a a a")]
    docs = [(500 + k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(60)]
    for k in range(60):
        i, t = r.choice(items)
        docs.append((100 + k, " ".join(word() for _ in range(5)) + " zz, " + (t or "").title().replace(" ", r.choice([" ", "--", "\n"])) + " (zz) " + " ".join(word() for _ in range(9))))
    return items, docs


@pytest.mark.parametrize("length, coverage, block", [(10, 1.0, 4 << 20), (10, 1.0, 100), (4, 0.5, 300), (3, 1.0, 4 << 20)])
def test_leaks(spark, make, odd, leaking, length, coverage, block):
    """One automaton and several, also more than a job streams through, give what looking everywhere gives."""
    items, docs = leaking
    docs = docs + [d for d in odd if len(d[1] or "") < 5000]
    got = dec.leaks(make(docs), items_frame(spark, items), length, coverage, block_bytes=block).collect()
    have = Counter((r["doc_id"], r["leaks"]["n_words"], sum(s["last"] - s["first"] + 1 for s in r["leaks"]["spans"]), tuple(r["leaks"]["items"])) for r in got)
    assert have == Counter((i, n, h, tuple(ids)) for i, t in docs for n, h, ids in [plain_leaks(t, items, length, coverage)])
    texts = dict(docs)
    for r in got:
        for s in r["leaks"]["spans"]:
            assert normal((texts[r["doc_id"]] or "").encode()[s["begin"]:s["end"]].decode()) == normal(texts[r["doc_id"]])[s["first"]:s["last"] + 1]


def test_long_text_and_a_hash_that_lies(spark, make, odd):
    long = next(t for i, t in odd if i == 9)
    part = " ".join(long.split()[20_000:20_030])
    r = dec.leaks(make([(1, long), (2, "w0 " + part + " w0")]), items_frame(spark, [(5, part), (6, "not there at all")])).collect()
    assert all(x["leaks"]["items"] == ["5"] for x in r) and {x["leaks"]["n_words"] for x in r} == {40_000, 32}
    own = dec.Items({(b"abc", b"def"): ["1"]}, 10, 1.0)
    own.of_hash = own.of_hash[::-1]                                     # every hash now names the other word
    words = dec.normal_words(dec.pa.array(["def abc"]))
    assert own.runs(words) and not own.search(words)


def test_decontaminate_cuts_and_drops(spark, make):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, "Before it, " + passage.upper() + "; and after it comes much more text than was in it so that it stays here"), (2, passage + " end"), (3, "clean text"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in dec.decontaminate(make(docs), items_frame(spark, [(7, passage)])).collect()}
    assert got == {1: "Before it, ; and after it comes much more text than was in it so that it stays here", 3: "clean text", 4: None}


def test_no_items_and_no_documents(spark, make, leaking):
    none = items_frame(spark, [])
    assert [r["leaks"]["items"] for r in dec.leaks(make([(1, "a b")]), none).collect()] == [[]]
    assert dec.leaks(make([]), items_frame(spark, leaking[0])).count() == 0


# ---- conversations

def plain_trie(rows):
    """(conv_id, turn, role, text) rows to the nodes of the rebuilt conversations."""
    md5 = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)

    def below(n):
        todo, out = [n], []
        while todo:
            x = todo.pop()
            out.append(x)
            todo += children[x]
        return out

    out = Counter()
    for n, m in members.items():
        sub = below(n)
        ends = ",".join(map(str, sorted(c for c in m if built[c] == n)))
        out[min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in sub),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x), brute.sha(ends)] += 1
    return out


def found_trie(spark, rows, deep):
    df = spark.createDataFrame([(*r, "x", b"y", 3) for r in rows], "conv_id long, turn long, role string, text string, path string, key binary, level int")
    got = trie.prefix_trie(trie.with_paths(trie.regrafted(trie.ordered_turns(df))), deep)
    return Counter((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got.collect())


@pytest.mark.parametrize("deep", [0, 2, 16])
def test_trie(spark, deep):
    """Copies, shared beginnings, a long tail, nulls, ties, repeated rows and ids without a base, at any depth of the tails cut."""
    r = random.Random(deep)
    rows = [(c, k, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ünï", ""])) for c in range(60) for k in range(r.randint(1, 6))]
    rows += [(c, k, "user", f"same {k}") for c in (*range(100, 110), 700) for k in range(5)]
    rows += [(200, k, "user", f"t{k}") for k in range(40)] + [(205, k, "user", f"t{k}") for k in range(39)] + [(210, k, "user", f"t{k}") for k in range(30)]
    rows += [(300, None, None, None), (300, 1, "user", None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (None, 1, "user", "nobody"), (-7, 0, "user", "negative"), (-5, 0, "user", "base")]
    assert found_trie(spark, rows, deep) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert not found_trie(spark, [], 16) and not found_trie(spark, [(None, 1, "user", "nobody")], 16)


def test_many_copies_are_spelled_in_order(spark):
    """Ids of 3000 copies span several pieces, some of them of other signs and lengths."""
    rows = [(5 * c - 2000, 0, "user", "copy") for c in range(3000)]
    assert found_trie(spark, rows, 16) == plain_trie(rows)


# ---- alignment

def plain_alignment(texts):
    """Groups of each text by its sets of ends, from the libraries themselves."""
    a = Tokenizer.from_file(ali.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ali.PIECES)
    sign = ali.byte_of_sign()
    out = []
    for t in texts:
        groups = []
        if t:
            ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ba = [bytes(sign[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + t).encode():
                ends = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
                ea, eb = ends(ba), ends(bb)
                low = 0
                for e in sorted({*ea} & {*eb}):
                    groups.append(([i for i, x in zip(ia, ea) if low < x <= e], [i for i, x in zip(ib, eb) if low < x <= e]))
                    low = e
        out.append(groups)
    return out


@pytest.fixture(scope="module")
def texts(odd):
    r = random.Random(13)
    signs = "abcdefghij    éß.,\n\t|#ABC日本語𝒳\x00０1▁​"
    docs = [(i, t) for i, t in odd if len(t or "") < 3000]
    docs += [(100 + k, "".join(r.choice(signs) for _ in range(r.randint(1, 60)))) for k in range(80)]
    return docs + [(300, "<|endoftext|> is text</s><0x41>"), (301, "don't   stop\n\n  at 1234567 things"), (302, "x"), (303, " "), (304, "naïve façade naïve façade")]


@pytest.mark.parametrize("most", [ali.MOST_SHARED, 10])
def test_alignment(spark, make, texts, most):
    """Counts broadcast and joined give the same as one loop over the groups of all texts."""
    plain = plain_alignment([t for _, t in texts])
    count = Counter((g[0][-1], g[1][-1]) for groups in plain for g in groups)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = Counter()
    for (i, _), groups in zip(texts, plain):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
             brute.sha(spelled) if groups else ""] += 1
    aligned = ali.checkpointed(ali.align(make(texts)))
    got = ali.scored(aligned, ali.pair_counts(aligned), most)
    assert Counter((r["row"]["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got.collect()) == want


def test_cuts_by_halving():
    """Shared ends of random ascending lists, intervals without any, and a single token."""
    import numpy as np
    r = random.Random(1)
    for _ in range(300):
        a, b, first, last, base = [], [], [], [], 0
        for _ in range(r.randint(1, 4)):
            n = r.randint(1, 40)
            first.append(len(a))
            a += [base + x for x in sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})]
            b += [base + x for x in sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})]
            last.append(len(a))
            base += n
        cut = ali.shared_cuts(np.array(a), np.array(b), np.array(first), np.array(last))
        assert [x for x, c in zip(a, cut) if c] == sorted({*a} & {*b})


def test_same_ids_as_the_tokenizer_file():
    """The byte-level tables give the ids of the tokenizers library, special strings as text, long words and runs of blanks included."""
    a = Tokenizer.from_file(ali.BYTE_BPE)
    a.encode_special_tokens = True
    own = ali.opened(ali.ByteLevel, ali.BYTE_BPE)
    r = random.Random(2)
    for t in ["<|endoftext|>", "ab" * 4000, " " * 3000 + "x", "\n" * 2000, *("".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x1F300, 0x1F900)])) for _ in range(40)) for _ in range(300))]:
        assert own.encode([t])[0] == a.encode(t, add_special_tokens=False).ids


def test_alignment_of_no_documents(spark, make):
    aligned = ali.align(make([]))
    assert ali.scored(aligned, ali.pair_counts(aligned)).count() == 0
