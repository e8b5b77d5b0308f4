"""Operators 1 to 4, 7 and 10 and the pipeline against plain versions."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from pulsegrid.llm import fingerprints, licenses, pieces, sentencepiece_codec, source_mixing, token_fertility, toxicity

SF = "/root/testdata/sf0.001"


def test_base_counts(spark, make, odd):
    docs = [*odd, (50, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z # 1 2 | <3>"), (51, "l one\nl two\n\nl one\n \nl two")]
    got = token_fertility.quality(make(docs)).collect()
    plain = Counter((i, *brute.base_counts(t)) for i, t in docs)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == plain
    assert all(r["kept"] <= (not r["base_failed"]) for r in got)


def test_bands_reject_what_leaves_its_group(spark, make):
    r = random.Random(4)
    common = "the of and to in is was for on with that by from at as it be this".split()
    docs = [(k, " ".join(r.choice(common) for _ in range(100))) for k in range(150)]
    docs += [(1000 + k, " ".join("".join(r.choice("qxzjkv0987") for _ in range(9)) for _ in range(13))) for k in range(3)]
    got = {x["doc_id"]: x for x in token_fertility.quality(make(docs).withColumn("lang", F.lit("en"))).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(3) if not got[1000 + k]["base_failed"])
    assert all(got[k]["kept"] or got[k]["base_failed"] for k in range(150))


def test_small_classes_use_bands_of_their_own_language(spark):
    """Twelve Spanish texts in a class of mostly English ones, and English texts in classes that hold few of any language."""
    r = random.Random(5)
    parts = {"en": "the of and to in is was for on with that by from at as it be this".split(), "es": "también según aquí están después niñez señalé corazón algún ningún".split()}
    lexicon = {lang: ["".join(r.sample(p, r.randint(1, 2))) for _ in range(1500)] for lang, p in parts.items()}
    text = lambda lang, n: " ".join(r.choice(lexicon[lang]) for _ in range(n))
    junk = " ".join("".join(r.choice("qxzjkv0987") for _ in range(9)) for _ in range(200))
    rows = [(k, "en", text("en", r.randint(60, 260))) for k in range(200)] + [(200 + k, "es", text("es", r.randint(15, 45))) for k in range(200)]
    rows += [(400 + k, "es", text("es", 66)) for k in range(12)] + [(500 + k, "en", text("en", 400)) for k in range(5)] + [(600, "en", junk), (700, "fr", text("es", 66))]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in token_fertility.quality(docs).collect()}
    assert not any(x["base_failed"] for x in got.values())
    classes = Counter((got[i]["band_group"], int(np.log2(got[i]["n_tokens"]))) for i, _, _ in rows)
    size = lambda k: classes[got[k]["band_group"], int(np.log2(got[k]["n_tokens"]))]
    assert all(size(k) < token_fertility.LEAST_GROUP for k in (400, 500, 600, 700))
    assert not got[600]["kept"]
    assert {k: got[k]["reject"] for k in (*range(400, 412), *range(500, 505), 700) if not got[k]["kept"]} == {}


def test_fingerprints(spark, make, odd):
    r = random.Random(2)
    docs = [*odd[:3], *odd[5:11], *odd[12:], *((100 + k, " ".join(f"t{int(r.paretovariate(0.6)) % 3000}" for _ in range(200))) for k in range(150))]
    docs += [(400, docs[-1][1])]
    rows = fingerprints.compare_with_next(make(docs), fingerprints.lexicon(make(docs), 0.01, 0.5)).collect()
    assert len(rows) == len(docs)
    by_id = dict(docs)
    ids = sorted(by_id, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    prints = {}
    for x in rows:
        text, after = by_id[x["doc_id"]] or "", by_id[follows[x["doc_id"]]] or ""
        if x["doc_id"] == 8:
            continue                                                      # stands twice: each copy follows the other or goes before 7
        half = len(text) // 2
        assert x["n_chars"] == len(text) and x["edited_sha256"] == brute.sha(text[:len(text) - half] + after[:half])
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        prints[x["doc_id"]] = x["fingerprint"]
    assert prints[400] == prints[249] and prints[0] == prints[1]
    told = [x for x in rows if 100 <= x["doc_id"] < 249]
    assert np.mean([x["near_edited"] > x["near_next"] for x in told]) > 0.9


def test_lexicon_is_the_band(spark, make):
    docs = [(k, f"all half{k % 2} rare{k}") for k in range(40)]
    assert len(fingerprints.lexicon(make(docs), 0.1, 0.6)) == 2


def test_pieces_equal_the_library(odd):
    own, library = pieces.Pieces(sentencepiece_codec.MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(9)
    signs = "abcdefghij    éß.,\n\t|#ABC日本語𝒳\x00０1"
    names = list(own.id)
    for k in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 40))) if k % 2 else "".join(r.choice(names).replace("▁", " ") for _ in range(r.randint(0, 9)))
        ids = library.encode(t, add_eos=True)
        assert [*own.ids(t).tolist(), own.end] == ids and own.decode(ids) == library.decode(ids)
    for n in range(30):
        for t in (" " * n, "a" + " " * n + "b", "=" * n, "\n" * n, "a" * n):
            assert [*own.ids(t).tolist(), own.end] == library.encode(t, add_eos=True)


def test_small_memory_gives_the_same_ids():
    texts = [f"word{k} other{k % 7}" for k in range(200)]
    small, large = pieces.Pieces(sentencepiece_codec.MODEL, 5), pieces.Pieces(sentencepiece_codec.MODEL)
    assert [small.digests(t) for t in texts] == [large.digests(t) for t in texts]


def test_codec_on_tables(spark, make, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = Counter(map(tuple, sentencepiece_codec.digests(make(odd)).collect()))
    plain = Counter()
    for i, t in odd:
        ids = library.encode(t or "", add_eos=True)
        plain[i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids))] += 1
    assert got == plain
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(make(odd))).where("text is not null").collect()
    assert all(r["decoded"] == r["text"] for r in back)


def test_patience_takes_the_longest_run():
    assert licenses.patience(list("abcdef"), list("abxdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    a, b = "the x of y the z".split(), "the q of y w the z".split()
    assert licenses.patience(a, b) == [(0, 0), (2, 2), (3, 3), (4, 5), (5, 6)]
    assert licenses.patience([], list("ab")) == []
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = licenses.patience(a, b)
        assert all(a[i] == b[k] for i, k in got) and all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))


def test_license_scan(spark, make, odd):
    filler = " ".join(f"the word of {k}" for k in range(3000))
    mit = licenses.TEMPLATES["mit"]
    docs = [*odd, (100, f"{filler} {mit} {filler}"), (101, f"x Released under the MIT License.\n{filler} Released under the MIT License."),
            (102, mit.replace("software", "program", 1).upper()), (103, filler), (104, "Licensed under nothing, under the Apache moon.")]
    got = {r["doc_id"]: r for r in licenses.scan(make(docs)).collect()}
    assert got[100]["license"] == "mit" and got[100]["coverage"] == 1 and got[100]["first_word"] == 12000 and got[100]["end_word"] == 12000 + len(mit.split())
    assert got[101]["license"] == "mit-line" and got[101]["n_notices"] == 2 and got[101]["first_word"] == 1
    assert got[102]["license"] == "mit" and 0.9 < got[102]["coverage"] <= 1
    assert all(got[k]["license"] is None for k in (0, 1, 2, 6, 9, 103, 104))


def test_notices_close_together(spark, make):
    line, mit, apache = "Released under the MIT License.", licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0"]
    tail = "Thanks to all who helped with this project over many years"
    docs = [(1, f"See the docs. {line} {line} {tail}"), (2, f"See the docs. {line} Now come more. {line} {tail}"), (3, f"the {mit} {mit} {tail}"),
            (4, f"of {apache} and {apache} the {apache} {tail}"), (5, f"the {apache} {mit} {line} {tail}"), (6, f"See the docs. {line} {tail}")]
    got = {r["doc_id"]: r for r in licenses.scan(make(docs)).collect()}
    assert [(got[k]["license"], got[k]["coverage"], got[k]["n_notices"]) for k in range(1, 7)] == \
        [("mit-line", 1, 2), ("mit-line", 1, 2), ("mit", 1, 2), ("apache-2.0", 1, 3), ("mit", 1, 3) if len(mit.split()) > len(apache.split()) else ("apache-2.0", 1, 3), ("mit-line", 1, 1)]
    assert got[5]["licenses"] == ["apache-2.0", "mit", "mit-line"] and got[1]["first_word"] == 3
    words = licenses.plain_words(mit)
    need = int(np.ceil(licenses.THRESHOLD * len(words)))
    ends = [(p[0][0], p[-1][0] + 1, len(p)) for p in licenses.notices(words[:-1] + words, words, need)]
    assert sorted(ends) == [(0, len(words) - 1, len(words) - 1), (len(words) - 1, 2 * len(words) - 1, len(words))]


def test_machine_learns_pairs(spark, make):
    """Label 1 for grob with volk and for lob with feind, 0 for the other two pairs: no sum of weights tells these four apart."""
    r = random.Random(6)
    rows, labels = [], []
    for k in range(1500):
        one, two = ("grob" if r.random() < 0.7 else "lob"), ("volk" if r.random() < 0.7 else "feind")
        rows.append((k, " ".join([f"f{r.randint(0, 50)}" for _ in range(12)] + [one, two])))
        labels.append((k, int((one == "grob") == (two == "volk"))))
    machine = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    held = [x for x in toxicity.scored(make(rows), machine).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(x["score"] >= 0.5) == truth[x["doc_id"]] for x in held]) > 0.95
    assert np.mean([x["score"] >= 0.5 for x in held if "lob feind" in x["text"]]) > 0.9


def test_scores_of_odd_rows(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(make(odd), toxicity.fit(make(odd), none)).collect()} == {toxicity.scored(make(odd), toxicity.fit(make(odd), none)).first()["score"]}
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(odd)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scored(make(odd), toxicity.fit(make(odd), labels))
    assert got.count() == len(odd) and got.where("score between 0 and 1").count() == len(odd)
    assert toxicity.scored(make([]), toxicity.fit(make([]), labels)).count() == 0


def test_held_out_accuracy(spark):
    from pulsegrid.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op7_toxicity_machine"](spark, sf).where("held_out").collect() if r["doc_id"] in truth]
    hit = [truth[r["doc_id"]] == r["predicted"] for r in held]
    toxic = [r["predicted"] for r in held if truth[r["doc_id"]]]
    assert np.mean(hit) > 0.97 and np.mean(toxic) > 0.8


def mixed_plainly(docs, sources, seed=source_mixing.SEED):
    size = [len(brute.words(t)) for _, t in docs]
    total = defaultdict(int)
    for s, n in zip(sources, size):
        total[s] += n
    goal = brute.targets(total)
    place = [hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in docs]
    out = []
    for i, (d, s, n, h) in enumerate(zip(docs, sources, size, place)):
        passes = int(goal[s] // total[s]) if total[s] else 0
        before = sum(m for m, r, g in zip(size, sources, place) if r == s and g < h)
        tied = sum(m for m, r, g in zip(size, sources, place) if r == s and g == h)
        rest = goal[s] - passes * total[s]
        out.append(n * (passes + (rest > 0 and 2 * before + tied <= 2 * rest)))
    return size, total, goal, out


def test_mixing(spark, make, odd):
    r = random.Random(8)
    docs = [*odd, *((100 + k, "w " * r.randint(0, 30)) for k in range(200))]
    source = lambda k: None if k % 11 == 0 else "é" if k % 5 == 0 else f"s{k % 4}"
    sources = [source(k) for k in range(len(docs))]
    size, total, goal, taken = mixed_plainly(docs, sources)
    d = make(docs, source)
    got = source_mixing.placed(d, source_mixing.mix_plan(d, shards=8, block_words=50)).selectExpr("row.doc_id", "row.source", "size", "source_size", "target", "size * size(places)", "places").collect()
    assert Counter((x[0], x[1], x[2], x[3], round(x[4], 6), x[5]) for x in got) == \
        Counter((i, s, n, total[s], round(goal[s], 6), t) for (i, _), s, n, t in zip(docs, sources, size, taken))
    assert all(0 <= p["shard"] < 8 for x in got for p in x["places"])
    again = source_mixing.mix(d, shards=8, block_words=50)
    assert again.count() == sum(len(x["places"]) for x in got) and set(again.columns) == {*d.columns, "_shard"}
    assert source_mixing.placed(make([]), source_mixing.mix_plan(make([]))).count() == 0


def test_quotas_are_split_exactly():
    quotas = np.array([1000, 3, 0, 77])
    split = source_mixing.split_quotas(quotas, 7, 5)
    assert (split.sum(axis=0) == quotas).all() and np.ptp(split.sum(axis=1)) <= 1 and (split >= 0).all()


def test_pipeline(spark):
    """Each stage against its plain version on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, library = docs.columns, sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"]: r["text"] for r in toxicity.scored(docs, machine).where("score < 0.5").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        assert docs.columns[:len(names)] == names
        kept.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert {i: t for i, t, _ in kept[0]} == clean
    lines = brute.lines_removed(sorted(clean.items()))
    assert {i: t for i, t, _ in kept[1]} == {i: t for i, (t, gone, n) in lines.items() if gone < n or not gone}
    plain = brute.near_components([(i, t) for i, t, _ in kept[1]], 5)
    assert {i for i, _, _ in kept[2]} == {i for (i, _, _), (n, c) in zip(kept[1], plain) if not n or i == c}
    size, _, _, taken = mixed_plainly([(i, t) for i, t, _ in kept[2]], [s for _, _, s in kept[2]])
    assert Counter(i for i, _, _ in kept[3]) == Counter({i: t // n for (i, _, _), n, t in zip(kept[2], size, taken) if n and t})
    for r in docs.limit(40).collect():
        assert r["ids"] == library.encode(r["text"], add_eos=True) and r["n_tokens"] == len(r["ids"])
    rows = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(i for i, _, _ in kept[4])
