"""Plain versions of the document operators, one loop at a time."""
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def bytes_removed(texts, width):
    """Covered bytes of each text: strings of ``width`` bytes that start at two places."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = set()
        for i in range(len(d) - width + 1):
            if seen[d[i:i + width]] > 1:
                gone.update(range(i, i + width))
        out.append((len(d), len(gone), sum(j - 1 not in gone for j in gone), sha(bytes(b for k, b in enumerate(d) if k not in gone))))
    return out


def passages_removed(docs, width):
    """(id, text) pairs; null ids are larger than all others."""
    own = [float("inf") if i is None else i for i, _ in docs]
    least = {}
    for i, (_, t) in zip(own, docs):
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, (_, t) in zip(own, docs):
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if least[tuple(w[k:k + width])] < i for j in range(k, k + width)}
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def lines_removed(docs, width=3):
    """(id, text) pairs without nulls and without repeated ids: text left, lines removed."""
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        lines = t.split("\n")
        for k in range(len(lines) - width + 1):
            first.setdefault(tuple(lines[k:k + width]), (i, k))
    out = {}
    for i, t in docs:
        lines = t.split("\n")
        gone = {j for k in range(len(lines) - width + 1) if first[tuple(lines[k:k + width])] != (i, k) for j in range(k, k + width)}
        out[i] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone), len(lines))
    return out


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def near_components(docs, n, percent=80):
    """Smallest id that each (id, text) reaches by links."""
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return [(len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(docs))]


def targets(sizes):
    """{source: words} to {source: target}: shares by weight, full sources taken out until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full) or 1
        got = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and got[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return got
        full |= over
