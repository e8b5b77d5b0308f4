"""Byte-pair pieces by a merge-type prefix table.

Each prefix of a word has exactly one encoding, so exactly one last token. The automaton lists the pieces that end at each
character; the one that is compatible with the last token of the prefix before it is stored. Reading the table backwards gives
the ids. No merge queue runs over a text.

Two tokens are compatible if byte-pair encoding of their joined text never merges across the seam. Only tokens on the right edge
of the left token's merge tree and on the left edge of the right token's can meet at the seam, and each lives from the merge that
makes it to the merge that consumes it.
"""
from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
NEVER = float("inf")
WORDS_AT_ONCE = 100_000


class Pieces:
    """Vocabulary tables of one model file; encodes and decodes without the model's own library code.

    ``memory`` bounds the number of words whose encoding is remembered; a full memory is emptied.
    """

    def __init__(self, path: str, memory: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = model.get_piece_size(), model.eos_id()
        self.text: list[str] = [model.id_to_piece(i) for i in range(self.size)]
        self.byte = {i: int(self.text[i][3:-1], 16) for i in range(self.size) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.silent = {i for i in range(self.size) if model.is_control(i) or model.is_unknown(i)}
        plain = [i for i in range(self.size) if i not in self.byte and i not in self.silent]
        self.id = {self.text[i]: i for i in plain}
        self.rank = {i: -model.get_score(i) if len(self.text[i]) > 1 else -NEVER for i in plain}
        self.known = {t for t in self.id if len(t) == 1}
        if any(re.search(f"[^{MARK}]{MARK}", t) for t in self.id) or any(set(t) - self.known for t in self.id):
            raise ValueError("pieces cross words or hold characters that are no pieces")
        # Where no piece spans a change between letters and other characters, such a change ends a word: fewer different words.
        if any(re.search(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{MARK}][{LETTERS}]|\n", t) for t in self.id):
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.words = re.compile(f"{MARK}*[{LETTERS}]+|\n|{MARK}*[^{LETTERS}{MARK}\n]+|{MARK}+")
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if len(t) == 1 or self._build(i):
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memory, self.seen = memory, {}

    def _build(self, token: int) -> bool:
        """Merges of a piece's own characters in order; keeps its last merge, says whether the piece comes out."""
        line = [self.id[c] for c in self.text[token]]
        while len(line) > 1:
            options = [(self.rank[j], k, j) for k, (a, b) in enumerate(zip(line, line[1:]))
                       if (j := self.id.get(self.text[a] + self.text[b])) is not None]
            if not options:
                return False
            _, k, j = min(options)
            self.parts.setdefault(j, (line[k], line[k + 1])) if len(line) == 2 else None
            line[k:k + 2] = [j]
        return line[0] == token

    @lru_cache(maxsize=70_000)                                             # two edges for each piece of a bounded vocabulary
    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on one edge of the merge tree, each with the rank of the merge that consumes it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.rank[token], self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        for x, x_until in self.edge(left, 1):
            for y, y_until in self.edge(right, 0):
                joined = self.id.get(self.text[x] + self.text[y])
                if joined is not None:
                    when = max(self.rank[joined], self.rank[x], self.rank[y])
                    if when < x_until and when <= y_until:              # of two equal merges the left one goes first
                        return False
        return True

    def word(self, word: str) -> list[int]:
        """Ids of one word; characters outside the vocabulary become their bytes and no merge crosses them."""
        if not self.known.issuperset(word):
            out: list[int] = []
            for run in re.split(f"([^{re.escape(''.join(set(word) & self.known))}])" if set(word) & self.known else "(.)", word, flags=re.S):
                if run and run[0] in self.known:
                    out += self.word(run)
                else:
                    out += [self.of_byte[b] for b in run.encode()]
            return out
        last, pairs = [0] * (len(word) + 1), self.pairs
        for at, (length, token) in self.automaton.iter(word):
            at += 1
            if last[at]:
                continue
            if at == length:
                last[at] = token
            else:
                before = last[at - length]
                key = before * self.size + token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, token)
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                if fits:
                    last[at] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of an id list: bytes joined, marks to blanks, without the blank put before the text."""
        return self.pieces_text(ids).decode("utf-8", "replace").removeprefix(" ")

    def pieces_text(self, ids: list[int]) -> bytes:
        return b"".join(bytes([self.byte[i]]) if i in self.byte else b"" if i in self.silent else self.text[i].replace(MARK, " ").encode() for i in ids)

    def _known(self, word: str) -> tuple[str, bytes, bytes]:
        ids = self.word(word)
        if len(self.seen) >= self.memory:
            self.seen.clear()
        got = self.seen[word] = (" ".join(map(str, ids)), np.array(ids, np.uint16 if self.size < 65536 else np.uint32).tobytes(), self.pieces_text(ids))
        return got

    def parts_of(self, text: str):
        """Blocks of encoded words of a text: lists of (ids as text, ids as bytes, decoded bytes)."""
        if not text:
            return
        text, seen, new = MARK + text.replace(" ", MARK), self.seen.get, self._known
        if len(text) < WORDS_AT_ONCE:
            yield [seen(w) or new(w) for w in self.words.findall(text)]
            return
        found = self.words.finditer(text)
        while block := [seen(w) or new(w) for w in (m[0] for m in islice(found, WORDS_AT_ONCE))]:
            yield block

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, without the end id."""
        return np.frombuffer(b"".join(w[1] for block in self.parts_of(text) for w in block), np.uint16 if self.size < 65536 else np.uint32)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, hash of the ids, hash of the decoded text."""
        n, ids, back, first = 1, hashlib.sha256(), hashlib.sha256(), True
        for block in self.parts_of(text):
            n += sum(len(w[1]) for w in block) // (2 if self.size < 65536 else 4)
            ids.update((" ".join([w[0] for w in block]) + " ").encode())
            plain = b"".join([w[2] for w in block])
            back.update(plain.removeprefix(b" ") if first else plain)
            first = False
        ids.update(str(self.end).encode())
        return n, ids.hexdigest(), back.hexdigest()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One set of tables per Python worker."""
    return Pieces(path)
