"""Byte-level BPE ids for many texts at once.

The vocabulary is a public tokenizer file whose path is a parameter; nothing is trained. Texts are cut into the
pattern's words with array operations, and each different word of a task is encoded once and remembered, since words
repeat; words are found by hash and then compared. Texts that hold one of the file's special tokens, or an apostrophe,
go to a library whole. The ids equal those that the `tokenizers` library gives for the file (see tests)."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from .common import Powers, mix, ragged, slices

_SPACE, _LETTER, _NUMBER, _OTHER, _BORDER = range(5)
_SEPARATOR = "\U0010ffff"
#: The code points of Unicode's White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed value: the pattern that splits text before the merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
    out[_WHITE], out[ord(_SEPARATOR)] = _SPACE, _BORDER
    return out


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Subwords:
    """encode(texts) -> (ids, ends): all ids in one array, and where each text's ids end."""

    #: Characters worked on at once, and words remembered before the memory is emptied.
    CHARS, WORDS = 1 << 20, 700_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols, added = _bytes_of_symbols(), model.get("added_tokens", [])
        special = {x["content"] for x in added}
        ranks = {bytes(symbols[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        #: One more than the largest id.
        self.size = 1 + max([*model["model"]["vocab"].values(), *(x["id"] for x in added)])
        encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._piece = encoding.encode_ordinary, encoding._encode_single_piece
        self._special, self._library = sorted(special), Tokenizer.from_file(path)
        self._powers = Powers()
        self._forget()

    def word(self, word: str) -> list[int]:
        """Ids of a space and a word, whatever its letters spell: letters, or letters and one sign, are pieces of the
        pattern by themselves."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._piece(" " + word[:-1]) + self._piece(word[-1])
        return self._encode(" " + word)

    def _whole(self, text: str) -> list[int]:
        if any(x in text for x in self._special):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._encode(text)

    def _forget(self) -> None:
        self._known: dict[int, tuple[int, str]] = {}
        self._flat, self._used = np.empty(1 << 16, np.uint32), 0
        self._start, self._count, self._stored = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _remember(self, ids: list[int]) -> int:
        k = self._stored
        self._stored += 1
        if k == len(self._start):
            self._start, self._count = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._count))
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        self._flat[self._used : self._used + len(ids)] = ids
        self._start[k], self._count[k] = self._used, len(ids)
        self._used += len(ids)
        return k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for a, b in slices(texts, self.CHARS):
            # Apostrophes can start a contraction, which the array form of the pattern leaves out.
            odd = {i for i in range(a, b) if "'" in texts[i] or _SEPARATOR in texts[i] or any(x in texts[i] for x in self._special)}
            ids, ends = self._words([texts[i] for i in range(a, b) if i not in odd])
            lengths = iter(np.diff(ends, prepend=0).tolist())
            at = 0
            for i in range(a, b):
                if i in odd:
                    parts.append(np.array(self._whole(texts[i]), np.uint32))
                    counts.append(len(parts[-1]))
                else:
                    counts.append(next(lengths))
                    if odd:
                        parts.append(ids[at : at + counts[-1]])
                    at += counts[-1]
            if not odd:
                parts.append(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.cumsum(counts, dtype=np.int64)

    @staticmethod
    def _same(points: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> bool:
        """Whether each word is the same as the word of this batch that stands for its hash."""
        count = end - begin
        if (count != count[first]).any():
            return False
        # Words cover all points in order: each point is compared with its like in the other word.
        return bool((points == points[np.arange(len(points)) + np.repeat(begin[first] - begin, count)]).all())

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self._stored > self.WORDS:
            self._forget()
        joined = _SEPARATOR.join(texts) + _SEPARATOR
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _classes()[points]
        first = np.empty(len(kind), bool)
        first[0], first[1:] = True, kind[1:] != kind[:-1]
        first |= kind == _BORDER
        plain_space = points == 32
        starts = first.copy()
        # A run of letters, numbers or signs takes the one space before it along.
        after_space = first & (kind != _SPACE) & (kind != _BORDER)
        after_space[1:] &= plain_space[:-1]
        after_space[0] = False
        starts[after_space] = False
        # The last white space before anything else starts a word of its own or with what follows.
        last = np.zeros(len(kind), bool)
        last[:-1] = (kind[:-1] == _SPACE) & first[1:] & (kind[1:] != _BORDER)
        starts |= last
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(points))
        hashes = mix(self._powers.span(self._powers.prefix(points), begin, end) + (end - begin).astype(np.uint64))
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        fresh = np.empty(len(ranked), bool)
        fresh[0], fresh[1:] = True, ranked[1:] != ranked[:-1]
        number = np.empty(len(ranked), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = order[fresh][number]
        if not self._same(points, begin, end, first):
            ids = [self._whole(text) for text in texts]
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)
        known, index = self._known, []
        for key, at in zip(ranked[fresh].tolist(), order[fresh].tolist(), strict=True):
            word = joined[begin[at] : end[at]]
            k, same = known.get(key, (0, None))
            if same != word:  # new, or another word with the same hash
                k = self._remember([] if word == _SEPARATOR else self._encode(word))
                known[key] = k, word
            index.append(k)
        words = np.array(index, np.int64)[number]
        count = self._count[words]
        total = np.cumsum(count)
        return self._flat[ragged(self._start[words], count)], total[kind[begin] == _BORDER]


@lru_cache(2)
def subwords(path: str) -> Subwords:
    """One encoder for each Python worker and file."""
    return Subwords(path)
