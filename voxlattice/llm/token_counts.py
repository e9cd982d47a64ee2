"""Token counts of whole texts, without their tokens: batch encoding in Arrow functions that return lengths only.

No row is shuffled: each task reads its Arrow batches, regroups their texts into chunks with about the same number of
bytes, whatever the rows, and returns a number a row. Texts are cut at boundaries that no token can cross, so a text of
any length is worked on in pieces of bounded size; what lies between two boundaries is a word. The library encodes each
different word of a task once, in batches balanced by bytes, and only the number of its tokens is remembered.

A boundary is safe by what the tokenizer's file says, not by trial:

* `.json` files that drop white space before the merges (white space is a separator of the pattern and is removed):
  at ASCII white space; within a run without any, before an ASCII digit if numbers stand alone in the pattern.
* byte-level `.json` files with the usual pattern: before a space that follows something else than white space.
* `.model` files in which no piece holds the space mark anywhere but at its start: before a space between two ASCII
  letters or digits.

With any other file, texts are encoded whole. Special strings inside texts are handled as the library does by default.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); bytes that are not UTF-8 count as U+FFFD; null
ids are returned as they are; equal rows are separate rows; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed

#: The patterns whose matches no boundary of ours cuts.
_WORDS_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts are cut into pieces of about so many bytes; chunks and the library's batches hold about as many.
PIECE, BATCH = 1 << 18, 1 << 16
#: Different words remembered at most, and the longest of them in bytes.
WORDS, LONGEST = 600_000, 64
#: Between a Latin letter and an ASCII sign: the pattern splits there, whatever stands around.
_SIGN = re.compile(rb"(?:(?<=[A-Za-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))(?=[!-/:-@\[-`{-~])")


class Memory:
    """Words and their numbers of tokens. When it holds WORDS, it becomes the older half, from which words that come up
    again are taken over; the half before that is forgotten."""

    def __init__(self):
        self.now: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def without(self, words: set[bytes]) -> list[bytes]:
        """The words that are not known; the others are in `now` afterwards."""
        if len(self.now) > WORDS:
            self.older, self.now = self.now, {}
        fresh = []
        for word in words.difference(self.now):
            if word in self.older:
                self.now[word] = self.older[word]
            else:
                fresh.append(word)
        return fresh


class Lengths:
    """counts(texts as bytes) -> tokens of each."""

    def __init__(self, path: str):
        self.known, self.forms = Memory(), Memory()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda words: [len(x) for x in model.encode(words, num_threads=1)]
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            plain = all("▁" not in p.lstrip("▁") for p in pieces)
            marked = model.encode("a", out_type=str)[0].startswith("▁")
            self._cut = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])") if plain and marked else None
            self._fold = self._merge = None
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._encode = lambda words: [len(x) for x in library.encode_batch_fast(words, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self._cut = self._fold = self._merge = None
        added = said.get("added_tokens") or []
        # A boundary inside an added token would break it; one beside it could take white space from its side.
        apart = all(not re.search(r"[\s\d]", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        kinds, split = self._kinds(said.get("normalizer")), self._kinds(said.get("pre_tokenizer"))
        if not apart:
            return
        if kinds == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]:
            how = said["pre_tokenizer"]["pretokenizers"][0]
            space = said["normalizer"]["normalizers"][1]
            if how["pattern"].get("Regex") == _WORDS_ALONE and how["invert"] and how["behavior"] == "Removed" and (space["pattern"].get("Regex"), space["content"]) == (r"\s+", " "):
                self._cut = re.compile(rb"[ \t-\r]+|(?=[0-9])")
                self._fold, self._merge = self._parts, library.model.tokenize
        elif not kinds and split == ["ByteLevel"] and said["pre_tokenizer"].get("use_regex") and not said["pre_tokenizer"].get("add_prefix_space"):
            self._cut = re.compile(rb"(?<=[!-~])(?= [!-~])")

    @staticmethod
    def _kinds(part: dict | None) -> list[str]:
        inner = (part or {}).get("normalizers") or (part or {}).get("pretokenizers")
        return [x["type"] for x in inner] if inner else [part["type"]] if part else []

    @staticmethod
    def _parts(word: bytes) -> list[bytes]:
        """A word in lower case, cut between letters and signs: far fewer forms than words. A special string may stand in
        a word with `<`, which stays as it is."""
        return [word] if b"<" in word else _SIGN.split(word.lower())

    def pieces(self, text: bytes):
        """The text in pieces of about PIECE bytes, cut at safe boundaries."""
        at = 0
        while self._cut and len(text) - at > PIECE:
            cut = self._cut.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def words(self, piece: bytes) -> list[bytes]:
        if not self._fold:
            return self._cut.split(piece) if self._cut else [piece]
        found = piece.split()  # bytes split at ASCII white space alone
        if max(map(len, found), default=0) <= LONGEST:
            return found
        return [x for word in found for x in ([word] if len(word) <= LONGEST else self._cut.split(word))]

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [self.words(x) for x in texts]
        fresh = self.known.without({w for words in split for w in words if len(w) <= LONGEST})
        known = self.known.now
        if self._fold:
            parts = [self._fold(w) for w in fresh]
            forms = self._encoded(self.forms.without({p for own in parts for p in own}), self.forms.now)
            known.update((w, sum(map(forms.__getitem__, own))) for w, own in zip(fresh, parts, strict=True))
        else:
            self._encoded(fresh, known)
        if long := {w for words in split for w in words if len(w) > LONGEST}:
            rest = self._encoded(list(long), {})
            return [sum(rest[w] if len(w) > LONGEST else known[w] for w in words) for words in split]
        return [sum(map(known.__getitem__, words)) for words in split]

    def _encoded(self, words: list[bytes], into: dict[bytes, int]) -> dict[bytes, int]:
        if self._merge:
            # ASCII letters alone are one match of the pattern and their own byte symbols: only the merges are left.
            into.update((w, len(self._merge(w.decode()))) for w in words if w.isalpha())
            words = [w for w in words if not w.isalpha()]
        for batch in self._batches(words):
            into.update(zip(batch, self._encode([w.decode("utf-8", "replace") for w in batch]), strict=True))
        return into

    @staticmethod
    def _batches(words: list[bytes]):
        """Runs of words with about BATCH bytes each; a longer word stands alone."""
        begin, size = 0, 0
        for i, word in enumerate(words):
            if size and size + len(word) > BATCH:
                yield words[begin:i]
                begin, size = i, 0
            size += len(word) + 1
        if begin < len(words):
            yield words[begin:]


@lru_cache(2)
def lengths(path: str) -> Lengths:
    """One encoder for each Python worker and file."""
    return Lengths(path)


def _counted(texts: list[bytes], own: Lengths) -> np.ndarray:
    """Tokens of each text: pieces are gathered into chunks of about PIECE bytes, a long text over several of them."""
    out = np.zeros(len(texts), np.int64)
    chunk, rows, size = [], [], 0

    def flush() -> None:
        np.add.at(out, rows, own.counts(chunk))
        chunk.clear()
        rows.clear()

    for i, text in enumerate(texts):
        for piece in own.pieces(text):
            if size and size + len(piece) > PIECE:
                flush()
                size = 0
            chunk.append(piece)
            rows.append(i)
            size += len(piece)
    if chunk:
        flush()
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row. `path`: a tokenizer's .json or a
    sentencepiece .model, on every executor."""
    Scratch(docs.sparkSession, "tokens")  # rows in an Arrow batch, as all operators here have them

    @freed
    def run(batches):
        own = lengths(path)
        for batch in batches:
            ids, texts = batch.columns
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
            n_tokens = np.empty(len(ids), np.int64)
            # A batch's texts become Python objects a few at a time.
            ends = np.cumsum(n_bytes.to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * PIECE, "right")))
                n_tokens[at:to] = _counted([x or b"" for x in texts.slice(at, to - at).to_pylist()], own)
                at = to
            yield pa.RecordBatch.from_arrays([ids, n_bytes.cast(pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
