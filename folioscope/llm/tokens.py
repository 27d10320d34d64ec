"""Whole-text tokenisation with the tokenizers library, with a memo of its answers.

A byte-level or word-level BPE never merges across the borders of its
pre-tokens. Both supported pipelines put such a border at every step from
other characters to white space, so a text's ids are those of its chunks one
after the other, and a chunk (mostly a word) seen before needs no new call.
Of many texts, distinct words are found by Arrow and looked up once (``batch``).
Texts for which that does not hold are given to the library whole: those with
the string of an added token, or with white space other than space, tab,
newline and carriage return.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are looked up together, each distinct one once.
SLICE_BYTES = 2 << 20
#: Chunks kept in each of the memo's two generations; bounds a worker's memory.
MEMO_CHUNKS = 400_000
#: Chunks that a worker between two tasks keeps in each memo: it may wait for long beside others.
RESTING_CHUNKS = 150_000
#: Chunks in each generation where other stages' workers and a full heap share an executor's memory.
SHARED_CHUNKS = 50_000
#: ASCII punctuation; apostrophes begin pre-tokens of their own kind.
TAIL = string.punctuation.replace("'", "")
#: Letters below U+0100: no normaliser changes them but by case, and that letter by letter.
LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha())
#: Chunks longer than this are not kept.
MEMO_CHARS = 64

_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_BYTE_CHUNK = re.compile(r" ?[^ \n\r\t]+|[ \n\r\t]+(?![^ \n\r\t])|[ \n\r\t]+")
#: Words of such letters and the punctuation after them; longer ones are not kept.
_SIMPLE = f"^[{LETTERS}]{{1,{MEMO_CHARS}}}[{re.escape(TAIL)}]{{0,{MEMO_CHARS}}}$"
_ID = attrgetter("id")
_BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def has_runs(text: str) -> bool:
    """Is there white space other than single spaces and line breaks?"""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def picked(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Memo(dict):
    """Two generations of answers: the older is dropped when the younger is full."""

    def __init__(self, answer, most: int = MEMO_CHUNKS):
        super().__init__()
        self.answer, self.most, self.old = answer, most, {}

    def __missing__(self, chunk):
        found = self.old.get(chunk)
        if found is None:
            found = self.answer(chunk)
            if len(chunk) > MEMO_CHARS:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def rest(self, most: int = RESTING_CHUNKS) -> None:
        """Keeps the answers that came first, which are those of frequent chunks."""
        self.old = {}
        if len(self) > most:
            first = dict(islice(self.items(), most))
            self.clear()
            self.update(first)


class Pool:
    """Answers for lists of words: their ids in one array, in the order in which the words came.

    When it is full, the words that came first stay, which are the frequent ones.
    """

    def __init__(self, answers, most: int):
        self.answers, self.most = answers, most
        self.numbers, self.ids, self.ends = _numbers({}), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the ids of each of these distinct words are, until the next call: (starts, lengths)."""
        if len(self.numbers) > self.most:
            self.rest(self.most // 2)
        words, known = words.to_numpy(zero_copy_only=False), len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        new = words[at >= known].tolist()
        if new:
            ids, sizes = self.answers(new)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return self.ends[at], self.ends[at + 1] - self.ends[at]

    def rest(self, most: int = RESTING_CHUNKS) -> None:
        if len(self.numbers) > most:
            self.numbers = _numbers(islice(self.numbers.items(), most))
            self.ends = self.ends[: most + 1].copy()
            self.ids = self.ids[: self.ends[-1]].copy()


def _numbers(first) -> defaultdict:
    """A table that gives each new word the next number."""
    numbers = defaultdict(None, first)
    numbers.default_factory = count(len(numbers)).__next__
    return numbers


class Encoder:
    """ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, most: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        byte = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        word = pre.get("type") == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]
        self.kind = "byte" if byte else "word" if word else "whole"
        self.alphabet = byte_alphabet()
        self.translation = dict(enumerate(self.alphabet))
        self.tails = Memo(self._library, most)
        self.lead = self.alphabet[32] if byte else ""
        self.cores = Pool(self._pieces, 2 * most)
        if byte:
            self.first = Memo(lambda w: self._word(w, w, "", w), most)
            self.after = Memo(lambda w: self._word(w, w, self.alphabet[32], " " + w), most)
            self.chunks = Memo(self._library, most)
            self.newline = self._library("\n")
        else:
            self.first = Memo(lambda w: self._word(w, w.lower(), "", w), most)

    def rest(self) -> None:
        """Gives back most of what the memos hold; a worker outlives its tasks."""
        for memo in vars(self).values():
            if isinstance(memo, Memo | Pool):
                memo.rest()

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str, lead: str = "") -> list[int]:
        """ids of one pre-token by the model alone."""
        if not text.isascii() or not text.isalpha():
            text = text.encode().decode("latin-1").translate(self.translation)
        return [t.id for t in self.model.tokenize(lead + text)]

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, each by the model alone, and how many each has."""
        tokenize, lead, ids, sizes = self.model.tokenize, self.lead, array("I"), []
        for w in words:
            found = tokenize(lead + (w if w.isascii() else w.encode().decode("latin-1").translate(self.translation)))
            ids.extend(map(_ID, found))
            sizes.append(len(found))
        return np.frombuffer(ids, "<u4"), np.array(sizes, np.int64)

    def _word(self, word: str, folded: str, lead: str, whole: str) -> bytes:
        """Plain letters and the ASCII punctuation after them are a pre-token each."""
        core = folded.rstrip(TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "\u0100" or (lead or folded is word) and max(core) < "\u0250"):
            tail = folded[len(core) :]
            return array("I", self.piece(core, lead)).tobytes() + (self.tails[tail] if tail else b"")
        return self._library(whole)

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of one text; null counts as empty."""
        return np.frombuffer(self.raw(text), "<u4")

    def regular(self, text: str) -> bool:
        """Do the ids of the text's chunks make up its ids?"""
        return self.kind != "whole" and not _RARE_SPACE.search(text) and not any(s in text for s in self.specials)

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.regular(text):
            return self._library(text)
        if self.kind == "word":
            return b"".join(map(self.first.__getitem__, text.split()))
        if has_runs(text):
            return b"".join(map(self.chunks.__getitem__, _BYTE_CHUNK.findall(text)))
        lines, after = [], self.after.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append((self.first[words[0]] if words[0] else b"") + b"".join(map(after, words[1:])))
        return self.newline.join(lines)

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``ids`` of each text of a string array. A slice's distinct words are looked up once, those
        of plain letters without the punctuation after them and, if the vocabulary has one case, lower-cased."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._slice(texts.slice(a, b - a))

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        strings, byte = texts.to_pylist(), self.kind == "byte"
        plain = [bool(t) and self.regular(t) and not (byte and has_runs(t)) for t in strings]
        if not any(plain):
            return [self.ids(t) for t in strings]
        rows = texts.filter(pa.array(plain))
        if byte:  # a word that begins a line keeps the line break before it, and the text gets one
            rows = pc.binary_join_element_wise("\n", pc.replace_substring(rows, "\n", " \n"), "")
        words = pc.split_pattern(rows, " ") if byte else pc.ascii_split_whitespace(rows)
        coded = words.flatten().dictionary_encode()
        flat, start, length = self._answers(coded.dictionary)
        code = coded.indices.to_numpy()
        start, length = start[code], length[code]
        cuts = words.offsets.to_numpy()
        if byte:
            start[cuts[:-1]] += len(self.newline) // 4
            length[cuts[:-1]] -= len(self.newline) // 4
        ids = picked(flat, start, length)
        ends = np.append(0, np.cumsum(length))[cuts].tolist()
        own = zip(ends, ends[1:], strict=False)
        return [ids[slice(*next(own))] if p else self.ids(t) for p, t in zip(plain, strings, strict=True)]

    def _answers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words as runs of one array: (array, starts, lengths)."""
        simple = pc.match_substring_regex(words, _SIMPLE)
        some, others = words.filter(simple), words.filter(pc.invert(simple)).to_numpy(zero_copy_only=False)
        core, tail = pc.utf8_rtrim(some, TAIL), pc.utf8_ltrim(some, LETTERS).dictionary_encode()
        core = (core if self.kind == "byte" else pc.utf8_lower(core)).dictionary_encode()
        simple, core_at, tail_at = simple.to_numpy(zero_copy_only=False), core.indices.to_numpy(), tail.indices.to_numpy()
        core_start, core_length = self.cores.runs(core.dictionary)
        tails = [self.tails[t] if t else b"" for t in tail.dictionary.to_pylist()]
        found = [*tails, *map(self._other, others)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size + len(self.cores.ids)
        # Each word is two runs: a core's and a tail's, or none and its own.
        start, length = np.zeros((2, len(words), 2), np.int64)
        start[simple, 0], length[simple, 0] = core_start[core_at], core_length[core_at]
        start[simple, 1], length[simple, 1] = begin[tail_at], size[tail_at]
        start[~simple, 1], length[~simple, 1] = begin[len(tails) :], size[len(tails) :]
        flat = picked(np.concatenate([self.cores.ids, np.frombuffer(b"".join(found), "<u4")]), start.ravel(), length.ravel())
        length = length.sum(axis=1)
        return flat, np.cumsum(length) - length, length

    def _other(self, word: str) -> bytes:
        """A word by the memo of whole words; one that begins a line has the line break before it."""
        if self.kind == "word":
            return self.first[word] if word else b""
        if word[:1] != "\n":
            return self.after[word]
        return self.newline + (self.first[word[1:]] if len(word) > 1 else b"")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = MEMO_CHUNKS) -> Encoder:
    """One encoder per worker process, file and size of its memos."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
