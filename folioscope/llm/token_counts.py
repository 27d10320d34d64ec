"""Token counts by the whole-token shortcut.

Offline, once per vocabulary and on the driver: a vocabulary string that is one
pre-token and that the library encodes alone as one token is a *whole token*.
Such a pre-token counts one without any merging; only the rest is merged. The
proved strings are broadcast; there are at most as many as the vocabulary has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import _BYTE_CHUNK, _BYTE_PATTERN, _RARE_SPACE, Memo, encoder, has_runs, tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(path: str) -> dict[str, int]:
    """{pre-token: 1} for every vocabulary string proved to encode alone as one token.

    The proof is the library's own answer for the string; strings that are not
    UTF-8 or not one pre-token of the pattern are left out.
    """
    import regex

    enc = encoder(path)
    one = regex.compile(_BYTE_PATTERN)
    back = {c: b for b, c in enumerate(enc.alphabet)}
    texts = []
    for entry in enc.library.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and one.fullmatch(text) and one.match(text).end() == len(text) and not _RARE_SPACE.search(text):
            texts.append(text)
    found = enc.library.encode_batch(texts, add_special_tokens=False)
    return {t: 1 for t, e in zip(texts, found, strict=True) if len(e.ids) == 1}


class _Whole(dict):
    """Pre-tokens that are whole tokens are found here; the rest is merged, with a memo."""

    def __init__(self, whole: dict[str, int], merge):
        super().__init__(whole)
        self.rest = Memo(merge)

    def __missing__(self, chunk: str) -> int:
        return self.rest[chunk]


class Counter:
    """Number of tokens of a whole text, as the library counts them; ``proved``: the vocabulary's whole tokens."""

    def __init__(self, path: str, proved: list[str]):
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(library.encode(text)) if text else 0
            return
        self.enc = encoder(path)
        if self.enc.kind != "byte":
            self.count = lambda text: len(self.enc.ids(text))
            return
        import regex

        self.pattern = regex.compile(_BYTE_PATTERN)
        self.whole = dict.fromkeys(proved, 1)
        self.first = _Whole({w: n for w, n in self.whole.items() if w[0] != " "} | {"": 0}, self._merge)
        self.after = _Whole({w[1:]: n for w, n in self.whole.items() if w[0] == " "}, lambda w: self._merge(" " + w))
        self.chunks = _Whole(self.whole, self._merge)
        self.count = self._count

    def _merge(self, chunk: str) -> int:
        """Pre-tokens of the chunk that are whole tokens count one; the others are merged."""
        n = 0
        if chunk[0] == " " and chunk[1:].isalpha():
            return len(self.enc.piece(chunk[1:], self.enc.alphabet[32]))
        for p in self.pattern.findall(chunk):
            n += 1 if p in self.whole else len(self.enc.piece(p))
        return n

    def _count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.enc.regular(text):
            return len(self.enc.library.encode(text, add_special_tokens=False).ids)
        if has_runs(text):
            return sum(map(self.chunks.__getitem__, _BYTE_CHUNK.findall(text)))
        n, after, lines = 0, self.after.__getitem__, text.split("\n")
        for line in lines:
            words = line.split(" ")
            n += self.first[words[0]] + sum(map(after, words[1:]))
        return n + len(lines) - 1


_COUNTERS: dict[str, Counter] = {}
_PROVED: dict[str, list[str]] = {}


def proved(path: str) -> list[str]:
    """The whole tokens of a vocabulary file, proved once a driver; none where there are no byte-level pre-tokens."""
    if path not in _PROVED:
        byte = not path.endswith(".model") and encoder(path).kind == "byte"
        _PROVED[path] = list(whole_tokens(path)) if byte else []
    return _PROVED[path]


def counter(path: str, whole: list[str]) -> Counter:
    """One counter per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 bytes and 0 tokens; a null id stays null;
    repeated rows give repeated rows; all other columns are left out, so their
    names cannot clash. Whole texts are counted, however long. No shuffle: one
    pass over the texts.
    """
    whole = df.sparkSession.sparkContext.broadcast(proved(path))

    def run(batches):
        count = counter(path, whole.value).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
