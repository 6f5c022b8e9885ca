"""Token ids of the whole corpus by a public byte-level BPE tokenizer.

The encoder is a dynamic program over byte prefixes. Every prefix of a word has exactly one BPE
encoding, and so exactly one last token; ``last[i]`` stores it for the first i bytes. The last token of
prefix i is the one token t that ends there and is *compatible* with the last token of the prefix before
it, that is, BPE would not have merged across the border between the two. Ids are read off backwards.
Because only the tail of the table depends on the tail of the text, bytes can be appended exactly, and
after an edit only the part from the edit on is filled again (:class:`PrefixEncoder`).

Words are cut by the tokenizer's own pattern, and BPE never crosses them, so distinct words are encoded
once per task and looked up afterwards. A null or empty text has an empty list of ids.
"""

from __future__ import annotations

import base64
import functools
import importlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of distinct words kept per task; past this the table starts anew, which costs time and changes no result.
MEMO_WORDS = 400_000
_INF = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE: the id of a token is its rank, lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        # lengths of the tokens that end in two given bytes, longest first: the only ones worth trying there
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 1:
                ends.setdefault(t[-2:], {1}).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        lines = Path(path).read_bytes().split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; null for single bytes."""
        if token not in self._split:
            text = self.bytes_of[token]
            self._split[token] = None if len(text) == 1 else self._last_merge(text, token)
        return self._split[token]

    def _last_merge(self, text: bytes, token: int) -> tuple[int, int]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _INF))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart when their bytes meet.

        Walks down the two merge histories along the border: at each step the later of the two merges is
        undone; a merge across the border of lower rank than the undone one would have come first.
        """
        key = left << 20 | right
        if (known := self._fits.get(key)) is not None:
            return known
        a, b, limit = left, right, _INF
        fits = True
        while fits:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _INF) < limit:
                fits = False
                break
            halves_a, halves_b = self.split(a), self.split(b)
            if halves_a is None and halves_b is None:
                break
            # of equal ranks the left one merges first, so a merge inside b loses ties to one across the border
            if halves_b is None or (halves_a is not None and a > b):
                limit, a = a, halves_a[1]
            else:
                limit, b = b + 1, halves_b[0]
        self._fits[key] = fits
        return fits


class PrefixEncoder:
    """The last token of every byte prefix of one word, for exact appends and re-encoding near edits."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.v, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> PrefixEncoder:
        """Adds bytes at the end; nothing before them is filled again."""
        v, start = self.v, len(self.text)
        self.text += more
        text, last, ranks, lengths, fits = self.text, self.last, v.ranks, v.lengths, v._fits
        for end in range(start + 1, len(text) + 1):
            for n in lengths.get(text[max(0, end - 2) : end], (1,)):
                begin = end - n
                if begin < 0 or (token := ranks.get(text[begin:end])) is None:
                    continue
                if begin == 0 or fits.get(last[begin] << 20 | token) or v.compatible(last[begin], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return self

    def edit(self, begin: int, end: int, new: bytes) -> PrefixEncoder:
        """Replaces the bytes from ``begin`` to ``end``; the table is kept up to ``begin``."""
        tail = self.text[end:]
        self.text, self.last = self.text[:begin], self.last[: begin + 1]
        return self.append(new + tail)

    def ids(self, upto: int | None = None) -> list[int]:
        """Ids of the whole word, or of its first ``upto`` bytes."""
        at, out = len(self.text) if upto is None else upto, []
        while at:
            out.append(self.last[at])
            at -= len(self.v.bytes_of[self.last[at]])
        return out[::-1]


class Encoder:
    """Whole texts: cuts words by the tokenizer's pattern and encodes each distinct one by prefixes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = MEMO_WORDS):
        self.v, self.words, self.memo = vocabulary, regex.compile(pattern), memo
        self.known: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= self.memo:
                self.known.clear()
            raw = word.encode("utf-8", "surrogatepass")
            token = self.v.ranks.get(raw)
            if token is not None and len(raw) == 1:
                ids = [token]
            else:
                ids = PrefixEncoder(self.v, raw).ids()
            self.known[word] = ids
        return ids

    def chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for w in self.words.findall(chunk):
            out += self.known.get(w) or self.word(w)
        return out

    def encode(self, text: str | None) -> list[int]:
        """A blank between two characters that are no white space always begins a word, so the text falls
        into chunks there, most of which are known already."""
        if not text:
            return []
        out: list[int] = []
        chunks, get = self.chunks, self.chunks.get
        pieces = text.split(" ")
        held = pieces[0]
        for piece in pieces[1:]:
            # a piece can stand alone if no white space touches the blank on either side
            if not piece or not held or held[-1].isspace() or piece[0].isspace():
                held += " " + piece
                continue
            ids = get(held)
            if ids is None:
                ids = self.chunk(held)
                if len(held) <= 40:
                    if len(chunks) >= self.memo:
                        chunks.clear()
                    chunks[held] = ids
            out += ids
            held = " " + piece
        out += self.chunk(held)
        return out


def tokenizer_file(name: str, folder: str | None = None) -> tuple[str, str]:
    """(path, word pattern) of a public tokenizer's rank file; ``folder`` overrides the installed place."""
    public = importlib.import_module("public_tokenizers")
    path = f"{folder}/{name}.tiktoken" if folder else public.path(f"{name}.tiktoken")
    return str(path), public.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(name: str, folder: str | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    path, pattern = tokenizer_file(name, folder)
    return Encoder(Vocabulary.from_file(path), pattern)


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>): one row per row of ``df``, in one narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        import numpy as np

        enc = encoder(name, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                flat, ends = array.array("i"), [0]
                for t in texts[at : at + 500]:
                    flat.extend(enc.encode(t.as_py()))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([keys[at : at + 500], lists], names=["key", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_column(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, raw binary): the bytes that each row's ids stand for; none for an empty list, null for a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(name, folder).v.bytes_of
        for batch in batches:
            raw = [None if x is None else b"".join(map(texts.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["key", "raw"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, raw binary").select(F.col("key").alias(key), "raw")
