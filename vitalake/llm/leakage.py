"""Evaluation passages inside training documents, by suffix arrays over shards of the corpus.

Each shard (a bounded run of documents of one task) becomes one array of word ids over the vocabulary of
the test items; words outside it are 0 and match nothing. Its suffix array holds every position that begins a
*seed* of some item, sorted by rank doubling (seeds, then twice, four times, ... as many words). Every test
suffix is binary-searched at each length, up to the longest at which one is found, and the ranks tell how far
each match goes on, so all longest verbatim matches and where they lie are known.

The seed of an item is what no passage can be without: a passage of at least half of the item's words, a share
``MISSPELT`` of them broken, holds one unbroken run of at least that length (the pigeonhole principle), and at
least ``needed`` different seeds in all. Documents with fewer are not looked at further; that loses nothing, for
items of any length.

The matches on one diagonal (same document, item and offset) are then joined across misspelt words into
stretches, and stretches of neighbouring diagonals across words that were put in, dropped, split or run
together into the longest continuous passage.

The items are held in blocks of ``BLOCK`` against all documents, so their number is not bound by memory.
Documents with null or empty text, and items without words, have no rows. The shuffle-free scan is one
narrow pass over the corpus per block of items.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.mail_text import readable

BLOCK = 5_000
SHARD_ROWS = 1_000
#: A passage counts from this share of an item's words on.
SHARE = 0.5
#: Share of a passage's words that may be misspelt.
MISSPELT = 0.25
#: Two stretches are joined if they lie at most ``REACH`` words apart, at most ``FOREIGN`` of which are not the item's.
REACH, FOREIGN = 8, 3
#: Longest seed in words.
SEED = 3

_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MARKS = re.compile(r"[^\x00-\x7f\w]+")


def words(text: str) -> list[bytes]:
    """Lower-case words of a text; everything but letters and digits parts them."""
    text = text.lower() if text.isascii() else _MARKS.sub(" ", text.casefold())
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split()


@functools.lru_cache(maxsize=200_000)
def _close(a: bytes, b: bytes, most: int = 2) -> bool:
    """Whether one is the other with at most ``most`` typing slips (swaps count once)."""
    most = min(most, max(1, len(b) // 3))
    # a slip changes the length by one at most, and the set of letters by two
    if abs(len(a) - len(b)) > most or a.isdigit() or b.isdigit() or len(set(a) ^ set(b)) > 2 * most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1] <= most


def seed_of(n_words: int) -> tuple[int, int]:
    """(words of a seed, different seeds needed) of an item of so many words.

    A passage has at least half of the words, rounded up; k of them may be broken, which leaves k + 1 runs and
    breaks as many seeds as a seed has words. The least over all lengths is that of one of the first four.
    """
    lengths = [(n, int(n * MISSPELT)) for n in range(-(-n_words // 2), min(n_words, -(-n_words // 2) + 3) + 1)]
    seed = max(1, min(SEED, *(-(-(n - k) // (k + 1)) for n, k in lengths)))
    return seed, max(1, min(n - (seed - 1) - seed * k for n, k in lengths))


@dataclass
class Items:
    """Test items as word ids, with their suffixes ready for the search."""

    ids: list[int]
    words: list[list[bytes]]

    def __post_init__(self):
        vocabulary = sorted({w for x in self.words for w in x})
        self.of = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.seq = [np.array([self.of[w] for w in x], dtype=np.int64) for x in self.words]
        self.size = np.array([len(s) for s in self.seq], dtype=np.int64)
        self.seed, self.needed = (np.array(x, dtype=np.int64) for x in zip(*map(seed_of, self.size))) if self.seq else (np.zeros(0, np.int64),) * 2
        # all items in one row, ``SEED`` zeros after each
        self.begin = np.cumsum(self.size + SEED) - self.size - SEED
        self.flat = np.zeros(int((self.size + SEED).sum()) + SEED, np.int64)
        for a, s in zip(self.begin, self.seq):
            self.flat[a : a + len(s)] = s
        self.item = np.repeat(np.arange(len(self.seq)), self.size)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = self.begin[self.item] + self.at
        # the distinct pairs, and the triples of a pair and a word: their ranks are in the order of the words
        pair = _pack(self.flat[:-1], self.flat[1:])
        self.pairs = np.unique(pair[pair > 0])
        two = np.append(_rank(pair, self.pairs), 0)
        triple = _pack(two[:-2], self.flat[2:])
        self.triples = np.unique(triple[triple > 0])
        self.ranks = {1: self.flat, 2: two, 3: np.concatenate([_rank(triple, self.triples), np.zeros(2, np.int64)])}
        #: Ranks of the runs that are seeds, by their length.
        self.seeds = {n: np.unique(r[r > 0]) for n in (1, 2, 3) for own in [self.place[self.seed[self.item] == n]] for r in [self.ranks[n][own]]}


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ranks as one number in the order of both; 0 where either is 0."""
    return np.where((a > 0) & (b > 0), a << 31 | b, 0)


def _rank(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place from 1 on of each key among the known ones, which are sorted; 0 where it is none."""
    if not len(known):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at + 1, 0)


class Shard:
    """Suffix array over a run of documents."""

    def __init__(self, items: Items, texts: list[str | None]):
        get = items.of.get
        parts, starts, at = [], [], 0
        for t in texts:
            starts.append(at)
            row = [get(w, 0) for w in words(readable(t))] if t else []
            row.append(0)
            parts.append(np.array(row, dtype=np.int64))
            at += len(row)
        self.items = items
        self.starts = np.array([*starts, at], dtype=np.int64)
        self.ids = np.concatenate([*parts, np.zeros(SEED, np.int64)])
        pair = _pack(self.ids[:-1], self.ids[1:])
        two = np.append(_rank(pair, items.pairs), 0)
        three = np.concatenate([_rank(_pack(two[:-2], self.ids[2:]), items.triples), np.zeros(2, np.int64)])
        self.ranks = {1: self.ids, 2: two, 3: three}
        begins = np.zeros(len(self.ids), bool)
        for n, known in items.seeds.items():
            begins |= _rank(self.ranks[n], known) > 0
        where = np.flatnonzero(begins)
        # rank doubling: the places of the corpus and of the test suffixes side by side, as long as a test suffix is found
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = [(3, three, items.ranks[3])]
        n, own, test = 3, three, items.ranks[3]
        while True:
            key = _pack(own[where], own[np.minimum(where + n, len(own) - 1)])
            known = np.unique(key[key > 0])
            found = _rank(_pack(test[items.place], test[np.minimum(items.place + n, len(test) - 1)]), known)
            if not found.any():
                break
            own, test = np.zeros_like(own), np.zeros_like(test)
            own[where], test[items.place] = _rank(key, known), found
            n *= 2
            self.levels.append((n, own, test))
        # the longest runs are in the order of all that is shorter, but for suffixes that match nothing longer
        self.suffix = where[np.lexsort([level[where] for _, level, _ in self.levels[::-1]] + [two[where], self.ids[where]])]

    def _ranges(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(test suffixes whose item has seeds of n words, suffixes of the corpus, begin and end there of those that begin with the same seed)."""
        it = self.items
        which = np.flatnonzero(it.seed[it.item] == n)
        seed = it.ranks[n][it.place[which]]
        which, seed = which[seed > 0], seed[seed > 0]
        key = self.ranks[n][self.suffix]
        suffix, key = self.suffix[key > 0], key[key > 0]
        return which, suffix, np.searchsorted(key, seed, "left"), np.searchsorted(key, seed, "right")

    def _length(self, pos: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that the corpus from ``pos`` and the items from ``place`` have in common."""
        n = np.zeros(len(pos), np.int64)
        for size, own, test in [*self.levels[:0:-1], *((k, self.ranks[k], self.items.ranks[k]) for k in (3, 2, 1))]:
            a, b = own[np.minimum(pos + n, len(own) - 1)], test[np.minimum(place + n, len(test) - 1)]
            n += np.where((a == b) & (a > 0), size, 0)
        return n

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place in the shard, place in the item, words) of the longest verbatim matches, of all
        documents that hold as many different seeds of an item as a passage must have."""
        it, rows = self.items, []
        for n in it.seeds:
            which, suffix, lo, hi = self._ranges(n)
            m = hi - lo
            test = np.repeat(which, m)
            pos = suffix[np.arange(len(test)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)]
            doc = np.searchsorted(self.starts, pos, "right") - 1
            pair = doc * len(it.seq) + it.item[test]
            once = np.unique(np.stack([pair, it.at[test]], 1), axis=0)[:, 0]
            some, count = np.unique(once, return_counts=True)
            some = some[count >= it.needed[some % len(it.seq)]]
            keep = np.isin(pair, some)
            doc, test, pos = doc[keep], test[keep], pos[keep]
            # runs that could begin one word earlier are part of a longer match
            first = (self.ids[pos - 1] != it.flat[it.place[test] - 1]) | (it.at[test] == 0) | (pos == self.starts[doc])
            doc, test, pos = doc[first], test[first], pos[first]
            rows.append(np.stack([doc, it.item[test], pos, it.at[test], self._length(pos, it.place[test])], 1))
        out = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        out = out[np.lexsort([out[:, 2], out[:, 2] - out[:, 3], out[:, 1], out[:, 0]])]
        return tuple(out.T)


def leaks(items: Items, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(document's index, item's index, words carried, offset in the document's words)."""
    shard = Shard(items, texts)
    doc, item, pos, at, size = shard.matches()
    edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else []
    seen: dict[int, list[bytes]] = {}
    there = np.zeros(len(items.of) + 1, bool)
    for a, z in zip(edges, [*edges[1:], len(doc)]):
        k, j = int(doc[a]), int(item[a])
        test, best = items.words[j], (0, 0)
        if k not in seen:
            seen = {k: words(readable(texts[k]))}
        own, offsets = seen[k], pos[a:z] - at[a:z]
        # stretches that can be joined lie on offsets at most REACH apart
        parted = a + np.flatnonzero(np.append(True, np.diff(offsets) > REACH))
        for b, y in zip(parted, [*parted[1:], z]):
            if (size[b:y] - items.seed[j] + 1).sum() < items.needed[j]:
                continue
            lo, hi = int(pos[b] - at[b]), int(pos[y - 1] - at[y - 1]) + len(test)
            # too few of the item's words lie there, even if every tolerated slip is one
            near = shard.ids[max(lo, shard.starts[k]) : min(hi, shard.starts[k + 1])]
            there[near] = True
            few = there[items.seq[j]].sum() < len(test) * SHARE * (1 - MISSPELT)
            there[near] = False
            if few:
                continue
            parts = []
            for off in np.unique(offsets[b - a : y - a]).tolist():
                base = off - int(shard.starts[k])
                on = np.flatnonzero(offsets[b - a : y - a] == off) + b
                parts += _diagonal(base, [(int(at[i]), int(at[i] + size[i])) for i in on], own, test, int(items.seed[j]))
            best = max(best, _chain(parts, own, test))
        if best[0] >= SHARE * len(test):
            yield k, j, *best


def _diagonal(base: int, runs: list[tuple[int, int]], own: list[bytes], test: list[bytes], seed: int) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Stretches (offset, begin and end in the item, words carried, those misspelt) of one diagonal with its verbatim runs."""
    row, slip = np.zeros(len(test), bool), np.zeros(len(test), bool)
    for x, y in runs:
        row[x:y] = True
    for x in np.flatnonzero(~row[max(0, -base) : len(own) - base]).tolist():
        x += max(0, -base)
        if own[base + x] == test[x]:
            row[x] = True
        elif abs(len(own[base + x]) - len(test[x])) <= 2 and _close(own[base + x], test[x]):
            row[x] = slip[x] = True
    return [(base, x, y, row, slip) for n, x, y in _stretches(row) if n >= seed]


def _stretches(row: np.ndarray) -> list[tuple[int, int, int]]:
    """(words, begin, end) of the stretches of equal or misspelt words; one foreign word inside is bridged but not counted."""
    out: list[tuple[int, int, int]] = []
    for x in np.flatnonzero(row).tolist():
        if out and x - out[-1][2] <= 1:
            out[-1] = (out[-1][0] + 1, out[-1][1], x + 1)
        else:
            out.append((1, x, x + 1))
    return out


def _between(a: list[bytes], b: list[bytes]) -> tuple[int, int]:
    """(words of b found in a in their order, those of them that are misspelt); words split or run together count as misspelt."""
    if a and b and b"".join(a) == b"".join(b):
        return len(b), sum(y not in a for y in b)
    last = [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            best = max(last[j + 1], row[-1])
            if x == y or _close(x, y):
                best = max(best, (last[j][0] + 1, last[j][1] - (x != y)))
            row.append(best)
        last = row
    return last[-1][0], -last[-1][1]


def _chain(parts: list[tuple[int, int, int, np.ndarray, np.ndarray]], own: list[bytes], test: list[bytes]) -> tuple[int, int]:
    """(words, begin in the document) of the longest passage, of stretches (offset, begin and end in the item, words carried, those misspelt).

    A stretch follows another that ends shortly before it in the document and in the item; where they overlap, the
    first keeps the words.
    """
    parts = sorted(parts, key=lambda p: (p[0] + p[1], p[0]))
    best, done = (0, 0), []
    for i, (base, x, y, row, slip) in enumerate(parts):
        ends = [(int(row[x:y].sum()), -int(slip[x:y].sum()), base + x)]
        for h in range(i - 1, -1, -1):
            base_h, x_h, y_h = parts[h][:3]
            if base_h + x_h + len(test) + REACH < base + x:
                break
            cut = max(0, y_h - x, base_h + y_h - base - x)
            gap, gap_own = x + cut - y_h, base + x + cut - base_h - y_h
            if x + cut >= y or max(gap, gap_own) > REACH:
                continue
            filled, bad = _between(own[base_h + y_h : base + x + cut], test[y_h : x + cut])
            if max(gap, gap_own) - filled <= (FOREIGN if base != base_h else 1):
                n, slips, at = done[h]
                ends.append((n + filled + int(row[x + cut : y].sum()), slips - bad - int(slip[x + cut : y].sum()), at))
        done.append(max(ends))
        best = max([best, *((n, at) for n, slips, at in ends if -slips <= MISSPELT * n)])
    return best


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key, n_words, at_word): documents that carry an item wholly or half of its words in a row.

    ``n_words`` counts the item's words in the passage and ``at_word`` is where it begins in the document.
    A document with several copies of an item has one row for it, the longest. Repeated items are found
    each for itself. The items (a fixed test suite) are read to the driver in blocks.
    """
    rows = items.where(F.col(item_text).isNotNull()).select(item_key, item_text).orderBy(item_key).toLocalIterator()
    blocks, block = [], []
    for r in rows:
        if len(w := words(readable(r[1]))) >= 1:
            block.append((r[0], w))
        if len(block) == BLOCK:
            blocks.append(block)
            block = []
    blocks += [block] if block or not blocks else []
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    docs = documents.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"{key} {kinds[0]}, {item_key} {kinds[1]}, n_words int, at_word int"
    types = [docs.sparkSession.createDataFrame([], schema).schema]

    def scan(block: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = Items([x[0] for x in block], [x[1] for x in block])
            for b in batches:
                for at in range(0, b.num_rows, SHARD_ROWS):
                    keys, texts = b.column(0).slice(at, SHARD_ROWS), b.column(1).slice(at, SHARD_ROWS).to_pylist()
                    got = list(leaks(test, texts))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([g[0] for g in got], pa.int64())), pa.array([test.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32())],
                        names=[key, item_key, "n_words", "at_word"],
                    )

        return docs.mapInArrow(run, types[0])

    out = scan(blocks[0])
    for more in blocks[1:]:
        out = out.unionByName(scan(more))
    return out


def remove_leaked(documents: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The documents that carry no item."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
