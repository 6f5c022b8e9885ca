"""Language of texts and of their lines, by prediction by partial matching.

One variable-order byte context tree per language (contexts of up to ``ORDER`` bytes, escapes by method C)
is trained on a bounded sample of labelled texts and then frozen. The code length of a byte under a tree is
exact: the cost of each escape from the longest known context down to the one that predicts it. Since the
statistics are frozen, the code lengths of all byte strings seen in training are worked out once, for all
languages side by side; scoring is then a table lookup per byte, and falls back by one order and one escape
where a string was seen in no language.

The sample's own labels are partly wrong and its texts partly mixed, so each half of its lines is re-labelled by
trees of the other half (no tree judges what it was taught), ``ROUNDS`` times, before the trees of all lines. Null and blank texts have no language; lines without letters
have none either. Letter case, digits and marks play no part.

A text that even its best language codes no shorter than plain bytes (the null model: escapes down to 8 bits a
byte) is in none of them and gets ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "fa")
UNKNOWN = "und"
ORDER, ROUNDS = 5, 3
#: Texts per label in the training sample (the smallest hashes of the key): a bound that the corpus does not move.
SAMPLE = 400
#: Bits by which a line must fit another language better than its text's own before it counts as that.
SWITCH = 7.0
_MARKS = re.compile(r"[\W\d_]+")


def level(line: str) -> bytes:
    """The bytes that are scored: lower case letters, one blank for anything else, a full context in front."""
    s = _MARKS.sub(" ", line.casefold()).strip()
    return b" " * ORDER + s.encode("utf-8", "ignore") + b" " if s else b""


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """All runs of k+1 bytes, packed; run i ends at byte i + ORDER."""
    out = np.zeros(len(data) - ORDER, np.int64)
    for j in range(k, -1, -1):
        out = out << 8 | data[ORDER - j : len(data) - j]
    return out


def _ends(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, mask of the positions that are scored, first scored position of each part)."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(data) - ORDER, bool)
    for j in range(1, ORDER + 1):
        at = starts[1:] - j
        keep[at[at >= 0]] = False
    return data, keep, starts


class Trees:
    """Frozen context trees of several languages: code lengths of all strings seen, and of all escapes."""

    def __init__(self, lines: Sequence[bytes], labels: np.ndarray, n_languages: int):
        self.n = n_languages
        self.grams: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        by = [[x for x, y in zip(lines, labels) if y == k] for k in range(n_languages)]
        packed = [_ends(b) if b else None for b in by]
        for k in range(ORDER + 1):
            counted = [np.unique(_grams(p[0], k)[p[1]], return_counts=True) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in packed]
            grams = np.unique(np.concatenate([g for g, _ in counted]))
            contexts = np.unique(grams >> 8)
            home = np.searchsorted(contexts, grams >> 8)
            bits = np.zeros((len(grams), n_languages), np.float32)
            escape = np.zeros((len(contexts), n_languages), np.float32)
            lower = self.bits[k - 1][np.searchsorted(self.grams[k - 1], grams & ((1 << 8 * k) - 1))] if k else np.full((len(grams), n_languages), 8.0, np.float32)
            for j, (g, c) in enumerate(counted):
                count = np.zeros(len(grams))
                count[np.searchsorted(grams, g)] = c
                total, kinds = np.bincount(home, count, len(contexts)), np.bincount(home, count > 0, len(contexts))
                seen = total > 0
                escape[seen, j] = -np.log2(kinds[seen] / (total + kinds)[seen])
                here = count > 0
                bits[here, j] = -np.log2(count[here] / (total + kinds)[home[here]])
                bits[~here, j] = escape[home[~here], j] + lower[~here, j]
            self.grams.append(grams), self.bits.append(bits), self.contexts.append(contexts), self.escape.append(escape)

    def cost(self, parts: list[bytes]) -> np.ndarray:
        """Code length in bits of each part (made by :func:`level`) under each language."""
        data, keep, starts = _ends(parts)
        at = np.flatnonzero(keep)
        total = np.zeros((len(at), self.n), np.float32)
        open_ = np.arange(len(at))
        for k in range(ORDER, -1, -1):
            grams = _grams(data, k)[at[open_]]
            where = np.minimum(np.searchsorted(self.grams[k], grams), len(self.grams[k]) - 1)
            known = self.grams[k][where] == grams
            total[open_[known]] += self.bits[k][where[known]]
            open_, grams = open_[~known], grams[~known]
            if not len(open_):
                break
            ctx = np.minimum(np.searchsorted(self.contexts[k], grams >> 8), len(self.contexts[k]) - 1)
            has = self.contexts[k][ctx] == grams >> 8
            total[open_[has]] += self.escape[k][ctx[has]]
        else:
            total[open_] += 8.0
        # each part has bytes that are scored
        return np.add.reduceat(total, np.searchsorted(at, starts), axis=0, dtype=np.float64)


def train(texts: Sequence[str], labels: Sequence[str], languages: Sequence[str] = LANGUAGES) -> Trees:
    """Trees from labelled texts; wrong labels and foreign lines are moved to the language that fits them best."""
    lines, given = [], []
    for t, y in zip(texts, labels):
        for x in (t or "").split("\n"):
            if b := level(x):
                lines.append(b), given.append(languages.index(y))
    now = np.array(given)
    draw = np.random.default_rng(0)
    for _ in range(ROUNDS if len(lines) > 1 else 0):
        # other halves each time
        new, halves = now.copy(), np.array_split(draw.permutation(len(lines)), 2)
        for own, other in (halves, halves[::-1]):
            if len(own) and len(other):
                new[own] = Trees([lines[i] for i in other], now[other], len(languages)).cost([lines[i] for i in own]).argmin(1)
        now = new
    return Trees(lines, now, len(languages))


def label_code(label: Column) -> Column:
    """A language label in lower case without what follows ``-`` or ``_``; blanks and fillers give text that is no language."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[-_].*$", "")


def fit(df: DataFrame, key: str, text: str, label: str, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` texts per label of ``df``."""
    rows = df.select(F.col(text).alias("text"), label_code(F.col(label)).alias("y"), F.xxhash64(key).alias("h")).where(F.col("y").isin(*languages) & (F.length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    got = rows.withColumn("r", rank).where(F.col("r") <= sample).select("text", "y").toPandas()
    got = got.sort_values(["y", "text"])
    return train(list(got["text"]), list(got["y"]), languages)


def judge(trees: Trees, texts: Sequence[str | None], languages: Sequence[str] = LANGUAGES) -> Iterator[tuple[int, str, float, list[tuple[int, str, float]]]]:
    """(text's index, language of most characters, confidence, [(line, language, confidence)]) of texts with letters."""
    # equal lines are scored once
    place: dict[bytes, int] = {}
    at, owner, number, chars = [], [], [], []
    for i, t in enumerate(texts):
        for j, x in enumerate((t or "").split("\n"), 1):
            if b := level(x):
                at.append(place.setdefault(b, len(place))), owner.append(i), number.append(j), chars.append(len(x.strip()))
    if not place:
        return
    parts = list(place)
    cost, null = trees.cost(parts)[at], 8.0 * np.array([len(p) - ORDER for p in parts])[at]
    owner, chars = np.array(owner), np.array(chars)
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    odds = np.exp2(-(cost - cost.min(1, keepdims=True)))
    every_sure, every_best, least = odds / odds.sum(1, keepdims=True), cost.argmin(1), cost.min(1)
    for a, z in zip(edges, np.append(edges[1:], len(owner))):
        own, best, weight, sure = cost[a:z], every_best[a:z], chars[a:z], every_sure[a:z]
        main = int(np.bincount(best, weight, len(languages)).argmax())
        best = np.where(own[:, main] - least[a:z] < SWITCH, main, best)
        main = int(np.bincount(best, weight, len(languages)).argmax())
        unknown = own[np.arange(z - a), best].sum() >= null[a:z].sum()
        lines = [(number[a + k], UNKNOWN if unknown else languages[b], float(round(sure[k, b], 4))) for k, b in enumerate(best)]
        mine = best == main
        share = float(weight[mine].sum() / max(1, weight.sum()))
        mean = float(np.average(sure[mine][:, main], weights=np.maximum(weight[mine], 1)))
        yield int(owner[a]), UNKNOWN if unknown else languages[main], round(share * mean, 4), lines


def label_lines(df: DataFrame, key: str, text: str, trees: Trees, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """(key, line_no, lang, confidence, mixed): line 0 is the whole text, then each line with letters.

    ``confidence`` of line 0 is the share of its language's characters times how surely they are of it.
    The trees are of bounded size (see ``SAMPLE``) and go to each worker once.
    """
    return _label(df.select(F.col(key).alias("key"), F.col(text).alias("text")), trees, languages).withColumnRenamed("key", key)


def _label(rows: DataFrame, trees: Trees, languages: Sequence[str]) -> DataFrame:
    """The lines of ``rows`` (key, text, or said beside them: then only what contradicts it, and mixed texts)."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2_000):
                part = b.iloc[at : at + 2_000]
                ids, out = part["key"].to_numpy(), []
                said = part["said"].to_numpy() if "said" in part else None
                for i, lang, sure, lines in judge(shared.value, list(part["text"]), languages):
                    mixed = len({x[1] for x in lines}) > 1
                    if said is None or said[i] != lang:
                        out.append((ids[i], 0, lang, sure, mixed))
                    if said is None or mixed:
                        out += [(ids[i], n, x, c, mixed) for n, x, c in lines]
                yield pd.DataFrame(out, columns=["key", "line_no", "lang", "confidence", "mixed"])

    return rows.where(F.length("text") > 0).mapInPandas(run, f"key {kind}, line_no int, lang string, confidence double, mixed boolean")


def find_mislabelled(df: DataFrame, key: str, text: str, label: str, trees: Trees, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """(key, line_no, lang, confidence): line 0 of texts whose label is missing or wrong, and every line of mixed texts. One pass, no join."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), label_code(F.col(label)).alias("said"))
    return _label(rows, trees, languages).drop("mixed").withColumnRenamed("key", key)
