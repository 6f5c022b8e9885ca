"""Text of scanned pages: find cut words, misread characters, running lines and page numbers, and repair them.

Corpus statistics come first: how often each word form occurs, and how often a line recurs once per page of
its text. Trusted words (frequent, letters only) are indexed by all their forms with at most one known confusion
(rn for m, 1 for l, a ligature for its letters) made; every other form looks up its own forms with at most one
undone (a symmetric join, so no pair of unrelated words meets, and every pair that two confusions part does).
The candidates are scored by an edit distance in which known confusions are cheap and everything else is dear.
Of several candidates the one that follows the preceding word most often wins (bigram counts of all texts).

Only words that may have a repair leave the texts: a bitmap of fixed size holds the hashes of all forms with a
candidate. It lets a few others pass, which the join with the candidates removes, but never holds one back.

A text with null or empty ``text`` has no lines. Repeated texts are judged each for itself. ``pages`` may be
null: then only lines that recur are running lines. All statistics cover the whole table; nothing is capped.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a scanner reads (right) where these letters stand (left).
CONFUSED = {
    "m": ("rn", "nn"), "d": ("cl",), "h": ("li", "lı", "b"), "u": ("ii", "v"), "w": ("vv", "uu"), "n": ("ri",), "o": ("0",), "l": ("1", "!", "|", "i"),
    "i": ("1", "!", "|", "l", "j"), "s": ("5", "$"), "b": ("6", "8", "h"), "g": ("q", "9"), "q": ("g",), "e": ("c", "€"), "c": ("e",), "t": ("†", "7", "+", "f"), "f": ("t",),
    "z": ("2",), "a": ("@", "4"), "rn": ("m",), "cl": ("d",), "li": ("h",), "vv": ("w",), "ii": ("u",), "v": ("u",),
    "ff": ("ﬀ",), "fi": ("ﬁ",), "fl": ("ﬂ",), "ffi": ("ﬃ",), "ffl": ("ﬄ",), "st": ("ﬆ",), "ü": ("ii",), "ä": ("a",), "ö": ("o",), "ß": ("b", "B"),
}
#: A trusted word occurs at least so often; a form of letters only is misread if its candidate is so many times as frequent.
TRUSTED, RATIO = 5, 10
#: Cost of a confusion; two are allowed, other edits are not.
SLIP, MOST = 0.3, 0.65
#: Longer forms are looked up by their levelled form alone; two confusions change a length by up to ``DRIFT``.
LONGEST, DRIFT = 48, 4
HYPHENS = "-­¬‐‑"

_EDGE = " .,:;()[]{}<>\"“”„«»'’‘?…–—/|*+=&%#_•·°"
_NUMBER = r"(?:\d{1,9}|[lIO|]\d{0,2})"
_PAGE = re.compile(rf"^(?:page|p\.|pg\.?|seite|s\.|página|pagina|pág\.|blz\.?|صفحه)\s*({_NUMBER})(?:\s*(?:of|von|de|di|van|sur|/|از)\s*({_NUMBER}))?$|^[–—-]\s*(\d{{1,9}})\s*[–—-]$|^\[\s*(\d{{1,9}})\s*\]$|^\(\s*(\d{{1,9}})\s*\)$|^(\d{{1,9}})\s*(?:/|of|von|de|di|van|sur)\s*(\d{{1,9}})$", re.I)
_TAIL = re.compile(rf"(?:[\s|–—-]+(?:page|p\.|seite|página|pagina|pág\.|blz\.?|صفحه)?\s*{_NUMBER}(?:\s*(?:of|von|de|di|van|sur|/)\s*{_NUMBER})?|\s+[\[(]\d{{1,9}}[\])])$", re.I)
_WORDY = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[\d†!|$€@ﬀ-ﬆ+]")
ODD_WORD = r"[0-9†!|$€@\x{FB00}-\x{FB06}+]"
_CODE = re.compile(r"^\d+[a-z]?$|@|\[at\]|://|\.[a-z]{2,}$")
_BARS = frozenset("|–—/-")
_PARTS = re.compile(r"\s[|–—/-]\s")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"(?<![^\W\d_])\d+(?![^\W_])")
_CUT = re.compile(rf"([^\W\d_][^\s]*?)([{HYPHENS}])$")


@functools.lru_cache(maxsize=1)
def roman() -> dict[str, int]:
    """All roman numerals (up to 3999), in lower case."""
    out = {}
    for n in range(1, 4000):
        text, rest = "", n
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            text += sign * (rest // value)
            rest %= value
        out[text] = n
    return out


#: Signs that a line with nothing but a page number, or with one at its end, ends in, digits aside.
_LAST = frozenset("lLiIoO|-–—])")
_ROMAN = frozenset("ivxlcdmIVXLCDM-–—[]() ")


def page_number(line: str, pages: int | None) -> bool:
    """Whether a line holds nothing but the number of its page."""
    s = line.strip()
    last = s[-1:]
    if not (last in _LAST or last in _ROMAN or last.isdigit()):
        return False
    most = pages or 0
    if s.isdigit() and s.isascii():
        return len(s) <= 10 and 1 <= int(s) <= most
    if last in _ROMAN and (bare := s.strip("-–—[]() ").lower()) and not bare.strip("ivxlcdm"):
        return roman().get(bare, most + 1) <= most
    m = _PAGE.match(s) if last in _LAST or last.isdigit() else None
    if not m:
        return False
    # between marks, a number has the digits of a year at most, or those of the number of pages
    if any(x and len(x) > max(4, len(str(most))) for x in m.group(3, 4, 5)):
        return False
    if m.group(6) and not int(m.group(6)) <= int(m.group(7)) <= max(most, int(m.group(7)) if pages is None else 0):
        return False
    return True


def running_key(line: str) -> str:
    """A line without its page number; blanks, letter case and digits (but for those inside words) levelled."""
    s = " ".join(line.split())
    if s[-1:] in _LAST or s[-1:].isdigit():
        cut = _TAIL.sub("", s)
        s = cut if len(cut) >= 3 and _WORDY.search(cut) else s
    s = s.lower()
    return _DIGITS.sub("#", s) if _DIGIT.search(s) else s


class Forms(dict):
    """Chunks (what stands between blanks) to word forms, each worked out once: lower case, marks at the edges taken off,
    exclamation marks inside kept; empty for chunks that are no words."""

    def __missing__(self, chunk: str) -> str:
        w = chunk.strip(_EDGE).rstrip("!").rstrip(_EDGE).lower()
        self[chunk] = w = w if len(w) >= 2 and _WORDY.search(w) else ""
        return w


def line_words(line: str, forms: Forms | None = None) -> list[str]:
    """Word forms of a line."""
    forms = Forms() if forms is None else forms
    return [w for c in line.split() if (w := forms[c])]


def clean_word(w: str) -> bool:
    return not _ODD.search(w)


def repeats(text: str, pages: int | None) -> list[tuple[str, str, int, int]]:
    """(line, the line or a part of it, 1 if the line recurs about once a page, 1 if it does so evenly) of a text's lines."""
    at: dict[str, list[int]] = {}
    for i, x in enumerate(text.split("\n")):
        if x.strip() and not page_number(x, pages):
            at.setdefault(running_key(x), []).append(i)
    n, out = pages or 0, []
    for k, where in at.items():
        c = len(where)
        hit = c >= 2 and (n - 1 <= c <= n + 1 if n else True) and n != 1
        gaps = [b - a for a, b in zip(where, where[1:])]
        even = hit and c >= 3 and max(gaps) <= 1.5 * min(gaps) + 2 and min(gaps) >= 5
        parts = {k, *(p for x in _PARTS.split(k) if len(p := x.strip()) >= 3)} if _BARS.intersection(k) else (k,)
        out += [(k, p, int(hit), int(even)) for p in parts]
    return out


def body_lines(text: str, pages: int | None, running: set[str]) -> tuple[list[str], list[str]]:
    """The lines of a text, and the kind of each: ``body``, ``blank``, ``header`` or ``page_number``."""
    lines, kinds = text.split("\n"), []
    for x in lines:
        if not x.strip():
            kinds.append("blank")
        elif page_number(x, pages):
            kinds.append("page_number")
        elif running and (k := running_key(x)) and (k in running or any(_near(k, r) for r in running)):
            kinds.append("header")
        else:
            kinds.append("body")
    return lines, kinds


def _near(a: str, b: str) -> bool:
    """Whether two running lines differ by misread characters only."""
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 2 or a[:2] != b[:2] and a[-3:] != b[-3:]:
        return False
    cost = confusion_cost(a, b)
    return cost is not None and cost <= MOST


def confusion_cost(read: str, true: str) -> float | None:
    """Cheapest way to misread ``true`` as ``read`` by known confusions; null if other edits are needed."""
    best = [{0: 0.0}] + [{} for _ in range(len(true))]
    for j in range(len(true)):
        for i, cost in best[j].items():
            if i < len(read) and read[i] == true[j] and best[j + 1].get(i + 1, 9) > cost:
                best[j + 1][i + 1] = cost
            if cost + SLIP > MOST:
                continue
            for k in range(1, min(3, len(true) - j) + 1):
                for wrong in CONFUSED.get(true[j : j + k], ()):
                    if read.startswith(wrong, i) and best[j + k].get(i + len(wrong), 9) > cost + SLIP:
                        best[j + k][i + len(wrong)] = cost + SLIP
    return best[-1].get(len(read))


_UNDONE: dict[str, list[str]] = {}
for _true, _wrongs in CONFUSED.items():
    for _wrong in _wrongs:
        _UNDONE.setdefault(_wrong, []).append(_true)
#: Every sign as the part of it that no confusion changes: whatever CONFUSED puts for a text has the text's own levelled form.
_LEVEL = str.maketrans({
    **dict.fromkeys("lıij1!|uvüwhb68ßB", ""), **dict.fromkeys("nr", "r"), "m": "rr", **dict.fromkeys("dce€", "c"), **dict.fromkeys("o0ö", "o"), **dict.fromkeys("a@4ä", "a"),
    **dict.fromkeys("s5$", "s"), **dict.fromkeys("gq9", "g"), **dict.fromkeys("t†7+f", "t"), "2": "z", "ﬀ": "tt", "ﬁ": "t", "ﬂ": "t", "ﬃ": "tt", "ﬄ": "tt", "ﬆ": "st",
})


def levelled(word: str) -> str:
    return word.translate(_LEVEL)


def _changed(word: str, table: dict) -> set[str]:
    """The word and its forms with one part replaced by what the table has for it."""
    out = {word}
    for i in range(len(word)):
        for k in (1, 2, 3):
            for new in table.get(word[i : i + k], ()) if i + k <= len(word) else ():
                out.add(word[:i] + new + word[i + k :])
    return out


def join_keys(word: str, true: bool) -> set[str]:
    """Keys of a true word (at most one confusion made) or a read one (at most one undone).

    Two words that at most two confusions part share the form in between. Very long words share their levelled form instead.
    """
    keys = _changed(word, CONFUSED if true else _UNDONE) if len(word) <= LONGEST else set()
    return keys | ({" " + levelled(word)} if len(word) > LONGEST - DRIFT else set())


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for at in range(0, len(b), 2_000):
                yield pd.DataFrame(fn(b.iloc[at : at + 2_000]), columns=names)

    return df.mapInPandas(run, schema)


def cuts(lines: list[str], kinds: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, line where it goes on, left part, right part, hyphen) of words cut at a line's end."""
    out = []
    for i, x in enumerate(lines):
        if kinds[i] != "body" or (x := x.rstrip())[-1:] not in HYPHENS or not (m := _CUT.search(x)):
            continue
        j = i + 1
        while j < len(lines) and kinds[j] != "body":
            j += 1
        if j == len(lines) or not lines[j].split():
            continue
        right = lines[j].split()[0].rstrip("!").rstrip(_EDGE).lower()
        if right and right[0] not in _EDGE and _WORDY.match(right[0]) or right[:1] in "!†015":
            out.append((i, j, m.group(1).lstrip(_EDGE).lower(), right, m.group(2)))
    return out


#: Bits of a bitmap (2 MB).
BITS = 24


class Maybe:
    """A bitmap of hashed texts, of fixed size: tells texts that are surely not among them from those that may be."""

    def __init__(self, texts: DataFrame, column: str):
        h = (F.crc32(F.encode(column, "UTF-8")) % (1 << BITS)).alias("h")
        words = texts.select(h).select(F.expr("h div 64").alias("i"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b"))
        # at most one row per machine word, however many texts there are
        rows = words.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
        bits = np.zeros(1 << (BITS - 6), np.int64)
        bits[rows["i"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
        self.bits = bits.astype("<i8").tobytes()

    def __call__(self, text: str) -> bool:
        h = zlib.crc32(text.encode("utf-8", "replace")) & (1 << BITS) - 1
        return bool(self.bits[h >> 3] >> (h & 7) & 1)


def survey(b: pd.DataFrame) -> list[tuple[str, str, int, int]]:
    """Counts over a batch: word forms (kind ``w``: form, n), joined forms of cut words (n 0), and lines (kind ``look``: the line
    or a part of it, number of texts that have it, of those where it recurs about once a page)."""
    of, chunks, forms = Forms(), Counter(), Counter()
    looks: dict[str, list[int]] = {}
    for text, pages in zip(b["text"], b["pages"]):
        pages = None if pd.isna(pages) else int(pages)
        lines, kinds = body_lines(text, pages, set())
        chunks.update(text.split())
        for line in lines:
            # the last word of a line that ends in a hyphen is no whole word
            if (end := line.rstrip())[-1:] in HYPHENS and end and (words := line_words(end, of)):
                forms[words[-1]] -= 1
        for x in cuts(lines, kinds):
            forms[x[2] + x[3]] += 0
        for _, look, hit, _ in repeats(text, pages):
            n = looks.setdefault(look, [0, 0])
            n[0] += 1
            n[1] += hit
    for c, n in chunks.items():
        if w := of[c]:
            forms[w] += n
    return [("w", w, n, 0) for w, n in forms.items()] + [("look", k, n, h) for k, (n, h) in looks.items()]


class Lexicon:
    """What a table of scans says as a whole: ``forms`` (w, n) and ``looks`` (look, known), lines or parts of lines that recur in
    several texts, known if they do so about once a page in at least half of them."""

    def __init__(self, docs: DataFrame, keep=lambda x, _: x):
        counts = _map(docs, survey, "kind string, s string, n bigint, hits bigint").groupBy("kind", "s").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        counts = keep(counts.where("kind = 'w' or n >= 3 and (hits >= 3 or n >= 5)"), "counts")
        self.forms = counts.where("kind = 'w'").select(F.col("s").alias("w"), "n")
        self.looks = counts.where("kind = 'look'").select(F.col("s").alias("look"), (F.col("hits") * 2 >= F.col("n")).alias("known"))

    def fixes(self, forms: DataFrame) -> DataFrame:
        """(w, fix, cost, n): for each misread form its candidates among the trusted words."""
        odd = F.col("w").rlike(ODD_WORD)
        trusted = forms.where((F.col("n") >= TRUSTED) & ~odd & (F.length("w") >= 3))
        suspect = forms.where((F.length("w") >= 3))

        def keys(true: bool):
            return lambda b: [(k, w, n) for w, n in zip(b["w"], b["n"]) for k in join_keys(w, true)]

        left = _map(suspect.where(~F.col("w").rlike(_CODE.pattern)), keys(False), "k string, w string, n bigint")
        right = _map(trusted, keys(True), "k string, fix string, m bigint")
        better = (F.col("m") >= F.col("n") * RATIO) | (F.col("w").rlike(ODD_WORD) & (F.col("m") > F.col("n")))
        pairs = left.join(right, "k").where((F.col("w") != F.col("fix")) & better & (F.abs(F.length("w") - F.length("fix")) <= DRIFT)).select("w", "fix", "m").distinct()

        def score(b: pd.DataFrame):
            got = [(w, t, confusion_cost(w, t), m) for w, t, m in zip(b["w"], b["fix"], b["m"])]
            return [x for x in got if x[2] is not None]

        return _map(pairs, score, "w string, fix string, cost double, n bigint")


def running_lines(docs: DataFrame, looks: DataFrame) -> DataFrame:
    """(key, running array): the running lines of each text.

    Section headings and common sentences recur too, but seldom once a page, so a line counts as running
    in all its texts if it does so in at least three and in at least half of those that have it; a line
    one part of which (between bars, dashes or slashes) is of that kind counts as well. A line of one text
    alone counts if it recurs three times or more, about once a page and at even distances.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Maybe(looks, "look"))

    def fn(b: pd.DataFrame):
        maybe = functools.lru_cache(maxsize=50_000)(shared.value)
        return [(k, line, look, even) for k, t, p in zip(b["key"], b["text"], b["pages"]) for line, look, _, even in repeats(t, None if pd.isna(p) else int(p)) if even or maybe(look)]

    kind = dict(docs.dtypes)["key"]
    rows = _map(docs, fn, f"key {kind}, line string, look string, even int")
    hits = rows.join(looks, "look", "left").where("known or (even = 1 and known is null)")
    return hits.groupBy("key").agg(F.collect_set("line").alias("running"))


def prepare(df: DataFrame, key: str, text: str, pages: str) -> DataFrame:
    return df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(pages).cast("int").alias("pages"))


def judged_words(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows (key, line_no, kind, w, prev, whole, cut_at, next_no): what a text's lines are, and the words to look up.

    ``docs`` has the running lines of each text beside it. kind ``header`` and ``page_number`` are final; ``word``
    holds a form of a body line that may have a repair, with the word before it; ``cut`` a word cut at the line's
    end, with its joined form in w, its compound form in whole, the length of its left part and the line where it
    goes on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Maybe(fixes, "w"))

    def fn(b: pd.DataFrame):
        maybe, of, out = functools.lru_cache(maxsize=200_000)(shared.value), Forms(), []
        for k, t, p, run in zip(b["key"], b["text"], b["pages"], b["running"]):
            lines, kinds = body_lines(t, None if pd.isna(p) else int(p), set(run) if run is not None else set())
            broken = {x[0]: x for x in cuts(lines, kinds)}
            starts, prev = {x[1] for x in broken.values()}, ""
            for i, kind in enumerate(kinds):
                if kind in ("header", "page_number"):
                    out.append((k, i + 1, kind, None, None, None, 0, 0))
                elif kind == "body":
                    words = line_words(lines[i], of)
                    words = words[i in starts : len(words) - 1 if i in broken and words else None]
                    seen = set()
                    for w in words:
                        if w not in seen and maybe(w):
                            seen.add(w)
                            out.append((k, i + 1, "word", w, prev, None, 0, 0))
                        prev = w
                    if i in broken:
                        _, j, left, right, h = broken[i]
                        out.append((k, i + 1, "cut", left + right, prev, left + "-" + right if h in "-‐‑" else None, len(left), j + 1))
                        prev = left + right
        return out

    kind = dict(docs.dtypes)["key"]
    return _map(docs, fn, f"key {kind}, line_no int, kind string, w string, prev string, whole string, cut_at int, next_no int")


def choose(docs: DataFrame, met: DataFrame, fixes: DataFrame) -> DataFrame:
    """(prev, w, fix): the repair of each misread form after each word it follows, for the pairs in ``met`` (prev, w).

    Candidates are ranked by their cost less what the counts of (preceding word, candidate) in all texts speak for
    them. Only bigrams that can decide between several candidates are counted.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy("prev", "w"))
    options = met.distinct().join(fixes, "w").withColumn("several", several > 1)
    wanted = options.where("several").select(F.concat_ws(" ", "prev", "fix").alias("pair"), "fix")
    sc = docs.sparkSession.sparkContext
    pairs, ends = sc.broadcast(Maybe(wanted, "pair")), sc.broadcast(Maybe(wanted, "fix"))

    def count(b: pd.DataFrame):
        seen: Counter[tuple[str, str]] = Counter()
        of, end, pair = Forms(), functools.lru_cache(maxsize=200_000)(ends.value), pairs.value
        for text in b["text"]:
            words = line_words(text, of)
            for i in [i for i, w in enumerate(words) if end(w)]:
                prev = words[i - 1] if i else ""
                if pair(prev + " " + words[i]):
                    seen[prev, words[i]] += 1
        return [(p, w, n) for (p, w), n in seen.items()]

    counts = _map(docs, count, "prev string, fix string, pair_n bigint").groupBy("prev", "fix").agg(F.sum("pair_n").alias("pair_n"))
    ranked = options.join(counts, ["prev", "fix"], "left")
    cost = F.col("cost") - 0.05 * F.log(1 + F.coalesce("pair_n", F.lit(0)))
    return ranked.groupBy("prev", "w").agg(F.min_by("fix", F.struct(cost, -F.col("n"), "fix")).alias("fix"))


def _judge(docs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(findings: key, line_no, kind; repairs: key, line_no, w, fix) of prepared texts."""
    lexicon = Lexicon(docs, keep)
    fixes = keep(lexicon.fixes(lexicon.forms), "fixes")
    rows = keep(judged_words(docs.join(running_lines(docs, lexicon.looks), "key", "left"), fixes), "judged")
    looked = rows.where("kind in ('word', 'cut')")
    chosen = keep(choose(docs, looked.select("prev", "w"), fixes), "chosen")
    fixed = rows.where("kind in ('header', 'page_number')").select("key", "line_no", "kind")
    words = rows.where("kind = 'word'").join(chosen, ["prev", "w"]).select("key", "line_no", "w", "fix")
    known = lexicon.forms.where("n > 0").select(F.col("w"), F.col("n").alias("n_joined"))
    part = rows.where("kind = 'cut'").join(known, "w", "left").join(chosen, ["prev", "w"], "left")
    part = part.join(known.select(F.col("w").alias("whole"), F.col("n_joined").alias("n_whole")), "whole", "left")
    real = F.coalesce("n_whole", F.lit(0)) <= F.greatest(F.coalesce("n_joined", F.lit(0)), F.when(F.col("fix").isNotNull(), 1).otherwise(0))
    part = part.where(real)
    hyphen = part.select("key", "line_no", F.lit("hyphen").alias("kind"))

    def sides(b: pd.DataFrame):
        out = []
        for k, i, j, w, t, at in zip(b["key"], b["line_no"], b["next_no"], b["w"], b["fix"], b["cut_at"]):
            same = next((x for x in range(min(len(w), len(t))) if w[x] != t[x]), min(len(w), len(t)))
            tail = next((x for x in range(min(len(w), len(t))) if w[-1 - x] != t[-1 - x]), min(len(w), len(t)))
            if same < at:
                out.append((k, i, "misread"))
            if len(w) - tail > at:
                out.append((k, j, "misread"))
        return out

    kind = dict(docs.dtypes)["key"]
    joined = part.where("fix is not null")
    both = _map(joined.select("key", "line_no", "next_no", "w", "fix", "cut_at"), sides, f"key {kind}, line_no int, kind string")
    found = fixed.unionByName(words.select("key", "line_no", F.lit("misread").alias("kind"))).unionByName(hyphen).unionByName(both).distinct()
    return found, words.unionByName(joined.select("key", "line_no", "w", "fix"))


def find_noise(df: DataFrame, key: str, text: str, pages: str, cache=None) -> DataFrame:
    """(key, line_no, kind): kinds ``hyphen``, ``misread``, ``header`` and ``page_number``, each line and kind once.

    ``cache`` may write a small DataFrame down and read it back (see ``session.materialise``).
    """
    return _judge(prepare(df, key, text, pages), cache or (lambda x, _: x))[0].withColumnRenamed("key", key)


def _as_read(read: str, fix: str) -> str:
    """``fix`` in the letter case of ``read``."""
    letters = [c for c in read if c.isalpha()]
    return fix.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else fix[:1].upper() + fix[1:] if read[:1].isupper() else fix


def rebuild(text: str, lines_out: dict[int, set[str]], repairs: dict[tuple[int, str], str]) -> str:
    """Readable paragraphs: noise lines dropped, cut words joined, misread words repaired, lines run on.

    ``repairs`` are by line and form; those of cut words by the line where they begin. A paragraph ends at a blank
    line that follows a sentence's end, and at lines that stand alone.
    """
    lines, out, para = text.split("\n"), [], []
    carried, origin = "", 0

    def flush():
        if para:
            out.append(" ".join(para))
            para.clear()

    for i, line in enumerate(lines, 1):
        kinds = lines_out.get(i, set())
        if kinds & {"header", "page_number"}:
            continue
        if not line.strip():
            if not carried and (not para or para[-1][-1:] in ".!?:؟"):
                flush()
            continue
        chunks, first = (carried + line.strip()).split(), origin if carried else i
        carried, origin = "", i
        if "hyphen" in kinds and chunks:
            carried = chunks.pop().rstrip(HYPHENS)
        elif chunks and re.search(r"[^\W\d_][-‐‑]$", chunks[-1]):
            carried = chunks.pop()  # a compound cut at its own hyphen
        done = []
        for n, c in enumerate(chunks):
            core = c.strip(_EDGE).rstrip("!").rstrip(_EDGE)
            if core and (fix := repairs.get((i if n else first, core.lower()))):
                c = c.replace(core, _as_read(core, fix))
            done.append(c)
        if done:
            para.append(" ".join(done))
        if done and len(line.strip()) < 40 and line.strip()[-1:] == ":":
            flush()
    if carried:
        para.append(carried)
    flush()
    return "\n\n".join(out)


def repair(df: DataFrame, key: str, text: str, pages: str, cache=None) -> DataFrame:
    """(key, text, n_noise): every text with its noise repaired into continuous paragraphs.

    Null and empty texts come back as they are, with 0.
    """
    docs = prepare(df, key, text, pages)
    noise, fixes = _judge(docs, cache or (lambda x, _: x))
    marks = noise.groupBy("key").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks"))
    needed = fixes.groupBy("key").agg(F.collect_list(F.struct("line_no", "w", "fix")).alias("fixes"))
    rows = docs.join(marks, "key", "left").join(needed, "key", "left")

    def fix(b: pd.DataFrame):
        out = []
        for k, t, m, f in zip(b["key"], b["text"], b["marks"], b["fixes"]):
            at: dict[int, set[str]] = {}
            for x in m if m is not None else ():
                at.setdefault(x["line_no"], set()).add(x["kind"])
            out.append((k, rebuild(t, at, {(x["line_no"], x["w"]): x["fix"] for x in (f if f is not None else ())}), sum(map(len, at.values()))))
        return out

    kind = dict(docs.dtypes)["key"]
    done = _map(rows, fix, f"key {kind}, text string, n_noise int")
    rest = df.where(F.col(text).isNull() | (F.length(text) == 0)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).alias("n_noise"))
    return done.unionByName(rest).withColumnRenamed("key", key)
