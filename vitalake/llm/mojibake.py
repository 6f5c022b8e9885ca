"""Text decoded with the wrong character encoding: find it, and restore the original where it is known.

Every distinct clean word of the corpus that holds a character outside ASCII is garbled under all
encoding chains, and the words of the documents are hash-joined against that table. A word found there
is replaced by the word it was made from. No encoding has to be guessed for a whole text, so texts that
are garbled in one header or one quoted part only, or twice over, are found like any other.

Words are runs of ASCII letters and digits and of any characters outside ASCII: the borders are ASCII
marks and blanks, which no chain touches, so a word and its garbled form have the same borders. Digits
are levelled to 0 for the join. A word counts as clean source of another only if it holds no replacement or
control characters and occurs in at least as many documents; that settles the rare pairs of which each
could be the other. UTF-8 read as something else gives forms so odd that they need no such count.

Words of any length are garbled; those of over ``LONG`` characters (runs without blanks) are joined by the SHA-256
of their forms. The chains are those of ``WRITTEN`` and ``READ``, with UTF-8 read wrongly twice or thrice by ``TWICE``.
A form that stands in very many documents is split by the engine's skew join, since the other side has it once.

Null and empty texts, and texts in plain ASCII, are never found. Replacement characters (U+FFFD) are
garbled text of which the original may be lost: they are found even if no clean form is known.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The encodings that text is written in, and those it is wrongly read in.
WRITTEN = ("utf-8", "cp1252", "cp1256", "cp1251")
LETTERS_ONLY = ("cp1256", "cp1251")  # their marks alone prove nothing
READ = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "cp1256", "cp1250", "iso8859-15", "cp1253", "cp1254", "koi8-r", "cp866")
TWICE = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251")
LOST = "�"
_WORD = r"(?<![0-9A-Za-z\x{80}-\x{10FFFF}])[0-9A-Za-z]*[^\x00-\x7F][0-9A-Za-z\x{80}-\x{10FFFF}]*"
#: The same for Python.
_PY_WORD = re.compile(r"(?<![0-9A-Za-z\x80-\U0010FFFF])[0-9A-Za-z]*[^\x00-\x7F][0-9A-Za-z\x80-\U0010FFFF]*")
#: Longer forms are joined by their hash.
LONG = 80
#: Characters of forms that are handed on at once.
CHUNK = 10_000_000


def _read(raw: bytes, encoding: str, lossy: bool = False) -> str | None:
    """``raw`` as read in an encoding; bytes the encoding lacks stay as control characters, or are lost."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if encoding == "utf-8":
            return raw.decode(encoding, "replace") if lossy else None
        out = []
        for b in raw:
            try:
                out.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                out.append(LOST if lossy else chr(b))
        return "".join(out)


def _write(text: str, encoding: str) -> bytes | None:
    """The bytes of a text; control characters stand for bytes the encoding lacks."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding == "utf-8":
            return None
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if not "\x80" <= c <= "\x9f":
                    return None
                out.append(ord(c))
        return bytes(out)


def garble(word: str) -> dict[str, str]:
    """Garbled form to the chain that makes it, over all chains; the word itself is no form of its own.

    A chain is ``written>read`` steps joined by ``+``; ``!`` marks one that loses bytes.
    """
    forms: dict[str, str] = {}

    def add(text: str | None, chain: str) -> None:
        if text is not None and text != word:
            forms.setdefault(text, chain)

    for w in WRITTEN:
        if w in LETTERS_ONLY and sum(c.isalpha() for c in word) < 2:
            continue
        raw = _write(word, w)
        if raw is None or len(raw) == len(word) and raw.isascii():
            continue
        for r in READ:
            if r == w:
                continue
            once = _read(raw, r)
            add(once, f"{w}>{r}")
            add(_read(raw, r, lossy=True), f"{w}>{r}!")
            if w == "utf-8" and once and r in TWICE:
                again = once.encode("utf-8", "ignore")
                for r2 in TWICE:
                    if r2 == r or "cp1252" in (r, r2):
                        twice = _read(again, r2)
                        add(twice, f"{w}>{r}+utf-8>{r2}")
                        add(_read(again, r2, lossy=True), f"{w}>{r}+utf-8>{r2}!")
                        if r == r2 == "cp1252" and twice:
                            add(_read(twice.encode("utf-8", "ignore"), r2), f"{w}>{r}+utf-8>{r2}+utf-8>{r2}")
        if w != "utf-8" and LOST in (lost := _read(raw, "utf-8", lossy=True)):
            # bytes that happen to be right UTF-8 would be a repair, not a form
            add(lost, f"{w}>utf-8!")
        add("".join(chr(b) if b < 128 else LOST for b in raw), f"{w}>ascii!")
    return forms


def ungarble(text: str, chain: str) -> str | None:
    """The original of a garbled word by its chain; null where bytes were lost."""
    if chain.endswith("!"):
        return None
    for step in reversed(chain.split("+")):
        written, read = step.split(">")
        raw = _write(text, read)
        if raw is None:
            return None
        try:
            text = raw.decode(written)
        except UnicodeDecodeError:
            return None
    return text


def words(text: Column) -> Column:
    """Distinct words of a text that hold a character outside ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def _level(word: Column) -> Column:
    return F.translate(word, "123456789", "000000000")


def _key(form: Column) -> Column:
    return F.when(F.length(form) > LONG, F.concat(F.lit("\x00"), F.sha2(F.encode(form, "UTF-8"), 256))).otherwise(form)


def document_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, form, long): one row per document and distinct word; form has its digits levelled, or is its hash: then long has it."""
    rows = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key), F.explode(words(F.col(text))).alias("word"))
    return rows.withColumn("form", _key(_level(F.col("word")))).withColumn("long", F.when(F.length("word") > LONG, _level(F.col("word"))))


def garbled_words(tokens: DataFrame) -> DataFrame:
    """(form, source, chain): the garbled words among ``tokens`` and what each was made from.

    Counts are aggregated before they are shuffled; the join is between distinct words and the forms of
    distinct words. ``source`` is null for words with lost characters that no clean word explains.
    """
    known = tokens.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long"), F.max((F.instr("word", LOST) > 0).cast("int")).alias("lost"))
    clean = known.withColumn("form", F.coalesce("long", "form")).where(~F.col("form").rlike(r"[\x{80}-\x{9F}\x{FFFD}]")).select("form", "n")
    known = known.drop("long")

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["form", "source", "chain", "source_n"]
        for b in batches:
            rows, size = [], 0
            for w, n in zip(b["form"], b["n"]):
                for g, c in garble(w).items():
                    long = len(g) > LONG
                    # what a chain without loss made needs no source: it is undone
                    rows.append(("\x00" + hashlib.sha256(g.encode("utf-8", "replace")).hexdigest() if long else g, "" if long and not c.endswith("!") else w, c, n))
                    size += len(rows[-1][0]) + len(rows[-1][1])
                if size > CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    table = clean.mapInPandas(forms, "form string, source string, chain string, source_n bigint")
    pairs = known.join(table, "form").where("source_n >= n or chain like 'utf-8>%'")
    # the commonest source, then the shortest chain
    best = F.min_by(F.struct("source", "chain"), F.struct(-F.col("source_n"), F.length("chain"), F.col("source")))
    hits = pairs.groupBy("form").agg(best.alias("b")).select("form", F.col("b.source").alias("source"), F.col("b.chain").alias("chain"))
    lost = known.where("lost = 1").select("form").join(hits.select("form"), "form", "left_anti")
    return hits.unionByName(lost.select("form", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("chain")))


def find_garbled(df: DataFrame, key: str, text: str, cache=None) -> DataFrame:
    """(key, n_words, n_restorable): documents that hold garbled words.

    ``cache`` may write a DataFrame down and read it back (see ``session.materialise``), so that the texts are
    cut into words once.
    """
    tokens = document_words(df, key, text)
    tokens = cache(tokens, "words") if cache else tokens
    hits = tokens.join(garbled_words(tokens), "form")
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_words"), F.count("source").alias("n_restorable"))


def restore(df: DataFrame, key: str, text: str, cache=None) -> DataFrame:
    """(key, text, n_replaced): garbled documents with the verified original of each known word put back.

    Words whose bytes were lost take the source's own digits and spelling if they hold no digits, else they
    stay. A document's own distinct garbled words are gathered; their number is bound by its length.
    """
    tokens = document_words(df, key, text)
    tokens = cache(tokens, "words") if cache else tokens
    hits = tokens.join(garbled_words(tokens).where("source is not null"), "form")

    @F.pandas_udf("string")
    def original(word: pd.Series, source: pd.Series, chain: pd.Series) -> pd.Series:
        def one(w: str, s: str, c: str) -> str:
            back = ungarble(w, c)
            return back if back is not None else s if not any(x.isdigit() for x in w) else w

        return pd.Series([one(*x) for x in zip(word, source, chain)])

    @F.pandas_udf("string")
    def put_back(text: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str, pairs) -> str:
            back = {p["word"]: p["back"] for p in pairs}
            return _PY_WORD.sub(lambda m: back.get(m.group(), m.group()), t)

        return pd.Series([one(*x) for x in zip(text, found)])

    pairs = hits.select(key, "word", original("word", "source", "chain").alias("back")).where("word <> back")
    per_doc = pairs.groupBy(key).agg(F.collect_list(F.struct("word", "back")).alias("x"))
    joined = df.select(key, text).join(per_doc, key)
    # whole words only: a word that holds a garbled one as a part was not verified
    return joined.select(key, put_back(text, "x").alias(text), F.size("x").alias("n_replaced"))
