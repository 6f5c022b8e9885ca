"""Personal data in free text: found through disguises, replaced by typed placeholders.

A transducer levels each line and remembers where every character came from: look-alike letters and wide
forms become plain ones, digits of other scripts and spelled digits become 0 to 9, written-out "at" and "dot"
become their signs. The identifiers are detected in the levelled text, and their spans are mapped back, so
that the rest of the source stays as it was, character for character.

Names need the corpus: first names are learned from the places where a person is announced ("Contact: ...",
"signed copy to ..."), counted over all texts, with those few words that follow a first name in capitals but
are ordinary words of the corpus ("Grace Period"). Both lists are bounded by the number of given names and
words; their size is checked before they are sent to the workers.

Null and empty texts hold nothing and come back as they are; lines are cut at line feeds only.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: A first name is learned from so many announcements; more learned names than this are refused.
LEARN, MOST_NAMES = 3, 200_000

#: Letters that look like Latin ones, number words, and words that announce a person.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАЕОРСУХІЈЅВКМНТαορυχιεκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwAEOPCYXIJSBKMHTaopuxiekABEZHIKMNOPTYX"))
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")), "oh": "0",
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")), "zwo": "2",
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    **dict(zip("nul een twee drie vier vijf zes zeven acht negen".split(), "0123456789")), "plus": "+",
}
ANNOUNCED = r"Emergency contact|Ansprechpartner(?:in)?:|Kontakt:|Contacto?:|Contatto:|Contactpersoon:|Reference:|Referenz:|Interview notes by|I reported to|reported to|My line manager there was|line manager:?|send the signed copy to|signed copy to|Name:|Nom\s?:|Nombre:|Nome:|Naam:|نام:"

#: The phrases of ``ANNOUNCED`` without a colon, by a part that each holds.
_PHRASES = ("mergency contact", "nterview notes by", "reported to", "line manager", "signed copy to")
_BRACKETS = frozenset("([{<")
_AT = re.compile(r"\s?[(\[{<]\s?(?:at|@|arroba|ät|à)\s?[)\]}>]\s?", re.I)
_DOT = re.compile(r"\s?[(\[{<]\s?(?:dot|punkt|punto|point|punt)\s?[)\]}>]\s?", re.I)
_AT_WORD = re.compile(r"(?<=[\w+-])\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+)")
_DOT_WORD = re.compile(r"(?<=[\w-])\s(?:dot|DOT)\s(?=[\w-])")
_AT_OPEN = re.compile(r"(?<=[\w.+-])\s?@\s?(?=[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})")
_SPELLED = re.compile(r"\b(?:(?:%s)\b[\s.-]{0,2}){6,}" % "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)), re.I)

_NAME = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
_LAST = rf"(?:(?:van|von|de|del|della|di|da|den|der|ten|zu)\s)*(?:{_NAME}|\p{{Lu}}[\p{{Lu}}'’-]{{2,}})"
_MID = r"(?:\s\p{Lu}\.)*"
_FORWARD = regex.compile(rf"(?<![\p{{L}}\d@._+-])(?P<first>{_NAME}){_MID}\s(?P<last>{_LAST})(?![\p{{L}}@\d_]|\.[\p{{L}}])")
_BACKWARD = regex.compile(rf"(?<![\p{{L}}\d@._+&-])(?P<last>{_LAST}),\s(?P<first>{_NAME}){_MID}(?![\p{{L}}@\d_]|\.[\p{{L}}])")
_INITIAL = regex.compile(rf"(?<![\p{{L}}\d.@_-])\p{{Lu}}\.(?:\s?\p{{Lu}}\.)*\s(?P<last>{_LAST})(?![\p{{L}}@\d_]|\.[\p{{L}}])")
_SLOT = regex.compile(rf"(?:{ANNOUNCED})\s*(?:(?P<first>{_NAME}){_MID}\s(?P<last>{_LAST})|(?P<last2>{_LAST}),\s(?P<first2>{_NAME}){_MID}|(?:\p{{Lu}}\.\s?)+(?P<last3>{_LAST}))(?![\p{{L}}@_])")
_EDGE_BEFORE = regex.compile(rf"(?:^[\s*•–-]*|[|(:]\s?|[.!?؟]\s|(?:{ANNOUNCED})\s*)$")
_EDGE_AFTER = regex.compile(r"^\s*(?:$|[|(<,:]|\.$)")

_EMAIL = regex.compile(r"(?<![\p{L}\d._%+-])[\p{L}\d](?:[\p{L}\d._%+-]*[\p{L}\d])?@(?:[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?\.)+\p{L}{2,}")
_PHONE = regex.compile(
    r"(?<![\d\p{L}+,.:/-])(?:(?:\+|00)\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){5,12}"
    r"|\(\d{3}\)\s?\d{3}[ .-]\d{4}|\(0\d{1,4}\)\s?\d(?:[ .\-/]?\d){4,9}|\d{3}-\d{3}-\d{4}"
    r"|0\d{1,4}[/ .-]\d(?:[ .\-/]?\d){4,9})(?![\d\p{L}]|[,.:-]\d|\s(?:EUR|€))"
)
_ID = regex.compile(
    r"(?<![\d\p{L}-])(?:SSN:?\s*)?\d{3}-\d{2}-\d{4}(?![\d-])"
    r"|(?<![\d\p{L}])(?:DNI|NIE|NIF)[:\s]*[XYZ]?\d{7,8}-?[A-Z](?!\p{L})|(?<![\d\p{L}-])\d{8}-[A-Z](?![\p{L}\d-])"
    r"|BSN[:\s]*\d{3}\.?\d{3}\.?\d{3}(?!\d)"
    r"|(?:Personalausweis|Ausweis|Reisepass)(?:nummer|-Nr\.?|\sNr\.?)?[:\s]*(?=[A-Z0-9]*\d)[A-Z0-9]{8,10}(?![\p{L}\d])"
    r"|(?:Passport|Passeport|Pasaporte|Passaporto|Paspoort)(?:\s(?:no|nr|number|numéro|n°|nº)\.?)?[:\s]*[A-Z]{1,2}\d{6,8}(?!\d)"
    r"|National\sID(?:\s(?:no|number)\.?)?[:\s]*\d(?:[ -]?\d){7,11}"
    r"|کد\s?ملی\s?:?\s*\d{10}|شماره\s?ملی\s?:?\s*\d{10}"
    r"|(?<![\p{L}\d])[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z](?![\p{L}\d])"
    r"|(?<![\p{L}\d])[A-CEGHJ-PR-TW-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-D](?![\p{L}\d])"
    r"|(?<![\p{L}\d])[12]\s\d{2}\s(?:0[1-9]|1[0-2])\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?(?!\d)"
)
_CITY = r"(?:,?\s(?:\d{4,5}(?:\s[A-Z]{2})?\s)?\p{Lu}[\p{L}-]+(?:\s(?:am|an der|de|la)\s\p{Lu}[\p{L}-]+|\s\p{Lu}[\p{L}-]+)?(?:\s\d{4,5})?(?![\p{L}]))?"
_ADDRESS = regex.compile(
    rf"(?:(?<![\p{{L}}\d])(?:\p{{Lu}}[\p{{L}}-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|laan|straat|plein|kade|gracht|dreef|steeg)|\p{{Lu}}\p{{L}}+\s(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ufer|Damm))\s\d{{1,4}}\s?[a-z]?(?![\p{{L}}\d])"
    rf"|(?<![\p{{L}}\d])(?:(?:Flat|Apt\.?|Unit)\s\d+[a-z]?,\s)?\d{{1,4}}[a-z]?,?\s(?:\p{{Lu}}[\p{{L}}'-]+\s){{1,3}}(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Court|Ct|Close|Square|Sq|Place|Terrace|Boulevard|Blvd|Row|Gardens|Mews)(?![\p{{L}}])\.?"
    rf"|(?<![\p{{L}}\d])\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-d]))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|ruelle|passage)\s(?:(?:de\sla|de|du|des|d'|l')\s?)?(?:l['’])?\p{{Lu}}[\p{{L}}-]+"
    rf"|(?<![\p{{L}}\d])(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|Travesía|Carrer)\s(?:(?:de|del|la|las|los|el)\s)*(?:\p{{Lu}}[\p{{L}}-]+\s?){{1,3}},?\s?\d{{1,4}}(?:,\s\d+º(?:\s[A-Z])?)?"
    rf"|(?<![\p{{L}}\d])(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Piazzale|Strada|Salita)\s(?:(?:della|dello|delle|dei|degli|del|di|da|la)\s|dell['’])*(?:\p{{Lu}}[\p{{L}}-]+\s?){{1,3}},?\s?\d{{1,4}}(?!\d)"
    rf"|(?:خیابان|کوچه|بلوار)\s[^،,\n]{{2,40}}[،,]?\s*(?:پلاک|شماره)\s*\d+){_CITY}"
)


class _Plain(dict):
    """Characters to what they are levelled to, each worked out once."""

    def __missing__(self, c: str) -> str:
        out = ""
        for x in LOOKALIKE.get(c) or (c if c in "º" else unicodedata.normalize("NFKC", c)):
            d = unicodedata.digit(x, None) if not x.isascii() else None
            out += str(d) if d is not None and x not in "º" else "-" if x in "‐‑‒–−" else " " if x.isspace() else x
        self[c] = out
        return out


_LEVEL = _Plain()
_UNSEEN = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+")
_DIGIT_WORDS = frozenset(DIGIT_WORDS)


class Levelled:
    """A line in levelled form; ``src[i]`` is the span of the source that character i came from.

    Each substitution is tried only on lines that hold what it cannot do without.
    """

    def __init__(self, line: str):
        text, src = line, None
        if not line.isascii():
            text = "".join(map(_LEVEL.__getitem__, line))
            if text != line or not _UNSEEN.isdisjoint(line):
                chars, src = [], []
                for i, c in enumerate(line):
                    if c in _UNSEEN and not (0 < i < len(line) - 1 and "؀" <= line[i - 1] <= "ۿ"):
                        continue
                    for x in _LEVEL[c]:
                        chars.append(x), src.append((i, i + 1))
                text = "".join(chars)
        self.text, self.src = text, src
        if not _BRACKETS.isdisjoint(text):
            self.sub(_AT, lambda m: "@").sub(_DOT, lambda m: ".")
        if "dot" in text or "DOT" in text:
            self.sub(_AT_WORD, lambda m: "@")
        if "@" in self.text:
            self.sub(_DOT_WORD, lambda m: ".").sub(_AT_OPEN, lambda m: "@")
        if not _DIGIT_WORDS.isdisjoint(map(str.lower, _TOKEN.findall(self.text))):
            self.sub(_SPELLED, lambda m: "".join(DIGIT_WORDS[w.lower()] for w in re.findall(r"[^\W\d_]+", m.group())) + " ")

    def sub(self, pattern: re.Pattern, to) -> Levelled:
        """Replaces matches; the replacement comes from the whole span it replaces."""
        at, text, src = 0, [], []
        for m in pattern.finditer(self.text):
            if self.src is None:
                self.src = [(i, i + 1) for i in range(len(self.text))]
            new, span = to(m), (self.src[m.start()][0], self.src[m.end() - 1][1])
            text += [self.text[at : m.start()], new]
            src += self.src[at : m.start()] + [span] * len(new)
            at = m.end()
        if at:
            self.text, self.src = "".join([*text, self.text[at:]]), src + self.src[at:]
        return self

    def span(self, a: int, z: int) -> tuple[int, int]:
        return (a, z) if self.src is None else (self.src[a][0], self.src[z - 1][1])


@dataclass
class Names:
    """What the corpus says about names: first names, and words in capitals that are none."""

    first: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)

    def __post_init__(self):
        #: The letters that first names begin with, up to their first other sign.
        self.begins = {m.group() for x in self.first if (m := _TOKEN.match(x))}


def slots(text: str) -> Iterator[str]:
    """First names in places where a person is announced."""
    for m in _SLOT.finditer(text):
        if f := m.group("first") or m.group("first2"):
            yield f


def _announced(t: str) -> bool:
    """Whether a person may be announced: each phrase ends in a colon or is one of the rest."""
    return ":" in t or any(x in t for x in _PHRASES)


def _names(t: str, names: Names) -> Iterator[tuple[int, int]]:
    if not names.begins.isdisjoint(_TOKEN.findall(t)):
        for m in _FORWARD.finditer(t):
            if m.group("first") in names.first and m.group("last").lower() not in names.ordinary and m.group("last") not in names.first:
                yield m.span()
        for m in _BACKWARD.finditer(t):
            if m.group("first") in names.first and m.group("last").lower() not in names.ordinary:
                before = t[: m.start()].rstrip(" ")
                if not regex.search(r"(?:^|\s)\p{Lu}[\p{L}&]*$", before):
                    yield m.span()
    if "." in t:
        for m in _INITIAL.finditer(t):
            if m.group("last").lower() not in names.ordinary and (_EDGE_BEFORE.search(t[: m.start()]) or _EDGE_AFTER.search(t[m.end() :])) and len(m.group("last")) > 3:
                yield m.span()
    if _announced(t):
        for m in _SLOT.finditer(t):
            start = min(m.start(g) for g in ("first", "last2", "last3") if m.group(g)) if not m.group("last3") else m.start("last3")
            yield (start, m.end())


def detect(line: str, names: Names) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the personal data of a line, as offsets of the source; spans do not overlap."""
    if not line or line.isspace():
        return []
    lev = Levelled(line)
    t, found = lev.text, []
    digits = len(_DIGIT.findall(t))
    # what each pattern cannot match without
    able = {"email": "@" in t, "id_number": digits >= 6 or digits and ("usweis" in t or "Reisepass" in t), "address": digits, "phone": digits >= 8}
    for rank, (kind, pattern) in enumerate((("email", _EMAIL), ("id_number", _ID), ("address", _ADDRESS), ("phone", _PHONE))):
        for m in pattern.finditer(t) if able[kind] else ():
            if kind == "phone" and not 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                continue
            found.append((rank, m.start(), m.end(), kind))
    found += [(4, a, z, "name") for a, z in _names(t, names)]
    if not found:
        return []
    out, used = [], [False] * len(t)
    for _, a, z, kind in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        while z > a and t[z - 1].isspace():
            z -= 1
        if z > a and not any(used[a:z]):
            used[a:z] = [True] * (z - a)
            out.append((*lev.span(a, z), kind))
    return sorted(out)


def mask(text: str, names: Names) -> tuple[str, int]:
    """The text with each finding replaced by a placeholder such as [EMAIL], and their number."""
    out, n = [], 0
    for line in text.split("\n"):
        at, parts = 0, []
        for a, z, kind in detect(line, names):
            parts += [line[at:a], f"[{kind.upper()}]"]
            at, n = z, n + 1
        out.append("".join([*parts, line[at:]]))
    return "\n".join(out), n


def learn_names(texts: DataFrame, text: str) -> Names:
    """First names and ordinary words in capitals, from all texts of a table."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = Counter(f for t in b["t"] for f in slots(t))
            yield pd.DataFrame(list(seen.items()), columns=["w", "n"])

    rows = texts.where(F.length(text) > 0).select(F.col(text).alias("t"))
    counts = rows.mapInPandas(first, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEARN)
    known = {r[0] for r in counts.select("w").limit(MOST_NAMES + 1).toLocalIterator()}
    if len(known) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} first names; raise LEARN")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = regex.compile(rf"(?<!\p{{L}})(\p{{Lu}}\p{{Ll}}+)\s({_NAME})(?!\p{{L}})")
        word = regex.compile(r"(?<![\p{L}\d@._+-])\p{Ll}{3,}(?![\p{L}\d@_+-]|\.\p{L}|\s?[(\[@])")
        for b in batches:
            after = Counter(m.group(2).lower() for t in b["t"] for m in pair.finditer(t) if m.group(1) in known)
            low = Counter(w for t in b["t"] for w in word.findall(t))
            rows = [(w, n, 0) for w, n in after.items()] + [(w, 0, n) for w, n in low.items()]
            yield pd.DataFrame(rows, columns=["w", "follows", "low"])

    words = rows.mapInPandas(follow, "w string, follows bigint, low bigint").groupBy("w").agg(F.sum("follows").alias("f"), F.sum("low").alias("l"))
    ordinary = {r[0] for r in words.where("f > 0 and l >= 3 * f").select("w").limit(MOST_NAMES + 1).toLocalIterator()}
    if len(ordinary) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} ordinary words follow a first name")
    return Names(known, ordinary)


def find_personal(df: DataFrame, keys: list[str], text: str, names: Names) -> DataFrame:
    """(keys, line_no, kind): one row per line and kind of personal data."""
    shared = df.sparkSession.sparkContext.broadcast(names)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, known = [], {}
            for *ids, t in b.itertuples(index=False, name=None):
                for i, line in enumerate(t.split("\n"), 1):
                    if (got := known.get(line)) is None:
                        got = known[line] = sorted({x[2] for x in detect(line, shared.value)})
                    out += [(*ids, i, k) for k in got]
            yield pd.DataFrame(out, columns=[*keys, "line_no", "kind"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "line_no int", "kind string"])
    return df.where(F.length(text) > 0).select(*keys, text).mapInPandas(run, schema)


def mask_personal(df: DataFrame, keys: list[str], text: str, names: Names) -> DataFrame:
    """(keys, text, n_masked): every text with its personal data replaced; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(names)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*ids, *(mask(t, shared.value) if isinstance(t, str) else (None, 0))) for *ids, t in b.itertuples(index=False, name=None)]
            yield pd.DataFrame(out, columns=[*keys, text, "n_masked"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{text} string", "n_masked int"])
    return df.select(*keys, text).mapInPandas(run, schema)
