"""Free-entered titles to the entry of a reference list which they name.

Titles are cut into tokens; each distinct token is joined to the vocabulary of the reference list by edit
distance (symmetric deletions as join keys, then the distance itself), with extra keys for abbreviations
and dropped vowels. The repaired tokens are combined with soft TF-IDF: an entry scores the weights of its
tokens times their similarity, and it is a candidate only if each of its tokens is found. What a title
says besides (rank, hours, employer) costs nothing. An entry needs its rarest token, so only the postings of
that token are looked up.

A label or alias is a reference *entry*; several may belong to one record. A title whose best entry is an
alias of several records is ``ambiguous``; one that covers no entry is ``none``. Null and blank titles are
left out. Repeated titles are resolved once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones, and signs typed for letters.
LOOKALIKE = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтзАЕОРСУХІЈЅВКМНТЗΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορτυχιενκı",
    "aeopcyxijshdqwbkmhtzAEOPCYXIJSBKMHTZABEZHIKMNOPTYXaoptyxievki",
)
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_VOWELS = re.compile(r"[aeiouyäöüàâéèêëîïôûáíóú]")
_CAMEL = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])")
_ALIAS = re.compile(r"[|;,]")
#: Least similarity of a token to a reference token, and of a whole entry (its tokens weighted by rarity).
TOKEN, ENTRY = 0.57, 0.74
#: The same of entries written as one word, which hide their tokens.
JOINED = 0.84
#: Largest reference list that is sent to the workers.
MOST_ENTRIES = 50_000
#: Least similarity of reference tokens of up to five letters.
SHORT_TOKEN = 0.5
#: Tokens longer than this are looked up by their parts instead of by deletions.
LONG = 16
#: Only reference tokens up to this length are abbreviated; longer ones are compounds.
SHORT = 13


def plain(text: str) -> str:
    """Width, look-alike letters and signs typed for letters levelled; letter case kept."""
    text = unicodedata.normalize("NFKC", text).translate(LOOKALIKE)
    out = []
    for w in re.split(r"(\s+|[_/|,;()\[\]*+&])", text):
        letters = sum(c.isalpha() for c in w)
        if letters >= 3 and any(c in LEET for c in w):
            keep = w.rstrip("!") if w.endswith("!") else w
            w = "".join(LEET.get(c, c) if 0 < i or c in "@134057$" else c for i, c in enumerate(keep))
            if all(c.isupper() for c in keep if c.isalpha()):
                w = w.upper()
        out.append(w)
    return "".join(out)


def fold(word: str) -> str:
    """Lower case, umlauts and accents in ASCII."""
    word = word.lower().replace("ß", "ss")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        word = word.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens(title: str) -> list[str]:
    """Tokens of a title: cut at marks, blanks and at inner capitals; joined forms of the parts come too."""
    s = plain(title)
    letters = [c for c in s if c.isalpha()]
    inverted = len(letters) > 3 and sum(c.isupper() for c in letters) > len(letters) / 2 and any(c.islower() for c in letters)
    s = s.swapcase() if inverted else s
    words = [w for w in re.split(r"[^\w]+|_", s) if w]
    out = []
    for w in words:
        parts = _CAMEL.split(w)
        short = [p for p in parts if len(p) > 1]
        out += [fold(p) for p in (short if len(short) > 1 and all(len(p) >= 3 for p in short) else [w])]
    return out


def grams_of(words: list[str]) -> list[tuple[str, int, int]]:
    """(form, first, last): tokens, and neighbours written as one."""
    out = [(w, i, i) for i, w in enumerate(words)]
    out += [(words[i] + words[i + 1], i, i + 1) for i in range(len(words) - 1)]
    return list(dict.fromkeys(out))


def skeleton(word: str) -> str:
    """First letter and the consonants after it, runs of one letter as one."""
    rest = _VOWELS.sub("", word[1:])
    return re.sub(r"(.)\1+", r"\1", word[:1] + rest)


def near_keys(word: str, reference: bool) -> set[str]:
    """Keys of which any two words within two edits share one, at any length.

    Up to ``LONG`` letters these are the word and its forms with one or two letters left out. A longer reference
    word is cut in three, one part of which two edits leave whole; a typed one shows what may be that part, at
    most two places off.
    """
    n, out = len(word), set()
    # the reference word's length decides; a typed word prepares for both where it may meet both
    if n <= (LONG if reference else LONG + 2):
        once = {word[:i] + word[i + 1 :] for i in range(n)}
        out = {word, *once, *(w[:i] + w[i + 1 :] for w in once for i in range(len(w)))}
        out = {x for x in out if len(x) >= min(2, n)}
    for size in (n,) if reference else range(n - 2, n + 3):
        if size > LONG:
            for k, (a, z) in enumerate(((0, size // 3), (size // 3, size * 2 // 3), (size * 2 // 3, size))):
                for i in range(a, a + 1) if reference else range(max(0, a - 2), min(a + 2, n - z + a) + 1):
                    part = word[i : i + z - a]
                    out.add(f"{size}:{k}:{part if len(part) <= 64 else hashlib.sha256(part.encode()).hexdigest()}")
    return out


def keys(word: str, reference: bool) -> set[str]:
    """Join keys: two words share one if they may be the same word."""
    out = {"w" + x for x in near_keys(word, reference)}
    s = skeleton(word)
    if len(s) == 2:
        out.add("s" + s)
    elif len(s) >= 8:
        out |= {"s" + x for x in near_keys(s, reference) if len(x) >= 2}
    elif len(s) >= 3:
        out |= {"s" + x for x in {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}}
    if reference:
        out |= {"p" + word[:n] for n in range(2, min(7, len(word)))}
        # of an abbreviation: its first, second and last letter, which come in this order
        rest = word[1:] if len(word) <= SHORT else ""
        out |= {"a" + word[:1] + rest[i] + c for i in range(len(rest)) for c in set(rest[i + 1 :])}
    elif 2 <= len(word) <= 6:
        out |= {"p" + word, "a" + word[:2] + word[-1]} if len(word) > 2 else {"p" + word}
    return out


def _common(a: str, b: str) -> int:
    """How many letters two words have in common, in any order."""
    n = 0
    for c in set(a):
        if c in b:
            n += min(a.count(c), b.count(c))
    return n


def distance(a: str, b: str, most: int) -> int:
    """Edits (swaps count once) from a to b, or ``most`` + 1 if there are more. Only the band that can hold so few is worked out."""
    # an edit changes one letter at most, so it costs one of those in common; a swap costs none
    if abs(len(a) - len(b)) > most or max(len(a), len(b)) - _common(a, b) > most:
        return most + 1
    if a[: len(b)] == b[: len(a)]:
        return abs(len(a) - len(b))
    before, last = [], [j if j <= most else most + 1 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < cost:
                cost = before[j - 2] + 1
            row[j] = cost
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _within(short: str, long: str) -> bool:
    """Whether all letters of ``short`` come in ``long`` in that order."""
    rest = iter(long)
    return all(c in rest for c in short)


def similarity(typed: str, reference: str) -> float:
    """1 for equal words, less by the share of edits; abbreviations and dropped vowels count as slips."""
    if typed == reference:
        return 1.0
    size = max(len(typed), len(reference))
    most = max(2, int(size * (1 - TOKEN)))
    edits = distance(typed, reference, most)
    best = 1 - edits / size if edits <= most else 0.0
    if typed.rstrip("s") == reference.rstrip("s") or typed in (reference + "in", reference + "en", reference + "innen"):
        best = max(best, 0.97)
    if typed[:1] == reference[:1] and len(typed) >= 2:
        if len(typed) <= 6 and len(reference) <= SHORT and reference.startswith(typed):
            best = max(best, 0.8 if len(typed) > 2 else 0.7)
        a, b = skeleton(typed), skeleton(reference)
        if a == b and len(a) >= 3:
            best = max(best, 0.85)
        elif a == b == typed:
            best = max(best, 0.75)
        elif len(a) >= 5 and (d := distance(a, b, 2)) <= (1 if len(a) < 8 else 2):
            best = max(best, 0.8 - 0.05 * d)
        if 3 <= len(typed) <= 6 and len(typed) < len(reference) <= SHORT and _within(typed, reference):
            best = max(best, 0.7)
        elif len(typed) > 6 and _within(typed, reference) and len(typed) >= 0.55 * len(reference):
            best = max(best, 0.78)
    return best


def aliases(text: str | None) -> list[str]:
    """Aliases of a record: JSON text or a list with a separator."""
    s = (text or "").strip()
    if s.startswith("["):
        try:
            return [str(x).strip() for x in json.loads(s) if x is not None and str(x).strip()]
        except ValueError:
            s = s.strip("[]")
    return [x.strip().strip('"') for x in _ALIAS.split(s) if x.strip().strip('"')]


def entries(reference: DataFrame, uri: str, label: str, alias: str) -> DataFrame:
    """(entry, tokens, uris, rank): distinct labels and aliases with the records they belong to.

    An entry that is some record's label belongs to records with that label only.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, lab, al in zip(b["uri"], b["label"], b["alias"]):
                own = [(" ".join(t), t, u, k) for x, k in [(lab, 0)] * bool(lab) + [(x, 1) for x in aliases(al)] if (t := tokens(x)) and u]
                out += own + [(t, [t], u, k + 2) for e, w, _, k in own if len(w) > 1 and (t := "".join(w))]
            yield pd.DataFrame(out, columns=["entry", "tokens", "uri", "rank"]).drop_duplicates(["entry", "uri", "rank"])

    read = reference.select(F.col(uri).alias("uri"), F.col(label).alias("label"), F.col(alias).alias("alias"))
    all_rows = read.mapInPandas(rows, "entry string, tokens array<string>, uri string, rank int")
    best = all_rows.groupBy("entry").agg(F.min("rank").alias("rank"), F.first("tokens").alias("tokens"), F.collect_set(F.struct("rank", "uri")).alias("of"))
    own = F.array_distinct(F.transform(F.filter("of", lambda x: (x["rank"] == F.col("rank")) | (F.col("rank") % 2 == 1)), lambda x: x["uri"]))
    return best.select("entry", "tokens", F.array_sort(own).alias("uris"), "rank")


def repair_tokens(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): reference words that each distinct typed token may stand for.

    ``typed`` has token, ``vocabulary`` has word; the join is on shared keys, then by edit distance.
    """

    def spread(reference: bool, name: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(k, w) for w in b[name] for k in keys(w, reference)], columns=["k", name])

        return run

    left = typed.repartition(int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(spread(False, "token"), "k string, token string")
    right = vocabulary.mapInPandas(spread(True, "word"), "k string, word string")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, w, s) for t, w in zip(b["token"], b["word"]) if (s := similarity(t, w)) >= (TOKEN if len(w) > 5 else SHORT_TOKEN)]
            yield pd.DataFrame(rows, columns=["token", "word", "sim"])

    # few bytes, but each pair is dear: they are spread by rows
    pairs = left.join(right, "k").select("token", "word").distinct()
    return pairs.repartition(int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(score, "token string, word string, sim double")


def rank_by_join(forms: DataFrame, repaired: DataFrame, ref: DataFrame, idf: DataFrame) -> DataFrame:
    """(norm, b: entry, uris, score): the best entry of each title, for reference lists of any size.

    ``forms`` has norm and token, ``repaired`` token, word, sim and idf.
    """
    # the repairs of a title's own tokens, best per reference word
    found = forms.distinct().join(repaired, "token").groupBy("norm", "word").agg(F.max(F.struct("sim", "token")).alias("s"))
    per_title = found.groupBy("norm").agg(F.map_from_entries(F.collect_list(F.struct("word", "s"))).alias("sims"), F.collect_set("word").alias("words"))
    # an entry is looked up under its rarest token
    weighed = ref.select("entry", "uris", "rank", F.explode("tokens").alias("word")).join(idf, "word").groupBy("entry", "uris", "rank").agg(F.collect_list(F.struct("word", "idf")).alias("parts"), F.max_by("word", F.struct("idf", "word")).alias("head"))
    pairs = per_title.select("norm", "sims", F.explode("words").alias("head")).join(weighed, "head")
    hit = F.transform("parts", lambda p: F.struct(p["idf"].alias("idf"), F.try_element_at(F.col("sims"), p["word"]).alias("s")))
    pairs = pairs.select("norm", "entry", "uris", "rank", hit.alias("hit")).where(F.forall("hit", lambda h: h["s"].isNotNull()))
    # each token of the title stands for one token of the entry only
    used = F.transform("hit", lambda h: h["s"]["token"])
    pairs = pairs.where(F.size(F.array_distinct(used)) == F.size(used))
    total = F.aggregate("hit", F.lit(0.0), lambda a, h: a + h["idf"])
    score = F.aggregate("hit", F.lit(0.0), lambda a, h: a + h["idf"] * h["s"]["sim"]) / total
    pairs = pairs.select("norm", "entry", "uris", "rank", score.alias("score"), total.alias("mass")).where(F.col("score") >= F.when(F.col("rank") >= 2, JOINED).otherwise(ENTRY))
    order = F.struct((F.col("score") * F.log(1 + F.col("mass"))).alias("s"), -F.col("rank"), F.col("entry"))
    return pairs.groupBy("norm").agg(F.max_by(F.struct("entry", "uris", "score"), order).alias("b"))


def rank_at_hand(forms: DataFrame, repaired: DataFrame, ref: list[tuple]) -> DataFrame:
    """The same as :func:`rank_by_join`, for a reference list small enough to go to every worker (checked)."""
    import math

    df: dict[str, int] = {}
    for entry in ref:
        for w in set(entry[1]):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + 1000.0 / n) for w, n in df.items()}
    heads: dict[str, list[tuple]] = {}
    for entry, words, uris, rank in ref:
        weights = [idf[w] for w in words]
        head = max(words, key=lambda w: (idf[w], w))
        heads.setdefault(head, []).append((entry, list(words), weights, sum(weights), list(uris), rank))
    shared = forms.sparkSession.sparkContext.broadcast(heads)
    hits = repaired.groupBy("token").agg(F.collect_list(F.struct("word", "sim")).alias("hits"))
    titles = forms.distinct().join(hits, "token").groupBy("norm").agg(F.collect_list(F.struct("token", "hits")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = shared.value
        for b in batches:
            out = []
            for norm, found in zip(b["norm"], b["t"]):
                sims: dict[str, tuple[float, str]] = {}
                for x in found:
                    for h in x["hits"]:
                        if (new := (h["sim"], x["token"])) > sims.get(h["word"], (0.0, "")):
                            sims[h["word"]] = new
                best = None
                for head in sims:
                    for entry, words, weights, total, uris, rank in heads.get(head, ()):
                        got = [sims.get(w) for w in words]
                        if None in got or len({g[1] for g in got}) < len(got):
                            continue
                        score = sum(w * g[0] for w, g in zip(weights, got)) / total
                        if score >= (JOINED if rank >= 2 else ENTRY):
                            key = (score * math.log(1 + total), -rank, entry)
                            if best is None or key > best[0]:
                                best = (key, entry, uris, score)
                if best:
                    out.append((norm, {"entry": best[1], "uris": best[2], "score": best[3]}))
            yield pd.DataFrame(out, columns=["norm", "b"])

    return titles.mapInPandas(run, "norm string, b struct<entry:string,uris:array<string>,score:double>")


def resolve(titles: DataFrame, key: str, title: str, reference: DataFrame, uri: str, label: str, alias: str, cache=None) -> DataFrame:
    """(key, uri, entry, score): one row per title that is not blank; uri may be ``ambiguous`` or ``none``.

    ``cache`` may write a DataFrame down and read it back (see ``session.materialise``).
    """
    keep = cache or (lambda x, _: x)
    ref = keep(entries(reference, uri, label, alias), "entries")
    rows = titles.where(F.length(F.trim(F.regexp_replace(F.col(title), r"(?U)\s+", " "))) > 0).select(F.col(key).alias("key"), F.col(title).alias("title"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["title"]:
                words = tokens(t)
                out.append((t, " ".join(words), [{"form": f, "a": i, "z": j} for f, i, j in grams_of(words)], len(words)))
            yield pd.DataFrame(out, columns=["title", "norm", "forms", "n"])

    distinct = rows.select("title").distinct().mapInPandas(cut, "title string, norm string, forms array<struct<form:string,a:int,z:int>>, n int")
    distinct = keep(distinct, "titles")
    norms = distinct.groupBy("norm").agg(F.first("forms").alias("forms"))
    forms = norms.select("norm", F.explode("forms").alias("f")).select("norm", F.col("f.form").alias("token"))
    vocabulary = ref.select(F.explode("tokens").alias("word"), "entry").groupBy("word").agg(F.count_distinct("entry").alias("df"))
    repaired = repair_tokens(forms.select("token").distinct(), vocabulary.select("word"))
    weight = F.log(1 + F.lit(1000.0) / F.col("df"))
    repaired = keep(repaired.join(vocabulary.select("word", weight.alias("idf")), "word"), "repaired")
    rows_of = ref.select("entry", "tokens", "uris", "rank").limit(MOST_ENTRIES + 1).collect()
    if len(rows_of) <= MOST_ENTRIES:
        best = rank_at_hand(forms, repaired, [tuple(r) for r in rows_of])
    else:
        best = rank_by_join(forms, repaired, ref, vocabulary.select("word", weight.alias("idf")))
    named = F.when(F.size("b.uris") > 1, "ambiguous").otherwise(F.element_at("b.uris", 1))
    answer = distinct.select("title", "norm").join(best.select("norm", named.alias("uri"), "b.entry", "b.score"), "norm", "left")
    out = rows.join(answer.select("title", "uri", "entry", "score"), "title", "left")
    return out.select(F.col("key").alias(key), F.coalesce("uri", F.lit("none")).alias("uri"), "entry", "score")
