"""Free-text titles to taxonomy records: exact, then alias, then fuzzy, with a confidence policy.

Titles are resolved once per normalised form and joined back. Each stage sees only what the one before left
(left anti join). Exact and alias are equi joins on the term table; fuzzy scores the remaining forms against
the distinct terms, which go to the workers as one array of checked size; longer lists are refused.

Null and blank titles are unresolved; over-long ones carry an error. Ties are broken by term, then by
record order, so results do not depend on partitioning.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vitalake.config import MatchConfig
from vitalake.functions.scorers import ratio, scorer, weighted_ratio

CFG = MatchConfig()
_HYPHEN = re.compile(r"[-‐‑‒–—―]")


def normalise_text(text: str, cfg: MatchConfig = CFG) -> str:
    s = unicodedata.normalize("NFKC", text)
    s = s.casefold() if cfg.casefold else s
    s = _HYPHEN.sub(" ", s)
    s = re.sub(r"[^\w\s]", " ", s) if cfg.strip_marks else s
    return re.sub(r"\s+", " ", s).strip()


@F.pandas_udf(StringType())
def normalise(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, hyphens and marks as blanks, blanks squeezed; null stays null."""
    return s.map(lambda t: normalise_text(t) if isinstance(t, str) else None)


def parse_aliases(c: Column) -> Column:
    """JSON lists, or lists parted by a bar, semicolon or comma; trimmed, without empty ones. JSON nulls become ``None``."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    s = trim(F.coalesce(c, F.lit("")))
    listed = F.when(s.startswith("["), F.transform(F.from_json(s, "array<string>"), lambda x: F.coalesce(x, F.lit("None"))))
    parts = F.coalesce(listed, F.split(s, "[|;,]"))
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def _term_rows(taxonomy: DataFrame) -> DataFrame:
    """(text, field, uri, rec_seq, term, own): as :func:`terms`, with the aliases equal to their own label, marked."""
    t = taxonomy.where(F.col("preferred_label").isNotNull()).select(F.coalesce("uri", F.lit("")).alias("uri"), "preferred_label", "alt_labels", "rec_seq")
    last = t.groupBy("uri").agg(F.max_by(F.struct("preferred_label", "alt_labels"), "rec_seq").alias("r"), F.min("rec_seq").alias("rec_seq"))
    label = last.select("uri", "rec_seq", F.lit("preferred_label").alias("field"), F.col("r.preferred_label").alias("term"))
    alias = last.select("uri", "rec_seq", F.lit("alias").alias("field"), F.explode(parse_aliases(F.col("r.alt_labels"))).alias("term"))
    rows = label.unionByName(alias).withColumn("text", normalise("term")).where("text <> ''")
    own = rows.where("field = 'preferred_label'").select("uri", F.col("text").alias("own"))
    rows = rows.join(own, "uri", "left").withColumn("own", (F.col("field") == "alias") & (F.col("text") == F.coalesce("own", F.lit(""))))
    return rows.groupBy("text", "field", "uri", "own").agg(F.min("rec_seq").alias("rec_seq"), F.min("term").alias("term"))


def terms(taxonomy: DataFrame) -> DataFrame:
    """(text, field, uri, rec_seq, term): normalised labels and aliases, one row per text, record and field.

    ``taxonomy`` has uri, preferred_label, alt_labels and rec_seq. Of repeated records the last values and the
    first position hold; an alias equal to its own label is dropped; rows without a label are left out.
    """
    return _term_rows(taxonomy).where("not own").drop("own")


class _Subsequences:
    """Longest common subsequences of one text with many, a machine word of rows at a time."""

    def __init__(self, texts: list[str]):
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        own = [texts[i] for i in self.order]
        self.sizes = np.array([len(t) for t in own], dtype=np.int64)
        self.ids = {c: i + 1 for i, c in enumerate(sorted({c for t in own for c in t}))}
        # column k holds the k-th letters of the texts that are longer than k
        self.begin = [int(np.searchsorted(self.sizes, k, "right")) for k in range(int(self.sizes.max(initial=0)))]
        self.columns = [np.array([self.ids[t[k]] for t in own[i:]], dtype=np.int64) for k, i in enumerate(self.begin)]
        self.letters = np.array([self.count(t) for t in own], dtype=np.int64).reshape(len(own), 64)

    @staticmethod
    def count(text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % 64, minlength=64)

    def most(self, q: str) -> np.ndarray:
        """Length of the longest common subsequence with each text; for a q of over 64 letters no less than it."""
        if len(q) > 64:
            got = np.minimum(np.minimum(self.letters, self.count(q)).sum(1), self.sizes)
        else:
            where = np.zeros(len(self.ids) + 1, np.uint64)
            for i, c in enumerate(q):
                if k := self.ids.get(c):
                    where[k] |= np.uint64(1 << i)
            rows = np.full(len(self.sizes), 2**64 - 1, np.uint64)
            for i, column in zip(self.begin, self.columns):
                hit = rows[i:] & where[column]
                rows[i:] = (rows[i:] + hit) | (rows[i:] - hit)
            got = np.bitwise_count(~rows & np.uint64((1 << len(q)) - 1)).astype(np.int64)
        out = np.empty(len(got), np.int64)
        out[self.order] = got
        return out


class _Bound:
    """The best scores (``ratio`` or ``weighted_ratio``) without scoring every text: common subsequences bound them from above.

    Texts are scored in the order of their bound until no other can reach the last kept one or ``least``, so nothing is lost.
    """

    def __init__(self, texts: list[str], score=ratio):
        self.texts, self.score, self.sizes = texts, score, np.array([len(t) for t in texts], dtype=np.float64)
        self.plain = _Subsequences(texts)
        if score is not ratio:
            tokens = [sorted(t.split()) for t in texts]
            # in the order of their tokens, as they are and each token once
            lines, sets = [" ".join(x) for x in tokens], [" ".join(sorted(set(x))) for x in tokens]
            self.sorted, self.sorted_sizes = _Subsequences(lines), np.array([len(x) for x in lines], dtype=np.float64)
            self.sets, self.set_sizes = _Subsequences(sets), np.array([len(x) for x in sets], dtype=np.float64)
            self.having: dict[str, list[int]] = {}
            for i, x in enumerate(tokens):
                for w in set(x):
                    self.having.setdefault(w, []).append(i)

    def bounds(self, q: str) -> np.ndarray:
        """No less than the score of each text."""
        size, n = self.sizes, len(q)
        whole = self.plain.most(q)
        plain = 200.0 * whole / (size + n)
        if self.score is ratio:
            return plain
        tokens = sorted(q.split())
        line, once = " ".join(tokens), " ".join(sorted(set(tokens)))
        by_line, by_set = self.sorted.most(line), self.sets.most(once)
        meets = np.zeros(len(self.texts), bool)
        for w in set(tokens):
            meets[self.having.get(w, [])] = True
        # of lengths below 1.5 to 1; a common token may make the sets equal
        sort = 200.0 * by_line / (self.sorted_sizes + len(line))
        near = np.maximum(sort, np.where(meets, 100.0, 200.0 * by_set / (self.set_sizes + len(once))))
        # a stretch of the longer text holds no longer common subsequence than the whole, and is at least that long
        part = lambda k, a, b: 200.0 * k / (np.minimum(a, b) + np.maximum(k, 1))
        far = np.maximum(part(whole, size, n), 0.95 * np.where(meets, 100.0, np.maximum(part(by_line, self.sorted_sizes, len(line)), part(by_set, self.set_sizes, len(once)))))
        times = np.maximum(size, n) / np.minimum(size, n)
        return np.maximum(plain, np.where(times < 1.5, 0.95 * near, np.where(times <= 8, 0.9, 0.6) * far))

    def best(self, q: str, k: int, least: float = 0.0) -> list[tuple[float, str]]:
        """(score below 0, text) of the k best texts; those under ``least`` may be left out."""
        if not self.texts or not q:
            return []
        most = self.bounds(q)
        heap: list[tuple[float, str]] = []
        kept = least
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] < kept - 1e-9:
                break
            heap.append((-self.score(q, self.texts[i]), self.texts[i]))
            if len(heap) >= k:
                heap = heapq.nsmallest(k, heap)
                kept = max(least, -heap[-1][0])
        return sorted(heap)[:k]


def _fuzzy(forms: DataFrame, term_rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(norm, uri, rank, similarity, weighted, matched_text, matched_field): the best records of each form.

    ``term_rows`` has the label of its record beside it. An alias equal to its record's label counts in the score, but is no candidate
    of its own. Equal scores are in descending order of the label.
    """
    own = F.col("field") == "alias"
    records = term_rows.groupBy("uri").agg(
        F.min("rec_seq").alias("rec_seq"), F.max(F.when(F.col("field") == "preferred_label", F.col("text"))).alias("label"), F.array_sort(F.collect_set(F.when(own & ~F.col("own"), F.col("text")))).alias("aliases"),
        F.max(F.when(F.col("own"), F.col("text"))).alias("own"), F.max("label").alias("name"),
    )
    rows = records.orderBy("rec_seq", "uri").limit(cfg.max_reference + 1).collect()
    if len(rows) > cfg.max_reference:
        raise ValueError("the reference list exceeds max_reference; resolve it in parts")
    refs = [(r["uri"], r["label"] or "", list(r["aliases"] or []), [r["own"]] if r["own"] else [], r["name"] or "") for r in rows]
    shared = forms.sparkSession.sparkContext.broadcast(refs)
    schema = "norm string, uri string, rank int, similarity double, weighted double, matched_text string, matched_field string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, score = shared.value, scorer(cfg.scorer)
        owners: dict[str, list[tuple[int, str]]] = {}
        for i, (_, label, aliases, _, _) in enumerate(refs):
            owners.setdefault(label, []).append((i, "preferred_label"))
            for a in aliases:
                owners.setdefault(a, []).append((i, "alias"))
        texts = sorted(t for t in owners if t)
        bound = _Bound(texts, score) if score in (ratio, weighted_ratio) else None
        for b in batches:
            out = []
            for q in b["norm"]:
                # a record none of whose texts reaches the threshold cannot reach it by their weighted mean
                top = bound.best(q, cfg.candidate_limit, cfg.threshold) if bound else heapq.nsmallest(cfg.candidate_limit, ((-score(q, t), t) for t in texts))
                best: dict[int, tuple] = {}
                known = {t: -neg for neg, t in top}
                for neg, t in top:
                    for i, where in owners[t]:
                        label, aliases = refs[i][1], refs[i][2] + refs[i][3]
                        known |= {x: score(q, x) for x in (label, *aliases) if x not in known}
                        label_score = known[label]
                        total = cfg.label_weight * label_score + cfg.alias_weight * max((known[a] for a in aliases), default=0.0)
                        weighted = total / (cfg.label_weight + cfg.alias_weight)
                        # the first entry of a record in the order of raw scores stands for it
                        best.setdefault(i, (refs[i][0], label_score if where == "preferred_label" else -neg, weighted, label if where == "preferred_label" else t, where))
                kept = [x for x in best.values() if x[2] >= cfg.threshold]
                names = {x[0]: refs[i][4] for i, x in best.items()}
                kept.sort(key=lambda x: (x[2], x[1], names[x[0]]), reverse=True)
                out += [(q, x[0], n, *x[1:]) for n, x in enumerate(kept[: min(cfg.limit, cfg.max_limit)])]
            yield pd.DataFrame(out, columns=["norm", "uri", "rank", "similarity", "weighted", "matched_text", "matched_field"])

    # few rows, but each is dear: they are spread over all tasks
    spread = forms.repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")), "norm")
    return spread.mapInPandas(run, schema)


def confidence(score: Column, margin: Column) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.round(unit(score / 100) * 0.75 + unit(margin / 20) * 0.25, 4)


def title_form(title: Column, cfg: MatchConfig = CFG) -> Column:
    """The normalised form under which a title is looked up; null for over-long ones."""
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(text) <= cfg.max_query_length, normalise(text))


def sure_hits(forms: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``forms`` (norm and other columns) with uri, rec_seq, match_type, matched_text and matched_field of all records whose label, or
    else whose alias, a form is; an alias of several records is ``ambiguous``. Forms that are neither have no row."""
    rows = terms(taxonomy)
    best = rows.groupBy("text").agg(F.min(F.when(F.col("field") == "preferred_label", 0).otherwise(1)).alias("kind"))
    many = F.count(F.lit(1)).over(Window.partitionBy("text"))
    kept = rows.join(best, "text").where((F.col("kind") == 1) | (F.col("field") == "preferred_label"))
    kind = F.when(F.col("kind") == 0, "exact").when(many > 1, "ambiguous").otherwise("alias")
    return forms.join(kept.select(F.col("text").alias("norm"), "uri", "rec_seq", kind.alias("match_type"), F.col("term").alias("matched_text"), F.col("field").alias("matched_field")), "norm")


#: What a record carries besides its names, and what stands for it where the taxonomy has no such column.
_DETAILS = {"isco_code": "", "definition": "", "taxonomy": "occupations", "source": "database"}


def resolve(titles: DataFrame, key: str, title: str, taxonomy: DataFrame, cfg: MatchConfig = CFG, threshold: float | None = None, limit: int | None = None) -> DataFrame:
    """One row per title: key, input, normalized_input, status, standardized, uri, isco_code, definition, taxonomy, source,
    similarity, confidence, margin, match_type, matched_field, matched_text, second_best_similarity, second_best_score, alternatives, error.

    status is accepted, review, unresolved or ambiguous. An ambiguous or empty result has no standardized value;
    an unresolved fuzzy one still names its best match. ``threshold`` and ``limit`` replace those of ``cfg`` for this call.
    """
    cfg = replace(cfg, **{k: v for k, v in {"threshold": threshold, "limit": None if limit is None else min(limit, cfg.max_limit)}.items() if v is not None})
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = titles.select(F.col(key).alias("key"), text.alias("input"))
    rows = rows.withColumn("error", F.when(F.length("input") > cfg.max_query_length, f"title longer than {cfg.max_query_length}"))
    rows = rows.withColumn("norm", F.when(F.col("error").isNull(), normalise("input")))
    forms = rows.where("norm <> ''").select("norm").distinct()
    details = [(F.coalesce(F.col(c), F.lit(x)) if c in taxonomy.columns else F.lit(x)).alias(c) for c, x in _DETAILS.items()]
    named = taxonomy.where(F.col("preferred_label").isNotNull()).groupBy(F.coalesce("uri", F.lit("")).alias("uri")).agg(F.max_by(F.struct(F.col("preferred_label").alias("label"), *details), "rec_seq").alias("r")).select("uri", "r.*")
    every_term = _term_rows(taxonomy).join(named.select("uri", "label"), "uri")
    sure = sure_hits(forms, taxonomy).select("norm", "uri", F.col("rec_seq").alias("rank"), "match_type", F.lit(100.0).alias("similarity"), F.lit(100.0).alias("weighted"), "matched_text", "matched_field")
    rest = forms.join(sure.select("norm").distinct(), "norm", "left_anti")
    fuzzy = _fuzzy(rest, every_term, cfg).withColumn("match_type", F.lit("fuzzy")).select(*sure.columns)
    every = sure.unionByName(fuzzy).join(named, "uri")
    # at most ``limit`` fuzzy rows in their rank, or the records that share a label or alias in their order, per form
    shown = [F.col("label").alias("standardized"), "uri", *_DETAILS, "similarity", F.col("weighted").alias("weighted_score"), "match_type", "matched_field", "matched_text"]
    best = every.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("o"), *shown))).alias("m"))
    one, two = F.element_at("m", 1), F.try_element_at("m", F.lit(2))
    margin = one["weighted_score"] - F.coalesce(two["weighted_score"], F.lit(0.0))
    ambiguous = one["match_type"] == "ambiguous"
    sure = one["match_type"].isin("exact", "alias")
    score = one["weighted_score"]
    status = (
        F.when(ambiguous, "ambiguous").when(sure, "accepted").when((score >= cfg.accept_threshold) & (margin >= cfg.accept_margin), "accepted")
        .when((score >= cfg.review_threshold) & (margin >= cfg.review_margin), "review").otherwise("unresolved")
    )
    shown = lambda c: F.when(~ambiguous, one[c]).alias(c)
    second = lambda c: F.when(ambiguous, 0.0).otherwise(F.round(F.coalesce(two[c], F.lit(0.0)), 2))
    rest_of = F.when(ambiguous, F.col("m")).otherwise(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))))
    two_digits = lambda x: x.dropFields("o").withField("similarity", F.round(x["similarity"], 2)).withField("weighted_score", F.round(x["weighted_score"], 2))
    decided = best.select(
        "norm", status.alias("status"), shown("standardized"), shown("uri"), *[shown(c) for c in _DETAILS], F.round(one["similarity"], 2).alias("similarity"),
        F.when(ambiguous, 0.0).when(sure, 1.0).otherwise(confidence(score, margin)).alias("confidence"), F.when(ambiguous, 0.0).otherwise(F.round(margin, 2)).alias("margin"),
        one["match_type"].alias("match_type"), shown("matched_field"), shown("matched_text"), second("similarity").alias("second_best_similarity"), second("weighted_score").alias("second_best_score"),
        F.transform(rest_of, two_digits).alias("alternatives"),
    )
    out = rows.join(decided, "norm", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(
        F.col("key").alias(key), "input", F.coalesce("norm", F.lit("")).alias("normalized_input"), F.coalesce("status", F.lit("unresolved")).alias("status"), "standardized", "uri", *_DETAILS,
        zero("similarity"), zero("confidence"), zero("margin"), "match_type", "matched_field", "matched_text", zero("second_best_similarity"), zero("second_best_score"),
        F.coalesce("alternatives", F.array().cast(decided.schema["alternatives"].dataType)).alias("alternatives"), "error",
    )


def resolve_cached(titles: DataFrame, key: str, title: str, taxonomy: DataFrame, cached: DataFrame | None, cfg: MatchConfig = CFG) -> tuple[DataFrame, DataFrame]:
    """(results of all titles, the new entries for the cache).

    ``cached`` has cache_key, result (a struct as :func:`resolve` gives, without key and input), resolved_at and expires_at; entries that have
    expired are passed over, of several the last resolved holds. Only titles without an entry are resolved, once per
    normalised form, by an anti join; results have ``cache_hit``. New entries live shorter if they name nothing.
    """
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = titles.select(F.col(key).alias("key"), text.alias("input")).withColumn("norm", normalise("input")).withColumn("cache_key", cache_key(F.col("norm"), cfg))
    known = None
    if cached is not None:
        known = cached.where(F.col("expires_at") > F.current_timestamp()).groupBy("cache_key").agg(F.max_by("result", "resolved_at").alias("result"))
    asked = rows.groupBy("cache_key").agg(F.min("input").alias("input"))
    asked = asked.join(known.select("cache_key"), "cache_key", "left_anti") if known is not None else asked
    done = resolve(asked, "cache_key", F.col("input"), taxonomy, cfg)
    fields = [c for c in done.columns if c not in ("cache_key", "input")]
    fresh = done.select("cache_key", F.struct(*fields).alias("result"), F.lit(False).alias("cache_hit"))
    every = fresh if known is None else fresh.unionByName(known.select("cache_key", "result", F.lit(True).alias("cache_hit")))
    out = rows.join(every, "cache_key").select(F.col("key").alias(key), "input", "result.*", "cache_hit")
    now = F.current_timestamp()
    entries = fresh.select("cache_key", "result", now.alias("resolved_at"), (now + F.make_interval(secs=ttl(F.col("result.status"), cfg).cast("decimal(18,6)"))).alias("expires_at"))
    return out, entries


def cache_key(query: Column, cfg: MatchConfig = CFG) -> Column:
    """prefix:version:sha256 of the query with its parameters, as sorted JSON."""
    text = F.concat(F.lit(f'{{"limit": {cfg.limit}, "query": '), F.regexp_replace(F.to_json(F.array(query)), r"^\[|\]$", ""), F.lit(f', "threshold": {float(cfg.threshold)}, "version": "{cfg.cache_version}"}}'))
    return F.concat_ws(":", F.lit(cfg.cache_prefix), F.lit(cfg.cache_version), F.sha2(text, 256))


def ttl(status: Column, cfg: MatchConfig = CFG) -> Column:
    return F.when(status.isin("unresolved", "ambiguous"), max(1, cfg.negative_ttl_seconds)).otherwise(max(1, cfg.ttl_seconds))


def summary(resolved: DataFrame) -> DataFrame:
    """(status, match_type, n): counters of a resolved table; with ``cache_hit`` (see :func:`resolve_cached`) also hits and misses of the cache."""
    extra = [F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses")] if "cache_hit" in resolved.columns else []
    return resolved.groupBy("status", "match_type").agg(F.count(F.lit(1)).alias("n"), *extra)


def search(resolved: DataFrame, key: str) -> DataFrame:
    """(key, rank, preferred_label, uri, weighted_score): the best match and its alternatives as rows; nothing for titles without a standardized value."""
    first = F.struct(F.col("standardized").alias("preferred_label"), F.col("uri"), F.col("similarity").alias("weighted_score"))
    rest = F.transform("alternatives", lambda a: F.struct(a["standardized"].alias("preferred_label"), a["uri"].alias("uri"), a["weighted_score"].alias("weighted_score")))
    rows = resolved.where("standardized is not null").select(key, F.posexplode(F.concat(F.array(first), rest)).alias("rank", "x"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), "x.*")
