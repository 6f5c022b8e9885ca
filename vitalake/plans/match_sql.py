"""SQL of compatibility forms and of the title matcher with the plain ratio, over the whole tables."""

from __future__ import annotations

import functools
import unicodedata

from vitalake.functions.text import BLANK as WS
from vitalake.operators.matching import CFG


@functools.lru_cache(maxsize=2)
def folded(case: bool) -> str:
    """A VALUES list of the characters whose compatibility form (and, with ``case``, folded form) is another text. Syllable blocks
    and ideographs are left to the composition, which comes after."""
    fold = (lambda c: unicodedata.normalize("NFKC", c).casefold()) if case else (lambda c: unicodedata.normalize("NFKC", c))
    points = [*range(0x20, 0x3400), *range(0xF900, 0x10000)]
    rows = [(n, fold(chr(n))) for n in points if fold(chr(n)) != chr(n)]
    return "VALUES " + ", ".join(f"({n}, '" + x.replace("'", "''") + "')" for n, x in rows)


def nfkc(source: str, case: bool = False) -> str:
    """CTEs that end in ``plain`` (text, folded): the distinct texts of the table ``source`` (text), without nulls."""
    return f"""fm(n, x) AS MATERIALIZED ({folded(case)}), ft AS (SELECT DISTINCT text FROM {source} WHERE text IS NOT NULL), fc AS (SELECT text, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM ft),
fx AS (SELECT text, i, coalesce(x, c) AS c FROM fc LEFT JOIN fm ON fm.n = unicode(c) AND length(c) > 0), plain AS (SELECT ft.text, nfc_normalize(coalesce(g.t, '')) AS folded FROM ft LEFT JOIN (SELECT text, string_agg(c, '' ORDER BY i) AS t FROM fx GROUP BY text) g USING (text))"""


_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(folded, '[-‐‑‒–—―]', ' ', 'g'), '[^\p{L}\p{N}_\s\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\x{1680}]', ' ', 'g'), '[\s\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\x{1680}]+', ' ', 'g'), '^ | $', '', 'g')"
_TWO = "CAST(round(CAST({0} AS DECIMAL(18, 10)), 2) AS DOUBLE)"

#: Titles, records and normalised terms; the exact and alias matches.
_SURE = f"""rec AS (SELECT coalesce(uri, '') AS uri, arg_max({{'l': preferred_label, 'a': alt_labels}}, rec_seq) AS r, min(rec_seq) AS rec_seq FROM occupations WHERE preferred_label IS NOT NULL GROUP BY 1),
ra AS (SELECT *, regexp_replace(coalesce(r.a, ''), '^{WS}+|{WS}+$', '', 'g') AS a FROM rec),
terms0 AS (SELECT uri, rec_seq, r.l AS label, 'preferred_label' AS field, r.l AS term FROM ra UNION ALL SELECT uri, rec_seq, r.l, 'alias', regexp_replace(unnest(CASE WHEN starts_with(a, '[') AND json_valid(a) THEN from_json(a, '["VARCHAR"]') ELSE regexp_split_to_array(a, '[|;,]') END), '^{WS}+|{WS}+$', '', 'g') FROM ra),
ti AS (SELECT result_id, regexp_replace(coalesce(input, ''), '^{WS}+|{WS}+$', '', 'g') AS input FROM resolution_results),
every AS (SELECT input AS text FROM ti UNION ALL SELECT term FROM terms0), {nfkc("every", case=True)}, nm AS MATERIALIZED (SELECT text AS raw, {_NORM} AS norm FROM plain),
tt AS MATERIALIZED (SELECT uri, rec_seq, label, field, nm.norm AS text, min(term) AS term, bool_or(field = 'alias' AND nm.norm = lab.norm) AS own FROM terms0 JOIN nm ON nm.raw = term JOIN nm lab ON lab.raw = label WHERE nm.norm <> '' GROUP BY ALL),
tn AS MATERIALIZED (SELECT result_id, input, CASE WHEN length(input) <= {CFG.max_query_length} THEN nm.norm END AS norm FROM ti JOIN nm ON nm.raw = input),
fs AS (SELECT DISTINCT norm FROM tn WHERE norm <> ''),
ex AS (SELECT norm, uri, rec_seq AS o, label, 100.0::DOUBLE AS similarity, 100.0::DOUBLE AS weighted, 'exact' AS match_type, field, term AS matched FROM fs JOIN tt ON tt.text = norm AND field = 'preferred_label'),
al AS (SELECT norm, uri, rec_seq AS o, label, 100.0::DOUBLE AS similarity, 100.0::DOUBLE AS weighted, CASE WHEN count(*) OVER (PARTITION BY norm) > 1 THEN 'ambiguous' ELSE 'alias' END AS match_type, field, term AS matched FROM fs JOIN tt ON tt.text = norm AND field = 'alias' AND NOT own WHERE norm NOT IN (SELECT norm FROM ex))"""

#: Longest common subsequences, one bit a letter of the term.
_FUZZY = f"""rest AS (SELECT norm, length(norm) AS n, string_split(norm, '') AS cs FROM fs WHERE norm NOT IN (SELECT norm FROM ex UNION ALL SELECT norm FROM al)),
tx AS (SELECT DISTINCT text, length(text) AS m FROM tt), tc AS (SELECT text, m, unnest(string_split(text, '')) AS c, unnest(range(m)) AS i FROM tx),
tb AS (SELECT text, m, map_from_entries(list((c, b))) AS bits FROM (SELECT text, m, c, CAST(sum(CAST(1 AS HUGEINT) << CAST(i AS HUGEINT)) AS HUGEINT) AS b FROM tc GROUP BY text, m, c) GROUP BY text, m),
lc AS (SELECT norm, text, n, m, (CAST(1 AS HUGEINT) << CAST(m AS HUGEINT)) - 1 AS everyone, list_transform(cs, lambda c: coalesce(bits[c], CAST(0 AS HUGEINT))) AS masks FROM rest, tb),
ls AS (SELECT norm, text, n, m, m - bit_count(list_reduce(list_prepend(everyone, masks), lambda s, k: ((s + (s & k)) | (s - (s & k))) & everyone)) AS common FROM lc),
sc AS MATERIALIZED (SELECT norm, text, 200.0::DOUBLE * common / (n + m) AS score FROM ls),
top AS (SELECT norm, text, score FROM sc QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, text) <= {CFG.candidate_limit}),
bl AS (SELECT norm, uri, max(CASE WHEN field = 'preferred_label' THEN score END) AS ls, max(CASE WHEN field = 'alias' THEN score END) AS als FROM sc JOIN tt USING (text) GROUP BY norm, uri),
fz AS (SELECT norm, uri, label, score AS similarity, {CFG.label_weight} * ls + {CFG.alias_weight} * coalesce(als, 0.0) AS weighted, field, text AS matched FROM top JOIN tt USING (text) JOIN bl USING (norm, uri) WHERE NOT own
 QUALIFY row_number() OVER (PARTITION BY norm, uri ORDER BY score DESC, text, CASE field WHEN 'preferred_label' THEN 0 ELSE 1 END) = 1),
fr AS (SELECT norm, uri, row_number() OVER (PARTITION BY norm ORDER BY weighted DESC, similarity DESC, label DESC) AS o, label, similarity, weighted, 'fuzzy' AS match_type, field, matched FROM fz WHERE weighted >= {CFG.threshold} QUALIFY row_number() OVER (PARTITION BY norm ORDER BY weighted DESC, similarity DESC, label DESC) <= {CFG.limit})"""

SURE = f"""WITH {_SURE}, h AS (SELECT * FROM ex UNION ALL SELECT * FROM al)
SELECT result_id, uri, match_type, field AS matched_field, matched AS matched_text, o AS rec_seq FROM tn JOIN h USING (norm)"""

RATIO = f"""WITH {_SURE}, {_FUZZY}, h AS (SELECT * FROM ex UNION ALL SELECT * FROM al UNION ALL SELECT * FROM fr),
g AS (SELECT norm, list({{'uri': uri, 'label': label, 's': similarity, 'w': weighted, 't': match_type, 'f': field, 'm': matched}} ORDER BY o, uri) AS l FROM h GROUP BY norm),
d AS (SELECT norm, l, l[1] AS b, l[1].w - coalesce(l[2].w, 0.0) AS margin, l[1].t = 'ambiguous' AS amb, l[1].t IN ('exact', 'alias') AS sure FROM g)
SELECT result_id, coalesce(CASE WHEN amb THEN 'ambiguous' WHEN sure THEN 'accepted' WHEN b.w >= 90 AND margin >= 8 THEN 'accepted' WHEN b.w >= 75 AND margin >= 3 THEN 'review' END, 'unresolved') AS status,
 CASE WHEN NOT amb THEN b.uri END AS uri, CASE WHEN NOT amb THEN b.label END AS standardized, coalesce({_TWO.format('b.s')}, 0.0) AS similarity,
 coalesce(CASE WHEN b IS NULL THEN 0.0 WHEN amb THEN 0.0 WHEN sure THEN 1.0 ELSE CAST(round(CAST(least(b.w / 100, 1.0) * 0.75 + least(margin / 20, 1.0) * 0.25 AS DECIMAL(24, 18)), 4) AS DOUBLE) END, 0.0) AS confidence,
 coalesce(CASE WHEN amb THEN 0.0 ELSE {_TWO.format('margin')} END, 0.0) AS margin, b.t AS match_type, CASE WHEN NOT amb THEN b.f END AS matched_field, CASE WHEN NOT amb THEN b.m END AS matched_text,
 coalesce(CASE WHEN amb THEN 0.0 ELSE {_TWO.format('coalesce(l[2].w, 0.0)')} END, 0.0) AS second_best_score, CAST(coalesce(CASE WHEN amb THEN len(l) ELSE len(l) - 1 END, 0) AS INTEGER) AS n_alternatives
FROM tn LEFT JOIN d USING (norm)"""
