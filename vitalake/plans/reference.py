"""Queries of the career, text, matching and document operators, each beside its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.config import MatchConfig
from vitalake.functions import json_text
from vitalake.functions import text as T
from vitalake.operators import career, documents, extraction, matching
from vitalake.plans import date_sql, match_sql, problems
from vitalake.session import table

AS_OF = "2025-01-01"
WS = T.BLANK

# ---------------------------------------------------------------- career


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resume_events")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return career.jobs(career.latest(_events(spark, d)), AS_OF, career.CFG, *problems.feeds(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return career.metrics(_events(spark, d), AS_OF, career.CFG, *problems.feeds(spark, d))


def career_type_filter(spark, d):
    e = career.normalise_events(career.latest(_events(spark, d)).select("event_id", "resume_id", "type", "title", "level"))
    kind = F.when(F.col("type").isin(*career.CFG.work_types), "work").when(F.col("type").isin(*career.CFG.academic_types), "academic")
    return e.withColumn("kind", kind).where("kind is not null").groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("resume_id").alias("resumes"))


def career_event_duration(spark, d):
    return _jobs(spark, d).select("event_id", "resume_id", F.round("months", 6).alias("months"))


def career_merged_intervals(spark, d):
    m = career.merged_jobs(_jobs(spark, d))
    return m.select("resume_id", "job_no", "title", "level", F.col("start_day").cast("string").alias("start_day"), F.col("eff_end").cast("string").alias("eff_end"), F.round("months", 6).alias("months"), "n_events")


def career_gaps(spark, d):
    g = career.gaps(career.merged_jobs(_jobs(spark, d)))
    return g.select("resume_id", "job_no", F.round("gap_months", 6).alias("gap_months"))


def career_metrics(spark, d):
    m = _metrics(spark, d)
    six = lambda c: F.round(c, 6).alias(c)
    return m.select(
        "resume_id", "num_jobs", six("years"), six("avg_months"), six("min_months"), six("max_months"), "unique_roles", "promotions", "demotions",
        "first_level", "current_level", "level_growth", six("gap_months"), "skills", six("variety"),
    )


def career_trends(spark, d):
    m = _metrics(spark, d)
    return m.select("resume_id", F.round("trend_slope", 4).alias("trend_slope"), F.round("correlation", 4).alias("correlation"), F.round("stability_index", 4).alias("stability_index"))


def career_scores(spark, d):
    s = career.scores(_metrics(spark, d))
    return s.select("resume_id", *[F.round(c, 6).alias(c) for c in ("growth", "stability", "skill", "direction", "seniority", "momentum", "risk", "learning_velocity")])


def career_interpretation(spark, d):
    s = career.labels(career.scores(_metrics(spark, d)))
    return s.groupBy("growth_label", "stability_label", "momentum_label", "risk_label").agg(F.count(F.lit(1)).alias("n"))


def career_analysis(spark, d):
    """The whole analysis, its nested parts as columns."""
    a = career.analyze(_events(spark, d), AS_OF, career.CFG, *problems.feeds(spark, d))
    shown = [F.col(f"intelligence.{c}").alias(c) for c in _INTEL] + [F.col(f"interpretation.{c}").alias(f"{c}_label") for c in ("growth", "stability", "momentum", "risk")]
    return a.select("resume_id", "formula_version", *[F.col(f"raw_metrics.{c}").alias(c) for c in ("num_jobs", "promotions", "demotions", "skills", "level_growth")], *shown)


_INTEL = ("growth", "stability", "skill", "direction", "learning_velocity", "seniority", "momentum", "risk")


def career_payload(spark, d):
    return _events(spark, d).select("event_id", F.size(career.parse_payload(F.col("payload"))).alias("n_keys"))


def career_parse_duration(spark, d):
    """Every cell of the raw event lines, and every number in payloads, read as a duration."""
    cells = table(spark, d, "raw_event_lines").select(F.explode(F.split("line", "[,:{}]")).alias("raw"))
    payloads = _events(spark, d).select(F.explode(F.split("payload", "[,:{}]")).alias("raw"))
    return cells.unionByName(payloads).distinct().select("raw", career.parse_duration(F.col("raw")).alias("months"))


_EV = f"""late AS (SELECT * FROM resume_events QUALIFY event_seq IS NULL OR resume_id IS NULL OR row_number() OVER (PARTITION BY resume_id, event_seq ORDER BY ingested_at DESC, event_id DESC) = 1),
ev AS (SELECT event_id, resume_id, event_seq, lower(regexp_replace(type, '^{WS}+|{WS}+$', '', 'g')) AS type, lower(regexp_replace(title, '^{WS}+|{WS}+$', '', 'g')) AS title,
 lower(regexp_replace(level, '^{WS}+|{WS}+$', '', 'g')) AS level, lower(regexp_replace(coalesce(end_date, ''), '^{WS}+|{WS}+$', '', 'g')) AS e FROM late)"""
_JOBS = f"""{date_sql.dates()}, {_EV}, sd AS (SELECT row_id, DATE '1970-01-01' + CAST(utc // 86400 AS INTEGER) AS sd FROM dated WHERE field = 'start_date'), ed AS (SELECT row_id, DATE '1970-01-01' + CAST(utc // 86400 AS INTEGER) AS ed FROM dated WHERE field = 'end_date'),
parsed AS (SELECT ev.*, sd, CASE WHEN e IN ('', 'present', 'current', 'now') THEN DATE '{AS_OF}' ELSE ed END AS eff_end FROM ev LEFT JOIN sd ON sd.row_id = event_id LEFT JOIN ed ON ed.row_id = event_id WHERE type IN ('work', 'internship') AND resume_id IS NOT NULL),
jobs AS (SELECT * FROM parsed WHERE sd <= eff_end)"""
_MERGED = f"""{_JOBS}, w AS (SELECT *, row_number() OVER o AS rn, max(eff_end) OVER (PARTITION BY resume_id ORDER BY sd, event_seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM jobs WINDOW o AS (PARTITION BY resume_id ORDER BY sd, event_seq, event_id)),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR sd > reach THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY rn) AS job_no FROM w),
merged AS (SELECT resume_id, CAST(job_no AS INTEGER) AS job_no, arg_min({{'t': title, 'l': level}}, rn) AS h, min(sd) AS sd, max(eff_end) AS ee, count(*) AS n_events FROM i GROUP BY resume_id, job_no)"""
_RANK = "CASE h.l " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in career.CFG.level_rank.items()) + " END"
_METRICS = f"""{_MERGED}, r0 AS (SELECT *, h.t AS title, {_RANK} AS rank, (ee - sd) / 30.44 AS months, greatest(lead(sd) OVER (PARTITION BY resume_id ORDER BY job_no) - ee, 0) / 30.44 AS gap FROM merged),
ranked AS (SELECT resume_id, job_no, rank, lag(rank) OVER (PARTITION BY resume_id ORDER BY job_no) AS before FROM r0 WHERE rank IS NOT NULL),
lev AS (SELECT resume_id, CAST(count_if(rank > before) AS BIGINT) AS promotions, CAST(count_if(rank < before) AS BIGINT) AS demotions, arg_min(rank, job_no) AS first_level, arg_max(rank, job_no) AS current_level FROM ranked GROUP BY resume_id),
agg AS (SELECT resume_id, count(*) AS num_jobs, nullif(sum(months), 0) / 12 AS years, avg(months) AS avg_months, min(months) AS min_months, max(months) AS max_months, stddev_samp(months) AS sd_months,
 count(DISTINCT nullif(title, '')) AS unique_roles, count(nullif(title, '')) AS titled_jobs, coalesce(sum(gap), 0.0) AS gap_months,
 var_pop(CAST(year(sd) AS DOUBLE)) AS vx, var_pop(months) AS vy, covar_pop(CAST(year(sd) AS DOUBLE), months) AS cxy FROM r0 GROUP BY resume_id),
sk AS (SELECT resume_id, CAST(count_if(type = 'skill') AS BIGINT) AS skills FROM ev WHERE resume_id IS NOT NULL GROUP BY resume_id),
m AS (SELECT sk.resume_id, coalesce(num_jobs, 0) AS num_jobs, years, avg_months, min_months, max_months, sd_months, coalesce(unique_roles, 0) AS unique_roles, coalesce(titled_jobs, 0) AS titled_jobs, coalesce(promotions, 0) AS promotions,
 coalesce(demotions, 0) AS demotions, first_level, current_level, coalesce(current_level - first_level, 0) AS level_growth, coalesce(gap_months, 0.0) AS gap_months, skills, unique_roles / nullif(num_jobs, 0) AS variety, vx, vy, cxy
 FROM sk LEFT JOIN agg USING (resume_id) LEFT JOIN lev USING (resume_id))"""
_CLAMP = "greatest(0.0, least(100.0, coalesce({0}, 0.0)))"
_SCORES = f"""{_METRICS}, s0 AS (SELECT *, {_CLAMP.format("least(promotions * 25.0, 100.0) * 0.5 + level_growth / 7.0 * 100.0 * 0.5")} AS growth,
 CASE WHEN num_jobs = 0 THEN 0.0 ELSE {_CLAMP.format("100.0 - least(gap_months, 100.0)")} END AS stability, {_CLAMP.format("coalesce(skills / years, 0.0) * 25.0")} AS skill,
 {_CLAMP.format("CASE WHEN titled_jobs > 1 THEN 100.0 - unique_roles / titled_jobs * 40.0 ELSE 100.0 END")} AS direction,
 {_CLAMP.format("0.4 * least(coalesce(years, 0.0) * 8.0, 100.0) + 0.3 * least(promotions * 20.0, 100.0) + 0.3 * (level_growth / 7.0 * 100.0)")} AS seniority, coalesce(skills / years, 0.0) AS learning_velocity FROM m),
s AS (SELECT *, {_CLAMP.format("0.5 * growth + 0.3 * skill + 0.2 * seniority")} AS momentum,
 least((CASE WHEN gap_months > 12.0 THEN 30.0 ELSE 0.0 END) + (CASE WHEN demotions > 0 THEN 20.0 ELSE 0.0 END) + (CASE WHEN stability < 50.0 THEN 25.0 ELSE 0.0 END) + (CASE WHEN skill < 40.0 THEN 25.0 ELSE 0.0 END), 100.0) AS risk FROM s0)"""


def _d6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"CAST(round(CAST({n} AS DOUBLE), {digits}) AS DOUBLE) AS {n}" for n in names)


def _three(c: str, high: float, mid: float, a: str, b: str, z: str) -> str:
    return f"CASE WHEN round(CAST({c} AS DOUBLE), 2) >= {high} THEN '{a}' WHEN round(CAST({c} AS DOUBLE), 2) >= {mid} THEN '{b}' ELSE '{z}' END"


CAREER_SQL = {
    "career_type_filter": f"WITH {_EV} SELECT CASE WHEN type IN ('work', 'internship') THEN 'work' ELSE 'academic' END AS kind, type, count(*) AS n, count(DISTINCT resume_id) AS resumes FROM ev WHERE type IN ('work', 'internship', 'education', 'certificate', 'project', 'skill') GROUP BY 1, 2",
    "career_event_duration": f"WITH {_JOBS} SELECT event_id, resume_id, CAST(round((eff_end - sd) / 30.44, 6) AS DOUBLE) AS months FROM jobs",
    "career_merged_intervals": f"WITH {_MERGED} SELECT resume_id, job_no, h.t AS title, h.l AS level, CAST(sd AS VARCHAR) AS start_day, CAST(ee AS VARCHAR) AS eff_end, CAST(round((ee - sd) / 30.44, 6) AS DOUBLE) AS months, n_events FROM merged",
    "career_gaps": f"WITH {_MERGED}, g AS (SELECT resume_id, job_no, lead(sd) OVER (PARTITION BY resume_id ORDER BY job_no) - ee AS days FROM merged) SELECT resume_id, job_no, CAST(round(days / 30.44, 6) AS DOUBLE) AS gap_months FROM g WHERE days > 0",
    "career_metrics": f"WITH {_METRICS} SELECT resume_id, num_jobs, {_d6('years', 'avg_months', 'min_months', 'max_months', 'gap_months', 'variety')}, unique_roles, promotions, demotions, first_level, current_level, level_growth, skills FROM m",
    "career_trends": f"""WITH {_METRICS} SELECT resume_id, CASE WHEN num_jobs >= 2 THEN coalesce(CAST(round(cxy / nullif(vx, 0), 4) AS DOUBLE), 0.0) END AS trend_slope,
 CASE WHEN num_jobs >= 3 THEN coalesce(CAST(round(cxy / nullif(sqrt(vx) * sqrt(vy), 0), 4) AS DOUBLE), 0.0) END AS correlation, CASE WHEN num_jobs >= 3 THEN CAST(round(avg_months / nullif(sd_months, 0), 4) AS DOUBLE) END AS stability_index FROM m""",
    "career_scores": f"WITH {_SCORES} SELECT resume_id, {_d6('growth', 'stability', 'skill', 'direction', 'seniority', 'momentum', 'risk', 'learning_velocity')} FROM s",
    "career_interpretation": f"""WITH {_SCORES} SELECT {_three("growth", 75, 40, "Strong upward career progression", "Moderate career progression", "Limited visible progression")} AS growth_label,
 {_three("stability", 80, 50, "Stable employment history", "Moderate employment stability", "Frequent transitions detected")} AS stability_label,
 {_three("momentum", 75, 45, "Career trajectory is accelerating", "Career trajectory is steady", "Career growth momentum is weak")} AS momentum_label,
 CASE WHEN round(CAST(risk AS DOUBLE), 2) < 30 THEN 'Low career risk' WHEN round(CAST(risk AS DOUBLE), 2) < 60 THEN 'Moderate career risk' ELSE 'High career risk' END AS risk_label, count(*) AS n FROM s GROUP BY 1, 2, 3, 4""",
    "career_analysis": f"""WITH {_SCORES} SELECT resume_id, '1.0.0' AS formula_version, num_jobs, promotions, demotions, skills, level_growth, {", ".join(f"CAST(round(CAST({n} AS DECIMAL(18, 10)), 2) AS DOUBLE) AS {n}" for n in _INTEL)},
 {_three("growth", 75, 40, "Strong upward career progression", "Moderate career progression", "Limited visible progression")} AS growth_label,
 {_three("stability", 80, 50, "Stable employment history", "Moderate employment stability", "Frequent transitions detected")} AS stability_label,
 {_three("momentum", 75, 45, "Career trajectory is accelerating", "Career trajectory is steady", "Career growth momentum is weak")} AS momentum_label,
 CASE WHEN round(CAST(risk AS DOUBLE), 2) < 30 THEN 'Low career risk' WHEN round(CAST(risk AS DOUBLE), 2) < 60 THEN 'Moderate career risk' ELSE 'High career risk' END AS risk_label FROM s""",
    "career_payload": f"""SELECT event_id, CAST(CASE WHEN payload IS NULL OR regexp_replace(payload, '^{WS}+|{WS}+$', '', 'g') = '' OR NOT json_valid(payload) THEN 0 WHEN json_type(payload) = 'OBJECT' THEN len(json_keys(payload)) END AS INTEGER) AS n_keys FROM resume_events""",
    "career_parse_duration": "SELECT raw, CASE WHEN isfinite(x) AND x >= 0 THEN x END AS months FROM (SELECT DISTINCT raw, CASE WHEN NOT contains(raw, '_') THEN try_cast(raw AS DOUBLE) END AS x FROM (SELECT unnest(regexp_split_to_array(line, '[,:{}]')) AS raw FROM raw_event_lines UNION ALL SELECT unnest(regexp_split_to_array(payload, '[,:{}]')) FROM resume_events))",
}

# ---------------------------------------------------------------- text


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_results").select("post_id", "text")


def text_language(spark, d):
    return _texts(spark, d).select("post_id", T.detect_script(F.col("text")).alias("lang"))


def text_whitespace(spark, d):
    out, n = T.squeeze(F.col("text"))
    return _texts(spark, d).select("post_id", out.alias("text"), n.alias("n"))


def text_drop_empty(spark, d):
    p = table(spark, d, "pdf_results").select("pdf_id", "text")
    out, n = T.drop_empty(F.col("text"))
    return p.select("pdf_id", out.alias("text"), n.alias("n"))


def text_ocr_fix(spark, d):
    t = _texts(spark, d).withColumn("lang", T.detect_script(F.col("text")))
    out, n = T.fix_ocr(F.col("text"), F.col("lang"))
    return t.select("post_id", "lang", out.alias("text"), n.alias("n"))


def text_paragraphs(spark, d):
    p = table(spark, d, "pdf_results").select("pdf_id", "text").withColumn("lang", T.detect_script(F.col("text")))
    out, n = T.refill(F.col("text"), F.col("lang"))
    return p.where("text is not null").withColumn("r", F.struct(out.alias("t"), n.alias("n"))).select("pdf_id", F.col("r.t").alias("text"), F.col("r.n").alias("n"))


#: Section headings of these tables beside the known ones.
_CFG = replace(T.CFG, sections=tuple((n, (*words, *more)) for (n, words), more in zip(T.CFG.sections, (("experience", "erfahrung", "berufserfahrung"), ("training", "ausbildung"), ("duties", "aufgaben"), ("summary",)))))


def text_sections(spark, d):
    p = table(spark, d, "pdf_results").where("text is not null")
    return p.select("pdf_id", T.sections(F.col("text"), _CFG).alias("s")).select("pdf_id", *[F.col("s")[n].alias(n) for n in ("work", "education", "skills", "certificates")])


def text_truncate(spark, d):
    t = _texts(spark, d).select("post_id", T.truncate(F.col("text"), 200).alias("c"))
    return t.select("post_id", "c.text", "c.total_chars", "c.truncated")


def text_pipeline(spark, d):
    """All stages with their counts, the statistics and the sections as columns."""
    p = T.post_process(_texts(spark, d), "text", _CFG)
    counts = {"n_unicode": "normalize_unicode", "n_ocr": "fix_ocr_errors", "n_merges": "fill_broken_paragraphs", "n_blanks": "normalize_whitespace", "n_empty": "remove_empty_lines"}
    rest = ("input_lines", "output_lines", "text_reduction_ratio", "sections_found", "detected_language")
    shown = [F.when(F.col("error").isNull(), F.col("stats")[k]).alias(c) for c, k in {**counts, **{c: c for c in rest}}.items()]
    return p.select("post_id", "processed", *shown, *[F.col("sections")[n].alias(n) for n in ("work", "education", "skills", "certificates")], "error")


_ENDS = r"[.!?:]$"
_BULLET = T.CFG.bullet
_LE = T.LINE_END


def _lines_sql(source: str, p: str = "") -> str:
    """Lines of a table (id, text): split at every line end, one empty line after the last end left out."""
    return f"""{p}parts AS (SELECT id, text, regexp_split_to_array(text, '{_LE}') AS a FROM {source}), {p}cut AS (SELECT id, text, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM {p}parts),
{p}lines AS (SELECT id, text, i, regexp_replace(a[i], '^{WS}+|{WS}+$', '', 'g') AS l FROM (SELECT id, text, a, unnest(range(1, len(a) + 1)) AS i FROM {p}cut))"""


def _refill_sql(lines: str, fa: str, p: str = "") -> str:
    """CTEs that end in g (id, t, n): paragraphs and merges of the lines; ``fa`` tells Persian texts."""
    return f"""{p}k AS (SELECT id, i, l, l = '' AS blank, regexp_matches(l, '{_BULLET}') AS bullet, CASE WHEN {fa} THEN regexp_matches(l, '[.!?:؟]$') ELSE regexp_matches(l, '{_ENDS}') END AS ends, max(i) OVER (PARTITION BY id) AS last FROM {lines}),
{p}b AS (SELECT *, NOT blank AND (bullet OR coalesce(lag(blank OR bullet OR ends) OVER (PARTITION BY id ORDER BY i), true)) AS new FROM {p}k),
{p}s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS seg FROM {p}b),
{p}p AS (SELECT id, seg, string_agg(l, ' ' ORDER BY i) AS t, count(*) AS c, arg_max(ends, i) AS ends, bool_or(bullet) AS bullet, max(i) = max(last) AS final FROM {p}s WHERE NOT blank GROUP BY id, seg),
{p}g AS (SELECT id, string_agg(t, chr(10) ORDER BY seg) AS t, sum(CASE WHEN NOT bullet AND (ends OR final) THEN c - 1 ELSE 0 END) AS n FROM {p}p GROUP BY id)"""


def _sections_sql(lines: str, p: str = "") -> str:
    """CTEs that end in last (id, head, body): the sections of the lines."""
    return f"""{p}h AS (SELECT id, i, l, {_HEADING_CASE} AS head FROM {lines} WHERE l <> ''), {p}bl AS (SELECT *, count(head) OVER (PARTITION BY id ORDER BY i) AS block FROM {p}h),
{p}one AS (SELECT id, block, max(head) AS head, string_agg(l, chr(10) ORDER BY i) FILTER (WHERE head IS NULL) AS body FROM {p}bl WHERE block > 0 GROUP BY id, block),
{p}last AS (SELECT id, head, arg_max(body, block) AS body FROM {p}one WHERE coalesce(body, '') <> '' GROUP BY id, head)"""


_FA = "length(regexp_replace({0}, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > length({0}) * 0.1"


def _chain(c: str, pairs) -> tuple[str, str]:
    n = []
    for old, new in pairs:
        n.append(f"(length({c}) - length(replace({c}, '{old}', '')))")
        c = f"replace({c}, '{old}', '{new}')"
    return c, " + ".join(n)


_EN_OUT, _EN_N = _chain("text", T.CFG.ocr_en)
_FA_OUT, _FA_N = _chain("text", T.CFG.ocr_fa)
_HEADING_CASE = "CASE " + " ".join(f"WHEN regexp_matches(l, '(?i)^\\s*(?:{'|'.join(w)})\\s*:?\\s*$') THEN '{n}'" for n, w in _CFG.sections) + " END"
_SECTIONS = ("work", "education", "skills", "certificates")
_SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_EMPTY = "(SELECT id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE l <> ''), '') AS t, CAST(count_if(l = '') AS INTEGER) AS n FROM {0} GROUP BY id)"

_PIPELINE = f"""{match_sql.nfkc("post_results")}, src AS (SELECT post_id AS id, p.text AS text0, plain.folded AS text, CASE WHEN length(p.text) > 0 AND {_FA.format('p.text')} THEN 'fa' ELSE 'en' END AS lang FROM post_results p JOIN plain USING (text) WHERE length(p.text) <= {T.CFG.max_text_length}),
ocr AS (SELECT id, lang, CASE WHEN lang = 'fa' THEN {_FA_OUT} ELSE {_EN_OUT} END AS text, CASE WHEN lang = 'fa' THEN {_FA_N} ELSE {_EN_N} END AS n FROM src), {_lines_sql("ocr", "o")}, ol AS (SELECT olines.*, lang FROM olines JOIN (SELECT id, lang FROM ocr) USING (id)), {_refill_sql("ol", "lang = 'fa'", "r")},
sq AS (SELECT id, coalesce(rg.t, '') AS before, {_SQUEEZE.format("coalesce(rg.t, '')")} AS text, coalesce(rg.n, 0) AS merges FROM ocr LEFT JOIN rg USING (id)), {_lines_sql("sq", "q")}, de AS {_EMPTY.format("qlines")},
done AS (SELECT sq.id, coalesce(de.t, '') AS text, coalesce(de.n, 0) AS n_empty, sq.merges, abs(length(sq.before) - length(sq.text)) AS n_blanks FROM sq LEFT JOIN de USING (id)), {_lines_sql("done", "d")}, {_sections_sql("dlines", "s")}, {_lines_sql("(SELECT id, text0 AS text FROM src)", "i")},
pipe AS (SELECT src.id, done.text AS processed, CAST(src.text0 <> src.text AS INTEGER) AS n_unicode, CAST(ocr.n AS INTEGER) AS n_ocr, CAST(merges AS INTEGER) AS n_merges, CAST(n_blanks AS INTEGER) AS n_blanks, CAST(n_empty AS INTEGER) AS n_empty,
 CAST(coalesce((SELECT count(*) FROM ilines WHERE ilines.id = src.id), 0) AS INTEGER) AS input_lines, CAST(coalesce((SELECT count(*) FROM dlines WHERE dlines.id = src.id), 0) AS INTEGER) AS output_lines,
 CASE WHEN length(text0) > 0 THEN CAST(round(CAST(1 - length(done.text) / length(text0) AS DECIMAL(24, 18)), 4) AS DOUBLE) ELSE 0.0 END AS text_reduction_ratio, CAST((SELECT count(*) FROM slast WHERE slast.id = src.id) AS INTEGER) AS sections_found, src.lang AS detected_language
 FROM src JOIN ocr ON ocr.id = src.id JOIN done ON done.id = src.id)"""

TEXT_SQL = {
    "text_language": f"SELECT post_id, CASE WHEN length(text) > 0 AND {_FA.format('text')} THEN 'fa' ELSE 'en' END AS lang FROM post_results",
    "text_whitespace": r"""SELECT post_id, o AS text, CAST(abs(length(text) - length(o)) AS INTEGER) AS n FROM (SELECT post_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS o FROM post_results)""",
    "text_drop_empty": f"""WITH src AS (SELECT pdf_id AS id, text FROM pdf_results WHERE text IS NOT NULL), {_lines_sql("src")}, g AS (SELECT id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE l <> ''), '') AS t, CAST(count_if(l = '') AS INTEGER) AS n FROM lines GROUP BY id)
SELECT p.pdf_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(n, 0) END AS n FROM pdf_results p LEFT JOIN g ON g.id = p.pdf_id""",
    "text_ocr_fix": f"""SELECT post_id, lang, CASE WHEN lang = 'fa' THEN {_FA_OUT} ELSE {_EN_OUT} END AS text, CAST(CASE WHEN lang = 'fa' THEN {_FA_N} ELSE {_EN_N} END AS INTEGER) AS n
FROM (SELECT post_id, text, CASE WHEN length(text) > 0 AND {_FA.format('text')} THEN 'fa' ELSE 'en' END AS lang FROM post_results)""",
    "text_paragraphs": f"""WITH src AS (SELECT pdf_id AS id, text FROM pdf_results WHERE text IS NOT NULL), {_lines_sql("src")}, {_refill_sql("lines", f"length(text) > 0 AND {_FA.format('text')}")}
SELECT src.id AS pdf_id, coalesce(g.t, '') AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS n FROM src LEFT JOIN g USING (id)""",
    "text_sections": f"""WITH src AS (SELECT pdf_id AS id, text FROM pdf_results WHERE text IS NOT NULL), {_lines_sql("src")}, {_sections_sql("lines")}
SELECT src.id AS pdf_id, {", ".join(f"coalesce((SELECT body FROM last WHERE last.id = src.id AND head = '{n}'), '') AS {n}" for n in _SECTIONS)} FROM src""",
    "text_pipeline": f"""WITH {_PIPELINE} SELECT p.post_id, {", ".join(c for c in ("processed", "n_unicode", "n_ocr", "n_merges", "n_blanks", "n_empty", "input_lines", "output_lines", "text_reduction_ratio", "sections_found", "detected_language"))},
 {", ".join(f"CASE WHEN pipe.id IS NOT NULL THEN coalesce((SELECT body FROM slast WHERE slast.id = p.post_id AND head = '{n}'), '') END AS {n}" for n in _SECTIONS)}, CASE WHEN p.text IS NULL THEN 'text is null' WHEN length(p.text) > {T.CFG.max_text_length} THEN 'text too long' END AS error FROM post_results p LEFT JOIN pipe ON pipe.id = p.post_id""",
    "text_truncate": """SELECT post_id, CASE WHEN length(text) > 200 THEN (CASE WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > 0 THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END) || chr(10) || chr(10) || '...[TRUNCATED]' ELSE text END AS text,
CAST(length(text) AS INTEGER) AS total_chars, length(text) > 200 AS truncated FROM (SELECT post_id, text, substr(text, 1, 200) AS h FROM post_results)""",
}

# ---------------------------------------------------------------- JSON, matching, files


def json_first_object(spark, d):
    """The first object of every raw record, as it is and inside braces that close too early, too late or never."""
    line = F.col("line")
    forms = F.array(line, F.concat(F.lit("} "), line), F.concat(F.lit("{"), line), F.concat(F.lit("a {"), line, F.lit("} b {c}")))
    e = table(spark, d, "raw_event_lines").select("line_id", F.posexplode(forms).alias("form", "t"))
    return e.select("line_id", "form", json_text.first_object("t").alias("obj"))


def extract_records(spark, d):
    """Records of all texts by the rule-based extractor, the parts of each as columns."""
    e = extraction.extract(table(spark, d, "pdf_results").select("pdf_id", "text"), "pdf_id", "text", cfg=_CFG)
    r = F.col("record")
    joined = lambda c: F.array_join(c, "|")
    return e.select(
        "pdf_id", *[r["personal_information"][c].alias(c) for c in ("email", "phone", "website")], joined(r["skills"]["name"]).alias("skills"), joined(r["education"]["degree"]).alias("degrees"),
        joined(r["experience"]["description"]).alias("experience"), joined(r["certificates"]["name"]).alias("certificates"), "error",
    )


def pdf_pages(spark, d):
    """Pages (parted by form feeds) collected into documents again, with their facts."""
    p = table(spark, d, "pdf_results").where("text is not null").select(F.col("pdf_id").cast("string").alias("path"), F.posexplode(F.split("text", "\f")).alias("n", "text"))
    pages = p.select("path", (F.col("n") + 1).alias("page_no"), "text", F.lit(False).alias("failed"))
    return documents.collect_pages(pages).select("path", "text", "total_chars", "truncated", "page_count", "ocr_required")


def occ_terms(spark, d):
    t = matching.terms(table(spark, d, "occupations"))
    return t.select("text", "field", "uri", "rec_seq")


def occ_resolve(spark, d):
    r = table(spark, d, "resolution_results").select("result_id", "input")
    return matching.resolve(r, "result_id", F.col("input"), table(spark, d, "occupations"))


def occ_resolve_ratio(spark, d):
    """The whole cascade with the plain ratio, which SQL can express."""
    r = table(spark, d, "resolution_results").select("result_id", "input")
    out = matching.resolve(r, "result_id", F.col("input"), table(spark, d, "occupations"), MatchConfig(scorer="ratio"))
    shown = ("result_id", "status", "uri", "standardized", "similarity", "confidence", "margin", "match_type", "matched_field", "matched_text", "second_best_score")
    return out.select(*shown, F.size("alternatives").alias("n_alternatives"))


def occ_sure(spark, d):
    """Titles that are a label or an alias, and the records they name: one row per title and record."""
    r = table(spark, d, "resolution_results").select("result_id", "input")
    hits = matching.sure_hits(r.select("result_id", matching.title_form(F.col("input")).alias("norm")).where("norm <> ''"), table(spark, d, "occupations"))
    return hits.select("result_id", "uri", "match_type", "matched_field", "matched_text", "rec_seq")


def occ_status_counts(spark, d):
    return matching.summary(occ_resolve(spark, d))


def occ_search(spark, d):
    return matching.search(occ_resolve(spark, d), "result_id")


def occ_cache_key(spark, d):
    r = table(spark, d, "resolution_results").where("input is not null")
    return r.select("result_id", matching.cache_key(F.col("input")).alias("cache_key"))


def occ_ttl(spark, d):
    return table(spark, d, "resolution_results").groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", "n", matching.ttl(F.col("status")).alias("ttl"))


def val_file_rules(spark, d):
    """The cheap checks on a file for every document of the tables: names from their metadata, sizes from their texts, kinds by turns."""
    parts = []
    for name, key in (("pdf_results", "pdf_id"), ("docx_results", "docx_id")):
        t, n = table(spark, d, name), F.col(key)
        path = F.concat(F.when(n % 7 == 0, "/in/../").when(n % 11 == 0, "/").otherwise("/in/"), F.col("metadata.filename"), F.when(n % 13 == 0, ".txt").when(n % 17 == 0, "/").otherwise(""))
        head = F.when(n % 5 == 0, F.lit("hello")).when(n % 2 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("PK\x03\x04"))
        parts.append(t.select(F.lit(name).alias("src"), n.alias("row_id"), path.alias("path"), (F.col("total_chars").cast("bigint") * 3_000).alias("length"), F.encode(head, "UTF-8").alias("header")))
    return documents.cheap_checks(parts[0].unionByName(parts[1])).select("src", "row_id", "path", "file_type", "size_mb", F.coalesce("stage", F.lit("passed")).alias("stage"), "failure_reason")


_FILE_ROWS = " UNION ALL ".join(
    f"""SELECT '{name}' AS src, {key} AS row_id, CASE WHEN {key} % 7 = 0 THEN '/in/../' WHEN {key} % 11 = 0 THEN '/' ELSE '/in/' END || metadata.filename || CASE WHEN {key} % 13 = 0 THEN '.txt' WHEN {key} % 17 = 0 THEN '/' ELSE '' END AS path,
 CAST(total_chars AS BIGINT) * 3000 AS length, CASE WHEN {key} % 5 = 0 THEN 'hello' WHEN {key} % 2 = 0 THEN '%PDF-1.7' ELSE 'PK' || chr(3) || chr(4) END AS head FROM {name}"""
    for name, key in (("pdf_results", "pdf_id"), ("docx_results", "docx_id"))
)
_SIZE = "CAST(round(CAST(length / 1048576 AS DECIMAL(24, 18)), 2) AS DOUBLE)"
OTHER_SQL = {
    "json_first_object": """WITH f AS (SELECT line_id, unnest([0, 1, 2, 3]) AS form, unnest([line, '} ' || line, '{' || line, 'a {' || line || '} b {c}']) AS t FROM raw_event_lines),
c AS (SELECT line_id, form, t, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM f), b AS (SELECT line_id, form, t, c, i, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY line_id, form ORDER BY i) AS depth FROM c WHERE c IN ('{', '}')),
o AS (SELECT line_id, form, min(i) AS a FROM b WHERE c = '{' GROUP BY ALL), z AS (SELECT b.line_id, b.form, o.a, min(b.i) AS z FROM b JOIN o ON o.line_id = b.line_id AND o.form = b.form WHERE b.c = '}' AND b.i > o.a AND b.depth = 0 GROUP BY ALL)
SELECT f.line_id, CAST(f.form AS INTEGER) AS form, CASE WHEN z.z IS NULL THEN t ELSE substr(t, z.a, z.z - z.a + 1) END AS obj FROM f LEFT JOIN z ON z.line_id = f.line_id AND z.form = f.form""",
    "occ_terms": f"""WITH last AS (SELECT coalesce(uri, '') AS uri, arg_max({{'l': preferred_label, 'a': alt_labels}}, rec_seq) AS r, min(rec_seq) AS rec_seq FROM occupations WHERE preferred_label IS NOT NULL GROUP BY 1),
al AS (SELECT uri, rec_seq, regexp_replace(coalesce(r.a, ''), '^{WS}+|{WS}+$', '', 'g') AS a FROM last),
x AS (SELECT uri, rec_seq, 'preferred_label' AS field, r.l AS term FROM last UNION ALL
 SELECT uri, rec_seq, 'alias', unnest(CASE WHEN starts_with(a, '[') AND json_valid(a) THEN from_json(a, '["VARCHAR"]') ELSE regexp_split_to_array(a, '[|;,]') END) FROM al),
n AS (SELECT uri, rec_seq, field, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(term), 'ß', 'ss'), '[-‐‑‒–—―]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM x),
own AS (SELECT uri, text AS own FROM n WHERE field = 'preferred_label')
SELECT text, field, n.uri, min(rec_seq) AS rec_seq FROM n JOIN own ON own.uri = n.uri WHERE text <> '' AND (field = 'preferred_label' OR text <> own) GROUP BY text, field, n.uri""",
    "extract_records": f"""WITH src AS (SELECT pdf_id AS id, coalesce(text, '') AS text FROM pdf_results), {_lines_sql("src")}, {_sections_sql("lines")},
x AS (SELECT id, head, unnest(string_split(body, chr(10))) AS l, unnest(range(len(string_split(body, chr(10))))) AS i FROM last), y AS (SELECT id, head, i, regexp_replace(regexp_replace(l, '^[-*•]{WS}*', ''), '^{WS}+|{WS}+$', '', 'g') AS l FROM x),
z AS (SELECT id, head, string_agg(l, '|' ORDER BY i) AS t FROM y WHERE l <> '' GROUP BY id, head)
SELECT id AS pdf_id, nullif(regexp_extract(text, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+(?:\\.[\\p{{L}}\\p{{N}}_-]+)+'), '') AS email, nullif(regexp_extract(text, '\\+?\\p{{Nd}}[\\p{{Nd}} ()./-]{{7,}}\\p{{Nd}}'), '') AS phone, nullif(regexp_extract(text, '\\b(?:https?://|www\\.)[^\\s\\x{{A0}}]+'), '') AS website,
 {", ".join(f"coalesce((SELECT t FROM z WHERE z.id = src.id AND head = '{h}'), '') AS {c}" for h, c in (("skills", "skills"), ("education", "degrees"), ("work", "experience"), ("certificates", "certificates")))}, CAST(NULL AS VARCHAR) AS error FROM src""",
    "occ_resolve_ratio": match_sql.RATIO,
    "occ_sure": match_sql.SURE,
    "pdf_pages": f"""WITH p AS (SELECT CAST(pdf_id AS VARCHAR) AS path, string_split(text, chr(12)) AS a FROM pdf_results WHERE text IS NOT NULL), u AS (SELECT path, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i FROM p),
g AS (SELECT path, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (WHERE regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') <> ''), '') AS t, CAST(count(*) AS INTEGER) AS page_count, count_if(regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') <> '') = 0 AS ocr_required FROM u GROUP BY path)
SELECT path, t AS text, CAST(length(t) AS INTEGER) AS total_chars, length(t) > 500000 AS truncated, page_count, ocr_required FROM g""",
    "occ_cache_key": """SELECT result_id, 'occupation:v1:' || sha256('{"limit": 5, "query": ' || CAST(to_json(input) AS VARCHAR) || ', "threshold": 70.0, "version": "v1"}') AS cache_key FROM resolution_results WHERE input IS NOT NULL""",
    "occ_ttl": "SELECT status, count(*) AS n, CASE WHEN status IN ('unresolved', 'ambiguous') THEN 300 ELSE 3600 END AS ttl FROM resolution_results GROUP BY status",
    "val_file_rules": f"""SELECT src, row_id, path, ft AS file_type, {_SIZE} AS size_mb,
CASE WHEN bad IS NOT NULL THEN 'path_validation' WHEN length > 5242880 THEN 'size_validation' WHEN path IS NULL THEN 'type_detection' WHEN ft IS NULL THEN 'type_detection' WHEN NOT magic THEN 'magic_number_validation' ELSE 'passed' END AS stage,
CASE WHEN bad IS NOT NULL THEN bad WHEN length > 5242880 THEN 'File too large: ' || {_SIZE} || ' MB' WHEN ft IS NULL THEN 'Unsupported file extension: ' || lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN NOT magic THEN 'File signature does not match its extension' END AS failure_reason
FROM (SELECT *, CASE WHEN list_contains(string_split(path, '/'), '..') THEN 'Path traversal detected' WHEN ends_with(path, '/') THEN 'Path is not a file' WHEN length IS NULL THEN 'File does not exist' END AS bad, CASE ft WHEN 'pdf' THEN starts_with(head, '%PDF') ELSE starts_with(head, 'PK' || chr(3) || chr(4)) END AS magic
FROM (SELECT *, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' END AS ft FROM ({_FILE_ROWS})))""",
}

QUERIES = {
    "career_type_filter": career_type_filter, "career_event_duration": career_event_duration, "career_merged_intervals": career_merged_intervals, "career_gaps": career_gaps, "career_metrics": career_metrics,
    "career_trends": career_trends, "career_scores": career_scores, "career_interpretation": career_interpretation, "career_analysis": career_analysis, "career_payload": career_payload, "career_parse_duration": career_parse_duration,
    "text_language": text_language, "text_whitespace": text_whitespace, "text_drop_empty": text_drop_empty, "text_ocr_fix": text_ocr_fix, "text_paragraphs": text_paragraphs, "text_sections": text_sections, "text_truncate": text_truncate,
    "text_pipeline": text_pipeline, "json_first_object": json_first_object, "extract_records": extract_records, "pdf_pages": pdf_pages, "occ_terms": occ_terms, "occ_resolve": occ_resolve, "occ_resolve_ratio": occ_resolve_ratio, "occ_sure": occ_sure, "occ_status_counts": occ_status_counts, "occ_search": occ_search, "occ_cache_key": occ_cache_key, "occ_ttl": occ_ttl,
    "val_file_rules": val_file_rules,
}
ORACLES = {**CAREER_SQL, **TEXT_SQL, **OTHER_SQL}
