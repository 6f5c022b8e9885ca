"""SQL that reads the dates of the test tables, for the queries that are checked against it.

The forms are those of the timestamps operator; everything after the match (calendar, zones, weeks, the order of
day and month) is left to the database's own functions.
"""

from __future__ import annotations

from vitalake.operators import timestamps as ts

EVENT_VALUES = """SELECT 'resume_events' AS src, event_id AS row_id, f.field, f.value, feed, feed_zone, ingested_at AS seen FROM
 (SELECT *, unnest([{'field': 'start_date', 'value': start_date}, {'field': 'end_date', 'value': end_date}]) AS f FROM resume_events)"""
PDF_VALUES = "SELECT 'pdf_results' AS src, pdf_id AS row_id, 'creation_date' AS field, metadata.creation_date AS value, feed, feed_zone, received_at AS seen FROM pdf_results"
PLAIN = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}Z)?"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _field(name: str) -> str:
    """The text of a field, from the groups of the form that fits."""
    cases = []
    for k, (pattern, names) in enumerate(ts.FORMS):
        groups = [i for i, n in enumerate(names.split(), 1) if n == name]
        if groups:
            cases.append(f"WHEN {k} THEN " + " || ".join(f"coalesce(regexp_extract(s, '^(?:' || {_quote(_re2(pattern))} || ')$', {i}), '')" for i in groups))
    return f"CASE k {' '.join(cases)} ELSE '' END AS t_{name}"


def _re2(pattern: str) -> str:
    # no look-behind there: the zeros after Z join it
    return pattern.replace(r"(Z|[+-]\d{2})(?:(?<=Z)00)?", r"(Z(?:00)?|[+-]\d{2})")


_MONTHS = "CASE lower(t_mo) " + " ".join(f"WHEN {_quote(w)} THEN {n}" for n, words in ts.MONTHS.items() for w in dict.fromkeys(words.split())) + " END"
_NAMED = "CASE regexp_replace(t_zone, '^Z0+$', 'Z') " + " ".join(f"WHEN '{k}' THEN {m * 60}" for k, m in ts.ABBREVIATIONS.items()) + " END"
_DAYS = ", ".join(sorted({_quote(x[:n]) for names in ts.WEEKDAYS for x in names.split() for n in range(2, len(x) + 1)}))
_FITS = " ".join(f"WHEN regexp_full_match(s, {_quote(_re2(p))}) THEN {k}" for k, (p, _) in enumerate(ts.FORMS))
_DATE = "try_cast(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({mo} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"


def dates(values: str = f"{EVENT_VALUES} UNION ALL {PDF_VALUES}") -> str:
    """CTEs that end in ``dated`` (src, row_id, field, value, feed, feed_zone, seen, wall, timed, zoned, utc): seconds since 1970, null where a value names no date."""
    late = lambda mo, d: f"CASE WHEN epoch({_DATE.format(y='yy', mo=mo, d=d)}) > epoch(seen) THEN 1 ELSE 0 END"
    return f"""dv AS MATERIALIZED ({values}), dc AS (SELECT *, trim(regexp_replace(translate(value, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), {_quote(ts._SPACE)}, ' ', 'g')) AS s FROM dv WHERE value IS NOT NULL),
dk AS (SELECT *, CASE {_FITS} END AS k FROM dc), dt AS MATERIALIZED (SELECT *, {", ".join(_field(f) for f in ts.FIELDS)} FROM dk WHERE k IS NOT NULL),
dn AS (SELECT *, try_cast(t_y AS INTEGER) AS y0, CASE WHEN length(t_y) > 2 THEN try_cast(t_y AS INTEGER) WHEN try_cast(t_y AS INTEGER) >= 70 THEN 1900 + try_cast(t_y AS INTEGER) ELSE 2000 + try_cast(t_y AS INTEGER) END AS yy, try_cast(t_a AS INTEGER) AS a, try_cast(t_b AS INTEGER) AS b FROM dt),
df AS (SELECT feed, sum(CASE WHEN b > 12 THEN 1000 ELSE 0 END + {late('b', 'a')}) <= sum(CASE WHEN a > 12 THEN 1000 ELSE 0 END + {late('a', 'b')}) AS day_first FROM dn WHERE a BETWEEN 1 AND 31 AND b BETWEEN 1 AND 31 AND (a <= 12 OR b <= 12) GROUP BY feed),
dp AS (SELECT dn.*, coalesce(df.day_first, true) AS dmy FROM dn LEFT JOIN df ON dn.feed = df.feed),
dq AS (SELECT *, CASE WHEN t_a <> '' THEN (CASE WHEN dmy THEN b ELSE a END) WHEN t_mo = '' THEN 1 ELSE coalesce(try_cast(t_mo AS INTEGER), {_MONTHS}) END AS mo, CASE WHEN t_a <> '' THEN (CASE WHEN dmy THEN a ELSE b END) WHEN t_d = '' THEN 1 ELSE try_cast(t_d AS INTEGER) END AS d,
 try_cast(t_h AS INTEGER) AS h0, coalesce(try_cast(t_mi AS INTEGER), 0) AS mi, coalesce(try_cast(t_s AS INTEGER), 0) AS sec FROM dp WHERE t_wd = '' OR lower(t_wd) IN ({_DAYS})),
dh AS (SELECT *, CASE WHEN t_half = '' THEN h0 WHEN h0 NOT BETWEEN 1 AND 12 THEN 99 ELSE h0 % 12 + CASE WHEN lower(t_half) = 'pm' THEN 12 ELSE 0 END END AS h,
 CASE WHEN t_w <> '' THEN CAST(try_strptime(t_y || '-' || t_w || '-' || CAST(d AS VARCHAR), '%G-%V-%u') AS DATE) WHEN yy BETWEEN 1000 AND 9999 THEN {_DATE.format(y="yy", mo="mo", d="d")} END AS day FROM dq),
dw AS (SELECT *, CASE WHEN t_epoch <> '' THEN CAST(floor(CAST(t_epoch AS BIGINT) / CASE WHEN length(t_epoch) > 10 THEN 1000 ELSE 1 END) AS BIGINT) WHEN coalesce(h, 0) < 24 AND mi < 60 AND sec < 60 AND (t_w = '' OR strftime(day, '%G-%V') = t_y || '-' || t_w) THEN CAST(epoch(day) AS BIGINT) + coalesce(h, 0) * 3600 + mi * 60 + sec END AS wall,
 CASE WHEN t_zone = '' THEN NULL WHEN regexp_matches(t_zone, '^[+-]') THEN (CASE WHEN t_zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(replace(t_zone, ':', '')[2:3] AS INTEGER) * 3600 + coalesce(try_cast(replace(t_zone, ':', '')[4:5] AS INTEGER), 0) * 60) ELSE {_NAMED} END AS off FROM dh),
dz AS (SELECT *, epoch(timezone(coalesce(feed_zone, 'UTC'), CAST(to_timestamp(wall) AT TIME ZONE 'UTC' AS TIMESTAMP))) AS z FROM dw WHERE wall IS NOT NULL),
dated AS (SELECT src, row_id, field, value, feed, feed_zone, seen, wall, t_epoch = '' AND h IS NOT NULL AS timed, t_zone <> '' AS zoned,
 CAST(CASE WHEN t_epoch <> '' OR h IS NULL THEN wall WHEN t_zone <> '' AND off IS NULL THEN NULL WHEN off IS NOT NULL THEN wall - off
 WHEN epoch(timezone(coalesce(feed_zone, 'UTC'), to_timestamp(z - 3600))) = wall THEN z - 3600 ELSE z END AS BIGINT) AS utc FROM dz)"""


FOUND = f"""WITH {dates()} SELECT src, row_id, field, strftime(to_timestamp(utc) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS utc FROM dated WHERE utc IS NOT NULL AND NOT regexp_full_match(value, '{PLAIN}')"""


def zones(candidates: tuple[str, ...]) -> str:
    """The feeds with the offset history that breaks the fewest orders, as ``estimate_zones`` defines it."""
    listed = ", ".join(_quote(z) for z in candidates)
    return f"""WITH {dates()}, near AS (SELECT feed, wall, epoch(seen) AS seen FROM dated WHERE timed AND NOT zoned AND abs(wall - epoch(seen)) <= 93600),
z AS (SELECT unnest([{listed}]) AS zone), u AS (SELECT feed, zone, wall, seen, epoch(timezone(zone, CAST(to_timestamp(wall) AT TIME ZONE 'UTC' AS TIMESTAMP))) AS u0 FROM near, z),
v AS (SELECT *, CASE WHEN epoch(timezone(zone, to_timestamp(u0 - 3600))) = wall THEN u0 - 3600 ELSE u0 END AS utc FROM u),
c AS (SELECT feed, zone, count(*) AS n, count_if(utc > seen) AS bad, avg(abs(utc - wall)) AS shift FROM v GROUP BY feed, zone),
b AS (SELECT feed, max(n) AS n, max(CASE WHEN zone = '{candidates[0]}' THEN bad END) AS prior, arg_min(zone, (bad, shift, zone)) AS best, min(bad) AS least FROM c GROUP BY feed),
e AS (SELECT feed, n, CASE WHEN n >= 20 AND prior - least >= n * 0.5 THEN best ELSE '{candidates[0]}' END AS est_zone, CASE WHEN n >= 20 AND prior - least >= n * 0.5 THEN least ELSE prior END AS violations FROM b)
SELECT f.feed, declared, n_values, est_zone, violations, n AS informative FROM (SELECT feed, min(feed_zone) AS declared, count(*) AS n_values FROM dv WHERE value IS NOT NULL GROUP BY feed) f LEFT JOIN e ON e.feed = f.feed"""


PERIODS = f"""WITH {dates()}, j AS (SELECT event_id, resume_id, end_date FROM resume_events WHERE lower(trim(type, ' ' || chr(9) || chr(10) || chr(13))) IN ('work', 'internship')),
d AS (SELECT resume_id, s.utc // 86400 AS a, CASE WHEN lower(trim(coalesce(end_date, ''), ' ' || chr(9) || chr(10) || chr(13))) IN ('', 'present', 'current', 'now') THEN date_diff('day', DATE '1970-01-01', DATE '2025-01-01') ELSE e.utc // 86400 END AS b
 FROM j JOIN (SELECT row_id, utc FROM dated WHERE field = 'start_date') s ON s.row_id = event_id LEFT JOIN (SELECT row_id, utc FROM dated WHERE field = 'end_date') e ON e.row_id = event_id),
o AS (SELECT *, max(b) OVER (PARTITION BY resume_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d WHERE a <= b AND resume_id IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM o),
p AS (SELECT resume_id, n, min(a) AS a, max(b) AS b FROM i GROUP BY resume_id, n), g AS (SELECT resume_id, b AS a, lead(a) OVER (PARTITION BY resume_id ORDER BY n) AS b FROM p),
x AS (SELECT resume_id, 'period' AS kind, a, b FROM p UNION ALL SELECT resume_id, 'gap', a, b FROM g WHERE b IS NOT NULL)
SELECT resume_id, kind, CAST(DATE '1970-01-01' + CAST(a AS INTEGER) AS VARCHAR) AS from_day, CAST(DATE '1970-01-01' + CAST(b AS INTEGER) AS VARCHAR) AS to_day FROM x"""
