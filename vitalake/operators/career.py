"""Career analytics on dated events: merged jobs, gaps, progression, scores and labels.

Events of a resume are rows, a resume is a group key. Jobs that begin on the same day always merge, so
they are pre-aggregated by (resume, day) first: that runs map-side and bounds the rows of a hot resume by
the days of a lifetime before any window sees them. Everything after works on merged jobs.

Days are whole days, read in any form that the timestamps operator knows; a missing or blank end, and the words for
an open one, last until ``as_of``. Rows with a null resume, an unreadable start or end, or an end before the start
are no jobs. Of a row that was delivered several times the last delivery counts. Ties on the start keep the order
of ``event_seq``, then ``event_id``. A resume without jobs still has a row, with zero counts and null means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.config import CareerConfig
from vitalake.operators import timestamps

CFG = CareerConfig()
_STRIP = r"(?U)^\s+|\s+$"


def norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, _STRIP, ""))


def latest(df: DataFrame) -> DataFrame:
    """``df`` without rows that were delivered again later: one row per resume_id and event_seq, that with the last ingested_at.

    Rows without event_seq are all kept, and so are all rows of a table without these columns. The columns stay.
    """
    if not {"event_seq", "ingested_at", "event_id"} <= set(df.columns):
        return df
    own = F.when(F.col("resume_id").isNull() | F.col("event_seq").isNull(), F.col("event_id"))
    last = df.groupBy("resume_id", "event_seq", own.alias("__own")).agg(F.max_by(F.struct(*df.columns), F.struct("ingested_at", "event_id")).alias("__r"))
    return last.select("__r.*")


def parse_duration(c: Column) -> Column:
    """Months as a number; not finite, negative or not numeric is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def months(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / CFG.days_per_month


def normalise_events(df: DataFrame) -> DataFrame:
    """Types, titles and levels trimmed and in lower case; other columns stay."""
    return df.withColumns({c: norm(F.col(c)) for c in ("type", "title", "level")})


def parse_payload(c: Column) -> Column:
    """JSON objects as maps of text; blank or broken text is an empty map, other JSON is null."""
    blank = F.coalesce(F.regexp_replace(c, _STRIP, ""), F.lit("")) == ""
    parsed = F.from_json(c, "map<string,string>")
    empty = F.expr("cast(map() as map<string,string>)")
    return F.when(blank, empty).when(parsed.isNotNull(), parsed).when(F.try_parse_json(c).isNull(), empty)


def jobs(df: DataFrame, as_of: str, cfg: CareerConfig = CFG, orders: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Job rows: resume_id, event_id, event_seq, title, level, start_day, end_day (null: open), eff_end, months.

    With the columns feed, feed_zone and ingested_at, values are read as those of their feed; ``orders`` and ``zones`` may
    give what is known of the feeds from more than ``df`` (see ``timestamps.normalise``).
    """
    e = normalise_events(df).where(F.col("type").isin(*cfg.work_types) & F.col("resume_id").isNotNull())
    missing = {"feed": F.lit(None).cast("string"), "feed_zone": F.lit(None).cast("string"), "ingested_at": F.lit(None).cast("timestamp")}
    e = e.withColumns({c: x for c, x in missing.items() if c not in df.columns})
    e = e.select("resume_id", "event_id", "event_seq", "title", "level", "start_date", "end_date", "feed", "feed_zone", "ingested_at")
    e = timestamps.normalise(e, ["start_date", "end_date"], "feed", "feed_zone", "ingested_at", orders=orders, zones=zones)
    day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / 86400).cast("int"))
    open_ = norm(F.coalesce("end_date", F.lit(""))).isin(*cfg.open_ends)
    e = e.select("resume_id", "event_id", "event_seq", "title", "level", day("start_date_utc").alias("start_day"), day("end_date_utc").alias("end_day"), open_.alias("open"))
    e = e.withColumn("eff_end", F.when(F.col("open"), F.lit(as_of).cast("date")).otherwise(F.col("end_day"))).drop("open").where(F.col("start_day") <= F.col("eff_end"))
    return e.withColumn("months", months(F.col("start_day"), F.col("eff_end")))


def merged_jobs(job_rows: DataFrame) -> DataFrame:
    """Jobs that overlap or touch, merged: (resume_id, job_no, title, level, start_day, end_day, eff_end, months, n_events).

    The merged job keeps title and level of its first event, and the end of the event that ends last.
    """
    first = F.struct("event_seq", "event_id")
    last = F.struct("eff_end", F.col("end_day").isNull(), -F.col("event_seq"))
    day = job_rows.groupBy("resume_id", "start_day").agg(
        F.min_by(F.struct("title", "level"), first).alias("head"), F.max("eff_end").alias("eff_end"), F.max_by("end_day", last).alias("end_day"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("resume_id").orderBy("start_day")
    reach = F.max("eff_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.coalesce((F.col("start_day") > F.col("reach")).cast("int"), F.lit(1))).over(order)
    day = day.withColumn("reach", reach).withColumn("job_no", isle.cast("int"))
    out = day.groupBy("resume_id", "job_no").agg(
        F.min_by("head", "start_day").alias("head"), F.min("start_day").alias("start_day"), F.max_by("end_day", F.struct("eff_end", -F.unix_date("start_day"))).alias("end_day"),
        F.max("eff_end").alias("eff_end"), F.sum("n").alias("n_events"),
    )
    return out.select("resume_id", "job_no", "head.title", "head.level", "start_day", "end_day", "eff_end", months(F.col("start_day"), F.col("eff_end")).alias("months"), "n_events")


def gaps(merged: DataFrame) -> DataFrame:
    """(resume_id, job_no, gap_months): positive gaps after each merged job."""
    nxt = F.lead("start_day").over(Window.partitionBy("resume_id").orderBy("job_no"))
    gap = merged.select("resume_id", "job_no", F.datediff(nxt, F.col("eff_end")).alias("days"))
    return gap.where("days > 0").select("resume_id", "job_no", (F.col("days") / CFG.days_per_month).alias("gap_months"))


def level_rank(level: Column, cfg: CareerConfig = CFG) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in cfg.level_rank.items() for x in kv])
    return F.try_element_at(ranks, F.coalesce(level, F.lit("")))


def metrics(events: DataFrame, as_of: str, cfg: CareerConfig = CFG, orders: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """One row per resume with all raw metrics, of the latest delivery of each event."""
    events = latest(events)
    merged = merged_jobs(jobs(events, as_of, cfg, orders, zones))
    order = Window.partitionBy("resume_id").orderBy("job_no")
    ranked = merged.withColumn("rank", level_rank(F.col("level"), cfg))
    # the rank before, over ranked jobs only
    ranked = ranked.withColumn("before", F.last("rank", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    nxt = F.lead("start_day").over(order)
    ranked = ranked.withColumn("gap", F.greatest(F.datediff(nxt, F.col("eff_end")), F.lit(0)) / cfg.days_per_month)
    titled = F.nullif("title", F.lit(""))
    x, y = F.year("start_day").cast("double"), F.col("months")
    n = F.count(F.lit(1))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    m = ranked.groupBy("resume_id").agg(
        n.alias("num_jobs"), (F.nullif(F.sum("months"), F.lit(0.0)) / 12).alias("years"), F.avg("months").alias("avg_months"), F.min("months").alias("min_months"), F.max("months").alias("max_months"),
        F.when(n >= 3, F.try_divide(F.avg("months"), F.nullif(F.stddev_samp("months"), F.lit(0.0)))).alias("stability_index"),
        F.count_distinct(titled).alias("unique_roles"), F.count(titled).alias("titled_jobs"),
        F.count_if(F.col("rank") > F.col("before")).alias("promotions"), F.count_if(F.col("rank") < F.col("before")).alias("demotions"),
        F.min_by("rank", F.when(F.col("rank").isNotNull(), F.col("job_no"))).alias("first_level"), F.max_by("rank", F.when(F.col("rank").isNotNull(), F.col("job_no"))).alias("current_level"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_months"),
        F.when(n >= 2, F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0))), F.lit(0.0))).alias("trend_slope"),
        F.when(n >= 3, F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))), F.lit(0.0))).alias("correlation"),
    )
    skills = normalise_events(events).where(F.col("resume_id").isNotNull()).groupBy("resume_id").agg(F.count_if(F.col("type") == "skill").alias("skills"))
    out = skills.join(m, "resume_id", "left").fillna(0, ["num_jobs", "unique_roles", "titled_jobs", "promotions", "demotions", "gap_months"])
    out = out.withColumn("level_growth", F.coalesce(F.col("current_level") - F.col("first_level"), F.lit(0)))
    return out.withColumn("variety", F.try_divide(F.col("unique_roles").cast("double"), F.nullif("num_jobs", F.lit(0))))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c, F.lit(0.0))))


def scores(m: DataFrame) -> DataFrame:
    """Unrounded scores from 0 to 100 beside the raw metrics."""
    years = F.coalesce("years", F.lit(0.0))
    per_year = F.coalesce(F.try_divide(F.col("skills").cast("double"), F.nullif("years", F.lit(0.0))), F.lit(0.0))
    s = m.withColumns({
        "growth": clamp(F.least(F.col("promotions") * 25.0, F.lit(100.0)) * 0.5 + F.col("level_growth") / 7.0 * 100.0 * 0.5),
        "stability": F.when(F.col("num_jobs") == 0, 0.0).otherwise(clamp(100.0 - F.least(F.col("gap_months"), F.lit(100.0)))),
        "skill": clamp(per_year * 25.0),
        "direction": clamp(F.when(F.col("titled_jobs") > 1, 100.0 - F.col("unique_roles") / F.col("titled_jobs") * 40.0).otherwise(100.0)),
        "seniority": clamp(0.4 * F.least(years * 8.0, F.lit(100.0)) + 0.3 * F.least(F.col("promotions") * 20.0, F.lit(100.0)) + 0.3 * (F.col("level_growth") / 7.0 * 100.0)),
        "learning_velocity": per_year,
    })
    risk = F.when(F.col("gap_months") > 12.0, 30.0).otherwise(0.0) + F.when(F.col("demotions") > 0, 20.0).otherwise(0.0)
    risk = risk + F.when(F.col("stability") < 50.0, 25.0).otherwise(0.0) + F.when(F.col("skill") < 40.0, 25.0).otherwise(0.0)
    return s.withColumns({"momentum": clamp(0.5 * F.col("growth") + 0.3 * F.col("skill") + 0.2 * F.col("seniority")), "risk": F.least(risk, F.lit(100.0))})


def labels(s: DataFrame, cfg: CareerConfig = CFG) -> DataFrame:
    """Four plain labels, judged on scores rounded to two digits. The texts of the labels."""
    def three(c: str, high: float, mid: float, texts: tuple[str, str, str]) -> Column:
        x = F.round(c, 2)
        return F.when(x >= high, texts[0]).when(x >= mid, texts[1]).otherwise(texts[2])

    low, mid = cfg.risk_labels
    return s.withColumns({
        "growth_label": three("growth", *cfg.growth_labels, ("Strong upward career progression", "Moderate career progression", "Limited visible progression")),
        "stability_label": three("stability", *cfg.stability_labels, ("Stable employment history", "Moderate employment stability", "Frequent transitions detected")),
        "momentum_label": three("momentum", *cfg.momentum_labels, ("Career trajectory is accelerating", "Career trajectory is steady", "Career growth momentum is weak")),
        "risk_label": F.when(F.round("risk", 2) < low, "Low career risk").when(F.round("risk", 2) < mid, "Moderate career risk").otherwise("High career risk"),
    })


def analyze(events: DataFrame, as_of: str, cfg: CareerConfig = CFG, orders: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Nested result per resume: raw_metrics, intelligence (two digits), interpretation, formula_version."""
    m = metrics(events, as_of, cfg, orders, zones)
    s, raw = labels(scores(m), cfg), [c for c in m.columns if c != "resume_id"]
    intel = ("growth", "stability", "skill", "direction", "learning_velocity", "seniority", "momentum", "risk")
    return s.select(
        "resume_id", F.struct(*raw).alias("raw_metrics"), F.struct(*[F.round(c, 2).alias(c) for c in intel]).alias("intelligence"),
        F.struct(*[F.col(f"{c}_label").alias(c) for c in ("growth", "stability", "momentum", "risk")]).alias("interpretation"), F.lit(cfg.formula_version).alias("formula_version"),
    )
