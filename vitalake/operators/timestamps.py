"""Mixed timestamp formats and time zones to one UTC form.

Everything is Catalyst expressions: a chain of guarded patterns turns the text
into calendar parts plus an optional zone, the parts become a wall-clock value,
and the wall clock becomes an instant through the value's own offset, the zone
of its feed, or an estimated zone.

Two things a single value cannot tell are taken from the whole feed, and both by
the same rule, fewest violations: the order of day and month in all-numeric
dates, and the zone of a feed that declares none (see :func:`estimate_zones`).

Nulls, blanks, open ends ("present", "-", "n/a"), fillers ("20xx") and impossible
dates (31.11., month 13) give a null result. A wall-clock time that a clock change
skips or repeats takes the offset in force before the change.
"""

from __future__ import annotations

from collections.abc import Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in the supported languages, by their three to four letter
# stems or full forms, lower case.
MONTHS = {
    1: "jan january januar janvier enero ene gennaio gen januari jänner janv",
    2: "feb february februar février febrero febbraio februari févr fevrier",
    3: "mar march märz mars marzo maart mär mrz mrt maerz",
    4: "apr april avril abril abr aprile avr",
    5: "may mai mayo maggio mei mag",
    6: "jun june juni juin junio giugno giu",
    7: "jul july juli juillet julio luglio lug juil",
    8: "aug august août agosto ago augustus aout",
    9: "sep sept september septembre septiembre settembre set",
    10: "oct october oktober octobre octubre ottobre okt ott",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre diciembre dicembre dez dic déc decembre",
}
# Zone abbreviations, offset from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "GST": 240, "IST": 330, "JST": 540, "KST": 540, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420,
}

# Names of the days of the week in the supported languages, Monday first.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday", "montag dienstag mittwoch donnerstag freitag samstag sonntag sonnabend", "lundi mardi mercredi jeudi vendredi samedi dimanche",
    "lunes martes miércoles miercoles jueves viernes sábado sabado domingo", "lunedì lunedi martedì martedi mercoledì mercoledi giovedì giovedi venerdì venerdi sabato domenica", "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag",
    "دوشنبه سه‌شنبه چهارشنبه پنجشنبه پنج‌شنبه جمعه شنبه یکشنبه یک‌شنبه",
)

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,4})"
_MON = r"([\p{L}]{3,10})\.?"
_DAY = r"(?:([\p{L}][\p{L}\x{200C}]+)\.?,? )?"
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200B}\x{200D}-\x{200F}\x{202F}\x{3000}\x{FEFF}]+"

ISO = rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]{_TIME} ?{_ZONE}?)?"
COMPACT = rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}?)?"
PDF = r"(D):(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z|[+-]\d{2})(?:(?<=Z)00)?'?(\d{2})?'?)?"
YEAR_FIRST = rf"(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[T ]{_TIME} ?{_ZONE}?)?"
NUMERIC = rf"(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,? {_TIME} ?([AaPp][Mm])? ?{_ZONE}?)?"
DAY_MON = rf"{_DAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?[ -](?:of |de )?{_MON}(?: de)?[ -](\d{{4}}|\d{{2}})(?:,? {_TIME} ?{_ZONE}?)?"
MON_DAY = rf"{_DAY}{_MON} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? {_TIME} ?{_ZONE}?)?"
CTIME = rf"{_DAY}{_MON} (\d{{1,2}}) {_TIME}(?: {_ZONE})? (\d{{4}})"
MON_YEAR = rf"{_MON}(?:[ -]|,? )(?:(\d{{4}})|['’](\d{{2}}))"
WEEK = r"(\d{4})-?W(\d{2})-?([1-7])?"
YEAR_MONTH = r"(\d{4})[-/.](\d{1,2})"
MONTH_YEAR = r"(\d{1,2})[/.-](\d{4})"
YEAR = r"(\d{4})"
EPOCH = r"(\d{10}|\d{13})"

#: Each form and what its groups hold. The order of ``a`` and ``b`` is the feed's; ``pdf`` marks that form, ``w`` is a
#: week of the year, ``wd`` the name of a weekday, which must be one but is not compared with the date.
FORMS = (
    (ISO, "y mo d h mi s zone"), (COMPACT, "y mo d h mi s zone"), (PDF, "pdf y mo d h mi s zone zone"), (YEAR_FIRST, "y mo d h mi s zone"), (NUMERIC, "a b y h mi s half zone"),
    (DAY_MON, "wd d mo y h mi s zone"), (MON_DAY, "wd mo d y h mi s zone"), (CTIME, "wd mo d h mi s zone y"), (MON_YEAR, "mo y y"), (WEEK, "y w d"), (YEAR_MONTH, "y mo"), (MONTH_YEAR, "mo y"), (YEAR, "y"), (EPOCH, "epoch"),
)
FIELDS = ("y", "mo", "d", "h", "mi", "s", "zone", "half", "a", "b", "w", "epoch", "pdf", "wd")


def clean(value: Column) -> Column:
    """Trimmed, inner blanks squeezed, Arabic and Persian digits as ASCII digits."""
    s = F.translate(value, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    return F.trim(F.regexp_replace(s, _SPACE, " "))


def fence(c: Column) -> Column:
    """``c``, evaluated once: the optimiser moves nothing across a value it must not recompute.

    The lambda keeps the projection out of whole-stage code, where a chain of large expressions would become one
    method, too large for the virtual machine to compile; by itself a projection is cut into small ones.
    """
    # a random number, since streams know no row ids; it is never below 0
    return F.when(F.forall(F.array(F.rand(0)), lambda x: x >= 0), c)


def _matcher() -> tuple[str, str]:
    """All forms as one pattern, the first that fits in their order, and the rewriting to ``FIELDS``, with a mark before them.

    A group of a form that did not fit is empty, so a field is what its groups of all forms hold together.
    """
    groups: dict[str, str] = dict.fromkeys(FIELDS, "")
    n = 0
    for _, names in FORMS:
        for name in names.split():
            n += 1
            groups[name] += f"${n}"
    return "^(?:" + "|".join(p for p, _ in FORMS) + ")$", "".join("\x01" + groups[f] for f in FIELDS)


_PATTERN, _REWRITTEN = _matcher()


def canonical(s: Column) -> Column:
    """Array of the ``FIELDS`` of a cleaned text, after an empty one; another array where no form fits.

    One pattern and no conditions, so that the code stays small enough to be compiled.
    """
    return F.split(F.regexp_replace(F.translate(s, "\x01", "?"), _PATTERN, _REWRITTEN), "\x01")


def parts(bits: Column, day_first: Column) -> Column:
    """Struct (y, mo, d, h, mi, s, w, zone, epoch) of canonical fields; mo and d are 1 where they are missing."""
    text = lambda f: F.get(bits, F.lit(FIELDS.index(f) + 1))
    num = lambda f: F.when(text(f) != "", text(f).try_cast("int"))
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    y = num("y")
    y = F.when(F.length(text("y")) > 2, y).when(y >= 70, y + 1900).otherwise(y + 2000)
    one = lambda f, other: F.when(text(f) != "", other).otherwise(1)
    mo = F.when(text("a") == "", one("mo", F.coalesce(num("mo"), F.try_element_at(names, F.lower(text("mo")))))).when(day_first, num("b")).otherwise(num("a"))
    d = F.when(text("a") == "", one("d", num("d"))).when(day_first, num("a")).otherwise(num("b"))
    h, half = num("h"), F.lower(text("half"))
    h = F.when(half == "", h).when((h < 1) | (h > 12), F.lit(99)).when(half == "pm", h % 12 + 12).otherwise(h % 12)
    epoch = F.when(text("epoch") != "", F.floor(text("epoch").try_cast("bigint") / F.when(F.length(text("epoch")) > 10, 1000).otherwise(1)))
    fields = F.struct(y.alias("y"), mo.alias("mo"), d.alias("d"), h.alias("h"), num("mi").alias("mi"), num("s").alias("s"), num("w").alias("w"), text("zone").alias("zone"), epoch.alias("epoch"))
    known = sorted({x[:n] for names in WEEKDAYS for x in names.split() for n in range(2, len(x) + 1)})
    return F.when((F.size(bits) > 1) & ((text("wd") == "") | F.lower(text("wd")).isin(*known)), fields)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _days(y: Column, mo: Column, d: Column) -> Column:
    """Day number of a date; null where it does not exist or the year has not four digits. Integers only."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(30 + (mo + _div(mo, 8)) % 2)
    # years and months counted from March on
    year = y - F.when(mo <= 2, 1).otherwise(0)
    month = F.when(mo <= 2, mo + 9).otherwise(mo - 3)
    day = year * 365 + _div(year, 4) - _div(year, 100) + _div(year, 400) + _div(month * 153 + 2, 5) + d
    return F.when(y.between(1000, 9999) & mo.between(1, 12) & (d >= 1) & (d <= last), (day - 719469).cast("int"))


def wall_seconds(p: Column) -> Column:
    """The wall clock as seconds since 1970 as if it were UTC; null for dates and times that do not exist."""
    h, mi, s = (F.coalesce(p[k], F.lit(0)) for k in ("h", "mi", "s"))
    clock = F.when((h < 24) & (mi < 60) & (s < 60), h * 3600 + mi * 60 + s)
    weekly = p["w"].isNotNull()
    # the fourth of January lies in the first week
    day = _days(p["y"], F.when(weekly, 1).otherwise(p["mo"]), F.when(weekly, 4).otherwise(p["d"]))
    monday = day - F.pmod(day + 3, F.lit(7)) + (p["w"] - 1) * 7
    week = F.when((p["w"] >= 1) & (F.weekofyear(F.date_from_unix_date(monday)) == p["w"]), monday + p["d"] - 1)
    return F.coalesce(p["epoch"], F.when(weekly, week).otherwise(day).cast("bigint") * 86400 + clock)


def offset_seconds(zone: Column) -> Column:
    """Offset named by the value itself; null where it names none that is known."""
    named = F.create_map(*[F.lit(x) for k, m in ABBREVIATIONS.items() for x in (k, m * 60)])
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.translate(zone, "+-:", ""), 4, "0")
    return F.when(zone == "", F.lit(None).cast("int")).when(
        zone.rlike("^[+-]"), sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    ).otherwise(F.try_element_at(named, F.when(zone.startswith("Z0"), "Z").otherwise(zone)))


def zone_to_utc(wall: Column, zone: Column) -> Column:
    """Wall-clock seconds in a named zone to UTC seconds; unknown or null zones give null."""
    known = F.when(zone.isin(*sorted(available_timezones())), zone)
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), known))


def iso_utc(seconds: Column) -> Column:
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.pmod(F.floor(seconds / 3600), F.lit(24))), F.lit(":"), two(F.pmod(F.floor(seconds / 60), F.lit(60))), F.lit(":"), two(F.pmod(seconds, F.lit(60))), F.lit("Z"))


def instant_seconds(df: DataFrame, name: str) -> Column:
    """A timestamp column as UTC seconds; one without zone holds UTC, whatever the session's zone is."""
    c = F.col(name).cast("timestamp")
    return F.unix_seconds(F.from_utc_timestamp(c, F.current_timezone()) if dict(df.dtypes)[name] == "timestamp_ntz" else c)


def feed_orders(values: DataFrame) -> DataFrame:
    """(feed, day_first): the order of day and month that breaks the fewest values of each feed.

    ``values`` has feed, s (cleaned) and seen (ingestion time). A value breaks an order when its month
    would exceed 12, and, with a smaller weight, when its date would lie after its ingestion. Ties and
    feeds without such dates read the day first.
    """
    numeric = f"^{NUMERIC}$"
    rows = values.where(F.col("s").rlike(numeric)).select("feed", instant_seconds(values, "seen").alias("seen"), fence(F.split(F.regexp_replace("s", numeric, "$3|$1|$2"), r"\|")).alias("x"))
    num = lambda i: F.element_at("x", i).try_cast("int")
    year = F.when(F.length(F.element_at("x", 1)) > 2, num(1)).when(num(1) >= 70, num(1) + 1900).otherwise(num(1) + 2000)
    rows = rows.select("feed", "seen", fence(F.struct(num(2).alias("a"), num(3).alias("b"), year.alias("y"))).alias("v")).select("feed", "seen", "v.*")
    rows = rows.where("a between 1 and 31 and b between 1 and 31 and (a <= 12 or b <= 12)")

    def broken(mo: Column, d: Column) -> Column:
        late = F.coalesce(_days(F.col("y"), mo, d) * 86400 > F.col("seen"), F.lit(False)).cast("bigint")
        return F.sum((mo > 12).cast("bigint") * 1000 + late)

    sums = rows.groupBy("feed").agg(broken(F.col("b"), F.col("a")).alias("dmy"), broken(F.col("a"), F.col("b")).alias("mdy"))
    return sums.select("feed", (F.col("dmy") <= F.col("mdy")).alias("day_first"))


def estimate_zones(values: DataFrame, candidates: Sequence[str], band_s: int = 26 * 3600, gain: float = 0.5, least: int = 20) -> DataFrame:
    """(feed, est_zone, violations, informative): the offset history of each feed that breaks the fewest orders.

    ``values`` has feed, wall (wall-clock seconds of values without a zone of their own) and seen
    (ingestion time). Only values within ``band_s`` of their ingestion can tell one zone from another; such a
    value is violated under a candidate zone that would put it after its ingestion. A candidate replaces the
    first one (the prior) only if there are ``least`` such values and it saves a share of ``gain`` of them, and of
    equally good ones the least shifted wins, since any zone further east would also do. One pass with one partial
    aggregate per candidate; no rows are gathered.
    """
    seen = instant_seconds(values, "seen")
    near = values.select("feed", "wall", seen.alias("seen")).where(F.abs(F.col("wall") - F.col("seen")) <= band_s)

    def broken(zone: str) -> Column:
        utc = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("wall"), zone))
        return F.struct(F.sum((utc > F.col("seen")).cast("bigint")).alias("v"), F.avg(F.abs(utc - F.col("wall"))).alias("shift"))

    sums = near.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), *[broken(z).alias(f"c{i}") for i, z in enumerate(candidates)])
    best = F.array_min(F.array(*[F.struct(F.col(f"c{i}.v").alias("v"), F.col(f"c{i}.shift").alias("shift"), F.lit(z).alias("zone")) for i, z in enumerate(candidates)]))
    wins = (F.col("n") >= least) & ((F.col("c0.v") - best["v"]) >= F.col("n") * gain)
    est = F.when(wins, best["zone"]).otherwise(F.lit(candidates[0]))
    return sums.select("feed", est.alias("est_zone"), F.when(wins, best["v"]).otherwise(F.col("c0.v")).alias("violations"), F.col("n").alias("informative"))


def feed_zones(values: DataFrame, candidates: Sequence[str], orders: DataFrame) -> DataFrame:
    """:func:`estimate_zones` for ``values`` (feed, zone, seen, value as text), of those that need it: with a time of day, without any zone."""
    rows = values.where(F.col("zone").isNull() & F.col("value").rlike(TIMED)).select("feed", "seen", "value")
    rows = walls(beside(rows, "feed", orders.select(F.col("feed").alias("__ts_feed"), F.col("day_first").alias("__ts_df")), "__ts_feed"), "value", "__ts_df")
    rows = rows.where("__ts_p.zone = '' and __ts_p.h is not null and __ts_w is not null")
    return estimate_zones(rows.select("feed", "seen", F.col("__ts_w").alias("wall")), candidates)


def utc_seconds(p: Column, wall: Column, zone: Column) -> Column:
    """UTC seconds of a wall clock: its own zone wins, else ``zone`` holds; days without a time are not shifted."""
    off = offset_seconds(p["zone"])
    return (
        F.when(p["epoch"].isNotNull() | p["h"].isNull(), wall)
        .when((p["zone"] != "") & off.isNull(), None)
        .when(off.isNotNull(), wall - off)
        .otherwise(zone_to_utc(wall, zone))
    )


def beside(df: DataFrame, name: str, few: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``df`` left joined with ``few`` on ``name`` = ``key``.

    One row per feed is expected; up to ``most`` rows are checked and broadcast, so that a feed that holds a
    third of ``df`` is not gathered in one task. Beyond that it is an ordinary join.
    """
    rows = few.limit(most + 1).collect()
    if len(rows) <= most:
        few = F.broadcast(df.sparkSession.createDataFrame(rows, few.schema))
    return df.join(few, F.col(name) == F.col(key), "left")


def gathered(few: DataFrame, most: int = 100_000) -> DataFrame:
    """``few`` worked out once, if it has up to ``most`` rows; else ``few`` itself."""
    rows = few.limit(most + 1).collect()
    return few.sparkSession.createDataFrame(rows, few.schema) if len(rows) <= most else few


def normalise(df: DataFrame, values: Sequence[str] | str, feed: str, zone: str, seen: str, unzoned: str | Sequence[str] = "UTC", orders: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """``df`` with ``<value>_utc`` (UTC seconds) for each value column; :func:`iso_utc` gives the text form.

    A zone or offset inside the value wins, then the column ``zone``; where that is null, ``unzoned`` holds:
    a zone name, or a sequence of candidate zones from which :func:`estimate_zones` picks one per feed.
    ``orders`` may give (feed, day_first) and ``zones`` (feed, est_zone) gathered elsewhere. Null, blank, unreadable, open and impossible
    values give null; rows with a null feed are read day first; an empty ``df`` gives an empty result.
    Other columns stay; helper columns begin with ``__ts_`` and are dropped.
    """
    values = [values] if isinstance(values, str) else list(values)
    if orders is None:
        long = df.select(F.col(feed).alias("feed"), F.col(seen).alias("seen"), F.explode(F.array(*values)).alias("v"))
        orders = gathered(feed_orders(long.select("feed", clean(F.col("v")).alias("s"), "seen")))
    orders = orders.select(F.col("feed").alias("__ts_feed"), F.col("day_first").alias("__ts_df"))
    rows, fallback = beside(df, feed, orders, "__ts_feed"), F.lit(unzoned if isinstance(unzoned, str) else unzoned[0])
    if zones is None and not isinstance(unzoned, str):
        long = df.select(F.col(feed).alias("feed"), F.col(zone).alias("zone"), F.col(seen).alias("seen"), F.explode(F.array(*values)).alias("value"))
        zones = feed_zones(long, unzoned, orders.toDF("feed", "day_first"))
    if zones is not None:
        rows = beside(rows, feed, zones.select(F.col("feed").alias("__ts_feed2"), F.col("est_zone").alias("__ts_est")), "__ts_feed2")
        fallback = F.coalesce("__ts_est", fallback)
    for v in values:
        rows = walls(rows, v, "__ts_df")
        rows = rows.withColumn(f"{v}_utc", fence(utc_seconds(F.col("__ts_p"), F.col("__ts_w"), F.coalesce(F.col(zone), fallback))))
    return rows.drop(*[c for c in rows.columns if c.startswith("__ts_")])


#: Values that can have a time of day: a colon, or enough digits in a row.
TIMED = r":|[0-9۰-۹٠-٩]{10}|T"


def walls(rows: DataFrame, value: str, day_first: str) -> DataFrame:
    """``rows`` with ``__ts_p`` (parts) and ``__ts_w`` (wall-clock seconds) of a value. Each step is fenced: it runs once and is compiled by itself."""
    rows = rows.withColumn("__ts_c", fence(canonical(clean(F.col(value)))))
    rows = rows.withColumn("__ts_p", fence(parts(F.col("__ts_c"), F.coalesce(day_first, F.lit(True)))))
    return rows.withColumn("__ts_w", fence(wall_seconds(F.col("__ts_p"))))
