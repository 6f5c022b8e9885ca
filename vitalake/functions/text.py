"""Text functions and stages: Column expressions, composed by a configurable stage executor.

Null text gives null throughout; empty text stays empty. Lines are split as Unicode line ends demand, and
blanks are those of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vitalake.config import TextConfig

CFG = TextConfig()
#: White space and line ends of Unicode, as regular expressions of Java and RE2.
BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def split_lines(c: Column) -> Column:
    """Lines of a text; no empty one after a final line end, none at all for empty text."""
    lines = F.split(c, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def detect_script(c: Column) -> Column:
    """``fa`` if more than a tenth of the characters are Arabic letters, else ``en``."""
    arabic = F.length(F.regexp_replace(c, r"[^\x{0600}-\x{06FF}]", ""))
    return F.when((F.length(c) > 0) & (arabic > F.length(c) * 0.1), "fa").otherwise("en")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Compatibility form; text in plain ASCII is its own."""
    return _nfkc(c)


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(text, number of replacements) of an ordered chain."""
    count: Column = F.lit(0)
    for old, new in pairs:
        count = count + ((F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)).cast("int")
        c = F.replace(c, F.lit(old), F.lit(new))
    return c, count


def fix_ocr(c: Column, lang: Column, cfg: TextConfig = CFG) -> tuple[Column, Column]:
    en, fa = replace_all(c, cfg.ocr_en), replace_all(c, cfg.ocr_fa)
    return F.when(lang == "fa", fa[0]).otherwise(en[0]), F.when(lang == "fa", fa[1]).otherwise(en[1])


def refill(c: Column, lang: Column, cfg: TextConfig = CFG) -> tuple[Column, Column]:
    """(text, merges): broken lines joined into paragraphs, by one fold over the lines.

    A blank line ends a paragraph, a bullet stands alone, a sentence's end closes. Merges are counted where a
    sentence's end or the text's end closes a paragraph, not where a blank line or a bullet does.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))
    ends = F.when(lang == "fa", r"[.!?:؟]$").otherwise(r"[.!?:]$")
    empty = F.array().cast("array<string>")

    def flushed(acc: Column) -> Column:
        return F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["buf"], " ")))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        grown = F.concat(acc["buf"], F.array(line))
        closes = F.rlike(line, ends)
        bullet = line.rlike(cfg.bullet)
        out = F.when(line == "", flushed(acc)).when(bullet, F.concat(flushed(acc), F.array(line))).when(closes, F.concat(acc["out"], F.array(F.array_join(grown, " ")))).otherwise(acc["out"])
        buf = F.when((line == "") | bullet | closes, empty).otherwise(grown)
        n = acc["n"] + F.when((line != "") & ~bullet & closes, F.size(acc["buf"])).otherwise(0)
        return F.struct(out.alias("out"), buf.alias("buf"), n.alias("n"))

    lines = F.transform(split_lines(c), strip)
    end = F.aggregate(lines, start, step, lambda acc: F.struct(F.array_join(flushed(acc), "\n").alias("text"), (acc["n"] + F.greatest(F.size(acc["buf"]) - 1, F.lit(0))).alias("n")))
    return end["text"], end["n"]


def squeeze(c: Column) -> tuple[Column, Column]:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return out, F.abs(F.length(c) - F.length(out))


def drop_empty(c: Column) -> tuple[Column, Column]:
    lines = F.transform(split_lines(c), strip)
    kept = F.filter(lines, lambda x: x != "")
    return F.array_join(kept, "\n"), F.size(lines) - F.size(kept)


def drop_page_numbers(c: Column, cfg: TextConfig = CFG) -> tuple[Column, Column]:
    """Off unless the configuration asks for it; the count is of lines removed."""
    if not cfg.drop_page_numbers:
        return c, F.lit(0)
    out = c
    for p in cfg.page_patterns:
        out = F.regexp_replace(out, p.replace("(?m)", "(?mU)"), "")
    blank = lambda t: F.size(F.filter(split_lines(t), lambda x: strip(x) == ""))
    return out, blank(out) - blank(c)


def truncate(c: Column, limit: int) -> Column:
    """Struct (text, total_chars, truncated): cut at the last space before the limit, if there is one past the first place."""
    head = F.substring(c, 1, limit)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > 0), F.substr(head, F.lit(1), space)).otherwise(head)
    long = F.length(c) > limit
    return F.struct(F.when(long, F.concat(cut, F.lit("\n\n...[TRUNCATED]"))).otherwise(c).alias("text"), F.length(c).alias("total_chars"), long.alias("truncated"))


def sections(c: Column, cfg: TextConfig = CFG) -> Column:
    """Map of section to text: lines under a heading belong to it, a later section of that name replaces an earlier one unless empty."""
    names = [n for n, _ in cfg.sections]

    def heading(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(cfg.sections):
            out = F.when(line.rlike(r"(?iu)^\s*(?:%s)\s*:?\s*$" % "|".join(words)), name).otherwise(out)
        return out

    start = F.struct(F.lit(None).cast("string").alias("cur"), F.array().cast("array<string>").alias("buf"), *[F.lit("").alias(n) for n in names])

    def store(acc: Column) -> list[Column]:
        body = F.array_join(acc["buf"], "\n")
        return [F.when((acc["cur"] == n) & (body != ""), body).otherwise(acc[n]).alias(n) for n in names]

    def step(acc: Column, line: Column) -> Column:
        head = heading(line)
        kept = [F.when(head.isNotNull(), s).otherwise(acc[n]).alias(n) for n, s in zip(names, store(acc))]
        buf = F.when(head.isNotNull(), F.array().cast("array<string>")).when(acc["cur"].isNull(), acc["buf"]).otherwise(F.concat(acc["buf"], F.array(line)))
        return F.struct(F.coalesce(head, acc["cur"]).alias("cur"), buf.alias("buf"), *kept)

    lines = F.filter(F.transform(split_lines(c), strip), lambda x: x != "")
    return F.aggregate(lines, start, step, lambda acc: F.create_map(*[x for n, s in zip(names, store(acc)) for x in (F.lit(n), s)]))


Stage = Callable[[Column, Column], tuple[Column, Column]]
STAGES: dict[str, Stage] = {
    "remove_headers": lambda t, _: (t, F.lit(0)),
    "remove_page_numbers": lambda t, _: drop_page_numbers(t),
    "fix_ocr_errors": fix_ocr,
    "fill_broken_paragraphs": refill,
    "normalize_whitespace": lambda t, _: squeeze(t),
    "remove_empty_lines": lambda t, _: drop_empty(t),
    "normalize_unicode": lambda t, _: (nfkc(t), F.when(nfkc(t) != t, 1).otherwise(0)),
}


def register_stage(name: str, stage: Stage) -> None:
    """Adds a stage of one's own; it gets the text and its language and gives the text and a count."""
    STAGES[name] = stage


def post_process(df: DataFrame, text: str, cfg: TextConfig = CFG) -> DataFrame:
    """``df`` with ``processed`` (text), ``stats``, ``sections`` and ``error``.

    Stages run in the configured order; names that are not registered are skipped. Null or over-long text
    has an error and null results.
    """
    bad = F.when(F.col(text).isNull(), "text is null").when(F.length(text) > cfg.max_text_length, "text too long")
    rows = df.withColumn("error", bad).withColumn("__t0", F.when(bad.isNull(), F.col(text)))
    rows = rows.withColumn("__lang", F.when(F.col("__t0").isNotNull(), detect_script(F.col("__t0"))))
    now, counts = "__t0", {}
    for i, name in enumerate([s for s in cfg.stages if s in STAGES], 1):
        out, n = STAGES[name](F.col(now), F.col("__lang"))
        rows = rows.withColumn(f"__s{i}", F.struct(out.alias("t"), n.cast("int").alias("n"))).withColumn(f"__t{i}", F.col(f"__s{i}.t"))
        now, counts[name] = f"__t{i}", F.col(f"__s{i}.n")
    rows = rows.withColumn("processed", F.col(now)).withColumn("sections", sections(F.col(now), cfg))
    ratio = F.when(F.length("__t0") > 0, F.round(1 - F.length("processed") / F.length("__t0"), 4)).otherwise(0.0)
    found = F.size(F.filter(F.map_values("sections"), lambda x: strip(x) != ""))
    stats = F.struct(
        *[c.alias(n) for n, c in counts.items()], F.size(split_lines(F.col("__t0"))).alias("input_lines"), F.size(split_lines(F.col("processed"))).alias("output_lines"),
        ratio.alias("text_reduction_ratio"), found.alias("sections_found"), F.col("__lang").alias("detected_language"),
    )
    rows = rows.withColumn("stats", stats)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])
