"""Settings of the career and document operators. The numbers are fixed values of the public formulas."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CareerConfig:
    days_per_month: float = 30.44
    formula_version: str = "1.0.0"
    work_types: tuple[str, ...] = ("work", "internship")
    academic_types: tuple[str, ...] = ("education", "certificate", "project", "skill")
    #: How an open end is written.
    open_ends: tuple[str, ...] = ("", "present", "current", "now")
    #: Rank of each level.
    level_rank: dict[str, int] = field(default_factory=lambda: {"junior": 1, "mid": 2, "senior": 3, "lead": 4, "manager": 5, "director": 6, "vp": 7, "c-level": 8})
    #: Thresholds of the labels (high, middle).
    growth_labels: tuple[float, float] = (75.0, 40.0)
    stability_labels: tuple[float, float] = (80.0, 50.0)
    momentum_labels: tuple[float, float] = (75.0, 45.0)
    risk_labels: tuple[float, float] = (30.0, 60.0)


@dataclass(frozen=True)
class TextConfig:
    max_text_length: int = 2_000_000
    stages: tuple[str, ...] = ("normalize_unicode", "remove_headers", "remove_page_numbers", "fix_ocr_errors", "fill_broken_paragraphs", "normalize_whitespace", "remove_empty_lines")
    #: Page numbers are left in unless asked for.
    drop_page_numbers: bool = False
    #: Patterns of lines that hold a page number only, and of bullets.
    page_patterns: tuple[str, ...] = (r"(?m)^\s*\d+\s*/\s*\d+\s*$", r"(?m)^\s*[-–]*\s*\d+\s*[-–]*\s*$", r"(?m)^\s*page\s+\d+\s*$", r"(?m)^\s*\d+\s+of\s+\d+\s*$")
    bullet: str = r"^(-|\*|•|\d+\.|[الف-ی]\.)\s+"
    #: Characters put right per language, in this order.
    ocr_en: tuple[tuple[str, str], ...] = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
    ocr_fa: tuple[tuple[str, str], ...] = (("ي", "ی"), ("ك", "ک"), ("ے", "ی"), ("ة", "ه"))
    #: Headings of the sections.
    sections: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("work", ("work experience", "employment", "سوابق کاری", "تجربه کاری")),
        ("education", ("education", "تحصیلات")),
        ("skills", ("skills", "technical skills", "مهارت‌ها")),
        ("certificates", ("certificates", "certifications", "گواهینامه‌ها")),
    )


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds lie within 0 to 100; a review threshold or margin never exceeds the accepting one."""

    threshold: float = 70.0
    limit: int = 5
    candidate_limit: int = 20
    max_limit: int = 100
    max_query_length: int = 256
    label_weight: float = 0.7
    alias_weight: float = 0.3
    accept_threshold: float = 90.0
    review_threshold: float = 75.0
    accept_margin: float = 8.0
    review_margin: float = 3.0
    casefold: bool = True
    strip_marks: bool = True
    scorer: str = "WRatio"
    #: Largest reference list that is sent to the workers as one array; longer ones are refused.
    max_reference: int = 200_000
    ttl_seconds: int = 3600
    negative_ttl_seconds: int = 300
    cache_prefix: str = "occupation"
    cache_version: str = "v1"

    def __post_init__(self) -> None:
        if not all(0 <= x <= 100 for x in (self.threshold, self.accept_threshold, self.review_threshold)):
            raise ValueError("thresholds must lie within 0 and 100")
        if self.review_threshold > self.accept_threshold or not 0 <= self.review_margin <= self.accept_margin:
            raise ValueError("review limits must not exceed the accepting ones")
        if self.limit < 1 or self.candidate_limit < self.limit or self.max_query_length < 1:
            raise ValueError("limits must be at least 1, candidate_limit at least limit")
        if min(self.label_weight, self.alias_weight) < 0 or self.label_weight + self.alias_weight <= 0:
            raise ValueError("weights must not be negative and not both zero")


@dataclass(frozen=True)
class FileConfig:
    """Limits of document files."""

    max_file_mb: float = 5.0
    max_entries: int = 1000
    max_uncompressed_mb: float = 100.0
    max_ratio: float = 100.0
    max_compressed_mb: float = 50.0
    max_pages: int = 1000
    max_text_length: int = 500_000
