"""What kind of defect an issue's text describes, and where it is mended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cluster, pattern on the lower-cased text, channel; the first that fits counts.
RULES = [
    ("highlight_mat", r"highlight|nền vàng|màu vàng", "policy"),
    ("congthuc_vo", r"công thức|phân số|subscript|superscript|số mũ|overline|căn bậc", "code"),
    ("bang_vo", r"bảng|exhibit.*cột|cột.*dồn|2 cột|3 cột|hàng.*giá trị", "code"),
    ("bullet_indent", r"bullet|indent|thụt lề|đánh dấu đầu dòng", "code"),
    ("chu_de_chong", r"đè|chồng|overlap|xuyên qua", "mixed"),
    ("tran_khung", r"tràn|sát viền|chạm viền|vượt khung|bị cắt|clip", "text"),
    ("label_tach_dong", r"tách.*dòng riêng|thành.*tiêu đề|run-in", "code"),
    ("header_hong", r"header|đầu trang.*lặp", "code"),
]
OTHER = ("khac", "unknown")
RANK = {"low": 1, "medium": 2, "high": 3}


def classify(detail: Column, part: int) -> Column:
    """The cluster (part 0) or channel (part 1) of an issue's text."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    out = F.lit(OTHER[part])
    for name, pattern, channel in reversed(RULES):
        out = F.when(low.rlike(pattern), F.lit((name, channel)[part])).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    """1 to 3; a missing or unknown severity is low."""
    out = F.lit(1)
    for name, n in RANK.items():
        out = F.when(severity == name, F.lit(n)).otherwise(out)
    return out


def sql(column: str, part: int) -> str:
    """The same classification for DuckDB."""
    cases = " ".join(f"WHEN regexp_matches(lower(coalesce({column}, '')), '{p}') THEN '{(n, c)[part]}'" for n, p, c in RULES)
    return f"CASE {cases} ELSE '{OTHER[part]}' END"
