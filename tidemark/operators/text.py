"""Text gates, entity names, alerts and order guards."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pattern families of attempts to steer a reader of documents, each with its label.
INJECTIONS = (
    (r"忽略(先前|以上|上述|之前).{0,6}(指示|指令|規則|設定)", "要求忽略先前指示"),
    (r"(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above|earlier)", "要求忽略先前指示"),
    (r"(你現在是|從現在起你是|扮演|assume the role of|you are now)", "要求改變角色"),
    (r"(system\s*prompt|系統提示|系統指令)", "提及系統提示"),
    (r"(請|務必|你必須|you must|always)\s*(輸出|回傳|回答|output|return|respond)", "指定輸出內容"),
    (r"(強力買進|強烈建議買入|立即買進|must buy|strong buy now)", "指定投資結論"),
    (r"<\s*/?\s*(system|instruction|prompt)\s*>", "偽造標記"),
    (r"(new instructions?|新的指示|新指令)", "宣稱有新指示"),
    (r"<<<UNTRUSTED_DOCUMENT>>>", "偽造資料標記"),
    (r"<<<END_UNTRUSTED_DOCUMENT>>>", "偽造資料標記"),
)


def injection_reasons(text: Column, patterns=INJECTIONS) -> Column:
    """The distinct labels of the families that a text matches, whatever the case."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(F.coalesce(text, F.lit("")), F.lit("(?i)" + p)), label) for p, label in patterns])))


def injection_scan(docs: DataFrame, patterns=INJECTIONS, text: str = "text") -> DataFrame:
    """docs with reasons, suspicious and trust: max(0.1, 1 - 0.3 * reasons)."""
    out = docs.withColumn("reasons", injection_reasons(F.col(text), patterns))
    return out.withColumn("suspicious", F.size("reasons") > 0).withColumn("trust", F.greatest(F.lit(0.1), 1 - 0.3 * F.size("reasons")))


def normalized_summary(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s", "")


def content_key(entity: Column, severity: Column, summary: Column) -> Column:
    return F.concat_ws(":", entity.cast("string"), severity, normalized_summary(summary))


def alike(left: str, right: str, threshold: float) -> bool:
    """Whether Ratcliff and Obershelp's ratio reaches the threshold; two bounds from above come before it. Two empty texts are equal."""
    if left == right:
        return True
    m = difflib.SequenceMatcher(None, left, right)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


class Router:
    """One entity's alerts in order: P0 always passes; others go if their content came within a day, or something similar did; more than
    `hourly` in an hour become digests."""

    def __init__(self, hourly: int = 5, day: float = 86400.0, threshold: float = 0.85):
        self.hourly, self.day, self.threshold = hourly, day, threshold
        self.recent: list[tuple[float, str, str]] = []
        self.counted: list[float] = []

    def route(self, at: float, severity: str, summary: str) -> str:
        self.recent = [r for r in self.recent if at - r[0] <= self.day]
        if severity != "P0":
            if any((s == severity and t == summary) or alike(t, summary, self.threshold) for _, s, t in self.recent):
                return "suppressed"
        self.recent.append((at, severity, summary))
        if severity == "P0":
            return "sent"
        self.counted = [c for c in self.counted if at - c < 3600] + [at]
        return "digest" if len(self.counted) > self.hourly else "sent"


def order_checks(orders: DataFrame, limit: int = 10, seconds: int = 60, deviation: float = 0.05) -> DataFrame:
    """orders(event_id, entity, idempotency_key, ts, price, ref_price) with duplicate, halted (limit or more orders in the last seconds) and far."""
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("ts", "event_id"))
    w = Window.partitionBy("entity").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return orders.withColumn("duplicate", first > 1).withColumn("halted", F.count("*").over(w) >= limit).withColumn("far", F.abs(F.col("price") / F.nullif("ref_price", F.lit(0.0)) - 1) > deviation)
