"""Row predicates as boolean columns (section 2.3, P1-P22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a login wall.
LOGIN_WALL = (
    "Sign in", "Log in to continue", "Subscribe to read", "Subscribe to continue reading", "article limit",
    "This content is for members only", "Unlock this article", "Become a member",
    "登录查看", "关注公众号", "请先登录", "扫码关注", "免费注册", "订阅后阅读", "会员专享", "付费内容",
)
#: Length limits of bodies.
LEAST_CONTENT, LEAST_FEED_TEXT, SHORT_RSS, FAILED_BODY, FAILED_CONTENT = 200, 500, 100, 500, 2000


def has_body(body: Column) -> Column:
    return body.isNotNull() & (body != "")


def display_ok(body: Column, layer1: Column, layer2: Column) -> Column:
    """Shown in listings."""
    return F.coalesce(has_body(body) & (layer1 == "candidate") & (layer2 == "ok"), F.lit(False))


def lenient_ok(layer2: Column) -> Column:
    """Not rejected; no verdict passes."""
    return layer2.isNull() | (layer2 != "reject")


def candidate_filter(mode: str, body: Column, layer1: Column, layer2: Column) -> Column:
    """Strict, layer1-only or all."""
    modes = {"strict": (layer1 == "candidate") & lenient_ok(layer2), "layer1-only": layer1 == "candidate", "all": F.lit(True)}
    if mode not in modes:
        raise ValueError(f"unknown filter mode: {mode}")
    return F.coalesce(has_body(body) & modes[mode], F.lit(False))


def title_contains(title: Column, needle: str) -> Column:
    """P7."""
    return F.lower(title).contains(needle.lower())


def needs_scrape(source: Column, body: Column) -> Column:
    """No body, or a feed's stub."""
    return ~has_body(F.coalesce(body, F.lit(""))) | ((source == "rss") & (F.length(body) <= SHORT_RSS))


def anti_bot_shell(body: Column, marker: str = "CAPTCHA") -> Column:
    """P9."""
    b = F.coalesce(body, F.lit(""))
    return (F.length(b) < LEAST_CONTENT) | F.upper(b).contains(marker)


def scrape_failed(body: Column, content_length: Column) -> Column:
    """P10: a short body of what was long; an unknown length is no failure."""
    return (F.length(F.coalesce(body, F.lit(""))) < FAILED_BODY) & F.coalesce(content_length > FAILED_CONTENT, F.lit(False))


def passes_quality_gate(text: Column) -> Column:
    """P11."""
    wall = "|".join(p.lower() for p in LOGIN_WALL)
    return F.coalesce((F.length(text) >= LEAST_CONTENT) & ~F.lower(text).rlike(wall), F.lit(False))


def feed_reason(text: Column, lang: Column, supported: tuple[str, ...] = ("en", "zh-CN", "zh")) -> Column:
    """Why a feed entry is dropped; null keeps it."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) < LEAST_FEED_TEXT, "too_short").when(~F.coalesce(lang.isin(*supported), F.lit(False)), "unsupported_lang")


def candidate_bucket(layer1: Column, version: Column, current: str) -> Column:
    """No verdict, one of another prompt version, or a candidate."""
    return layer1.isNull() | ~version.eqNullSafe(F.lit(current)) | (layer1 == "candidate")


def is_stuck(status: Column) -> Column:
    """P18."""
    return F.lower(status).isin("failed", "processing")


def is_due(status: Column, next_retry_at: Column, now: Column) -> Column:
    """Terminal suggestions never; retries when their time has come; the rest always."""
    return F.when(status.isin("applied", "rejected"), False).when(status == "retry", next_retry_at.isNull() | (next_retry_at <= now)).otherwise(True)


def within_tolerance(actual: Column, expected: Column, share: float) -> Column:
    """P21."""
    return F.abs(actual - expected) <= F.abs(expected) * share


def evidence_violations(evidence_type: Column, ref: Column, title: Column, quote: Column) -> Column:
    """The violations of an evidence row."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(~F.coalesce(evidence_type.isin("article", "web", "builtin"), F.lit(False)), "unknown type"),
        F.when((evidence_type != "builtin") & blank(ref), "missing ref"),
        F.when(blank(title), "missing title"), F.when(blank(quote), "missing quote"),
    ))
