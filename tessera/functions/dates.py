"""Dates, retries, budgets and numbers as columns (section 2.10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def epoch_to_iso(epoch: Column) -> Column:
    """None and 0 give an empty text."""
    return F.when(epoch.isNull() | (epoch == 0), "").otherwise(F.date_format(F.timestamp_seconds(epoch), ISO))


def rfc822(value: Column) -> Column:
    """A timestamp of an RFC 822 text, with or without its weekday; null if malformed."""
    t = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")))


def feed_time(published: Column, fetched: Column) -> Column:
    """ISO passes, RFC 822 is rewritten, anything else gives the fetch time."""
    iso = F.when(published.rlike(r"^\d{4}-"), published)
    return F.coalesce(iso, F.date_format(rfc822(published), ISO), fetched, F.lit(""))


def any_time(value: Column) -> Column:
    """D3: epoch digits, ISO or RFC 822, as UTC; null otherwise."""
    t = F.trim(value)
    digits = F.when(t.rlike(r"^\d{1,12}$"), F.timestamp_seconds(F.try_to_number(t, F.lit("999999999999")).cast("long")))
    iso = F.when(t.rlike(r"^\d{4}-"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")))
    return F.coalesce(digits, iso, rfc822(t))


def humanized(value: Column, now: Column, lang: str = "zh-CN") -> Column:
    """Today, days ago, or the date; a text that is no date stays."""
    at = any_time(value)
    days = F.datediff(now, at)
    y, m, d = F.year(at).cast("string"), F.month(at), F.dayofmonth(at).cast("string")
    if lang.startswith("zh"):
        today, ago, full = F.lit("今天"), F.concat(days.cast("string"), F.lit(" 天前")), F.concat(y, F.lit(" 年 "), m.cast("string"), F.lit(" 月 "), d, F.lit(" 日"))
    else:
        name = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), m)
        today, ago, full = F.lit("Today"), F.concat(days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago")), F.concat(name, F.lit(" "), d, F.lit(", "), y)
    shown = F.when(days <= 0, today).when(days < 7, ago).otherwise(full)
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(at.isNull(), value).otherwise(shown)


def export_time(value: Column) -> Column:
    """Digits are epochs; a blank becomes T; Z follows unless an offset does."""
    t = F.trim(value)
    digits = F.date_format(F.timestamp_seconds(F.try_to_number(t, F.lit("999999999999")).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    iso = F.replace(t, F.lit(" "), F.lit("T"))
    return F.when(F.coalesce(t, F.lit("")) == "", None).when(t.rlike(r"^\d+$"), digits).when(iso.rlike(r"(Z|[+-]\d\d:\d\d)$"), iso).otherwise(F.concat(iso, F.lit("Z")))


def age_hours(at: Column, now: Column) -> Column:
    """Infinite if missing."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) / 3600, F.lit(float("inf")))


def is_stale(last_updated: Column, today: Column, most_days: int = 180) -> Column:
    """Missing is stale."""
    return F.coalesce(F.datediff(today, last_updated) > most_days, F.lit(True))


def retry_days(attempts: Column) -> Column:
    """D8."""
    return F.when(attempts <= 1, 1).when(attempts == 2, 3).otherwise(7)


def transition(attempts: Column, outcome: Column, now: Column, most: int = 3) -> Column:
    """(status, attempts, next_retry_at) after an outcome: applied, rejected or retry."""
    n = attempts + 1
    again = (outcome == "retry") & (n < most)
    return F.struct(
        F.when(outcome.isin("applied", "rejected"), outcome).when(again, "retry").otherwise("rejected").alias("status"),
        n.alias("attempts"), F.when(again, F.date_add(now, retry_days(n))).alias("next_retry_at"),
    )


def in_window(at: Column, end: Column, lookback: int) -> Column:
    """The last ``lookback`` days up to ``end``, both inclusive."""
    day = F.to_date(at)
    return day.between(F.date_sub(end, max(lookback - 1, 0)), end)


def article_budget(chars: Column, images: Column) -> Column:
    """M1: seconds for an article."""
    chunks = F.greatest(F.lit(1), F.floor(chars / 4800))
    return F.greatest(120 + 30 * chunks + 30 * images, F.lit(3600)).cast("long")


def clamped_timeout(single: Column, remaining: Column) -> Column:
    """M2."""
    return F.when(remaining - 60 > 0, F.least(single, remaining - 60)).otherwise(F.greatest(F.lit(60), remaining / 2)).cast("double")


def queue_budget(base: Column, depth: Column, cap: Column) -> Column:
    """M3."""
    return F.least(cap, F.greatest(base, depth * 200))


def cooldown(failures: Column) -> Column:
    """M4, without jitter."""
    return F.least(30 * F.pow(F.lit(2.0), failures - 1), F.lit(1800.0))


def burn_rate(cost: Column, articles: Column, baseline: Column) -> Column:
    """M6."""
    return F.coalesce(F.try_divide(F.try_divide(cost, articles), baseline), F.lit(1.0))


def keeps_image(width: Column, height: Column, least: int = 300) -> Column:
    """M7: unreadable images are kept."""
    return F.coalesce(F.least(width, height) >= least, F.lit(True)) | width.isNull() | height.isNull()


def cost(articles: Column, images: Column) -> Column:
    """Decimal cost; negatives count as none."""
    return (F.greatest(articles, F.lit(0)).cast("decimal(18,0)") * F.greatest(images, F.lit(0)).cast("decimal(18,0)") * F.lit("0.0013").cast("decimal(5,4)")).cast("decimal(18,4)")


def low_balance(balance: Column, estimate: Column) -> Column:
    """Y17."""
    return (balance < estimate) | (balance < F.lit("0.05").cast("decimal(18,4)"))


def age_text(seconds: Column) -> Column:
    """Y24."""
    s = seconds.cast("long")
    t = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 60, t(s, "s")).when(s < 3600, t(s / 60, "m")).when(s < 86400, F.concat(t(s / 3600, "h "), t((s % 3600) / 60, "m"))).otherwise(F.concat(t(s / 86400, "d "), t((s % 86400) / 3600, "h")))


def known_topics(topics: Column, known: tuple[str, ...]) -> Column:
    """The known topics of a JSON list in order; none if it is no list."""
    return F.array_sort(F.filter(F.coalesce(F.from_json(topics, "array<string>"), F.array().cast("array<string>")), lambda t: t.isin(*known)))


def tag_list(tags: Column, most: int = 5) -> Column:
    """R2: a JSON list, or else a comma-separated one."""
    parts = F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.slice(F.coalesce(F.from_json(F.when(F.trim(tags).startswith("["), tags), "array<string>"), parts, F.array().cast("array<string>")), 1, most)
