"""Identity keys of articles, chunks, errors and pages (section 1.4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def canonical_ref(url: Column) -> Column:
    """First ten hex digits of the URL's MD5, for both sources."""
    return F.substring(F.md5(url), 1, 10)


def display_hash(source: Column, content_hash: Column, url: Column) -> Column:
    """wechat: the content hash, else the URL's reference; rss: ten digits of the content hash; others are errors."""
    rss = F.when(content_hash.isNotNull(), F.substring(content_hash, 1, 10)).otherwise(F.raise_error(F.lit("rss row without content_hash")).cast("string"))
    other = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(source, F.lit("null")))).cast("string")
    return F.when(source == "wechat", F.coalesce(blank_to_null(content_hash), canonical_ref(url))).when(source == "rss", rss).otherwise(other)


def doc_id(source: Column, url: Column) -> Column:
    return F.concat(source, F.lit("_"), canonical_ref(url))


def checkpoint_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def lint_fingerprint(check: Column, slug: Column, evidence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", check, slug, F.substring(evidence, 1, 80)), 256), 1, 16)


def embedding_cache_key(text: Column, is_query: Column) -> Column:
    return F.struct(F.substring(F.sha2(text, 256), 1, 16).alias("digest"), is_query.alias("is_query"))


def page_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def patch_id(*parts: Column) -> Column:
    return F.concat(F.lit("wpatch-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def point_id(key: Column) -> Column:
    """A SHA-256 prefix as a UUID of version 4."""
    h = F.sha2(key, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
