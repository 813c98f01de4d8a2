"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of common words are
compared with the reference of its language, by Jensen-Shannon distance (base
2, so 0 to 1). References are the summed histograms of all documents of a
language; documents of other or unknown languages meet the sum of all. Texts
too short for a stable histogram are not judged by it.

Defined cases: a null or empty text has no words, fails the base rule and is
not kept; a null language meets the overall reference; long texts are counted
whole; repeated rows are judged each; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import WORD, let, table, text_column, written

#: Frequent function words by language.
COMMON_WORDS = {
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "ein", "auf", "für", "sich", "des"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "was", "on", "be", "by", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"),
}
ANY = "any"
#: The character classes, as sets of a regular expression; the rest is one more class.
CLASSES = ("a-z", "A-Z", "0-9", " ", r"\n", r".,;:!?'\"()\-", r"#*$%&|<>@^~_=+/\\\[\]{}`")

#: Histograms are compared only for texts with at least so many characters or words.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest distances that are kept.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.33


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the list."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(ranked: Column) -> Column:
        """``ranked``: (window, place) in order; places whose window has an equal neighbour."""
        after = F.zip_with(ranked, F.slice(ranked, 2, F.greatest(F.size(ranked) - 1, F.lit(0))), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))
        return let(places, lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))))

    def counted(t: Column) -> Column:
        ranked = F.sort_array(F.zip_with(t, F.sequence(F.lit(0), F.size(t) - 1), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(let(ranked, covered))

    return F.when(F.size(words) < 3, 0).otherwise(let(words, lambda w: let(windows(w), counted))).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = text_column(docs, text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumns({
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    words = F.regexp_extract_all(t, F.lit(WORD), 0)
    measured = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    out = out.withColumn("_m", measured)
    return out.select("*", "_m.n_words", "_m.word_chars", "_m.n_repeat_words").drop("_m")


def class_histogram(text: Column) -> Column:
    """Characters by class, the rest last."""
    left = [text]
    for c in CLASSES:
        left.append(F.regexp_replace(left[-1], f"[{c}]+", ""))
    # each class is counted on what the classes before it left
    return F.array(*[(F.length(a) - F.length(b)).cast("long") for a, b in zip(left, left[1:], strict=False)], F.length(left[-1]).cast("long"))


def word_histogram(text: Column, language: Column, n_words: Column) -> Column:
    """Words by the common words of a language, all others last; an unknown language has none."""

    def of(words: tuple[str, ...]) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}])(" + "|".join(words) + r")(?![\p{L}])"), 1)
        joined = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))

        def counts(j: Column) -> Column:
            each = [((F.length(j) - F.length(F.replace(j, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in words]
            return F.array(*each, F.greatest(n_words - reduce(lambda a, b: a + b, each), F.lit(0)).cast("long"))

        return let(joined, counts)

    chain = F
    for name, words in COMMON_WORDS.items():
        chain = chain.when(language == name, of(words))
    return chain.otherwise(F.array(*[F.lit(0).cast("long")] * len(next(iter(COMMON_WORDS.values()))), n_words))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null if either is empty."""

    def share(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda n: F.when(n > 0, F.transform(h, lambda x: x / n)))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.when(divergence < 0, 0.0).otherwise(divergence))


def references(histograms: DataFrame) -> DataFrame:
    """Summed histograms by language and over all: one row per known language and one more, so at most five."""
    sizes = {"chars": len(CLASSES) + 1, "words": len(next(iter(COMMON_WORDS.values()))) + 1}
    flat = histograms.select("language", *[F.col(k)[i].alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)])
    sums = [F.sum(f"{k}{i}").alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    by = flat.where(F.col("language") != ANY).groupBy("language").agg(*sums)
    every = flat.agg(*sums).select(F.lit(ANY).alias("language"), *[f"{k}{i}" for k, n in sizes.items() for i in range(n)])
    return by.unionByName(every).select("language", *[F.array(*[F.col(f"{k}{i}") for i in range(n)]).alias(f"reference_{k}") for k, n in sizes.items()])


def judge(docs: DataFrame, text: str = "text", language: str = "lang", most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """The base measures and rule, both distances (null where a text is too short) and ``kept`` of every document."""
    known = F.when(docs[language].isin(*COMMON_WORDS), docs[language]).otherwise(F.lit(ANY))
    slim = docs.select("doc_id", docs[text].cast("string").alias("text"), known.alias("language"))
    counted = base_counts(slim)
    t = text_column(counted)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    histograms = written(counted.select("doc_id", "language", *measures, F.length(t).alias("n_chars"), class_histogram(t).alias("chars"), word_histogram(t, F.col("language"), F.col("n_words")).alias("words")), "histograms")
    out = histograms.join(F.broadcast(references(histograms)), "language", "left")
    out = out.withColumns({
        "char_distance": F.when(F.col("n_chars") >= LEAST_CHARS, jensen_shannon(F.col("chars"), F.col("reference_chars"))),
        "word_distance": F.when((F.col("n_words") >= LEAST_WORDS) & (F.col("language") != ANY), jensen_shannon(F.col("words"), F.col("reference_words"))),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= most_char) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= most_word)
    return out.select("doc_id", *measures, "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def _distance(p: str, q: str) -> str:
    """DuckDB SQL of the Jensen-Shannon distance of two lists."""
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(a)} + {part(b)})) / 2, 0)) END"


def _sql() -> str:
    """DuckDB SQL of the query's rows. A common word stands alone where a maximal run of letters is the word."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    classes = ", ".join("length(t) - length(regexp_replace(t, '[" + c.replace("'", "''") + "]', '', 'g'))" for c in CLASSES)
    common = " ".join(f"WHEN '{name}' THEN {quoted(words)}" for name, words in COMMON_WORDS.items())
    n = len(next(iter(COMMON_WORDS.values())))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE '{ANY}' END AS language FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, CASE language {common} END AS common, regexp_extract_all(lower(t), '\\p{{L}}+') AS runs, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, [{classes}] AS kinds FROM d),
h AS (
  SELECT doc_id, language, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t) AS n_chars,
    kinds || [length(t) - list_sum(kinds)] AS chars, CASE WHEN common IS NULL THEN list_transform(range({n}), lambda i: 0) ELSE list_transform(common, lambda c: len(list_filter(runs, lambda x: x = c))) END AS found FROM w),
v AS (SELECT *, found || [greatest(n_words - list_sum(found), 0)] AS words FROM h),
g AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM v WHERE len(w) >= 3)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE (doc_id, win) IN (SELECT (doc_id, win) FROM g GROUP BY doc_id, win HAVING count(*) > 1)) GROUP BY doc_id),
x AS (SELECT language, 'c' AS kind, unnest(chars)::bigint AS n, generate_subscripts(chars, 1) AS i FROM v UNION ALL SELECT language, 'w', unnest(words)::bigint, generate_subscripts(words, 1) FROM v),
y AS (SELECT language, kind, i, sum(n) AS n FROM x WHERE language <> '{ANY}' GROUP BY ALL UNION ALL SELECT '{ANY}', kind, i, sum(n) FROM x GROUP BY kind, i),
r AS (SELECT language, list(n ORDER BY i) FILTER (kind = 'c') AS ref_chars, list(n ORDER BY i) FILTER (kind = 'w') AS ref_words FROM y GROUP BY language),
z AS (
  SELECT v.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN n_chars >= {LEAST_CHARS} THEN {_distance("chars", "ref_chars")} END AS cd, CASE WHEN n_words >= {LEAST_WORDS} AND v.language <> '{ANY}' THEN {_distance("words", "ref_words")} END AS wd
  FROM v LEFT JOIN r ON v.language = r.language LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(cd, 0) <= {MOST_CHAR_DISTANCE} AND coalesce(wd, 0) <= {MOST_WORD_DISTANCE} AS kept, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance FROM z"""


SQL = _sql()
