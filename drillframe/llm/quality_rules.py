"""Rule-based quality filter: one Spark projection compiled from a table of thresholds, without user functions.

Edge cases: a null text counts as empty; an empty or blank text has no words and fails the base rule; rows with
equal ids or texts are measured one by one; an empty table gives an empty result; any other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, plain_text

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it on with as are be at by this from was".split()
    + "der die und in den von zu das mit ein eine ist nicht für auf im dem des".split()
    + "de la le et les des en un une du que est pour dans par sur au".split()
    + "el los las y del se por con una no es para su al lo".split()
)

#: As they stand in running text, so that a word is looked up as it is.
STOP_FORMS = tuple(sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize()) for end in ("", ".", ",")}))

#: Fixed rules: rows with fewer words, or with a larger share (percent) of words in repeated windows, always fail.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PCT = 50, 50

#: measure, of what, lowest and highest percentage allowed (None: no bound). Applied to rows that pass the base rules.
THRESHOLDS = (
    ("word_chars", "n_words", 200, 1500),
    ("n_symbols", "n_words", None, 20),
    ("n_stop_words", "n_words", 3, None),
    ("n_exclamations", "n_words", None, 30),
    ("n_dup_lines", "n_lines", None, 60),
    ("n_repeat_words", "n_words", None, 45),
    ("n_ellipsis_lines", "n_lines", None, 30),
    ("n_bullet_lines", "n_lines", None, 90),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _count_of(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def _repeat_words(words: Column) -> Column:
    """Positions covered by 3-word windows found twice or more. Sorting brings equal windows together; each repeated
    start adds the positions up to the next one, three at most."""

    def repeated_starts(s: Column) -> Column:
        starts = F.transform(s, lambda x, k: F.when((x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]), x["i"]))
        return F.sort_array(F.filter(starts, lambda v: v.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("w"), i.alias("i"))

    ordered = F.sort_array(F.slice(F.transform(words, window), F.lit(1), F.size(words) - 2))
    return _let(_let(ordered, repeated_starts), covered).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the thresholds refer to, from whole texts."""
    base = docs.select("doc_id", plain_text().alias("text")).select(
        "doc_id", "text",
        F.array_remove(F.split("text", SPACE_RUN), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    words = F.col("words")
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    base = base.withColumn("hashes", F.when(F.size("words") >= 3, F.slice(hashes, F.lit(1), F.size("words") - 2)).otherwise(F.array().cast("array<bigint>")))
    # Windows that differ in hash differ: only texts in which a hash comes back need the windows themselves.
    base = base.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes")).drop("hashes")
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), "[" + SYMBOLS + "]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _repeat_words(words)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        _count_of(F.col("text"), "!").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("• "))).cast("long").alias("n_bullet_lines"),
    )
    # Generated columns: a filter on them is never pushed into the projections below, where it would stand in place of
    # the word array and split the text anew for every word.
    return base.select("doc_id", F.inline(F.array(counts)))


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one condition in whole numbers."""
    passed = F.lit(True)
    for name, of, low, high in thresholds:
        if low is not None:
            passed &= F.col(name) * 100 >= F.col(of) * low
        if high is not None:
            passed &= F.col(name) * 100 <= F.col(of) * high
    return passed


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: the measures, base_failed and kept."""
    out = measure(docs).withColumn("base_failed", (F.col("n_words") < BASE_MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_MAX_REPEAT_PCT))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def oracle(thresholds=THRESHOLDS) -> str:
    """The same in DuckDB's SQL, with windows unnested and counted."""
    bounds = [f"{a} * 100 >= {b} * {low}" for a, b, low, _ in thresholds if low is not None]
    bounds += [f"{a} * 100 <= {b} * {high}" for a, b, _, high in thresholds if high is not None]
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    blank = r"'[\x20\x09-\x0D]+'"
    return rf"""
    WITH base AS (
      SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
    ), cut AS (
      SELECT rid, doc_id, text,
        list_filter(regexp_split_to_array(text, {blank}), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM base
    ), win AS (
      SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM cut WHERE len(words) >= 3)
    ), again AS (
      SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n >= 2
    ), rep AS (
      SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
    ), m AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, {blank}, '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
        length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
        len(lines)::BIGINT AS n_lines,
        len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
        len(list_filter(lines, lambda x: ltrim(x, ' ') LIKE '- %' OR ltrim(x, ' ') LIKE '• %'))::BIGINT AS n_bullet_lines
      FROM cut LEFT JOIN rep USING (rid)
    ), f AS (
      SELECT *, n_words < {BASE_MIN_WORDS} OR n_repeat_words * 100 > n_words * {BASE_MAX_REPEAT_PCT} AS base_failed FROM m
    )
    SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM f
    """
