"""Line-first cleaning: rules judge every line, failing lines go, documents that lose too much go.

Only DataFrame functions; one pass over the rows, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliflow.llm.common import BLANK_RUN, BLANKS, let, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of notices and page furniture (lower case); a line of few words that holds one is boilerplate.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign up", "subscribe to our", "terms of service", "terms of use",
)


#: A phrase between word boundaries.
WHOLE_PHRASE = r"(^|[^\p{L}\p{N}_])(" + "|".join(BOILERPLATE) + r")($|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class LineRules:
    """Thresholds. A line fails if any rule holds; a document is kept if enough of its text is in lines that pass."""

    max_symbols_per_word: float = 0.3
    max_bars_per_word: float = 0.15
    max_upper_share: float = 0.6
    min_upper_words: int = 3
    min_distinct_share: float = 0.25
    min_distinct_words: int = 12
    max_boilerplate_words: int = 12
    #: Phrases count between word boundaries only: "log in" isn't in "catalog in".
    whole_phrases: bool = True
    min_unended_words: int = 2
    min_kept_share: float = 0.5
    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20


def _symbols(text: Column) -> Column:
    """How many of ``SYMBOLS`` the text holds."""
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Number of words in ``window``-word runs that are found twice or more in the array, the first included.

    Runs are compared by 64-bit hashes; only rows with an equal pair sort them.
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def mark(e: Column, k: Column) -> Column:
                same = lambda j: F.coalesce(F.get(s, j)["g"] == e["g"], F.lit(False))
                return F.when(same(k - 1) | same(k + 1), e["i"])

            return F.sort_array(F.filter(F.transform(s, mark), lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, k - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), total))

    def shifted(a: Column, by: int) -> Column:
        return F.slice(a, by + 1, F.size(a))

    def doubled(runs: Column, by: int) -> Column:
        return let(runs, lambda r: F.zip_with(r, shifted(r, by), lambda a, b: F.xxhash64(a, b)))

    def grams(w: Column) -> Column:
        """Hashes of all runs: those of 2, 4, 8 ... words are hashed in pairs, then single words are added."""
        width, runs = 1, w
        while 2 * width <= window:
            runs = doubled(runs, width)
            width *= 2
        for at in range(width, window):
            runs = F.zip_with(runs, shifted(w, at), lambda a, b: F.xxhash64(a, b))
        return F.slice(runs, 1, F.size(w) - window + 1)

    def of_words(w: Column) -> Column:
        return let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))

    return let(words, lambda w: F.when(F.size(w) > window, of_words(w)).otherwise(F.lit(0).cast("long")))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line with a word fails a punctuation, navigation, symbol, shouting, run or boilerplate rule."""

    def judge(w: Column) -> Column:
        n = F.size(w)
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
        lower = F.lower(line)
        phrase = F.lit(False)
        if rules.whole_phrases:
            phrase = lower.rlike(WHOLE_PHRASE)
        else:
            for p in BOILERPLATE:
                phrase = phrase | lower.contains(p)
        return (
            (_symbols(line) > rules.max_symbols_per_word * n)
            | (bars > rules.max_bars_per_word * n)
            | ((n >= rules.min_upper_words) & (upper > rules.max_upper_share * letters))
            | ((n >= rules.min_distinct_words) & (F.size(F.array_distinct(w)) < rules.min_distinct_share * n))
            | ((n < rules.min_unended_words) & ~line.rlike(r"[.!?:;,\"'”»…)\]][\x20\x09-\x0D]*$"))
            | ((n <= rules.max_boilerplate_words) & phrase)
        )

    return let(words_of(line), judge)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Every input row and column, with ``qr_*`` columns: counts, verdict and the cleaned text.

    Null texts count as texts without words and are rejected; so are empty ones. Rows are judged one by one, so
    repeated rows get equal results, and an empty table gives an empty result. Input columns that are already named
    ``qr_*`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    lines = docs.withColumns({"qr_words": words_of(text), "qr_lines": with_word})
    good = F.filter(F.col("qr_lines"), lambda x: ~line_fails(x, rules))
    judged = lines.withColumns(
        {
            "qr_n_words": F.size("qr_words").cast("long"),
            "qr_word_chars": F.length(F.regexp_replace(text, BLANK_RUN, "")).cast("long"),
            "qr_n_symbols": _symbols(text),
            "qr_n_lines": F.size("qr_lines").cast("long"),
            "qr_n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
            "qr_n_repeat_words": repeated_words(F.col("qr_words"), rules.window),
            "qr_clean_text": F.array_join(good, "\n"),
            "qr_line_chars": F.length(F.array_join("qr_lines", "\n")).cast("long"),
        }
    ).drop("qr_words", "qr_lines")
    failed = (F.col("qr_n_words") < rules.min_words) | (100 * F.col("qr_n_repeat_words") > rules.max_repeat_percent * F.col("qr_n_words"))
    enough = F.length("qr_clean_text") >= rules.min_kept_share * F.col("qr_line_chars")
    return judged.withColumn("qr_base_failed", failed).withColumn("qr_kept", ~failed & enough)


def op7_query(docs: DataFrame) -> DataFrame:
    q = quality_rules(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"qr_{n}").alias(n) for n in names], F.length("qr_clean_text").cast("long").alias("clean_chars"))



#: The same in DuckDB, with the default thresholds.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(CASE WHEN p IS NULL THEN 5 ELSE least(5, i - p) END)::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
j AS (SELECT rid, pos, line,
  length(line) - length(translate(line, '{SYMBOLS}', '')) > 0.3 * len(lw)
  OR length(line) - length(translate(line, '|', '')) > 0.15 * len(lw)
  OR (len(lw) >= 3 AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) > 0.6 * length(regexp_replace(line, '[^\p{{L}}]', '', 'g')))
  OR (len(lw) >= 12 AND len(list_distinct(lw)) < 0.25 * len(lw))
  OR (len(lw) < 2 AND NOT regexp_matches(line, '[.!?:;,"''”»…)\]][\x20\x09-\x0D]*$'))
  OR (len(lw) <= 12 AND regexp_matches(lower(line), '{WHOLE_PHRASE}')) AS fails FROM l),
a AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) + count(*) - 1 AS line_chars,
  greatest(coalesce(sum(length(line)) FILTER (NOT fails), 0) + count(*) FILTER (NOT fails) - 1, 0) AS clean_chars FROM j GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND clean_chars >= 0.5 * line_chars AS kept, clean_chars
FROM (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(clean_chars, 0)::BIGINT AS clean_chars, coalesce(line_chars, 0) AS line_chars,
  len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN c USING (rid) LEFT JOIN a USING (rid))
"""
