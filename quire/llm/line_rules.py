"""Line-first quality rules in DataFrame functions only (no Python on the executors).

Each line of a text is judged by itself: by its punctuation (it ends like a sentence, symbols and exclamation marks are
rare), as navigation (a row of short items between bars or arrows) and as boilerplate (consent, login, legal and
template phrases). Failing lines are removed; a document that loses over half of its word characters is rejected, as is
one that fails the base rules (under ten words, or over a fifth of its words in repeated five-word windows).

Repeated windows: the windows' 64-bit hashes are sorted within the row with their positions, so equal ones stand
together; nothing is exploded or shuffled. (Two windows of one text with one hash by chance count as equal: under 1e-10
for a text of 20,000 words.)

Defined results: null text counts as empty: zero counts, base_failed, not kept; any length is judged whole; rows are
judged one by one, so repeated rows repeat; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space, symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules of the method.
ENDS = (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "]")
BARS = "|»›·•"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookies?\b.{0,40}\b(use|accept|policy|site)|privacy policy|terms of (use|service)|"
    r"sign (up|in)\b|log ?in\b|click here|subscribe (now|to)|enable javascript|lorem ipsum|powered by|page not found|"
    r"(licensed|released) under|general public license|share this|read more|add to cart)"
)
#: Each way to match BOILERPLATE contains one of these once lowered, so texts without any skip the expression.
HINTS = (
    "rights reserved", "cookie", "privacy policy", "terms of ", "sign up", "sign in", "log in", "login", "click here", "subscribe ", "enable javascript",
    "lorem ipsum", "powered by", "page not found", "licensed under", "released under", "general public license", "share this", "read more", "add to cart",
)
LOSS = 0.5
NEW = "__line_rules"


def _count(text: Column, chars: str) -> Column:
    """How many of the characters a text has. (translate() takes ten times as long as a character class.)"""
    return F.regexp_count(text, F.lit("[" + "".join(f"\\x{ord(c):02X}" if ord(c) < 128 else c for c in chars) + "]"))


def line_fails(line: Column, hinted: Column) -> Column:
    """Whether a line with a word is removed. ``hinted``: its text has a hint of boilerplate."""
    words = (F.length(line) - _count(line, SPACES)) / 5.0  # in words of usual length
    return (
        ~F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).isin(*ENDS)
        | (_count(line, SYMBOLS) > 1 + words / 4)
        | (_count(line, "!") > 2 + words / 4)
        | ((_count(line, BARS) >= 2) & (_count(line, BARS) > words / 6))
        | (hinted & line.rlike(BOILERPLATE))
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once. A lambda's variable is bound, while a column that a lambda names may be
    replaced by its definition (as when a filter moves below a projection) and then computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _repeated(words: Column) -> Column:
    """Words that stand in a five-word window found twice or more."""
    hashes = F.when(
        F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return once(placed, lambda s: once(F.sort_array(F.transform(F.filter(s, lambda x, k: twin(s, x, k)), lambda x: x["i"])), span))

    def twin(s: Column, x: Column, k: Column) -> Column:
        """Whether a neighbour in the sorted order has the same hash (get() beyond the ends is null)."""
        return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

    def span(p: Column) -> Column:
        """Each window counts its words up to the next window."""
        own = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``__whole``, the row of docs as a struct, and ``__line_rules``: base counts, base_failed, kept, clean_text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    step = docs.select(F.struct("*").alias("__whole"), text.alias("__t"))
    t = F.col("__t")
    hinted = once(F.lower(t), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in HINTS)))
    long = lambda c: c.cast("bigint")

    def of_lines(lines: Column) -> Column:
        passed = once(hinted, lambda h: F.filter(lines, lambda x: ~line_fails(x, h)))
        return F.struct(long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.array_join(passed, "\n").alias("clean"))

    def of_words(words: Column) -> Column:
        return F.struct(long(F.size(words)).alias("n_words"), long(F.length(F.array_join(words, ""))).alias("word_chars"), _repeated(words).alias("n_repeat_words"))

    def verdict(w: Column, x: Column) -> Column:
        failed = (w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])
        left = F.length(x["clean"]) - _count(x["clean"], SPACES)
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), long(_count(t, SYMBOLS)).alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"), long(left).alias("clean_chars"), failed.alias("base_failed"),
            (~failed & (left >= (1 - LOSS) * w["word_chars"])).alias("kept"), x["clean"].alias("clean_text"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = once(once(_words(t), of_words), lambda w: once(once(lines, of_lines), lambda x: verdict(w, x)))
    return step.select("__whole", out.alias(NEW))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, the counts, base_failed and kept."""
    got = judged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return got.select("__whole.doc_id", *(F.col(f"{NEW}.{n}").alias(n) for n in names))


def _kept(docs: DataFrame) -> DataFrame:
    """Rows that are kept. The row number, which no optimizer rule moves a filter across, keeps the filter above the
    projection: pushed below it, the verdict would be computed twice."""
    return judged(docs).withColumn("__row", F.monotonically_increasing_id()).where(F.col(f"{NEW}.kept") & (F.col("__row") >= 0))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, every column as it is."""
    return _kept(docs).select("__whole.*")


def cleaned(docs: DataFrame) -> DataFrame:
    """As ``accepted``, with the text reduced to the lines that passed."""
    return _kept(docs).select(F.col("__whole").withField("text", F.col(f"{NEW}.clean_text")).alias("w")).select("w.*")


#: The same result in DuckDB's SQL, for the check of op4.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
f AS (
  SELECT *, list_filter(l, lambda x:
      regexp_matches(x, '[.!?:;…"''”’»)\]][\x20\x09-\x0D]*$')
      AND NOT (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > 1 + (length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) / 5.0) / 4)
      AND NOT (length(x) - length(replace(x, '!', '')) > 2 + (length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) / 5.0) / 4)
      AND NOT (length(x) - length(regexp_replace(x, '[|»›·•]', '', 'g')) >= 2
               AND length(x) - length(regexp_replace(x, '[|»›·•]', '', 'g')) > (length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) / 5.0) / 6)
      AND NOT regexp_matches(x, '(?i)(all rights reserved|cookies?\b.{0,40}\b(use|accept|policy|site)|privacy policy|terms of (use|service)|sign (up|in)\b|log ?in\b|click here|subscribe (now|to)|enable javascript|lorem ipsum|powered by|page not found|(licensed|released) under|general public license|share this|read more|add to cart)')
    ) AS c
  FROM e),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, w FROM f WHERE len(w) >= 5),
h AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 4], ' ') AS gram FROM g),
i AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h),
j AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
  FROM i, (SELECT unnest(range(0, 5)) AS k) WHERE n >= 2 GROUP BY doc_id),
r AS (
  SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(array_to_string(c, chr(10)), '[\x20\x09-\x0D]', '', 'g')) AS clean_chars
  FROM f LEFT JOIN j USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND clean_chars >= 0.5 * word_chars) AS kept
FROM r
"""
