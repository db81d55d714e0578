"""Text functions as Column expressions. White space is Unicode's, as the flag (?U) makes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space, spelt out: Java's flag (?U) makes every class of an expression several times slower.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def words(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def has_words(c: Column, least: int) -> Column:
    """Whether c has at least so many words; no more of them are read."""
    word = "[^" + SPACE[1:-1] + "]++"
    return c.rlike(f"^{SPACE}*+(?:{word}{SPACE}++){{{least - 1}}}{word}") if least > 0 else c.isNotNull()


def slug(c: Column) -> Column:
    return trim_chars(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-")


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def sentences(c: Column) -> Column:
    parts = F.split(c, "(?<=[.!?])" + SPACE + "+(?=[A-Z(\"'“])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def overlap_tail(c: Column, budget: int) -> Column:
    """The last whole sentences within the budget, at least one; the walk stops at the first that does not fit.

    Only the end of a text is cut into sentences if the walk stops there, before the first of them, which may be a part."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, s: Column) -> Column:
        cost = estimate_tokens(s)
        full = acc["stop"] | ((acc["used"] + cost > budget) & (F.size(acc["taken"]) > 0))
        return F.struct(
            F.when(full, acc["used"]).otherwise(acc["used"] + cost).alias("used"),
            full.alias("stop"),
            F.when(full, acc["taken"]).otherwise(F.concat(F.array(s), acc["taken"])).alias("taken"),
        )

    def walk(parts: Column) -> Column:
        return F.array_join(F.aggregate(F.reverse(parts), start, step)["taken"], " ")

    def stops(parts: Column) -> Column:
        behind = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.aggregate(behind, F.lit(0), lambda n, s: n + estimate_tokens(s)) > budget

    near = 8 * budget
    end = once(sentences(F.right(c, F.lit(near))), lambda s: F.when(stops(s), walk(s)).otherwise(walk(sentences(c))))
    return F.when(F.length(c) <= near, walk(sentences(c))).otherwise(end) if budget > 0 else F.lit("")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space and the separators that count as such in a text's quality.
WHITE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def text_quality(c: Column) -> Column:
    """score, broken_ratio, space_ratio, vowel_ratio, reason of a text: how little it reads like language."""

    def counted(t: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(pattern))
        return F.struct(
            F.length(t).alias("n"), (count(rf"[\p{{C}}&&[^{WHITE}]]") + F.length(t) - F.length(F.replace(t, F.lit("�")))).alias("broken"),
            count(f"[{WHITE}]").alias("space"), count(r"\p{L}").alias("letters"), count("[aeiouAEIOU]").alias("vowels"),
        )

    def judged(x: Column) -> Column:
        broken, space = x["broken"] / x["n"], x["space"] / x["n"]
        vowel = F.when(x["letters"] > 0, x["vowels"] / x["letters"]).otherwise(0.0)
        p_broken = F.least(F.lit(1.0), broken * 20)
        p_space = F.when(space >= 0.08, 0.0).otherwise(F.least(F.lit(1.0), (0.08 - space) / 0.08))
        off = F.abs(vowel - 0.38)
        p_vowel = F.when((x["letters"] == 0) | (off <= 0.18), 0.0).otherwise(F.least(F.lit(1.0), (off - 0.18) / 0.18))
        score = F.greatest(p_broken, p_space, p_vowel)
        cause = F.when(score <= 0, "reads as language").when(score == p_broken, "broken").when(score == p_space, "space").otherwise("vowel")
        short = x["n"] < 40
        zero = lambda v: F.when(short, F.lit(0.0)).otherwise(v)
        return F.struct(
            zero(score).alias("score"), zero(broken).alias("broken_ratio"), zero(space).alias("space_ratio"), zero(vowel).alias("vowel_ratio"),
            F.when(short, "too short to assess").otherwise(cause).alias("reason"),
        )

    return once(once(strip(c), counted), judged)


def furniture_key(c: Column) -> Column:
    """A line with its numbers blanked, so that a footer's pages count as one line."""
    return trim_chars(F.regexp_replace(c, r"\d+", "#"), " *")


def strip_images(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""))


def unfence(c: Column) -> Column:
    """Without a code fence around the whole text; fences around a part stay."""
    lines = F.split(c, "\n")
    fences = F.size(F.filter(lines, lambda x: strip(x).startswith("```")))
    whole = c.startswith("```") & (F.size(lines) >= 2) & strip(F.element_at(lines, -1)).startswith("```") & (fences == 2)
    return F.when(whole, strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(c)


def table_runs(c: Column) -> Column:
    """Runs of two or more neighbouring pipe rows."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"))
    is_row = lambda x: strip(x).startswith("|") & (F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2)

    def step(acc: Column, x: Column) -> Column:
        run = F.when(is_row(x), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), (acc["n"] + F.when(run == 2, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(c, "\n"), start, step)["n"]


def separator_rows(c: Column) -> Column:
    """Rows that consist of bars, dashes and colons and hold three dashes."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: strip(x).startswith("|") & strip(x).rlike(r"^[|\-: ]+$") & x.contains("---")))


def is_contents_table(c: Column) -> Column:
    """Whether a pipe table lists sections and page numbers instead of data."""
    rows = F.filter(F.split(c, "\n"), lambda x: strip(x).startswith("|") & ~strip(x).rlike(r"^[|\-: ]*$"))

    def listed(row: Column) -> Column:
        cells = F.transform(F.split(trim_chars(strip(row), "|"), r"\|"), strip)
        first, rest = F.get(cells, F.lit(0)), strip(F.array_join(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), " "))
        numbered = first.rlike(r"^\s*\d+(\.\d+){0,4}\.?\s+\S") | first.rlike(r"(?i)^\s*(annexure|appendix|schedule|exhibit)\b")
        return numbered & rest.rlike(r"^[.\s]*\d{0,4}[.\s]*$")

    return (F.size(rows) >= 3) & (F.size(F.filter(rows, listed)) >= F.greatest(F.lit(3), F.floor(F.size(rows) * 0.6).cast("int")))


def degenerate_repeat(c: Column, threshold: int = 8) -> Column:
    """Occurrences of the most repeated telling line, if they look like a loop, else 0."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    telling = F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike(r"^[|\-:` \t]*$"))
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["line"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate(F.array_sort(telling), start, step)["most"]
    return F.when((F.size(lines) >= 2 * threshold) & (most >= threshold), most).otherwise(0)


def safe_filename(c: Column) -> Column:
    """Without path and control characters, with .pdf, at most 150 characters (NFKC is up to the caller)."""
    base = F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)
    base = strip(F.regexp_replace(F.regexp_replace(base, r"\p{Cntrl}", ""), '[<>:"|?*]', "_"))
    stem = F.regexp_replace(base, r"(?i)\.pdf$", "")
    return F.concat(F.left(stem, F.lit(146)), F.lit(".pdf"))


def count_of(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")
