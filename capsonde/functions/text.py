"""String expressions. Every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the source data defines it: the Unicode set plus the four ASCII separators.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Fixed value: words which carry no meaning in a capability name.
LABEL_STOPWORDS = ["and", "to", "of", "the", "in", "for", "with", "from", "on"]

# Fixed value: wording put between the kept head and tail of a long text.
ELISION = "\n...\n"


# The same set as characters, for trimming without a regular expression.
WS_CHARS = "".join(
    chr(i)
    for i in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def compact(c: Column, limit: int = 1200) -> Column:
    """B1: one-line text of at most `limit` characters, marked with dots when cut."""
    text = squeeze(c.cast("string"))
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def norm_name(c: Column) -> Column:
    """snake_case key of a free-text name."""
    snake = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(snake, F.lit("_")), F.lit("")), F.lit("unnamed_ability"))


def title_of(name: Column) -> Column:
    """A snake_case name in title case; a letter after a digit starts a word too."""
    # The mark opens a word after a digit for initcap and is taken out again.
    spaced = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([0-9])(?=[a-z])", "$1\x01 ")
    return F.replace(F.initcap(spaced), F.lit("\x01 "), F.lit(""))


def or_else(*cols: Column) -> Column:
    """First value which is neither null nor empty; the last one is the default."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def strip_fence(c: Column) -> Column:
    """Remove one Markdown code fence around the whole text."""
    text = strip(F.coalesce(c, F.lit("")))
    opened = F.regexp_replace(text, rf"\A```(?:json)?{WS}*", "")
    closed = F.substring(opened, F.lit(1), F.char_length(opened) - 3)
    return (
        F.when(~text.startswith("```"), text)
        .when(opened.endswith("```"), F.rtrim(closed, F.lit(WS_CHARS)))
        .otherwise(opened)
    )


def parse_json_text(c: Column) -> Column:
    """VARIANT of a judged reply; null when neither the text nor its {...} part parses."""
    body = strip_fence(c)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))


def once(c: Column) -> Column:
    """Evaluate a costly expression in a generator of one row.

    Filters and projections above read its result. Left as a plain column it would be copied
    into each of them by the optimizer.
    """
    return F.explode(F.array(c))


def head_tail(c: Column, max_tokens: int = 1024, reserve: int = 40) -> Column:
    """B11 on whitespace tokens: keep the first and last half of an over-long text."""
    half = (max_tokens - reserve) // 2
    words = F.split(strip(c), f"{WS}+")
    cut = F.concat(
        F.array_join(F.slice(words, 1, half), " "),
        F.lit(ELISION),
        F.array_join(F.slice(words, -half, half), " "),
    )
    return F.when(F.size(words) > max_tokens - reserve, cut).otherwise(c)


def label_words(c: Column) -> Column:
    """Lower-case words of a capability name, duplicates kept."""
    words = F.split(F.lower(c), r"(?U)[_\W]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(LABEL_STOPWORDS))


def query_variants(c: Column) -> Column:
    """Search spellings of a benchmark name, distinct, in order."""
    return F.array_distinct(
        F.array(c, F.replace(c, F.lit(" "), F.lit("-")), F.split_part(c, F.lit(" ("), F.lit(1)))
    )


def file_name(c: Column) -> Column:
    """Dataset id as a file-system name."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "__")
