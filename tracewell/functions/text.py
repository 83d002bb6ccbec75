"""Text primitives as column expressions: lines, identifier tokens, shingles, retrieval tokens, cleaning, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5

# Terms that retrieval leaves out.
STOP_TERMS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "be", "this", "that", "it", "as", "by", "from", "at",
    "our", "your", "you", "we", "using", "use", "uses", "used", "via", "self", "def", "class", "return", "import", "if", "else", "true", "false",
)


def round4(x: Column) -> Column:
    """Four decimals by arithmetic that every engine does alike."""
    return F.floor(x * 10000 + 0.5) / F.lit(10000.0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rescale(x: Column, baseline: float) -> Column:
    """A share as suspicion: nothing up to the baseline, linear above."""
    return F.when(x <= baseline, F.lit(0.0)).otherwise(clamp((x - baseline) / (1.0 - baseline)))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(text: Column) -> Column:
    """Lines of a text: at line feeds (with or without a carriage return), without an empty last one."""

    def made(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return bound(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1), made)


def count_loc(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"\S"))).cast("long")


def word_tokens(text: Column) -> Column:
    """Identifiers, lower-cased once they are found."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda x: F.lower(x))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams, joined by spaces; a shorter list is one gram, an empty one has none."""

    def made(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.array_distinct(F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(many))

    return bound(tokens, made)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    return ngrams(word_tokens(text), k)


def retrieval_terms(text: Column, split_identifiers: bool = True) -> Column:
    """Lower-cased words, numbers, and (unless left out) the parts of camel and snake case; not single characters or stop terms."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_]*|[0-9]+)"), 1)

    def terms(w: Column) -> Column:
        if not split_identifiers:
            return F.array(F.lower(w))
        found = F.regexp_extract_all(w, F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), 1)
        several = bound(found, lambda parts: F.when(F.size(parts) > 1, F.concat(F.array(F.lower(w)), F.transform(parts, lambda p: F.lower(p)))).otherwise(F.array(F.lower(w))))
        # most words are one part: a letter and lower-case ones
        return F.when(w.rlike("^[A-Za-z][a-z]*$"), F.array(F.lower(w))).otherwise(several)

    return F.filter(F.flatten(F.transform(words, terms)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_TERMS))


def clean_markdown(text: Column) -> Column:
    """Without back-ticks around code, links as their text, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, "`([^`]*)`", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    return strip(F.regexp_replace(plain, r"\s+", " "))
