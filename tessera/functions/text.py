"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicons as L

WHITE = r"(?U)[\s\x1c-\x1f]+"


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, as a substring, not as a word."""
    return reduce(or_, (F.contains(text, F.lit(t)) for t in terms))


def count_present(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text."""
    return reduce(add, (F.contains(text, F.lit(t)).cast("int") for t in terms))


def split_words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def token_estimate(text: Column) -> Column:
    """Words times 1.33, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(word_count(text) * 1.33)).cast("long")


def query_terms(text: Column) -> Column:
    """Lower-case terms of letters, digits, _ and -, of three characters at least; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9][A-Za-z0-9_-]+"), F.lit(0)), lambda t: F.length(t) > 2)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(word: Column) -> Column:
    """A light stem: ing, ed, es or s goes, where enough of the word stays."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when(F.endswith(word, F.lit("ing")) & (n > 5), cut(3))
        .when(F.endswith(word, F.lit("ed")) & (n > 4), cut(2))
        .when(F.endswith(word, F.lit("es")) & (n > 4), cut(2))
        .when(F.endswith(word, F.lit("s")) & (n > 3), cut(1))
        .otherwise(word)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all; 0 if both sets are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def word_ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces. words must be a column, not an expression."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def sensitivity(lowered: Column) -> Column:
    """The first class of the cascade whose keywords the text has; medium if none."""
    return (
        F.when(contains_any(lowered, L.SECRET_KEYWORDS), "sealed")
        .when(contains_any(lowered, L.FINANCIAL_KEYWORDS), "high")
        .when(contains_any(lowered, L.LEGAL_KEYWORDS), "restricted")
        .when(contains_any(lowered, L.HEALTH_KEYWORDS), "restricted")
        .when(contains_any(lowered, L.WORK_KEYWORDS), "high")
        .otherwise("medium")
    )


def privacy(level: Column) -> Column:
    return F.when(level == "sealed", "sealed").when(level.isin("high", "restricted"), "personal_sensitive").otherwise("personal")


def without_injections(text: Column, sentinel: str = "[BLOCKED]") -> Column:
    """The text with each injected instruction replaced."""
    for p in L.INJECTION_PATTERNS:
        text = F.regexp_replace(text, f"(?i){p}", sentinel)
    return text


def injection_hits(text: Column) -> Column:
    """The numbers of the patterns that match."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(L.INJECTION_PATTERNS))))


def claim_class(lowered: Column) -> Column:
    """Identity, interpretation, value, prediction or inference, by the first list that matches."""
    return F.coalesce(*(F.when(contains_any(lowered, phrases), name) for name, phrases in L.CLAIM_CLASSES.items()), F.lit("inference"))


def reasoning_errors(lowered: Column) -> Column:
    """Codes of the reasoning errors whose phrases stand in the text, in the order of the list."""
    return F.array_compact(F.array(*(F.when(contains_any(lowered, terms), code) for code, terms in L.REASONING_ERRORS.items())))


def clean_line(line: Column) -> Column:
    """A line without its bullet or number."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^[\-\*•]\s*", ""), r"^\d+\.\s*", ""))


def affect_bonus(lowered: Column) -> Column:
    """2 for the first affect term, 1 for each more, 4 at most."""
    n = count_present(lowered, L.AFFECT_TERMS)
    return F.when(n > 0, F.least(n + 1, F.lit(4))).otherwise(0)


def salience(lowered: Column) -> Column:
    """Score of the phrase banks."""
    score = affect_bonus(lowered)
    for terms, points in ((L.DECISION_PHRASES, 3), (L.OPEN_LOOP_PHRASES, 3), (L.CORRECTION_PHRASES, 4), (L.DURABLE_PLAN_PHRASES, 2)):
        score = score + F.when(contains_any(lowered, terms), points).otherwise(0)
    return F.when(F.contains(lowered, F.lit("/forget")), -100).when(F.contains(lowered, F.lit("/remember")), 10).when(F.length(lowered) <= 5, 0).otherwise(score)


def action(score: Column, skip: int = 3, light: int = 6) -> Column:
    return F.when(score < skip, "skip").when(score < light, "lightweight").otherwise("full")
