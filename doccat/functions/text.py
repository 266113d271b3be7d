"""Text analysis as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 3


def split_ws(text: Column) -> Column:
    """Lower-cased whitespace tokens."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def split_punct(text: Column) -> Column:
    """ASCII punctuation becomes a token boundary."""
    return F.regexp_replace(text, r"[\p{Punct}]", " ")


def split_digits(text: Column) -> Column:
    """ASCII digits become a token boundary."""
    return F.regexp_replace(text, r"[0-9]", " ")


def drop_stopwords(tokens: Column, stops: Iterable[str]) -> Column:
    """Tokens outside ``stops``. A long literal list is planned as a hash set."""
    words = list(stops)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def min_length(tokens: Column, least: int = MIN_LENGTH) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= least)


def raw_tokens(text: Column) -> Column:
    """Tokens before stopwords and length: both boundary rules in one pass over the text."""
    return F.split(F.regexp_replace(F.lower(text), r"[\p{Punct}0-9]", " "), r"\s+")


def keeps(token: Column, stops: Iterable[str]) -> Column:
    """The stopword and length rules as one predicate, for the exploded form."""
    words = list(stops)
    long_enough = F.length(token) >= MIN_LENGTH
    return long_enough & ~token.isin(words) if words else long_enough


def analyze(text: Column, stops: Iterable[str]) -> Column:
    """Text to its list of terms: lower-case, split, drop stopwords and short tokens."""
    words = list(stops)
    return F.filter(raw_tokens(text), lambda t: keeps(t, words))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams as ``struct(head, tail)``: all words but the last, and the last."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda i: F.struct(
            F.array_join(F.slice(tokens, i, n - 1), " ").alias("head"),
            F.get(tokens, i + (n - 2)).alias("tail"),
        ),
    )


def class_label(name: Column) -> Column:
    """Readable class name: every ``A.`` goes, underscores become spaces."""
    return F.replace(F.replace(name, F.lit("A."), F.lit("")), F.lit("_"), F.lit(" "))


def title_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit("\n"), abstract)


def text_name(name: Column) -> Column:
    """``x.xml`` to ``x.txt``."""
    return F.regexp_replace(name, r"\.xml$", ".txt")


def record_name(name: Column) -> Column:
    """``/x.txt`` back to ``x.xml``."""
    return F.regexp_replace(F.regexp_replace(name, r"^/", ""), r"\.txt$", ".xml")


def safe_key(value: Column) -> Column:
    """A value that can serve as a file or partition name."""
    return F.replace(value, F.lit("/"), F.lit(""))


def round2(value: Column) -> Column:
    """Display rounding: half-even, two decimals, whatever the locale."""
    return F.bround(value, 2)


def show2(value: Column) -> Column:
    """Rounded value as text with no trailing ``.0``."""
    return F.regexp_replace(round2(value).cast("string"), r"\.0$", "")


def entity_text(
    title: Column, cls: Column, partner: Column, service: Column,
    themes: Column, abstract: Column, attributes: Column,
) -> Column:
    """All fields of a record as lines."""
    lines = F.concat(
        F.array(title, cls, partner, service),
        themes,
        F.array(abstract),
        F.transform(attributes, lambda a: F.concat(a["label"], F.lit(": "), a["description"])),
    )
    return F.array_join(lines, "\n")
