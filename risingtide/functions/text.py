"""Tokenising and cleaning text with built-in expressions only.

Every function takes and returns columns, so the work stays in the JVM and in
one stage with the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# A term holding any of these fragments is not counted.
TERM_FRAGMENTS = (
    "www", "http", "https", "video", "youtube", "facebook",
    "new", "follow", "like", "watch", "subscribe", "channel",
)

NO_TAGS = "[None]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without(tokens: Column, stopwords: Iterable[str]) -> Column:
    words = sorted({w.lower() for w in stopwords})
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~F.lower(t).isin(words))


def remove_stopwords(tokens: Column | str, stopwords: Iterable[str]) -> Column:
    """Drop stop words, ignoring case; repeats of other words are kept."""
    return _without(_col(tokens), stopwords)


def lower_words(text: Column | str) -> Column:
    """Lower-cased words between white space; empty tokens dropped."""
    return F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda t: F.length(t) >= 1)


def spaced_tokens(text: Column | str) -> Column:
    """Lower-cased split at every white-space character.

    Empty tokens inside the text are kept, trailing ones are not.
    """
    lowered = F.lower(_col(text))
    body = F.regexp_replace(lowered, r"\s+$", "")
    blank = (F.length(body) == 0) & (F.length(lowered) > 0)
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, r"\s"))


def tag_tokens(tags: Column | str, separator: str = r"\|") -> Column:
    """Lower-cased tags; empty tags and the "no tags" mark are dropped."""
    parts = F.split(F.lower(_col(tags)), separator)
    return F.filter(parts, lambda t: (F.length(t) >= 1) & (t != NO_TAGS.lower()))


def tag_list(tags: Column | str, separator: str = r"\|") -> Column:
    """Tags trimmed with their case kept; no tags gives an empty array."""
    c = _col(tags)
    parts = F.transform(F.split(c, separator), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    none = c.isNull() | c.isin("", NO_TAGS)
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def letter_digit_runs(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; text edges may give an empty run."""
    return F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{N}]+")


def word_tokens(text: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """The runs of a text that pass ``word_term``; missing text gives an empty array."""
    return F.filter(letter_digit_runs(text), word_term(stopwords))


def alpha_term(
    stopwords: Iterable[str] = (), fragments: Iterable[str] = TERM_FRAGMENTS
) -> Callable[[Column], Column]:
    """Test for a term: purely alphabetic, no stop word, holding no fragment."""
    barred = "|".join(fragments)
    pattern = rf"^(?!.*(?:{barred}))\p{{L}}+$" if barred else r"^\p{L}+$"
    words = sorted({w.lower() for w in stopwords})

    def keep(term: Column) -> Column:
        fits = term.rlike(pattern)
        return fits & ~term.isin(words) if words else fits

    return keep


def word_term(stopwords: Iterable[str] = ()) -> Callable[[Column], Column]:
    """Test for a term: longer than one character and no stop word."""
    words = sorted({w.lower() for w in stopwords})

    def keep(term: Column) -> Column:
        fits = F.length(term) > 1
        return fits & ~term.isin(words) if words else fits

    return keep


def alpha_tokens(
    text: Column | str,
    stopwords: Iterable[str] = (),
    fragments: Iterable[str] = TERM_FRAGMENTS,
) -> Column:
    """The runs of a text that pass ``alpha_term``."""
    return F.filter(letter_digit_runs(text), alpha_term(stopwords, fragments))


def joined(tokens: Column | str, separator: str = " ") -> Column:
    return F.array_join(_col(tokens), separator)


def unescape_html(text: Column | str) -> Column:
    """Decode the five basic HTML entities; ``&amp;`` goes last."""
    c = _col(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def normalised_name(name: Column | str) -> Column:
    """Lower case without spaces, for joining names typed differently."""
    return F.lower(F.regexp_replace(_col(name), " ", ""))
