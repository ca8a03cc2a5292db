"""Tokenizing and cleaning of post bodies, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import NGram, StopWordsRemover, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.functions.stopwords import ENGLISH

# Fixed value: cash-tags and links.
TAGS_AND_LINKS = r"\$\S+|http\S+"
# Words keep inner apostrophes, hyphens, dots, slashes and the like; every other visible character is its own token.
WORDS = r"[\p{L}\p{N}]+(?:[-./_+*=~^|\\’'][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
# Those of them that are letters only, two or more: not next to a letter or digit, nor to a joiner that has one on its other side.
_INNER = r"[-./_+*=~^|\\’']"
LETTER_WORDS = rf"(?<![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{_INNER})\p{{L}}{{2,}}+(?![\p{{L}}\p{{N}}]|{_INNER}[\p{{L}}\p{{N}}])"
# Terms as the tf-idf vectorizer sees them: two or more word characters.
TERMS = r"[\p{L}\p{N}_]{2,}"


def strip_tags_and_links(body: str | Column) -> Column:
    return F.regexp_replace(_text(body), TAGS_AND_LINKS, "")


def word_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(WORDS), F.lit(0))


def term_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(TERMS), F.lit(0))


def alphanumeric_only(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, "[^A-Za-z0-9]+", ""))


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens that are not in ``words``; repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def words_refined(body: str | Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Tags and links removed, alphabetic tokens longer than one letter, lower case, no stop words."""
    letters = F.regexp_extract_all(strip_tags_and_links(body), F.lit(LETTER_WORDS), F.lit(0))
    lowered = F.split(F.lower(F.array_join(letters, " ")), " ")  # all words at once; none holds a blank
    return drop_words(lowered, ["", *stop_words])


def words_in_context(body: str | Column) -> Column:
    """Tags and links removed, lower case, apostrophes dropped, so that "don't" is the negator "dont"; all words stay,
    stop words too, as they may change the score of the next."""
    bare = F.transform(word_tokens(strip_tags_and_links(body)), lambda t: F.regexp_replace(F.lower(t), "['’]", ""))
    return F.filter(bare, lambda t: t.rlike(r"^\p{L}+$"))


def words_stripped(body: str | Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Every token reduced to its ASCII letters and digits, longer than one, lower case, not numeric, no stop words."""
    tokens = alphanumeric_only(word_tokens(body))
    kept = F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))
    return drop_words(F.transform(kept, F.lower), stop_words)


def without_digits(tokens: str | Column) -> Column:
    """Last step after ``words_stripped`` and the lemmas: drop tokens with a digit in them."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(tokens, lambda t: ~t.rlike("[0-9]"))


def join_tokens(tokens: str | Column) -> Column:
    return F.concat_ws(" ", tokens)


def distinct_terms(text: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(_text(text), " ")))


def bag_of_words(df: DataFrame, body: str = "body", out: str = "bow", n: int = 1) -> DataFrame:
    """White-space tokens in lower case, stop words removed, n-grams, joined by blanks.

    A missing body counts as empty text.
    """
    stages = Pipeline(stages=[
        Tokenizer(inputCol="_body", outputCol="_tokens"),
        StopWordsRemover(inputCol="_tokens", outputCol="_kept", stopWords=ENGLISH, locale="en_US"),
        NGram(n=n, inputCol="_kept", outputCol="_ngrams"),
    ])
    prepared = df.withColumn("_body", _text(body))
    grams = stages.fit(prepared).transform(prepared)
    return grams.withColumn(out, join_tokens("_ngrams")).drop("_body", "_tokens", "_kept", "_ngrams")


def _text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
