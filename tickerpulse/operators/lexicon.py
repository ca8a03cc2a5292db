"""Lemmas and sentiment from dictionary tables.

A dictionary is an input table. The texts' tokens are exploded and inner-joined with it. Where Spark knows that the dictionary
is small (a file, a local table), it is the side that is copied and only the hits are shuffled; a dictionary too large for
that is joined by shuffling both. Hits are gathered per key and token list: two texts under one key stay apart, a NULL
key is a key, and a row that stands twice counts its hits once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published lexicon method.
NORMALISER = 15.0
NEGATION_FACTOR = -0.74
BOOST = 0.293
BOOST_DECAY = (1.0, 0.95, 0.9)
NEGATORS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt "
    "neither never none nope nor not nothing nowhere oughtnt shant shouldnt wasnt werent without wont "
    "wouldnt rarely seldom despite uhuh"
).split()
BOOSTERS_UP = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially "
    "exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably "
    "unusually utterly very"
).split()
BOOSTERS_DOWN = "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat".split()


def compound(total: Column) -> Column:
    """Sum of valences squeezed into [−1, 1], four places; 0 when nothing was found."""
    total = F.coalesce(total, F.lit(0.0))
    # Adding zero turns −0.0 into 0.0.
    return F.round(total / F.sqrt(total * total + NORMALISER), 4) + F.lit(0.0)


def dictionary(lemmas: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Both tables in one, (form, lemma, valence): a form counts with the valence of its lemma."""
    if lexicon is None:
        return lemmas.select("form", "lemma", F.lit(None).cast("double").alias("valence"))
    if lemmas is None:
        return lexicon.select(F.col("token").alias("form"), F.lit(None).cast("string").alias("lemma"), "valence")
    through_lemma = lemmas.join(lexicon, lemmas["lemma"] == lexicon["token"], "left").select("form", "lemma", "valence")
    direct = lexicon.join(lemmas, lexicon["token"] == lemmas["form"], "left_anti").select(
        F.col("token").alias("form"), F.lit(None).cast("string").alias("lemma"), "valence"
    )
    return through_lemma.unionByName(direct)


def lookup(df: DataFrame, key: str, tokens: str | Column, entries: DataFrame, source: str | None = None) -> DataFrame:
    """One row per text with a hit: the lemmas of its forms (a map) and the sum of its valences.

    A text is told by ``key`` and ``_tokens_hash``, a hash of its tokens or of the ``source`` they are made from.
    Its hits are at most its tokens.
    """
    exploded = _hashed(df, key, tokens, source).select(key, "_tokens_hash", F.posexplode_outer("_tokens").alias("pos", "form"))
    hits = exploded.join(entries, "form").groupBy(key, "_tokens_hash").agg(
        F.array_sort(F.collect_set(F.struct("pos", "form", "lemma", "valence"))).alias("_hits")
    )
    total = F.aggregate("_hits", F.lit(None).cast("double"), lambda acc, h: F.coalesce(acc + h["valence"], acc, h["valence"]))
    known = F.transform(F.filter("_hits", lambda h: h["lemma"].isNotNull()), lambda h: F.struct(h["form"], h["lemma"]))
    return hits.select(key, "_tokens_hash", total.alias("valence_sum"), F.map_from_entries(F.array_distinct(known)).alias("lemma_of"))


def _hashed(df: DataFrame, key: str, tokens: str | Column, source: str | None = None) -> DataFrame:
    """Key, tokens and their hash, computed once per text: in one select with an explode, the hash would be computed above it, for
    every token anew. The outer form of the explode keeps Spark from testing the tokens before it explodes them."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(key, F.xxhash64(tokens if source is None else source).alias("_tokens_hash"), tokens.alias("_tokens"))


def with_found(df: DataFrame, key: str, tokens: str | Column, found: DataFrame) -> DataFrame:
    """``df`` with what was found for each row's own tokens (or the source they were told by)."""
    same = [F.col(key).eqNullSafe(F.col("_found_key")), F.xxhash64(tokens) == F.col("_tokens_hash")]
    return df.join(found.withColumnRenamed(key, "_found_key"), same, "left").drop("_found_key", "_tokens_hash")


def lemmatize(df: DataFrame, key: str, tokens: str, lemmas: DataFrame, out: str = "lemmatized_tokens") -> DataFrame:
    """Each token replaced by its lemma where the table has one; order and repeats stay."""
    found = lookup(df, key, tokens, dictionary(lemmas=lemmas)).drop("valence_sum")
    return _apply_lemmas(with_found(df, key, tokens, found), tokens, out).drop("lemma_of")


def score_tokens(
    df: DataFrame, key: str, tokens: str | Column, lexicon: DataFrame, out: str = "score_vader", source: str | None = None,
) -> DataFrame:
    """Compound score of each text; no hit or no text gives 0."""
    found = lookup(df, key, tokens, dictionary(lexicon=lexicon), source).drop("lemma_of")
    return with_found(df, key, tokens if source is None else source, found).withColumn(out, compound(F.col("valence_sum"))).drop("valence_sum")


def lemmatize_and_score(
    df: DataFrame, key: str, tokens: str | Column, lemmas: DataFrame, lexicon: DataFrame,
    out: str = "lemmatized_tokens", score: str = "score_vader", source: str | None = None,
) -> DataFrame:
    """Both at once: one pass over the tokens, one shuffle of the hits, one join.

    With a ``source`` column that the tokens are made from, they do not travel to the join: it is made on the source,
    and the tokens are made again behind it, if anyone reads them.
    """
    found = lookup(df, key, tokens, dictionary(lemmas, lexicon), source)
    joined = with_found(df, key, tokens if source is None else source, found).withColumn(score, compound(F.col("valence_sum")))
    lemmatized = _apply_lemmas(joined.withColumn("_tokens", F.col(tokens) if isinstance(tokens, str) else tokens), "_tokens", out)
    return lemmatized.drop("_tokens", "lemma_of", "valence_sum")


def valences_of(df: DataFrame, key: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """One row per text with a hit: ``_valences``, a map of its distinct tokens that the lexicon has."""
    distinct = _hashed(df, key, tokens).withColumn("_tokens", F.array_distinct("_tokens"))
    exploded = distinct.select(key, "_tokens_hash", F.explode_outer("_tokens").alias("token"))
    return exploded.join(lexicon, "token").groupBy(key, "_tokens_hash").agg(
        F.map_from_entries(F.collect_set(F.struct("token", "valence"))).alias("_valences")
    )


def score_with_context(
    df: DataFrame, key: str, tokens: str, lexicon: DataFrame, out: str = "score_vader",
    negators: Sequence[str] = NEGATORS, up: Sequence[str] = BOOSTERS_UP, down: Sequence[str] = BOOSTERS_DOWN,
) -> DataFrame:
    """Compound score in which the three tokens before a hit may strengthen, weaken or negate it."""
    valences = valences_of(df, key, tokens, lexicon)
    words, known = F.col(tokens), F.col("_valences")

    def in_context(token: Column, i: Column) -> Column:
        value = known[token]
        adjusted = value
        for back, decay in enumerate(BOOST_DECAY, start=1):
            before = F.when(i >= back, F.get(words, i - back))
            step = F.when(before.isin(*up), BOOST).when(before.isin(*down), -BOOST).otherwise(0.0) * decay
            factor = F.when(before.isin(*negators), NEGATION_FACTOR).otherwise(1.0)
            # A neighbour that carries a valence of its own changes nothing.
            neutral = known[before].isNull()
            adjusted = F.when(neutral, (adjusted + F.signum(value) * step) * factor).otherwise(adjusted)
        # Few words are hits; the others are not looked at further.
        return F.when(value.isNull(), F.lit(0.0)).otherwise(F.coalesce(adjusted, F.lit(0.0)))

    total = F.aggregate(F.transform(words, in_context), F.lit(0.0), lambda acc, v: acc + v)
    scored = with_found(df, key, tokens, valences)
    return scored.withColumn(out, compound(F.when(known.isNotNull(), total))).drop("_valences")


def _apply_lemmas(df: DataFrame, tokens: str, out: str) -> DataFrame:
    known = F.col("lemma_of")
    replaced = F.transform(tokens, lambda t: F.coalesce(known[t], t))
    return df.withColumn(out, F.when(known.isNull(), F.col(tokens)).otherwise(replaced))
