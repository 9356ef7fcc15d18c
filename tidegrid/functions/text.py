"""Caption text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The common English stop words removed from word counts.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()


def hashtags(text: Column | str) -> Column:
    """Lower-cased tokens that start with ``#``, in order and with repeats; tokens split on single spaces."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.filter(F.split(c, " "), lambda t: t.startswith("#")), F.lower)


def caption_words(text: Column | str) -> Column:
    """Lower case, ``#`` as a space, split on single spaces: a tag counts as a word, newlines stay in words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.replace(F.lower(c), F.lit("#"), F.lit(" ")), " ")


def has_caption(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def stop_words(df: DataFrame) -> DataFrame:
    """The stop list as a one-column frame (a fixed, small table: safe to broadcast)."""
    return df.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "word string")
