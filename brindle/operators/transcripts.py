"""Transcript cleaning over segments (array<struct<id, start, end, no_speech, text, words>>) with their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_LEAST, CONFIDENCE_LEAST, WORDS_LEAST, NO_SPEECH_MOST = 0.40, 0.45, 3, 0.6
# What a recogniser writes for silence.
SILENCE_PHRASES = (
    "thank you", "thanks for watching", "thanks for listening",
    "please subscribe", "subscribe", "like and subscribe",
    "you're welcome", "you are welcome", "welcome back",
    "see you next time", "see you later", "bye", "goodbye",
    "good morning", "good evening", "good afternoon", "good night",
    "hello", "hi there", "hey there", "what's up",
    "uh", "um", "hmm", "hm", "ah", "oh",
    ".", "..", "...", "[music]", "[applause]", "[laughter]",
    "[noise]", "[silence]", "[inaudible]", "[blank_audio]",
)


def keep_word(word: Column, prob: Column, strict: bool = True) -> Column:
    """A word with something in it and, in strict cleaning, a probability of 0.40 or more."""
    there = F.trim(F.coalesce(word, F.lit(""))) != ""
    return there & (F.coalesce(prob, F.lit(0.0)) >= WORD_LEAST) if strict else there


def has_speech(text: Column) -> Column:
    """The text has more than punctuation and space."""
    return F.coalesce(text, F.lit("")).rlike(r"[^ \t\n.,\-!?;:]")


def is_silence_phrase(text: Column) -> Column:
    """True if the whole text is one that recognisers make up for silence."""
    low = F.lower(F.trim(text))
    return low.isin(*SILENCE_PHRASES) | F.regexp_replace(low, "[.,!?]+$", "").isin(*SILENCE_PHRASES)


def clean_segments(segments: Column, strict: bool = True) -> Column:
    """Segments with speech and at least one kept word, with only the kept words."""
    kept = lambda ws: F.filter(ws, lambda w: keep_word(w["word"], w["prob"], strict))
    bare = F.transform(segments, lambda s: s.withField("words", kept(s["words"])))
    quiet = lambda s: s["no_speech"] <= NO_SPEECH_MOST if strict else F.lit(True)
    return F.filter(bare, lambda s: quiet(s) & has_speech(s["text"]) & (F.size(s["words"]) > 0))


def joined_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(segments), lambda s: F.trim(s["text"])), " ")


def transcripts(rows: DataFrame, segments: str = "segments", strict: bool = True) -> DataFrame:
    """Add text, confidence (mean kept probability, four decimals), n_words and silent.

    A strict transcript is silent, with an empty text, if it has no segment, fewer than three words, a confidence under
    0.45 or only a made-up phrase.
    """
    out = rows.withColumn("clean", clean_segments(F.col(segments), strict))
    words = F.flatten(F.transform("clean", lambda s: s["words"]))
    out = out.withColumn("words", words).withColumn("n_words", F.size("words").cast("long"))
    mean = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["prob"]) / F.col("n_words")
    out = out.withColumn("confidence", F.when(F.col("n_words") > 0, F.round(mean, 4)).otherwise(F.lit(0.0)))
    text = joined_text(F.col("clean"))
    bad = (F.col("confidence") < CONFIDENCE_LEAST) | (F.col("n_words") < WORDS_LEAST) | is_silence_phrase(text)
    silent = (F.size("clean") == 0) | (bad if strict else F.lit(False))
    out = out.withColumn("silent", silent).withColumn("text", F.when(silent, "").otherwise(text))
    return out.drop("clean", "words")
