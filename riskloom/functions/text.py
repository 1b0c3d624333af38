"""Text, date and JSON columns. All are JVM-side expressions; null texts count as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import banded, rounded

#: White space as a class that Java and RE2 read alike.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}\x{85}]"
#: The same white space one by one.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = r"[^\x{4E00}-\x{9FFF}]+"
DATE_FORMATS = ("yyyy-M-d", "yyyy年M月d日", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m")


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; linear however much there is."""
    return F.btrim(text, F.lit(BLANKS))


def single_spaced(text: Column) -> Column:
    """Runs of white space as one space each; single spaces, which most are, aren't touched."""
    other = r"[\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}-\x{2029}\x{202F}\x{205F}\x{3000}]"
    return F.regexp_replace(text, f"{other}{SPACE}*| {SPACE}+", " ")


def without_tags(text: Column) -> Column:
    """The text without `<...>`. What stands behind the last `>` can't be in a tag and isn't searched, so open brackets cost nothing."""

    def cut(t: Column) -> Column:
        tail = F.substring_index(t, ">", -1)
        head = F.left(t, F.length(t) - F.length(tail))
        return F.when(F.contains(t, F.lit("<")) & F.contains(t, F.lit(">")), F.concat(F.regexp_replace(head, "<[^>]+>", ""), tail)).otherwise(t)

    return bound(text, cut)


def before_marks(text: Column, marks: list[str]) -> Column:
    """The text up to the first of the marks."""

    def cut(t: Column) -> Column:
        at = F.least(F.lit(None).cast("int"), F.lit(None).cast("int"), *[F.nullif(F.instr(t, m), F.lit(0)) for m in marks])
        return F.when(at.isNull(), t).otherwise(F.left(t, at - 1))

    return bound(text, cut) if marks else text


def clean_text(text: Column, marks: list[str] = params.NOISE_MARKS) -> Column:
    """Tags off, white space to single spaces, everything from a noise mark on cut, URLs off, trimmed."""
    t = before_marks(trimmed(single_spaced(without_tags(given(text)))), marks)
    return trimmed(bound(t, lambda x: F.when(F.contains(x, F.lit("http")), F.regexp_replace(x, r"https?://[^\s\x{3000}\x{A0}]+", "")).otherwise(x)))


def normalize_date(text: Column, as_of: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date by the first format that fits (day before month where both do), else as_of."""
    t = trimmed(given(text))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in formats], as_of)


def compact_date(text: Column, as_of: Column) -> Column:
    """The date of a stamp that begins yyyyMMdd, else as_of."""
    return F.coalesce(F.to_date(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd"))), as_of)


def script_language(text: Column, share: float = 0.3) -> Column:
    """'zh' for blank texts and those with over `share` CJK characters, else 'en'."""
    t = trimmed(given(text))
    n = F.length(t)
    return F.when((n == 0) | (F.length(F.regexp_replace(t, CJK, "")) > share * n), "zh").otherwise("en")


def any_cjk_language(text: Column) -> Column:
    """'zh' if any character is CJK, else 'en'."""
    return F.when(F.length(F.regexp_replace(given(text), CJK, "")) > 0, "zh").otherwise("en")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words as a substring."""
    return bound(F.lower(given(text)), lambda low: F.exists(F.lit([w.lower() for w in words]), lambda w: F.contains(low, w)))


def held_words(text: Column, words: list[str]) -> Column:
    """The words that the text holds as substrings, in the list's order."""
    return bound(given(text), lambda t: F.filter(F.lit(words), lambda w: F.contains(t, w)))


def event_words(text: Column, language: Column) -> Column:
    """Event words of the text's language."""
    return F.when(language == "zh", held_words(text, params.EVENT_WORDS_ZH)).otherwise(held_words(F.lower(given(text)), params.EVENT_WORDS_EN))


def lexicon_sentiment(text: Column, positive: list[str] = params.POSITIVE_WORDS, negative: list[str] = params.NEGATIVE_WORDS) -> Column:
    """Positive words over all sentiment words that occur, each counted once; 0.5 without any."""
    n = lambda low, words: F.size(F.filter(F.lit(words), lambda w: F.contains(low, w)))
    counts = bound(F.lower(given(text)), lambda low: F.struct(n(low, positive).alias("pos"), n(low, negative).alias("neg")))
    share = lambda c: F.when(c["pos"] + c["neg"] == 0, F.lit(0.5)).otherwise(rounded(c["pos"] / F.greatest(c["pos"] + c["neg"], F.lit(1)), 4))
    return bound(counts, share)


def compound_sentiment(compound: Column, text: Column | None = None) -> Column:
    """A score from -1..1 as 0..1; 0.5 where the score is null or the text blank."""
    score = rounded((compound + 1) / 2, 4)
    if text is not None:
        score = F.when(F.length(trimmed(given(text))) > 0, score)
    return F.coalesce(score, F.lit(0.5))


def risk_sentiment(score: Column, tone: Column | None = None, language: Column | None = None) -> Column:
    """struct<sentiment_score,risk_score,risk_level,source>: a tone's normalized score first, then the text's."""
    tone = F.lit(None).cast("double") if tone is None else tone
    language = F.lit("en") if language is None else language
    s = F.coalesce(tone, score)
    risk = rounded(1 - s, 4)
    source = F.when(tone.isNotNull(), "gdelt").when(language == "en", "fallback").otherwise("snownlp")
    return F.struct(s.alias("sentiment_score"), risk.alias("risk_score"), banded(risk, params.SENTIMENT_BANDS).alias("risk_level"), source.alias("source"))


def canonical_url(url: Column, base: str | None = None) -> Column:
    """The URL without closing slashes; relative ones after `base`."""
    u = F.regexp_replace(given(url), "/+$", "")
    return u if base is None else F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(base), u))


def json_object(text: Column) -> Column:
    """The first JSON object in a text as a string: the whole text without code fences, else the first {...} of one
    nesting level that parses; else an object with event_type 'parse failed' and the first 500 characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(given(text)), "^```(?:json)?", ""), "```$", ""))
    whole = F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    parts = F.filter(F.regexp_extract_all(t, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())
    failed = F.to_json(F.struct(F.lit("parse failed").alias("event_type"), F.substring(t, 1, 500).alias("raw")))
    return F.coalesce(whole, F.get(parts, F.lit(0)), failed)


def completeness(n_fields: Column) -> Column:
    """Confidence by filled fields: min(1, n / 4 * 0.8 + 0.2), 0 without any."""
    return F.when(n_fields > 0, rounded(F.least(F.lit(1.0), n_fields / 4 * 0.8 + 0.2), 4)).otherwise(F.lit(0.0))
