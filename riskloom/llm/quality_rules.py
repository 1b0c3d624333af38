"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the text, so all rules are one narrow projection without
user functions, shuffles or joins. Null and empty texts have no words and fail the word rule; texts of any
length are read whole, in steps about linear in their length but for sorting; repeated rows are judged row by
row, and nothing is ranked, so there are no ties. Extra columns of the input pass through untouched, but for
those named like a measure of apply_rules(), which it replaces; keep_good() keeps every column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BLANKS

#: Frequent function words of the corpus' languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "was", "on", "as", "by", "this", "are", "be", "from", "at", "or", "an", "a"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "pour", "dans", "par", "sur", "pas", "au", "aux", "avec", "en"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "no", "se", "su", "para", "es", "al", "lo", "del"],
}
SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` is below `least` or above `most`, once it has `from_words` words."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Ratios are per word, or per line with a word.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_windows", "repeat_word_ratio", most=0.2),
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("shouting", "shout_ratio", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.02, from_words=60),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)


def measured(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df and the counts and ratios that the rules read. `prefix` keeps clear of clashing column names."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    p = prefix
    df = df.withColumn(f"{p}words", F.filter(F.split(t, BLANKS), lambda w: w != ""))
    words = F.col(f"{p}words")
    n = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda s: F.translate(s, BREAKS, "") != "")
    stop_hits = F.size(F.filter(words, lambda w: w.isin(stop)))
    df = df.select(
        "*",
        n.cast("long").alias(f"{p}n_words"),
        F.length(F.translate(t, BREAKS, "")).cast("long").alias(f"{p}word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias(f"{p}n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias(f"{p}n_shouts"),
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        stop_hits.cast("long").alias(f"{p}n_stop_words"),
        repeated_words(words).alias(f"{p}n_repeat_words"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"{p}{a}").cast("double"), F.col(f"{p}{b}")), F.lit(0.0))
    return df.select(
        "*",
        share("word_chars", "n_words").alias(f"{p}mean_word_chars"),
        share("n_symbols", "n_words").alias(f"{p}symbol_ratio"),
        share("n_shouts", "n_words").alias(f"{p}shout_ratio"),
        share("n_stop_words", "n_words").alias(f"{p}stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias(f"{p}dup_line_ratio"),
        share("n_repeat_words", "n_words").alias(f"{p}repeat_word_ratio"),
    ).drop(f"{p}words")


def repeated_words(words: Column, width: int = 5) -> Column:
    """long: the words inside windows of `width` words that the text holds at least twice."""
    n = F.size(words)
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def count(h: Column) -> Column:
        windows = F.transform(at, lambda i: F.xxhash64(*[h[i + j] for j in range(width)]))

        def covered(keys: Column) -> Column:
            pairs = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def from_sorted(s: Column) -> Column:
                last = F.size(s) - 1
                twin = lambda x, j: (F.when(j > 0, s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]).otherwise(F.lit(False)) | F.when(j < last, s[F.least(j + 1, last)]["h"] == x["h"]).otherwise(F.lit(False)))
                starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
                zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
                step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(width))).alias("n"))
                return F.aggregate(starts, zero, step, lambda a: a["n"].cast("long"))

            return bound(pairs, from_sorted)

        return bound(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))

    return bound(hashes, count)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def verdict(prefix: str = "", rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string>: the names of the rules that a measured row fails."""
    checks = []
    for r in rules:
        x = F.col(f"{prefix}{r.measure}")
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (x < r.least)
        if r.most is not None:
            bad = bad | (x > r.most)
        checks.append(F.when(bad & (F.col(f"{prefix}n_words") >= r.from_words), F.lit(r.name)))
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every measure as q_<measure> and q_failed, the names of the rules that the row fails."""
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(text).alias("__text"))
    out = measured(row, "__text", "q_").withColumn("q_failed", verdict("q_", rules))
    new = [c for c in out.columns if c.startswith("q_")]
    return out.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in new], *new)


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that fail no rule, with df's columns."""
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(text).alias("__text"))
    return measured(row, "__text", "q_").filter(F.size(verdict("q_", rules)) == 0).select(*[F.col("__row")[c].alias(c) for c in df.columns])


def op9(docs: DataFrame) -> DataFrame:
    """The digest of each document: base counts, base verdict and the verdict of the whole table."""
    q = apply_rules(docs.select("doc_id", "text"))
    base = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    return q.select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (F.size("q_failed") == 0)).alias("kept"),
    )
