"""Quality predicates and the filter cascade with the first failing reason.

All predicates take columns and return columns; null texts count as empty. ``with_reason`` computes a text's words,
lines and n-grams once and lets ``CASE`` stop at the first failing test, cheapest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import LINE_BREAK, STOPWORDS_PT, STOPWORDS_PT_SHORT, WS, clean_boilerplate, let, lines, strip, whitespace_words, word_tokens

REASONS = ("length", "alpha_density", "line_repetition", "ngram_repetition", "pt_stopwords")


def long_enough(c: Column, min_chars: int = 150, min_words: int = 30) -> Column:
    return (F.length(c) >= min_chars) & (F.size(whitespace_words(c)) >= min_words)


def alpha_density(c: Column) -> Column:
    """Share of letters and numbers among all characters; null for an empty text."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.nullif(F.length(c), F.lit(0))


def repeated_line_share(c: Column) -> Column:
    """Share of the non-blank lines that stand more than once, every copy counted; 0 with fewer than two lines."""

    def share(x: Column) -> Column:
        # in order, a line stands once if it differs from both neighbours
        n = F.size(x)
        once = F.size(F.filter(x, lambda v, i: ((i == 0) | (F.get(x, i - 1) != v)) & ((i == n - 1) | (F.get(x, i + 1) != v))))
        return F.when(n <= 1, F.lit(0.0)).otherwise((n - once) / n)

    return let(F.array_sort(lines(c)), share)


def repeated_ngram_share(c: Column, n: int = 5) -> Column:
    """Share of the runs of ``n`` words that repeat an earlier one; 0 with fewer words. Runs are compared by 64-bit hashes."""
    if n <= 0:
        return F.lit(0.0)
    return let(word_tokens(c), lambda w: _repeated_runs(w, n))


def _repeated_runs(w: Column, n: int) -> Column:
    def distinct(h: Column) -> Column:
        # a run's hash is made of the hashes of its words, so that each word is hashed once
        return F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))))

    return F.when(F.size(w) < n, F.lit(0.0)).otherwise(1 - let(F.transform(w, lambda x: F.xxhash64(x)), distinct) / (F.size(w) - n + 1))


def stopword_count(c: Column, words: list[str] | None = None) -> Column:
    known = F.array(*(F.lit(w) for w in (words or STOPWORDS_PT)))
    return F.size(F.filter(word_tokens(c), lambda w: F.array_contains(known, w)))


def has_stopwords(w: Column, words: list[str], least: int) -> Column:
    """Whether at least ``least`` of the words ``w`` are among ``words``: mostly settled by how many different ones occur."""
    known = F.array(*(F.lit(v) for v in words))
    return let(w, lambda x: F.when(F.size(F.array_intersect(x, known)) >= least, True).otherwise(F.size(F.filter(x, lambda v: F.array_contains(known, v))) >= least))


def rejection_reason(c: Column, is_pt: Column, min_chars=150, min_words=30, min_alpha=0.7, max_lines=0.3, max_ngrams=0.2, n=5, min_stopwords=3) -> Column:
    """Name of the first test that the (cleaned) text fails, null if it passes all."""

    def first_failed(t: Column) -> Column:
        return (
            F.when(~long_enough(t, min_chars, min_words), "length")
            .when(F.coalesce(alpha_density(t), F.lit(0.0)) < min_alpha, "alpha_density")
            .when(repeated_line_share(t) > max_lines, "line_repetition")
            .when(repeated_ngram_share(t, n) > max_ngrams, "ngram_repetition")
            .when(is_pt & ~has_stopwords(word_tokens(t), STOPWORDS_PT, min_stopwords), "pt_stopwords")
        )

    return let(F.coalesce(c, F.lit("")), first_failed)


def with_reason(df: DataFrame, is_pt: Column, text: str = "text", clean: bool = True, **limits) -> DataFrame:
    """``df`` with its text cleaned and a column ``reason``; text and reason come out of one evaluation."""
    value = clean_boilerplate(F.col(text)) if clean else F.coalesce(F.col(text), F.lit(""))
    others = [c for c in df.columns if c != text]
    both = let(value, lambda t: F.struct(t.alias("t"), rejection_reason(t, is_pt, **limits).alias("r")))
    # a generator is a barrier: neither column copies the whole expression
    return df.select(*others, F.explode(F.array(both)).alias("_both")).select(*others, F.col("_both.t").alias(text), F.col("_both.r").alias("reason"))


def filter_document(df: DataFrame, is_pt: Column, text: str = "text", **limits) -> DataFrame:
    """The rows whose cleaned text passes all tests."""
    return with_reason(df, is_pt, text, **limits).filter("reason is null").drop("reason")


def keep(df: DataFrame, test: Column) -> DataFrame:
    """The rows that pass a costly test, which is made where the rows are: a plain filter would be moved below the spreading of
    a table with few splits, into as few tasks."""
    return df.withColumn("_passed", F.explode(F.array(test))).filter("_passed").drop("_passed")


def legacy_quality(c: Column, is_pt: Column, min_chars: int = 150, max_chars: int = 100_000) -> Column:
    """The older filter: length, flooded characters, repeated lines, words, symbols, and stopwords among the first 100 words."""
    def repeats(x: Column) -> Column:
        return (F.size(x) >= 6) & (F.size(F.array_distinct(x)) / F.size(x) < 0.6)

    def worded(s: Column, w: Column) -> Column:
        symbols = F.length(F.regexp_replace(s, rf"[\p{{L}}\p{{N}}]|{WS}", ""))
        plain = F.transform(F.slice(w, 1, 100), lambda v: F.regexp_replace(F.lower(v), r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""))
        return F.when(F.size(w) < 20, False).when(symbols / F.length(s) > 0.35, False).when(is_pt & ~has_stopwords(plain, STOPWORDS_PT_SHORT, 3), False).otherwise(True)

    def passes(s: Column) -> Column:
        x = F.filter(F.transform(F.split(s, LINE_BREAK), strip), lambda v: v != "")
        return (
            F.when((F.length(s) < min_chars) | (F.length(s) > max_chars), False)
            .when(s.rlike(r"([^\n])\1{8,}"), False)
            .when(let(x, repeats), False)  # lines and words are bound once
            .otherwise(let(whitespace_words(s), lambda w: worded(s, w)))
        )

    return let(strip(F.coalesce(c, F.lit(""))), passes)


def score_filter(score: Column, other: Column | None = None, least: float = 3.0) -> Column:
    """Whether the first score that is there reaches ``least``; missing and unreadable scores pass."""
    first = score if other is None else F.coalesce(score, other)
    return F.coalesce(first.try_cast("double") >= least, F.lit(True))
