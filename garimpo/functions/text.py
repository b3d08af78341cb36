"""Text functions as Spark columns; everything but HTML entities stays inside the JVM.

``\\w`` and white space are spelt out, as the regular-expression dialects disagree on them: word characters are
``[\\p{L}\\p{N}_]``, alphanumeric is ``[\\p{L}\\p{N}]``. Null texts count as empty.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: white space as in Unicode, with the separators U+001C to U+001F.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HSPACE = r"[\t\x0b\x0c\x1c-\x1f\x85 \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD_HSPACE = HSPACE.replace(" ", "")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"

# The Portuguese stopwords of the quality filters.
STOPWORDS_PT = """
o os um uma uns umas de do da dos das em no na nos nas num numa nuns numas ao aos à às pelo pela pelos pelas
por para com sem sob sobre entre até perante trás contra
que e ou mas porém contudo todavia portanto entretanto porque porquê pois como quando onde quanto se
eu tu ele ela nós vós eles elas você vocês meu minha meus minhas teu tua teus tuas seu sua seus suas
nosso nossa nossos nossas dele dela deles delas este esta estes estas isto esse essa esses essas isso
aquele aquela aqueles aquelas aquilo quem qual quais cujo cuja cujos cujas
não mais muito já também só mesmo ainda depois antes sempre nunca talvez assim bem menos tão
é são era eram foi foram ser seja sejam sendo sido tem têm tinha tinham teve ter tenha tenham tendo tido
está estão estava estavam esteve estar esteja estejam estando estado havia houve haver haja há
""".split()
# The shorter list of the older filters.
STOPWORDS_PT_SHORT = "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito nos já está".split()


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    Inside a lambda every mention of a column is its whole expression, evaluated anew for each element; a lambda
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_fallback(*cols: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*(empty_as_null(c) for c in cols), F.lit(""))


def source_fallback(*cols: Column) -> Column:
    """The first column that is not null, else ``unknown``."""
    return F.coalesce(*cols, F.lit("unknown"))


def canonical_source(c: Column) -> Column:
    """One spelling of a source name: trimmed, lower case, blanks and hyphens as underscores; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def resolve_is_pt(flag: Column, source: Column, pt_sources: list[str] | None = None) -> Column:
    """The flag if there is one, else membership in ``pt_sources``, else what the source's name says (true in doubt)."""
    s = F.lower(source)
    by_name = (
        F.when(s.rlike(r"^(pt_|pt-|por_)") | (s == "pt") | s.contains("_pt_") | s.rlike(r"(_pt|-pt)$"), True)
        .when(s.contains("en") | s.contains("code") | s.contains("math") | s.contains("python"), False)
        .otherwise(True)
    )
    if pt_sources:
        by_name = F.when(source.isin(pt_sources), True).otherwise(by_name)
    return F.coalesce(flag, by_name)


def whitespace_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS + "+"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Maximal runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize(c: Column) -> Column:
    """Lower case, single blanks."""
    return F.array_join(whitespace_words(F.lower(F.coalesce(c, F.lit("")))), " ")


def lines(c: Column) -> Column:
    """Stripped lower-case lines that are not blank."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), LINE_BREAK), strip), lambda x: x != "")


def n_grams(words: Column, n: int) -> Column:
    """All runs of ``n`` words; with fewer words, the words themselves."""
    return let(words, lambda w: F.when(F.size(w) < n, w).otherwise(runs(w, n)))


def runs(w: Column, n: int) -> Column:
    """All runs of ``n`` elements of a bound array, joined by blanks."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))


def char_shingles(normalized: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` characters; a shorter text is its own only one, an empty text has none."""

    def cut(t: Column) -> Column:
        got = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - k + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(k)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(got))

    return let(normalized, cut)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def unescape(c: Column) -> Column:
    """HTML entities decoded; only texts with an ampersand leave the JVM."""
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def drop_markup(c: Column) -> Column:
    """Without script and style blocks and comments; tags become blanks."""
    c = F.regexp_replace(c, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>", "")
    c = F.regexp_replace(c, r"<!--[\s\S]*?-->", "")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def tidy(c: Column) -> Column:
    """Without badges and images, horizontal space collapsed, lines stripped, at most one empty line in a row."""
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, r"\[!\[[^\n]*?\]\([^\n]*?\)\]\([^\n]*?\)", "")
    c = F.regexp_replace(c, r"!\[[^\n]*?\]\([^\n]*?\)", "")
    c = F.regexp_replace(c, LINE_BREAK, "\n")
    c = F.regexp_replace(c, f"{ODD_HSPACE}{HSPACE}*| {HSPACE}+", " ")  # single blanks stay as they are
    c = F.regexp_replace(c, " ?\n ?", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


def clean_boilerplate(c: Column) -> Column:
    """Markup, entities, badges and surplus white space removed, in that order."""
    return tidy(unescape(drop_markup(F.coalesce(c, F.lit("")))))


def keyword_score(response: Column, keys: Column) -> Column:
    """Hits of the keys over four tenths of their number, at most 1; long answers not starting with ``!`` get 0.4 at least."""
    hits = F.size(F.filter(keys, lambda k: F.contains(F.lower(response), F.lower(k))))
    score = F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), F.size(keys) * 0.4))
    return F.when((F.length(response) > 10) & ~F.startswith(response, F.lit("!")), F.greatest(score, F.lit(0.4))).otherwise(score)


def answer_match(output: Column, expected: Column) -> Column:
    """Whether any expected string stands in the output, whatever the case."""
    return F.exists(expected, lambda e: F.contains(F.lower(output), F.lower(strip(e))))


def chat_template(prompt: Column, response: Column, user: str = "<|user|>", assistant: str = "<|assistant|>", end: str = "<|endoftext|>") -> tuple[Column, Column]:
    """(prompt, response) in the tags of a chat."""
    return F.concat(F.lit(f"{user}\n"), prompt, F.lit(f"\n{assistant}\n")), F.concat(response, F.lit(f"\n{end}\n"))
