"""Made-up records of four kinds, for trying the pipeline out without data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By kind: parts of a sentence, one list for each place in it.
PHRASES = {
    "pt_web": (("O mercado", "A feira", "O bairro", "A rádio", "A praça"), ("abriu cedo", "mudou de lugar", "ficou cheio de gente", "recebeu uma reforma"), ("na segunda-feira", "depois da chuva", "por causa da festa")),
    "pt_hq": (("A enciclopédia", "O tratado", "A carta", "O mapa"), ("descreve com cuidado", "resume em poucas páginas", "compara com outros"), ("os rios do interior", "as leis da época", "os nomes das ilhas", "a história da cidade", "o clima do litoral")),
    "en_edu": (("The lesson", "The exercise", "The teacher", "The chapter"), ("explains step by step", "repeats with examples", "leaves to the reader"), ("how plants grow", "why the tide turns", "what a fraction is")),
}
CODE = (("total", "count", "width"), ("items", "rows", "values", "pages"), ("+", "-", "*"))


def _pick(words: tuple, step: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(step, F.lit(len(words))) + 1).cast("int"))


def sentence(kind: str, number: Column) -> Column:
    """Sentence ``number`` of a kind: its parts run through their lists at different paces."""
    a, b, c = PHRASES[kind]
    return F.concat(_pick(a, number), F.lit(" "), _pick(b, F.floor(number / 2)), F.lit(" "), _pick(c, F.floor(number / 3)), F.lit("."))


def code(number: Column) -> Column:
    name, over, sign = (_pick(words, F.floor(number / k)) for words, k in zip(CODE, (1, 2, 3)))
    return F.concat(F.lit("def f"), number, F.lit("("), over, F.lit("):\n    "), name, F.lit(" = 0\n    for x in "), over, F.lit(":\n        "), name, F.lit(" = "), name, F.lit(" "), sign, F.lit(" x\n    return "), name, F.lit("\n"))


def mock_records(spark: SparkSession, n: int, sentences: int = 12) -> DataFrame:
    """(seq, text, content, _source): ``n`` records of each kind; code stands under ``content``, the rest under ``text``."""
    out = None
    for k, kind in enumerate([*PHRASES, "code"]):
        i = F.col("id")
        many = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(sentences - 1).cast("bigint")), lambda j: code(i * sentences + j) if kind == "code" else sentence(kind, i * 7 + j))
        whole = F.array_join(many, "\n" if kind == "code" else " ")
        none = F.lit(None).cast("string")
        d = spark.range(n).select((i * 4 + k).alias("seq"), (none if kind == "code" else whole).alias("text"), (whole if kind == "code" else none).alias("content"), F.lit(kind).alias("_source"))
        out = d if out is None else out.unionByName(d)
    return out
