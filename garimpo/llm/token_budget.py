"""Problem 3: tokens under a byte-level pair-merge vocabulary, per record and summed by slice.

Texts are cut into pieces. Distinct pieces are stored as arrays of symbols, one after the other; in each round the
adjacent pairs of all arrays are joined with the merge ranks, every array applies its lowest-ranked merge, and finished
arrays leave, until no array has a merge left. The number of its symbols is then the piece's number of tokens. Tasks
remember the pieces that they have counted, so each is merged about once a task and no piece is shuffled.

Cases: a null or empty text has 0 tokens. Merges may be empty (one token a byte); merges whose parts no vocabulary or
other merge makes are never applied; of repeated merges the lowest rank counts. Empty tables give empty totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.llm.languages import record_languages
from garimpo.llm.words import canonical, effective_text, source_name
from garimpo.plans.materialize import materialize, spread

# Fixed value: how the existing tokenizer cuts a text.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

NONE = np.int64(1 << 40)


def byte_characters() -> list[str]:
    """The printable character for each byte: itself if visible Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts tokens of pieces; ``merges`` holds (rank, left token, right token)."""

    def __init__(self, merges: list[tuple[int, str, str]], limit: int = 1_000_000):
        number = {c: b for b, c in enumerate(byte_characters())}
        rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, left, right in sorted(m for m in merges if None not in m):
            for t in (left, right, left + right):
                number.setdefault(t, len(number))
            rules.setdefault((number[left], number[right]), (rank, number[left + right]))
        keys = sorted(rules)
        self.base = np.int64(len(number) + 1)
        self.keys = np.array([a * int(self.base) + b for a, b in keys], np.int64)
        self.ranks = np.array([rules[k][0] for k in keys], np.int64)
        self.made = np.array([rules[k][1] for k in keys], np.int64)
        self.cut = regex.compile(PIECES)
        self.known: dict[str, int] = {}
        self.limit = limit

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece: all pieces are merged at once, each by its own lowest rank."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        out = sizes.copy()
        sym = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(sym) > 1 and len(self.keys):
            pair = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            joined = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(joined, self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, NONE], first)
            spans = np.diff(np.r_[first, len(sym)])
            lowest = np.repeat(low, spans)
            hit = joined & (rank == lowest[:-1])
            if not hit.any():
                break
            # of overlapping equal pairs (aaa) every other one merges, from the left
            start = hit & ~np.r_[False, hit[:-1]]
            place = np.flatnonzero(hit)
            begin = np.maximum.accumulate(np.where(start, np.arange(len(hit)), -1))[place]
            place = place[(place - begin) % 2 == 0]
            sym[place] = self.made[at[place]]
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            live = stay & (lowest < NONE)  # arrays without a merge are finished
            out -= np.bincount(owner[place], minlength=len(out))
            sym, owner = sym[live], owner[live]
        return out

    def count(self, texts: list) -> list[int]:
        cut, known = self.cut.findall, self.known
        if len(known) > self.limit:
            known.clear()
        pieces = [cut(t) if t else [] for t in texts]
        new = list({p for ps in pieces for p in ps if p not in known})
        if new:
            known.update(zip(new, self.count_pieces(new).tolist()))
        return [sum([known[p] for p in ps]) for ps in pieces]


def merge_rules(merges: DataFrame, most: int = 2_000_000) -> list[tuple[int, str, str]]:
    """The merges on the driver. A vocabulary has a fixed size; more than ``most`` rules are refused."""
    got = merges.select("merge_rank", "left_token", "right_token").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} merges")
    return [tuple(r) for r in got]


def with_tokens(df: DataFrame, merges: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the text column replaced by its number of tokens."""
    rules = df.sparkSession.sparkContext.broadcast(merge_rules(merges))
    others = [c for c in df.columns if c != text]

    def count(batches):
        merger = Merger(rules.value)
        for b in batches:
            n = pa.array(merger.count(b.column(len(others)).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), n], [*others, out])

    schema = df.select(*others).withColumn(out, F.lit(0).cast("bigint")).schema
    return df.select(*others, text).mapInArrow(count, schema)


def language_label(df: DataFrame) -> Column:
    """``pt``, ``other`` or ``unknown`` from the flag ``is_pt``."""
    return F.when(F.col("is_pt"), "pt").when(~F.col("is_pt"), "other").otherwise("unknown")


def record_tokens(raw: DataFrame, merges: DataFrame) -> DataFrame:
    """(seq, source, language, n_tokens) of each record."""
    return with_tokens(spread(raw.select("seq", source_name(raw).alias("source"), language_label(raw).alias("language"), effective_text(raw).alias("text"))), merges)


def token_slices(raw: DataFrame, merges: DataFrame, targets: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """(source, language, subject, n_records, n_tokens) of every combination that occurs.

    Unlike in ``token_totals``, the language is the one that problem 2 finds in the text (``und`` where it finds none).
    A repeated ``seq`` has the language of one of its rows.
    """
    tokens = record_tokens(raw, merges).groupBy("seq", "source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    found = record_languages(raw, sample_rows).filter("line_no = 0").groupBy("seq").agg(F.min("lang").alias("language"))
    by = tokens.join(found, "seq").groupBy("source", "language").agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    subjects = targets.groupBy(canonical(F.col("source")).alias("source")).agg(F.min("subject").alias("subject"))
    return by.join(subjects, "source", "left").select("source", "language", F.coalesce("subject", F.lit("unknown")).alias("subject"), "n_records", "n_tokens")


def token_totals(raw: DataFrame, merges: DataFrame, targets: DataFrame) -> DataFrame:
    """(slice, name, n_records, n_tokens): totals by ``source``, ``language`` and ``subject``, and ``all``.

    A source that no target names has the subject ``unknown``.
    """
    by = record_tokens(raw, merges).groupBy("source", "language").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    subjects = targets.groupBy(canonical(F.col("source")).alias("source")).agg(F.min("subject").alias("subject"))
    by = materialize(by.join(subjects, "source", "left").withColumn("subject", F.coalesce("subject", F.lit("unknown"))), "totals")
    sums = (F.sum("n_records").cast("bigint").alias("n_records"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))
    parts = [by.groupBy(F.lit(c).alias("slice"), F.col(c).alias("name")).agg(*sums) for c in ("source", "language", "subject")]
    whole = by.groupBy(F.lit("all").alias("slice"), F.lit("all").alias("name")).agg(*sums)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(whole)
