"""Byte-level pair-merge tokenizers from tables of tokens and merges: encoding, decoding, and the spelling of bytes.

Texts go through the ``tokenizers`` library in Arrow batches; the two tables (of a vocabulary's fixed size, refused above
``MOST`` rows) are sent to the tasks. Cases: null texts have no ids and stay null when decoded from no ids; ids that no
token has decode to nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2_000_000
# Fixed value: how the tokenizer cuts a text before merging.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def byte_alphabet() -> list[str]:
    """The printable character of each byte: visible Latin-1 stands for itself, the others for U+0100 and up in order."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
    hidden = [c for c in range(256) if c not in shown]
    return [chr(c) if c in shown else chr(256 + hidden.index(c)) for c in range(256)]


def _rows(df: DataFrame, *cols: str) -> list:
    got = df.select(*cols).limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} rows of a vocabulary")
    return [tuple(r) for r in got if None not in tuple(r)]


class Codec:
    """Encoder and decoder of a vocabulary; ``vocab`` holds (token, id), ``merges`` (rank, left, right)."""

    def __init__(self, vocab: list[tuple[str, int]], merges: list[tuple[int, str, str]]):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ids = dict(vocab)
        rules = [(a, b) for _, a, b in sorted(merges) if a in ids and b in ids and a + b in ids]
        self.tokenizer = Tokenizer(models.BPE(ids, rules))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PIECES), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.pieces = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab}

    def encode(self, texts: list) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces.get(i, b"") for i in ids).decode("utf-8", "replace")


def encode(df: DataFrame, vocab: DataFrame, merges: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by its token ids (array of bigint)."""
    sent = df.sparkSession.sparkContext.broadcast((_rows(vocab, "token", "id"), _rows(merges, "merge_rank", "left_token", "right_token")))
    others = [c for c in df.columns if c != text]

    def run(batches):
        codec = Codec(*sent.value)
        for b in batches:
            ids = codec.encode(b.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(ids, pa.list_(pa.int64()))], [*others, out])

    return df.select(*others, text).mapInArrow(run, df.select(*others).withColumn(out, F.array().cast("array<bigint>")).schema)


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the ids replaced by the text they spell."""
    sent = df.sparkSession.sparkContext.broadcast(_rows(vocab, "token", "id"))
    others = [c for c in df.columns if c != ids]

    def run(batches):
        codec = Codec(sent.value, [])
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(texts, pa.string())], [*others, out])

    return df.select(*others, ids).mapInArrow(run, df.select(*others).withColumn(out, F.lit("").cast("string")).schema)


def count_tokens(df: DataFrame, vocab: DataFrame, merges: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
    ids = encode(df, vocab, merges, text, "_ids")
    return ids.withColumn(out, F.size("_ids").cast("bigint")).drop("_ids")


def _is_byte(piece: Column) -> Column:
    return piece.rlike("^<0x[0-9A-Fa-f]{2}>$")


def _readable(raw: Column) -> Column:
    """Bytes as UTF-8 if they are, else each as the Latin-1 character."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def piece_text(piece: Column) -> Column:
    """What a piece such as ``<0xC3>`` or a plain token stands for."""
    return F.when(_is_byte(piece), _readable(F.unhex(F.substring(piece, 4, 2)))).otherwise(piece)


def merged_text(left: Column, right: Column) -> Column:
    """The token that a merge of two pieces makes; two bytes are read together."""
    both = _readable(F.unhex(F.concat(F.substring(left, 4, 2), F.substring(right, 4, 2))))
    return F.when(_is_byte(left) & _is_byte(right), both).otherwise(F.concat(piece_text(left), piece_text(right)))


def token_bytes(token: Column) -> Column:
    """The bytes, in hexadecimal, that a token of printable characters stands for."""
    code = lambda c: F.ascii(c)
    byte = lambda c: F.when(code(c) < 256, code(c)).when(code(c) <= 288, code(c) - 256).when(code(c) <= 322, code(c) - 162).otherwise(173)
    return F.array_join(F.transform(F.split(token, ""), lambda c: F.lpad(F.hex(byte(c)), 2, "0")), "")
