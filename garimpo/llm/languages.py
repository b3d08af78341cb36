"""Problem 2: language of each record and of each line, with a confidence.

A word is the mean of the embeddings of its hashed subwords (character n-grams and the whole word), a text the mean of
its words, and a linear softmax on top gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample of lines (``sample_rows`` records, chosen by hash) that
their function words label beyond doubt. A held-out tenth of those lines calibrates the softmax by a temperature, and sets the confidence below which a
text is rejected (language ``und``). As short texts are less certain than long ones, that is done for each class of
lengths (1, 2-3, 4-7, ... words), for lines and for records of several lines: the threshold is the lowest confidence of a
held-out text of that length or shorter at which at most ``max_error`` of the accepted ones are wrong. Nothing less certain than
what was held out is accepted.

As both layers are linear, a word's scores can be remembered; every word of every text counts. A line's words are
scored with their neighbours, and the line has the language of most of its words.

Cases: null, empty and wordless texts have the language ``und`` and confidence 0. Without any labelled line (such as an
empty table) everything is ``und``. Lines end at a newline; blank lines have no number.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.languages_data import FUNCTION_WORDS, LANGUAGES, fold
from garimpo.llm.structure import KINDS, class_table, measure
from garimpo.llm.words import Words, chunks, effective_text, has, words_of
from garimpo.plans.materialize import spread

BUCKETS = 1 << 15
DIM = 16
NEAR = 3  # words on either side that a word is scored with
LENGTHS = 7  # classes of lengths: powers of two, the last one open
VOWELS = frozenset("aeioyàáéèêíóôú")


def subwords(word: str) -> list[int]:
    """Buckets of the word's character n-grams (2 to 4, with edges) and of the word itself."""
    w = f"<{word}>"
    crc = zlib.crc32
    grams = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [crc(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


@dataclass
class Model:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: np.ndarray  # thresholds of lines and of records, by class of lengths
    held_out: np.ndarray  # share of right answers among the held-out texts, likewise

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word; a text's scores are the mean over its words."""
        if not words:
            return np.zeros((0, len(LANGUAGES)))
        grams = [subwords(w) for w in words]
        n = np.array([len(g) for g in grams])
        sums = np.add.reduceat(self.embedding[np.concatenate(grams)], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        return (sums / n[:, None]) @ self.weights + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled_lines(texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """Lines of at least 8 words of which the function words of one language, and of no other, make up a good part."""
    weight: dict[str, np.ndarray] = {}
    for n, lang in enumerate(LANGUAGES):
        for rank, w in enumerate(FUNCTION_WORDS[lang].split()):
            for form in {w, fold(w)}:
                weight.setdefault(form, np.full(len(LANGUAGES), np.log(2e-4)))[n] = np.log(0.12 / (rank + 3))
    lines, labels = [], []
    for t in texts:
        for x in t.split("\n"):
            w = words_of(x)
            if len(w) < 8:
                continue
            known = [weight[v] for v in w if v in weight]
            if len(known) < 3 or len(known) < 0.2 * len(w):
                continue
            s = np.sum(known, axis=0)
            order = np.argsort(s)
            if s[order[-1]] - s[order[-2]] > 6:
                lines.append([v for v in w if not v.isdigit()])
                labels.append(order[-1])
    return lines, np.array(labels, np.int64)


def train(texts: list[str], epochs: int = 6, rate: float = 1.0, batch: int = 128, max_error: float = 0.01, seed: int = 7, max_lines: int = 12_000, most_balance: float = 2.0) -> Model | None:
    """Fit the model on the labelled lines of ``texts``; None if there is none. At most ``max_lines`` lines are used."""
    lines, y = labelled_lines(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(lines))[:max_lines]
    lines, y = [lines[i] for i in order if lines[i]], np.array([y[i] for i in order if lines[i]], np.int64)
    if not len(lines):
        return None
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in x]) for x in lines]
    grams = [np.array(subwords(w)) for w in vocab]
    n_grams = np.array([len(g) for g in grams])
    starts = np.r_[0, np.cumsum(n_grams)[:-1]]
    flat = np.concatenate(grams)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    wts, bias = rng.normal(0, 0.1, (DIM, len(LANGUAGES))).astype(np.float32), np.zeros(len(LANGUAGES), np.float32)
    held = max(1, len(lines) // 10) if len(lines) > 20 else 0
    share = np.bincount(y[held:], minlength=len(LANGUAGES)) / max(1, len(y) - held)
    balance = np.where(share > 0, np.minimum(most_balance, 0.25 / np.maximum(share, 1e-9)), 0).astype(np.float32)

    def gathered(take):
        words = np.concatenate([ids[i] for i in take])
        owner = np.repeat(np.arange(len(take)), [len(ids[i]) for i in take])
        n = n_grams[words]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = flat[np.repeat(starts[words], n) + inner]
        # each gram's share in the text's vector
        part = (1 / (np.repeat(n, n) * np.repeat(np.bincount(owner)[owner], n))).astype(np.float32)
        return g, np.repeat(owner, n), part

    def vectors(take):
        g, owner, part = gathered(take)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.add.reduceat(emb[g] * part[:, None], first, axis=0), g, owner, part

    steps = epochs * ((len(lines) - held + batch - 1) // batch)
    done = 0
    for _ in range(epochs):
        shuffled = held + rng.permutation(len(lines) - held)
        for i in range(0, len(shuffled), batch):
            take = shuffled[i : i + batch]
            lr = rate * (1 - done / steps)
            done += 1
            v, g, owner, part = vectors(take)
            p = softmax(v @ wts + bias)
            p[np.arange(len(take)), y[take]] -= 1
            p *= balance[y[take]][:, None]
            dv = p @ wts.T
            wts -= lr * (v.T @ p) / len(take) * 4
            bias -= lr * p.mean(axis=0)
            np.add.at(emb, g, (-lr * 8) * (dv[owner] * part[:, None]).astype(np.float32))
    model = Model(emb.astype(np.float64), wts.astype(np.float64), bias.astype(np.float64), 1.0, np.ones((2, LENGTHS)), np.zeros((2, LENGTHS)))
    if held:
        held_words = list(vocab)
        fragments = [f for i in range(held) if len(f := ids[i][(at := int(rng.integers(0, len(ids[i])))) : at + int(rng.integers(1, 9))])]
        ids, y_short = [*fragments, *ids[:held]], np.r_[y[:held], y[:held]]
        v, *_ = vectors(np.arange(len(fragments)))
        z = v @ wts + bias
        model.temperature = min((float(-np.log(np.maximum(softmax(z / t)[np.arange(held), y_short[:held]], 1e-12)).mean()), t) for t in np.geomspace(0.1, 10, 41))[1]
        lines = [[held_words[k] for k in x] for x in ids[len(fragments) :]]
        calibrate(model, lines, y[:held], max_error, rng)
    return model


def length_class(words: np.ndarray) -> np.ndarray:
    """0 for a single word, then one class more with each doubling."""
    return np.clip(np.floor(np.log2(np.maximum(words, 1))).astype(np.int64), 0, LENGTHS - 1)


def calibrate(model: Model, lines: list[list[str]], y: np.ndarray, max_error: float, rng: np.random.Generator, texts: int = 600) -> None:
    """Set the thresholds from texts of each length cut out of held-out lines, read as all texts are."""
    reader = Reader(model)
    by = [np.flatnonzero(y == k) for k in range(len(LANGUAGES))]
    for several in (0, 1):
        for c in range(LENGTHS):
            made, label = [], []
            for i in rng.integers(0, len(y), texts):
                n, parts, held = int(rng.integers(1 << c, 2 << c)), [lines[i]], len(lines[i])
                while held < n:
                    parts.append(lines[int(rng.choice(by[y[i]]))])
                    held += len(parts[-1])
                cut = int(rng.integers(0, held - n + 1)) if len(parts) == 1 else 0
                parts[0] = parts[0][cut:]
                parts[-1] = parts[-1][: len(parts[-1]) - max(0, held - cut - n)]
                made.append(("\n" if several else " ").join(" ".join(p) for p in parts if p))
                label.append(y[i])
            read = reader.lines(made)
            _, votes = _by_record(read, len(made))
            best, conf = _record_confidence(reader, read, votes)
            right = best == np.array(label)
            rank = np.argsort(-conf, kind="stable")
            wrong = np.cumsum(~right[rank]) / np.arange(1, len(rank) + 1)
            ok = np.flatnonzero(wrong <= max_error)
            model.reject[several, c] = conf[rank[ok[-1]]] if len(ok) else 1.0
            model.held_out[several, c] = right.mean()
        # the same mean confidence over more words is no less certain
        model.reject[several] = np.minimum.accumulate(model.reject[several])


def fit(docs: DataFrame, sample_rows: int = 3000, **options) -> Model | None:
    """Train on up to ``sample_rows`` records of ``docs(seq, text)``, those whose hashes are below a bound.

    The bound follows from the number of records, so that about ``sample_rows`` rows in all come to the driver.
    """
    n = docs.count()
    part = min(1.0, sample_rows / n) if n else 1.0
    h = F.shiftrightunsigned(F.xxhash64("seq"), 11)  # 53 bits
    rows = docs.withColumn("h", h).filter((F.col("h") <= int(part * (1 << 53))) & (F.length("text") >= 40)).select("h", "text").limit(2 * sample_rows).collect()
    return train([t for _, t in sorted(map(tuple, rows))[:sample_rows]], **options)


class Reader:
    """Scores of the words of texts, remembered by word."""

    def __init__(self, model: Model | None, limit: int = 300_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self):
        self.known, self.row, self.table = np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((0, len(LANGUAGES)))

    def _scores(self, w: Words) -> np.ndarray:
        """Scores of each word of ``w``; numbers and single consonants (which number the items of lists) have none."""
        hashes, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            words = [w.word(k) for k in first[new].tolist()]
            fresh = self.model.scores(words)
            fresh[[x.isdigit() or len(x) == 1 and x not in VOWELS for x in words]] = 0
            row = np.r_[self.row, len(self.table) + np.arange(len(words))]
            self.table = np.concatenate([self.table, fresh])
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
            at = np.searchsorted(self.known, hashes)
        return self.table[self.row[at]][back]

    def _lines(self, texts: list) -> dict[str, np.ndarray]:
        w = Words(texts)
        cp, k = w.code_points, len(LANGUAGES)
        end = np.flatnonzero(cp == 10)
        start = np.r_[0, end[:-1] + 1]
        record = np.searchsorted(w.offsets, start, side="right") - 1
        solid = np.add.reduceat((np.where(cp < 0x3000, class_table()[np.minimum(cp, 0x2FFF)], 8) != 4).astype(np.int64), start) > 0
        count = np.cumsum(solid)
        opened = np.searchsorted(record, np.arange(len(texts)))
        number = count - (count[opened] - solid[opened])[record]
        line = np.searchsorted(start, w.starts, side="right") - 1
        n = np.bincount(line, minlength=len(start))
        votes, sums = np.zeros((len(n), k)), np.zeros((len(n), k))
        if self.model is not None and len(line):
            s = self._scores(w)
            counts = (s != 0).any(axis=1).astype(float)
            last = np.cumsum(n)
            total = np.concatenate([np.zeros((1, k)), np.cumsum(s, axis=0)])
            at = np.arange(len(s))
            near = total[np.minimum(at + NEAR + 1, last[line])] - total[np.maximum(at - NEAR, (last - n)[line])]
            votes = np.bincount(line * k + near.argmax(axis=1), weights=counts, minlength=len(n) * k).reshape(-1, k)
            sums = total[last] - total[last - n]
        out = {"record": record, "line_no": number, "words": n, "votes": votes, "scores": sums}
        return {c: v[solid] for c, v in out.items()}

    def lines(self, texts: list) -> dict[str, np.ndarray]:
        """One entry for each non-blank line: record (position in ``texts``), line_no, words, votes by language, scores."""
        parts = []
        for at, part in chunks(texts):
            got = self._lines([t or "" for t in part])
            got["record"] = got["record"] + at
            parts.append(got)
        if not parts:
            return self._lines([""])
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def confidence(self, scores: np.ndarray, votes: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Calibrated probability of the language ``best``."""
        if self.model is None or not len(scores):
            return np.zeros(len(scores))
        n = np.maximum(votes.sum(axis=1, keepdims=True), 1)
        p = softmax(scores / n / self.model.temperature)[np.arange(len(scores)), best]
        return np.where(votes.sum(axis=1) > 0, p, 0.0)

    def languages(self, votes: np.ndarray, scores: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language of most of the words of each line (-1 where rejected) and its confidence."""
        best = votes.argmax(axis=1)
        conf = self.confidence(scores, votes, best)
        return np.where(self.accepts(conf, votes, words, 0), best, -1), conf

    def accepts(self, conf: np.ndarray, votes: np.ndarray, words: np.ndarray, several: int) -> np.ndarray:
        """Whether a confidence is high enough for a text of that many words, in one line or in several."""
        if self.model is None:
            return np.zeros(len(conf), bool)
        return (conf >= self.model.reject[several, length_class(words)]) & (votes.sum(axis=1) > 0)


#: Structures whose records have no language of their own.
UNREAD = tuple(KINDS.index(k) for k in ("table", "junk", "code"))
NAMES = np.array([*LANGUAGES, "und"], dtype=object)


def _segments(raw: DataFrame, model: Model | None, rows_of, schema: str) -> DataFrame:
    """``rows_of(batch, texts, kinds, reader)`` over the records of ``raw``; the model is sent to the tasks (4 MB)."""
    sent = raw.sparkSession.sparkContext.broadcast(model)
    flag = F.col("is_pt") if has(raw, "is_pt") else F.lit(None).cast("boolean")

    def run(batches):
        reader = Reader(sent.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            yield from rows_of(b, texts, measure(texts)["kind"], reader)

    return spread(raw.select("seq", flag.alias("is_pt"), effective_text(raw).alias("text"))).mapInArrow(run, schema)


def _fit(raw: DataFrame, sample_rows: int) -> Model | None:
    return fit(raw.select("seq", effective_text(raw).alias("text")), sample_rows)


def _by_record(lines: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each record, and its votes by language."""
    r, v = lines["record"], lines["votes"]
    votes = np.stack([np.bincount(r, weights=v[:, c], minlength=n) for c in range(v.shape[1])], axis=1)
    return np.bincount(r, weights=lines["words"], minlength=n).astype(np.int64), votes


def record_languages(raw: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """(seq, line_no, lang, confidence): ``line_no`` 0 for every record, and every line of a text in several languages.

    A text is in several languages if its lines of at least 8 words are not all in one. ``lang`` is ``und`` where the
    confidence is too low for the length; a rejected line goes with the rest of its record.
    """

    def rows(b, texts, kinds, reader):
        lines = reader.lines(texts)
        lang, conf, each, each_conf, _ = _languages(reader, lines, len(texts))
        mixed = _mixed(lines, each, len(texts))[lines["record"]]
        where = np.r_[np.arange(len(texts)), lines["record"][mixed]]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(where)), pa.array(np.r_[np.zeros(len(texts), np.int64), lines["line_no"][mixed]].astype(np.int32)), pa.array(NAMES[np.r_[lang, each[mixed]]], pa.string()), pa.array(np.r_[conf, each_conf[mixed]])],
            ["seq", "line_no", "lang", "confidence"],
        )

    return _segments(raw, _fit(raw, sample_rows), rows, "seq bigint, line_no int, lang string, confidence double")


def _languages(reader: Reader, lines: dict[str, np.ndarray], n: int):
    """Of each of ``n`` records language (-1 where rejected) and confidence, of each line the same, and the records' words."""
    words, votes = _by_record(lines, n)
    best, conf = _record_confidence(reader, lines, votes)
    several = (np.bincount(lines["record"], minlength=n) > 1).astype(np.int64)
    lang = np.where(reader.accepts(conf, votes, words, several), best, -1)
    each, each_conf = reader.languages(lines["votes"], lines["scores"], lines["words"])
    return lang, conf, _in_context(lines, each, lang), each_conf, words


def _in_context(lines: dict[str, np.ndarray], each: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Language of each line: one that differs from its record's only counts if it is clearly ahead of that."""
    own, votes, at = record[lines["record"]], lines["votes"], np.arange(len(each))
    best = votes[at, np.maximum(each, 0)]
    ahead = (each >= 0) & (best >= 0.65 * votes.sum(axis=1)) & (best >= 2 * votes[at, np.maximum(own, 0)])
    return np.where((each != own) & (own >= 0) & ~ahead, own, each)


def _record_confidence(reader: Reader, lines: dict[str, np.ndarray], votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language of most words of each record, and the mean confidence of its lines in it, weighted by their words of it."""
    best = votes.argmax(axis=1)
    own = best[lines["record"]]
    mine = lines["votes"][np.arange(len(own)), own]
    conf = reader.confidence(lines["scores"], lines["votes"], own)
    held = np.bincount(lines["record"], weights=conf * mine, minlength=len(best))
    n = np.bincount(lines["record"], weights=mine, minlength=len(best))
    return np.where(votes.sum(axis=1) > 0, best, -1), held / np.maximum(n, 1)


def _mixed(lines: dict[str, np.ndarray], lang: np.ndarray, n: int, least: int = 8) -> np.ndarray:
    """Whether the lines of at least ``least`` words of each record are in more than one language."""
    ok = (lines["words"] >= least) & (lang >= 0)
    held = np.zeros((n, len(LANGUAGES)), bool)
    held[lines["record"][ok], lang[ok]] = True
    return held.sum(axis=1) > 1


def mislabelled(raw: DataFrame, sample_rows: int = 3000, least_words: int = 10, least_line: int = 8) -> DataFrame:
    """(seq, line_no, lang): records whose ``is_pt`` is missing or wrong, and the lines of records in several languages.

    ``line_no`` 0 stands for a record of at least ``least_words`` words; lines of at least ``least_line`` words are
    numbered from 1 among all that are not blank. Code, tables, junk and rejected records give no rows; a rejected line
    goes with the rest of its record.
    """

    def rows(b, texts, kinds, reader):
        read = np.flatnonzero(~np.isin(kinds, UNREAD))
        texts = [texts[i] for i in read]
        flag = b.column(1).take(pa.array(read)).to_pylist()
        lines = reader.lines(texts)
        lang, _, each, _, words = _languages(reader, lines, len(texts))
        pt = LANGUAGES.index("pt")
        wrong = np.array([f is None or f != (x == pt) for f, x in zip(flag, lang)], bool)
        whole = np.flatnonzero((words >= least_words) & (lang >= 0) & wrong)
        part = np.flatnonzero(_mixed(lines, each, len(texts), least_line)[lines["record"]] & (lines["words"] >= least_line) & (each >= 0))
        where = read[np.r_[whole, lines["record"][part]].astype(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(where)), pa.array(np.r_[np.zeros(len(whole)), lines["line_no"][part]].astype(np.int32)), pa.array(NAMES[np.r_[lang[whole], each[part]].astype(np.int64)], pa.string())],
            ["seq", "line_no", "lang"],
        )

    return _segments(raw, _fit(raw, sample_rows), rows, "seq bigint, line_no int, lang string")
