"""Problem 1: text quality statistics and the structure of each record: prose, list, table or junk.

A record is described by distributions, each compared with profiles by Jensen-Shannon divergence:

* *layout*: how much of the text stands in lines of each shape (long or short, ended or open, items, rows of fields, code),
  against the layouts of prose, lists, tables and code;
* *characters*: classes of the characters outside the rows, against the prose of each language and kinds of noise;
* *function words*, against the prose of each language and bare items;
* *repetition*: runs of three words that are new and that were there before, against prose and endless repetition;
* *pieces*: readable text and dumped bytes, against prose and dumps.

The record gets the structure whose profiles are nearest. Layouts of tables and code decide where most of the text has
them; noise, repetition and dumps are junk; between list and prose, layout and function words decide together.

Cases: null and blank texts are ``prose`` with all statistics 0. Texts of fewer than ``MIN_WORDS`` words without rows
are prose, unless they are noise throughout. Texts mainly in other scripts than Latin are prose unless they have rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.languages_data import FUNCTION_WORDS, LANGUAGES, fold
from garimpo.llm.words import Words, chunks, effective_text, run_hashes, source_name, words_of
from garimpo.plans.materialize import spread

KINDS = ("prose", "list", "table", "junk", "code")
MIN_WORDS = 12
SHAPE_WEIGHT = 0.05
LIST_MARGIN = 0.012  # in doubt, verse rather than a list

# Character classes: 0 vowel, 1 frequent consonant, 2 rare letter, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 odd, 8 other letter
N_CLASSES = 9

# Shares of the character classes in prose of each language and in kinds of noise.
CHARACTER_PROFILES = {
    "prose_pt": (0.393, 0.375, 0.013, 0.006, 0.175, 0.034, 0.003, 0.001, 0.0),
    "prose_en": (0.315, 0.440, 0.036, 0.006, 0.168, 0.032, 0.002, 0.001, 0.0),
    "prose_es": (0.387, 0.382, 0.022, 0.006, 0.169, 0.032, 0.001, 0.001, 0.0),
    "prose_fr": (0.370, 0.395, 0.017, 0.006, 0.172, 0.038, 0.001, 0.001, 0.0),
    "noise_letters": (0.175, 0.510, 0.195, 0.0, 0.115, 0.004, 0.001, 0.0, 0.0),
    "noise_base64": (0.150, 0.480, 0.185, 0.150, 0.012, 0.002, 0.021, 0.0, 0.0),
    "noise_hex": (0.070, 0.140, 0.0, 0.460, 0.330, 0.0, 0.0, 0.0, 0.0),
    "noise_log": (0.050, 0.130, 0.040, 0.290, 0.070, 0.0, 0.420, 0.0, 0.0),
    "noise_symbols": (0.050, 0.100, 0.020, 0.130, 0.050, 0.250, 0.400, 0.0, 0.0),
    "noise_dots": (0.190, 0.180, 0.010, 0.180, 0.120, 0.320, 0.0, 0.0, 0.0),
    "noise_garbled": (0.220, 0.260, 0.010, 0.005, 0.140, 0.035, 0.010, 0.320, 0.0),
    "noise_garbled_light": (0.300, 0.330, 0.012, 0.005, 0.158, 0.040, 0.005, 0.150, 0.0),
}

# Shapes of free lines: 0 long and ended, 1 long and open, 2 short and ended, 3 short and open, 4 marked item, 5 inline items
FREE = 6
# Shares of text by line shape.
SHAPE_PROFILES = {
    "prose_paragraphs": (0.93, 0.04, 0.02, 0.01, 0.0, 0.0),
    "prose_open": (0.30, 0.66, 0.01, 0.03, 0.0, 0.0),
    "prose_wrapped": (0.18, 0.72, 0.04, 0.06, 0.0, 0.0),
    "prose_verse": (0.05, 0.30, 0.10, 0.55, 0.0, 0.0),
    "list_marked": (0.01, 0.02, 0.01, 0.02, 0.94, 0.0),
    "list_bare": (0.0, 0.02, 0.01, 0.95, 0.02, 0.0),
    "list_inline": (0.0, 0.0, 0.0, 0.02, 0.0, 0.98),
}
# Shares of text in free lines, rows of fields and code.
LAYOUT_PROFILES = {"free": (0.97, 0.02, 0.01), "table": (0.06, 0.93, 0.01), "code": (0.18, 0.02, 0.80)}
# Shares of word triples that are new and that have been there before.
RUN_PROFILES = {"prose": (0.97, 0.03), "loop": (0.08, 0.92)}
# Shares of readable text and of dumped bytes.
PIECE_PROFILES = {"text": (0.99, 0.01), "dump": (0.25, 0.75)}

_CELL = re.compile(r"<t[dhr](?:\s[^<>]*)?>", re.I)
_LI = re.compile(r"<li(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&[a-zA-Z]{2,8};|&#\d{1,6};")
_PAIR = re.compile(r"(?<![^\s;,|&{(])[\"']?[\w.-]{1,30}[\"']?\s?(?:=|:)\s?(?=\S)")
_ITEM = re.compile(r"\s*(?:[-*•·‣▪◦–+»>]\s+|\(?\d{1,3}[.)ºª]\s+|\(?[a-zA-Z][.)]\s+|\(?[ivx]{1,5}[.)]\s+|\[[ xX]?\]\s)")
_HEX = re.compile(r"\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{2}\b|\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{8,}\b")
_GARBLED = re.compile(r"[�¤¦\x80-\x9f\x00-\x08\x0e-\x1f]|(?<![A-ZÀ-ÖØ-Þ])[ÃÂ](?![A-ZÀ-ÖØ-Þ])|(?<=[^\W\d_])\?(?=[^\W\d_])|(?<=[a-zà-ÿ])[¡-»](?=[a-zà-ÿ])")
_CODE = re.compile(
    r"\s*(?:(?:async |export |public |private |static )*(?:def|function|func|fn|class|interface|struct|enum)\s+\w+\s*[({:<]"
    r"|(?:if|elif|else if|for|while|with|switch|catch|except|foreach)\b.*[:{]\s*$|(?:try|else|finally|do)\s*[:{]|\}\s*(?:else|catch|finally|while|;|$|\))"
    r"|(?:return|raise|throw|assert|yield|import|from|using|package|include|#include|print|echo|let|var|const|await|del|pass|break|continue|int|float|double|char|bool|string|void|auto)\b.*[\w)\]};'\"]\s*;?\s*$"
    r"|[\w.\[\]'\"*&]+(?:\s*,\s*[\w.\[\]'\"]+)*\s*(?:[-+*/%|&^]|\*\*|//|<<|>>|:)?=\s*\S|[\w.]+\(.*\)\s*[;{:]?\s*$|[\w.]+\(.*[,(]\s*$|@\w[\w.]*(?:\(.*\))?\s*$|//|/\*|\*/|\"\"\"|'''|<\?php|</?(?:script|style)\b"
    r"|(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b\s.+)"
)
_ODD_SIGNS = ("�", "¤", "¦", "Ã", "Â", "?", "\x80", "\x00")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Character class by code point; code points above the table are other letters."""
    import unicodedata

    t = np.full(0x3000, 8, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        cat, base = unicodedata.category(c), fold(c).lower()[:1]
        if c.isspace() or cat[0] == "Z":
            t[cp] = 4
        elif cat[0] == "L":
            t[cp] = 0 if base in "aeiouæøœ" else 2 if base in "jkqwxyz" else 1 if base.isascii() else 8
        elif cat[0] == "N":
            t[cp] = 3
        elif cat[0] == "M":
            t[cp] = 0
        elif c in ".,;:!?…'\"’‘“”«»()-–—¿¡":
            t[cp] = 5
        elif cat[0] == "C" or 0x80 <= cp < 0xC0 and c not in "ªº°·§©®£":
            t[cp] = 7
        else:
            t[cp] = 6
    return t


@lru_cache(maxsize=1)
def function_index() -> tuple[dict[str, int], np.ndarray]:
    """Index of each (accent-free) function word, and for each language the profile over these and the other words."""
    index: dict[str, int] = {}
    for words in FUNCTION_WORDS.values():
        for w in words.split():
            index.setdefault(fold(w), len(index))
    profiles = np.zeros((len(LANGUAGES) + 1, len(index) + 1))
    for n, lang in enumerate(LANGUAGES):
        for rank, w in enumerate(FUNCTION_WORDS[lang].split()):
            profiles[n, index[fold(w)]] += 1 / (rank + 3)
        profiles[n] *= 0.42 / profiles[n].sum()
        profiles[n, -1] = 0.58
    profiles[-1, :-1] = 0.08 * profiles[:-1, :-1].sum(axis=0) / profiles[:-1, :-1].sum()  # items: hardly a function word
    profiles[-1, -1] = 0.92
    return index, profiles


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from each row of ``q``."""
    out = np.empty((len(p), len(q)))
    with np.errstate(divide="ignore", invalid="ignore"):
        hp = -np.where(p > 0, p * np.log2(p), 0).sum(axis=1)
        for k, row in enumerate(q):
            m = (p + row) / 2
            hm = -np.where(m > 0, m * np.log2(m), 0).sum(axis=1)
            hq = -np.where(row > 0, row * np.log2(row), 0).sum()
            out[:, k] = hm - (hp + hq) / 2
    return np.maximum(out, 0)


def _line_sums(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask, starts, dtype=np.int64)


@lru_cache(maxsize=1)
def _function_codes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, with and without accents, and their indices."""
    index, _ = function_index()
    forms = {f: index[fold(w)] for words in FUNCTION_WORDS.values() for w in words.split() for f in (w, fold(w))}
    hashes = Words([" ".join(forms)]).hashes
    order = np.argsort(hashes)
    return hashes[order], np.array(list(forms.values()))[order]


def _measure(texts: list[str]) -> dict[str, np.ndarray]:
    n = len(texts)
    marked = [i for i, t in enumerate(texts) if "<" in t or "&" in t]
    plain = list(texts)
    for i in marked:
        t = texts[i]
        plain[i] = _ENTITY.sub("–", _TAG.sub("", _LI.sub("\n- ", _CELL.sub("\t", t))))
    w = Words(plain)
    cp = w.code_points
    n_words = np.diff(w.bounds)
    length = w.ends - w.starts
    letters = np.concatenate([[0], np.cumsum(length)])[w.bounds]
    letters = (letters[1:] - letters[:-1]).astype(float)

    # lines of all texts; each text ends with a newline of its own
    newline = cp == 10
    line_end = np.flatnonzero(newline)
    line_start = np.r_[0, line_end[:-1] + 1] if len(line_end) else np.empty(0, np.int64)
    doc = np.searchsorted(w.offsets, line_start, side="right") - 1
    size = (line_end - line_start).astype(float)
    # line_start[k] is a newline itself if the line is empty, so every reduceat stretch has at least one element
    cls = np.where(cp < 0x3000, class_table()[np.minimum(cp, 0x2FFF)], 8).astype(np.int64)
    line_of = np.repeat(np.arange(len(line_end)), (line_end - line_start) + 1)
    by_class = np.bincount(line_of * N_CLASSES + cls, minlength=len(line_end) * N_CLASSES).reshape(-1, N_CLASSES).astype(float)
    by_class[:, 4] -= 1  # its newline
    blank = by_class.sum(axis=1) - by_class[:, 4] <= 0
    digits = by_class[:, 3]
    after, before = np.r_[cp[1:], np.uint32(10)], np.r_[np.uint32(10), cp[:-1]]
    counts = {c: _line_sums(cp == ord(c), line_start) for c in "\t|;,&=:"}
    tight = {c: _line_sums((cp == ord(c)) & (after != 32), line_start) for c in ";,&"}
    gaps = _line_sums((cp == 32) & (after == 32) & ~np.isin(before, np.array([ord(c) for c in " \n.!?:;,"], np.uint32)), line_start)
    inline = _line_sums(np.isin(cp, np.array([ord(c) for c in "|•·;,/>»"], np.uint32)), line_start)
    word_line = np.searchsorted(line_start, w.starts, side="right") - 1
    line_words = np.bincount(word_line, minlength=len(line_start))

    # the last character that is not white space, behind closing quotes and brackets
    idx = np.arange(len(cp))
    closing = np.isin(cp, np.array([ord(c) for c in "\"'”’»)]"], np.uint32))
    inner = np.maximum.accumulate(np.where((cls != 4) & ~closing, idx, -1)) if len(cp) else idx
    last = cp[np.maximum(inner[line_end], 0)] if len(line_end) else np.empty(0, np.uint32)
    alive = ~blank
    stop = np.isin(last, np.array([ord(c) for c in ".!?…"], np.uint32)) & alive
    colon = np.isin(last, np.array([ord(":"), ord(";")], np.uint32)) & alive
    ended = stop | colon

    # rows of fields: 1 tab, 2 bar, 3 gap, 4-6 tight separators, 7 pairs
    kind = np.zeros(len(line_end), np.int64)
    cells = np.zeros(len(line_end))
    pairs = np.flatnonzero((counts["="] >= 2) | (counts[":"] >= 2))
    n_pairs = np.zeros(len(line_end), np.int64)
    fields: dict[tuple, list[int]] = {}  # lines by their text and the names of their fields

    def line(k):
        d = doc[k]
        o = w.offsets[d]
        return plain[d][line_start[k] - o : line_end[k] - o]

    for k in pairs.tolist():
        names = _PAIR.findall(line(k))
        n_pairs[k] = len(names)
        if len(names) > 1:
            fields.setdefault((doc[k], *names), []).append(k)
    # the same fields in line after line are records, whatever else they look like
    is_record = np.zeros(len(line_end), bool)
    for lines in fields.values():
        if len(lines) > 2:
            is_record[lines] = True
    for code, n_sep, ok in (
        (7, n_pairs, (n_pairs >= 2) & (size < 45 * n_pairs)),
        (6, tight["&"], (tight["&"] >= 2)),
        (5, tight[","], (tight[","] >= 2) & (tight[","] >= 0.6 * counts[","])),
        (4, tight[";"], (tight[";"] >= 2) & (tight[";"] >= 0.6 * counts[";"])),
        (3, gaps, gaps >= 1),
        (2, counts["|"], counts["|"] >= 2),
        (1, counts["\t"], counts["\t"] >= 1),
    ):
        kind[ok] = code
        cells[ok] = n_sep[ok] + 1
    kind[blank] = 0
    many = np.bincount(doc * 8 + kind, minlength=n * 8)[doc * 8 + kind] if n else kind
    is_row = (kind > 0) & (many >= 3) & (np.isin(kind, (1, 2, 3, 7)) | ((size < 30 * cells) & ((digits > 0.08 * size) | (many >= 4))))

    def per_doc(weights):
        return np.bincount(doc, weights=weights, minlength=n)

    total = per_doc(size)
    whole = np.maximum(total, 1)
    # code: only texts with many code signs are looked at line by line
    signs = per_doc(_line_sums(np.isin(cp, np.array([ord(c) for c in "_(){}[]="], np.uint32)), line_start)) if len(line_start) else np.zeros(n)
    is_code = np.zeros(len(line_end), bool)
    for k in np.flatnonzero((signs > 0.03 * whole)[doc] & alive).tolist():
        d = doc[k]
        o = w.offsets[d]
        is_code[k] = bool(_CODE.match(texts[d][line_start[k] - o : line_end[k] - o] if plain[d] is texts[d] else line(k)))
    is_code &= ~is_record
    is_row = (is_row | is_record) & ~is_code

    # items
    start = np.minimum.accumulate(np.where(cls != 4, idx, len(cp))[::-1])[::-1] if len(cp) else idx
    lead = np.minimum(start[line_start], len(cp) - 1) if len(line_start) else np.empty(0, np.int64)
    letter = cls[lead] <= 2 if len(lead) else np.empty(0, bool)
    second = after[lead] if len(lead) else np.empty(0, np.uint32)
    maybe = alive & ~is_row & (~letter | (second == ord(".")) | (second == ord(")")) | (second == ord("i")) | (second == ord("v")) | (second == ord("x")))
    is_item = np.zeros(len(line_end), bool)
    for k in np.flatnonzero(maybe & (line_words <= 16)).tolist():
        is_item[k] = bool(_ITEM.match(line(k)))
    is_item &= (line_words <= 14) & ~((line_words >= 7) & stop)
    shape = np.where(line_words >= 7, np.where(ended, 0, 1), np.where(stop, 2, 3))
    shape[(line_words >= 8) & (inline >= 5) & (line_words <= 4.2 * (inline + 1))] = 5
    shape[is_item] = 4
    free = alive & ~is_row
    shapes = np.bincount((doc * FREE + shape)[free], weights=size[free], minlength=n * FREE).reshape(-1, FREE)
    chars = np.stack([per_doc(np.where(free, by_class[:, c], 0)) for c in range(N_CLASSES)], axis=1) if n else np.zeros((0, N_CLASSES))

    garbled, hexes, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
    doc_digits = per_doc(digits)
    for i, t in enumerate(texts):
        if any(c in t for c in _ODD_SIGNS):
            garbled[i] = len(_GARBLED.findall(t))
        if doc_digits[i] > 0.12 * whole[i]:
            hexes[i] = sum(map(len, _HEX.findall(t)))
    # texts that say the same over and over: few distinct words, then the share of repeated triples
    owner = np.repeat(np.arange(n), n_words)
    seen = np.zeros((n, 4096), bool)
    seen[owner, (w.hashes >> np.uint64(52)).astype(np.int64)] = True
    for i in np.flatnonzero((n_words >= 24) & (seen.sum(axis=1) < 0.4 * n_words)).tolist():
        grams = run_hashes(w.of(i), 3)
        repeats[i] = 1 - len(np.unique(grams)) / len(grams)

    known, code_of = _function_codes()
    width = function_index()[1].shape[1]
    at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
    codes = np.where(known[at] == w.hashes, code_of[at], width - 1)
    f = np.bincount(owner * width + codes, minlength=n * width).reshape(-1, width).astype(float)
    brief = (shape >= 3)[word_line]
    f_items = np.bincount((owner * width + codes)[brief], minlength=n * width).reshape(-1, width).astype(float)
    for i in marked:  # the statistics keep the markup
        if plain[i] is not texts[i]:
            own = words_of(texts[i])
            n_words[i], letters[i] = len(own), sum(map(len, own))
    raw_size = np.fromiter(map(len, texts), np.float64, n)
    blanks = np.array([t.count(" ") + t.count("\n") + t.count("\t") + t.count("\r") for t in texts], float)
    n_lines = per_doc(alive.astype(float))
    return {
        "words": n_words, "letters": letters, "size": raw_size, "symbols": np.maximum(raw_size - letters - blanks, 0), "ended": per_doc(ended.astype(float)), "lines": n_lines,
        "rows": per_doc(np.where(is_row, size, 0)) / whole, "code": per_doc(np.where(is_code & ~is_row, size, 0)) / whole, "hexes": hexes / whole, "repeats": repeats,
        "garbled": garbled, "chars": chars, "function": f, "function_items": f_items, "shapes": shapes,
    }


def measure(texts: list) -> dict[str, np.ndarray]:
    """Statistics, divergences and kind of each text."""
    parts = [_measure([t or "" for t in part]) for _, part in chunks(texts, 300_000)] or [_measure([""])]
    m = {k: np.concatenate([p[k] for p in parts])[: len(texts)] for k in parts[0]}
    n, words, size = len(texts), m["words"], m["size"]
    chars = m["chars"]
    chars[:, 7] = np.maximum(chars[:, 7], m["garbled"])
    chars = chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)
    names = list(CHARACTER_PROFILES)
    noise_first = next(i for i, x in enumerate(names) if x.startswith("noise"))
    d_char = divergence(chars, np.array([CHARACTER_PROFILES[x] for x in names]))
    f = m["function"] / np.maximum(m["function"].sum(axis=1, keepdims=True), 1)
    # where items make up most of a text, their words decide, not those of a sentence above them
    in_items = m["shapes"][:, 3:].sum(axis=1) > 0.5 * m["shapes"].sum(axis=1)
    items = m["function_items"]
    d_word = divergence(np.where(in_items[:, None], items / np.maximum(items.sum(axis=1, keepdims=True), 1), f), function_index()[1])
    d_shape = divergence(m["shapes"] / np.maximum(m["shapes"].sum(axis=1, keepdims=True), 1), np.array(list(SHAPE_PROFILES.values())))
    n_prose = sum(x.startswith("prose") for x in SHAPE_PROFILES)
    prose_char, noise_char = d_char[:, :noise_first].min(axis=1), d_char[:, noise_first:].min(axis=1)
    prose_word, item_word = d_word[:, :-1].min(axis=1), d_word[:, -1]
    prose_shape, list_shape = d_shape[:, :n_prose].min(axis=1), d_shape[:, n_prose:].min(axis=1)
    latin = chars[:, 8] < 0.3
    common = np.where(words > 0, 1 - f[:, -1], 0.0)
    is_noise = (noise_char < prose_char) & latin & ((words >= 5) | (size >= 40)) & (m["rows"] < 0.5)
    like_list = item_word + SHAPE_WEIGHT * list_shape < prose_word + SHAPE_WEIGHT * prose_shape - LIST_MARGIN
    # words without any sentence: running text that has the function words of no language
    bare = (item_word < prose_word) & (common < 0.06) & (prose_shape < list_shape) & latin
    def near(profiles, *shares):
        return np.array(list(profiles))[divergence(np.stack(shares, axis=1), np.array(list(profiles.values()))).argmin(axis=1)]

    layout = near(LAYOUT_PROFILES, np.maximum(1 - m["rows"] - m["code"], 0), m["rows"], m["code"])
    runs = near(RUN_PROFILES, 1 - m["repeats"], m["repeats"])
    pieces = near(PIECE_PROFILES, 1 - np.minimum(m["hexes"], 1), np.minimum(m["hexes"], 1))
    kind = np.zeros(n, np.int64)
    kind[like_list & in_items & (words >= MIN_WORDS)] = 1
    kind[bare & (words >= MIN_WORDS)] = 3
    kind[is_noise | (runs == "loop")] = 3
    kind[layout == "table"] = 2
    kind[pieces == "dump"] = 3
    kind[layout == "code"] = 4
    kind[m["lines"] == 0] = 0
    return {
        "n_words": words, "mean_word_length": m["letters"] / np.maximum(words, 1), "symbol_ratio": m["symbols"] / np.maximum(size, 1),
        "ended_lines": m["ended"] / np.maximum(m["lines"], 1), "common_words": common,
        "prose_char": prose_char, "noise_char": noise_char, "prose_word": prose_word, "item_word": item_word, "prose_shape": prose_shape, "list_shape": list_shape,
        "rows": m["rows"], "code": m["code"], "hexes": m["hexes"], "repeats": m["repeats"], "in_items": in_items, "kind": kind,
    }


def quality(raw: DataFrame) -> DataFrame:
    """Statistics, divergence from prose and structure of each record of ``raw``.

    (seq, source, n_words, mean_word_length, symbol_ratio, ended_lines, common_words, divergence, kind); ``divergence``
    is the one of the function words from the nearest language's prose.
    """
    schema = "seq bigint, source string, n_words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, divergence double, kind string"

    def run(batches):
        for b in batches:
            m = measure(b.column(2).to_pylist())
            cols = [pa.array(m["n_words"].astype(np.int64)), *(pa.array(m[c].astype(np.float64)) for c in ("mean_word_length", "symbol_ratio", "ended_lines", "common_words", "prose_word"))]
            names = ["seq", "source", "n_words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", "divergence", "kind"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array([KINDS[k] for k in m["kind"]], pa.string())], names)

    return spread(raw.select("seq", source_name(raw).alias("source"), effective_text(raw).alias("text"))).mapInArrow(run, schema)


def not_prose(raw: DataFrame) -> DataFrame:
    """(seq, kind) of the records most of whose text is a list, a table or junk."""
    return quality(raw).filter(F.col("kind").isin("list", "table", "junk")).select("seq", "kind").distinct()


def quality_by_source(raw: DataFrame) -> DataFrame:
    """(source, kind, n_records, n_words): how much of each source has which structure."""
    return quality(raw).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_words").alias("n_words"))
