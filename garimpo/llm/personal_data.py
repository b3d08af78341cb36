"""Problem 7: personal data inside free text, by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs however written, schemes (``tel:``, ``wa.me/``), cues of
identifiers and telephones, street types, and cues of names (see ``person_names``). A parser of the anchor's kind expands
it in the text around, as far as its grammar holds (there are no windows), and validates the result: hosts of addresses,
check digits, house numbers, surnames. Of overlapping finds the earlier kind in ``KINDS`` and then the one further left
stays. A find may hold a line break, with the comment mark that opens the next line.

Cases: null and empty texts hold nothing and stay as they are. Repeated rows and repeated finds give one row. Empty
tables give empty results. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from garimpo.llm import person_names as N
from garimpo.llm.languages_data import fold
from garimpo.llm.person_names import BREAK, GAP
from garimpo.plans.materialize import spread

KINDS = ("email", "id_number", "phone", "address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID]", "phone": "[PHONE]", "address": "[ADDRESS]", "person_name": "[NAME]"}

# Street types before the name, and behind it in English.
STREETS = "rua r. avenida av. av travessa trav. tv. alameda al. praça pça. largo estrada estr. rodovia rod. beco ladeira viela calle plaza".split()
STREETS_BEHIND = "street st avenue ave road rd lane ln drive boulevard blvd court terrace crescent".split()

# Cues of identifiers and of telephones.
ID_CUES = {
    "cpf": ("cpf/mf", "cpf", "c.p.f.", "c.p.f"),
    "rg": ("rg", "r.g.", "identidade", "identity card"),
    "ssn": ("ssn", "social security", "national id", "id no", "national insurance", "dni", "nie", "identidad", "numéro de sécurité sociale"),
}
PHONE_CUES = (
    "fone", "tel.", "tel:", "tel ", "telefone", "teléfono", "telefono", "téléphone", "telephone", "phone", "cel.", "cel:", "cel ", "celular", "cell", "zap", "whatsapp", "móvil", "mobile",
    "ligue", "ligar", "liga", "llame", "llamar", "call", "ring", "text", "mensagem", "message", "mensaje", "avise", "número", "numero", "numéro", "number", "plantão", "plantao", "contato", "contacto", "contact", "appelez", "appeler",
)
NOT_PHONE = (
    "cnpj", "processo", "protocolo", "lote", "isbn", "serial", "invoice", "part number", "cep", "formulário", "formulario", "build", "barras", "pedido", "versão", "versao", "order", "batch", "ticket", "process", "file", "nota fiscal", "model",
    "cpf", "c.p.f", "rg", "identidade", "ssn", "national id", "id no",
)
_D = rf"(?:[ .\-/\xa0]|{BREAK})"

_AT = rf"(?:@|＠|&#64;|{GAP}?[(\[{{<]{GAP}?(?:arroba|at|@){GAP}?[)\]}}>]{GAP}?|{GAP}arroba{GAP}|{GAP}@{GAP})"
_DOT = rf"(?:\.|{GAP}?[(\[{{<]{GAP}?(?:ponto|dot|punto|point){GAP}?[)\]}}>]{GAP}?|{GAP}(?:ponto|dot){GAP})"
_HOST = re.compile(rf"{_AT}((?:[^\W_](?:[\w-]{{0,61}}[^\W_])?{_DOT})+[^\W\d_]{{2,24}})(?![\w-]*[\w]@)", re.I)
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "py", "pdf", "html", "cached", "json", "zip", "exe", "ico", "mp4", "property", "setter", "wraps"}
_SEP = re.compile(r"[\s:.,#ºª°\"'(\-*/>=|]|n[ºo°.]|no\.|n\.[ºo]|número|numero|number|nº")
_CPF = re.compile(rf"\d{{3}}{_D}?\d{{3}}{_D}?\d{{3}}{_D}?\d{{2}}(?!\d)")
_RG = re.compile(rf"\d{{1,2}}{_D}?\d{{3}}{_D}?\d{{3}}(?:(?:-|{BREAK})[\dXx](?!\w))?(?!\d)")
_SSN = re.compile(rf"\d{{3}}{_D}\d{{2}}{_D}\d{{4}}(?!\d)|\d{{8}}-?[A-Z](?!\w)|[XYZ]-?\d{{7}}-?[A-Z](?!\w)|[12] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?\d{{3}} ?\d{{3}}(?: ?\d{{2}})?(?!\d)|\d{{7,9}}(?!\d)")
_PHONE = re.compile(
    rf"(?<![\w.,/-])(?:(?:\+55{_D}?)?(?:\(0?\d\d\)|0?\d\d){_D}?9?\d{{4}}{_D}?\d{{4}}|(?:\+?1{_D}?)?(?:\(\d{{3}}\)|\d{{3}}){_D}?\d{{3}}{_D}?\d{{4}}|\+\d{{1,3}}{_D}?\(?\d{{1,4}}\)?(?:{_D}?\d{{2,4}}){{2,4}})(?![\w]|[.,/-]\d)"
)
_NUMBER = rf"(?:,|{GAP}?[-–])?{GAP}?(?:(?:n\.?[ºo°]?\.?|n[ºo°]|no\.|nº\.?|número|numero|num\.|#){GAP}?)?\d{{1,5}}(?![\w]|[.,/-]\d|[ \xa0]?(?:km|%|metros|m\b|anos|dias|years|days))"
_NAME_WORD = r"(?:[A-ZÀ-ÖØ-Þ][\w'’ªº-]*\.?|\d{1,2}(?=\s+de\s))"
_STREET_NUMBER = re.compile(_NUMBER)
_STREET_WORD = re.compile(rf"{GAP}(?:{_NAME_WORD}|d[aeo]s?|d['’][A-ZÀ-Þ]\w+|e|y|del|la|las|los|DA|DE|DO|DAS|DOS)")
# in lower case the number needs its sign
_LOWER_NUMBER = re.compile(rf"(?:,|{GAP}?[-–])?{GAP}?(?:n\.?[ºo°]\.?|n\.|nº){GAP}?\d{{1,5}}(?!\w)")
_LOWER_WORD = re.compile(rf"{GAP}(?!tem\b|foi\b|fica\b|has\b)[^\W\d_][\w'’-]*\.?")
_BEFORE_STREET = re.compile(rf"\d{{1,5}}(?:{GAP}[A-ZÀ-ÖØ-Þ][\w'’-]*\.?)+{GAP}")
_CLAUSE = re.compile(r"[.;|!?]\s+\w|\n\s+\w")
_CUT_NUMBER = re.compile(r"0?\d\d-9?\d{4}-\d{4}|\d{3}-\d{3}-\d{4}")
_SIGNED = re.compile(r"[^\S\n]*\n[ \t#/*]*")


def valid_cpf(digits: str) -> bool:
    """Whether the two check digits of a CPF are right; eleven equal digits are none."""
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for n in (9, 10):
        s = sum(int(c) * w for c, w in zip(digits, range(n + 1, 1, -1)))
        if int(digits[n]) != (s * 10 % 11) % 10:
            return False
    return True


@lru_cache(maxsize=1)
def automaton():
    """All anchors, in lower case, with their kinds."""
    import ahocorasick

    kinds: dict[str, list] = {}

    def add(key, *kind):
        for k in {key, fold(key)}:
            if kind not in kinds.setdefault(k, []):
                kinds[k].append(kind)

    for k in ("@", "＠", "&#64;", "%40", "arroba", *(f"{a}{b}at{b}{c}" for a, c in ("[]", "()", "{}", "<>") for b in ("", " "))):
        add(k, "email")
    for name, keys in ID_CUES.items():
        for k in keys:
            add(k, "id", name)
    for k in PHONE_CUES:
        add(k, "phone")
    for k in NOT_PHONE:
        add(k, "not")
    for k in ("+", "(", *(f"{d}-" for d in range(10))):
        add(k, "digits")
    for k in STREETS:
        add(k, "street")
    for k in STREETS_BEHIND:
        add(k, "behind")
    for k, kind in N.anchors():
        add(k, kind)
    a = ahocorasick.Automaton()
    for k, v in kinds.items():
        a.add_word(k, (len(k), tuple(v)))
    a.make_automaton()
    return a


def _email(text: str, low: str, start: int) -> tuple[int, int] | None:
    """An address around an at-sign at ``start``, or the word that stands for one."""
    lead = start
    while lead > 0 and text[lead - 1] in " \t\xa0([{<\n#/*":
        lead -= 1
    m = _HOST.match(text, lead) or _HOST.match(text, start)
    if not m:
        return None
    labels = re.split(r"[^\w-]+", m.group(1))
    if labels[-1].lower() in _FILES or labels[0].isdigit():
        return None
    begin = _local_start(text, m.start())
    while begin < m.start() and text[begin] in ".'- \t\n([":
        begin += 1
    if begin == m.start():
        return None
    return begin, m.end()


def _local_start(text: str, end: int) -> int:
    """Where the local part that stops at ``end`` begins: back over its characters and written-out dots."""
    at = end
    while True:
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_.%+'-"):
            at -= 1
        close = at
        while close > 0 and text[close - 1] in " \t\xa0\n#*/":
            close -= 1
        opened = max(text.rfind("(", max(0, close - 12), close), text.rfind("[", max(0, close - 12), close)) if close and text[close - 1] in ")]" else -1
        if opened < 0 or text[opened + 1 : close - 1].strip().lower() not in ("ponto", "dot", "punto", "point"):
            return at
        while opened > 0 and text[opened - 1] in " \t\xa0\n#*/":
            opened -= 1
        at = opened


def _after_cue(text: str, at: int) -> int:
    """Position behind the separators that may stand between a cue and its value."""
    while m := _SEP.match(text, at):
        at = m.end()
    return at


def _check_letter(value: str) -> bool:
    """Whether the letter behind a number of the Spanish kind is the one that its digits ask for; others pass."""
    v = value.replace("-", "").upper()
    if len(v) == 9 and v[-1].isalpha():
        digits = {"X": "0", "Y": "1", "Z": "2"}.get(v[0], v[0]) + v[1:-1]
        return digits.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == v[-1]
    return True


def _identifier(text: str, end: int, name: str) -> tuple[int, int] | None:
    at = _after_cue(text, end)
    if name == "cpf":
        m = _CPF.match(text, at)
        return (m.start(), m.end()) if m and valid_cpf("".join(c for c in m.group() if c.isdigit())) else None
    first, second = (_RG, _SSN) if name == "rg" else (_SSN, _RG)
    m = first.match(text, at) or second.match(text, at)
    return (m.start(), m.end()) if m and _check_letter(m.group()) else None


def _phone_at(text: str, at: int) -> tuple[int, int] | None:
    m = _PHONE.match(text, at)
    return (m.start(), m.end()) if m and sum(c.isdigit() for c in m.group()) <= 14 else None


class _Phones:
    """Telephones of one text: the first number behind a cue in its clause, unless a cue of other numbers is nearer."""

    def __init__(self, text: str):
        self.text, self.cues, self._breaks = text, [], None
        self.reach, self.last = -1, None  # how far the last search went, and what it gave

    @property
    def breaks(self) -> list[tuple[int, int]]:
        if self._breaks is None:
            self._breaks = [m.span() for m in _CLAUSE.finditer(self.text)]
        return self._breaks

    def after(self, end: int) -> tuple[int, int] | None:
        """The first number behind a cue that stops at ``end``, within its clause."""
        if end <= self.reach:
            return self.last
        text = self.text
        k = bisect_left(self.breaks, (end, 0))
        stop = self.breaks[k][0] if k < len(self.breaks) else len(text)
        self.reach, self.last, at = stop, None, end
        while m := _DIGIT.search(text, at, stop + 1):
            if got := _phone_at(text, m.start()):
                self.reach, self.last = m.start(), got
                break
            if m.group() in "+(":
                at = m.end()
                continue
            run = _DIGITS.match(text, m.start())
            at = run.end()
            if run.end() - run.start() > 2 or not text[at : at + 1].isspace():
                self.reach = m.start()
                break
        return self.last

    def is_one(self, at: int) -> bool:
        """Whether the nearest cue before ``at`` in its clause is not one of other numbers."""
        k = bisect_left(self.cues, (at + 1,)) - 1
        if k < 0 or self.cues[k][1]:
            return True
        b = bisect_left(self.breaks, (self.cues[k][0], 0))
        return b < len(self.breaks) and self.breaks[b][1] <= at


_DIGIT = re.compile(r"[\d+(]")
_DIGITS = re.compile(r"\d+")


def _street(text: str, end: int, word: re.Pattern, number: re.Pattern) -> tuple[int, int]:
    """(end of the address or -1, how far was read) of the street whose type stops at ``end``."""
    at = end
    while m := word.match(text, at):
        at = m.end()
        if n := number.match(text, at):
            return n.end(), at
    return -1, at


def _house_before(text: str, begin: int) -> int | None:
    """Where the house number stands whose street's name goes on to the street type at ``begin``."""
    at = begin
    while True:
        stop = at
        while stop > 0 and text[stop - 1] in " \t\xa0\n#*/":
            stop -= 1
        if stop == at:
            return None
        start = stop - 1 if stop and text[stop - 1] == "." else stop
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_'’-"):
            start -= 1
        word = text[start:stop]
        if word.isdigit():
            ok = not (start and text[start - 1] in ".,") and _BEFORE_STREET.fullmatch(text, start, begin)
            return start if ok else None
        if not word[:1].isupper():
            return None
        at = start


def _is_word(text: str, begin: int, end: int) -> bool:
    return not (begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_"))


def find(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the personal data in ``text``, in order and without overlaps."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    got: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    phones, cued, cut, no_street, read = _Phones(text), [], [], [(-1, -1), (-1, -1)], 0
    for last, (size, kinds) in automaton().iter(low):
        begin, end = last - size + 1, last + 1
        is_word = None
        for kind in kinds:
            what = kind[0]
            x = None
            if what == "email":
                if x := _email(text, low, begin):
                    got["email"].append(x)
                continue
            if what == "phone":
                if begin == 0 or not low[begin - 1].isalpha():
                    phones.cues.append((end, True))
                    cued.append(end)
                continue
            if what == "digits":
                at = begin if low[begin] in "+(" else begin - 1
                if low[begin] in "+(":
                    x = _phone_at(text, begin)
                else:
                    while at > 0 and begin - at < 5 and low[at - 1].isdigit():
                        at -= 1
                    at = at if low[at].isdigit() else begin
                    # without a cue, only numbers cut like telephones: area code and two groups
                    x = _phone_at(text, at) if at == 0 or low[at - 1] not in "+()" else None
                    if x and not _CUT_NUMBER.fullmatch(text[x[0] : x[1]]):
                        x = None
                if x:
                    cut.append(x)
                continue
            if what == "street":
                if (begin == 0 or not (text[begin - 1].isalnum() or text[begin - 1] in "_./-@")) and not low[end : end + 1].isalnum():
                    for n, (word, number) in enumerate(((_STREET_WORD, _STREET_NUMBER), (_LOWER_WORD, _LOWER_NUMBER))):
                        if no_street[n][0] < begin < no_street[n][1]:
                            continue  # what was read from a street type before has no number
                        stop, reach = _street(text, end, word, number)
                        if stop > 0:
                            got["address"].append((begin, stop))
                            break
                        no_street[n] = (begin, reach)
                continue
            if is_word is None:
                is_word = _is_word(text, begin, end)
            if not is_word:
                continue
            if what == "not":
                phones.cues.append((end, False))
            elif what == "id":
                if x := _identifier(text, end, kind[1]):
                    got["id_number"].append(x)
            elif what == "behind":
                if (at := _house_before(text, begin)) is not None:
                    got["address"].append((at, end))
            else:
                if what == "given":
                    if begin < read:
                        continue  # within the name that an earlier one began
                    x, read = N.around_given(text, begin, end)
                else:
                    x = N.AFTER[what](text, begin, end)
                if x:
                    got["person_name"].append(x)
    phones.cues.sort()
    got["phone"] = [x for x in (*map(phones.after, cued), *cut) if x and phones.is_one(x[0])]
    # a signature: a line with nothing but a telephone below a name
    for _, stop in got["person_name"]:
        m = _SIGNED.match(text, stop)
        if m and (x := _PHONE.match(text, m.end())) and re.match(r"[ \t]*(?:\n|$)", text[x.end() : x.end() + 80].split("\n")[0] + "\n"):
            got["phone"].append((x.start(), x.end()))
    out: list[tuple[int, int, str]] = []
    begins: list[int] = []
    for kind in KINDS:
        for b, e in sorted(set(got[kind]), key=lambda x: (x[0], -x[1])):
            k = bisect_left(begins, b)
            if (k == 0 or out[k - 1][1] <= b) and (k == len(out) or e <= out[k][0]):
                out.insert(k, (b, e, kind))
                begins.insert(k, b)
    return out


def redact(text: str, finds: list[tuple[int, int, str]] | None = None) -> str:
    """The text with a typed placeholder in the place of each find."""
    parts, at = [], 0
    for b, e, kind in find(text) if finds is None else finds:
        parts += [text[at:b], PLACEHOLDERS[kind]]
        at = e
    return "".join(parts) + text[at:]


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text): each distinct piece of personal data of each document, as written there."""

    def run(batches):
        for b in batches:
            at, kinds, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for kind, x in dict.fromkeys((k, t[s:e]) for s, e, k in find(t)):
                        at.append(i)
                        kinds.append(kind)
                        texts.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "kind", "found_text"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, kind string, found_text string").distinct()


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_found): each document with placeholders in the place of personal data."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            finds = [find(t) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([redact(t, f) if t else t for t, f in zip(texts, finds)], pa.string()), pa.array([len(f) for f in finds], pa.int32())], ["doc_id", "text", "n_found"]
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, text string, n_found int")
