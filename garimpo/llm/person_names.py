"""Full names of persons by the cues around them: labels, phrases, titles, closings, verbs of saying, and given names.

A cue says where a name may begin (or end). From there the name is expanded word by word, as far as the grammar of
names holds: capitalised words, particles before another name word, and initials before another name word. There is no
limit on the number of surnames. What a cue proves decides how much more is asked of the words:

* a *field* (``Nome:``, ``"name": "``) or a *closing* (a line below ``Atenciosamente,``) holds nothing but the name, so
  the name may be written in any case;
* a *phrase*, *label* or *title* is followed by a name that stands out from the words around it by its capitals;
* a *verb of saying* ends a name that begins its sentence or line;
* a *given name* of the fixed list is a cue of its own, and the only one that settles a name which its writing doesn't
  set off (all words in capitals, or none). The list is a feature: names outside it are found by all other cues.
"""

from __future__ import annotations

import re
from functools import lru_cache

from garimpo.llm.languages_data import FUNCTION_WORDS, fold

BREAK = r"(?:[ \t\xa0]*\n[ \t]*(?:(?:#+|//+|\*+|--|;+|%+|>+)[ \t]*)?)"
GAP = rf"(?:[ \t\xa0]+|{BREAK})"

# The most frequent given names of Brazil by census (men, women), then frequent ones of the United States,
# Spain and France.
GIVEN_NAMES = """
josé joão antônio francisco carlos paulo pedro lucas luiz marcos luís gabriel rafael daniel marcelo bruno eduardo felipe
raimundo rodrigo manoel mateus andré fernando fábio leonardo gustavo guilherme leandro tiago anderson ricardo márcio jorge
sebastião alexandre roberto edson diego vítor sérgio cláudio matheus thiago geraldo adriano luciano júlio renato alex
maria ana francisca antônia adriana juliana márcia fernanda patrícia aline sandra camila amanda bruna jéssica letícia júlia
luciana vanessa mariana gabriela vera vitória larissa cláudia beatriz rita luana sônia renata eliane josefa simone natália
cristiane carla débora rosângela jaqueline rosa daniela aparecida marlene terezinha raimunda andreia fabiana lúcia raquel
james robert john michael david william richard joseph thomas christopher charles matthew anthony mark
mary patricia jennifer linda elizabeth barbara susan jessica karen sarah lisa nancy ashley emily
antonio manuel juan javier miguel carmen isabel laura cristina marta dolores pilar elena
jean philippe michel alain nicolas pierre marie nathalie isabelle sylvie catherine martine christine monique
""".split()

# Labels of a field that holds one name.
FIELDS = ("nome", "nome completo", "name", "full name", "nom", "nom complet", "nombre", "nombre completo", "titular", "paciente", "patient", "customer", "cliente", "aluno", "aluna", "student")
# Labels that persons follow.
LABELS = (
    "réu", "ré", "autor", "autora", "autores", "requerente", "requerido", "testemunha", "testemunhas", "vítima", "presente", "presentes", "participantes", "relator", "relatora", "advogado", "advogada", "assinado", "assinado por", "por", "responsável",
    "defendant", "plaintiff", "witness", "witnesses", "present", "attendees", "author", "authors", "by", "signed", "firmado", "firmado por", "asistentes", "testigo", "présents", "auteur", "témoin", "signé", "par",
)
# Phrases that a person follows.
PHRASES = (
    "segundo", "conforme", "de acordo com", "agradeço a", "agradeço ao", "agradecemos a", "agradecimentos a", "obrigado a", "graças a", "assinado por", "escrito por", "revisado por", "redigido por", "dirigido por", "identificada como", "identificado como", "conhecida como", "conhecido como",
    "ficou com", "conversei com", "falei com", "falar com", "encontrei", "ontem com", "hoje com", "assina", "é", "era", "foi", "por", "com",
    "according to", "thanks to", "written by", "signed by", "taken by", "reviewed by", "edited by", "prepared by", "known as", "identified as", "named", "called", "spoke with", "spoke to", "talked to", "talked with", "met", "went to", "it was", "is", "was", "by", "with",
    "según", "de acuerdo con", "agradezco a", "gracias a", "escrito por", "firmado por", "identificada como", "identificado como", "hablé con", "hablé ayer con", "ayer con", "es", "fue", "con",
    "selon", "d'après", "grâce à", "remercie", "écrit par", "signé par", "identifiée comme", "identifié comme", "parlé avec", "hier avec", "est", "par", "avec",
)
# Titles before a name.
TITLES = ("sr", "sra", "srta", "dr", "dra", "prof", "profa", "professor", "professora", "mr", "mrs", "ms", "miss", "dona", "don", "doña", "señor", "señora", "monsieur", "madame", "mme", "eng", "des", "exmo", "exma")
# What closes a letter, above the name of its writer.
CLOSINGS = (
    "atenciosamente", "att", "abraços", "abraço", "cordialmente", "saudações", "respeitosamente", "grato", "grata", "regards", "best regards", "kind regards", "sincerely", "yours sincerely", "yours faithfully", "best wishes",
    "saludos", "un saludo", "atentamente", "cordialement", "bien à vous", "salutations",
)
# Verbs of saying behind a name.
SAYING = (
    "comentou", "disse", "afirmou", "escreveu", "respondeu", "declarou", "explicou", "contou", "informou", "relatou", "perguntou", "said", "says", "wrote", "replied", "told", "commented", "added", "asked", "explained",
    "dijo", "comentó", "escribió", "afirmó", "respondió", "declaró", "explicó", "a dit", "a écrit", "a déclaré", "a commenté", "a répondu",
)
# Words in front of (or behind) a name that make it the one of a place or an institution.
PLACES = set(
    "escola colégio colegio instituto fundação fundacao hospital universidade faculdade rua avenida av praça praca travessa alameda largo estrada rodovia r ponte viaduto museu biblioteca teatro centro creche ginásio ginasio estádio estadio "
    "parque editora construtora clínica clinica associação associacao igreja auditório auditorio edifício edificio terminal aeroporto escuela fundación fundacion universidad museo calle plaza école ecole fondation lycée lycee université universite rue "
    "school college foundation institute university museum library theatre theater bridge park street st ave avenue road lane drive hall airport prize award prêmio premio laboratório laboratorio comércio comercio lojas loja ltda "
    "banco ministério ministerio secretaria câmara camara senado tribunal supremo governo partido conselho comissão comissao estados nações nacoes companhia empresa grupo clube cidade município municipio estado região regiao vila bairro santa santo são "
    "bank ministry department council committee company club city state united new north south east west supreme court house party".split()
)
PLACES = {fold(w) for w in PLACES}
PARTICLES = {"da", "de", "do", "das", "dos", "e", "del", "di", "du", "des", "van", "von", "y", "la"}
_VERBS = {fold(w) for s in SAYING for w in s.split()} - {"a"}
STOPS = (
    {fold(w) for ws in FUNCTION_WORDS.values() for w in ws.split()} | _VERBS
    | {fold(w) for w in "pela pelo sobre ontem ayer hier yesterday today hoje who which recebeu chegou saiu assinou moradora morador and ou or id cpf rg ssn email mail fone tel cel celular telefone phone end endereco address identidade identity carteira national data nascimento cep".split()}
    | {fold(w) for c in CLOSINGS for w in c.split()}
) - PARTICLES
_TITLE_WORDS = {fold(t) for t in TITLES}

_NAME = r"(?:d['’])?[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_FIRST = re.compile(rf"({_NAME})(\.(?!\w))?")
_PART = re.compile(rf"{GAP}({_NAME})(\.(?!\w))?")
_TITLE = re.compile(rf"(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ªº]?{GAP})+", re.I)
_TITLE_SIGN = re.compile(rf"\.?[ªº]?(?:[ \xa0]+|{BREAK})")
_COMMA = re.compile(rf",{GAP}")
_FIELD_SIGN = re.compile(r"[\"'*_]*[ \t]*(?:\([ao]\)[ \t]*)?[:=][ \t]*[\"'*_(]*")
_LABEL_SIGN = re.compile(r"[\"'*_]*[ \t]*:[ \t\"'*_]*")
_PHRASE_SIGN = re.compile(rf"{GAP}(?:(?:o|a|ao|à|the|el|la|le|l['’]){GAP}(?=(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b))?[\"'“*]*", re.I)
_CLOSING_SIGN = re.compile(rf"[,.;!:]*[ \t]*{BREAK}+[\"'*—–-]*[ \t]*")
_LINE_END = re.compile(r"[\s*_\"']*?(?:\n|$)")
_FIELD_END = re.compile(r"[ \t]*(?:[|;,\"'\n<>)\]}.\t]|$)")
_LETTERS = re.compile(r"[^\W\d_]+")


def given_names() -> frozenset[str]:
    """The fixed list and its forms of the other gender (Paulo, Paula), with and without accents."""
    return _given()


@lru_cache(maxsize=1)
def _given() -> frozenset[str]:
    swap = {"a": "o", "o": "a"}
    forms = [f for w in GIVEN_NAMES for f in (w, w[:-1] + swap.get(w[-1], w[-1]))]
    return frozenset(f for w in forms for f in (w, fold(w)))


def anchors() -> list[tuple[str, str]]:
    """(key, kind) of all cues of names, in lower case."""
    out = [(k, kind) for kind, keys in (("field", FIELDS), ("label", LABELS), ("phrase", PHRASES), ("title", TITLES), ("closing", CLOSINGS), ("saying", SAYING)) for k in keys]
    return out + [(k, "given") for k in sorted(given_names())]


def _bare(word: str) -> str:
    return word[2:] if word[:2].lower() in ("d'", "d’") else word


def _case(word: str) -> str:
    """``upper``, ``lower``, ``title`` or, of any other writing, ``mixed``."""
    bare = _bare(word)
    if bare.isupper():
        return "upper" if len(bare) > 1 else "title"
    return "title" if bare[:1].isupper() else "lower" if bare.islower() else "mixed"


def _plain(word: str) -> str:
    return fold(word).lower()


class Name:
    """A run of name words: where it stands, how it is written, and how many of its words are full or listed."""

    __slots__ = ("begin", "end", "case", "full", "listed", "first_listed")

    def __init__(self, begin: int, end: int, case: str):
        self.begin, self.end, self.case, self.full, self.listed, self.first_listed = begin, end, case, 0, 0, False


def expand(text: str, at: int, case: str | None = None) -> Name | None:
    """The name that begins with the word at ``at`` and goes on as far as the grammar of names holds."""
    m = _FIRST.match(text, at)
    if not m or (at and (text[at - 1].isalnum() or text[at - 1] in "_@")):
        return None
    word, dot = m.group(1), m.group(2)
    plain = _plain(word)
    case = case or _case(word)
    if len(_bare(word)) < 2 or plain in STOPS or plain in PARTICLES or plain in PLACES or plain in _TITLE_WORDS or _case(word) != case or case == "mixed":
        return None
    after = text[m.end(1) : m.end(1) + 1]
    if after in ("@", "_") or after == "." and text[m.end(1) + 1 : m.end(1) + 2].isalnum():
        return None
    name, known = Name(at, m.end(1), case), _given()
    name.full, name.listed = 1, plain in known
    name.first_listed = plain in known
    pending = m.end(1)
    ended = bool(dot)
    while not ended and (m := _PART.match(text, pending)):
        word, dot = m.group(1), m.group(2)
        plain = _plain(word)
        if plain in PARTICLES and not dot:
            follow = _PART.match(text, m.end())
            if not follow or _plain(follow.group(1)) in STOPS or _plain(follow.group(1)) in PARTICLES or not _fits(follow.group(1), case):
                break
            pending = m.end()
            continue
        if len(word) == 1:
            if not dot or word.islower() and case != "lower":
                break
            pending = m.end()  # an initial counts only if a name follows
            continue
        if plain in STOPS or plain in PLACES or plain in _TITLE_WORDS or not _fits(word, case):
            break
        after = text[m.end(1) : m.end(1) + 1]
        if after in ("@", "_") or after == "." and text[m.end(1) + 1 : m.end(1) + 2].isalnum():
            break
        name.full += 1
        name.listed += plain in known
        name.end = pending = m.end(1)
        ended = bool(dot)
    return name


def _fits(word: str, case: str) -> bool:
    own = _case(word)
    return own == case or case == "upper" and len(_bare(word)) == 1 and own == "title"


def _reversed(text: str, name: Name, alone: bool) -> Name | None:
    """``name`` as surnames before a comma and given names, or None.

    Of unlisted names, one word behind the comma (or several, with one before) must end the phrase; ``alone``: the
    whole must be nothing but a name.
    """
    m = _COMMA.match(text, name.end)
    if not m or name.listed and name.first_listed:
        return None
    back = expand(text, m.end(), name.case)
    if not back:
        return None
    if not back.first_listed:
        if name.listed or back.full > 1 and name.full > 1:
            return None
        if name.full > 1 and not (_LINE_END.match(text, back.end) or re.match(r"[ \t]*[|;.\"\n]", text[back.end : back.end + 3])):
            return None
    elif back.listed < back.full and name.full > 1:
        return None  # another full name follows in a list
    out = Name(name.begin, back.end, name.case)
    out.full, out.listed, out.first_listed = name.full + back.full, name.listed + back.listed, back.first_listed
    return out


def _outside(text: str, begin: int) -> bool:
    """Whether no place or institution stands right before ``begin``, through capitalised words and particles."""
    at = begin
    while True:
        end = at
        while end > 0 and text[end - 1] in " \t\xa0\n#*/":
            end -= 1
        if end == at or end == 0:
            return True
        dot = text[end - 1] == "."
        end -= dot
        start = end
        while start > 0 and text[start - 1].isalpha():
            start -= 1
        word = text[start:end]
        plain = _plain(word)
        if not word or dot and len(word) > 3:
            return True  # a sentence ends there
        if plain in PLACES:
            return plain == "r" and not dot
        if plain in _TITLE_WORDS or plain in STOPS or dot:
            return True
        if not (word[:1].isupper() or plain in PARTICLES):
            return True
        at = start


def _ends_as_place(text: str, end: int) -> bool:
    m = _PART.match(text, end)
    return bool(m and m.group(1)[:1].isupper() and _plain(m.group(1)) in PLACES)


def _shouted(text: str, begin: int, end: int) -> bool:
    """Whether the cue ``text[begin:end]`` is itself written in capitals, so that capitals set nothing off."""
    letters = [c for c in text[begin:end] if c.isalpha()]
    if len(letters) > 1:
        return all(c.isupper() for c in letters)
    at = begin
    while at > 0 and not text[at - 1].isalpha() and text[at - 1] not in ".!?\n":
        at -= 1
    start = at
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    return at - start > 1 and text[start:at].isupper()


def _settled(text: str, name: Name | None, alone: bool, shouted: bool) -> tuple[int, int] | None:
    """The name, if it is a full one and its writing or the list settles it."""
    if not name:
        return None
    name = _reversed(text, name, alone) or name
    if name.full < 2 or name.full == name.listed and not alone:
        return None  # listed names alone (Ana Paula) are given names without a surname
    if not alone and (name.case == "lower" or shouted) and not name.listed:
        return None
    if _ends_as_place(text, name.end) or not _outside(text, name.begin):
        return None
    return name.begin, name.end


def after_field(text: str, begin: int, end: int) -> tuple[int, int] | None:
    m = _FIELD_SIGN.match(text, end)
    if not m:
        return None
    at = m.end()
    if t := _TITLE.match(text, at):
        at = t.end()
    name = expand(text, at)
    if not name:
        return None
    got = _settled(text, name, True, False)
    return got if got and (name.case != "lower" or name.listed or _FIELD_END.match(text, got[1])) else None


def after_label(text: str, begin: int, end: int) -> tuple[int, int] | None:
    m = _LABEL_SIGN.match(text, end)
    if not m:
        return None
    return after_title(text, begin, m.end())


def after_phrase(text: str, begin: int, end: int) -> tuple[int, int] | None:
    m = _PHRASE_SIGN.match(text, end)
    return after_title(text, begin, m.end()) if m else None


def after_title(text: str, begin: int, at: int) -> tuple[int, int] | None:
    """A name at ``at``, behind a cue that begins at ``begin``."""
    if t := _TITLE.match(text, at):
        at = t.end()
    name = expand(text, at)
    return _settled(text, name, False, name is not None and name.case == "upper" and _shouted(text, begin, at)) if name else None


def behind_title(text: str, begin: int, end: int) -> tuple[int, int] | None:
    m = _TITLE_SIGN.match(text, end)
    end = begin
    while end > 0 and text[end - 1] in " \t\xa0\n.":
        end -= 1
    start = end
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    if not m or end < begin and _plain(text[start:end]) in _TITLE_WORDS:
        return None  # no title, or not the first one
    return after_title(text, begin, m.end())


def below_closing(text: str, begin: int, end: int) -> tuple[int, int] | None:
    m = _CLOSING_SIGN.match(text, end)
    if not m:
        return None
    at = m.end()
    if t := _TITLE.match(text, at):
        at = t.end()
    name = expand(text, at)
    if not name:
        return None
    whole = _reversed(text, name, True) or name
    if not _LINE_END.match(text, whole.end) and name.case == "lower" and not name.listed:
        return None
    return _settled(text, name, True, False)


def before_saying(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """A name that begins its sentence or line and ends right before the verb ``text[begin:end]``."""
    starts, at, comma = [], begin, False
    while True:
        stop = at
        while stop > 0 and text[stop - 1] in " \t\xa0\n#*/":
            stop -= 1
        if stop == at:
            break
        if stop and text[stop - 1] == "," and starts and not comma:
            comma, stop = True, stop - 1
        elif stop and text[stop - 1] == ".":
            if not (stop > 1 and text[stop - 2].isalpha() and (stop == 2 or not text[stop - 3].isalpha())):
                break  # only an initial's dot lies within a name
            stop -= 1
        start = stop
        while start > 0 and (text[start - 1].isalpha() or text[start - 1] in "'’-" and start < stop):
            start -= 1
        plain = _plain(text[start:stop])
        if start == stop or plain in STOPS or plain in _TITLE_WORDS or start and (text[start - 1].isdigit() or text[start - 1] in "_@"):
            break
        starts.append(start)
        at = start
    shouted = text[begin:end].isupper()
    line = text.rfind("\n", starts[-1], begin) if starts else -1
    # of a name broken over two lines, the part on the verb's line is no full name
    for at in sorted(starts, key=lambda x: (x <= line, x)):
        name = expand(text, at)
        if name:
            name = _reversed(text, name, False) or name
            if name.full > 1 and not text[name.end : begin].strip(" \t\xa0\n#*/,"):
                return _settled(text, name, False, shouted and name.case == "upper")
    return None


def around_given(text: str, begin: int, end: int) -> tuple[tuple[int, int] | None, int]:
    """A name that begins with the listed given name ``text[begin:end]``, or has it behind a comma; and how far was read."""
    word = text[begin:end]
    case = _case(word)
    if begin and text[begin - 1] in "@.+-_/'’" or text[end : end + 1] in ("-", "+") or case == "title" and not word[1:].islower():
        return None, end
    name = expand(text, begin)
    if not name or name.case == "lower":
        return None, end  # without a cue, nothing sets off a name in lower case
    if name.full > name.listed:
        return None if _ends_as_place(text, name.end) or not _outside(text, begin) else (begin, name.end), name.end
    return _surnames_before(text, begin, name), name.end


def _surnames_before(text: str, begin: int, given: Name) -> tuple[int, int] | None:
    """Surnames and a comma right before the listed given name(s)."""
    at = begin
    while at > 0 and text[at - 1] in " \t\xa0\n#*/":
        at -= 1
    if at == begin or at == 0 or text[at - 1] != ",":
        return None
    first = stop = at - 1
    while True:
        end = first
        while end > 0 and text[end - 1] in " \t\xa0":
            end -= 1
        if end == first and first != stop:
            break
        start = end
        while start > 0 and (text[start - 1].isalpha() or text[start - 1] in "'’-"):
            start -= 1
        word = text[start:end]
        plain = _plain(word)
        if len(_bare(word)) < 3 or plain in STOPS or plain in PLACES or plain in PARTICLES or plain in _given() or plain in _TITLE_WORDS or not _fits(word, given.case):
            break
        if start and (text[start - 1].isdigit() or text[start - 1] in "_@."):
            break
        if start == 0 or text[start - 1] in ".!?:\n\"'" or first == stop:
            first = start
        elif first != stop:
            break  # one surname, unless a phrase settles more
        if first == 0:
            break
    if first == stop or not _outside(text, first):
        return None
    return first, given.end


#: What each kind of cue asks of the text around it.
AFTER = {
    "field": after_field, "label": after_label, "phrase": after_phrase, "title": behind_title,
    "closing": below_closing, "saying": before_saying,
}
