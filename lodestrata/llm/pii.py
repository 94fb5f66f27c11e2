"""Finding personal information in free text and replacing it by typed placeholders.

Anchor expansion: one automaton over the lower-cased text finds at-signs, schemes
and the words that introduce identity numbers, addresses and persons, and given
names; from each anchor a local parser looks left and right for the whole item
and validates it.  Runs of digits are anchors too.  Invisible characters inside an
item don't hide it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.names import LEGAL, NICKNAMES, TRADES
from lodestrata.llm.quality import COMMON

TYPES = ("email", "phone", "id_number", "address", "name")

# What stands before identity numbers.
ID_CUES = """ssn|social security|national insurance|ni number|ni no|nino|passport|reisepass|passeport|pasaporte|driving licence|driving license|driver's license|drivers license|driver licence|führerschein|permis de conduire|permiso de conducir|
ausweisnummer|ausweisnr|personalausweis|ausweis-nr|steuer-id|steuer-identifikationsnummer|steueridentifikationsnummer|idnr|steuernummer|sozialversicherungsnummer|dni|nie|nif|documento nº|documento n.º|documento no|documento de identidad|
numéro de sécurité sociale|sécurité sociale|nir|carte d'identité|carte d’identité|identity card|identity number|id card|tax id|taxpayer|número de identidad|seguridad social""".replace("\n", "").split("|")
# What stands before numbers that identify no person.
THING_CUES = ("ticket", "build", "offset", "port", "trace", "commit", "order", "serial", "version", "release", "room", "slot", "sku", "isbn", "issue", "job", "host", "hash", "part", "run", "number", "no", "sum", "nummer", "numéro", "número")
# What stands before telephone numbers.
PHONE_CUES = ("tel", "tél", "phone", "call", "mobile", "text me", "reach", "rückruf", "anruf", "appel", "llama", "móvil", "handy", "fax", "whatsapp", "portable", "ring", "fon", "cell", "dial", "sms")
# Kinds of streets.
STREETS_EN = "street|st|avenue|ave|lane|ln|close|road|rd|blvd|boulevard|drive|dr|court|ct|place|square|terrace|crescent|way|gardens|grove|mews|parkway|highway"
STREETS_FR = "rue|avenue|av|bd|boulevard|chemin|place|impasse|allée|allee|quai|cours|route|square|sentier|passage"
STREETS_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|ufer|damm|tor|steig|pfad|hof|chaussee|markt"
STREETS_ES = "calle|c/|avda|avd|avenida|plaza|pza|paseo|camino|ronda|carrer|travesía|glorieta|urbanización"
# Words that persons stand behind: prepositions, greetings, verbs of dealing with somebody, and "is" of who somebody is.
PERSON_BEFORE = tuple("""with by from to for of and or according per via thanks cc attn hi hello dear hey ask asked tell told met meet meeting saw see contact contacted call called email emailed ping pinged thank invite invited name named is
mit von an bei für und oder laut danke hallo liebe lieber frag fragte traf sah kontakt ruf anruf name heißt ist
avec par de à chez pour et ou selon après merci bonjour cher chère demande vu rencontré contacter appeler nom est
con por para y o según gracias hola querido querida pregunta vio contactar llamar nombre es""".split())
# What persons do; stands behind them.
PERSON_AFTER = tuple("""said says wrote writes signed asked told called sent replied thinks wants works joined left agreed has is will
sagte schrieb unterschrieb fragte rief schickte meint hat ist war will
dit écrit signé demandé appelé envoyé est était veut
dijo escribió firmó preguntó llamó envió ha era quiere""".split())
TITLES = "dr|mr|mrs|ms|prof|ing|herr|frau|mme|mlle|monsieur|madame|sr|sra|señor|señora|doña|dipl"

_AMBIGUOUS = frozenset("will don dot may mark art pat sue bill max al ed em fi mo jo ant rich rick dan rob ray dick drew kit hank jack john tim dom ling wolf ring len red ned gail babs carrie".split())
_ACCENTED = {"jose": "josé", "etienne": "étienne", "francoise": "françoise", "veronique": "véronique", "vero": "véro", "malgorzata": "małgorzata", "malgosia": "małgosia", "bjorn": "björn", "soren": "søren", "stanislaw": "stanisław", "ngozi": "ngọzi"}
GIVEN = {w for full, short in NICKNAMES.items() for w in (full, *short.split())} | set(_ACCENTED.values())
_FULL = set(NICKNAMES) | set(_ACCENTED.values())

_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BLANKS = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000]")
_EMAIL_LEFT = re.compile(r"(?:[\w+%-]+(?:\s+dot\s+|\s*[(\[{]dot[)\]}]\s*|\.))*[\w+%-]+\s{0,2}$", re.I)
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|punkt|point|punto)\s*[)\]}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_EMAIL_RIGHT = re.compile(rf"\s{{0,2}}((?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+[^\W\d_]{{2,24}})(?![\w@])", re.I)
_DIGITS = re.compile(r"(?<![\w.,@/#])(?:\(?\+ ?)?\(?\d[\d \t().\-/]{5,24}\d(?![\w@])")
_LONG_NUMBER = re.compile(r"\d(?:[ \t().\-/]{0,4}\d){5}")
_GROUPS = re.compile(r"\d+")
_ID_VALUE = re.compile(r"(?:\s*(?:number|nummer|numéro|número|no\.?|nr\.?|n[º°o]\.?|#|:|=|\.|is|ist|est|es|lautet|card|\(us\)|\"|'|’|“)){0,5}\s*([A-Za-z0-9](?:[ .\-/]?[A-Za-z0-9]){4,24})(?![A-Za-z0-9])", re.I)
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d](?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![\w/+=.-])[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?(?![\w/+=])")
_CARD = re.compile(r"(?<![\w.-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\w-])|(?<![\w.-])3\d{3}([ -])\d{6}\2\d{5}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_DNI = re.compile(r"(?<![\w-])(\d{8})[\s-]?([A-Za-z])(?![\w])")
_WORDS_EN = r"(?:(?:North|South|East|West|N|S|E|W|Old|New|Upper|Lower|St)\.?\s+)?[^\W\d_][^\W\d_'’-]+(?:\s[^\W\d_]{3,})?"
_ADDRESS = (
    re.compile(rf"(?<![\w.#-])(?:(?:Flat|Apt|Unit|Suite)\.?\s*\w+,\s*)?\d{{1,5}}[A-Za-z]?,?\s+(?P<mid>{_WORDS_EN})\s+(?:{STREETS_EN})\b\.?(?:,?\s+(?:Apt|Suite|Flat|Unit|Floor)\.?\s*\w+)?", re.I),
    re.compile(rf"(?<![\w.#-])\d{{1,5}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s+(?:{STREETS_FR})\.?\s+(?:(?:de\s+la|du|des|de)\s+|(?:de\s+l|d|l)['’])?(?P<mid>[^\W\d_]{{3,}})(?:,\s*\d{{5}}\s+[^\W\d_]+)?", re.I),
    re.compile(rf"(?<![\w-])(?:(?:Am|An der|Auf der|Zum|Zur)\s)?(?P<mid>(?:[^\W\d_]+-)*[^\W\d_]{{2,}}(?:{STREETS_DE})|[^\W\d_]{{3,}}[\s-](?:Allee|Straße|Strasse|Str\.|Platz|Weg|Ring))\s*\d{{1,4}}(?:\s?[a-z])?(?![\w.]\d)(?:,\s*\d{{5}}\s+[^\W\d_]+)?", re.I),
    re.compile(rf"(?<![\w-])(?:{STREETS_ES})\.?\s*(?:(?:de\s+la|de\s+los|del|de|la)\s+)?(?P<mid>[^\W\d_]{{3,}}(?:\s[^\W\d_]{{3,}})?)\s*,?\s*(?:n[º°o.]+\s*)?\d{{1,4}}\b(?:,\s*\d{{1,2}}[º°ª]?\s?[A-Za-z]?\b)?", re.I),
)
_TITLED = re.compile(rf"(?<![\w.])(?:{TITLES})\b\.?\s+(?:(?:{TITLES})\b\.?\s+){{0,3}}(?P<who>[^\W\d_][^\W\d_'’-]{{2,}}(?:\s[^\W\d_][^\W\d_'’-]{{2,}})?)", re.I)
_INITIAL = re.compile(r"(?<![\w.@&'’-])(?P<letter>[^\W\d_])\.\s?(?:[^\W\d_]\.\s?)?(?P<who>[^\W\d_][^\W\d_'’-]{2,})(?![\w@])")
_PARTICLE = r"(?:(?:de la|de|del|della|di|da|van der|van den|van|von der|von|bin|al|el|la|le|ter) )"
_SHAPED = re.compile(rf"([^\W\d_][^\W\d_'’-]+) (?:[^\W\d_]\. )?{_PARTICLE}?([^\W\d_][^\W\d_'’-]+)(?![\w@])")
_UPPER = "A-Z\u00c0-\u00d6\u00d8-\u00de" + "".join(chr(c) for c in range(0x100, 0x180) if chr(c).isupper())
_CAPITALS = re.compile(rf"(?<![\w@/.'’-])[{_UPPER}](?:['’-]?[^\W\d_])+ (?=(?:[^\W\d_]\. )?{_PARTICLE}?[{_UPPER}])")
_MORE = re.compile(r" ?(?:,|&|and|or|und|oder|et|ou|y|o) ")
_WORD_BEHIND = re.compile(r"[\s,*_`\"“”]*([^\W\d_]+)")
_WORD_AHEAD = re.compile(r"([^\W\d_’']+)[\s:,*_`\"“„]*$")
_NEXT = re.compile(r"[\s*_`]{1,3}(?:[\"“„«(][^\W\d_]+[\"”“»)]\s+)?(?:[^\W\d_]\.\s?)?([^\W\d_][^\W\d_'’-]{2,})(?![\w@])")
_BEFORE = re.compile(r"(?<![\w@.])([^\W\d_][^\W\d_'’-]{2,})(,?)[\s*_`]{1,3}$")

# Ordinary words that stand beside given names in running text.
_NO_FAMILY = frozenset("""about also team group project release theme themes channel branch server layer file folder contact phone email mail address home name please careful version roughly signed wrote said says sent asked told called
yesterday today tomorrow thanks danke merci gracias hello hallo bonjour hola dear monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
spoke owner task according nothing laut según tel tél call text new copy send replies merci bitte escribe rappel""".split())


_THING_SET = frozenset(THING_CUES)
_BEFORE_SET, _AFTER_SET = frozenset(PERSON_BEFORE), frozenset(PERSON_AFTER)
# What names that aren't a person's are made of, besides words for firms.
_THINGS = frozenset("""project team theme group release channel branch server layer file folder board plan report note street avenue road lane square park lake river bridge tower hill valley north south east west new old san saint los las
university college school hospital institute bank museum club church hotel station airport city county island office department committee council agency ministry summit conference meeting review sprint workshop week day monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo
projekt gruppe thema projet équipe thème groupe proyecto equipo tema grupo""".split()) | frozenset(w for full, short in TRADES.items() for w in (full, *short.split())) | LEGAL


def _caseless(text: str, start: int, end: int) -> bool:
    """Whether the surroundings have no mixture of cases that could mean anything."""
    part = text[max(0, start - 60) : end + 60]
    return part == part.lower() or part == part.upper()


def _edge(text: str, start: int, end: int) -> bool:
    """Whether [start, end) isn't the inside of a longer word, address or handle."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] in "@.+/#&-_" and not (text[start - 1] in "_-./" and (start < 2 or not text[start - 2].isalnum())))) and not (end < len(text) and (text[end].isalnum() or text[end] in "@+" or (text[end] in "._-" and end + 1 < len(text) and text[end + 1].isalnum())))


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()

    def add(words, kind: str) -> None:
        for w in words:
            kinds = found.get(w, ())
            found.add_word(w, (*kinds, (kind, len(w))))

    add(("@", "＠", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]"), "at")
    add((" at ",), "at word")
    add(ID_CUES, "id")
    add(GIVEN, "given")
    add((f"{x}" for x in ("street", "avenue", "lane", "close", "road", "blvd", " st", " ave", " rd", " dr", "drive", "court", "place", "square", "terrace", "crescent", " way", "gardens", "grove", "mews", "parkway", "highway", "boulevard")), "street")
    add((f" {x}" for x in STREETS_FR.split("|")), "street fr")
    add((*(x.replace("\\", "") for x in STREETS_DE.split("|")),), "street de")
    add((x for x in STREETS_ES.split("|")), "street es")
    add((f"{t}{e}" for t in TITLES.split("|") for e in (". ", " ")), "title")
    found.make_automaton()
    return found


def _email(text: str, low: str, start: int, end: int, bare: bool) -> tuple[int, int] | None:
    """The address around an at-sign at [start, end)."""
    right = _EMAIL_RIGHT.match(text, end)
    if right is None or (bare and " dot " not in low[right.start() : right.end()] and "dot" not in low[right.start() : right.end()]):
        return None
    low_end = start
    while low_end and start - low_end < 254 and text[low_end - 1] != "\n":  # no address is longer than 254 characters
        low_end -= 1
    left = _EMAIL_LEFT.search(text, low_end, start)
    if left is None or not left[0].strip():
        return None
    first = left.start()
    while first < start and text[first] in " .+%-_":
        first += 1
    local = text[first:start].strip()
    if not local or (local.lower() == "git" and text[right.end() : right.end() + 1] == ":"):
        return None
    if not local[0].isalnum():
        return None
    return first, right.end()


def _phone(text: str, low: str, start: int, end: int) -> bool:
    value = text[start:end]
    groups = _GROUPS.findall(value)
    digits = "".join(groups)
    n = len(digits)
    if not 7 <= n <= 16 or "\n" in value:
        return False
    before = low[max(0, start - 26) : start]
    cut = max(before.rfind(x) for x in ".;|\n")
    near = before[cut + 1 :]
    if _word_ahead(near, len(near)) in _THING_SET or near.rstrip(" :#=-").endswith(THING_CUES):
        return False
    if re.fullmatch(r"\d{4}-\d\d-\d\d.*|\d{1,3}(\.\d{1,3}){3}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}\.\d{1,2}\.\d{1,2}", value) and not value.startswith("+"):
        return False
    cued = any(c in before for c in PHONE_CUES)
    if value.lstrip("( ").startswith("+"):
        return n >= 8
    if digits.startswith("00") and n >= 10:
        return True
    if len(groups) == 1:
        return cued and n >= 8 or (digits.startswith("0") and 10 <= n <= 11 and cued)
    if digits.startswith("0") and 9 <= n <= 13:
        return True
    sizes = [len(g) for g in groups]
    if sizes in ([3, 3, 4], [1, 3, 3, 4]) and (n == 10 or digits[0] == "1"):
        return True
    if sizes == [3, 3, 3]:
        return cued or low[start - 1 : start] in ("|", "\t", '"') or text[end : end + 1] in ("|", "\t", '"')
    if sizes == [3, 4]:
        return cued
    return cued and n >= 8


def _iban(value: str) -> bool:
    """Whether letters and digits are an international account number by its check digits."""
    v = re.sub(r"[\s-]", "", value).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _card(value: str) -> bool:
    """Whether digits are a card number by length, first digit and check digit."""
    d = [int(c) for c in value if c.isdigit()]
    return 13 <= len(d) <= 19 and d[0] in (3, 4, 5, 6) and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def _id_spans(text: str, low: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for start, end in cues:
        if (start and text[start - 1].isalnum()) or (end < len(text) and low[end].isalpha() and not low.startswith(("number", "nummer", "nr"), end)):
            continue
        m = _ID_VALUE.match(text, end)
        if m:
            value, stop = m[1], m.end(1)
            # A following word isn't part of the number: cut behind the last digit, a single check letter may follow.
            last = max((i for i, c in enumerate(value) if c.isdigit()), default=-1)
            tail = re.match(r"[\s-]?[A-Za-z](?![A-Za-z])", value[last + 1 :])
            stop = m.start(1) + last + 1 + (tail.end() if tail else 0)
            core = text[m.start(1) : stop]
            runs = re.split(r"[\s.\-/]+", core)
            if sum(c.isdigit() for c in core) >= 5 and all(any(c.isdigit() for c in r) or len(r) <= 2 for r in runs):
                yield m.start(1), stop
                continue
        back = re.search(r"([A-Za-z]{0,2}\s?\d[\dA-Za-z\s-]{5,16})\s*\(\s*$", text[max(0, start - 30) : start])
        if back and sum(c.isdigit() for c in back[1]) >= 5:
            yield max(0, start - 30) + back.start(1), max(0, start - 30) + back.end(1)


def _plausible_family(word: str, given: str, caseless: bool) -> bool:
    low = word.lower()
    if low in COMMON or low in _NO_FAMILY:
        return False
    if word[0].isupper() or caseless:
        return True
    return given.islower() and given in _FULL and len(given) >= 5


def _name_at(text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
    """The full name around a given name at [start, end)."""
    given = low[start:end]
    caseless = _caseless(text, start, end)
    if not _edge(text, start, end):
        return None
    shown = text[start].isupper()
    if given in _AMBIGUOUS and (not shown or caseless):
        return None
    right = _NEXT.match(text, end)
    if right and "\n" in text[end : right.start(1)] and re.search(r"[^\W\d_]{3,}, $", text[max(0, start - 40) : start]):
        right = None  # "Family, Given" ends the line
    if right and _plausible_family(right[1], text[start:end], caseless and given not in _AMBIGUOUS) and "\n\n" not in right[0]:
        return start, right.end()
    left = _BEFORE.search(text, max(0, start - 40), start)
    if left and given not in _AMBIGUOUS:
        word = left[1].lower()
        if word not in COMMON and word not in _NO_FAMILY and (left[1][0].isupper() or (caseless and left[2])) and (left[2] or (shown and not _starts_sentence(text, left.start()))):
            return left.start(), end
    if given in _FULL and shown and given not in _AMBIGUOUS and len(given) >= 5:
        if _introduced(low, start, end):
            return start, end
    return None


def _word_ahead(low: str, at: int) -> str:
    """The word that ends before ``at``."""
    m = _WORD_AHEAD.search(low, max(0, at - 32), at)
    return m[1] if m else ""


def _word_behind(low: str, at: int) -> str:
    """The word that begins behind ``at``; behind the French auxiliary the one after it."""
    m = _WORD_BEHIND.match(low, at, at + 40)
    if m and m[1] == "a":
        m = _WORD_BEHIND.match(low, m.end(), m.end() + 40) or m
    return m[1] if m else ""


def _introduced(low: str, start: int, end: int) -> bool:
    """Whether the words beside [start, end) are such as stand beside persons."""
    return _word_ahead(low, start) in _BEFORE_SET or _word_behind(low, end) in _AFTER_SET


def _shaped_names(text: str, low: str, at: int) -> Iterator[tuple[int, int]]:
    """Given and family names by their shape behind a word at ``at`` that persons stand behind, and those listed with it."""
    while True:
        m = _SHAPED.match(text, at, at + 80)
        if m is None or not all(w[0].isupper() and w[1:].islower() and len(w) > 1 for w in m.groups()):
            return
        if text.startswith(":", m.end()) or any(w in COMMON or w in _NO_FAMILY or w in _THINGS for w in map(str.lower, m.groups())) or _word_behind(low, m.end()) in _THINGS or _SHAPED.match(text, m.start(2), m.start(2) + 80) and text[m.end() + 1 : m.end() + 2].isupper():
            return
        yield m.start(), m.end()
        more = _MORE.match(text, m.end(), m.end() + 12)
        if more is None:
            return
        at = more.end()


def _starts_sentence(text: str, at: int) -> bool:
    before = text[:at].rstrip()
    return not before or before[-1] in ".!?:;|\n"


def _without_given(text: str, low: str, m: re.Match) -> bool:
    """Whether an initial and a word are a person: by the word's shape and what is around."""
    word = m["who"]
    if word.lower() in COMMON or word.lower() in _NO_FAMILY:
        return False
    before = low[max(0, m.start() - 24) : m.start()].rstrip(" *_`")
    after = low[m.end() : m.end() + 24].lstrip(" ,*_`")
    if re.search(r"\d[\s-]*$", before) or re.search(r"[º°]\s*$", before):
        return False
    if _introduced(low, m.start(), m.end()):
        return True
    alone = (not before or before[-1] in "|>\"=:") and (not after or after[0] in "|<\"")
    return alone and m["letter"].isupper() and word[0].isupper()


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """Disjoint spans ``(start, end, type)`` in order, in the text as :func:`readable` gives it."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int, str]] = []
    ids, given, streets, titled = [], [], [], False
    for stop, kinds in _anchors().iter(low):
        for kind, size in kinds:
            start, end = stop + 1 - size, stop + 1
            if kind == "given":
                given.append((start, end))
            elif kind in ("at", "at word"):
                if found := _email(text, low, start, end, kind == "at word"):
                    spans.append((*found, "email"))
            elif kind == "id":
                ids.append((start, end))
            elif kind == "title":
                titled = True
            else:
                streets.append((start, end, kind))
    spans += [(a, b, "id_number") for a, b in _id_spans(text, low, ids)]
    # All numbers of persons and telephones have six digits with little between them.
    numbers = _LONG_NUMBER.search(text) is not None
    if numbers:
        spans += [(m.start(), m.end(), "id_number") for m in _NINO.finditer(text)]
        spans += [(m.start(), m.end(), "id_number") for m in _SSN.finditer(text) if _word_ahead(low, m.start()) not in _THING_SET]
        spans += [(m.start(), m.end(), "id_number") for m in _IBAN.finditer(text) if _iban(m[0])]
        spans += [(m.start(), m.end(), "id_number") for m in _CARD.finditer(text) if _card(m[0])]
        spans += [(m.start(), m.end(), "id_number") for m in _DNI.finditer(text) if "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1]) % 23] == m[2].upper()]
    if streets and any(map(str.isdigit, text)):
        done = -1
        for start, end, kind in streets:
            which = {"street": 0, "street fr": 1, "street de": 2, "street es": 3}[kind]
            base = max(0, start - 48)
            for m in _ADDRESS[which].finditer(text, base, min(len(text), end + 40)):
                if m.end() < end and which != 3 or m.start() > end or m.end() <= done:
                    continue
                if _is_address(text, m, which):
                    spans.append((m.start(), m.end(), "address"))
                    done = m.end()
    if numbers:
        taken = _covered([(a, b) for a, b, k in spans if k in ("id_number", "email")])
        for m in _DIGITS.finditer(text):
            if not taken(m.start(), m.end()) and _phone(text, low, m.start(), m.end()):
                spans.append((m.start(), m.end(), "phone"))
    mail, place = _covered([(a, b) for a, b, k in spans if k == "email"]), _covered([(a, b) for a, b, k in spans if k == "address"])
    names = []
    for start, end in given:
        if not mail(start, start + 1) and (found := _name_at(text, low, start, end)):
            names.append(found)
    if titled:
        for m in _TITLED.finditer(text):
            word = m["who"].split()[0]
            if word.lower() not in COMMON and word.lower() not in _NO_FAMILY and (word[0].isupper() or _caseless(text, m.start(), m.end())) and not place(m.start(), m.start() + 1):
                names.append((m.start(), m.start("who") + len(word)))
    if ". " in text or "." in text:
        for m in _INITIAL.finditer(text):
            if _without_given(text, low, m) and not mail(m.start(), m.start() + 1):
                names.append((m.start(), m.end()))
    done = 0
    for m in _CAPITALS.finditer(text):
        at = m.start()
        if at < done:
            continue
        if _word_ahead(low, at) in _BEFORE_SET:
            found = list(_shaped_names(text, low, at))
        else:
            shape = _SHAPED.match(text, at, at + 80)
            told = shape and _word_behind(low, shape.end()) in _AFTER_SET and not (_starts_sentence(text, at) and shape[1].lower() not in GIVEN)
            found = list(_shaped_names(text, low, at))[:1] if told else []
        names += found
        done = found[-1][1] if found else 0
    spans += [(a, b, "name") for a, b in names]
    return _disjoint(spans)


def _is_address(text: str, m: re.Match, which: int) -> bool:
    middle = m["mid"]
    words = middle.split()
    caseless = _caseless(text, m.start(), m.end())
    if any(w.lower() in COMMON for w in words if w.lower() not in ("new", "old")):
        return False
    if which == 2:
        return (middle[0].isupper() or caseless) and not re.search(r"[.,]\d", text[m.end() : m.end() + 2])
    if caseless:
        return which != 0 or len(words) <= 2
    return all(w[0].isupper() for w in words)


def _covered(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether [a, b) overlaps one of some spans, by bisection."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def over(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and merged[i - 1][1] > a

    return over


def _disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlaps go to the type that comes first in order of certainty; overlapping spans of a type are joined."""
    kept: list[tuple[int, int, str]] = []
    for kind in ("email", "id_number", "address", "phone", "name"):
        over = _covered([(a, b) for a, b, _ in kept])
        joined: list[list[int]] = []
        for a, b in sorted({(a, b) for a, b, k in spans if k == kind and not over(a, b)}):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        kept += [(a, b, kind) for a, b in joined]
    return sorted(kept)


def readable(text: str) -> str:
    """The text as spans count in: composed, without invisible characters, with plain spaces."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    return _BLANKS.sub(" ", _UNSEEN.sub("", text))


def redact(text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]``, and the spans."""
    if not text:
        return text, []
    clean = readable(text)
    spans = find_pii(clean)
    if not spans:
        return text, []
    out, at = [], 0
    for a, b, kind in spans:
        out += [clean[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + clean[at:], spans


def redact_texts(records: DataFrame, with_text: bool = True) -> DataFrame:
    """src_field, row_id, types (distinct, sorted), n_items and the redacted text of ``records``.

    ``records``: src_field, row_id, text.  Null and empty texts stay as they are,
    without types; texts without a find stay byte for byte; rows repeat as given.
    Without ``with_text`` the texts stay in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [redact(t) for t in b.column("text").to_pylist()]
            types = pa.array([sorted({k for _, _, k in spans}) for _, spans in done], pa.list_(pa.string()))
            counts = pa.array([len(spans) for _, spans in done], pa.int32())
            columns, names = [b.column("src_field"), b.column("row_id"), types, counts], ["src_field", "row_id", "types", "n_items"]
            if with_text:
                columns.append(pa.array([t for t, _ in done], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "src_field string, row_id long, types array<string>, n_items int" + (", text string" if with_text else "")
    return records.select("src_field", F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
