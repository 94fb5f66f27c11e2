"""Reading one typed name: what it names, its parts, its phonetic codes, and how like it is to another."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Short, pet and other-language forms, by the full given name.
NICKNAMES = {
    "abdullah": "abdallah abdul", "abigail": "abby gail abbie", "agnieszka": "aga agnes", "alexander": "alex sandy sasha xander al", "alexandra": "alex sandra sasha", "anastasia": "nastya stasya ana",
    "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny", "bjorn": "bjoern", "caroline": "carrie caro", "catherine": "cathy kate cat", "charles": "charlie chuck chas",
    "christina": "tina chris", "christopher": "chris kit topher", "chukwuemeka": "emeka", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya dmitry", "dolores": "lola",
    "dominique": "dom domi", "donald": "don donny", "dorothy": "dot dolly", "edward": "eddie ted ed ned", "ekaterina": "katya katja", "elizabeth": "lizzie liz beth eliza betty", "emily": "em emmy", "enrique": "kike quique",
    "etienne": "eti", "fiona": "fi", "francisco": "paco pancho fran", "francoise": "fran", "frederick": "fred freddie", "friederike": "friedi rike", "gabriel": "gabe gabi", "george": "georgie", "gerald": "gerry jerry",
    "gregory": "greg", "guadalupe": "lupe", "guillaume": "gui", "haruka": "haru", "helena": "lena nell", "henry": "harry hank", "hussein": "hossein husayn hussain", "ignacio": "nacho", "ingeborg": "inge", "isabella": "bella izzy isa",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes jo hans", "john": "johnny jack", "jonathan": "jon jonny", "joseph": "joe joey jo", "jose": "pepe", "joshua": "josh", "katharina": "kathi rina kati",
    "katherine": "kate kathy katie kat", "kenichi": "ken", "kenneth": "ken kenny", "lakshmi": "laxmi", "lawrence": "larry laurie", "leonard": "len leo lenny", "magdalena": "lena magda", "malgorzata": "gosia malgosia", "margaret": "maggie meg peggy marge",
    "matthew": "matt matty", "maximilian": "max maxi", "mercedes": "merche", "michael": "mick mike mickey", "mikhail": "misha", "mohammed": "mo muhammad mohamed", "nathaniel": "nat nate", "ngozi": "ngozi", "nicholas": "nick nico nicky",
    "olena": "lena olya", "oluwaseun": "seun", "padraig": "paddy", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "priyanka": "priya", "quentin": "quent", "rebecca": "becca becky", "richard": "dick rich rick",
    "robert": "bob bobby rob robbie", "rosario": "charo", "samuel": "sam sammy", "sebastian": "basti seb", "soren": "soeren", "stanislaw": "stan staszek", "stephen": "steve", "susan": "sue susie suzy", "tatiana": "tanya", "theodore": "teddy theo ted",
    "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli", "ursula": "ursel uschi", "venkatesh": "venkat venky", "veronique": "vero", "victoria": "tori vicky", "vladimir": "volodya vova", "walter": "wally walt", "william": "bill liam will billy",
    "wolfgang": "wolf wolfi", "xiaoling": "ling", "yevgenia": "zhenya", "yusuf": "joseph yousef", "zachary": "zach zack", "zeynep": "zeyno",
}
# Words for what a firm does or is, with their usual short forms.
TRADES = {
    "analytics": "anal", "associates": "assoc", "brothers": "bros", "company": "", "consulting": "cons", "department": "dept", "development": "dev", "engineering": "eng", "financial": "fin", "group": "grp", "house": "",
    "industries": "ind", "institute": "inst", "insurance": "ins", "international": "intl", "laboratories": "labs lab", "logistics": "log", "management": "mgmt mgt", "manufacturing": "mfg", "medical": "med", "publishing": "publ pub",
    "research": "res", "services": "svcs svc serv", "software": "sw", "solutions": "soln", "store": "", "systems": "sys", "technologies": "tech", "transport": "transp trans", "university": "univ uni", "bank": "", "holdings": "hldgs", "partners": "",
    "foundation": "fdn", "hospital": "hosp", "media": "", "energy": "", "foods": "", "ventures": "", "capital": "", "studios": "",
}
# Words of trades that name ordinary things as well.
WEAK_TRADES = frozenset("logistics store house group research services systems software media energy capital foods development transport company".split())
# Legal forms, dots left out, and words that mean nothing in a firm's name.
LEGAL = frozenset("llc ltd limited inc incorporated gmbh gesmbh ag aktiengesellschaft sa societe anonyme bv co corp corporation plc kg srl oy ab pty llp sarl spa nv kgaa sl".split())
FILLERS = frozenset("the and & und et y of de".split())
# Titles before and after names, and notes people add to contacts.
TITLES = frozenset("dr mr ms mrs miss prof professor ing sir dipl phd md jr sr herr frau mme m. mlle sra don dona señor senor senora hr fr team work private home office".split())

_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_QUOTED = re.compile("[\"“”„«»]([^\"“”„«»]*)[\"“”„«»]")
_PARENS = re.compile(r"\([^)(]{0,200}\)|\[[^\]\[]{0,200}\]")
_HANDLE = re.compile(r"@?([^\W\d_]{2,})[._]([^\W\d_]{2,})\d*")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z]{2})(?=[A-Z][^\W\d_A-Z]{2})")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def folded(text: str) -> str:
    """Lower case, without marks; Scandinavian, Polish and German letters as their plain ones."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def plain(word: str) -> str:
    """A folded word with ae, oe and ue as a, o and u, as those stand for letters with two dots."""
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


FORMS: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _word in {_full, *_short.split()}:
        FORMS[plain(_word)] = FORMS.get(plain(_word), frozenset()) | {plain(_full)}
FULL = frozenset(map(plain, NICKNAMES))
TRADE = {w: full for full, short in TRADES.items() for w in (full, *short.split())}

#: Words from this length on may differ by two slips.
TWO_SLIPS = 8

_CLASS = {c: str(n) for n, cs in enumerate(("bpfv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """The classes of a word's consonants in order, without vowels and doubled letters."""
    out, last = "", ""
    for c in word:
        k = _CLASS.get(c, "")
        if k and k != last:
            out += k
        last = k
    return out


@lru_cache(maxsize=200_000)
def with_slack(code: str, slips: int = 1) -> frozenset[str]:
    """What is left of a code after some slips: words so many slips apart share one of these.

    A slip adds, drops, changes or swaps a class, or parts two equal ones (565 and 5).
    """
    out = {code}
    for _ in range(slips):
        out |= {c[:i] + c[i + 1 :] for c in out for i in range(len(c))} | {c[:i] + c[i + 2 :] for c in out for i in range(len(c) - 2) if c[i] == c[i + 2]}
    return frozenset(out)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    span = max(0, max(la, lb) // 2 - 1)
    hit_b = [False] * lb
    seq_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - span), min(lb, i + span + 1)):
            if not hit_b[j] and b[j] == c:
                hit_b[j] = True
                seq_a.append(c)
                break
    m = len(seq_a)
    if not m:
        return 0.0
    seq_b = [c for c, h in zip(b, hit_b) if h]
    swaps = sum(x != y for x, y in zip(seq_a, seq_b)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            fresh.append(v)
        before, row = row, fresh
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


def within(a: str, b: str, most: int) -> bool:
    """Whether ``edits`` are at most ``most``, mostly without counting them."""
    if abs(len(a) - len(b)) > most or len(set(a) - set(b)) > most or len(set(b) - set(a)) > most:
        return False
    if most > 1:
        return edits(a, b, most) <= most
    i, j, k = 0, len(a), len(b)
    while i < min(j, k) and a[i] == b[i]:
        i += 1
    while min(j, k) > i and a[j - 1] == b[k - 1]:
        j, k = j - 1, k - 1
    return max(j, k) - i <= 1 or (j == k == i + 2 and a[i] == b[i + 1] and a[i + 1] == b[i])


@dataclass(frozen=True)
class Name:
    """kind: person (two words), initial (a letter and a word), family (a title and a word), firm (trade, rest), thing, or none."""

    kind: str
    parts: tuple[str, ...]
    legal: bool = field(default=False, compare=False)

    @property
    def key(self) -> str:
        return self.kind + ":" + "|".join(self.parts)


@lru_cache(maxsize=50_000)
def trade_of(word: str) -> str | None:
    """The trade a word means, one slip in a long word allowed."""
    if word in TRADE:
        return TRADE[word]
    if len(word) >= 6:
        for full in TRADES:
            if abs(len(full) - len(word)) <= 1 and edits(word, full, 1) <= 1:
                return full
    return None


def read_name(text: str | None) -> Name:
    """The parts of a typed name, in an order that doesn't depend on how it was typed."""
    if text is None or not text.strip():
        return Name("none", ())
    text = unicodedata.normalize("NFKC", _QUOTED.sub(" ", _PARENS.sub(" ", text))).strip()
    firm = _firm(text)
    if firm is not None:
        return firm
    handle = _HANDLE.fullmatch(text)
    if handle:
        text = f"{handle[1]} {handle[2]}"
    before, comma, after = text.partition(",")
    if comma and after.strip():
        text = f"{after} {before}"
    words = [folded(w) for w in _WORD.findall(text)]
    if words and words[0] == "project":
        return Name("thing", tuple(words))
    titled = any(w in TITLES for w in words)
    words = [w.replace("'", "").replace("’", "") for w in words if w not in TITLES]
    long = [w for w in words if len(w) > 1]
    short = [w for w in words if len(w) == 1]
    if len(long) >= 2:
        return Name("person", tuple(sorted((long[0], long[-1]))))
    if len(long) == 1 and short:
        return Name("initial", (short[0], long[0]))
    if len(long) == 1 and titled:
        return Name("family", (long[0],))
    return Name("thing" if long else "none", tuple(words))


def _firm(text: str) -> Name | None:
    words = [folded(w) for w in re.split(r"[\s,/_-]+", _CAMEL.sub(" ", text.replace("'", "").replace("’", ""))) if w]
    words = [w.replace(".", "") for w in words]
    trades, rest, legal = [], [], False
    for w in words:
        if not w or w in FILLERS:
            continue
        if w in LEGAL:
            legal = True
            continue
        trade = trade_of(w)
        if trade:
            trades.append(trade)
        else:
            rest.append(w)
    if rest and (trades or (legal and len(words) > 2)):
        return Name("firm", (" ".join(sorted(set(trades))), " ".join(sorted(rest))), legal)
    return None


def certainty(name: Name) -> int:
    """How much the spelling alone speaks for a person or firm: 3 (as much as three types), 2, 1 or 0."""
    if name.kind == "firm":
        return 3 if name.legal or not WEAK_TRADES.issuperset(name.parts[0].split()) else 1
    if name.kind == "person":
        return 3 if any(map(forms, name.parts)) else 0
    return {"family": 2, "initial": 1}.get(name.kind, 0)


@lru_cache(maxsize=200_000)
def letters(word: str) -> int:
    """A bit for each letter that occurs, another for each that occurs twice.

    A slip takes away one bit at most and adds one at most.  The letter e has none,
    as ``plain`` leaves some out.
    """
    once = twice = 0
    for c in word:
        if c != "e" and "a" <= c <= "z":
            bit = 1 << (ord(c) - 97)
            twice |= once & bit
            once |= bit
    return once | twice << 26


def imaged_blocks(name: Name) -> set[tuple[str, int]]:
    """The blocks of a name, each with the letters of the words that it stands for."""
    if name.kind == "firm":
        trade, rest = name.parts
        return {(f"f:{trade}:{c}", letters(rest)) for c in with_slack("".join(sound(w) for w in rest.split()), 2 if len(rest) >= TWO_SLIPS else 1)}
    if name.kind == "person":
        out = set()
        long = [max(len(p), len(plain(p))) >= TWO_SLIPS for p in name.parts]
        for x in forms(name.parts[0]) | {name.parts[0]}:
            for y in forms(name.parts[1]) | {name.parts[1]}:
                a, b, image = sound(x), sound(y), letters(x + y)
                # A slip in each part, or two in one long part beside the same other.
                both = [(p, q) for p in with_slack(a) for q in with_slack(b)]
                twice = [(p, b) for p in with_slack(a, 2)] if long[0] else []
                twice += [(a, q) for q in with_slack(b, 2)] if long[1] else []
                for p, q in both + twice:
                    out.add(("p:" + ":".join(sorted((p, q))), image))
        return out
    if name.kind == "initial":
        return {(f"i:{name.parts[0]}:{c}", letters(name.parts[1])) for c in with_slack(sound(name.parts[1]))}
    if name.kind == "family":
        return {(f"n:{c}", letters(name.parts[0])) for c in with_slack(sound(name.parts[0]))}
    return set()


def blocks(name: Name) -> set[str]:
    """Names that may mean the same person or firm share one of these."""
    return {b for b, _ in imaged_blocks(name)}


def short_blocks(name: Name) -> set[tuple[str, int]]:
    """What initials and family names alone that may mean this person share with it, with the family name's letters."""
    if name.kind != "person":
        return set()
    out = set()
    for given, family in (name.parts, name.parts[::-1]):
        for c in with_slack(sound(family)):
            out |= {(b, letters(family)) for b in (f"n:{c}", *(f"i:{g[0]}:{c}" for g in forms(given) | {given}))}
    return out


@lru_cache(maxsize=200_000)
def forms(word: str) -> frozenset[str]:
    """The full given names a word may stand for."""
    return FORMS.get(plain(word), frozenset())


def same_word(a: str, b: str, slips: int = 1) -> bool:
    """The same word but for some slips; more than one only in long words."""
    if a == b or plain(a) == plain(b):
        return True
    shorter = min(len(a), len(b))
    if shorter < 4:
        return False
    most = slips if shorter >= TWO_SLIPS else 1
    if not within(a, b, most) and not within(plain(a), plain(b), most):
        return False
    return max(jaro_winkler(a, b), jaro_winkler(plain(a), plain(b))) >= (0.8 if slips == 1 else 0.85)


@lru_cache(maxsize=200_000)
def same_given(a: str, b: str) -> bool:
    x, y = forms(a), forms(b)
    if x and y:
        return bool(x & y)
    return same_word(a, b) or any(same_word(p, b) for p in x) or any(same_word(a, q) for q in y)


def same_name(a: Name, b: Name) -> bool:
    """Whether two names of one kind are spellings of one."""
    if a.kind != b.kind:
        return False
    if a.kind == "firm":
        # Endings tell firms of one root apart, so two slips are allowed before them only.
        slips = 2 if a.parts[1][-2:] == b.parts[1][-2:] else 1
        return a.parts[0] == b.parts[0] and same_word(a.parts[1], b.parts[1], slips)
    if a.kind == "person":
        (p, q), (r, s) = a.parts, b.parts
        for x, y in ((r, s), (s, r)):
            if same_given(p, x) and same_word(q, y, 2 if p == x or forms(p) & forms(x) else 1):
                return True
            if same_given(q, y) and same_word(p, x, 2 if q == y or forms(q) & forms(y) else 1):
                return True
        return False
    if a.kind == "initial":
        return a.parts[0] == b.parts[0] and same_word(a.parts[1], b.parts[1])
    return a.kind == "family" and same_word(a.parts[0], b.parts[0])


def fits(short: Name, person: Name) -> int:
    """2 if an initial or a bare family name fits a person exactly, 1 but for a slip, 0 if not."""
    best = 0
    for given, family in (person.parts, person.parts[::-1]):
        if short.kind == "initial" and short.parts[0] not in {g[0] for g in forms(given) | {given}}:
            continue
        if short.parts[-1] == family:
            return 2
        if same_word(short.parts[-1], family):
            best = 1
    return best
