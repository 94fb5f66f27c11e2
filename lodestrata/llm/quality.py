"""Statistics of texts that tell running prose from lists, tables and junk.

All texts of an Arrow batch are one array of code points; lengths, symbols,
punctuation, bullets and common words are counted by lookup tables and grouped
sums, without a loop over texts or lines.  Fixed thresholds decide about each
line, lines of plain text are joined into paragraphs, so that hard line breaks
don't matter, and thresholds decide about those.  A text fails where less than
half of its characters are in paragraphs of prose; the recorded reasons say which
rules the rest failed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closed classes of words. CLAUSE has pronouns, auxiliaries, modal verbs, conjunctions and negations, which
# come with a clause; LINKING articles, prepositions and the like.
CLAUSE = frozenset(
    """i you he she it we they me him us them who whom what which that this there is are was were be been being am isn aren wasn weren
    have has had haven hasn hadn do does did don doesn didn will would won can could couldn should must may might shall cannot
    not never nobody nothing everything if when whenever while because since until unless although though whether so yet but before after once why how please let
    je tu il elle on nous vous ils elles ce cela ça qui que qu quoi dont où est sont était étaient été être suis es sommes êtes ai as ont avait avaient avons avez
    ne pas plus jamais rien personne tout si quand lorsque parce car pendant avant après depuis puisque quoique afin donc mais faut peut peuvent doit doivent veut veulent fait
    ich du er sie es wir ihr mich dich ihm ihn uns euch ihnen man wer was das dies ist sind war waren sein bin bist seid hat haben hatte hatten habe wird werden wurde wurden
    nicht kein keine nie niemand nichts alle alles wenn als weil da dass ob obwohl bevor nachdem damit sobald solange während seit aber doch denn warum wie bitte kann können muss müssen soll sollen will wollen darf mag
    yo tú él ella usted nosotros ellos ellas lo esto eso quien qué cual cuando donde es son era eran fue fueron ser está están estaba hay ha han había he hemos
    no nunca nadie nada todo si porque aunque mientras antes después desde hasta ya pero para sin se le les me te nos puede pueden debe deben tiene quiere quieren""".split()
)
LINKING = frozenset(
    """a an the of in on at to from by with without for about into over under between through and or as than then now still even just only also very more most less few many much some any each every all both no
    other another such same own first second last next new old one two here where again against during my your his her its our their
    le la les un une des du de au aux à en dans par pour avec sans sur sous entre vers chez et ou ni comme plus moins très encore même aussi ici là chaque quelque quelques autre autres mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs cette cet ces
    der die den dem des ein eine einen einem einer eines und oder mit ohne von vom zu zum zur im in am an auf aus bei beim bis durch für gegen nach über unter um vor hinter zwischen auch noch nur schon sehr mehr jetzt hier dort dann mein dein sein unser jeder jede jedes jeden dieser diese dieses diesen rund
    el la los las un una unos unas del al de a en con sin por para sobre entre hacia hasta según y e o u ni como más menos muy también aún todavía cada otro otra otros otras mi tu su sus nuestro este esta estos estas ese esa cerca""".split()
)
COMMON = CLAUSE | LINKING
# Words that open a noun phrase, words that something must follow, and words that can't be the first thing in a noun
# phrase; a stop can't stand behind either.
OPENING = frozenset("the a an my our their every le la les un une des du au aux mon notre ce cette chaque der die das den dem des ein eine einen einem einer el los las una al del mi nuestro cada".split())
LEADING = frozenset("of from into with and or as than because if de dans avec sous et que mit von vom zum und dass con por sin y".split())
NOT_OPENED = frozenset(
    """the a an of in on at to from by with for into about and or as than then is are was were be been have has had do does did will would can could should must if when while because since until although though but we they it he she i you
    le la les un une des du au aux en dans par pour avec sans sur sous et ou que qui est sont était ont sera si quand car mais je tu il elle nous vous ils elles ne
    der die das den dem des ein eine mit ohne von vom zu zum zur in im am an auf aus bei beim und oder ist sind war waren hat haben wird werden wenn als weil dass ob aber ich wir sie es nicht
    el los las una unas del al de en con sin por para y o que es son era fue está han si cuando porque pero se""".split()
)

#: Published rules for web corpora, as numbers: Gopher (Rae et al. 2021) wants a mean word length of 3 to 10, less than one
#: symbol in ten words, 80 % of the words with a letter and two common words; lists fail by their bullets, repetition by repeated runs of words.
MIN_MEAN, MAX_MEAN, MAX_SYMBOLS_PER_WORD, MIN_ALPHABETIC, MIN_STOP_WORDS = 3.0, 10.0, 0.1, 0.8, 2
#: Ours, for parts of a text, as those rules are for whole pages.
MIN_COMMON, MIN_CLAUSE, CLAUSE_FROM, FEW_COMMON, SOME_COMMON = 0.12, 0.008, 60, 0.1, 0.2
MIN_BROKEN, MAX_BROKEN = 2, 0.22
MAX_ODD, MIN_WORDS, MAX_TECHNICAL, MAX_MIXED, MAX_REPEATED, PROSE_SHARE = 0.3, 4, 0.25, 0.5, 0.5, 0.5

_LETTER, _DIGIT, _SPACE, _BREAK, _USUAL, _CLOSING, _CODE, _CELL = (1 << k for k in range(8))
_LONE = "aàyeoIAÀYEO–—&-"
_BULLETS = "-*+•‣◦▪–—·"
KINDS = ("blank", "label", "symbols", "machine", "table", "furniture", "list", "text", "garbled", "gibberish", "repeated", "prose")
_K = {k: n for n, k in enumerate(KINDS)}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower-case forms by code point; what is beyond the basic plane counts as a symbol."""
    classes, lower = np.zeros(65537, np.uint8), np.arange(65537, dtype=np.uint32)
    for c in range(65536):
        x = chr(c)
        kind = unicodedata.category(x)
        if x in "\n\r\x0b\x0c\u2028\u2029":
            classes[c] = _BREAK
        elif x.isspace() or c < 32:
            classes[c] = _SPACE
        elif kind[0] == "L":
            classes[c] = _LETTER
            lower[c] = ord(x.lower()) if len(x.lower()) == 1 else c
        elif kind == "Nd":
            classes[c] = _DIGIT
        elif kind[0] == "M" or x in "'’.,;:!?-/@)(\"“”„«»…":
            classes[c] = _USUAL
        if x in ".!?…:":
            classes[c] |= _CLOSING
        if x in "=/\\{}[]<>_$#|^~`*+@&%":
            classes[c] |= _CODE
        if x in ",;|»›·":
            classes[c] |= _CELL
    return classes, lower


def _mix(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    z = (values.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(31)
    return z * np.uint64(0xBF58476D1CE4E5B9)


def _run_hashes(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of every run of positions ``inside``."""
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    return at[first], sizes, np.add.reduceat(_mix(codes[at], place), first)


@lru_cache(maxsize=1)
def _common_hashes() -> tuple[np.ndarray, ...]:
    def of(words) -> np.ndarray:
        codes = np.array([ord(c) for w in sorted(words) for c in w + " "], np.uint32)
        return np.sort(_run_hashes(codes, codes != 32)[2])

    return of(CLAUSE), of(LINKING), of(OPENING), of(LEADING), of(NOT_OPENED)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _sums(group: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(group, weights, n).astype(np.int64)


def _repeated_share(group: np.ndarray, tokens: np.ndarray, n: int, run: int = 4) -> np.ndarray:
    """Per group the share of its runs of four words that repeat one that occurs three times or more."""
    if len(tokens) < run:
        return np.zeros(n)
    h = np.zeros(len(tokens) - run + 1, np.uint64)
    for k in range(run):
        h = _mix(h ^ tokens[k : len(h) + k], np.full(1, k))
    whole = group[: len(h)] == group[run - 1 :]
    h, g = h[whole], group[: len(h)][whole]
    order = np.lexsort((h, g))
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    again = _sums(g[first], n, np.where(times >= 3, times - 1, 0))
    return again / np.maximum(_sums(g, n), 1)


def _line_kinds(f: dict[str, np.ndarray]) -> np.ndarray:
    """What each line is, by its statistics alone; text stands for what paragraphs decide."""
    solid, n, named, letters = f["solid"], f["tokens"], f["named"], f["letters"]
    common = f["common"] / np.maximum(named, 1)
    technical = ((f["technical"] > MAX_TECHNICAL * solid) & (common < 0.15)) | ((f["mixed"] >= MAX_MIXED * n) & (common < 0.5))
    columns = (f["bars"] >= 2) | (f["tabs"] > 0) | (f["gaps"] >= 2)
    cells = f["cells"] + 1
    furniture = (f["clauses"] == 0) & (f["marks"] >= 3) & (n <= 4.5 * (f["marks"] + 1))
    tests = [
        (solid == 0, "blank"),
        (f["dashes"] & (solid <= 5), "label"),
        ((solid >= 8) & (letters < 0.25 * solid) & (f["digits"] == 0), "symbols"),
        (f["dashes"], "symbols"),
        (((n <= 2) & (solid >= 40)) | (solid > 40 * n), "machine"),
        (columns & ((named < 8) | (common < SOME_COMMON)) & (f["bars"] >= 2) & (letters > 0.6 * solid) & ~f["bar_first"], "furniture"),
        (columns & ((named < 8) | (common < SOME_COMMON)), "table"),
        (f["bullet"] & (named >= 6) & (common >= SOME_COMMON) & (f["clauses"] > 0), "text"),
        (f["bullet"], "list"),
        (f["label"] & (solid <= 80), "label"),
        (f["dated"] | technical, "machine"),
        (furniture, "furniture"),
        ((common < FEW_COMMON) & (cells >= 3) & (n <= 4.5 * cells) & (f["digits"] > 0.15 * solid), "table"),
        ((common < FEW_COMMON) & (cells >= 3) & (n <= 4.5 * cells), "list"),
        ((solid >= 20) & (letters < 0.5 * solid), "machine"),
    ]
    return np.select([t for t, _ in tests], [_K[k] for _, k in tests], _K["text"])


def _paragraph_kinds(f: dict[str, np.ndarray]) -> np.ndarray:
    """What paragraphs, sums over their lines, are."""
    n, solid, named = f["tokens"], f["solid"], f["named"]
    some = n >= 8
    tests = [
        (n < MIN_WORDS, "label"),
        (some & ((f["odd"] > MAX_ODD * n) | (solid < 2.5 * n) | (f["letters"] < 0.65 * solid)), "garbled"),
        (solid > (MAX_MEAN + 4) * n, "machine"),
        (some & (f["strange"] > 0.08 * n), "garbled"),
        (some & (f["common"] < MIN_COMMON * named) & ((f["lines"] > 1) | (f["cells"] > 0)), "list"),
        (some & (f["common"] < MIN_COMMON * named), "gibberish"),
        (some & (n >= CLAUSE_FROM) & (f["clauses"] < MIN_CLAUSE * n), "list"),
    ]
    return np.select([t for t, _ in tests], [_K[k] for _, k in tests], _K["prose"])


def _counts(codes: np.ndarray, doc_sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every line, and of its tokens, of texts that end with a line break each."""
    classes, lower = _tables()
    small = np.minimum(codes, 65536).astype(np.int32)
    c, low = classes.take(small), lower.take(small)
    has = lambda bit: (c & bit) != 0
    broken, blank, letter, digit, mark = has(_BREAK), has(_SPACE), has(_LETTER), has(_DIGIT), codes == 0x301
    ends = np.flatnonzero(broken)
    n = len(ends)
    starts = np.append(0, ends[:-1] + 1)
    line_of = lambda at: np.searchsorted(ends, at)
    solid = ~(broken | blank)
    before, behind = np.append(False, solid[:-1]), np.append(solid[1:], False)
    tokens, sizes, token_hash = _run_hashes(low, solid)
    words, long, word_hash = _run_hashes(low, letter | mark)
    clause_table, linking_table, opening_table, leading_table, closed_table = _common_hashes()
    quote = (codes == 39) | (codes == 0x2019)
    elided = (long <= 2) & (quote[np.minimum(words + long, len(codes) - 1)] | quote[np.maximum(words - 1, 0)])
    clause = _among(word_hash, clause_table) & ((long > 1) | np.isin(low[words], [ord(x) for x in "iyà"])) if len(words) else np.empty(0, bool)
    common = (clause | elided | _among(word_hash, linking_table)) if len(words) else np.empty(0, bool)
    per = lambda where: np.add.reduceat(where.view(np.uint8), starts, dtype=np.int64)
    word_line, token_line = line_of(words), line_of(tokens)
    # Words that open a noun phrase and stand before a stop or a word that can't be in one.
    opening = _among(word_hash, opening_table) & ~elided if len(words) else np.empty(0, bool)
    after = codes[np.minimum(words + long, len(codes) - 1)]
    stopped = np.isin(after, [ord(x) for x in ".,;:!?)…"])
    wrong = (opening | (_among(word_hash, leading_table) if len(words) else opening)) & stopped | opening & (np.append(_among(word_hash, closed_table)[1:], False) & np.append(words[1:] - words[:-1] - long[:-1] <= 2, False) if len(words) else False)
    inner = before & behind & ~(letter | digit | has(_CODE) | quote | (codes == 45) | (codes == 46) | (codes == 44))
    slash = (codes == 47) & ~before & ~behind
    tab = codes == 9
    # Where cells of a column begin: behind two spaces or a tab that follow something.
    gap = blank & before & (tab | np.append(blank[1:], False)) & ~np.append(broken[1:], True)
    first_of, first = np.unique(token_line, return_index=True) if len(tokens) else (np.empty(0, np.int64), np.empty(0, np.int64))
    total = np.append(0, np.cumsum(digit, dtype=np.int32))
    hard = digit | has(_CODE) | inner
    coded = np.append(0, np.cumsum(hard | (before & behind & (codes == 46)), dtype=np.int32))
    mixed = (coded[tokens + sizes] > coded[tokens]) & (np.add.reduceat((letter).view(np.uint8), tokens, dtype=np.int64) > 0 if len(tokens) else False)
    head, size = tokens[first], sizes[first]
    tail = head + size - 1
    digits_in = total[tail + 1] - total[head]
    many = _sums(token_line, n)[first_of] > 1
    ends_list = (codes[tail] == 46) | (codes[tail] == 41)
    opened = codes[head] == 40
    bullet = many & (((size == 1) & np.isin(codes[head], [ord(x) for x in _BULLETS])) | (ends_list & (size - 1 - opened == digits_in) & (digits_in > 0) & (digits_in <= 3)) | (ends_list & (size == 2) & letter[head]) | ((codes[head] == 91) & ((size == 1) | (size == 3) & (codes[tail] == 93))))
    last_of = np.append(first[1:], len(tokens))[: len(first)] - 1
    final = tokens[last_of] + sizes[last_of] - 1
    closing = has(_CLOSING)
    wrapped = np.isin(codes[final], [ord(x) for x in "\"'”’»)]"]) & closing[np.maximum(final - 1, 0)]
    width = _sums(token_line, n)[first_of]
    three = lambda x: (codes[head] == x) & (codes[np.minimum(head + 1, len(codes) - 1)] == x) & (codes[np.minimum(head + 2, len(codes) - 1)] == x)
    label = (codes[head] == 35) | three(61) | ((codes[head] == 91) & (codes[final] == 93)) | ((codes[tail] == 58) & (width <= 2)) | ((codes[final] == 58) & (width <= 4))
    dated = (digits_in >= 8) & (codes[np.minimum(head + 4, len(codes) - 1)] == 45) & (codes[np.minimum(head + 7, len(codes) - 1)] == 45)

    def flags(where: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[first_of[where]] = True
        return out

    usual = letter | digit | blank | broken | has(_USUAL)
    near = np.append(False, letter[:-1]) & np.append(letter[1:] | ~usual[1:], False)
    one = sizes == 1
    odd = one & ~digit[tokens] & ~np.isin(codes[tokens], [ord(x) for x in _LONE])
    symbol = ~(letter | digit | blank | broken)
    return {
        "doc": np.searchsorted(np.cumsum(doc_sizes), ends, side="right"),
        "solid": per(solid), "tokens": _sums(token_line, n), "named": _sums(word_line, n), "letters": per(letter), "digits": per(digit),
        "common": _sums(word_line[common], n), "clauses": _sums(word_line[clause], n), "symbols": per(symbol),
        "technical": per(hard), "mixed": _sums(token_line[mixed], n), "openings": _sums(word_line[opening], n), "wrong": _sums(word_line[wrong], n), "bars": per(codes == 124), "tabs": per(tab & before), "gaps": per(gap), "cells": per(has(_CELL)) + per(slash), "marks": per((codes == 0xBB) | (codes == 0x203A) | (codes == 0xB7) | (codes == 124)) + per(slash),
        "odd": _sums(token_line[odd], n), "strange": per(~usual & near), "bullet": flags(bullet), "closed": flags(closing[final] | wrapped), "label": flags(label), "dated": flags(dated), "dashes": flags(three(45) & (size >= 3)), "bar_first": flags(codes[head] == 124),
        "token_line": token_line, "token_hash": token_hash, "alphabetic": None,
    }


def _measured(texts: list[str | None]) -> list[list]:
    """The columns of SCHEMA of some texts."""
    size = np.array([0 if t is None else len(t) for t in texts], np.int64)
    clean = ["\n" if t is None else (t if t.isascii() else unicodedata.normalize("NFC", t)).replace("\r\n", "\n") + "\n" for t in texts]
    m = len(texts)
    if not m:
        return [[] for _ in _ARROW]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, clean), np.int64, m)
    unseen = np.isin(codes, _UNSEEN) if int(codes.max()) > 127 else np.zeros(0, bool)
    if unseen.any():
        sizes -= np.add.reduceat(unseen.view(np.uint8), np.cumsum(sizes) - sizes, dtype=np.int64)
        codes = codes[~unseen]
    f = _counts(codes, sizes)
    doc, token_line, token_hash = f.pop("doc"), f.pop("token_line"), f.pop("token_hash")
    f.pop("alphabetic")
    kind = _line_kinds(f)
    plain = kind == _K["text"]
    if plain.any():
        new = plain & ~(np.append(False, plain[:-1]) & np.append(False, doc[1:] == doc[:-1]))
        paragraph = np.cumsum(new)[plain] - 1
        n = int(new.sum())
        sums = {k: _sums(paragraph, n, v[plain]) for k, v in f.items()} | {"lines": _sums(paragraph, n)}
        what = _paragraph_kinds(sums)
        owner = doc[new]
        prose = what == _K["prose"]
        # All prose of a text together: words out of order, said again and again, or long without a single clause.
        keep = np.zeros(len(kind), bool)
        keep[plain] = prose[paragraph]
        inside = keep[token_line]
        again = _repeated_share(doc[token_line[inside]], token_hash[inside], m)
        words, clauses = (_sums(owner[prose], m, sums[k][prose]) for k in ("tokens", "clauses"))
        openings, wrong = (_sums(owner[prose], m, sums[k][prose]) for k in ("openings", "wrong"))
        what = np.where(prose & ((wrong >= MIN_BROKEN) & (wrong >= MAX_BROKEN * openings))[owner], _K["gibberish"], what)
        what = np.where((what == _K["prose"]) & (again > MAX_REPEATED)[owner] & (words >= 8)[owner], _K["repeated"], what)
        what = np.where((what == _K["prose"]) & ((words >= CLAUSE_FROM) & (clauses == 0))[owner], _K["list"], what)
        kind = kind.copy()
        kind[plain] = what[paragraph]
    weight = np.zeros((m, len(KINDS)), np.int64)
    np.add.at(weight, (doc, kind), f["solid"])
    prose, label, whole = weight[:, _K["prose"]], weight[:, _K["label"]], weight.sum(axis=1)
    # Headings and labels go with the prose they belong to; where there are far more, they are furniture.
    total = whole - np.where(label <= 3 * prose, label, 0)
    share = np.where(total > 0, prose / np.maximum(total, 1), 0.0)
    lines = f["solid"] > 0
    of = lambda k: _sums(doc, m, f[k])
    solid, n_words, named, n_lines = of("solid"), of("tokens"), np.maximum(of("named"), 1), np.maximum(_sums(doc[lines], m), 1)
    per_word = np.maximum(n_words, 1)
    ratios = [solid / per_word, of("symbols") / np.maximum(solid, 1), of("closed") / n_lines, of("bullet") / n_lines, of("common") / named, of("clauses") / named, share]
    reasons = []
    for k in range(m):
        if not n_words[k] or share[k] >= PROSE_SHARE:
            reasons.append([])
            continue
        row = [(-weight[k, i], KINDS[i]) for i in np.flatnonzero(weight[k]) if KINDS[i] != "prose" and weight[k, i] >= 0.2 * max(1, total[k])]
        reasons.append([name for _, name in sorted(row)] or ["mixed"])
    some = n_words > 0
    return [size.tolist(), n_words.tolist(), *([x if ok else None for x, ok in zip(r.tolist(), some.tolist())] for r in ratios), reasons]


def measure(text: str | None) -> tuple:
    """All statistics of one text, as in SCHEMA; the reasons are empty where it may pass for prose or has no text."""
    return tuple(c[0] for c in _measured([text]))


# Soft hyphens and zero-width characters.
_UNSEEN = np.array([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF], np.uint32)

SCHEMA = "n_chars long, n_words long, mean_word_length double, symbol_ratio double, closed_line_share double, bullet_line_share double, common_word_share double, clause_word_share double, prose_share double, reasons array<string>"
_ARROW = pa.schema(
    [("n_chars", pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in ("mean_word_length", "symbol_ratio", "closed_line_share", "bullet_line_share", "common_word_share", "clause_word_share", "prose_share")), ("reasons", pa.list_(pa.string()))]
)

#: Texts that are counted together.
STEP = 512


def text_quality(texts: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and the statistics of ``column``; ``reasons`` says why a text isn't prose.

    Null, empty and blank texts have no words, null ratios and no reason.  Rows
    repeat as given.  Whole texts are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, STEP) for k in range(0, b.num_rows, STEP)):
                columns = _measured(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, _ARROW))], [key, *_ARROW.names])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key), F.col(column).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
