"""Reading one written time: every valid interpretation of a value as UTC instants.

Pure Python, used from Arrow batches.  A value yields *candidates*
``(format, instants)``; ``instants`` has one entry where the reading denotes one
instant, none where the clock of the zone skipped the wall time, and two where
it showed the wall time twice.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
ORDERS = ("DMY", "MDY", "YMD")

# Month names of English, German, French and Spanish, and their usual short forms.
MONTH_NAMES = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier febrero",
    3: "march mar märz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
# Weekday names and short forms, Monday = 0.
WEEKDAY_NAMES = {
    0: "monday mon montag mo lundi lun lunes",
    1: "tuesday tue tues dienstag di mardi mar martes",
    2: "wednesday wed mittwoch mi mercredi mer miércoles mié",
    3: "thursday thu thur thurs donnerstag do jeudi jeu jueves jue",
    4: "friday fri freitag fr vendredi ven viernes vie",
    5: "saturday sat samstag sa samedi sam sábado sáb",
    6: "sunday sun sonntag so dimanche dim domingo dom",
}
MONTHS = {w: n for n, ws in MONTH_NAMES.items() for w in ws.split()}
WEEKDAYS = {w: n for n, ws in WEEKDAY_NAMES.items() for w in ws.split()}

_LETTERS = r"[^\W\d_]"
_SPACE = re.compile(r"[\s\u00a0\u202f\u2009]+")
_PLAIN = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z")
_UNIX = re.compile(r"(-?\d{9,10}(?:[.,]\d{1,9})?|-?\d{12,13}(?:\.\d{1,6})?|-?\d{15,16})")
_STAMP = re.compile(
    rf"""(?:(?P<dow>{_LETTERS}+)\.?,?\s+)?
    (?:(?P<y1>\d{{4}})(?P<s1>[-/.])(?P<m1>\d{{1,2}})(?P=s1)(?P<d1>\d{{1,2}})
     |(?P<y2>\d{{4}})(?P<m2>\d\d)(?P<d2>\d\d)(?=[Tt\s]?\d)
     |(?P<a>\d{{1,2}})(?P<s3>[-/.])(?P<b>\d{{1,2}})(?P=s3)(?P<c>\d{{4}}|\d\d)
     |(?P<y4>\d{{4}})年\s?(?P<m4>\d{{1,2}})月\s?(?P<d4>\d{{1,2}})日
     |(?P<d5>\d{{1,2}})(?:\.|st|nd|rd|th|er)?[\s-](?:de\s)?(?P<m5>{_LETTERS}+)\.?,?[\s-](?:del?\s)?(?P<y5>\d{{4}}|\d\d)
     |(?P<m6>{_LETTERS}+)\.?\s(?P<d6>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y6>\d{{4}}))
    (?:[Tt]|,?\s(?:(?:at|à|um|a\slas?|el)\s)?|,\s?)
    (?:(?P<H>\d{{1,2}})(?:\s?[:h]\s?(?P<M>\d\d)(?::(?P<S>\d\d)(?:[.,](?P<f>\d{{1,9}}))?)?|\s?h)
     |(?P<H2>\d\d)(?P<M2>\d\d)(?P<S2>\d\d)?(?:[.,](?P<f2>\d{{1,9}}))?)
    (?:\s?Uhr)?
    (?:\s?(?P<ap>[AaPp])\.?\s?[Mm]\.?(?![^\W\d_]))?
    (?P<rest>.*)""",
    re.X | re.S,
)
_OFFSET = re.compile(r"(?:(?:UTC|GMT)\s?)?([+\-−])(\d{1,2})(?::?(\d\d))?(?::?00)?")
_REGION = re.compile(r"[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+|UTC|GMT")
_ABBREV = re.compile(r"[A-Za-z]{1,5}")


def is_plain(value: str | None) -> bool:
    """Already written as ``YYYY-MM-DDThh:mm:ss[.f...]Z``."""
    return value is not None and _PLAIN.fullmatch(value) is not None


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    if not name:
        return None
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _micros(wall: datetime, offset: timedelta) -> int:
    gone = wall - EPOCH - offset
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def wall_instants(wall: datetime, zone: ZoneInfo) -> list[int]:
    """The instants at which clocks of ``zone`` show ``wall``: none, one or two."""
    found = []
    for fold in (0, 1):
        local = wall.replace(tzinfo=zone, fold=fold)
        offset = local.utcoffset()
        utc = wall - offset
        if utc.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None, fold=0) == wall:
            us = _micros(wall, offset)
            if us not in found:
                found.append(us)
    return found


@lru_cache(maxsize=65_536)
def _abbreviation_offset(name: str, abbr: str, year: int) -> timedelta | None:
    zone = zone_of(name)
    for month in range(1, 13):
        at = datetime(year, month, 15, 12, tzinfo=zone)
        if at.tzname() == abbr:
            return at.utcoffset()
    return None


def _zoned(wall: datetime, rest: str, home: str | None) -> list[int] | None:
    """Instants of ``wall`` given the text after the time; None where that text isn't a zone."""
    rest = rest.strip()
    region = None
    if rest.endswith("]") and "[" in rest:
        rest, _, inner = rest[:-1].partition("[")
        rest, region = rest.strip(), inner.strip()
        if not _REGION.fullmatch(region):
            return None
    if rest.endswith(")") and "(" in rest:
        rest = rest.partition("(")[0].strip()
    if rest in ("Z", "z"):
        return [_micros(wall, timedelta(0))]
    if m := _OFFSET.fullmatch(rest):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        gap = timedelta(hours=hours, minutes=minutes)
        return [_micros(wall, gap if m[1] == "+" else -gap)]
    if rest.upper() in ("UTC", "GMT") and not (rest.upper() == "GMT" and home == "Europe/London"):
        return [_micros(wall, timedelta(0))]
    if rest and _REGION.fullmatch(rest) and "/" in rest:
        region, rest = rest, ""
    if not rest:
        zone = zone_of(region or home)
        return None if zone is None else wall_instants(wall, zone)
    if not _ABBREV.fullmatch(rest):
        return None
    zone, abbr = zone_of(home), rest.upper()
    if zone is None:
        return None
    for fold in (0, 1):
        local = wall.replace(tzinfo=zone, fold=fold)
        if local.tzname() == abbr:
            return [_micros(wall, local.utcoffset())]
    if abbr == "GMT":
        return [_micros(wall, timedelta(0))]
    offset = _abbreviation_offset(home, abbr, wall.year)
    return None if offset is None else [_micros(wall, offset)]


def candidates(value: str | None, home: str | None) -> list[tuple[str, list[int]]]:
    """Every reading of ``value``: ``(format, instants)``; empty where no reading with a time is valid."""
    if not value:
        return []
    text = _SPACE.sub(" ", value).strip()
    if m := _UNIX.fullmatch(text):
        whole, _, part = m[1].replace(",", ".").partition(".")
        digits = len(whole.lstrip("-"))
        unit, name = (1_000_000, "unix_s") if digits <= 10 else (1_000, "unix_ms") if digits <= 13 else (1, "unix_us")
        if unit == 1 and part:
            return []
        us = int(whole) * unit
        if part:
            more = int((part + "000000")[:6]) * unit // 1_000_000
            us += -more if whole.startswith("-") else more
        return [(name, [us])]
    m = _STAMP.fullmatch(text)
    if m is None:
        return []
    g = m.group
    hour, minute, second = int(g("H") or g("H2")), int(g("M") or g("M2") or 0), int(g("S") or g("S2") or 0)
    micro = int(((g("f") or g("f2") or "") + "000000")[:6])
    if ap := g("ap"):
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + (12 if ap in "Pp" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return []
    if g("y1"):
        days = [("year_first", g("y1"), g("m1"), g("d1"))]
    elif g("y2"):
        days = [("compact", g("y2"), g("m2"), g("d2"))]
    elif g("y4"):
        days = [("cjk", g("y4"), g("m4"), g("d4"))]
    elif g("a"):
        a, b, c = g("a"), g("b"), g("c")
        days = [("DMY", c, b, a), ("MDY", c, a, b)]
        if len(c) == 2:
            days.append(("YMD", a, b, c))
    else:
        name = (g("m5") or g("m6")).lower()
        if name not in MONTHS:
            return []
        days = [("named", g("y5") or g("y6"), str(MONTHS[name]), g("d5") or g("d6"))]
    dow = WEEKDAYS.get(g("dow").lower(), -1) if g("dow") else None
    out = []
    for fmt, y, mo, d in days:
        year = int(y) + (2000 if len(y) <= 2 else 0)
        try:
            wall = datetime(year, int(mo), int(d), hour, minute, second, micro)
        except ValueError:
            continue
        if dow is not None and wall.weekday() != dow:
            continue
        instants = _zoned(wall, g("rest"), home)
        if instants is not None:
            out.append((fmt, instants))
    return out


