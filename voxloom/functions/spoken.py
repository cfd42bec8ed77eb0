"""Written to spoken English: numbers, dates, times, money, measures, phones, addresses and the cascade over whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types

# Number words, months, units, currencies, short forms and states, as English has them.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "January February March April May June July August September October November December".split()
UNITS = {
    "km": "kilometer", "m": "meter", "cm": "centimeter", "mm": "millimeter", "nm": "nanometer", "kg": "kilogram", "g": "gram", "mg": "milligram", "lb": "pound", "lbs": "pound", "oz": "ounce",
    "ft": "foot", "mi": "mile", "mph": "mile per hour", "kph": "kilometer per hour", "h": "hour", "hr": "hour", "hrs": "hour", "min": "minute", "s": "second", "sec": "second", "ms": "millisecond",
    "l": "liter", "ml": "milliliter", "gal": "gallon", "ha": "hectare", "hz": "hertz", "kHz": "kilohertz", "MHz": "megahertz", "GHz": "gigahertz", "kW": "kilowatt", "kWh": "kilowatt hour", "W": "watt",
    "V": "volt", "KB": "kilobyte", "MB": "megabyte", "GB": "gigabyte", "TB": "terabyte", "kbps": "kilobit per second", "mbps": "megabit per second", "dB": "decibel",
    "°F": "degree Fahrenheit", "°C": "degree Celsius", "°": "degree",
}
PLURALS = {"foot": "feet", "hertz": "hertz", "kilohertz": "kilohertz", "megahertz": "megahertz", "gigahertz": "gigahertz", "penny": "pence"}
CURRENCY = {"$": ("dollar", "cent"), "€": ("euro", "cent"), "£": ("pound", "penny"), "¥": ("yen", "sen"), "₹": ("rupee", "paisa"), "US$": ("dollar", "cent")}
SAME_PLURAL = {"yen", "sen"}
LETTER_SCALES = {"k": "thousand", "K": "thousand", "M": "million", "m": "million", "B": "billion", "bn": "billion", "T": "trillion"}
SHORT = {
    "Dr.": "doctor", "Mr.": "mister", "Mrs.": "misses", "Ms.": "miss", "Prof.": "professor", "Sr.": "senior", "Jr.": "junior", "Gen.": "general", "Sgt.": "sergeant", "Capt.": "captain",
    "Lt.": "lieutenant", "Col.": "colonel", "Gov.": "governor", "Sen.": "senator", "Rep.": "representative", "Rev.": "reverend", "Hon.": "honorable", "St.": "saint", "Ave.": "avenue",
    "Blvd.": "boulevard", "Rd.": "road", "Ln.": "lane", "Mt.": "mount", "Ft.": "fort", "vs.": "versus", "vs": "versus", "etc.": "et cetera", "e.g.": "for example", "i.e.": "that is", "approx.": "approximately",
    "dept.": "department", "Dept.": "department", "Inc.": "incorporated", "Ltd.": "limited", "Corp.": "corporation", "Co.": "company", "No.": "number", "no.": "no.", "fig.": "figure", "Fig.": "figure",
    "vol.": "volume", "Vol.": "volume", "min.": "minimum", "max.": "maximum", "w/": "with", "w/o": "without", "b/c": "because", "&": "and", "%": "percent", "#": "hash", "@": "at", "+": "plus", "=": "equals",
}
STATES = dict(
    pair.split(":")
    for pair in (
        "AL:Alabama|AK:Alaska|AZ:Arizona|AR:Arkansas|CA:California|CO:Colorado|CT:Connecticut|DE:Delaware|FL:Florida|GA:Georgia|HI:Hawaii|ID:Idaho|IL:Illinois|IN:Indiana|IA:Iowa|KS:Kansas|KY:Kentucky|"
        "LA:Louisiana|ME:Maine|MD:Maryland|MA:Massachusetts|MI:Michigan|MN:Minnesota|MS:Mississippi|MO:Missouri|MT:Montana|NE:Nebraska|NV:Nevada|NH:New Hampshire|NJ:New Jersey|NM:New Mexico|NY:New York|"
        "NC:North Carolina|ND:North Dakota|OH:Ohio|OK:Oklahoma|OR:Oregon|PA:Pennsylvania|RI:Rhode Island|SC:South Carolina|SD:South Dakota|TN:Tennessee|TX:Texas|UT:Utah|VT:Vermont|VA:Virginia|"
        "WA:Washington|WV:West Virginia|WI:Wisconsin|WY:Wyoming"
    ).split("|")
)
VULGAR = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
RAISED = str.maketrans("ˢᵗⁿᵈʳʰ", "stndrh")
ZONES = "GMT|UTC|EST|EDT|CST|CDT|MST|MDT|PST|PDT|CET|CEST|BST"
TAG = re.compile(r"\[[^\[\]]*\]|<[A-Za-z]+>")


# ---------------------------------------------------------------- numbers


def _below_thousand(n: int) -> list[str]:
    words = []
    if n >= 100:
        words += [ONES[n // 100], "hundred"]
        n %= 100
    if n >= 20:
        words.append(TENS[n // 10])
        n %= 10
    if n or not words:
        words.append(ONES[n])
    return [w for w in words if not (w == "zero" and len(words) > 1)]


def cardinal(n: int) -> str:
    """Words of an integer; one of more than 21 digits is read digit by digit."""
    if n < 0:
        return "minus " + cardinal(-n)
    if n < 1000:
        return " ".join(_below_thousand(n))
    if n >= 1000 ** len(SCALES):
        return digits(f"{n:d}")
    groups, words = [], []
    while n:
        n, r = divmod(n, 1000)
        groups.append(r)
    for scale, r in reversed(list(enumerate(groups))):
        if r:
            words += _below_thousand(r) + ([SCALES[scale]] if scale else [])
    return " ".join(words)


def digits(text: str) -> str:
    return " ".join(ONES[int(c)] for c in text if c in "0123456789")


def _number(text: str) -> int | None:
    """The value of plain or grouped digits; None if there are too many to be a quantity."""
    bare = text.replace(",", "")
    return int(bare) if len(bare) <= 21 else None


def quantity(text: str) -> str:
    """A count by value, whatever its length; of too many digits one by one."""
    n = _number(text)
    return digits(text) if n is None else cardinal(n)


def written_number(text: str) -> str:
    """Comma groups by value; bare numbers of five digits or more, and leading zeros, digit by digit."""
    bare = text.replace(",", "")
    if "," not in text and (len(bare) >= 5 or (len(bare) > 1 and bare[0] == "0")):
        return digits(bare)
    return quantity(text)


def ordinal(n: int) -> str:
    head, _, last = cardinal(n).rpartition(" ")
    last = IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return f"{head} {last}".strip()


def year(n: int) -> str:
    high, low = divmod(n, 100)
    if n % 1000 < 10 or n < 100:
        return cardinal(n)
    return f"{cardinal(high)} {'hundred' if low == 0 else ('o ' if low < 10 else '') + cardinal(low)}"


def _many(words: str) -> str:
    """The plural of the last word, as decades have it: nineties, hundreds."""
    return words[:-1] + "ies" if words.endswith("y") else words + "s"


def decade(text: str) -> str:
    n = int(text)
    return _many(year(n) if n >= 100 else cardinal(n))


def decimal(whole: str, fraction: str) -> str:
    return f"{written_number(whole) if whole else 'zero'} point {digits(fraction)}"


def amount(whole: str, fraction: str | None) -> str:
    return decimal(whole, fraction) if fraction else written_number(whole)


def _plural(word: str, one: bool) -> str:
    if one or word in SAME_PLURAL:
        return word
    for joint in (" per ",):
        if joint in word:
            head, _, rest = word.partition(joint)
            return _plural(head, False) + joint + rest
    head, _, last = word.partition(" ")
    if head == "degree":
        return f"degrees {last}".strip()
    if last:
        return f"{head} {_plural(last, False)}"
    return PLURALS.get(word, word + "s")


def unit(text: str) -> str:
    """The name of a unit; ``/`` is per, a raised 2 or 3 square or cubic."""
    if "/" in text:
        above, _, below = text.partition("/")
        return f"{unit(above)} per {unit(below)}"
    power = {"2": "square ", "²": "square ", "3": "cubic ", "³": "cubic "}.get(text[-1:], "")
    bare = text[:-1] if power and text[:-1] in UNITS else text
    return (power if bare != text else "") + UNITS.get(bare, bare)


def _units(text: str, one: bool) -> str:
    name = unit(text)
    for kind in ("square ", "cubic "):
        if name.startswith(kind):
            return kind + _plural(name[len(kind) :], one)
    return _plural(name, one)


def money(symbol: str, whole: str, cents: str | None, scale: str | None) -> str:
    major, minor = CURRENCY[symbol]
    if scale:
        return f"{amount(whole, cents)} {LETTER_SCALES.get(scale, scale)} {_plural(major, False)}"
    value, parts = _number(whole), []
    if value is None or value or not cents or not int(cents):
        parts.append(f"{quantity(whole)} {_plural(major, value == 1)}")
    if cents and int(cents):
        n = int((cents + "0")[:2])
        if n:
            parts.append(f"{cardinal(n)} {_plural(minor, n == 1)}")
    return " ".join(parts) or f"zero {_plural(major, False)}"


def clock(h: str, m: str | None, half: str | None, zone: str | None = None, s: str | None = None) -> str:
    if s is not None:
        parts = [f"{cardinal(int(v))} {_plural(name, int(v) == 1)}" for v, name in ((h, "hour"), (m, "minute"), (s, "second"))]
        said = f"{parts[0]} {parts[1]} and {parts[2]}"
    else:
        minutes = "" if m is None or int(m) == 0 else (" o " + ONES[int(m)] if int(m) < 10 else " " + cardinal(int(m)))
        said = cardinal(int(h)) + (minutes or ("" if half or m is None else " o'clock"))
    return said + (f" {half.upper().replace('.', '')}" if half else "") + (f" {' '.join(zone)}" if zone else "")


def fraction(top: int, bottom: int) -> str:
    if bottom == 0:
        return f"{cardinal(top)} over zero"
    if bottom == 1:
        return f"{cardinal(top)} over one"
    name = {2: "half", 4: "quarter"}.get(bottom) or ordinal(bottom)
    return f"{cardinal(top)} {name if top == 1 else 'halves' if bottom == 2 else _many(name)}"


def mixed(whole: str | None, top: str, bottom: str) -> str:
    said = fraction(int(top), int(bottom))
    return f"{written_number(whole)} and {'a ' + said[4:] if top == '1' and said.startswith('one ') else said}" if whole else said


def phone(country: str | None, groups: list[str], extension: str | None = None) -> str:
    parts = ([f"plus {digits(country)}"] if country else []) + [digits(g) if g.isdigit() else " ".join(g) for g in groups if g]
    return ", ".join(parts + ([f"extension {digits(extension)}"] if extension else []))


def address(text: str) -> str:
    """An electronic address: marks by name, digits one by one, the protocol and www spelled."""
    protocol, mark, rest = text.partition("://")
    head = f"{' '.join(protocol.lower())} colon slash slash " if mark else ""
    names = {".": "dot", "/": "slash", "-": "dash", "_": "underscore", "@": "at", ":": "colon", "?": "question mark", "=": "equal sign", "&": "and", "#": "hash", "~": "tilde", "+": "plus", "%": "percent"}
    parts = re.findall(r"[^\W\d_]+|\d|[^\s]", rest if mark else text)
    return head + " ".join("w w w" if p.lower() == "www" else ONES[int(p)] if p in "0123456789" else names.get(p, p) for p in parts)


def serial(text: str) -> str:
    """Letters as they are, digits one by one, hyphens as breaks."""
    return " ".join(digits(p) if p.isdigit() else p for p in re.findall(r"\d+|[^\W\d_]+", text))


def _date(y: str, m: str, d: str) -> str:
    return f"{MONTHS[int(m) - 1].lower()} {ordinal(int(d))} {year(int(y))}"


def _numeric_date(m: re.Match) -> str:
    a, b, y = m[1], m[3], m[4]
    month, day = (a, b) if int(a) <= 12 else (b, a)
    return _date(y, month, day) if 1 <= int(month) <= 12 and 1 <= int(day) <= 31 else m[0]


_MONTH = "|".join(MONTHS)
_MONTH_SHORT = "|".join(f"{x[:3]}\\.?" for x in MONTHS if x != "May")
_NUM = r"\d{1,3}(?:,\d{3})+(?!\d)|\d+"
_SUFFIX = "(?:st|nd|rd|th)"
_UNIT = "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True))
_COIN = r"US\$|[$€£¥₹]"
_SCALE = r"(?: ?(thousand|million|billion|trillion)\b| ?(k|K|M|bn|B|T)\b)?"
_TIME = r"([01]?\d|2[0-4]):([0-5]\d)"
_HALF = r"(?: ?([AaPp](?:\.[Mm]\.?|[Mm]\b))(?!\w))"


def _month(name: str) -> str:
    return next((m for m in MONTHS if m[:3] == name[:3]), name)


def _to(left: str, right: str) -> str:
    return f"{left} to {right}"


#: Rules in the order of their class priority; the first that fits at a place wins.  What a rule makes has no digits left.
RULES: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    # addresses
    (re.compile(r"\b(?:https?|ftp)://[^\s\[\]<>\"')]+[\w/]"), lambda m: address(m[0])),
    (re.compile(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"), lambda m: address(m[0])),
    (re.compile(r"\b(?:www\.)?[a-z][\w-]*(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|io|co|uk|de|fr|es|info)\b(?:/[\w./?=&%#-]*\w)?"), lambda m: address(m[0])),
    (re.compile(r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"), lambda m: " dot ".join(digits(g) for g in m.groups())),
    (re.compile(r"\bv(?:ersion )?(\d+(?:\.\d+)+)\b"), lambda m: "version " + " point ".join(quantity(x) for x in m[1].split("."))),
    # dates
    (re.compile(rf"\b({_MONTH}|{_MONTH_SHORT}) (\d{{1,2}}){_SUFFIX}?,? ([12]\d{{3}})\b"), lambda m: f"{_month(m[1])} {ordinal(int(m[2]))} {year(int(m[3]))}"),
    (re.compile(rf"\b(?:the )?(\d{{1,2}}){_SUFFIX}?(?: of)? ({_MONTH}),? ([12]\d{{3}})\b"), lambda m: f"the {ordinal(int(m[1]))} of {m[2]} {year(int(m[3]))}"),
    (re.compile(rf"\b({_MONTH}),? ([12]\d{{3}})\b"), lambda m: f"{m[1]} {year(int(m[2]))}"),
    (re.compile(rf"\b({_MONTH}|{_MONTH_SHORT}) (\d{{1,2}}){_SUFFIX}?\b(?![:.,]\d)"), lambda m: f"{_month(m[1])} {ordinal(int(m[2]))}"),
    (re.compile(r"\b([12]\d{3})([-/.])(0?[1-9]|1[0-2])\2(0?[1-9]|[12]\d|3[01])\b"), lambda m: _date(m[1], m[3], m[4])),
    (re.compile(r"\b(\d{1,2})([-/.])(\d{1,2})\2([12]\d{3})\b"), _numeric_date),
    (re.compile(r"\b(mid|early|late)[- ]([12]\d\d0)'?s\b"), lambda m: f"{m[1]} {decade(m[2])}"),
    (re.compile(r"\b([12]\d\d0)'?s\b"), lambda m: decade(m[1])),
    (re.compile(r"(?<!\w)['’]?(\d0)['’]?s\b"), lambda m: decade(m[1])),
    (re.compile(r"\b([12]\d{3}) ?[-–] ?([12]\d{3})\b(?![-–/.]\d)"), lambda m: _to(year(int(m[1])), year(int(m[2])))),
    (re.compile(r"\b([1-4])(Q|H)(?:'|20)?(\d{2})\b"), lambda m: f"{ordinal(int(m[1]))} {'quarter' if m[2] == 'Q' else 'half'} of {year(2000 + int(m[3]))}"),
    (re.compile(r"\b(\d{1,4}) ?(AD|BCE|BC|CE|A\.D\.|B\.C\.)(?!\w)"), lambda m: f"{year(int(m[1]))} {' '.join(m[2].replace('.', ''))}"),
    # numbers to dial
    (re.compile(r"(?<![\d-])(?:\+?(\d{1,3})[ .-])?\(?(\d{3})\)?[ .-](\d{3})[ .-](\d{4})(?:,? ?(?:ext\.?|x|extension) ?(\d{1,6}))?\b(?!-\d)"), lambda m: phone(m[1], [m[2], m[3], m[4]], m[5])),
    (re.compile(r"(?<![\w-])(\d)-(\d{3})-([A-Z]{4,10})\b"), lambda m: phone(None, [m[1], m[2], m[3]])),
    (re.compile(r"\b(\d{3})-(\d{2})-(\d{4})\b"), lambda m: phone(None, list(m.groups()))),
    (re.compile(r"(?<![\d-])(\d{3})-(\d{4})\b(?!-\d)"), lambda m: phone(None, list(m.groups()))),
    (re.compile(r"(?<![\w+])\+(\d{1,3}) ?(\d[\d ]{6,14}\d)\b"), lambda m: phone(m[1], m[2].split())),
    # times
    (re.compile(rf"\b{_TIME}:([0-5]\d)\b"), lambda m: clock(m[1], m[2], None, None, m[3])),
    (re.compile(rf"\b{_TIME} ?[-–] ?{_TIME}{_HALF}?(?: ({ZONES})\b)?"), lambda m: _to(clock(m[1], m[2], None), clock(m[3], m[4], m[5], m[6]))),
    (re.compile(rf"\b{_TIME}{_HALF}?(?: ({ZONES})\b)?"), lambda m: clock(m[1], m[2], m[3], m[4])),
    (re.compile(rf"\b(1[0-2]|0?[1-9])\.([0-5]\d){_HALF}(?: ({ZONES})\b)?"), lambda m: clock(m[1], m[2], m[3], m[4])),
    (re.compile(rf"\b(1[0-2]|0?[1-9]){_HALF}(?: ({ZONES})\b)?"), lambda m: clock(m[1], None, m[2], m[3])),
    # money
    (re.compile(rf"({_COIN}) ?({_NUM})(?:\.(\d+))?{_SCALE} ?[-–] ?(?:{_COIN})? ?({_NUM})(?:\.(\d+))?{_SCALE}(?![\d%])"), lambda m: _to(money(m[1], m[2], m[3], m[4] or m[5]), money(m[1], m[6], m[7], m[8] or m[9]))),
    (re.compile(rf"({_COIN}) ?({_NUM})(?:\.(\d+))?{_SCALE}(?:/(hour|day|week|month|year|{_UNIT})\b)?(?!\d)"), lambda m: money(m[1], m[2], m[3], m[4] or m[5]) + (f" per {unit(m[6])}" if m[6] else "")),
    (re.compile(rf"\b({_NUM})(?:\.(\d+))?{_SCALE} ?([$€£¥₹])(?!\w)"), lambda m: money(m[5], m[1], m[2], m[3] or m[4])),
    # measures
    (re.compile(rf"\b({_NUM})(?:\.(\d+))? ?[-–] ?({_NUM})(?:\.(\d+))? ?((?:{_UNIT})[23²³]?(?:/(?:{_UNIT}))?)(?!\w)"), lambda m: f"{_to(amount(m[1], m[2]), amount(m[3], m[4]))} {_units(m[5], False)}"),
    (re.compile(rf"\b({_NUM})(?:\.(\d+))? ?((?:{_UNIT})[23²³]?(?:/(?:{_UNIT}))?)(?!\w)"), lambda m: f"{amount(m[1], m[2])} {_units(m[3], m[1] == '1' and not m[2])}"),
    (re.compile(rf"({_NUM})(?:\.(\d+))? ?[-–] ?({_NUM})(?:\.(\d+))? ?%"), lambda m: f"{_to(amount(m[1], m[2]), amount(m[3], m[4]))} percent"),
    (re.compile(rf"({_NUM})(?:\.(\d+))? ?%"), lambda m: f"{amount(m[1], m[2])} percent"),
    (re.compile(r"\b(\d+) ?[x×] ?(\d+)\b"), lambda m: f"{written_number(m[1])} by {written_number(m[2])}"),
    # fractions, ordinals, powers, decimals
    (re.compile(r"(?<![\d/.])(?:(\d+) )?(\d+)/(\d+)\b(?!/\d)"), lambda m: mixed(m[1], m[2], m[3])),
    (re.compile(rf"\b({_NUM}){_SUFFIX}\b"), lambda m: m[0] if _number(m[1]) is None else ordinal(_number(m[1]))),
    (re.compile(r"\b(\d+)(?:\.(\d+))?[eE]([+-]?)(\d{1,4})\b"), lambda m: f"{cardinal(int(m[1])) + (' point ' + digits(m[2]) if m[2] else '')} e {'negative ' if m[3] == '-' else ''}{cardinal(int(m[4]))}"),
    (re.compile(r"\b(\d+)(?:\.(\d+))? ?[x×*] ?10\^(-?)(\d+)"), lambda m: f"{amount(m[1], m[2])} times ten to the power of {'negative ' if m[3] else ''}{quantity(m[4])}"),
    (re.compile(r"(?<=\w)\^2\b|²"), lambda m: " squared"),
    (re.compile(r"(?<=\w)\^3\b|³"), lambda m: " cubed"),
    (re.compile(rf"\b({_NUM})\.(\d+)(?: (thousand|million|billion|trillion)\b)?"), lambda m: decimal(m[1], m[2]) + (f" {m[3]}" if m[3] else "")),
    (re.compile(r"(?<![\w.])\.(\d+)\b"), lambda m: f"point {digits(m[1])}"),
    # ranges, sums, identifiers, years, the rest
    (re.compile(r"(?<!\w)[~≈] ?(?=\d)"), lambda m: "approximately "),
    (re.compile(rf"(?<![\w.-])({_NUM}) ?(?:[-–]|\.\.\.|…) ?({_NUM})(?![\w-])"), lambda m: _to(written_number(m[1]), written_number(m[2]))),
    (re.compile(r"(?<=[\d\w]) ?\+ ?(?=\d)"), lambda m: " plus "),
    (re.compile(r"\b(?=[\w-]*\d)(?=[\w-]*[^\W\d_])[^\W_]+(?:-[^\W_]+)*\b"), lambda m: serial(m[0])),
    (re.compile(r"(?<![\w.,$€£-])([12]\d{3})(?![\w]|[.,:-]\d)"), lambda m: year(int(m[1]))),
    (re.compile(rf"(?<![\w.])({_NUM})(?![\w])"), lambda m: written_number(m[1])),
    (re.compile(r"[0-9]+"), lambda m: f" {digits(m[0])} "),
]
SIGN = re.compile(rf"(?<![\w\d])(?:[-−]({_COIN})(?=\d)|({_COIN})[-−](?=\d)|[-−](?=[\d.]\d*))")
_INITIALS = re.compile(r"\b(?:[A-Z]\.){2,}(?!\w)")
_STATE = re.compile(rf"(?<=[a-z], )({'|'.join(STATES)})\b")
_SHORT = re.compile(rf"(?<![^ ])(?:{'|'.join(sorted(map(re.escape, SHORT), key=len, reverse=True))})(?![^ ])")
#: What any rule, short form or sign needs to be there, and what the numbered rules need.
_NEEDS = re.compile(rf"[0-9½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞²³~≈@]|://|[a-z]\.[a-z]|(?:\b[A-Z]\.){{2}}|, [A-Z]{{2}}\b|{_SHORT.pattern}")
_NUMBERED = re.compile(r"[0-9@²³~≈]|://|[a-z]\.[a-z]")
_SENTENCE = re.compile(r"(?<=[.!?]) (?=[^\W\d_])")


def _say(text: str) -> str:
    for sign, plain in VULGAR.items():
        if sign in text:
            text = re.sub(rf"(?<=\d) ?{sign}", f" {plain}", text).replace(sign, plain)
    text = re.sub(r"(?<=\d)[ˢⁿʳᵗ][ᵗᵈʰ]", lambda m: m[0].translate(RAISED), text)
    text = SIGN.sub(lambda m: " minus " + (m[1] or m[2] or ""), text)
    if _NUMBERED.search(text):
        for pattern, say in RULES:
            text = pattern.sub(say, text)
    text = _STATE.sub(lambda m: STATES[m[1]], text)
    text = _SHORT.sub(lambda m: SHORT[m[0]], text)
    return _INITIALS.sub(lambda m: " ".join(m[0].replace(".", "")), text)


def normalize_text(text: str) -> str:
    """Bracketed tags stay as they are; in all else signs, rules in order, short forms; trailing quotes go.

    Sentences without anything to say differently are left alone.
    """
    tags, out = TAG.findall(text), []
    for i, part in enumerate(TAG.split(text)):
        part = re.sub(r"\s+", " ", part)
        # a short form before a name looks like the end of a sentence, which does no harm: no rule reaches across it
        out.append(" ".join(_say(s) if _NEEDS.search(s) else s for s in _SENTENCE.split(part)))
        out.append(tags[i] if i < len(tags) else "")
    return re.sub(r"\s+", " ", "".join(out)).strip().rstrip("\"'”")


def tidy_spaces(text: str) -> str:
    """No space before closing marks and after opening ones, one space elsewhere; doubled quotes become one sort."""
    text = re.sub(r"``|''", '"', text)
    text = re.sub(r"\s+([,.:;?!)\]}%])", r"\1", re.sub(r"([(\[{])\s+", r"\1", text))
    return re.sub(r"\s+", " ", text).strip()


def match_punctuation(written: str, spoken: str) -> str:
    """``spoken`` with the spaces around its punctuation as ``written`` has them.

    The k-th mark of a kind stands for the k-th of the other text; kinds that are not equally often in both are left.
    """
    written = written.replace("``", '"') if "``" not in spoken else written
    marks = {c for c in written if not c.isalnum() and not c.isspace() and c.isascii() and c != "_"}
    pads = {}
    for c in marks:
        mine, theirs = [m.start() for m in re.finditer(re.escape(c), written)], [m.start() for m in re.finditer(re.escape(c), spoken)]
        if len(mine) == len(theirs):
            for a, b in zip(mine, theirs):
                pads[b] = (a > 0 and written[a - 1].isspace(), a + 1 < len(written) and written[a + 1].isspace())
    out: list[str] = []
    skip = False
    for i, c in enumerate(spoken):
        if i in pads:
            before, after = pads[i]
            while out and out[-1] == " ":
                out.pop()
            out += ([" "] if before and out else []) + [c]
            if after and i + 1 < len(spoken):
                out.append(" ")
            skip = True
        elif c == " " and skip:
            continue
        else:
            out.append(c)
            skip = False
    return re.sub(" +", " ", "".join(out))


@F.pandas_udf(types.StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalize_text(t))


def spoken(c: Column) -> Column:
    """Arrow-batched ``normalize_text``; null stays null."""
    return _normalize(c)
