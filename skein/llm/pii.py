"""Personal information inside free text: found, and replaced by typed placeholders.

E-mail addresses, phone numbers, identity numbers, street and postal addresses and
person names are found in the text as a reader sees it (look-alike letters, widths and
invisible characters do not hide them); the placeholder goes into the text as it was.
Phone numbers, identity numbers and dates of birth are permuted within their format by a
keyed Feistel network: a value that is valid by its format's rules (numbering plan, social
security blocks, check letter, calendar) stays valid, one that is not stays invalid, country
code and length are kept. Equal values, however written, get equal pseudonyms in every
document, unequal ones unequal ones, and the key's holder can reverse them (revealed()).
Other kinds get a keyed tag.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from skein.llm.visual import TO_LATIN, fold_char, script
from skein.session import ship

KINDS = ("email", "phone", "id_number", "address", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


# -- keyed permutations --------------------------------------------------------------


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def feistel(values: list[int], base: int, key: bytes, tweak: str, rounds: int = 10, back: bool = False) -> list[int]:
    """A keyed permutation of fixed-length strings over range(base); back=True reverses it."""
    n = len(values)
    if n == 0:
        return []
    if n == 1:
        shift = _prf(key, tweak, base) % base
        return [(values[0] + (-shift if back else shift)) % base]
    half = n // 2
    a, b = 0, 0
    for v in values[:half]:
        a = a * base + v
    for v in values[half:]:
        b = b * base + v
    na, nb = base**half, base ** (n - half)
    for r in reversed(range(rounds)) if back else range(rounds):
        sign = -1 if back else 1
        if r % 2 == 0:
            a = (a + sign * _prf(key, tweak, n, r, b)) % na
        else:
            b = (b + sign * _prf(key, tweak, n, r, a)) % nb
    out = []
    for x, k in ((a, half), (b, n - half)):
        part = []
        for _ in range(k):
            x, d = divmod(x, base)
            part.append(d)
        out += reversed(part)
    return out


def pseudonym(value: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits and letters permuted in place, all else as it was."""
    digits = [i for i, c in enumerate(value) if c in "0123456789"]
    letters = [i for i, c in enumerate(value) if c.isascii() and c.isalpha()]
    out = list(value)
    for i, d in zip(digits, feistel([int(value[i]) for i in digits], 10, key, f"{tweak}/d", back=back), strict=True):
        out[i] = str(d)
    for i, d in zip(letters, feistel([ord(value[i].upper()) - 65 for i in letters], 26, key, f"{tweak}/l", back=back), strict=True):
        out[i] = chr(65 + d) if value[i].isupper() else chr(97 + d)
    return "".join(out)


def permuted(value: str, key: bytes, tweak: str, valid, back: bool = False) -> str:
    """A pseudonym that is valid exactly if the value is: the cycle is walked until that holds."""
    good, out = valid(value), value
    while True:
        out = pseudonym(out, key, tweak, back)
        if valid(out) == good:
            return out


def permuted_date(day: dt.date, key: bytes, back: bool = False, first: dt.date = dt.date(1900, 1, 1), days: int = 73_049) -> dt.date:
    """A date permuted among `days` days; walks the cycle of a six-digit permutation until it is back in range."""
    x = (day - first).days
    if not 0 <= x < days:
        return day
    while True:
        x = int("".join(map(str, feistel([int(c) for c in f"{x:06d}"], 10, key, "date", back=back))))
        if x < days:
            return first + dt.timedelta(days=x)


def tag(value: str, key: bytes, kind: str) -> str:
    """96 bits, so that no two people's values share a tag by chance."""
    return f"{_prf(key, kind, ' '.join(value.lower().split())) & ((1 << 96) - 1):024x}"


# -- the text as it looks, with the way back ------------------------------------------


def seen_text(text: str) -> tuple[str, list[int]]:
    """The text as a reader sees it and, for each of its characters, the place in the text."""
    if text.isascii():
        return text, list(range(len(text) + 1))
    chars: list[str] = []
    where: list[int] = []
    for i, c in enumerate(text):
        if c in "\n\r":
            chars.append("\n")
            where.append(i)
            continue
        if chars and unicodedata.combining(c):
            both = unicodedata.normalize("NFC", chars[-1] + c)
            if len(both) == 1:
                chars[-1] = both
                continue
        for x in fold_char(c):
            chars.append(x)
            where.append(i)
    where.append(len(text))
    out = "".join(chars)
    if any(c in TO_LATIN for c in chars):
        for m in re.finditer(r"[^\W_]+", out):
            token = m.group()
            if any(c in TO_LATIN for c in token) and all(c in TO_LATIN or script(c) in ("", "LATIN") for c in token):
                chars[m.start() : m.end()] = [TO_LATIN.get(c, c) for c in token]
        out = "".join(chars)
    return out, where


# -- patterns ------------------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)"
EMAIL = re.compile(
    rf"(?<![\w@.+-])(?:{_LOCAL}@{_LABEL}(?:\.{_LABEL})+|{_LOCAL}\s@\s{_LABEL}(?:\.{_LABEL})+|{_LOCAL}\s?[\[(]\s?(?:at|@)\s?[\])]\s?{_LABEL}(?:{_DOT}{_LABEL})+|{_LOCAL}\sat\s{_LABEL}(?:\sdot\s{_LABEL})+)",
    re.I,
)
#: What any e-mail address holds; looked for first, as it is cheap.
MAIL_SIGN = re.compile(r"\w@\w|\s@\s|[\[(]\s?(?:at|@)\s?[\])]|\sdot\s", re.I)
LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_EXT = r"(?:\s?(?:ext\.?|extension|x)\s?\d{1,5})?"
_S = r"[\s.-]?"
PHONES = [
    # North America: area and exchange codes start with 2 to 9
    re.compile(rf"(?<![\w#$.,/-])(?:\+?1{_S})?(?:\([2-9]\d\d\)\s?|[2-9]\d\d{_S})[2-9]\d\d{_S}\d\d{_S}\d\d(?![\w]|[.,-]\d){_EXT}"),
    # any country, international form
    re.compile(rf"(?<![\w#$])(?:\+|00)[1-9]\d{{0,2}}[\s.-]?(?:\(0\)[\s.-]?)?\d{{1,4}}(?:[\s./-]?\d{{2,8}}){{1,5}}(?!\w){_EXT}"),
    # Britain and France, national form in groups
    re.compile(rf"(?<![\w#$.,/-])07\d{{3}}\s?\d{{3}}\s?\d{{3}}(?!\w){_EXT}"),
    re.compile(r"(?<![\w#$.,/-])0[1-9](?:[\s.-]\d\d){4}(?!\w|[.-]\d)"),
    re.compile(r"(?<![\w#$.,/-])0\d{2,4}[\s/-]\d{3,4}[\s-]\d{3,4}(?!\w|[.-]\d)"),
]
#: Digits in words.
SPOKEN = "zero oh one two three four five six seven eight nine".split()
PHONES.append(re.compile(rf"(?<!\w)(?:(?:{'|'.join(SPOKEN)})[\s-]){{9,}}(?:{'|'.join(SPOKEN)})(?!\w)", re.I))
#: Words before a number that make it something else.
NO_PHONE = re.compile(r"(?:order|bag tag|tag|reference|ref|claim|confirmation|booking|invoice|tracking|ticket|voucher|case|flight|record locator|code|total|paid|#)\s?(?:no\.?|number|#|:)?\s?$", re.I)
SOLID = re.compile(r"^\d{10,11}$")

#: Names of identity numbers.
ID_WORDS = (
    r"ssn|social security(?: (?:number|no\.?|#))?|social(?= ?[:#])|passport(?: (?:number|no\.?|nr\.?))?|driver'?’?s?'? licen[cs]e(?: (?:number|no\.?))?|driving licen[cs]e(?: (?:number|no\.?))?|licen[cs]e (?:number|no\.?)"
    r"|national id(?:entity)?(?: (?:number|no\.?|card))?|identity (?:card|number)|id (?:card|number|no\.?)(?: (?:number|no\.?))?|national insurance(?: number)?|aadhaar(?: (?:number|no\.?))?|dni|nie|nif|personalausweis|ausweis(?:nummer)?|reisepass(?:nummer)?|pasaporte|passeport|carte d'identité|паспорт"
)
ID_CUED = re.compile(rf"(?<!\w)(?:{ID_WORDS})\s?(?:is\s|n[°º]\s?)?[:#]?\s?#?((?:[A-Z]{{1,3}}[\s-]?)?\d[\dA-Z]*(?:[\s.-]\d[\dA-Z]*)*(?:-?[A-Z](?![A-Za-z]))?)(?!\w)", re.I)
SSN = re.compile(r"(?<![\w#$.,/+-])\d{3}-\d{2}-\d{4}(?![\w-])")

#: Kinds of streets.
_TYPES = r"street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|way|boulevard|blvd\.?|place|pl\.?|terrace|square|close|crescent|parkway|pkwy\.?|highway|circle|trail"
_DIR = r"(?:(?:north|south|east|west|[nsew]|ne|nw|se|sw)\.?\s)?"
_W = r"[^\W\d_][\w'’-]*"
_CITY = r"(?-i:[A-ZÀ-Þ][a-zà-ÿ][\w'’-]*(?:\s(?!Instead|In\b)[A-ZÀ-Þ][a-zà-ÿ][\w'’-]*){0,2}|[a-zà-ÿ]+(?:\s[a-zà-ÿ]+)?(?=\s*(?:[.;!?/)]|$)))"
_MONTH = r"(?!january|february|march|april|may\b|june|july|august|september|october|november|december)"
_TAIL_US = rf"(?:,?\s(?:apt|apartment|unit|suite|ste|flat|#)\.?\s?\w+)?(?:(?:,\s|\sin\s|(?<=\w)\s(?=[A-Z][a-z]+,?\s[A-Z]{{2}}\s\d)){_MONTH}{_CITY}(?:,?\s?(?-i:[A-Z]{{2}})(?:\s\d{{5}})?(?!\w))?)?"
ADDRESSES = [
    re.compile(rf"(?<![\w$#:.@-])(?:(?:flat|apt|unit|suite)\s\w+,\s)?\d{{1,5}}[a-z]?\s{_DIR}({_W}(?:\s{_W}){{0,2}})\s(?:{_TYPES})(?![\w'’])(?!\sdate)", re.I),
    re.compile(r"(?<!\w)(?:p\.?\s?o\.?\sbox|postfach|apartado|boîte postale)\s\d+", re.I),
    re.compile(rf"(?<!\w){_W}(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm|ring)\s\d{{1,4}}[a-z]?(?!\w)(?:,\s\d{{5}}(?:\s(?-i:[A-ZÄÖÜ])[\w'’-]+){{1,2}})?", re.I),
    re.compile(rf"(?<![\w$#:.-])\d{{1,4}}(?:\s?bis)?,?\s(?:rue|avenue|allée|allee|boulevard|chemin|impasse|quai|cours|place)\s(?:(?:de la|de l'|des|du|de|d'|la|le|les)\s?)?{_W}(?:\s{_W})?(?:,\s\d{{5}}(?:\s(?-i:[A-Z])[\w'’-]+){{1,2}})?", re.I),
    re.compile(rf"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|carrer|c/)\s(?:(?:de las|de los|de la|del|de|la|el)\s)?{_W}(?:\s{_W})?,?\s\d{{1,4}}(?:,\s\d{{1,2}}\s?º\s?[A-Z]?)?", re.I),
    re.compile(rf"(?<!\w)(?:rue|avenue|boulevard|place|quai)\s(?:(?:de la|de l'|des|du|de|d'|la|le|les)\s?)?(?-i:[A-ZÀ-Þ])[\w'’-]*(?:\s(?-i:[A-ZÀ-Þ])[\w'’-]*)?,?\s\d{{1,4}}(?!\w)(?:,\s(?-i:[A-Z])[\w'’-]+)?", re.I),
    re.compile(rf"(?<!\w)(?:улица|ул\.|проспект|пр\.)\s{_W},?\s(?:д\.?\s)?\d{{1,4}}", re.I),
]
#: The German form's place in the list, and what any of its finds holds.
GERMAN, STREET_SIGN = 2, re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm|ring)\s\d", re.I)
#: Words that are no part of a street's name.
NO_STREET = set("of the a an and or in on at to for from with by is was were are be my your our their this that it no not any all some minutes minute hours hour days day weeks week months years people emails calls pages members miles pounds loyalty points usd dollars percent times row gate seat terminal level unit".split())

_TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|herr|frau|mme)\.?"
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
TITLED = re.compile(rf"(?<![\w@^]){_TITLE}[^\S\n]", re.I)
#: What comes before a name, and after one.
BEFORE = re.compile(
    r"(?<![\w@])(?:my name is|this is|i am called|name on (?:the )?(?:booking|ticket|order) is|booked under|booking under|reserved (?:under|for)|under the name(?: of)?|kudos to|shout ?out to|ask for|asked for|spoke (?:to|with)|talked (?:to|with)|the (?:agent|rep|clerk|manager|captain|supervisor) was|agent was|signed,?|cc|tell|thanks for waiting,?|thank you for waiting,?|our colleague|passenger|traveller|traveler|guest|(?:please )?contact|i am|i'm|names?:|regards,|sincerely,|cheers,|yours,|best,|attn:?|attention:|contact person:?|me llamo|mi nombre es|je m'appelle|mon nom est|ich heiße|mein name ist|меня зовут)\s",
    re.I,
)
#: Cues that many other words follow; after them only a full name in capitals counts.
WEAK = ("contact", "please contact", "i am", "i'm", "name:", "names:")
GREETING = re.compile(r"(?<![\w@])(?:hi|hello|hey|dear|hola|bonjour|hallo)\s(?=(?:[A-ZÀ-Þ]|[a-z]+ [a-z'’-]+,))", re.I)
AFTER = re.compile(r"\s(?:never called|never rang|at the desk|from our (?:team|desk|office)|from your (?:team|desk|office)|i said hi|will call|will ring|said hi)(?!\w)", re.I)
SIGNATURE = re.compile(r"(?:^|(?<=\s))[-–—]\s(?=[^\W\d_])")
ENDS = re.compile(r"\s*(?:[.,!?;/]|$|https?:|[@#])")
#: Parts of family names, and words that are no names.
PARTICLES = set("van der den de del della di da von zu la le al el bin ibn ten ter dos du st".split())
NO_NAME = set(
    "a an the us me my mine your yours our ours their his her its it this that these those there here team all everyone everybody someone somebody anyone nobody folks people any some no none not more less help information info details "
    "manager supervisor agent agents staff crew captain pilot clerk rep reps host driver handler guy lady attendant desk gate counter kiosk phone app website chat line form email message refund refunds voucher vouchers miles callback answer "
    "answers receipt seat seats booking order parcel bag bags flight and or but so because when while with without for from to in on at of by as is was were are be been am will would can could should did does do has have had never "
    "i you he she we they him them who whom what why how wow ugh hey hi hello ok okay seriously unbelievable update question again please thanks thank today tomorrow tonight yesterday monday tuesday wednesday thursday friday saturday sunday "
    "last this next week month morning afternoon evening night noon both half zero one two three four five six seven eight nine ten still just only really very too also now then than way old new wrong right "
    "rude filthy lovely awful great good bad nice kind helpful weird slow patient painful spotless smooth careless chaotic bizarre brilliant cold confusing decent dismissive exhausting generous shocking sloppy unreal clear already "
    "called rang said going here waiting delayed cancelled furious sorry upset angry happy stuck lost worried record speechless https http www customer customers passengers guests riders callers travelers frequent parents".split()
)


def _phrase(s: str, at: int) -> int | None:
    """Where a name that starts at `at` ends; None if there is none."""
    m = re.match(rf"{_TITLE}\s", s[at:], re.I)
    titled, p = bool(m), at + (m.end() if m else 0)
    end, real, n, capital = None, 0, 0, False
    comma_used = False
    while n < 5:
        m = re.match(rf"({_NAME}\.?)", s[p:])
        if not m:
            break
        raw = m.group(1)
        token = raw.rstrip(".")
        low = token.lower()
        initial = len(token) == 1 and raw.endswith(".") or len(token) == 1 and token.isupper() and real
        if raw.endswith(".") and len(token) > 1:
            raw = token
        if not initial and (low in NO_NAME and not (titled and n == 0) or re.fullmatch(_TITLE, low) and n):
            break
        n += 1
        q = p + len(raw)
        if low in PARTICLES and re.match(rf"\s{_NAME}", s[q:]):
            p = q + 1
            continue
        real += not initial
        capital |= token[0].isupper()
        end = q
        nxt = re.match(rf",\s({_NAME})((?:\s[^\W\d_]\.?)?)(?=\s*(?:[.,!?;/)\n]|$|never|at the desk|i said|will call|from our|@|#|[^\w\s'’,]))", s[q:], re.I)
        if nxt and not comma_used and real == 1 and not initial and nxt.group(1)[0].isupper() and nxt.group(1).lower() not in NO_NAME:
            end, real = q + nxt.end(2), real + 1
            break
        m = re.match(r"\s", s[q:])
        if not m or s[q : q + 1] == "\n":
            break
        p = q + 1
    if end is None or not real:
        return None
    return end if titled or real > 1 or capital or n > 1 or len(s[at:end]) >= 3 else None


def _names(s: str) -> Iterator[tuple[int, int]]:
    mixed = not (s.isupper() or s.islower())
    for rx in (BEFORE, GREETING, SIGNATURE, TITLED):
        for m in rx.finditer(s):
            at = m.start() if rx is TITLED else m.end()
            end = _phrase(s, at)
            if end is None:
                continue
            found = s[at:end]
            words = re.findall(_NAME, found)
            if rx is TITLED and (len(words) < 2 or mixed and not words[1][0].isupper() and words[1].lower() not in PARTICLES):
                continue
            if rx in (GREETING, SIGNATURE) and mixed and not found[0].isupper() and (len(words) < 2 or not ENDS.match(s, end)):
                continue
            if rx in (SIGNATURE, GREETING) and not ENDS.match(s, end):
                continue
            cue = m.group().lower().strip()
            if rx is BEFORE and len(words) == 1 and (not found[0].isupper() or not mixed) and cue in ("the agent was", "agent was", "this is", "tell", "the captain was", "the supervisor was", "the manager was", "the clerk was", "the rep was", "our colleague"):
                continue
            if rx is BEFORE and cue in ("tell", "this is", "guest") and mixed and not found[0].isupper() and len(words) < 2:
                continue
            if rx is BEFORE and cue in WEAK and not (mixed and len(words) > 1 and all(w[0].isupper() or w.lower() in PARTICLES for w in words)):
                continue
            yield at, end
    for m in AFTER.finditer(s):
        head = s[max(0, m.start() - 60) : m.start()]
        cut = max((x.end() for x in re.finditer(r"[!?;/:\n()]\s*|(?<!\b[^\W\d_])(?<!\bmr)(?<!\bms)(?<!\bdr)(?<!\bmrs)\.\s+|@\w+\s+|[^\w\s.,'’-]\s*|\d\w*\s*", head, re.I)), default=0)
        rest = head[cut:]
        starts = [x.start() for x in re.finditer(rf"(?<![\w'’-])(?:{_TITLE}\s)?{_NAME}", rest, re.I)]
        for a in starts[-6:]:
            at = m.start() - len(rest) + a
            if _phrase(s, at) == m.start():
                if len(re.findall(_NAME, s[at : m.start()])) == 1 and mixed and not s[at].isupper():
                    break
                yield at, m.start()
                break


def find(text: str | None, births: bool = False) -> list[Span]:
    """Personal information in a text, in order and without overlap; places are those of the text itself.

    births: dates of birth too, as kind date; other dates never count. Null, empty and blank texts hold none.
    """
    if not text or not text.strip():
        return []
    s, where = seen_text(text)
    taken = bytearray(len(s) + 1)
    spans: list[Span] = []

    def take(a: int, b: int, kind: str) -> None:
        if a < b and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            spans.append(Span(where[a], where[b - 1] + 1, kind, s[a:b]))

    for m in LINK.finditer(s):
        taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    if MAIL_SIGN.search(s):
        for m in EMAIL.finditer(s):
            take(m.start(), m.end(), "email")
    digits = any(c.isdigit() for c in s)
    if digits:
        for m in ID_CUED.finditer(s):
            if sum(c.isdigit() for c in m.group(1)) >= 5:
                take(m.start(1), m.end(1), "id_number")
        for m in SSN.finditer(s):
            take(m.start(), m.end(), "id_number")
        if births:
            for m in BIRTH.finditer(s):
                take(m.start(1), m.end(1), "date")
    for rx in PHONES:
        for m in rx.finditer(s):
            before = s[max(0, m.start() - 24) : m.start()]
            if NO_PHONE.search(before) and not m.group().startswith("+"):
                continue
            take(m.start(), m.end(), "phone")
    if digits:
        for k, rx in enumerate(ADDRESSES):
            if k == GERMAN and not STREET_SIGN.search(s):
                continue
            for m in rx.finditer(s):
                if k == 0 and any(w.lower() in NO_STREET for w in m.group(1).split()):
                    continue
                end = m.end()
                if k == 0 and re.search(r"\bdr\.?$", m.group(), re.I) and re.match(rf"\.?\s({_NAME}|[^\W\d_]\.)", s[end:]) and not re.match(r"\s(?:in|instead|please|unit|apt)\b", s[end:], re.I) and m.group(1)[0].islower():
                    continue
                if k in (0, 1):
                    tail = re.match(_TAIL_US, s[end:], re.I)
                    end += tail.end() if tail else 0
                while end > m.end() and s[end - 1] in " ,":
                    end -= 1
                take(m.start(), end, "address")
    for a, b in _names(s):
        take(a, b, "name")
    return sorted(spans)


#: Country codes of one and two digits; all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Check letters of Spanish identity numbers by the remainder of 23.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


class Phone(NamedTuple):
    """Country code (empty if the writing does not tell it), national number without leading 0, extension or empty."""

    country: str
    national: str
    extension: str

    def __str__(self) -> str:
        return (f"+{self.country} " if self.country else "0 ") + self.national + (f" x{self.extension}" if self.extension else "")


def phone(value: str) -> Phone:
    """The number a writing stands for. North American, British mobile and French national forms tell their country."""
    m = re.match(r"(.*?)\s?(?:ext\.?|extension|x)\s?(\d{1,5})$", value.strip(), re.I)
    main, extension = (m.group(1), m.group(2)) if m else (value, "")
    main = main.lower().replace("(0)", "").strip()
    found = re.findall(r"[a-z]+|\d", main)
    digits = "".join(w if w.isdigit() else str(0 if w in ("zero", "oh") else SPOKEN.index(w) - 1) for w in found if w.isdigit() or w in SPOKEN)
    if main.startswith("+") or digits.startswith("00"):
        digits = digits[2:] if digits.startswith("00") else digits
        n = next((k for k in (1, 2) if digits[:k] in CODES), 3)
        return Phone(digits[:n], digits[n:].lstrip("0") or digits[n:], extension)
    if len(digits) == 11 and digits[0] == "1":
        return Phone("1", digits[1:], extension)
    if len(digits) == 10 and digits[0] in "23456789":
        return Phone("1", digits, extension)
    if len(digits) == 11 and digits.startswith("07"):
        return Phone("44", digits[1:], extension)
    if re.fullmatch(r"0[1-9](?:[\s.-]\d\d){4}", main):
        return Phone("33", digits[1:], extension)
    return Phone("", digits.lstrip("0") or digits, extension)


def _valid_national(country: str):
    """Whether a national number fits its plan: in North America area and exchange start with 2 to 9, elsewhere no leading 0."""
    if country == "1":
        return lambda n: len(n) == 10 and n[0] > "1" and n[3] > "1"
    return lambda n: n[:1] != "0"


def _valid_id(value: str) -> bool:
    """Whether an identity number keeps a rule that its form has: social security blocks, Spanish check letter."""
    if re.fullmatch(r"\d{9}", value):
        return value[:3] not in ("000", "666") and value[0] != "9" and value[3:5] != "00" and value[5:] != "0000"
    if re.fullmatch(r"\d{8}[A-Z]", value):
        return CHECK_LETTERS[int(value[:8]) % 23] == value[8]
    return True


def _id(value: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", value).upper()


def _phone_moved(p: Phone, key: bytes, back: bool = False) -> Phone:
    n = permuted(p.national, key, f"phone/{p.country}", _valid_national(p.country), back)
    return p._replace(national=n, extension=pseudonym(p.extension, key, "extension", back))


#: Names of the months.
_MONTHS = "january february march april may june july august september october november december".split()
BIRTH = re.compile(
    rf"(?<!\w)(?:born(?:\son)?|date of birth(?:\sis)?|d\.?o\.?b\.?|birth\s?date|birthday(?:\sis)?|geboren am|geburtsdatum|né(?:e)? le|nacid[oa] el|fecha de nacimiento)\s?[:,]?\s?(\d{{4}}-\d\d-\d\d|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s(?:{'|'.join(_MONTHS)}),?\s\d{{4}}|(?:{'|'.join(_MONTHS)})\s\d{{1,2}}(?:st|nd|rd|th)?,?\s\d{{4}})(?!\w)",
    re.I,
)


def date(value: str) -> dt.date | None:
    """The day a writing stands for; of two readings with slashes the month first, if there is such a month. None if there is no such day."""
    numbers = [int(x) for x in re.findall(r"\d+", value)]
    month = next((i for i, m in enumerate(_MONTHS, 1) if m in value.lower()), None)
    if month:
        d, y = numbers[0], numbers[1]
    elif "-" in value:
        y, month, d = numbers
    elif "/" in value and numbers[0] <= 12:
        month, d, y = numbers
    else:
        d, month, y = numbers
    try:
        return dt.date(y, month, d)
    except ValueError:
        return None


def placeholder(span: Span, key: bytes) -> str:
    kind = span.kind.upper()
    if span.kind == "phone":
        return f"[{kind} {_phone_moved(phone(span.value), key)}]"
    if span.kind == "id_number":
        return f"[{kind} {permuted(_id(span.value), key, 'id', _valid_id)}]"
    if span.kind == "date" and (day := date(span.value)):
        return f"[{kind} {permuted_date(day, key)}]"
    return f"[{kind} {tag(span.value, key, span.kind)}]"


def revealed(text: str, key: bytes) -> str | None:
    """The canonical value behind a placeholder of a phone number, identity number or date; None for tags."""
    kind, _, rest = text.strip("[]").partition(" ")
    if kind == "PHONE":
        m = re.fullmatch(r"(?:\+(\d+)|0) (\d+)(?: x(\d+))?", rest)
        return str(_phone_moved(Phone(m.group(1) or "", m.group(2), m.group(3) or ""), key, back=True)) if m else None
    if kind == "ID_NUMBER":
        return permuted(rest, key, "id", _valid_id, back=True)
    if kind == "DATE" and re.fullmatch(r"\d{4}-\d\d-\d\d", rest):
        return str(permuted_date(dt.date.fromisoformat(rest), key, back=True))
    return None


def redact(text: str | None, key: bytes, spans: list[Span] | None = None) -> str | None:
    """The text with a typed placeholder for each find, otherwise as it was; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s in find(text) if spans is None else spans:
        out += [text[at : s.start], placeholder(s, key)]
        at = s.end
    return "".join([*out, text[at:]])


# -- operators -----------------------------------------------------------------------


def with_pii(df: DataFrame, text: str, key: bytes, births: bool = False) -> DataFrame:
    """df with redacted (string) and kinds (array, sorted, distinct) beside its other columns.

    births: dates of birth are replaced too, and date is among the kinds. Columns of these names are replaced. One pass without a shuffle, whole texts.
    """
    ship(df.sparkSession)
    base = df.drop("redacted", "kinds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            redacted, kinds = [], []
            seen: dict[str, tuple] = {}
            for t in b["_pii_text"]:
                if t not in seen:
                    spans = find(t, births)
                    seen[t] = (redact(t, key, spans), sorted({s.kind for s in spans}))
                r, k = seen[t]
                redacted.append(r)
                kinds.append(k)
            yield b.drop(columns="_pii_text").assign(redacted=redacted, kinds=kinds)

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return base.withColumn("_pii_text", F.col(text).cast("string")).mapInPandas(run, schema)
