"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are read as an index into the set of all values of their format,
permuted there by a keyed Feistel network with cycle walking, and written back in the same
format. A permutation has no collisions and depends on the key and the kind alone, so equal
values get equal pseudonyms in all documents, and different values different ones.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mediaframe.llm.common import texts
from mediaframe.llm.tokens import in_slices

ROUNDS = 8
#: Numbers as issuers give them, and digits of the groups in which they are written.
ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7]|35)\d{14}|3[47]\d{13}|3[0689]\d{12}|6\d{15,18}")
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3)}
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Days after the 12th: written month first they can't be read day first, so their pseudonyms are of the same kind.
LATE_DAYS = [d for d in range(FIRST_DAY, LAST_DAY + 1) if dt.date.fromordinal(d).day > 12]


def permute(x: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0..size-1, one for each kind and size."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8
    salt = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64]).digest()
    mix = lambda k, half: int.from_bytes(hashlib.blake2b(k.to_bytes(1, "big") + half.to_bytes(width, "big"), key=salt, digest_size=width + 8).digest(), "big")
    while True:
        left, right = divmod(x, b)
        for k in range(0, ROUNDS, 2):
            left = (left + mix(k, right)) % a
            right = (right + mix(k + 1, left)) % b
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if c.isdecimal() else c for c in shape)


def _card(run: str, key: bytes) -> str:
    """The pseudonym of a run whose digits are a valid number."""
    digits = re.sub(r"\D", "", run)
    low = 10 ** (len(digits) - 2)
    body = str(low + permute(int(digits[:-1]) - low, 9 * low, key, "card"))
    return _refill(run, body + str(luhn(body)))


def _check_sums(digits: list[int]) -> list[list[int]]:
    """Running sums of digits at even and odd places as they are, then doubled as check digits ask for: so that any window is tested in one step."""
    sums = [[0], [0], [0], [0]]
    for k, d in enumerate(digits):
        for part in range(4):
            sums[part].append(sums[part][-1] + (0 if k % 2 != part % 2 else d if part < 2 else d * 2 - 9 * (d > 4)))
    return sums


def _windows(run: str) -> Iterator[tuple[bool, int, int, int, int]]:
    """Whether it is unusual, start and negative end, and groups from and to, of every window of 13 to 19 digits between bounds of groups that has a valid check digit."""
    groups = [g.span() for g in re.finditer(r"\d+", run)]
    digits = [int(c) for c in run if c.isdecimal()]
    sums, first = _check_sums(digits), [0]
    for lo, hi in groups:
        first.append(first[-1] + hi - lo)
    for k in range(len(groups)):
        i, e = first[k], k
        if digits[i] == 0:
            continue
        while e < len(groups) and first[e + 1] - i < 13:
            e += 1
        while e < len(groups) and first[e + 1] - i <= 19:
            j = first[e + 1]
            own, other = (j - 1) % 2, 2 + j % 2
            if (sums[own][j] - sums[own][i] + sums[other][j] - sums[other][i]) % 10 == 0:
                sizes = tuple(hi - lo for lo, hi in groups[k : e + 1])
                usual = (sizes in CARD_GROUPS or len(sizes) == 1) and ISSUED.fullmatch("".join(map(str, digits[i:j])))
                yield not usual, groups[k][0], -groups[e][1], k, e + 1
            e += 1


def _cards(m: re.Match, key: bytes) -> list[tuple[int, int, str]]:
    """Start, end and pseudonym of the cards in a run of digits, by place. Of windows that overlap one stays: those issued
    and grouped as cards are first, then the leftmost, then the longest. Only what stays is permuted; time and memory grow with the run's length."""
    run, kept = m.group(), []
    taken = bytearray(len(run))  # more than it has groups
    for _, lo, hi, k, e in sorted(_windows(run)):
        if not any(taken[k:e]):
            taken[k:e] = b"\1" * (e - k)
            kept.append((lo, -hi))
    return [(m.start() + lo, m.start() + hi, _card(run[lo:hi], key)) for lo, hi in sorted(kept)]


def _holds(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and apart, has places from start on and before end."""
    at = bisect.bisect_left(spans, end, key=lambda s: s[0]) - 1
    return at >= 0 and spans[at][1] > start


def _phone(m: re.Match, key: bytes, cards: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
    """Start, end and pseudonym: the most groups that have 6 to 14 digits and don't end within a card."""
    at, country = m.end("country"), m["country"]
    for g in reversed(list(re.finditer(r"\d+", m.group()[len(country) :]))):
        shape = m.string[at : at + g.end()]
        digits = re.sub(r"\D", "", shape)
        if 6 <= len(digits) <= 14 and not _holds(cards, at + g.end(), at + g.end()):
            new = (_national(digits, key) if country == "+1" else None) or str(permute(int(digits), 10 ** len(digits), key, "phone" + country)).zfill(len(digits))
            return m.start(), at + g.end(), country + _refill(shape, new)
    return None


def _national(digits: str, key: bytes) -> str | None:
    """Ten digits whose area and exchange begin with 2 to 9, as others of that kind; with and without +1 they are the same numbers."""
    if not re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", digits):
        return None
    area, exchange, line = int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])
    rest, line = divmod(permute((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, key, "phone of ten digits"), 10_000)
    return f"{rest // 800 + 200}{rest % 800 + 200}{line:04d}"


def _ten_digits(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    new = _national(digits[-10:], key)
    return new and _refill(m.group(), digits[:-10] + new)


def _by_class(text: str, key: bytes, kind: str) -> str:
    """Letters stay letters of their case and digits digits; other characters stay."""
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    own = [next((s for s in sets if c in s), None) for c in text]
    size, x = 1, 0
    for c, s in zip(text, own, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    x = permute(x, size, key, kind + "".join("." if s is None else str(sets.index(s)) for s in own))
    out = []
    for c, s in zip(reversed(text), reversed(own), strict=True):
        if s:
            x, r = divmod(x, len(s))
            c = s[r]
        out.append(c)
    return "".join(reversed(out))


def _iban(m: re.Match, key: bytes) -> str | None:
    """Numbers whose check digits are right; country and spaces stay, the check digits are made anew."""
    code = m.group().replace(" ", "")
    number = lambda country, check, body: int("".join(str(int(c, 36)) for c in body + country + check))
    if not 15 <= len(code) <= 34 or number(code[:2], code[2:4], code[4:]) % 97 != 1:
        return None
    body = _by_class(code[4:], key, "iban" + code[:2])
    new = iter(code[:2] + f"{98 - number(code[:2], '00', body) % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in m.group())


def _ip6(m: re.Match, key: bytes) -> str | None:
    """Addresses of three written groups at least, or of a whole first one and another, in the shortest form."""
    try:
        x = int(ipaddress.IPv6Address(m.group()))
    except ValueError:
        return None
    groups = m.group().split(":")
    if sum(map(bool, groups)) < (2 if len(groups[0]) == 4 else 3):
        return None
    return str(ipaddress.IPv6Address(permute(x, 1 << 128, key, "ip6")))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(permute(index, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(index, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m.group().split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m.group().split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(m: re.Match, key: bytes) -> str | None:
    text = m.group()
    kind = "%Y-%m-%d" if "-" in text else "%Y/%m/%d" if text[:4].isdecimal() else "%d.%m.%Y" if "." in text else "%d/%m/%Y"
    try:
        day = dt.datetime.strptime(text, kind).date().toordinal()
    except ValueError:
        return _month_first(text, key) if kind == "%d/%m/%Y" else None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = dt.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    return _written(new, kind, text)


def _month_first(text: str, key: bytes) -> str | None:
    try:
        day = dt.datetime.strptime(text, "%m/%d/%Y").date().toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = permute(bisect.bisect_left(LATE_DAYS, day), len(LATE_DAYS), key, "date month first")
    return _written(dt.date.fromordinal(LATE_DAYS[new]), "%m/%d/%Y", text)


def _written(day: dt.date, kind: str, like: str) -> str:
    """day in a format, without leading zeros where the date that it stands for has a part of one digit."""
    parts = day.strftime(kind)
    return re.sub(r"(?<!\d)0(?=\d)", "", parts) if re.search(r"(?<!\d)\d(?!\d)", like) else parts


def _email(m: re.Match, key: bytes) -> str | None:
    """Letters stay letters and digits digits in the local part; the domain stays."""
    local, at, domain = m.group().partition("@")
    return _by_class(local, key, "email") + at + domain


#: Kinds in order of precedence where matches begin at one place; phones and cards, whose runs of digits are cut, come after.
KINDS = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}"), _email),
    "date": (re.compile(r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?=[Tt]\d\d|(?![\w/-]))"), _date),
    "ssn": (re.compile(r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"), _ssn),
    "ip": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _ip),
    "ip6": (re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])"), _ip6),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    "phone10": (re.compile(r"(?<![\w+.-])(?:1[-. ])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])[2-9]\d\d[-. ]\d{4}(?![\w-]|\.\d)"), _ten_digits),
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip6": ":"}
#: After + the country is what stands before a separator, or, where none follows, the code of its numbering zone; 15 digits at most are then in one run.
PHONE = re.compile(r"(?<![\w+])(?P<country>\+(?:\d{1,3}(?=[ (-])|(?!\d{16})(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)(?=\d)))[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?!\w)")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,}(?![\w-])")
_MAYBE = re.compile(r"[0-9]|@")


def pseudonymize_text(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, by code point in the original."""
    if not _MAYBE.search(text):
        return text, []
    found, cards = [], [c for m in CARD.finditer(text) for c in _cards(m, key)]
    for rank, (kind, (pattern, change)) in enumerate(KINDS.items()):
        if kind in NEEDS and NEEDS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            new = change(m, key)
            if new is not None and not (kind == "phone10" and _holds(cards, m.start(), m.end())):
                found.append((m.start(), rank, m.end(), "phone" if kind == "phone10" else kind, new))
    for m in PHONE.finditer(text):
        new = _phone(m, key, cards)
        if new is not None:
            found.append((new[0], len(KINDS), new[1], "phone", new[2]))
    found += [(a, len(KINDS) + 1, b, "card", new) for a, b, new in cards]
    out, spans, at = [], [], 0
    for start, _, end, kind, new in sorted(found):
        if start < at:
            continue
        out += [text[at:start], new]
        spans.append((kind, start, end))
        at = end
    return "".join(out) + text[at:], spans


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii, and spans (kind:start:end of the original text, by
    start, comma-joined). Overlapping finds: the leftmost, then the first kind of KINDS, phones and
    cards, stays; a phone that would reach into a card ends before it. Dates with slashes are read
    day first, and month first where that gives none. Not found, so left as they are: dates with names of months, account numbers (IBAN) in lower case,
    national numbers without separators, and in an address before @ whatever stands before a letter that isn't ASCII and that letter.
    A null text stays null, with n_pii 0 and spans ''."""
    if not key:
        raise ValueError("the key is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, text in in_slices(batch):
                done = [(None, []) if t is None else pseudonymize_text(t, key) for t in text]
                cols = [pa.array(ids, pa.int64()), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for _, s in done], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done], pa.string())]
                yield pa.record_batch(cols, names=["doc_id", "text", "n_pii", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, text string, n_pii long, spans string")
