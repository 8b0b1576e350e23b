"""The pseudonyms of roadspark.llm.privacy in plain Python, one text at a time: the same patterns, rules and keyed hashes, none of its code."""

import datetime
import hashlib
import re

from roadspark.llm import privacy

PATTERNS = {k: re.compile(p, re.ASCII) for k, p in privacy.PATTERNS.items()}
ANY = re.compile("|".join(f"(?:{p})" for p in privacy.PATTERNS.values()), re.ASCII)
RUN, LAYOUT, ISSUER = (re.compile(p, re.ASCII) for p in (privacy.RUN, privacy.LAYOUT, privacy.ISSUER))
PUNCTUATION = privacy.PUNCTUATION
DAYS = 3_652_059


def digits(text):
    return re.sub("[^0-9]", "", text)


def residue(value, a, b, label, key):
    left, right = divmod(value, b)
    for i in range(1, 9):
        number = lambda half: int(hashlib.sha256(f"{key}|{label}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2:
            right = (right + number(left)) % b
        else:
            left = (left + number(right)) % a
    return left * b + right


def moved(c, by, kind):
    if kind == "hex":
        return "0123456789abcdef"[(int(c, 16) + by) % 16]
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        if 0 <= ord(c) - ord(first) < size:
            return chr(ord(first) + (ord(c) - ord(first) + by) % size)
    if kind == "secret" and c in PUNCTUATION:
        return PUNCTUATION[(PUNCTUATION.index(c) + by) % len(PUNCTUATION)]
    blocks = ((0xC0, 0x17F), (0x400, 0x47F), (0x4E00, 0x9FBF), (0xAC00, 0xD77F))
    if kind == "secret" and any(b <= ord(c) <= e for b, e in blocks):
        return chr(ord(c) // 64 * 64 + (ord(c) + by) % 64)
    return c


def core(value, label, key, kind="text"):
    if len(value) == 1:
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if value in alphabet:
                order = sorted(alphabet, key=lambda x: hashlib.sha256(f"{key}|{label}|{x}".encode()).hexdigest())
                return order[alphabet.index(value)]
    if len(value) < 2:
        return value
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, 9):
        digest = hashlib.sha512(f"{key}|{label}|{i}|{b}".encode()).digest()
        a, b = b, "".join(moved(c, digest[j % 64], kind) for j, c in enumerate(a))
    return a + b


def woven(value, inner, own):
    rest = iter(inner)
    return "".join(next(rest) if re.match(own, c) else c for c in value)


def text(value, label, key, kind="text"):
    if kind == "secret":
        return core(value, label, key, kind)
    own = "[0-9A-Fa-f]" if kind == "hex" else "[0-9A-Za-z]"
    inner = "".join(re.findall(own, value))
    out = core(inner.lower() if kind == "hex" else inner, label, key, kind)
    return woven(value, out.upper() if kind == "hex" and re.search("[A-F]", value) else out, own)


def walk(value, step, valid):
    value = step(value)
    while not valid(value):
        value = step(value)
    return value


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10


def card(value, key):
    d = digits(value)
    body = d[:4] + core(d[4:-1], "card", key)
    return woven(value, body + str(-luhn(body + "0") % 10), "[0-9]")


def cards_of(run, usual):
    """(pieces, cards)"""
    tokens = re.findall(r"[0-9]+|[ \-]", run)
    found = []
    for i in range(0, len(tokens), 2):
        for j in range(i + 1, min(len(tokens), i + 37) + 1, 2):
            v = "".join(tokens[i:j])
            d = digits(v)
            if 13 <= len(d) <= 19 and ISSUER.search(d) and luhn(d) == 0 and (not usual or LAYOUT.search(v)):
                found.append((not LAYOUT.search(v), i, j, v))
    taken = []
    for _, i, j, v in sorted(found):
        if all(j <= a or b <= i for a, b, _ in taken):
            taken.append((i, j, v))
    pieces, at = [], 0
    for i, j, _ in sorted(taken):
        pieces.append("".join(tokens[at:i]))
        at = j
    return [*pieces, "".join(tokens[at:])], [v for _, _, v in sorted(taken)]


def calendar(day, month, year):
    try:
        return datetime.date(int(year), int(month), int(day)).toordinal() - 1
    except ValueError:
        return None


def number_of_account(value):
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def image(value, key):
    kind = next(k for k, p in PATTERNS.items() if p.fullmatch(value))
    day = lambda d: residue(d, 1911, 1912, "date", key)
    date = lambda d: datetime.date.fromordinal(d + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        return text(local, f"email@{domain.lower()}", key) + "@" + domain
    if kind == "address":
        parts = value.split(".")
        if any(not re.fullmatch("0|[1-9][0-9]*", p) or int(p) > 255 for p in parts):
            return None
        n = residue(int.from_bytes(bytes(map(int, parts)), "big"), 65536, 65536, "address", key)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "long_address":
        return walk(value, lambda v: text(v, "long address", key, "hex"), lambda v: re.search("[0-9]", v))
    if kind == "access_key":
        return value[:4] + text(value[4:], "key", key)
    if kind == "account":
        if number_of_account(value) != 1:
            return None
        body = text(value[4:], "account", key)
        return f"{value[:2]}{98 - number_of_account(value[:2] + '00' + body):02d}{body}"
    if kind == "password":
        name, _, secret = value.partition("=")
        return name + "=" + text(secret, "password", key, "secret")
    if kind == "hex":
        return walk(value, lambda v: text(v, "hex", key, "hex"), lambda v: re.search("[0-9]", v) and re.search("[A-Fa-f]", v))
    if kind == "social":
        valid = lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"
        return woven(value, walk(digits(value), lambda v: core(v, "social", key), valid), "[0-9]") if valid(digits(value)) else None
    if kind == "iso_date":
        own = calendar(value[8:], value[5:7], value[:4])
        return None if own is None else date(walk(own, day, lambda d: d < DAYS)).isoformat()
    if kind == "slash_date":
        a, b, year = value.split("/")
        pad = 2 if len(a) == len(b) == 2 else 1
        if (own := calendar(a, b, year)) is not None:
            d = date(walk(own, day, lambda d: d < DAYS))
            return f"{d.day:0{pad}d}/{d.month:0{pad}d}/{d.year:04d}"
        if (own := calendar(b, a, year)) is None:
            return None
        d = date(walk(own, day, lambda d: d < DAYS and date(d).day > 12))
        return f"{d.month:0{pad}d}/{d.day:0{pad}d}/{d.year:04d}"
    if kind == "phone":
        code = re.match(r"(?:\+1[ .\-]?)?", value)[0]
        ten, usual = digits(value[len(code) :]), lambda v: bool(re.match("[2-9][0-9]{2}[2-9]", v))
        if not usual(ten) and value[0] not in "+(":
            return None
        return code + woven(value[len(code) :], walk(ten, lambda v: core(v, "phone", key), lambda v: usual(v) == usual(ten)), "[0-9]")
    if kind == "foreign_phone":
        d = digits(value)
        return woven(value, d[:3] + core(d[3:], "foreign", key), "[0-9]") if 8 <= len(d) <= 15 else None
    pieces, cards = cards_of(value, usual=False)
    return "".join(p + c for p, c in zip(pieces, [*(card(c, key) for c in cards), ""], strict=True)), len(cards)


def replaced(piece, key):
    out, at, n = [], 0, 0
    for m in ANY.finditer(piece):
        out.append(piece[at : m.start()])
        at, new = m.end(), image(m[0], key)
        new, more = new if isinstance(new, tuple) else (new, int(new is not None and new != m[0]))
        n += more
        out.append(new if more else m[0])
    return "".join([*out, piece[at:]]), n


def pseudonymise(whole, key):
    """(text, n_replaced)"""
    if whole is None:
        return None, 0
    out, rest, at, n = [], "", 0, 0
    for m in RUN.finditer(whole):
        rest += whole[at : m.start()]
        at = m.end()
        pieces, cards = cards_of(m[0], usual=True)
        rest += pieces[0]
        for piece, c in zip(pieces[1:], cards, strict=True):
            new, more = replaced(rest, key)
            out += [new, card(c, key)]
            n += more + 1
            rest = piece
    new, more = replaced(rest + whole[at:], key)
    return "".join([*out, new]), n + more
