"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn sum and issuer of card numbers, canonical octets of addresses, the calendar for dates,
number ranges of social security and telephone numbers, remainder 97 of bank account numbers) and, where valid, replaced
by its image under a keyed permutation of its own format: digits stay digits, letters keep their case, separators stay where they are,
and the image passes the same validation. Equal values have equal images in all documents, also where they are written with other
separators; different values of one format have different ones. Invalid candidates are left as they are, and only values that change are counted.

- Text values: what is permuted is taken out from between the separators and put back between them. A Feistel network over its two halves adds
  to each character, within its own alphabet, a keyed hash of the other half; a single character takes its place in a keyed order of its alphabet. Where
  the image must pass a check, the permutation is walked until it does.
- Card and bank account numbers: the payload is permuted and the check digits are computed anew; a card keeps the four digits that tell its issuer. A
  card number has 13 to 19 digits, with single blanks or hyphens between groups, and no digit adjoins it. Every stretch of whole groups of a run is
  tried, so that a number beside it (a date, a security code) hides none. Where valid stretches overlap, the usual layouts (unbroken, 4-4-4-4,
  4-6-5) come first, then the leftmost, then the shortest. Cards in a usual layout are taken out before all other patterns are sought in what is left.
- Dates of the years 0001 to 9999, all that the formats can write, are permuted as one of 3,652,059 days. A date with slashes is read day first
  where that gives a date, else month first, and those that can only be read month first are permuted among themselves; it is padded with
  zeros if both its day and month have two digits. Addresses are permuted as one of 2^32. Both by a Feistel network over a pair of residues, walked
  where their product is larger than the range.
- e-mail addresses keep their domain, on which the permutation depends; longer addresses (IPv6), keys and other secrets (hexadecimal strings of one
  case, access keys, password=...) are permuted like text, secrets with their punctuation and their letters beyond ASCII.

The key is the setting spark.roadspark.pseudonym.key, or a parameter; the plan holds a digest of it, so plans must be guarded like the key. Without
either a key for demonstration is used.

Null text stays null with no replacement; empty text stays empty. Repeated rows get the same result. Very long texts are treated as a whole, in
memory in proportion to their length. Of patterns that match at one place the first in order is tried (ties). Empty tables give no row; other
columns, whatever their names, are kept untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common

SETTING, DEMO_KEY = "spark.roadspark.pseudonym.key", "roadspark-demo-key"
ROUNDS = 8
#: Steps of a walk to a valid image. All validations pass a third of the values at least, so none is as long but one in 10^11; that one is an error.
WALK = 64
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "long_address": r"(?<![A-Za-z0-9:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![A-Za-z0-9:])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "password": r"(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api_key)=[^\s\"',;]{6,}",
    "hex": r"(?<![A-Za-z0-9])(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,128}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{16,128})(?![A-Za-z0-9])",
    "social": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "iso_date": r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])",
    "slash_date": r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])",
    "phone": r"(?<![0-9+])(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "foreign_phone": r"(?<![0-9+])\+[2-9](?:[ .\-]?\(?[0-9]\)?){7,14}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:(?:[ \-](?!STOP))?[0-9]){12,}+",
}
#: What a run of digits doesn't run into after a blank or hyphen.
PATTERNS["card"] = PATTERNS["card"].replace("STOP", "|".join(PATTERNS[k].split(")", 1)[1] for k in ("email", "address", "hex", "social", "iso_date", "slash_date", "phone")))
#: Punctuation within secrets: what may not end one.
PUNCTUATION = "!#$%&()*+-./:<=>?@[]^_`{|}~\\"
#: Groups of digits, at least 13 in all, that are no part of a longer word, mail address, secret or telephone number.
CLEAN = r"[0-9]++(?![.\-]?[A-Za-z@_%+]|\.[0-9])"
RUN = rf"(?<![A-Za-z0-9=@._%+])(?<![A-Za-z0-9=@._%+]-)(?=[0-9](?:[ \-]?[0-9]){{12}}){CLEAN}(?:[ \-]{CLEAN})*+"
LAYOUT = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
ISSUER = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}"
    r"|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|6(?:011|4[4-9][0-9]|5[0-9]{2}|2[0-9]{2})[0-9]{12,15}"
    r"|220[0-4][0-9]{12,15}|(?:50(?:18|20|38)|5893|6304|67(?:59|6[1-3]))[0-9]{9,15})$"
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of the years 0001-9999, and sizes of two residues whose product is slightly larger.
FIRST_DAY, DAYS, DAY_SIZES = "0001-01-01", 3_652_059, (1911, 1912)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute_number(value: Column, sizes: tuple[int, int], label: str, key: str) -> Column:
    """A permutation of 0 .. sizes[0] * sizes[1] - 1."""
    a, b = sizes

    def step(acc: Column, r: Column) -> Column:
        even = (r % 2) == 0
        return F.struct(
            F.when(even, (acc["l"] + _number(key, label, r, acc["r"])) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + _number(key, label, r, acc["l"])) % b).alias("r"),
        )

    begin = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda acc: acc["l"] * b + acc["r"])


def _shift(c: Column, by: Column, kind: str) -> Column:
    code = F.ascii(c)
    if kind == "hex":
        return F.lower(F.hex(((F.conv(c, 16, 10).cast("int") + by) % 16).cast("long")))
    out = F.when(c.rlike("^[0-9]$"), F.char(48 + (code - 48 + by) % 10))
    out = out.when(c.rlike("^[a-z]$"), F.char(97 + (code - 97 + by) % 26))
    out = out.when(c.rlike("^[A-Z]$"), F.char(65 + (code - 65 + by) % 26))
    if kind == "secret":
        at = F.instr(F.lit(PUNCTUATION), c)
        out = out.when(at > 0, F.substr(F.lit(PUNCTUATION), (at - 1 + by) % len(PUNCTUATION) + 1, F.lit(1)))
        # Letters of blocks of 64 that hold nothing but letters and marks move within their block.
        moved = code - code % 64 + (code + by) % 64
        out = out.when(c.rlike(BLOCKS), F.decode(F.unhex(F.lpad(F.hex(moved.cast("long")), 8, "0")), "UTF-32"))
    return out.otherwise(c)


def _lone(c: Column, label: Column, key: str) -> Column:
    """The image of a single character: its place in its alphabet, in a keyed order of it."""

    def of(alphabet: str) -> Column:
        order = F.array_sort(F.transform(F.split(F.lit(alphabet), "(?!^)"), lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(key), label, x).cast("binary"), 256).alias("h"), x.alias("x"))))
        return F.get(order, F.instr(F.lit(alphabet), c) - 1)["x"]

    return F.when(c.rlike("^[0-9]$"), of("0123456789")).when(c.rlike("^[a-z]$"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)


BLOCKS = r"^[\u00C0-\u017F\u0400-\u047F\u4E00-\u9FBF\uAC00-\uD77F]$"
#: For each kind of text, the characters that are permuted; all others stay where they are. Of secrets every character is.
CORE = {"text": "0-9A-Za-z", "hex": "0-9A-Fa-f", "digits": "0-9"}


def permute_core(value: Column, label: str | Column, key: str, kind: str = "text") -> Column:
    """A permutation of the strings that have value's pattern of characters, none of them a separator."""
    label = F.lit(label) if isinstance(label, str) else label

    def step(acc: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), label, r.cast("string"), acc["b"]).cast("binary"), 512)

        def one(i: Column) -> Column:
            by = F.conv(F.substr(digest, ((i - 1) * 2) % 128 + 1, F.lit(2)), 16, 10).cast("int")
            return _shift(F.substr(acc["a"], i, F.lit(1)), by, kind)

        return F.struct(acc["b"].alias("a"), F.array_join(F.transform(F.sequence(F.lit(1), F.length(acc["a"])), one), "").alias("b"))

    half = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))
    network = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda acc: F.concat(acc["a"], acc["b"]))
    return F.when(F.length(value) > 1, network).when(F.length(value) == 1, _lone(value, label, key)).otherwise(value)


def core_of(value: Column, kind: str) -> Column:
    return value if kind == "secret" else F.regexp_replace(value, f"[^{CORE[kind]}]", "")


def put_back(value: Column, core: Column, kind: str) -> Column:
    """value with the characters of core in the places of its own."""
    if kind == "secret":
        return core
    pieces = F.regexp_extract_all(value, F.lit(f"[{CORE[kind]}]+|[^{CORE[kind]}]+"), F.lit(0))

    def add(acc: Column, piece: Column) -> Column:
        own = piece.rlike(f"^[{CORE[kind]}]")
        return F.struct(F.concat(acc["out"], F.when(own, F.substr(acc["core"], acc["at"], F.length(piece))).otherwise(piece)).alias("out"), (acc["at"] + F.when(own, F.length(piece)).otherwise(0)).alias("at"), acc["core"].alias("core"))

    return F.aggregate(pieces, F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), core.alias("core")), add, lambda acc: acc["out"])


def permute_text(value: Column, label: str | Column, key: str, kind: str = "text") -> Column:
    """A permutation of the strings that have value's pattern of digits, letters and other characters; it depends on the former two alone."""
    if kind != "hex":
        return put_back(value, permute_core(core_of(value, kind), label, key, kind), kind)
    moved = permute_core(F.lower(core_of(value, kind)), label, key, kind)
    return put_back(value, F.when(value.rlike("[A-F]"), F.upper(moved)).otherwise(moved), kind)


def walked(value: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The permutation of the valid values: applied again until the image is valid."""
    image = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permute(value), lambda acc, _: F.when(valid(acc), acc).otherwise(permute(acc)))
    return _bound(image, lambda v: F.when(v.isNull() | valid(v), v).otherwise(F.raise_error(F.lit("a walk found no valid image"))))


def luhn_sum(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card_valid(digits: Column) -> Column:
    return digits.rlike(ISSUER) & (luhn_sum(digits) % 10 == 0)


def _card(value: Column, key: str) -> Column:
    def image(digits: Column) -> Column:
        body = F.concat(F.substr(digits, F.lit(1), F.lit(4)), permute_core(F.substr(digits, F.lit(5), F.length(digits) - 5), "card", key))
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    return put_back(value, _bound(_digits(value), image), "digits")


def _cut(run: Column, usual: bool) -> Column:
    """(pieces, cards) of a run of groups: its card numbers (those in a usual layout, or all), and the text before, between and after them."""

    def windows(tokens: Column) -> Column:
        n = F.floor((F.size(tokens) + 1) / 2).cast("int")

        def starting(i: Column) -> Column:
            at = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i + 1)), lambda k: F.struct((2 * i - 1).alias("i"), (2 * k - 1).alias("k"), F.array_join(F.slice(tokens, 2 * i - 1, 2 * k - 1), "").alias("v")))
            fits = F.filter(at, lambda w: F.length(_digits(w["v"])).between(13, 19))
            return F.filter(fits, lambda w: (w["v"].rlike(LAYOUT) if usual else F.lit(True)) & card_valid(_digits(w["v"])))

        found = F.flatten(F.transform(F.sequence(F.lit(1), n), starting))
        ranked = F.array_sort(F.transform(found, lambda w: F.struct((~w["v"].rlike(LAYOUT)).alias("odd"), w["i"].alias("i"), w["k"].alias("k"), w["v"].alias("v"))))
        kind = "array<struct<i:int,k:int,v:string>>"

        def accept(acc: Column, w: Column) -> Column:
            taken = F.exists(acc, lambda o: (o["i"] < w["i"] + w["k"]) & (w["i"] < o["i"] + o["k"]))
            return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(w["i"].alias("i"), w["k"].alias("k"), w["v"].alias("v"))).cast(kind)))

        return F.array_sort(F.aggregate(ranked, F.array().cast(kind), accept))

    def parts(tokens: Column, kept: Column) -> Column:
        def piece(j: Column) -> Column:
            begin = F.when(j == 0, 1).otherwise(F.get(kept, j - 1)["i"] + F.get(kept, j - 1)["k"])
            end = F.when(j == F.size(kept), F.size(tokens) + 1).otherwise(F.get(kept, j)["i"])
            return F.array_join(F.slice(tokens, begin, end - begin), "")

        return F.struct(F.transform(F.sequence(F.lit(0), F.size(kept)), piece).alias("pieces"), F.transform(kept, lambda w: w["v"]).alias("cards"))

    tokens = F.regexp_extract_all(run, F.lit(r"[0-9]+|[ \-]"), F.lit(0))
    return _bound(tokens, lambda t: _bound(windows(t), lambda kept: parts(t, kept)))


def _woven(pieces: Column, values: Column) -> Column:
    """The pieces, of which there is one more, with the values between them."""
    return F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def _cards_out(text: Column) -> Column:
    """(pieces, cards) of a text: its card numbers in a usual layout, and the text before, between and after them."""
    kind = "struct<pieces:array<string>,open:string,cards:array<string>>"

    def add(acc: Column, run: Column) -> Column:
        cut, after = run["cut"], run["after"]
        m = F.size(cut["cards"])
        more = F.concat(F.array(F.concat(acc["open"], cut["pieces"][0])), F.slice(cut["pieces"], F.lit(2), F.greatest(m - 1, F.lit(0))))
        grown = F.struct(F.concat(acc["pieces"], more).alias("pieces"), F.concat(F.element_at(cut["pieces"], -1), after).alias("open"), F.concat(acc["cards"], cut["cards"]).alias("cards"))
        return F.when(m == 0, F.struct(acc["pieces"].alias("pieces"), F.concat(acc["open"], cut["pieces"][0], after).alias("open"), acc["cards"].alias("cards")).cast(kind)).otherwise(grown.cast(kind))

    def over(between: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _cut(r, usual=True))
        joined = F.zip_with(runs, F.slice(between, F.lit(2), F.size(between)), lambda c, a: F.struct(c.alias("cut"), a.alias("after")))
        start = F.struct(F.array().cast("array<string>").alias("pieces"), between[0].alias("open"), F.array().cast("array<string>").alias("cards")).cast(kind)
        return F.aggregate(joined, start, add, lambda acc: F.struct(F.concat(acc["pieces"], F.array(acc["open"])).alias("pieces"), acc["cards"].alias("cards")))

    whole = F.struct(F.array(text).alias("pieces"), F.array().cast("array<string>").alias("cards"))
    return F.when(text.rlike(RUN), _bound(F.split(text, RUN, -1), over)).otherwise(whole)


def remainder_97(account: Column) -> Column:
    moved = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.substr(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)


def _account(value: Column, key: str) -> Column:
    country, body = F.substr(value, F.lit(1), F.lit(2)), permute_text(F.substr(value, F.lit(5), F.length(value)), "account", key)
    return F.concat(country, F.lpad((98 - remainder_97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)


def _day(value: Column, pattern: str) -> Column:
    """Days since FIRST_DAY; null where the value is no date of the years 0001 to 9999."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when((day >= 0) & (day < DAYS), day)


def _written(day: Column, pattern: str | Column) -> Column:
    return F.date_format(_date(day), pattern)


def _date(day: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))


def _iso_date(value: Column, key: str) -> Column:
    moved = walked(_day(value, "yyyy-MM-dd"), lambda d: permute_number(d, DAY_SIZES, "date", key), lambda d: d < DAYS)
    return _written(moved, "yyyy-MM-dd")


def _slash_date(value: Column, key: str) -> Column:
    padded = value.rlike("^[0-9]{2}/[0-9]{2}/")
    by_day, by_month = _day(value, "d/M/yyyy"), _day(value, "M/d/yyyy")
    step = lambda d: permute_number(d, DAY_SIZES, "date", key)
    first = walked(by_day, step, lambda d: d < DAYS)
    # Days beyond the twelfth can't be months, so these stay dates that are read month first.
    second = walked(by_month, step, lambda d: (d < DAYS) & (F.dayofmonth(_date(F.least(d, F.lit(DAYS - 1)))) > 12))
    return F.when(by_day.isNotNull(), F.when(padded, _written(first, "dd/MM/yyyy")).otherwise(_written(first, "d/M/yyyy"))).when(
        by_month.isNotNull(), F.when(padded, _written(second, "MM/dd/yyyy")).otherwise(_written(second, "M/d/yyyy"))
    )


def _address(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
    octet = lambda n, shift: (F.shiftright(n, shift) % 256).cast("string")
    moved = _bound(permute_number(number, (65536, 65536), "address", key), lambda n: F.concat_ws(".", octet(n, 24), octet(n, 16), octet(n, 8), octet(n, 0)))
    return F.when(F.forall(parts, lambda p: p.rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")), moved)


def _social_valid(v: Column) -> Column:
    return v.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _phone_valid(v: Column) -> Column:
    return v.rlike("^[2-9][0-9]{2}[2-9]")


def _phone(value: Column, key: str) -> Column:
    """The ten digits of a number; those out of the usual ranges, taken only with country code or brackets, are permuted among themselves."""
    step = lambda v: permute_core(v, "phone", key)

    def image(ten: Column) -> Column:
        usual, other = walked(ten, step, _phone_valid), walked(ten, step, lambda v: ~_phone_valid(v))
        return F.when(_phone_valid(ten), usual).when(value.rlike("^\\+|\\("), other)

    code = F.length(F.regexp_extract(value, r"^(?:\+1[ .\-]?)?", 0))
    rest = F.substr(value, code + 1, F.length(value))
    return F.concat(F.substr(value, F.lit(1), code), put_back(rest, _bound(_digits(rest), image), "digits"))


def _foreign(value: Column, key: str) -> Column:
    """Three digits stay, as a country code has three at most."""
    digits = _digits(value)
    moved = F.concat(F.substr(digits, F.lit(1), F.lit(3)), permute_core(F.substr(digits, F.lit(4), F.length(digits)), "foreign", key))
    return F.when(F.length(digits).between(8, 15), put_back(value, moved, "digits"))


def pseudonym(value: Column, key: str) -> Column:
    """The image of one candidate; null where it fails validation."""
    like = {k: value.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    at, equals = F.instr(value, "@"), F.instr(value, "=")
    social = walked(_digits(value), lambda v: permute_core(v, "social", key), _social_valid)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Fa-f]")
    domain = F.substr(value, at, F.length(value))
    return (
        F.when(like["email"], F.concat(permute_text(F.substr(value, F.lit(1), at - 1), F.concat(F.lit("email"), F.lower(domain)), key), domain))
        .when(like["address"], _address(value, key))
        .when(like["long_address"], walked(value, lambda v: permute_text(v, "long address", key, "hex"), lambda v: v.rlike("[0-9]")))
        .when(like["access_key"], F.concat(F.substr(value, F.lit(1), F.lit(4)), permute_text(F.substr(value, F.lit(5), F.lit(16)), "key", key)))
        .when(like["account"], F.when(remainder_97(value) == 1, _account(value, key)))
        .when(like["password"], F.concat(F.substr(value, F.lit(1), equals), permute_text(F.substr(value, equals + 1, F.length(value)), "password", key, "secret")))
        .when(like["hex"], walked(value, lambda v: permute_text(v, "hex", key, "hex"), mixed))
        .when(like["social"], F.when(_social_valid(_digits(value)), put_back(value, social, "digits")))
        .when(like["iso_date"], _iso_date(value, key))
        .when(like["slash_date"], _slash_date(value, key))
        .when(like["phone"], _phone(value, key))
        .when(like["foreign_phone"], _foreign(value, key))
    )


def _images(value: Column, key: str) -> Column:
    """(text, n): a candidate with pseudonyms, and how many; null where there is none."""
    run = _bound(_cut(value, usual=False), lambda c: F.struct(_woven(c["pieces"], F.transform(c["cards"], lambda v: _card(v, key))).alias("text"), F.size(c["cards"]).alias("n")))
    one = _bound(pseudonym(value, key), lambda v: F.struct(F.when(v != value, v).alias("text"), F.lit(1).alias("n")))
    return _bound(F.when(value.rlike(f"^(?:{PATTERNS['card']})$"), run).otherwise(one), lambda p: F.when(p["text"].isNotNull() & (p["n"] > 0), p))


def _replaced(text: Column, key: str) -> Column:
    """(text, n): a text with pseudonyms, and how many."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def over(found: Column) -> Column:
        images = F.transform(found, lambda v: F.struct(v.alias("v"), _images(v, key).alias("p")))
        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).alias("n"))).otherwise(
            _bound(images, lambda im: F.struct(_woven(F.split(text, ANY, -1), F.transform(im, lambda x: F.coalesce(x["p"]["text"], x["v"]))).alias("text"), F.aggregate(im, F.lit(0), lambda acc, x: acc + F.coalesce(x["p"]["n"], F.lit(0))).alias("n")))
        )

    return _bound(found, over)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(row, text, n_replaced): every row of docs as a struct, its text with pseudonyms, and how many were put in."""
    key = derived(key or docs.sparkSession.conf.get(SETTING, DEMO_KEY))
    rows = common.packed_rows(docs).withColumn("text", F.col("row")[text])

    def over(c: Column) -> Column:
        done = F.transform(c["pieces"], lambda p: _replaced(p, key))
        cards = F.transform(c["cards"], lambda v: _card(v, key))
        return _bound(done, lambda d: F.struct(_woven(F.transform(d, lambda p: p["text"]), cards).alias("text"), F.aggregate(d, F.size(c["cards"]), lambda acc, p: acc + p["n"]).alias("n")))

    rows = rows.withColumn("done", F.when(F.col("text").rlike("[0-9@=]"), _bound(_cards_out(F.col("text")), over)))
    return rows.select("row", F.coalesce("done.text", "text").alias("text"), F.coalesce("done.n", F.lit(0)).cast("long").alias("n_replaced"))


def derived(key: str) -> str:
    """What stands in plans for a key."""
    return hashlib.sha256(f"roadspark pseudonyms {key}".encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "n_replaced")
