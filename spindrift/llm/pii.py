"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of what is replaced (fixed values). None can match empty text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
#: A separator within a phone number; a date after a blank is none of its groups.
_GAP = r"(?:(?! (?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})(?![0-9]))(?:[ .-]?\(|\)[ .-]?|[ .-]))?"
#: International: + and 8 to 16 digits in groups of any length, ten digits after +1. National: 3-3-4.
PHONE = rf"(?<![0-9+])(?:\+1(?:{_GAP}[0-9]){{10}}(?![0-9])|\+[0-9](?:{_GAP}[0-9]){{7,15}}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}})(?![0-9])"
#: Country codes but 1, which has national numbers' way: of one, two or three digits.
_COUNTRY = "^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "date": DATE, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "account": ACCOUNT, "secret": SECRET, "card": CARD}
ANY = "|".join(KINDS.values())
ROUNDS = 8

#: Dates are permuted within runs of so many years, of this range, which is a whole number of runs.
_RUN, _YEARS = 32, (1600, 2399)
#: Days of each month after the 12th; 29 February is on its own.
_LATE = (19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19)


def _prf(key: str, tweak: Column | str, *parts: Column) -> Column:
    """A keyed 48-bit number."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    text = F.concat_ws("|", F.lit(key), tweak, *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(12)), 16, 10).cast("long")


def _shift_char(c: Column, by: Column) -> Column:
    """The letter or digit so many places on, among digits, small or capital letters; other characters stay."""
    code = F.ascii(c)
    move = lambda first, n: F.char((F.lit(first) + (code - first + by) % n).cast("long"))
    return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).otherwise(c)


def _shift(half: Column, other: Column, turn: Column, key: str, tweak: str) -> Column:
    moved = F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: _shift_char(F.substr(half, i, F.lit(1)), _prf(key, tweak, turn, i, other)))
    return F.when(half == "", half).otherwise(F.array_join(moved, ""))


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings with the same places of digits, small and capital letters."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def turn(s, i):
        left = F.when(i % 2 == 1, _shift(s["l"], s["r"], i, key, tweak)).otherwise(s["l"])
        right = F.when(i % 2 == 0, _shift(s["r"], s["l"], i, key, tweak)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permute_pair(a: Column, a_size: int | Column, b: Column, b_size: int | Column, key: str, tweak: Column | str) -> Column:
    """A permutation of 0 <= a < a_size, 0 <= b < b_size, as struct<a, b>."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s, i):
        a = F.when(i % 2 == 0, (s["a"] + _prf(key, tweak, i, s["b"])) % a_size).otherwise(s["a"])
        b = F.when(i % 2 == 1, (s["b"] + _prf(key, tweak, i, s["a"])) % b_size).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _refill(pattern: Column, letters: Column) -> Column:
    """``pattern`` with its letters and digits replaced, in order, by ``letters``."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(pattern, F.lit(1), i), "[^A-Za-z0-9]", ""))
    fill = lambda i: F.when(F.substr(pattern, i, F.lit(1)).rlike("[A-Za-z0-9]"), F.substr(letters, seen(i), F.lit(1))).otherwise(F.substr(pattern, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), fill), "")


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Za-z0-9]", "")


def _email(m: Column, key: str) -> Column:
    """Name and domain are permuted each on its own, in small letters; the top-level domain stays."""
    low = F.lower(m)
    name, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.substring_index(domain, ".", -1)
    return F.concat(permute_text(name, key, "name"), F.lit("@"), permute_text(F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1), key, "domain"), F.lit("."), top)


def _address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    moved = permute_pair(parts[0] * 256 + parts[1], 65536, parts[2] * 256 + parts[3], 65536, key, "address")
    out = F.concat_ws(".", *[x.cast("string") for x in (F.floor(moved["a"] / 256), moved["a"] % 256, F.floor(moved["b"] / 256), moved["b"] % 256)])
    return F.when(F.exists(parts, lambda p: p > 255), m).otherwise(out)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    at = lambda i: F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(at(i))).otherwise(at(i)))


def _card(m: Column, key: str) -> Column:
    """All digits but the first are permuted, and the check digit made new; without a right one it is no card."""
    digits = _bare(m)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    made = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when((luhn(digits) % 10 != 0) | ~F.substr(digits, F.lit(1), F.lit(1)).isin(*"23456"), m).otherwise(_refill(m, made[0]))


def _phone(m: Column, key: str) -> Column:
    """The last digits of the national number are permuted; country code and the first digits of area and exchange stay.

    Of the exchange this holds for +1 and national numbers, whose shape is known.
    """
    digits = _bare(m)
    n = F.length(digits)
    code = F.length(F.regexp_extract(digits, _COUNTRY, 0)) + 1
    abroad = F.concat(F.substr(digits, F.lit(1), code), permute_text(F.substr(digits, code + 1), key, "phone"))
    last = F.when(n >= 10, F.lit(10)).otherwise(F.greatest(n - 3, F.lit(4)))
    head, tail = F.substr(digits, F.lit(1), n - last), F.substr(digits, n - last + 1)
    ten = F.concat(F.substr(tail, F.lit(2), F.lit(2)), F.substr(tail, F.lit(5)))
    moved = F.transform(F.array(permute_text(ten, key, "phone")), lambda p: F.concat(head, F.substr(tail, F.lit(1), F.lit(1)), F.substr(p, F.lit(1), F.lit(2)), F.substr(tail, F.lit(4), F.lit(1)), F.substr(p, F.lit(3))))[0]
    home = F.when(last == 10, moved).otherwise(F.concat(head, permute_text(tail, key, "phone")))
    return F.when(n < 8, m).otherwise(_refill(m, F.when(m.rlike(r"^\+[02-9]"), abroad).otherwise(home)))


def _social(m: Column, key: str) -> Column:
    """A permutation of the numbers that can be issued: area 001-899 but 666, group 01-99, serial 0001-9999."""
    digits = _bare(m)
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    moved = permute_pair(area - F.when(area > 666, 2).otherwise(1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "social")
    show = lambda s: F.concat(F.lpad((s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, _refill(m, F.transform(F.array(moved), show)[0])).otherwise(m)


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _account(m: Column, key: str) -> Column:
    """A bank account number whose two check digits are right: the rest but the country is permuted, the check made new."""
    bare = _bare(m)
    country, rest = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))
    made = F.transform(F.array(permute_text(rest, key, "account")), lambda r: F.concat(country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
    right = (_mod97(F.concat(rest, F.substr(bare, F.lit(1), F.lit(4)))) == 1) & F.length(bare).between(15, 34)
    return F.when(right, _refill(m, made[0])).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """A permutation of the days of 32 years that keeps how a day is written, in every form; what is no date stays.

    Days 1-9, 10-12 and later ones of the months 1-9 and 10-12 are each
    permuted among themselves, so a day has one pseudonym in all forms, with as
    many digits, and day-first and month-first dates are read as they were; 29
    February moves among leap years.
    """
    texts = F.split(m, "[-/.]")
    iso = m.rlike("^[0-9]{4}-")
    month_first = iso | (m.contains("/") & (texts[0].cast("int") <= 12))
    year_text = F.when(iso, texts[0]).otherwise(texts[2])
    month_text = F.when(iso, texts[1]).when(month_first, texts[0]).otherwise(texts[1])
    day_text = F.when(iso, texts[2]).when(month_first, texts[1]).otherwise(texts[0])
    year, month, day = (t.cast("int") for t in (year_text, month_text, day_text))
    right = F.concat_ws("-", year_text, F.lpad(month_text, 2, "0"), F.lpad(day_text, 2, "0")).try_cast("date").isNotNull() & year.between(*_YEARS)

    high, early, middle = month > 9, day < 10, day < 13
    within, months = month - F.when(high, 10).otherwise(1), F.when(high, 3).otherwise(9)
    starts = [[sum(_LATE[a:k]) for k in range(a, b)] for a, b in ((0, 9), (9, 12))]
    late = F.when(high, F.array(*map(F.lit, starts[1]))).otherwise(F.array(*map(F.lit, starts[0])))
    place = F.when(early, within * 9 + day - 1).when(middle, within * 3 + day - 10).otherwise(F.try_element_at(late, within + 1) + day - 13)
    size = F.when(early, months * 9).when(middle, months * 3).when(high, sum(_LATE[9:])).otherwise(sum(_LATE[:9]))
    run = F.floor((year - _YEARS[0]) / _RUN)
    tweak = F.concat_ws("|", F.lit("date"), run.cast("string"), F.when(early, "1").when(middle, "10").otherwise("13"), high.cast("string"))
    moved = permute_pair((year - _YEARS[0]) % _RUN, _RUN, place, size, key, tweak)
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    first = (run * _RUN + _YEARS[0]).cast("int")
    leaps = F.filter(F.sequence(first, first + _RUN - 1), leap)
    leap_year = F.try_element_at(leaps, ((F.array_position(leaps, year) - 1 + _prf(key, "leap", run)) % F.size(leaps) + 1).cast("int"))

    def show(s):
        month_of = F.when(early, F.floor(s["b"] / 9)).when(middle, F.floor(s["b"] / 3)).otherwise(F.size(F.filter(late, lambda x: x <= s["b"])) - 1)
        day_of = F.when(early, s["b"] % 9 + 1).when(middle, s["b"] % 3 + 10).otherwise(s["b"] - F.try_element_at(late, (month_of + 1).cast("int")) + 13)
        y = F.lpad((run * _RUN + _YEARS[0] + s["a"]).cast("string"), 4, "0")
        mm = F.lpad((month_of + F.when(high, 10).otherwise(1)).cast("string"), F.length(month_text), F.lit("0"))
        dd = F.lpad(day_of.cast("string"), F.length(day_text), F.lit("0"))
        return _dated(m, iso, month_first, y, mm, dd)

    plain = F.transform(F.array(moved), show)[0]
    extra = _dated(m, iso, month_first, F.lpad(leap_year.cast("string"), 4, "0"), month_text, day_text)
    return F.when(right, F.when((month == 2) & (day == 29), extra).otherwise(plain)).otherwise(m)


def _dated(m: Column, iso: Column, month_first: Column, year: Column, month: Column, day: Column) -> Column:
    """A date in the form of ``m``."""
    mark = F.when(m.contains("/"), "/").otherwise(".")
    return F.when(iso, F.concat_ws("-", year, month, day)).when(month_first, F.concat_ws("/", month, day, year)).otherwise(F.concat(day, mark, month, mark, year))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a match of ``ANY``; the match itself if it is not valid in its kind."""
    make = {"email": _email, "date": _date, "address": _address, "social": _social, "phone": _phone, "account": _account, "card": _card, "secret": lambda m, k: F.concat(F.lit("AKIA"), permute_text(F.substr(m, F.lit(5)), k, "secret"))}
    out = F
    for name, pattern in KINDS.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), make[name](m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_replaced``, how many values.

    E-mail addresses, dates, IPv4 addresses, phone numbers (with + and country
    code, or 3-3-4 digits), US social security
    numbers, bank accounts (mod 97), payment cards (Luhn) and access key ids
    are replaced by a keyed permutation within their format, so equal values
    have equal pseudonyms in every document, however they are punctuated, and
    different values different ones. Numbers that fail their check stay as they
    are, and so do dates before 1600 or after 2399. Null text stays null with
    n_replaced 0, a column of that name is replaced, and columns that begin
    with ``__`` may not be there. Texts are handled whole, whatever their
    length; repeated rows come back as often; an empty table gives no rows. The key is part of the query plan: give executors' logs the
    protection that the key needs.
    """
    whole = F.col(text)
    found = F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))
    between = F.split(whole, ANY, -1)
    has = whole.rlike("[0-9]|@|AKIA")
    rows = docs.drop("n_replaced").withColumn("__found", F.when(has, found))
    some = F.size("__found") > 0
    new = F.transform("__found", lambda m: pseudonym(m, key))
    rows = rows.withColumn("__new", F.when(some, new))
    pieces = F.flatten(F.zip_with(between, "__new", lambda t, p: F.array(t, F.coalesce(p, F.lit("")))))
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    rows = rows.withColumn(text, F.when(some, F.array_join(pieces, "")).otherwise(whole)).withColumn("n_replaced", F.when(some, changed).otherwise(0))
    return rows.select(*[c for c in docs.columns if c != "n_replaced"], "n_replaced")
