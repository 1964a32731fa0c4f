"""Format-preserving pseudonyms of personal data by keyed Feistel permutations, in DataFrame functions only.

Found and validated: e-mail addresses, IBANs (mod 97), card numbers (Luhn), social security numbers, IPv4 addresses,
telephone numbers (national North American layout, or + and 8 to 15 digits) and calendar dates of 1900 to 2099.
A value is cut in two halves; in each round one half is moved within its range by a keyed hash of the other, so each kind
is permuted within its own valid values: equal values get equal pseudonyms in all documents, different ones different
ones. Check digits are computed anew; separators, length, letter case, domains and country codes stay. What does not
validate stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import spare

ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Lengths of the IBANs of each country: without them the pattern would take in a capital word or number that follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    """IBANs of one length, unbroken or in groups of four."""
    groups, rest = divmod(length - 4, 4)
    spaced = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})(?![A-Za-z0-9])"


# Codes of no known length are taken as far as groups go.
IBAN = r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
SLASH_DATE = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
DOT_DATE = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
NANP = r"(?<![0-9A-Za-z+(-])(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
E164 = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<s>[ -])[0-9]{4}\k<s>[0-9]{4}\k<s>[0-9]{4}|[0-9]{4}(?<t>[ -])[0-9]{6}\k<t>[0-9]{5})(?![0-9A-Za-z])"
ANY = f"(?=[0-9(+])(?:{'|'.join((ISO_DATE, SLASH_DATE, DOT_DATE, SSN, IPV4, CARD, NANP, E164))})|{EMAIL}|{IBAN}"


def _draw(key: str, tweak: str | Column, *parts: Column) -> Column:
    """52 keyed bits, the pseudorandom function of the rounds."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(left: Column, n_left: Column, right: Column, n_right: Column, key: str, tweak: str) -> Column:
    """Permutes pairs of longs below (n_left, n_right); a struct (l, r)."""

    def turn(s, i):
        return F.when(i % 2 == 1, F.struct(F.pmod(s.l + _draw(key, tweak, i, s.r), n_left).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), F.pmod(s.r + _draw(key, tweak, i, s.l), n_right).alias("r"))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permutes digit strings of equal length, 2 to 30 digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    f = feistel(F.substr(digits, F.lit(1), half), _power(half), F.substr(digits, half + 1), _power(n - half), key, tweak)
    return F.transform(F.array(f), lambda s: F.concat(_pad(s.l, half), _pad(s.r, n - half)))[0]


def permute_characters(text: Column, key: str, tweak: str | Column) -> Column:
    """Permutes strings of equal layout: digits, small and capital ASCII letters move within their class."""

    def moved(half: Column, other: Column, i: Column) -> Column:
        def one(c, j):
            x = _draw(key, tweak, i, j, other)
            within = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + F.pmod(x, F.lit(n)), F.lit(n)))
            return F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def turn(s, i):
        return F.when(i % 2 == 1, F.struct(moved(s.l, s.r, i).alias("l"), s.r.alias("r"))).otherwise(F.struct(s.l.alias("l"), moved(s.r, s.l, i).alias("r")))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    f = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(f), lambda s: F.concat(s.l, s.r))[0]


def refill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced by those given, in order."""

    def turn(s, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s.out, F.when(is_digit, F.substr(digits, s.at, F.lit(1))).otherwise(c)).alias("out"), (s.at + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(layout, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), turn)["out"]


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload and digit pass Luhn's test."""

    def add(total, i):
        v = F.substr(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _but_last(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - 1)


def luhn_valid(digits: Column) -> Column:
    return luhn_digit(_but_last(digits)) == F.substr(digits, F.length(digits))


def mod_97(text: Column) -> Column:
    """Remainder of digits and capital letters (10 to 35) read as one number."""

    def add(rest, c):
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    kept = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    new = F.transform(F.array(kept), lambda p: refill(m, F.concat(p, luhn_digit(p))))[0]
    return F.when(luhn_valid(d) & d.rlike("[1-9]"), new).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    valid = (F.length(plain) >= 15) & (F.length(plain) <= 34) & (mod_97(F.concat(body, F.substring(plain, 1, 4))) == 1)

    def new(b):
        made = F.concat(country, _pad(98 - mod_97(F.concat(b, country, F.lit("00"))), 2), b)
        spaced = F.regexp_replace(made, "(.{4})(?!$)", "$1 ")
        return F.when(plain == m, made).otherwise(spaced)

    grouped = (plain == m) | (m == F.regexp_replace(plain, "(.{4})(?!$)", "$1 "))
    return F.when(valid & grouped, F.transform(F.array(permute_characters(body, key, F.concat(F.lit("iban|"), country))), new)[0]).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    f = feistel(area - 1 - (area > 666).cast("long"), F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999), key, "ssn")

    def new(s):
        first = s.l + 1 + (s.l >= 665).cast("long")
        return F.concat_ws("-", _pad(first, 3), _pad(F.floor(s.r / 9999) + 1, 2), _pad(s.r % 9999 + 1, 4))

    return F.when(valid, F.transform(F.array(f), new)[0]).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(part, lambda x: x < 256)
    f = feistel(part[0] * 256 + part[1], F.lit(65536), part[2] * 256 + part[3], F.lit(65536), key, "ipv4")
    new = F.transform(F.array(f), lambda s: F.concat_ws(".", F.floor(s.l / 256), s.l % 256, F.floor(s.r / 256), s.r % 256))[0]
    return F.when(valid, new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    area, line = F.substr(d, n - 9, F.lit(3)).cast("long"), F.substr(d, n - 6).cast("long")
    # Codes of 200 and more stay so, and lower ones stay low.
    low_a, size_a = F.when(area < 200, 0).otherwise(200), F.when(area < 200, 200).otherwise(800)
    low_l, size_l = F.when(line < 2_000_000, 0).otherwise(2_000_000), F.when(line < 2_000_000, 2_000_000).otherwise(8_000_000)
    f = feistel(area - low_a, size_a, line - low_l, size_l, key, "phone")
    national = F.transform(F.array(f), lambda s: refill(m, F.concat(F.substr(d, F.lit(1), n - 10), _pad(s.l + low_a, 3), _pad(s.r + low_l, 7))))[0]
    abroad = refill(m, F.concat(F.substring(d, 1, 2), permute_digits(F.substr(d, F.lit(3)), key, "phone+")))
    return F.when(m.rlike(f"^(?:{NANP})$"), national).when((n >= 8) & (n <= 15), abroad).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")
    p = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    year = F.when(iso, p[0]).otherwise(p[2])
    # With slashes the month comes first unless it can't; such dates stay among themselves.
    day_first = ~iso & (~slash | (p[0] > 12))
    month = F.when(iso, p[1]).when(day_first, p[1]).otherwise(p[0])
    day = F.when(iso, p[2]).when(day_first, p[0]).otherwise(p[1])
    date = F.try_to_date(F.concat_ws("-", _pad(year, 4), _pad(month, 2), _pad(day, 2)), "yyyy-MM-dd")
    made = lambda s: F.date_add(F.make_date((s.l + 1900).cast("int"), F.lit(1), F.lit(1)), s.r.cast("int"))

    def outside(s):
        return (F.year(made(s)) != s.l + 1900) | (slash & day_first & (F.day(made(s)) <= 12))

    # Days 1 to 366 of 200 years hold a few that don't exist: the permutation is applied again until it leaves them.
    start = F.struct((F.year(date) - 1900).cast("long").alias("l"), (F.dayofyear(date) - 1).cast("long").alias("r"))
    f = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, lambda s, i: F.when((i == 1) | outside(s), feistel(s.l, F.lit(200), s.r, F.lit(366), key, "date")).otherwise(s))

    def new(s):
        t, wide = made(s), m.rlike("^[0-9]{2}.[0-9]{2}.")
        show = lambda n: F.when(wide, _pad(n, 2)).otherwise(n.cast("string"))
        mark, d, mo, y = F.when(slash, "/").otherwise("."), show(F.day(t)), show(F.month(t)), F.year(t).cast("string")
        return F.when(iso, F.date_format(t, "yyyy-MM-dd")).otherwise(F.concat(F.when(day_first, d).otherwise(mo), mark, F.when(day_first, mo).otherwise(d), mark, y))

    return F.when(date.isNotNull() & year.between(1900, 2099), F.transform(F.array(f), new)[0]).otherwise(m)


def _email(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    return F.concat(permute_characters(F.substring_index(m, "@", 1), key, F.concat(F.lit("email|"), F.lower(domain))), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found string."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .when(whole(f"{ISO_DATE}|{SLASH_DATE}|{DOT_DATE}"), _date(m, key))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(IPV4), _ipv4(m, key))
        .when(whole(CARD), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with its text column pseudonymised; ``count_col`` names a new column with the number of changed values.

    All rows and other columns stay. A null text stays null (count 0) and an empty one empty. Rows are treated each on
    its own, so there is nothing to shuffle; texts without a digit or an @ are passed through.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col).cast("string")
    # Three arrays of one row: the parts between findings, the findings, their pseudonyms.
    work = spare(docs, "pii_work")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    some = text.rlike("[0-9@]")
    d = docs.withColumn(work, F.when(some, F.struct(F.split(text, ANY, -1).alias("between"), found.alias("found"), F.transform(found, lambda m: pseudonym(m, key)).alias("new"))))
    w = F.col(work)
    joined = F.array_join(F.zip_with(w["between"], w["new"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    d = d.withColumn(text_col, F.when(w.isNotNull(), joined).otherwise(text))
    if count_col:
        changed = F.size(F.filter(F.zip_with(w["found"], w["new"], lambda a, b: a != b), lambda x: x))
        d = d.withColumn(count_col, F.when(w.isNotNull(), changed).otherwise(0).cast("long"))
    return d.drop(work)
