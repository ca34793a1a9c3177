"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

What looks private is found by one pattern and validated by kind: card numbers by their check digit, addresses of
machines by their range, social security numbers by the numbering rules, dates by the calendar; telephone numbers by
their form alone, those within the numbering rules and those outside permuted each among themselves. A valid
value is written as two numbers (a, b) that exactly cover the values of its kind, and a keyed Feistel network with modular
addition permutes the pairs. The result is a valid value of the same format; equal values get equal pseudonyms in all
documents, different values different ones. What has no numbering (mail addresses, keys and passwords) gets a
keyed hash in its own shape. Numbers that fail validation stay as they are.

Defined cases: a null text stays null, an empty one empty, with nothing found; rows are handled one by one, so repeated
rows agree; other columns are kept; a text of any length is one row and is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of the registered query; a real run passes its own.
EXAMPLE_KEY = "example key, to be replaced"
ROUNDS = 5

# The shapes of private data. Each kind is told from the others by its shape alone.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"(?i:token|password|passwd|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\d(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASH_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)"
#: Every shape has one of these characters, or the beginning of an access key: most texts need no closer look.
HINT = "[0-9@=:]|AKIA|ASIA"
ANY = "|".join((CARD, MAIL, SECRET, ACCESS, ADDRESS, PHONE, SOCIAL, ISO_DATE, SLASH_DATE))


class Cipher:
    """Keyed functions over pairs of numbers."""

    def __init__(self, key: str):
        self.key = key

    def number(self, *parts: Column) -> Column:
        """60 pseudorandom bits from the key and ``parts``."""
        text = F.concat_ws("|", F.lit(self.key), *[p.cast("string") for p in parts])
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def permute(self, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
        """struct(a, b): the Feistel image of the pair within ``size_a`` times ``size_b``; a bijection for each tweak."""

        def turn(state: Column, k: Column) -> Column:
            left = F.pmod(state["a"] + F.pmod(self.number(tweak, k, F.lit("a"), state["b"]), size_a), size_a)
            right = F.pmod(state["b"] + F.pmod(self.number(tweak, k, F.lit("b"), left), size_b), size_b)
            return F.struct(left.alias("a"), right.alias("b"))

        begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn)

    def hex(self, kind: str, value: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), value).cast("binary"), 256)


def _one(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _padded(n: Column, width) -> Column:
    text = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.lit(width) - F.length(text)), text)


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)

    def worth(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, k: total + worth(k))


def _in_shape(shape: Column, digits: Column) -> Column:
    """The digits of ``digits`` put one by one where ``shape`` has digits."""
    step = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(r"^\d$"), F.substring(digits, s["next"], F.lit(1))).otherwise(c)).alias("out"),
            (s["next"] + F.when(c.rlike(r"^\d$"), 1).otherwise(0)).alias("next"),
        ),
    )
    return step["out"]


def _card(cipher: Cipher, found: Column) -> Column:
    def moved(d: Column) -> Column:
        n = F.length(d)
        left = F.floor((n - 2) / 2).cast("int")
        right = n - 2 - left
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        pair = cipher.permute(
            F.concat_ws("-", F.lit("card"), n.cast("string"), F.substring(d, 1, 1)),
            F.substring(d, F.lit(2), left).cast("long"), F.substring(d, left + 2, right).cast("long"), power(left), power(right),
        )
        body = _one(pair, lambda p: F.concat(F.substring(d, 1, 1), F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))
        return _one(body, lambda x: _in_shape(found, F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))))

    return _one(_digits(found), lambda d: F.when(luhn_sum(d) % 10 == 0, moved(d)))


def _address(cipher: Cipher, found: Column) -> Column:
    def moved(p: Column) -> Column:
        o = lambda k: F.get(p, F.lit(k)).cast("long")
        pair = cipher.permute(F.lit("address"), o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536))
        parts = lambda x: F.concat_ws(".", *[n.cast("string") for n in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)])
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), _one(pair, parts))

    return _one(F.split(found, r"\."), moved)


def _phone(cipher: Cipher, found: Column) -> Column:
    def moved(d: Column) -> Column:
        last = F.substring(d, -10, 10)
        area, exchange, line = (F.substring(last, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        # Numbers by the numbering rules stay so; the others are permuted among themselves: area code and exchange first,
        # of 1000 * 1000 pairs those 200 * 1000 with an area code below 200, then 800 * 200 with an exchange below 200.
        ruled = (area >= 200) & (exchange >= 200)
        code = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        pair = F.when(
            ruled, cipher.permute(F.lit("phone"), area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000))
        ).otherwise(cipher.permute(F.lit("phone by form"), code, line, F.lit(360_000), F.lit(10_000)))

        def text(x: Column) -> Column:
            rest = x["a"] - 200_000
            low = F.when(rest < 0, x["a"]).otherwise((200 + F.floor(rest / 200)) * 1000 + rest % 200)
            ten = F.when(ruled, F.concat((x["a"] + 200).cast("string"), _padded(x["b"] + 2_000_000, 7)))
            ten = ten.otherwise(F.concat(_padded(low, 6), _padded(x["b"], 4)))
            return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), ten)

        return _in_shape(found, _one(pair, text))

    return _one(_digits(found), moved)


def _social(cipher: Cipher, found: Column) -> Column:
    area, group, serial = (F.substring(found, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("long")
    pair = cipher.permute(F.lit("social"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(x: Column) -> Column:
        n = F.floor(x["a"] / 99)
        first = n + 1 + (n >= 665).cast("long")
        return F.concat_ws("-", _padded(first, 3), _padded(x["a"] % 99 + 1, 2), _padded(x["b"] + 1, 4))

    return F.when(valid, _one(pair, text))


#: 400 years of the calendar are 146,097 days, 627 times 233: every pair is a day.
_FIRST_DAY = "1800-01-01"


def _date(cipher: Cipher, day: Column, shape: str) -> Column:
    """Image of a day from 1800 to 2199, written in ``shape``; null where the day is none or lies outside."""

    def moved(n: Column) -> Column:
        pair = cipher.permute(F.lit("date"), F.floor(n / 233), n % 233, F.lit(627), F.lit(233))
        at = lambda x: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (x["a"] * 233 + x["b"]).cast("int")), shape)
        return F.when(n.between(0, 146_096), _one(pair, at))

    return _one(F.datediff(day, F.lit(_FIRST_DAY).cast("date")), moved)


def pseudonym(cipher: Cipher, found: Column) -> Column:
    """The pseudonym of one found value, or null if it is not valid."""

    def whole(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    def day(form: str, text: Column = found) -> Column:
        return F.try_to_timestamp(text, F.lit(form)).cast("date")

    local = F.substring(cipher.hex("mail", F.lower(found)), 1, 16)
    lead = F.regexp_extract(found, r"(?s)^(.*?[=:]\s*[\"']?)[A-Za-z0-9+/_-]+$", 1)
    value = F.substring(found, F.length(lead) + 1, F.length(found))
    secret = lambda v: F.concat(lead, F.substring(F.repeat(cipher.hex("secret", v), F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v)))
    access = F.translate(F.upper(F.substring(cipher.hex("access", found), 1, 16)), "0189", "GHIJ")
    slashed = F.coalesce(_date(cipher, day("MM/dd/yyyy"), "MM/dd/yyyy"), _date(cipher, day("dd/MM/yyyy"), "dd/MM/yyyy"))
    return (
        F.when(whole(CARD), _card(cipher, found))
        .when(F.contains(found, F.lit("@")), F.concat(F.lit("user."), local, F.lit("@mail.example")))
        .when(whole(ADDRESS), _address(cipher, found))
        .when(whole(SOCIAL), _social(cipher, found))
        .when(whole(ISO_DATE), _date(cipher, day("yyyy-MM-dd"), "yyyy-MM-dd"))
        .when(whole(SLASH_DATE), slashed)
        .when(whole(PHONE), _phone(cipher, found))
        .when(whole(ACCESS), F.concat(F.substring(found, 1, 4), access))
        .otherwise(_one(value, secret))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_private``: how many values were replaced."""
    cipher = Cipher(key)
    body = F.col(text)
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    named = F.transform(found, lambda x: F.struct(x.alias("old"), pseudonym(cipher, x).alias("new")))
    split = F.when(body.rlike(HINT) & body.rlike(ANY), F.struct(F.split(body, ANY, -1).alias("between"), named.alias("named")))
    parts = docs.withColumn("_split", split)
    between, named = F.col("_split.between"), F.col("_split.named")
    told = F.concat(
        F.get(between, F.lit(0)),
        F.array_join(
            F.zip_with(named, F.slice(between, F.lit(2), F.size(named)), lambda x, after: F.concat(F.coalesce(x["new"], x["old"]), after)), ""
        ),
    )
    count = F.size(F.filter(named, lambda x: x["new"].isNotNull()))
    return parts.withColumn(text, F.when(F.col("_split").isNotNull(), told).otherwise(body)).withColumn(
        "n_private", F.when(F.col("_split").isNotNull(), count).otherwise(0).cast("long")
    ).drop("_split")
