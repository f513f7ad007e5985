"""PII: personal data becomes format-preserving pseudonyms, the same for equal values everywhere.

Found values are checked first (card numbers by Luhn, IBANs by their remainder modulo 97, dates by
the calendar, IPv4 and US social security numbers by their ranges), then permuted within their own
format by a keyed Feistel network, so that equal values stay equal, different ones stay different
and lengths and punctuation remain:

* digits of a value of a kind are a number below ``10 ** n``; six rounds of an alternating Feistel
  network over its two halves, with a keyed hash as round function, permute these numbers;
* what must stay valid stays valid: a card's last digit and an IBAN's two check digits are computed
  anew, dates are permuted by their day number within a range of years (cycle walking), octets and
  social security areas walk until they are in range again;
* letters of mail names and secrets are permuted with the same network over 36 symbols, letters and
  digits, where upper and lower case and all other characters stay in their places.

A text is split at its matches and put together again, in time linear in its length. Everything is
an SQL expression; there is no Python on the path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import replaced, whole_text, with_row

ROUNDS = 6
#: First and last year of dates that are permuted among themselves.
FIRST_YEAR, LAST_YEAR = 1900, 2099

#: Kinds in the order in which they are tried at a place; each pattern starts at a word's start.
#: Inside a pattern no part can be read in two ways, so a search takes linear time.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:[A-Za-z0-9]++[_-]){0,8}(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+)(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?=T\d)|(?!\w))",
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])",
}
#: Not inside a word, a number or a path; digits may follow the two strokes of an address.
START = r"(?:(?<![A-Za-z0-9._%+@/-])|(?<=//)(?=\d))"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Day numbers of the permuted dates.
FIRST_DAY = f"{FIRST_YEAR}-01-01"
LAST_DAY = f"{LAST_YEAR}-12-31"
DAYS = 73049


def any_pattern() -> str:
    """One pattern for all kinds; the card's back reference is the only numbered group."""
    return START + "(?:" + "|".join(PATTERNS.values()) + ")"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once (an SQL expression has no variables)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed_number(key: str, label: Column, below: int | Column) -> Column:
    """A pseudo-random number below ``below`` for a label, by SHA-256 with the key."""
    code = F.sha2(F.concat(F.lit(key + "|"), label), 256)
    return F.pmod(F.conv(F.substring(code, 1, 13), 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below)


def add_symbols(half: Column, other: Column, label: Column, key: str) -> Column:
    """Move each digit or letter of ``half`` round its own alphabet by a keyed number of steps."""

    def moved(symbol: Column, place: Column) -> Column:
        def step(alphabet: str) -> Column:
            shift = keyed_number(key, F.concat_ws("|", label, place.cast("string"), other), len(alphabet))
            at = F.instr(F.lit(alphabet), symbol)
            return F.substr(F.lit(alphabet), (F.pmod(at - 1 + shift, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

        out = symbol
        for alphabet, kind in ((UPPER, "[A-Z]"), (LOWER, "[a-z]"), (DIGITS, "[0-9]")):
            out = F.when(symbol.rlike(kind), step(alphabet)).otherwise(out)
        return out

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), moved), ""))


def permuted(value: Column, kind: str, key: str) -> Column:
    """The string after six Feistel rounds over its halves; digits stay digits, letters letters.

    The label of a round holds the form of the value (its length), so that values of one format
    are permuted among themselves. A value of one symbol is moved by the key alone.
    """

    def network(whole: Column) -> Column:
        middle = F.floor(F.length(whole) / 2).cast("int")
        first = F.struct(F.left(whole, middle).alias("a"), F.substr(whole, middle + 1, F.length(whole)).alias("b"))

        def turn(state: Column, number: Column) -> Column:
            label = F.concat_ws("|", F.lit(kind), F.length(whole).cast("string"), number.cast("string"))
            even = F.struct(add_symbols(state["a"], state["b"], label, key).alias("a"), state["b"].alias("b"))
            odd = F.struct(state["a"].alias("a"), add_symbols(state["b"], state["a"], label, key).alias("b"))
            return F.when(number % 2 == 0, even).otherwise(odd)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn, lambda s: F.concat(s["a"], s["b"]))

    return bound(value, network)


def permuted_number(value: Column, kind: str, key: str, side: int, size: int) -> Column:
    """A permutation of the numbers below ``size`` (at most ``side ** 2``), by cycle walking.

    Each walk leaves the range with a chance below ``1 - size / side ** 2``; 64 walks are as good
    as all.
    """

    def network(start: Column) -> Column:
        first = F.struct(F.floor(start / side).cast("long").alias("a"), (start % side).cast("long").alias("b"))

        def turn(state: Column, number: Column) -> Column:
            label = F.concat_ws("|", F.lit(kind), number.cast("string"), state["b"].cast("string"))
            moved = F.pmod(state["a"] + keyed_number(key, label, side), F.lit(side)).cast("long")
            return F.struct(state["b"].alias("a"), moved.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn, lambda s: s["a"] * side + s["b"])

    def walk(now: Column, step: Column) -> Column:
        return F.when(now < size, now).otherwise(network(now))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), network(value), walk)


def filled(template: Column, symbols: Column, kept: str) -> Column:
    """The template with its characters of class ``kept`` replaced by ``symbols``, in order."""

    def put(symbol: Column, place: Column) -> Column:
        before = F.length(F.regexp_replace(F.left(template, place + 1), f"[^{kept}]", ""))
        return F.when(symbol.rlike(f"[{kept}]"), F.substr(symbols, before, F.lit(1))).otherwise(symbol)

    return F.array_join(F.transform(F.split(template, ""), put), "")


def only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, f"[^{kept}]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of a card number's digits, every second one from the right but one doubled."""
    symbols = F.reverse(F.split(digits, ""))

    def worth(symbol: Column, place: Column) -> Column:
        twice = symbol.cast("int") * 2
        return F.when(place % 2 == 0, symbol.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(symbols, worth), F.lit(0), lambda total, x: total + x)


def remainder_97(text: Column) -> Column:
    """An IBAN's remainder (its first four characters moved to the end, letters as 10 to 35)."""
    symbols = F.split(F.concat(F.substr(text, F.lit(5), F.length(text)), F.left(text, F.lit(4))), "")

    def add(total: Column, symbol: Column) -> Column:
        code = F.ascii(symbol)
        return F.when(code < 65, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(symbols, F.lit(0), add)


def card(value: Column, key: str) -> Column:
    """All digits but the last are permuted, the last is the new check digit; null if not a card."""

    def of(digits: Column) -> Column:
        body = permuted(F.left(digits, F.length(digits) - 1), "card", key)
        checked = bound(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when((luhn_sum(digits) % 10 == 0) & digits.rlike("[1-9]"), filled(value, checked, "0-9"))

    return bound(only(value, "0-9"), of)


def iban(value: Column, key: str) -> Column:
    """The account part is permuted, the check digits are computed anew; null if not an IBAN."""

    def of(plain: Column) -> Column:
        body = permuted(F.substr(plain, F.lit(5), F.length(plain)), "iban", key)

        def with_check(b: Column) -> Column:
            rest = remainder_97(F.concat(F.left(plain, F.lit(2)), F.lit("00"), b))
            return F.concat(F.left(plain, F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), b)

        return F.when(remainder_97(plain) == 1, filled(value, bound(body, with_check), "A-Z0-9"))

    return bound(only(value, "A-Z0-9"), of)


def date(value: Column, key: str) -> Column:
    """Another day of the range of years, written in the same way; null if not a date of it.

    Dates with points or strokes have the day first, or the month if only that makes a date.
    """
    out = F.lit(None).cast("string")
    for shape, pattern in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy")):
        day = F.try_to_timestamp(value, F.lit(pattern)).cast("date")
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        moved = permuted_number(number.cast("long"), "date", key, 271, DAYS)
        # try_to_timestamp is asked only where the shape fits; a day out of the calendar is null.
        inside = value.rlike(shape) & day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
        out = F.when(inside, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), pattern)).otherwise(out)
    return out


def ip(value: Column, key: str) -> Column:
    """Another IPv4 address; leading zeros never get here."""
    number = F.aggregate(F.split(value, "\\."), F.lit(0).cast("long"), lambda total, part: total * 256 + part.cast("long"))
    parts = bound(
        permuted_number(number, "ip", key, 1 << 16, 1 << 32),
        lambda n: F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))),
    )
    return parts


def ssn(value: Column, key: str) -> Column:
    """Nine digits, walked until the area, group and serial numbers are in use; null if they are not."""
    valid = r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"

    def of(digits: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(64))
        moved = F.aggregate(steps, permuted(digits, "ssn", key), lambda now, _: F.when(now.rlike(valid), now).otherwise(permuted(now, "ssn", key)))
        return F.when(digits.rlike(valid), filled(value, moved, "0-9"))

    return bound(only(value, "0-9"), of)


def tail_permuted(value: Column, kind: str, key: str, head: str, kept: str) -> Column:
    """What follows the part that matches ``head`` is permuted, by its characters of class ``kept``."""

    def of(start: Column) -> Column:
        rest = F.substr(value, F.length(start) + 1, F.length(value))
        return F.concat(start, bound(rest, lambda r: filled(r, permuted(only(r, kept), kind, key), kept)))

    return bound(F.regexp_extract(value, head, 0), of)


def email(value: Column, key: str) -> Column:
    """The name is permuted, the domain stays."""
    at = F.instr(value, "@")
    name = F.left(value, at - 1)
    return F.concat(bound(name, lambda n: filled(n, permuted(only(n, "A-Za-z0-9"), "email", key), "A-Za-z0-9")), F.substr(value, at, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """``kind`` and ``text`` for a match; the text is unchanged and the kind null if it is not valid."""
    makers: dict[str, Callable[[Column], Column]] = {
        "email": lambda v: email(v, key),
        "secret": lambda v: tail_permuted(v, "secret", key, r"^(?:AKIA|gh[pousr]_|[A-Za-z0-9_-]+[\"']?[ \t]*[:=][ \t]*[\"']?)", "A-Za-z0-9"),
        "iban": lambda v: iban(v, key),
        "date": lambda v: date(v, key),
        "ip": lambda v: ip(v, key),
        "ssn": lambda v: ssn(v, key),
        "card": lambda v: card(v, key),
        "phone": lambda v: tail_permuted(v, "phone", key, r"^(?:\+\d{1,3}(?=[ .(-])|)", "0-9"),
    }
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        fits = value.rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        text = F.when(fits, makers[name](value)).otherwise(text)
    return F.struct(F.when(text.isNotNull(), kind).alias("kind"), F.coalesce(text, value).alias("text"))


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``row`` (all columns, the text with pseudonyms) and ``found``, the kinds in their order.

    Null texts stay null, texts without a match are unchanged. Equal texts get equal results, so
    repeated rows do; an empty table gives an empty one. Matches have no longest length. All columns
    travel in ``row``, so no name can clash.

    Not looked for: names, postal addresses, IPv6, identity numbers of other countries, dates with
    names of months, phones without a plus, brackets or separators, and secrets without a key word
    before them that are not AWS or GitHub keys. Phones are told by their form alone.
    """
    pattern = any_pattern()
    held = F.col(f"`{text_column}`").cast("string")
    whole = with_row(docs, text=whole_text(held))
    split = whole.withColumn("some", F.col("text").rlike("[0-9@:=]")).select(
        "row",
        "text",
        F.when(F.col("some"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("values"),
        F.when(F.col("some"), F.split("text", pattern)).alias("between"),
    )
    named = split.withColumn("names", F.when(F.size("values") > 0, F.transform("values", lambda v: pseudonym(v, key))))
    pieces = F.zip_with("between", "names.text", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.col("names").isNull(), F.col(f"row.`{text_column}`").cast("string")).otherwise(F.array_join(pieces, ""))
    found = F.filter(F.coalesce(F.col("names.kind"), F.expr("cast(array() as array<string>)")), lambda k: k.isNotNull())
    return named.select(F.struct(*replaced(docs, **{text_column: text})).alias("row"), found.alias("found"))
