"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Patterns find candidates kind by kind, each is validated, and a valid one is replaced by a
keyed permutation of itself within its format (a Feistel network whose round function is
SHA-256 of key, kind, round and the other half), so equal values stay equal across
documents and different ones stay different:

* number (13 to 19 digits, also in groups, Luhn valid): all digits but the last are permuted,
  the last is the new check digit. Of a longer run of groups every valid part on group borders
  is replaced: first parts in the groups of cards, then any of up to five groups of three digits or more; of parts that overlap the leftmost,
  then the longest. A number that fails the check is no card and stays;
* phone (international or North American, whole groups of 8 to 15 digits): digits after the
  country code;
* ssn (area, group and serial valid): digits, walked on until valid again;
* iban (mod 97 valid): the account part, with new check digits;
* ip (dotted quad of octets): the 32-bit address;
* date (a real day from 1900 to 2099; year-month-day, day.month.year, month/day/year or, if
  that is no day, day/month/year): year with month against day, walked on until a real day. A
  date moves among those of its format: the same order and as many digits of day and month, so
  a day/month date gets a day over 12 again and is never read as another's pseudonym;
* email: letters and digits before the @, each within its class;
* secret (24 or more hexadecimal digits, letters and digits both): within its alphabet.

A value that is replaced is held back while the kinds after it are looked for, so none runs on
into it, and a candidate that fails its check hides no value of a later kind.

Separators, letter case and lengths stay (an address's octets may get other lengths). The
permutations can be inverted with the key. The key is a parameter: take it from a secret
store; it appears in query plans, so set spark.sql.redaction.string.regex to a pattern that
it matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeplan.llm.shared import exactly

ROUNDS = 10
#: What finds candidates, by kind (Java regular expressions).
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?=[0-9a-f]*+(?![A-Za-z0-9])|[0-9A-F]*+(?![A-Za-z0-9]))(?=[A-Fa-f]*+\d)(?=\d*+[A-Fa-f])[0-9A-Fa-f]{24,}+"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
#: Behind a country code and an area in brackets of so many digits: whole groups, 8 to 15 digits in all, and no address or date.
_TAIL = rf"[ .-]?\d(?:(?:(?: (?!{IP}|{DATE})|[.-])(?=\d\d))?\d)"
WORLD = "|".join(rf"\+\d{{{c}}}{rf'[ .-]?\(\d{{{a}}}\)' if a else ''}{_TAIL}{{{max(7 - c - a, 1)},{14 - c - a}}}(?!\d)" for c in (1, 2, 3) for a in range(5))
#: Of ten digits, so that its end is known whatever follows.
AMERICA = r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
#: A whole run of groups with 13 digits or more; the groups that cards are written in, and any up to five groups of three digits or more: what
#: has more or shorter ones is a list of numbers.
NUMBER = r"(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++)*+"
CARD = r"^(?:\d{13,19}|\d{4} \d{6} \d{4,5}|\d{4} \d{4} \d{4} \d{4}(?: \d{3})?)$"
ANY = r"^\d{3,}(?: \d{3,}){0,4}$"
#: Stands for a value that is replaced already.
HELD = "\x00"
#: Not the rest of a phone number behind its country code.
FREE = r"(?<!\+\d{1,3}[ .-])"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, kind: str, n: Column, other: Column) -> Column:
    """128 hexadecimal digits."""
    start = F.concat(F.lit(f"{key}\x1f{kind}\x1f"), n.cast("string"), F.lit("\x1f"), other)
    return F.concat(F.sha2(F.concat(start, F.lit("\x1f0")), 256), F.sha2(F.concat(start, F.lit("\x1f1")), 256))


def _shifted(half: Column, stream: Column, letters: int) -> Column:
    """Each digit, lower and upper letter moved within its class by its own four digits of the stream."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(stream, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        moved = lambda first, n: F.char(first + (code - first + step) % n)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, letters)).when(c.between("A", "Z"), moved(65, letters)).otherwise(c)

    return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))


def permuted(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A keyed permutation of strings with the same classes of characters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, n: Column) -> Column:
        return let(_digest(key, kind, n, s["r"]), lambda d: F.struct(s["r"].alias("l"), _shifted(s["l"], d, letters).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_bits(value: Column, bits: int, key: str, kind: str) -> Column:
    """A keyed permutation of longs from 0 to 2^(2 * bits) - 1."""
    mask = (1 << bits) - 1
    start = F.struct(F.shiftright(value, bits).alias("l"), value.bitwiseAND(F.lit(mask)).cast("long").alias("r"))

    def turn(s: Column, n: Column) -> Column:
        f = F.conv(F.substr(_digest(key, kind, n, s["r"].cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(f.bitwiseAND(F.lit(mask))).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.shiftleft(s["l"], bits) + s["r"])


def walked(value: Column, step, valid, most: int) -> Column:
    """step(value), again until it is valid: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), step(value), lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, F.length(body) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add) % 10) % 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _refilled(m: Column, chars: Column, where: str) -> Column:
    """m with its characters of the class `where` replaced in turn by those of `chars`."""

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(m, F.lit(1), i), f"[^{where}]", "")) + 1
        return F.when(c.rlike(f"[{where}]"), F.substr(chars, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _mod97(text: Column) -> Column:
    """A string of digits and capitals as a number (A: 10 ... Z: 35), by 97."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda t, c: add(t, c).cast("int"))


def permuted_pair(pair: Column, sizes: tuple[Column, Column], key: str, kind: Column) -> Column:
    """A keyed permutation of struct(a long, b long) with 0 <= a < sizes[0] and 0 <= b < sizes[1]: each in turn is
    moved by a function of the other."""

    def moved(own: Column, other: Column, size: Column, n: Column) -> Column:
        start = F.concat(F.lit(f"{key}\x1f"), kind, F.lit("\x1f"), n.cast("string"), F.lit("\x1f"), other.cast("string"))
        return (own + F.conv(F.substr(F.sha2(start, 256), F.lit(1), F.lit(12)), 16, 10).cast("long")) % size

    def turn(s: Column, n: Column) -> Column:
        return let(moved(s["a"], s["b"], sizes[0], n), lambda a: F.struct(a.alias("a"), moved(s["b"], a, sizes[1], n).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn)


#: The years of dates.
FIRST_YEAR, YEARS = 1900, 200


def _real(y: Column, mo: Column, d: Column) -> Column:
    """Whether it is a day of those years."""
    leap = F.when((y % 4 == 0) & (y != 1900), 29).otherwise(28)
    return y.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1) & mo.between(1, 12) & d.between(1, F.when(mo == 2, leap).when(mo.isin(4, 6, 9, 11), 30).otherwise(31))


def _date(m: Column, key: str) -> Column:
    def read(parts: Column) -> Column:
        n = [F.get(parts, i).cast("long") for i in range(3)]
        iso, dotted = m.contains("-"), m.contains(".")
        american = ~iso & ~dotted & _real(n[2], n[0], n[1])
        at = F.when(iso, F.array(F.lit(0), F.lit(1), F.lit(2))).when(american, F.array(F.lit(2), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(1), F.lit(0)))
        form = F.when(iso, "-").when(dotted, ".").when(american, "/").otherwise("//")
        return let(at, lambda at: placed(F.struct(form.alias("form"), *[F.get(parts, at[k]).alias(c) for k, c in enumerate("ymd")])))

    def placed(own: Column) -> Column:
        # days over 12 only, where less would be read as a month; as many digits as before
        least = F.when(own["form"] == "//", 13).otherwise(1).cast("long")
        months = F.when(F.length(own["m"]) == 1, 9).otherwise(12).cast("long")
        days = F.when(F.length(own["d"]) == 1, 9).otherwise(31).cast("long") - least + 1
        kind = F.concat(F.lit("date"), own["form"], months.cast("string"), F.lit(","), days.cast("string"))
        return let(F.struct(own.alias("own"), least.alias("least"), months.alias("months"), days.alias("days"), kind.alias("kind")), moved)

    def moved(c: Column) -> Column:
        own, y, mo, d = c["own"], *(c["own"][x].cast("long") for x in "ymd")
        start = F.struct(((y - FIRST_YEAR) * c["months"] + mo - 1).alias("a"), (d - c["least"]).alias("b"))
        step = lambda v: permuted_pair(v, (c["months"] * YEARS, c["days"]), key, c["kind"])
        parts = lambda v: (F.floor(v["a"] / c["months"]) + FIRST_YEAR, v["a"] % c["months"] + 1, v["b"] + c["least"])
        new = walked(start, step, lambda v: _real(*parts(v)), 40)  # at most one in 20 is no day

        def written(v: Column) -> Column:
            y, mo, d = (F.lpad(n.cast("string"), F.length(own[x]), F.lit("0")) for n, x in zip(parts(v), "ymd", strict=True))
            form = own["form"]
            mark = F.substr(form, F.lit(1), F.lit(1))
            return F.when(form == "-", F.concat(y, mark, mo, mark, d)).when(form == "/", F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))

        return F.when(_real(y, mo, d), let(new, written))

    return let(F.split(m, r"[./-]"), read)


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(m, r"\."), i).cast("long")
    whole = F.shiftleft(octet(0), 24) + F.shiftleft(octet(1), 16) + F.shiftleft(octet(2), 8) + octet(3)
    shown = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.greatest(*[octet(i) for i in range(4)]) <= 255, let(permuted_bits(whole, 16, key, "ip"), shown))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda v: ~v.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")
    new = walked(_digits(m), lambda v: permuted(v, key, "ssn"), valid, 96)
    return F.when(valid(_digits(m)), let(new, lambda v: _refilled(m, v, "0-9")))


def _number(m: Column, key: str) -> Column:
    def renumbered(all_digits: Column) -> Column:
        body = F.substr(all_digits, F.lit(1), F.length(all_digits) - 1)
        return let(permuted(body, key, "number"), lambda new: _refilled(m, F.concat(new, luhn_digit(new).cast("string")), "0-9"))

    return let(_digits(m), renumbered)


def _luhn(digits: Column) -> Column:
    return luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1)).cast("int")


def _numbers(m: Column, key: str, groups: str) -> Column:
    """A run of groups of digits, as _read() gives it: valid parts of `groups` on group borders are held."""

    def parted(units: Column) -> Column:
        part = lambda i, k: F.regexp_replace(F.array_join(F.slice(units, i + 1, k), ""), "[ -]$", "")

        def valid(p: Column) -> Column:
            fits = lambda d: F.when(F.length(d).between(13, 19) & F.regexp_replace(p, "-", " ").rlike(groups), _luhn(d)).otherwise(False)
            return let(_digits(p), fits)

        def reading(i: Column) -> Column:
            sizes = F.sequence(F.least(F.lit(19), F.size(units) - i), F.lit(1), F.lit(-1))
            return F.coalesce(F.get(F.filter(sizes, lambda k: let(part(i, k), valid)), 0), F.lit(0))

        def chosen(sizes: Column) -> Column:
            def add(s: Column, i: Column) -> Column:
                unit = F.element_at(units, i + 1)
                last = lambda k: F.regexp_replace(F.element_at(units, i + k), r"\d", "")
                taken = let(F.element_at(sizes, i + 1), lambda k: F.struct((i + k).alias("next"), F.concat(s["text"], F.lit(HELD), last(k)).alias("text"), F.concat(s["values"], F.array(_number(part(i, k), key))).alias("values")))
                passed = F.struct((i + 1).alias("next"), F.concat(s["text"], unit).alias("text"), s["values"].alias("values"))
                return F.when(s["next"] > i, s).when(F.element_at(sizes, i + 1) > 0, taken).otherwise(passed)

            start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"), F.array().cast("array<string>").alias("values"))
            made = F.aggregate(F.sequence(F.lit(0), F.size(units) - 1), start, add, lambda s: F.struct(s["text"].alias("text"), s["values"].alias("values")))
            return F.when(F.exists(sizes, lambda k: k > 0), made).otherwise(_left(m))

        return let(F.transform(F.sequence(F.lit(0), F.size(units) - 1), reading), chosen)

    return let(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0)), parted)


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-]))?", 0)
    tail = F.substr(m, F.length(head) + 1, F.length(m))
    enough = F.length(_digits(m)).between(8, 15)
    return F.when(enough, F.concat(head, let(permuted(_digits(tail), key, "phone"), lambda v: _refilled(tail, v, "0-9"))))


def _iban(m: Column, key: str) -> Column:
    flat = F.regexp_replace(m, " ", "")
    land, own = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
    valid = _mod97(F.concat(own, F.substr(flat, F.lit(1), F.lit(4)))) == 1
    new = let(permuted(own, key, "iban"), lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(valid & F.length(flat).between(15, 34), let(new, lambda v: _refilled(m, v, "A-Z0-9")))


def _ibans(m: Column, key: str) -> Column:
    """A run of groups, as _read() gives it: the longest valid IBAN at its start is held."""

    def parted(groups: Column) -> Column:
        part = lambda k: F.array_join(F.slice(groups, 1, k), " ")
        new = F.filter(F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), _iban(part(k), key).alias("new"))), lambda x: x["new"].isNotNull())
        held = lambda x: F.struct(F.concat(F.lit(HELD), F.substr(m, F.length(part(x["k"])) + 1, F.length(m))).alias("text"), F.array(x["new"]).alias("values"))
        return let(F.get(new, 0), lambda x: F.when(x.isNull(), _left(m)).otherwise(held(x)))

    return let(F.split(m, " "), parted)


def _email(m: Column, key: str) -> Column:
    own = F.substring_index(m, "@", 1)
    return F.concat(permuted(own, key, "email"), F.substr(m, F.length(own) + 1, F.length(m)))


def _left(m: Column) -> Column:
    """A candidate without valid values, as _read() gives it."""
    return F.struct(m.alias("text"), F.array().cast("array<string>").alias("values"))


def _read(new: Column, m: Column) -> Column:
    """struct(text, values) of a candidate: HELD and its replacement, or the candidate itself if that is null."""
    return let(new, lambda v: F.when(v.isNull(), _left(m)).otherwise(F.struct(F.lit(HELD).alias("text"), F.array(v).alias("values"))))


#: What a text must have, at the least, for a sweep to be worth its while. Each is implied by the patterns it stands before, also on a text where
#: values are held back already, and is a test that most texts fail after one quick pass.
GATES = {
    "word": lambda t: t.contains("@") | t.rlike(r"[0-9A-Fa-f]{24}"),
    "land": lambda t: t.rlike(r"[A-Z]{2}\d{2}"),
    "few": lambda t: t.rlike(r"\d(?:[./-]?\d){3}"),
    "more": lambda t: t.rlike(r"\d(?:[ .()-]{0,3}\d){6}"),
    "many": lambda t: t.rlike(r"\d(?:[ -]?\d){12}"),
    "plus": lambda t: t.contains("+") & t.rlike(r"\+\d"),
}


def _swept(text: Column, may: Column, pattern: str, read) -> Column:
    """struct(text, values, n): the text with HELD for each value that `read` finds in candidates, what stands there,
    and how many new values that are. HELD itself is found again in its turn."""
    every = rf"\x00|{pattern}"

    def joined(found: Column) -> Column:
        gaps = F.split(text, every, -1)
        join = lambda gap, i: F.concat(gap, F.coalesce(F.get(found, i)["text"], F.lit("")))
        values = F.flatten(F.transform(found, lambda x: x["values"]))
        own = F.size(F.filter(values, lambda v: v != HELD))
        return F.struct(F.array_join(F.transform(gaps, join), "").alias("text"), values.alias("values"), own.cast("long").alias("n"))

    held = lambda m: F.struct(F.lit(HELD).alias("text"), F.array(F.lit(HELD)).alias("values"))
    found = F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda m: F.when(m == HELD, held(m)).otherwise(read(m)))
    none = F.struct(text.alias("text"), F.lit(None).cast("array<string>").alias("values"), F.lit(0).cast("long").alias("n"))
    return F.when(may & text.rlike(pattern), let(found, joined)).otherwise(none)


def _filled(text: Column, values: Column) -> Column:
    """The text with each HELD replaced by its value."""
    join = lambda gap, i: F.concat(gap, F.coalesce(F.get(values, i), F.lit("")))
    return F.when(values.isNull(), text).otherwise(F.array_join(F.transform(F.split(text, r"\x00", -1), join), ""))


def _sweeps(key: str) -> list[tuple]:
    """A gate, then arguments of _swept(), in order of precedence."""

    def named(m: Column) -> Column:
        return _read(F.when(m.contains("@"), _email(m, key)).otherwise(permuted(m, key, "secret", 6)), m)

    def dotted(m: Column) -> Column:
        return _read(F.when(m.rlike(rf"^{IP}$"), _ip(m, key)).when(m.rlike(rf"^{DATE}$"), _date(m, key)).otherwise(_ssn(m, key)), m)

    def phone(m: Column) -> Column:
        return _read(_phone(m, key), m)

    return [
        ("word", rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]*+@){EMAIL}|(?<![A-Za-z0-9]){SECRET}", named),
        ("land", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d){IBAN}", lambda m: _ibans(m, key)),
        ("few", rf"{FREE}(?:(?<![\d.]){IP}|(?<![\d./-]){DATE}|(?<![\d-]){SSN})", dotted),
        ("more", rf"(?<![\d+]){AMERICA}", phone),
        ("many", rf"(?<![\d+]){NUMBER}", lambda m: _numbers(m, key, CARD)),
        ("plus", rf"(?<![\d+])(?:{WORLD})", phone),
        ("many", rf"(?<!\d){NUMBER}", lambda m: _numbers(m, key, ANY)),
    ]


def pseudonymized(docs: DataFrame, text: Column, key: str) -> DataFrame:
    """(row, made): the columns of docs, which may have any names, as a struct; and struct(text, n_replaced), the text
    with every valid value replaced, and how many that were; the text is null for null."""
    sweeps = _sweeps(key)
    made, now = docs.select(F.struct(*[exactly(c).alias(c) for c in docs.columns]).alias("row"), text.alias("text")), F.col("text")
    made = made.withColumn("may", F.struct(*[gate(now).alias(c) for c, gate in GATES.items()]))
    done = [f"sweep{k}" for k in range(len(sweeps))]
    for column, sweep in zip(done, sweeps, strict=True):  # one projection each: nested in one, they are too deep for the analyzer
        made = made.withColumn(column, _swept(now, F.col("may")[sweep[0]], *sweep[1:]))
        now = F.col(column)["text"]
    for column in reversed(done):
        now = _filled(now, F.col(column)["values"])
    return made.select("row", F.struct(now.alias("text"), sum((F.col(c)["n"] for c in done), F.lit(0).cast("long")).alias("n_replaced")).alias("made"))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced), one row for each row of docs.

    A null text stays null with 0 replaced, a null id stays; a text without candidates stays as it is;
    equal values have equal pseudonyms in all rows; repeated rows give repeated rows; an empty
    table gives none; other columns are not looked at; a very long text is one value of one row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = pseudonymized(rows, F.col("text"), key)
    return made.select(F.col("row.doc_id").alias("doc_id"), F.col("made.text").alias("text"), F.col("made.n_replaced").alias("n_replaced"))
