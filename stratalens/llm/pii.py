"""Format-preserving pseudonyms for personal data (operator 4), in DataFrame functions only.

Found values are validated, and their characters are permuted within their own format by a keyed Feistel network, so
that equal values become equal pseudonyms in all documents and texts keep their shape:

  card    13 to 19 digits in groups, Luhn number right; the last digit is made right again.  Of a run of groups, any
          whole groups together may be the card: one group by itself or four of four before others, else from the left
  iban    country code, letters and digits, remainder 1 modulo 97; the two check digits are made right again
  phone   digits with + or brackets or separators; country code kept, digits of the rest permuted
  ssn     ddd-dd-dddd with possible groups
  ip      four numbers up to 255; all 2 ** 32 are permuted as one number
  date    a real day from 1801 to 2200, y-m-d or d.m.y or m/d/y (d/m/y where only that is a day); the 146,097 days
          of these 400 years are permuted exactly
  email   letters and digits of the local part and of the domain's names before the last
  secret  hexadecimal strings of 32 or more with a digit and a letter, in small or capital letters; and, after key words
          such as token and = or :, values of 8 characters or more with a digit and a letter (letters and digits are
          permuted, signs and capitals kept); long ones in parts, so that cost follows length

Values that fail validation (a 16-digit number with a wrong Luhn digit, 999.1.1.1) stay as they are.

The network splits n characters in halves and adds to each in turn, digit by digit, a digest of the key, the round,
the kind, the length and the other half, so it is a permutation of each alphabet's strings of that length.

Edge cases: null stays null and counts nothing; an empty text stays empty; a text of any length is treated whole;
repeated rows get the same result; an empty table gives an empty result; columns named like outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("email", "secret", "iban", "date", "ip", "ssn", "card", "phone")
ROUNDS = 8

# The formats looked for.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
WORD = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|credentials?)[\"']?\s{0,3}(?:=>|[:=])\s{0,3}[\"']?(?:(?i:bearer|basic)\s)?"
SIGN = r"[A-Za-z0-9_~+/=-]"
KEYED = WORD + rf"(?=[A-Za-z_~+/.=-]*+[0-9])(?=[0-9_~+/.=-]*+[A-Za-z])(?={SIGN}(?:{SIGN}|\.(?={SIGN})){{7}}){SIGN}++(?:\.{SIGN}++)*+(?![A-Za-z0-9@_~+/=-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|(?<=\+[0-9 ]{2,4})[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9])"
#: A run of groups of digits, as far as it goes: other values end it where they begin.
LOCAL = r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = rf"(?<![0-9])(?!{LOCAL})[0-9](?:(?:[ -](?!{LOCAL}|{EMAIL}|{SECRET}|{DATE}|{IP}|{SSN}))?[0-9]){{12,}}+(?![0-9])"
ANY = "|".join((EMAIL, KEYED, SECRET, IBAN, DATE, IP, SSN, CARD, PHONE))
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once and written once in the expression."""
    return F.transform(F.array(value), body)[0]


def _digest(key: str, tweak: str, k: Column, half: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), k.cast("string"), of.cast("string"), half), 256)


def _add(half: Column, digest: Column, alphabet: str) -> Column:
    """half plus three hexadecimal digits of the digest for each character, modulo the alphabet's size."""
    n, letters = len(alphabet), F.lit(alphabet)

    def with_digest(d: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.instr(letters, F.substring(half, i, F.lit(1))) - 1
            plus = F.conv(F.substring(d, (i * 3 - 2), F.lit(3)), 16, 10).cast("int")
            return F.substring(letters, (at + plus) % n + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")

    return F.when(F.length(half) > 0, let(digest, with_digest)).otherwise(half)


def feistel(text: Column, alphabet: str, key: str, tweak: str) -> Column:
    """A permutation of the strings of text's length over the alphabet (up to 42 characters)."""

    def bound(t: Column) -> Column:
        n = F.length(t)
        cut = F.floor(n / 2).cast("int")

        def turn(s: Column, k: Column) -> Column:
            left = F.struct(_add(s["l"], _digest(key, tweak, k, s["r"], n), alphabet).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), _add(s["r"], _digest(key, tweak, k, s["l"], n), alphabet).alias("r"))
            return F.when(k % 2 == 0, left).otherwise(right)

        start = F.struct(F.substring(t, F.lit(1), cut).alias("l"), F.substring(t, cut + 1, n).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return let(text, bound)


def feistel_number(x: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A permutation of 0..a*b-1."""

    def turn(s: Column, k: Column) -> Column:
        def more(of: Column) -> Column:
            return F.conv(F.substring(_digest(key, tweak, k, of.cast("string"), F.lit(a * b)), 1, 15), 16, 10).cast("long")

        left = F.struct(((s["l"] + more(s["r"])) % a).alias("l"), s["r"].alias("r"))
        return F.when(k % 2 == 0, left).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + more(s["l"])) % b).alias("r")))

    def bound(v: Column) -> Column:
        start = F.struct(((v - v % b) / b).cast("long").alias("l"), (v % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    return let(x, bound)


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits; 0 modulo 10 if the last one is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, i)
        twice = (n - i) % 2 == 1
        return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def iban_rest(code: Column) -> Column:
    """The remainder modulo 97 of country and check digits put last and letters as numbers from 10."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), F.substring(turned, i, F.lit(1))) - 1
        return F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def refill(shape: Column, chars: Column, pattern: str) -> Column:
    """shape with its characters that match pattern (one class) replaced, in order, by those of chars."""

    def bound(pair: Column) -> Column:
        def put(s: Column, i: Column) -> Column:
            c = F.substring(pair["s"], i, F.lit(1))
            new = F.struct(F.concat(s["o"], F.substring(pair["c"], s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))
            return F.when(c.rlike(pattern), new).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k")))

        return F.aggregate(F.sequence(F.lit(1), F.length(pair["s"])), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), put, lambda s: s["o"])

    return let(F.struct(shape.alias("s"), chars.alias("c")), bound)


def _only(s: Column, drop: str) -> Column:
    return F.regexp_replace(s, drop, "")


def _day(m: Column) -> Column:
    """The date that m states, or null."""
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    dots = F.try_to_timestamp(m, F.lit("d.M.yyyy")).cast("date")
    us, eu = F.try_to_timestamp(m, F.lit("M/d/yyyy")).cast("date"), F.try_to_timestamp(m, F.lit("d/M/yyyy")).cast("date")
    day = F.when(m.contains("-"), iso).when(m.contains("."), dots).otherwise(F.coalesce(us, eu))
    return F.when(day.between(F.lit("1801-01-01").cast("date"), F.lit("2200-12-31").cast("date")), day)


def _new_date(m: Column, key: str) -> Column:
    """Another day in m's format; 189 * 773 days are the 400 years from 1801 to 2200."""
    first = F.lit("1801-01-01").cast("date")

    def bound(new: Column) -> Column:
        y = F.date_format(new, "yyyy")
        short = m.rlike(r"^[0-9][./]|[./][0-9][./]")  # a one-digit day or month: no leading zeros
        d = F.date_format(new, "dd")
        d, mo = F.when(short, F.date_format(new, "d")).otherwise(d), F.when(short, F.date_format(new, "M")).otherwise(F.date_format(new, "MM"))
        us = F.try_to_timestamp(m, F.lit("M/d/yyyy")).isNotNull()
        return F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(m.contains("."), F.concat_ws(".", d, mo, y)).when(us, F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws("/", d, mo, y))

    return let(F.date_add(first, feistel_number(F.datediff(_day(m), first).cast("long"), 189, 773, key, "date").cast("int")), bound)


def _parts(s: Column, size: int, new) -> Column:
    """s in parts of size characters, each put through new."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), new), "")


def _letters(s: Column, key: str, tweak: str) -> Column:
    """Letters of s permuted among letters, digits among digits; case kept; in parts of 240, and their runs in parts of 40."""
    return _parts(s, 240, lambda part: _letters_of(part, key, tweak))


def _letters_of(s: Column, key: str, tweak: str) -> Column:

    def of(t: Column, alphabet: str, drop: str, name: str) -> Column:
        def bound(chars: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(chars) - 1) / 40).cast("int")), lambda i: feistel(F.substring(chars, i * 40 + 1, F.lit(40)), alphabet, key, tweak + name))
            return F.when(F.length(chars) > 0, F.array_join(parts, "")).otherwise(chars)

        return let(_only(t, drop), bound)

    def bound(t: Column) -> Column:
        new = refill(refill(t, of(t, LOWER, "[^a-z]", "a"), "^[a-z]$"), of(t, DIGITS, "[^0-9]", "0"), "^[0-9]$")

        def cased(n: Column) -> Column:
            upper = lambda i: F.substring(s, i, F.lit(1)).rlike("^[A-Z]$")
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.when(upper(i), F.upper(F.substring(n, i, F.lit(1)))).otherwise(F.substring(n, i, F.lit(1)))), "")

        return let(new, cased)

    return F.when(F.length(s) > 0, let(F.lower(s), bound)).otherwise(s)


def _new_email(m: Column, key: str) -> Column:
    """Local part and domain are permuted apart, so that accounts of one domain stay together; the last name stays."""
    domain = F.substring_index(m, "@", -1)
    last = F.substring_index(domain, ".", -1)
    names = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    new = lambda part, tweak: let(part, lambda p: _letters(p, key, tweak))
    return F.concat(new(F.substring_index(m, "@", 1), "local"), F.lit("@"), new(names, "domain"), F.lit("."), last)


def _new_ip(m: Column, key: str) -> Column:
    x = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda t, v: t * 256 + v.cast("long"))
    return let(feistel_number(x, 65536, 65536, key, "ip"), lambda y: F.concat_ws(".", *[F.shiftright(y, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)]))


def _new_card(m: Column, key: str) -> Column:
    new = let(_only(m, "[^0-9]"), lambda d: feistel(F.substring(d, F.lit(1), F.length(d) - 1), DIGITS, key, "card"))
    whole = let(new, lambda body: F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))
    return refill(m, whole, "^[0-9]$")


def _new_iban(m: Column, key: str) -> Column:
    land = F.substring(m, 1, 2)
    new = let(_only(m, " "), lambda code: _letters(F.substring(code, F.lit(5), F.length(code)), key, "iban"))
    check = lambda body: F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0")
    return refill(m, let(new, lambda body: F.concat(land, check(body), body)), "^[A-Z0-9]$")


def _new_phone(m: Column, key: str) -> Column:
    """The country code, if there is one set apart, stays; two numbers that differ in separators alone stay equal."""
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]|\+[0-9]{1,2}(?=\())?", 0)
    rest = let(head, lambda h: F.substring(m, F.length(h) + 1, F.length(m)))
    return F.concat(head, let(rest, lambda r: refill(r, feistel(_only(r, "[^0-9]"), DIGITS, key, "phone"), "^[0-9]$")))


def _new_ssn(m: Column, key: str) -> Column:
    """Nine digits, area 001-665 or 667-899: 898 areas, then 99 groups, then 9999 serials, permuted as one number."""
    a, g, s = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    at = F.when(a > 666, a - 2).otherwise(a - 1)

    def bound(y: Column) -> Column:
        s2 = y % 9999
        g2 = ((y - s2) / 9999).cast("long") % 99
        a2 = ((y - s2 - g2 * 9999) / (99 * 9999)).cast("long")
        area = F.when(a2 >= 665, a2 + 2).otherwise(a2 + 1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((g2 + 1).cast("string"), 2, "0"), F.lpad((s2 + 1).cast("string"), 4, "0"))

    return let(feistel_number((at * 99 + g - 1) * 9999 + s - 1, 898 * 11, 9 * 9999, key, "ssn"), bound)


def _new_secret(m: Column, key: str) -> Column:
    """Hexadecimal digits (in parts of 40), equal for small and capital letters; other secrets by letters and digits."""

    def hexed(h: Column) -> Column:
        return _parts(h, 40, lambda part: feistel(part, HEX, key, "secret"))

    small = m.rlike("^[0-9a-f]{32,}$")
    return F.when(small, let(m, hexed)).when(m.rlike("^[0-9A-F]{32,}$"), F.upper(let(F.lower(m), hexed))).otherwise(_letters(m, key, "secret"))


def kind_of(m: Column, digits: Column) -> Column:
    """The kind of a match with these digits if it is valid, or an empty string."""
    bare = F.length(digits) == F.length(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[0-9A-Fa-f]{32,}$") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "secret")
        .when(m.rlike("^[A-Z]{2}"), F.when((F.length(_only(m, " ")).between(15, 34)) & (iban_rest(_only(m, " ")) == 1), "iban").otherwise(""))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$"), F.when(_day(m).isNotNull(), "date").otherwise(""))
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), "ip").otherwise(""))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn").otherwise(""))
        .when(F.length(digits).between(13, 19) & m.rlike(RUN) & card_number(digits), "card")
        .when(~bare & F.length(digits).between(8, 15) & (m.startswith("+") | m.contains("(") | m.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")), "phone")
        .otherwise("")
    )


def card_number(digits: Column) -> Column:
    return (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^(.)\\1*$")


def _cards(m: Column) -> Column:
    """The segments of a run of groups: its cards, and what is between.  One pass from the left, in proportion to the run."""
    groups = F.split(m, "(?<=[0-9])(?=[ -])")  # each with the separator before it

    def bound(g: Column) -> Column:
        n = F.size(g)
        text = lambda i, j: F.array_join(F.slice(g, i, F.greatest(j - i + 1, F.lit(0))), "")
        digits = lambda i, j: _only(text(i, j), "[^0-9]")
        valid = lambda d: F.length(d).between(13, 19) & card_number(d)
        each = F.sequence(F.lit(1), n)

        def usual(i: Column) -> Column:
            """Where the card ends that is group i by itself or four groups of four from i; 0 if there is none."""
            four = (i + 3 <= n) & F.regexp_replace(text(i, i + 3), "^[ -]", "").rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}$")
            return F.when(let(digits(i, i), valid), i).when(four & let(digits(i, i + 3), valid), i + 3).otherwise(F.lit(0))

        def picks(own: Column) -> Column:
            def end(i: Column) -> Column:
                ok = lambda j: ((own[i - 1] == j) | ~F.exists(F.slice(own, i + 1, j - i), lambda k: k > 0)) & let(digits(i, j), valid)
                return F.when(own[i - 1] == i, i).otherwise(F.coalesce(F.array_max(F.filter(F.sequence(i, F.least(n, i + 18)), ok)), F.lit(0)))

            def turn(s: Column, i: Column) -> Column:
                more = lambda j: F.when(j == 0, s).otherwise(F.struct((j + 1).alias("free"), F.concat(s["got"], F.array(F.struct(i.alias("i"), j.alias("j"), s["free"].alias("from")))).alias("got")))
                return F.when(i < s["free"], s).otherwise(let(end(i), more))

            start = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<i:int,j:int,from:int>>").alias("got"))
            return F.aggregate(each, start, turn)

        def segments(s: Column) -> Column:
            one = lambda t: F.array(_segment("", F.concat(text(t["from"], t["i"] - 1), F.regexp_extract(g[t["i"] - 1], "^[ -]?", 0))), _segment("card", F.regexp_replace(text(t["i"], t["j"]), "^[ -]", "")))
            return F.concat(F.flatten(F.transform(s["got"], one)), F.array(_segment("", text(s["free"], n))))

        return let(let(F.transform(each, usual), picks), segments)

    return let(groups, bound)


def _segment(kind, value: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.alias("value"))


RUN = r"^[0-9](?:[ -]?[0-9]){12,}+$"


def segments_of(m: Column) -> Column:
    """What a match is made of, in order: values with their kinds, and the rest with an empty kind."""
    word = F.regexp_extract(m, "^" + WORD, 0)
    whole = let(_only(m, "[^0-9]"), lambda d: F.array(_segment(kind_of(m, d), m)))
    keyed = let(word, lambda w: F.array(_segment("", w), _segment("secret", F.substring(m, F.length(w) + 1, F.length(m)))))
    other = ~m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & m.rlike(RUN)
    return F.when(~m.contains("@") & m.rlike("^" + WORD), keyed).when(other, _cards(m)).otherwise(whole)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """m's pseudonym as that kind."""
    new = {"email": _new_email, "secret": _new_secret, "iban": _new_iban, "date": _new_date, "ip": _new_ip, "ssn": _new_ssn, "card": _new_card, "phone": _new_phone}
    out = F.when(kind == "", m)
    for k in KINDS:
        out = out.when(kind == k, new[k](m, key))
    return out.otherwise(m)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with pseudonyms in its texts, and found (array of struct kind, value, pseudonym, in order of the text)."""
    base = df.drop(*[c for c in df.columns if c in ("found",)])
    own, cut = (fresh(n, *base.columns, "found") for n in ("changed", "parts"))
    hit = F.col(text).rlike("[0-9@]")
    matches = F.when(hit, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = F.transform(matches, lambda m: F.transform(segments_of(m), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(s["value"], s["kind"], key).alias("pseudonym"))))
    got = base.withColumn(cut, named).withColumn("found", F.flatten(cut))
    parts = F.split(F.col(text), ANY, -1)
    new = lambda m: F.coalesce(F.array_join(F.transform(m, lambda s: s["pseudonym"]), ""), F.lit(""))
    joined = F.array_join(F.zip_with(parts, F.col(cut), lambda p, m: F.concat(p, new(m))), "")
    changed = F.exists("found", lambda m: m["kind"] != "")
    return got.withColumn(own, F.when(changed, joined).otherwise(F.col(text))).select(*[F.col(own).alias(text) if c == text else F.col(c) for c in base.columns], F.filter("found", lambda m: m["kind"] != "").alias("found"))
