"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions alone.

Numbers that validate (cards by issuer and Luhn, IBANs by mod 97, social security numbers, IP addresses, phone
numbers, calendar dates), mail addresses and credentials are permuted within their format by a Feistel network
keyed with SHA-256. A permutation has no collisions, so equal values get equal pseudonyms in every document and different
values different ones; separators, lengths, check digits and domains of addresses stay valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates that are permuted: DAYS days from the first of 1900, as a product of two moduli.
FIRST_DAY, DAYS = "1900-01-01", (250, 292)

#: An assignment to a name with one of these words in it, up to the value and its quote. A value ends at its quote or a blank, without a quote at a delimiter too.
SECRET_NAME = r"(?>(?i:password|passwd|secret|token|api[_-]?key)(?:(?i:key|s)?(?:[A-Z0-9_.-][A-Za-z0-9_.-]{0,64}+)?)(?:\\{0,3}[\"'])?[ \t]{0,16}[=:]{1,2}>?[ \t]{0,16})"
BLANKS = r" \t\r\n\x0b\f\u00a0\u2028\u2029\u3000"
SECRET_VALUE = rf"""(?:\\{{0,3}}"[^"{BLANKS}]{{12,}}+|\\{{0,3}}'[^'{BLANKS}]{{12,}}+|[^"'`,;&|<>(){{}}\[\]\\\u00ab\u00bb\u2018-\u201f{BLANKS}]{{12,}}+)"""

#: The characters of an IBAN by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """As long as its country has it, with single blanks anywhere; of other countries, groups of four and a rest."""
    listed = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, names in IBANS.items())
    names = "|".join(" ".join(IBANS.values()).split())
    return rf"\b(?:{listed}|(?!{names})[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)\b"


#: The numbers that card issuers give, by their first digits and length.
ISSUED = (
    "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(?:30[0-5][0-9]|3095|36[0-9]{2}|3[89][0-9]{2})[0-9]{10,15}"
    "|(?:6011|64[4-9][0-9]|65[0-9]{2}|62[0-9]{2}|81[0-9]{2}|220[0-4]|352[89]|35[3-8][0-9])[0-9]{12,15}|(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15})$"
)
#: How often the text beside failed numbers is looked through again.
AGAIN = 3
#: The formats, in order of preference where two could start at one place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": SECRET_NAME + SECRET_VALUE,
    "iban": _iban(),
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date_ymd": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date_dmy": r"(?<![0-9./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])",
    "date_mdy": r"(?<![0-9./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:(?<![0-9+])\+?[0-9]{0,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -]?[0-9]){9,15})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; a lambda works out anew, at each step, what it reads from outside."""
    return F.transform(F.array(value), body)[0]


def _noise(key: str, tweak: Column | str, turn: Column, half: Column) -> Column:
    """60 bits from key, format, round and the half that stays."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds(start: Column, turn: Callable, finish: Callable) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, finish)


def feistel(value: Column, left: Column, right: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of the integers below left * right (each at most 10^10): halves are shifted in turn within their moduli."""

    def turn(state: Column, i: Column) -> Column:
        one, two = state["l"], state["r"]
        even = i % 2 == 0
        shifted = F.when(even, (one + _noise(key, tweak, i, two) % left) % left).otherwise((two + _noise(key, tweak, i, one) % right) % right)
        return let(shifted, lambda s: F.struct(F.when(even, s).otherwise(one).alias("l"), F.when(even, two).otherwise(s).alias("r")))

    whole = lambda v: _rounds(F.struct(F.floor(v / right).cast("long").alias("l"), (v % right).cast("long").alias("r")), turn, lambda s: s["l"] * right + s["r"])
    return let(value, whole)


def digits_permuted(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of one length, 2 to 36."""

    def whole(text: Column) -> Column:
        n = F.length(text)
        left = F.floor(n / 2).cast("int")
        own = F.concat_ws(":", F.lit(tweak), n.cast("string"))

        def turn(state: Column, i: Column) -> Column:
            one, two = state["l"], state["r"]
            even = i % 2 == 0
            half, stays = F.when(even, one).otherwise(two), F.when(even, two).otherwise(one)
            ten = F.pow(F.lit(10), F.length(half)).cast("decimal(38,0)")
            shifted = F.lpad(((half.cast("decimal(20,0)") + _noise(key, own, i, stays)) % ten).cast("decimal(20,0)").cast("string"), F.length(half), F.lit("0"))
            return let(shifted, lambda s: F.struct(F.when(even, s).otherwise(one).alias("l"), F.when(even, two).otherwise(s).alias("r")))

        return _rounds(F.struct(F.substr(text, F.lit(1), left).alias("l"), F.substr(text, left + 1, n - left).alias("r")), turn, lambda s: F.concat(s["l"], s["r"]))

    return let(digits, whole)


def letters_permuted(text: Column, key: str, tweak: str, hexed: bool = False) -> Column:
    """A keyed permutation of the strings of one shape: digits, lower and upper case stay such, other characters stay.

    hexed: a string of hexadecimal digits stays one.
    """

    def whole(known: Column) -> Column:
        value, hexadecimal = known["text"], known["hexadecimal"]
        n = F.length(value)
        left = F.floor(n / 2).cast("int")
        own = F.concat_ws(":", F.lit(tweak), n.cast("string"), hexadecimal.cast("string"))

        def moved(half: Column, other: Column, i: Column) -> Column:
            noise = F.sha2(F.concat_ws("|", F.lit(key), own, i.cast("string"), other), 512)

            def shifted(z: Column) -> Column:
                def one(c: Column, j: Column) -> Column:
                    shift = F.conv(F.substr(z, (j % 30) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(j / 30)

                    def within(alphabet: str) -> Column:
                        at = F.position(c, F.lit(alphabet)) - 1 + shift
                        return F.substr(F.lit(alphabet), (at % len(alphabet) + 1).cast("int"), F.lit(1))

                    return F.when(hexadecimal, within(HEX)).when(c.rlike("^[0-9]$"), within(DIGITS)).when(c.rlike("^[a-z]$"), within(LOWER)).when(c.rlike("^[A-Z]$"), within(UPPER)).otherwise(c)

                return F.array_join(F.transform(F.split(half, ""), one), "")

            return let(noise, shifted)

        def turn(state: Column, i: Column) -> Column:
            one, two = state["l"], state["r"]
            even = i % 2 == 0
            return F.struct(F.when(even & (left > 0), moved(one, two, i)).otherwise(one).alias("l"), F.when(even, two).otherwise(moved(two, one, i)).alias("r"))

        return _rounds(F.struct(F.substr(value, F.lit(1), left).alias("l"), F.substr(value, left + 1, n - left).alias("r")), turn, lambda s: F.concat(s["l"], s["r"]))

    known = lambda t: F.struct(t.alias("text"), (F.lit(hexed) & t.rlike("^[0-9a-f]+$")).alias("hexadecimal"))
    return let(let(text, known), whole)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo ten: zero for a valid card."""

    def whole(text: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substr(text, F.length(text) - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), F.lit(0), add) % 10

    return let(digits, whole)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string whose letters count as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, rest * 10 + F.when(digit, c).otherwise("0").cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(text, "(?!^)(?!$)"), F.lit(0), add)


def refilled(shape: Column, characters: Column, kept: str) -> Column:
    """The shape with its characters of the class `kept` replaced by the given ones in order."""

    def whole(given: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            hit = c.rlike(f"^[{kept}]$")
            return F.struct(F.concat(state["out"], F.when(hit, F.substr(given, state["at"], F.lit(1))).otherwise(c)).alias("out"), (state["at"] + F.when(hit, 1).otherwise(0)).alias("at"))

        return F.aggregate(F.split(shape, "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])

    return let(characters, whole)


def _iso(value: Column, kind: Column) -> Column:
    """A date of one of the three layouts as year-month-day."""
    part = lambda a, n: F.substring(value, a, n)
    dmy = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))
    # month first where it can be, else day first
    mdy = F.when(part(1, 2) <= "12", F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))).otherwise(dmy)
    return F.when(kind == "date_ymd", value).when(kind == "date_dmy", dmy).otherwise(mdy)


def _day(value: Column, kind: Column) -> Column:
    """Days from FIRST_DAY, null for what is no date."""
    return F.datediff(F.try_to_date(_iso(value, kind), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def issued(digits: Column) -> Column:
    """True for the digits of a card: an issuer's number that passes Luhn."""
    return F.when(digits.rlike(ISSUED), luhn(digits) == 0).otherwise(False)


def valid_part(value: Column) -> Column:
    """The longest start of a match, up to a blank or dash, that is a valid card; else the match."""
    end = lambda n: F.regexp_extract(value, rf"^((?:[0-9][ -]?){{{n - 1}}}[0-9])(?![0-9])", 1)
    starts = F.filter(F.array(*(end(n) for n in range(19, 12, -1))), lambda x: let(F.regexp_replace(x, "[^0-9]", ""), issued))
    return F.when(value.rlike(f"^(?:{FORMATS['card']})$"), F.coalesce(F.get(starts, F.lit(0)), value)).otherwise(value)


def kind_of(value: Column) -> Column:
    """The name of the format that a match has, null if it doesn't validate."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    joined = F.regexp_replace(value, "[^A-Z0-9]", "")
    shape = F.coalesce(*(F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in FORMATS.items()))
    date = shape.startswith("date")
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    valid = (
        F.when(shape == "card", issued(digits))
        .when(shape == "iban", F.length(joined).between(15, 34) & (mod97(F.concat(F.substr(joined, F.lit(5)), F.substring(joined, 1, 4))) == 1))
        .when(shape == "ip", octets)
        .when(date, _day(value, shape).between(0, DAYS[0] * DAYS[1] - 1))
        .when(shape == "ssn", ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"))
        .when(shape == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )
    return F.when(valid, shape)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value permuted within its format."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    mail = F.split(value, "@")
    # the case of letters doesn't tell addresses apart, so it stays
    cased = lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b)
    local = F.array_join(F.zip_with(F.split(mail[0], ""), F.split(letters_permuted(F.lower(mail[0]), key, "email"), ""), cased), "")
    email = F.concat(local, F.lit("@"), mail[1])
    access = F.concat(F.lit("AKIA"), letters_permuted(F.substr(value, F.lit(5)), key, "access"))
    before = F.regexp_extract(value, rf"""^({SECRET_NAME}(?:\\{{0,3}}["'])?)""", 1)
    after = F.regexp_extract(value, "([^0-9A-Za-z]*+)$", 1)  # such as the end of a sentence
    secret = F.concat(before, letters_permuted(F.substr(value, F.length(before) + 1, F.length(value) - F.length(before) - F.length(after)), key, "secret", hexed=True), after)
    # the issuer's digits stay, the check digit follows
    body = F.concat(F.substring(digits, 1, 4), digits_permuted(F.substr(digits, F.lit(5), n - 5), key, "card"))
    card = let(body, lambda b: refilled(value, F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")), "0-9"))
    joined = F.regexp_replace(value, "[^A-Z0-9]", "")
    account = letters_permuted(F.substr(joined, F.lit(5)), key, "iban")
    check = lambda a: F.lpad((98 - mod97(F.concat(a, F.substring(joined, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = let(account, lambda a: refilled(value, F.concat(F.substring(joined, 1, 2), check(a), a), "A-Z0-9"))
    octets = F.split(value, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    moved = feistel(number, F.lit(1 << 16).cast("long"), F.lit(1 << 16).cast("long"), key, "ip")
    ip = let(moved, lambda x: F.array_join(F.transform(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), lambda i: (F.floor(x / F.pow(F.lit(256), i)) % 256).cast("int").cast("string")), "."))
    day = feistel(_day(value, kind).cast("long"), F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, "date")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    swapped = F.substring(value, 1, 2) > "12"
    date = F.when(kind == "date_ymd", F.date_format(new, "yyyy-MM-dd")).when(kind == "date_dmy", F.date_format(new, "dd.MM.yyyy")).when(swapped, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    area = F.substring(digits, 1, 3).cast("long")
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1

    def social(i: Column) -> Column:
        a = F.floor(i / (99 * 9999)) + 1
        return F.concat_ws("-", F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"), F.lpad((F.floor(i / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((i % 9999 + 1).cast("string"), 4, "0"))

    ssn = let(feistel(index, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn"), social)
    lead = F.when(n > 10, n - 10).when(n == 10, 0).otherwise(2)
    phone = refilled(value, F.concat(F.substr(digits, F.lit(1), lead), digits_permuted(F.substr(digits, lead + 1, n - lead), key, "phone")), "0-9")
    return (
        F.when(kind == "email", email).when(kind == "access_key", access).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ip", ip)
        .when(kind.startswith("date"), date).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "card", card).otherwise(value)
    )


def _pieces(text: Column) -> Column:
    """The text in pieces (t, kind, again): finds and, with kind null, what is between them.

    Of a number that fails, all but its first group goes to the piece after it, which is to be looked through again, as
    what a valid number begins in may lie there; so does the rest of a match after a valid card.
    """

    def parted(m: Column) -> Column:
        def held(part: Column) -> Column:
            return let(F.struct(part.alias("t"), kind_of(part).alias("kind")), lambda x: F.struct(_first(x).alias("t"), x["kind"].alias("kind"), F.substr(m, F.length(_first(x)) + 1).alias("rest")))

        return let(valid_part(m), held)

    def _first(x: Column) -> Column:
        return F.when(x["kind"].isNull() & x["t"].rlike("^[A-Z0-9+(]"), F.regexp_extract(x["t"], "^(.[A-Za-z0-9]*+)", 1)).otherwise(x["t"])

    def joined(found: Column) -> Column:
        nothing = F.struct(F.lit("").alias("t"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("rest"))
        before = F.concat(F.array(nothing), found)
        gaps = F.zip_with(F.split(text, ANY, -1), before, lambda g, x: F.struct(F.concat(x["rest"], g).alias("t"), F.lit(None).cast("string").alias("kind"), (x["rest"] != "").alias("again")))
        finds = F.transform(found, lambda x: F.struct(x["t"].alias("t"), x["kind"].alias("kind"), F.lit(False).alias("again")))
        return F.flatten(F.zip_with(gaps, finds, lambda g, x: F.when(x.isNull(), F.array(g)).otherwise(F.array(g, x))))

    return let(F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), parted), joined)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_found, found (array of kind, pseudonym in text order), text: one row per input row.

    Matches that don't validate stay as they are and aren't counted. Null counts as empty; a very long text is one value of the JVM, as it came. The
    same key gives the same pseudonyms in every run; without it they can't be undone. A day has one pseudonym in all
    layouts; a date with slashes is read month first where it can be, so a day-first one may be taken for another day. Repeated rows return repeated rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # a text with none of these has no match
    named = F.col("text").contains("=") | F.col("text").contains(":")
    hinted = F.col("text").rlike("[0-9@]") | F.col("text").contains("AKIA") | (named & F.col("text").rlike(FORMATS["secret"]))
    rows = rows.withColumn("pieces", F.when(hinted, _pieces(F.col("text"))))
    for _ in range(AGAIN):
        again = F.flatten(F.transform("pieces", lambda p: F.when(p["again"], let(p["t"], _pieces)).otherwise(F.array(p))))
        rows = rows.withColumn("pieces", F.when(F.exists("pieces", lambda p: p["again"]), again).otherwise(F.col("pieces")))
    rows = rows.withColumn("pieces", F.transform("pieces", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["t"]).otherwise(pseudonym(x["t"], x["kind"], key)).alias("pseudonym"))))
    new = F.array_join(F.transform("pieces", lambda x: x["pseudonym"]), "")
    found = F.coalesce(F.filter("pieces", lambda x: x["kind"].isNotNull()), F.expr("CAST(array() AS array<struct<kind: string, pseudonym: string>>)"))
    return rows.select("doc_id", F.size(found).cast("long").alias("n_found"), found.alias("found"), F.when(F.col("pieces").isNull(), F.col("text")).otherwise(new).alias("text"))
