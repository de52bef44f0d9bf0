"""Format-preserving pseudonyms for personal data, in DataFrame operations alone.

Candidates are found by one pattern over the whole text, cut into the values that
stand side by side in them, validated by kind, and replaced by a keyed Feistel permutation of their own format: digits stay digits
in the same places, a card number passes the Luhn check again, an address is a
valid address, a date is a date. The same value gives the same pseudonym in every
document, written in any accepted way, so records stay linked; without the key
it is not undone. A text is split at its candidates and put together again, so
all else stays byte for byte as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the date domain: 400 years from 1800-01-01, a whole Gregorian cycle, as 189 x 773.
_EPOCH, _DAYS = "1800-01-01", (189, 773)
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Fixed patterns of the kinds, in order of precedence.
# Repeated groups are possessive: Java then repeats them in a loop and not by a call for each turn.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?+(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?+)++"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|(?<!\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.[0-9])|(?:" + "|".join(_MONTHS) + r") [0-9]{1,2}, [0-9]{4})(?![0-9/-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])"
# Runs of values with spaces between them, as long as they go; ``_segments`` cuts them into single values.
IBANS = IBAN.replace("{2,7}", "{2,40}")
PHONES = r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:(?: (?![0-9]{1,2}/[0-9])|[.-])?[0-9]){5,80}(?![0-9A-Za-z])"
_WORD = r"(?![0-9]{1,2}/[0-9])[0-9]{2,}+(?:[.-][0-9]++)*+(?![0-9A-Za-z])"
NUMBERS = rf"(?<![0-9A-Za-z.+-])(?:\([0-9]{{2,4}}\)[ .-]?)?{_WORD}(?: {_WORD})*+(?: [0-9](?![0-9A-Za-z]|[./-][0-9]))?+"
#: National digits of country codes that have one length only.
_PLANS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "86": 11, "91": 10, "351": 9}
#: A country code before a separator, or of a plan whose national digits follow.
_CODE = r"^\+(?:[0-9]{1,3}(?=[ .(-])|" + "|".join(rf"{code}(?=(?:[ .()-]*+[0-9]){{{n}}}$)" for code, n in _PLANS.items()) + ")"
#: Shapes that show where a value ends, whatever number follows it, and shapes that only end before one of those.
_BOUND = "|".join(
    (
        *(rf"\+{code}[ .-]?(?:\(0\)[ .-]?)?(?:\([0-9]{{{k}}}\)(?:[ .-]?[0-9]){{{n - k}}})" for code, n in _PLANS.items() for k in (2, 3, 4)),
        *(rf"\+{code}[ .-]?(?:\(0\)[ .-]?)?[0-9](?:[ .-]?[0-9]){{{n - 1}}}" for code, n in _PLANS.items()),
        r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
        r"[A-Z]{2}[0-9]{2}[0-9A-Z ]{11,}|[0-9]{13,19}",
    )
)
_GROUPED_CARD = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
_LOOSE = r"(?:\+[0-9]|\()[0-9 ().-]+|" + CARD.split(")", 1)[1].rsplit("(?!", 1)[0]
#: Groups of a value, at most: those of an IBAN of 34 characters; a phone number has no more.
_GROUPS = 9
PATTERN = "|".join((EMAIL, SECRET, IPV4, DATE, IBANS, PHONES, NUMBERS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(key: str, tag: Column, turn: int, half: Column) -> Column:
    """A keyed 60-bit number from one half, its tag and the round."""
    text = F.concat_ws("|", F.lit(key), tag, F.lit(str(turn)), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: str, tag: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of pairs below (size_left, size_right): each round adds a keyed draw of one half to the other, modulo its size."""
    state = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    for turn in range(rounds):
        if turn % 2 == 0:
            state = _let(state, lambda s, t=turn: F.struct(F.pmod(s["a"] + F.pmod(_draw(key, tag, t, s["b"]), size_left), size_left).alias("a"), s["b"].alias("b")))
        else:
            state = _let(state, lambda s, t=turn: F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_draw(key, tag, t, s["a"]), size_right), size_right).alias("b")))
    return state


def permute_digits(digits: Column, key: str, tag: Column) -> Column:
    """Digits for digits: a permutation of all strings of the same length, up to 34; one digit is a keyed shift."""

    def run(d: Column) -> Column:
        n = F.length(d)
        cut = (n / 2).cast("int")
        left, right = F.substr(d, F.lit(1), cut), F.substr(d, cut + 1, n)
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        mixed = feistel(F.when(cut > 0, left).otherwise(F.lit("0")), right, power(cut), power(n - cut), key, F.concat_ws("/", tag, n.cast("string")))
        return _let(mixed, lambda s: F.concat(F.when(cut > 0, F.lpad(s["a"].cast("string"), cut, "0")).otherwise(F.lit("")), F.lpad(s["b"].cast("string"), n - cut, "0")))

    return _let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, every second digit from the right but one doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: _let(x.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("i"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["t"], F.substr(digits, a["i"] + 1, F.lit(1))).alias("t"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["t"])


def _card(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        return _let(body, lambda b: _refill(m, F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return _let(F.regexp_replace(m, "[^0-9]", ""), run)


def _phone(m: Column, key: str) -> Column:
    """The country code stays, set apart or known by its plan; the subscriber's digits are permuted."""
    lead = F.regexp_extract(m, _CODE, 0)
    rest = F.substr(m, F.length(lead) + 1, F.length(m))
    return F.concat(lead, _let(F.regexp_replace(rest, "[^0-9]", ""), lambda d: _refill(rest, permute_digits(d, key, F.lit("phone")))))


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    mixed = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"))
    byte = lambda x, high: (F.floor(x / 256) if high else x % 256).cast("string")
    return _let(mixed, lambda s: F.concat_ws(".", byte(s["a"], True), byte(s["a"], False), byte(s["b"], True), byte(s["b"], False)))


def _month_name(m: Column) -> Column:
    names = F.array(*[F.lit(x) for x in _MONTHS])
    return F.array_position(names, F.regexp_extract(m, "^[A-Z][a-z]+", 0))


def parsed_date(m: Column) -> Column:
    """The day of an ISO date, a month/day/year (day/month/year where only that is valid), a day.month.year or a ``Month D, YYYY``; else null."""
    iso = F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd"))
    slash = F.when(m.contains("/"), F.coalesce(F.try_to_date(m, "M/d/yyyy"), F.try_to_date(m, "d/M/yyyy")))
    dotted = F.when(m.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_date(m, "d.M.yyyy"))
    named = F.when(m.rlike("^[A-Z]"), F.try_to_date(m, "MMMM d, yyyy"))
    day = F.coalesce(iso, slash, dotted, named)
    return F.when((day >= F.lit(_EPOCH).cast("date")) & (F.datediff(day, F.lit(_EPOCH).cast("date")) < _DAYS[0] * _DAYS[1]), day)


def _date(m: Column, key: str) -> Column:
    first = F.lit(_EPOCH).cast("date")
    a, b = (F.lit(x).cast("long") for x in _DAYS)

    def run(day: Column) -> Column:
        at = F.datediff(day, first)
        mixed = feistel(F.floor(at / _DAYS[1]), at % _DAYS[1], a, b, key, F.lit("date"))

        def show(new: Column) -> Column:
            monthly = F.try_to_date(m, "M/d/yyyy").isNotNull()
            wide = m.rlike("^[0-9]{2}[/.][0-9]{2}[/.]")
            pad = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
            slash = F.when(monthly, F.concat_ws("/", pad(F.month(new)), pad(F.day(new)), F.year(new).cast("string"))).otherwise(F.concat_ws("/", pad(F.day(new)), pad(F.month(new)), F.year(new).cast("string")))
            dotted = F.concat_ws(".", pad(F.day(new)), pad(F.month(new)), F.year(new).cast("string"))
            return F.when(m.contains("/"), slash).when(m.contains("."), dotted).when(m.rlike("^[0-9]"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "MMMM d, yyyy"))

        return _let(mixed, lambda s: _let(F.date_add(first, (s["a"] * _DAYS[1] + s["b"]).cast("int")), show))

    return _let(parsed_date(m), run)


def _letters(m: Column, key: str, tag: str, alphabet: str) -> Column:
    """Each character of the alphabet is shifted within it by a keyed stream over the value's other half, in Feistel rounds."""
    size = len(alphabet)

    def shift(text: Column, by: Column, turn: int) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), F.lit(str(turn)), by), 512)
        move = lambda c, i: _let(F.instr(F.lit(alphabet), c), lambda p: F.when(p == 0, c).otherwise(F.substr(F.lit(alphabet), F.pmod(p - 1 + F.conv(F.substr(stream, (i * 2) % 124 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(size)) + 1, F.lit(1))))
        return F.array_join(F.transform(F.split(text, ""), move), "")

    cut = F.greatest((F.length(m) / 2).cast("int"), F.lit(1))
    state = F.struct(F.substr(m, F.lit(1), cut).alias("a"), F.substr(m, cut + 1, F.length(m)).alias("b"))
    for turn in range(4):
        if turn % 2 == 0:
            state = _let(state, lambda s, t=turn: F.struct(shift(s["a"], s["b"], t).alias("a"), s["b"].alias("b")))
        else:
            state = _let(state, lambda s, t=turn: F.struct(s["a"].alias("a"), shift(s["b"], s["a"], t).alias("b")))
    return _let(state, lambda s: F.concat(s["a"], s["b"]))


_LOWER = "abcdefghijklmnopqrstuvwxyz0123456789"


def _email(m: Column, key: str) -> Column:
    """Local part and host keep their lengths and punctuation; the top-level domain stays. Case is ignored, so results are lower-case."""
    low = F.lower(m)
    top = F.regexp_extract(low, r"\.[a-z0-9-]+$", 0)
    return F.concat(_letters(F.substr(low, F.lit(1), F.length(low) - F.length(top)), key, "email", _LOWER), top)


def _iban(m: Column, key: str) -> Column:
    """The country stays; digits and letters behind the check digits are permuted, check digits computed anew."""

    def run(c: Column) -> Column:
        body = _letters(_letters(F.substr(c, F.lit(5), F.length(c)), key, "iban-digits", "0123456789"), key, "iban-letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return _let(body, lambda b: _respace(m, F.concat(F.substr(c, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(F.concat(b, F.substr(c, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), b)))

    return _let(F.replace(m, F.lit(" "), F.lit("")), run)


def _respace(shape: Column, text: Column) -> Column:
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("i"))
    step = lambda a, c: F.when(c == " ", F.struct(F.concat(a["t"], c).alias("t"), a["i"].alias("i"))).otherwise(F.struct(F.concat(a["t"], F.substr(text, a["i"] + 1, F.lit(1))).alias("t"), (a["i"] + 1).alias("i")))
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["t"])


def _mod97(text: Column) -> Column:
    """Remainder by 97 with letters as 10 to 35."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def kind_of(m: Column) -> Column:
    """The kind of a whole match, or null if it validates as none."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    whole = lambda p: m.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    plain = F.replace(m, F.lit(" "), F.lit(""))
    iban = whole(IBAN) & (F.length(plain).between(15, 34)) & (_mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    card = m.rlike(r"^[0-9](?:[ -]?[0-9])*+$") & F.length(digits).between(13, 19)
    phone = m.rlike(r"^(?:\+[0-9]|\()") & F.length(digits).between(8, 15) | m.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")
    ssn = m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.when(m.contains("@"), "email").when(whole(SECRET) & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "secret").when(whole(IPV4) & octets, "ip").when(parsed_date(m).isNotNull(), "date").when(iban, "iban").when(card & (luhn_sum(digits) % 10 == 0), "card").when(phone, "phone").when(ssn, "ssn").when(card, "account")


def _segments(m: Column) -> Column:
    """The values of a run, in order: texts between single spaces, and kinds (null if none).

    A value whose shape shows its end goes before one that could take in what
    follows; of several from one place the longest is taken. What is left between
    them is a number of its own if it validates as a whole.
    """
    segment = "struct<text:string,kind:string>"
    make = lambda text, kind: F.struct(text.cast("string").alias("text"), kind.cast("string").alias("kind"))
    joined = lambda words, i, n: F.array_join(F.slice(words, i + 1, n), " ")

    def window(text: Column, n: Column) -> Column:
        kind = F.when(text.rlike(f"^(?:{_BOUND}|{_GROUPED_CARD}|{_LOOSE})$"), kind_of(text))
        bound = text.rlike(f"^(?:{_BOUND})$") | (text.rlike(f"^(?:{_GROUPED_CARD})$") & (luhn_sum(F.regexp_replace(text, "[^0-9]", "")) % 10 == 0))
        return _let(kind, lambda k: F.struct(F.when(k.isNull(), 0).when(bound, 2).otherwise(1).alias("rank"), n.alias("n"), k.alias("kind")))

    def cut(words: Column) -> Column:
        size = F.size(words)
        windows = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(_GROUPS), size - i)), lambda n: window(joined(words, i, n), n)), lambda w: w["rank"] > 0))

        def choose(all_: Column) -> Column:
            free = lambda i, w: ~F.exists(F.slice(all_, i + 2, w["n"] - 1), lambda later: F.exists(later, lambda x: x["rank"] == 2))
            best = F.transform(all_, lambda own, i: F.struct(i.alias("i"), F.array_max(F.filter(own, lambda w: (w["rank"] == 2) | free(i, w))).alias("w")))
            start = F.struct(F.lit(0).alias("skip"), F.lit(None).cast("string").alias("rest"), F.array().cast(f"array<{segment}>").alias("out"))

            def flushed(a: Column) -> Column:
                return F.concat(a["out"], F.when(a["rest"].isNotNull(), F.array(make(a["rest"], F.lit("?")))).otherwise(F.array().cast(f"array<{segment}>")))

            def step(a: Column, c: Column) -> Column:
                word = F.get(words, c["i"])
                state = lambda skip, rest, out: F.struct(skip.cast("int").alias("skip"), rest.cast("string").alias("rest"), out.alias("out"))
                taken = state(c["w"]["n"] - 1, F.lit(None), F.concat(flushed(a), F.array(make(joined(words, c["i"], c["w"]["n"]), c["w"]["kind"]))))
                single = state(F.lit(0), F.lit(None), F.concat(flushed(a), F.array(make(word, F.lit(None)))))
                return F.when(a["skip"] > 0, state(a["skip"] - 1, a["rest"], a["out"])).when(c["w"].isNotNull(), taken).when(F.length(word) < 2, single).otherwise(state(F.lit(0), F.concat_ws(" ", a["rest"], word), a["out"]))

            return F.transform(F.aggregate(best, start, step, flushed), lambda s: make(s["text"], F.when(s["kind"] == "?", kind_of(s["text"])).otherwise(s["kind"])))

        return _let(windows, choose)

    spaced = m.contains(" ") & ~m.rlike("^[A-Z][a-z]")
    return F.when(spaced, _let(F.split(m, " "), cut)).otherwise(F.array(make(m, kind_of(m))))


def _cased(m: Column, made: Column) -> Column:
    """In capitals where the value has no small letter."""
    return F.when(m == F.upper(m), F.upper(made)).otherwise(made)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match of a kind."""
    plain_digits = _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _refill(m, permute_digits(d, key, kind)))
    made = F.when(kind == "email", _email(m, key)).when(kind == "secret", _cased(m, _letters(F.lower(m), key, "secret", "0123456789abcdef"))).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key))
    return made.when(kind == "iban", _iban(m, key)).when(kind == "card", _card(m, key)).when(kind == "phone", _phone(m, key)).when(kind.isNotNull(), plain_digits).otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace personal data in whole texts.

    Kinds: e-mail addresses, IPv4 addresses, dates from 1800 to 2199, IBANs, card
    numbers that pass the Luhn check, phone numbers with a country code or area
    code, social security numbers, other numbers of 13 to 19 digits (account), and
    hexadecimal keys of 32 to 64 digits (secret). Values with a space between them
    are told apart by their kinds' own groups of digits; a phone number of a country
    whose numbers differ in length may take in a short number behind it.

    Returns every input column, the text replaced, and ``pii`` (for each value
    replaced, in order: kind, and the pseudonym); an input column ``pii`` is
    replaced. Null texts stay null, with no values; an empty text and one
    without values stay as they are. Each row is treated on its own, repeated rows
    alike, so results hang on the key and the text only.
    """
    text = F.col(text_col).cast("string")
    hint = text.rlike(r"[0-9]{2}|[0-9]\.[0-9]|@|[0-9]/[0-9]|[0-9],? [0-9]|[0-9A-Fa-f]{32}")

    def one(m: Column) -> Column:
        return F.transform(_segments(m), lambda s: F.struct(s["kind"].alias("kind"), pseudonym(s["text"], s["kind"], key).alias("value")))

    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), one)
    pieces = F.split(text, PATTERN, -1)
    marked = docs.withColumn("_pii_all", F.when(hint, found)).withColumn("_pii_pieces", F.when(hint, pieces))
    joined = F.concat(F.array_join(F.zip_with("_pii_pieces", "_pii_all", lambda p, run: F.concat(p, F.coalesce(F.array_join(F.transform(run, lambda v: v["value"]), " "), F.lit("")))), ""))
    values = F.coalesce(F.filter(F.flatten("_pii_all"), lambda v: v["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>"))
    return marked.withColumn(text_col, F.when(F.size("_pii_all") > 0, joined).otherwise(text)).withColumn("pii", values).drop("_pii_all", "_pii_pieces")
