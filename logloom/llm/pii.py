"""Format-preserving pseudonyms for personal values (DataFrame functions only).

A value is found by its shape, validated, and then permuted within its format by a keyed Feistel network, so that
equal values get equal pseudonyms in all documents, without a table of values. ``restore`` undoes it with the key:

* card numbers (13 to 19 digits, plain or in the groups 4-4-4-4 and 4-6-5, that pass the Luhn check): all digits but
  the last are permuted, the last is the new check digit; a digit run that fails the check is no card and stays;
* dates (real days of 1900 to 2099, as Y-M-D, Y/M/D, D.M.Y, D/M/Y, or M/D/Y where D/M/Y is no date; also at the head of
  an ISO timestamp): the day is permuted among these 73,049 days, walking on until it can be written in the same style
  (without leading zeros, or month first);
* social security numbers (valid area, group and serial): permuted among the valid ones;
* IBANs (check 97, also in groups of four): the digits of the account part are permuted, the check digits computed anew;
* IPv4 addresses without leading zeros: permuted among all 2^32;
* phone numbers: all digits after the country code, or all ten of a national number ((ddd) ddd-dddd, ddd-ddd-dddd);
* e-mail addresses: letters (as lower case) and digits of the local part;
* secrets (32 or more hex digits, however long, in lower, upper or mixed case) and access keys (AKIA or ASIA and 16 more).

What fails validation (a 30 February, an address part of 300, a number without its check digit) stays as it is, as do
shapes not listed (IBANs with letters after the fifth group, dates that mix padded and unpadded parts in one value are
written padded). All other text stays as it is. ``restore`` gives the text back, but for the case of e-mail names and
for such mixed dates.

Draws are HMAC-SHA256. The key is no literal of the plan: its two padded blocks are the one row of a table that is
joined to the documents, so explained plans and event logs do not show it.

Edge cases: a null text stays null; an empty one stays empty; equal rows get equal results; rows without a ``doc_id``
are treated alike, as no id is read. Other columns of the input pass through unless they are named like an output
(``text``, ``n_pii``, ``kinds``), which replaces them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a walk. One step in two at least is a landing, so that a walk fails with a chance below 1e-12.
WALK = 64
DIGITS, HEX, BOTH, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz"

#: The shapes of the kinds, in the order in which they are tried.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"[0-9a-fA-F]{32,}",
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: [0-9]{4}){2,6}(?: [0-9]{1,3})?)",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ymd": r"[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}",
    "dmy": r"[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/)[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}",
    "national": r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}",
    "number": r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})",
}
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join(SHAPES.values()) + r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:))(?:(?![A-Za-z0-9])|(?=T[0-9]{2}:))"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Key:
    """The columns ``_inner`` and ``_outer``: HMAC's two padded blocks, in hex."""

    def __init__(self, inner: Column | None = None, outer: Column | None = None):
        self.inner, self.outer = F.col("_inner") if inner is None else inner, F.col("_outer") if outer is None else outer

    @staticmethod
    def row(key: str) -> tuple[str, str]:
        block = key.encode()
        block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
        return bytes(x ^ 0x36 for x in block).hex(), bytes(x ^ 0x5C for x in block).hex()

    def draw(self, tweak: str, round_: Column, half: Column, part: Column | None = None) -> Column:
        """64 hex digits that depend on the key, the kind, the round, the other half and the part."""
        message = F.concat_ws("|", F.lit(tweak), round_.cast("string"), half.cast("string"), (F.lit(0) if part is None else part).cast("string"))
        inner = F.sha2(F.concat(F.unhex(self.inner), F.encode(message, "UTF-8")), 256)
        return F.sha2(F.concat(F.unhex(self.outer), F.unhex(inner)), 256)


def feistel_text(value: Column, alphabet: str, key: Key, tweak: str, inverse: bool = False) -> Column:
    """Permutes strings over an alphabet among those of the same length (one symbol: among the symbols).

    Each round adds, symbol by symbol, draws of the right half to the left one, and swaps them; ``inverse`` undoes it.
    """
    r = len(alphabet)
    n = F.length(value)
    half = (n / 2).cast("int")

    def add(left: Column, round_: Column, right: Column) -> Column:
        blocks = F.array_join(F.transform(F.sequence(F.lit(0), ((F.length(left) - 1) / 16).cast("int")), lambda b: key.draw(tweak, round_, right, b)), "")

        def symbol(i: Column, hash_: Column) -> Column:
            more = F.conv(F.substring(hash_, i * 4 - 3, F.lit(4)), 16, 10).cast("int")
            own = place(alphabet, left, i)
            return F.substring(F.lit(alphabet), F.pmod(own - more if inverse else own + more, F.lit(r)) + 1, F.lit(1))
        return let(blocks, lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(left)), lambda i: symbol(i, h)), ""))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, n).alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    if inverse:
        end = F.aggregate(rounds, start, lambda a, i: F.struct(add(a["r"], i, a["l"]).alias("l"), a["l"].alias("r")))
    else:
        end = F.aggregate(rounds, start, lambda a, i: F.struct(a["r"].alias("l"), add(a["l"], i, a["r"]).alias("r")))
    wide = next(a for a in range(int(r ** 0.5), 0, -1) if r % a == 0)
    one = let(feistel_number(place(alphabet, value, F.lit(1)), wide, r // wide, key, tweak, inverse), lambda v: F.substring(F.lit(alphabet), v.cast("int") + 1, F.lit(1)))
    return F.when(n > 1, let(end, lambda e: F.concat(e["l"], e["r"]))).when(n == 1, one).otherwise(value)


def feistel_number(value: Column, a: int, b: int, key: Key, tweak: str, inverse: bool = False) -> Column:
    """Permutes the numbers below a * b; ``a`` and ``b`` below 2^31."""
    def more(i: Column, half: Column, n: int) -> Column:
        return F.pmod(F.conv(F.substring(key.draw(tweak, i, half), 1, 13), 16, 10).cast("long"), F.lit(n)) * (-1 if inverse else 1)

    v = value.cast("long")
    start = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + more(i, s["r"], a), F.lit(a))).otherwise(s["l"]).cast("long").alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + more(i, s["l"], b), F.lit(b))).cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return let(F.aggregate(rounds, start, step), lambda e: e["l"] * F.lit(b) + e["r"])


def walk(value: Column, step, inside) -> Column:
    """The first of step(value), step(step(value)) and so on that is ``inside``: a permutation of what is inside."""
    start = F.struct(step(value).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda a, _: F.when(inside(a["v"]), a).otherwise(F.struct(step(a["v"]).alias("v"))))["v"]


def refill(shape: Column, symbols: Column, pattern: str) -> Column:
    """``shape`` with its characters that match the pattern replaced, in order, by the symbols."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.split(shape, "(?!^)(?!$)"), start, lambda a, c: F.when(
        c.rlike(pattern), F.struct(F.concat(a["out"], F.substring(symbols, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))), lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum in which the last digit counts once, the one before doubled, and so on."""
    def each(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), each), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Rest of an IBAN's characters as a number (A is 10)."""
    def step(a: Column, c: Column) -> Column:
        v = place(ALNUM, F.lower(c), F.lit(1))
        return F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")
    return F.aggregate(F.split(text, "(?!^)(?!$)"), F.lit(0), step)


def place(alphabet: str, text: Column, i: Column) -> Column:
    """Place, from 0, of the i-th character in the alphabet."""
    return F.instr(F.lit(alphabet), F.substring(text, i, F.lit(1))) - 1


def pseudonym(m: Column, key: Key, inverse: bool = False) -> Column:
    """(kind, value) of a found value; kind null and the value unchanged if it isn't valid. ``inverse`` undoes it."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    is_ = {kind: m.rlike(f"^(?:{shape})$") for kind, shape in SHAPES.items()}
    out = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    keep = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    text = lambda v, alphabet, tweak: feistel_text(v, alphabet, key, tweak, inverse)
    number = lambda v, a, b, tweak: feistel_number(v, a, b, key, tweak, inverse)

    local = F.lower(F.substring_index(m, "@", 1))
    email = F.concat(refill(local, text(F.regexp_replace(local, "[^a-z0-9]", ""), ALNUM, "email"), "[a-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))
    lower, upper = m.rlike("[a-f]"), m.rlike("[A-F]")
    secret = F.when(lower & upper, walk(m, lambda v: text(v, BOTH, "mixed"), lambda v: v.rlike("[a-f]") & v.rlike("[A-F]"))).when(
        upper, walk(m, lambda v: F.upper(text(F.lower(v), HEX, "secret")), lambda v: v.rlike("[A-F]"))).otherwise(text(m, HEX, "secret"))
    access = F.concat(F.substring(m, 1, 4), F.upper(text(F.lower(F.substring(m, 5, 16)), ALNUM, "access_key")))

    compact = F.replace(m, F.lit(" "))
    account = F.substring(compact, F.lit(5), F.length(compact))
    own = F.regexp_replace(account, "[^0-9]", "")
    iban = let(refill(account, text(own, DIGITS, "iban"), "[0-9]"), lambda a: refill(m, F.concat(
        F.substring(m, 1, 2), F.lpad((F.lit(98) - mod97(F.concat(a, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0"), a), "[A-Z0-9]"))
    iban_ok = (mod97(F.concat(account, F.substring(m, 1, 4))) == 1) & (F.length(own) >= 2)

    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    ip_ok = F.forall(parts, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0[0-9]")
    address = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    ip = let(number(address, 65536, 65536, "ip"), lambda v: F.concat_ws(".", *(
        F.pmod(F.floor(v / F.lit(256 ** i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0))))

    zero = F.lit("1900-01-01").cast("date")
    day_of = lambda n: F.date_add(zero, n.cast("int"))

    def dated(day: Column, inside, write) -> Column:
        """``inside``: whether a day can be written in the value's style."""
        n = F.datediff(day, zero)
        new = walk(n, lambda v: number(v, 319, 229, "date").cast("int"), lambda v: inside(day_of(v)))
        return F.when((n >= 0) & (n < 73049), out("date", let(new, lambda v: write(day_of(v))))).otherwise(keep)

    sep = F.regexp_extract(m, "[./-]", 0)
    split = F.split(m, "[./]")
    first, second, year = (F.get(split, F.lit(i)) for i in range(3))
    as_date = lambda d, mo: F.try_to_date(F.concat_ws("-", year, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first = as_date(first, second)
    month_first = day_first.isNull() & (sep == "/")
    #: Written without leading zeros: a part of one digit shows it.
    short = ((F.length(first) == 1) | (F.length(second) == 1)) & ~first.startswith("0") & ~second.startswith("0")
    inside = lambda d: (~short | (F.dayofmonth(d) < 10) | (F.month(d) < 10)) & (~month_first | (F.dayofmonth(d) > 12))

    def write(d: Column) -> Column:
        dd, mm = (F.when(short, F.date_format(d, one)).otherwise(F.date_format(d, one * 2)) for one in ("d", "M"))
        return F.concat(F.when(month_first, mm).otherwise(dd), sep, F.when(month_first, dd).otherwise(mm), sep, F.date_format(d, "yyyy"))
    ymd_date = dated(F.try_to_date(F.translate(m, "/", "-"), "yyyy-MM-dd"), lambda d: F.lit(True), lambda d: F.concat(F.date_format(d, "yyyy"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "dd")))
    dmy_date = dated(F.when(month_first, as_date(second, first)).otherwise(day_first), inside, write)

    area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place_ = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    ssn = let(number(place_.cast("long") * 9999 + serial - 1, 898 * 99, 9999, "ssn"), lambda v: let(
        F.floor(v / F.lit(9999 * 99)).cast("int") + 1, lambda x: F.concat_ws(
            "-", F.lpad(F.when(x > 665, x + 1).otherwise(x).cast("string"), 3, "0"),
            F.lpad((F.pmod(F.floor(v / F.lit(9999)), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))))

    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    phone = F.concat(code, refill(rest, text(F.regexp_replace(rest, "[^0-9]", ""), DIGITS, "phone"), "[0-9]"))
    phone_ok = F.length(digits).between(8, 15)

    card = let(text(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, "card"), lambda d: refill(
        m, F.concat(d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")), "[0-9]"))
    card_ok = F.pmod(luhn_sum(digits), F.lit(10)) == 0
    return (
        F.when(is_["email"], out("email", email)).when(is_["secret"], out("secret", secret)).when(is_["access_key"], out("access_key", access))
        .when(is_["ip"], F.when(ip_ok, out("ip", ip)).otherwise(keep))
        .when(is_["ymd"], ymd_date).when(is_["dmy"], dmy_date)
        .when(is_["ssn"], F.when(ssn_ok, out("ssn", ssn)).otherwise(keep))
        .when(is_["phone"] | is_["national"], F.when(phone_ok, out("phone", phone)).otherwise(keep))
        .when(is_["number"], F.when(card_ok, out("card", card)).otherwise(keep))
        .when(is_["iban"], F.when(iban_ok, out("iban", iban)).otherwise(keep))
        .otherwise(keep))


def replaced(docs: DataFrame, key: str, inverse: bool) -> DataFrame:
    text = F.col("text").cast("string")
    likely = text.rlike("[0-9@]")
    secret = docs.sparkSession.createDataFrame([Key.row(key)], "_inner string, _outer string")
    keyed = docs.crossJoin(F.broadcast(secret))  # one row
    found = keyed.withColumn("n_pii", F.when(likely, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, Key(), inverse)))).drop("_inner", "_outer")
    gaps = F.split(text, ANY, -1)
    new = F.when(F.size("n_pii") > 0, F.array_join(F.transform(gaps, lambda g, i: F.concat(
        g, F.coalesce(F.get("n_pii", i)["value"], F.lit("")))), "")).otherwise(text)
    valid = F.filter("n_pii", lambda x: x["kind"].isNotNull())
    return found.withColumns({
        "text": new,
        "kinds": F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.transform(valid, lambda x: x["kind"]), F.array().cast("array<string>")))), ","),
        "n_pii": F.coalesce(F.size(valid), F.lit(0)).cast("long")})


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with ``text`` replaced, ``n_pii`` (values replaced) and ``kinds`` (their kinds, sorted, distinct)."""
    return replaced(docs, key, False)


def restore(docs: DataFrame, key: str) -> DataFrame:
    """What ``pseudonymise`` did with the same key undone; the same columns."""
    return replaced(docs, key, True)
