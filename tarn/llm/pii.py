"""PII pseudonyms by format-preserving Feistel permutation: DataFrame operations only.

Candidates are found by one expression and validated: card numbers by the Luhn sum, IPv4 octets,
telephone numbers by their shape, social security numbers by their numbering rules, dates by the calendar. A valid value is
permuted within its own format by a keyed Feistel network over its positions; each position keeps
its radix (a digit stays a digit, a letter a letter, an octet an octet, a day a day), separators stay, and a card's
check digit is computed anew. Days before 1900-01-01, the 65,536 from then on, and later ones are permuted each among
themselves. The permutation depends on the key and the kind only, so
equal values get equal pseudonyms in all documents, whatever separators are used, and different
ones never meet.

Edge cases: a null text stays null and an empty one empty; invalid candidates stay as they are; the
calendar is the proleptic Gregorian one from year 0001 on, so a date of year 0000 is invalid;
repeated rows each get their row; an empty table gives no rows; texts and local parts of any length are taken
whole. Extra columns are kept, whatever they are called, but for one named like the column of kinds, which replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What a candidate of each kind looks like. One match is one candidate, the first kind that fits.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*\.?"
DATE_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DATE_SLASH = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
#: Days from 1900-01-01 on, each range permuted within itself: its first day and two radices whose product is its days.
#: Together every day from 0001-01-01 to 9999-12-31.
DAYS = ((-693595, 745, 931), (0, 256, 256), (65536, 1552, 1864))
KINDS = (("email", EMAIL), ("date", DATE_ISO), ("date", DATE_SLASH), ("ipv4", IPV4), ("ssn", SSN), ("phone", PHONE), ("card", CARD))
ANY = "|".join(p for _, p in KINDS)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, tweak: Column, key: str) -> Column:
    """Permute an array of ints, each below its radix: ROUNDS rounds, each adds a keyed hash of one half to the other."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def one(acc: Column, i: Column) -> Column:
        low = (i % 2) == 0  # this round changes the first half
        other = F.when(low, F.slice(acc, half + 1, n - half)).otherwise(F.slice(acc, 1, half))
        noise = F.sha2(F.concat_ws(",", F.lit(key), tweak, i.cast("string"), n.cast("string"), F.transform(other, lambda x: x.cast("string"))).cast("binary"), 512)

        def moved(noise: Column) -> Column:
            def at(x: Column, k: Column) -> Column:
                place = F.when(low, k).otherwise(k - half)
                word = F.conv(F.substring(noise, (place % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when((k < half) == low, (x + word + F.floor(place / 32).cast("int")) % F.get(radices, k)).otherwise(x).cast("int")

            return F.transform(acc, at)

        return let(noise, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _digits(c: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(c, "[^0-9]", "")), lambda x: x.cast("int"))


def _text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of `digits`, a string of as many."""
    step = F.aggregate(
        _chars(shape),
        F.struct(F.lit("").alias("out"), digits.alias("left")),
        lambda a, x: F.when(x.between("0", "9"), F.struct(F.concat(a["out"], F.substring(a["left"], 1, 1)).alias("out"), F.substring(a["left"], 2, 1 << 20).alias("left"))).otherwise(
            F.struct(F.concat(a["out"], x).alias("out"), a["left"].alias("left"))
        ),
    )
    return step["out"]


def luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last being the check digit."""

    def weighed(x: Column, i: Column) -> Column:
        twice = x * 2
        return F.when((F.size(digits) - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, x: (a + x).cast("int"))


# Reading: each kind's values, their radices, and a number that stays as it is (`fixed`). Null where a candidate isn't valid.


def _read(kind: str, ok: Column, values: Column, radices: Column, fixed: Column | None = None) -> Column:
    kept = F.struct(F.lit(kind).alias("kind"), values.cast("array<int>").alias("v"), radices.cast("array<int>").alias("r"), (F.lit(0) if fixed is None else fixed).cast("int").alias("fixed"))
    return F.when(ok, kept)


def read_card(c: Column) -> Column:
    """All digits but the first, which names the scheme, and the check digit."""
    return let(_digits(c), lambda d: _read("card", luhn(d) % 10 == 0, F.slice(d, 2, F.size(d) - 2), F.transform(F.slice(d, 2, F.size(d) - 2), lambda _: F.lit(10)), F.get(d, F.lit(0))))


def read_ipv4(c: Column) -> Column:
    parts = F.split(c, "\\.")
    octets = F.transform(parts, lambda x: x.cast("int"))
    return _read("ipv4", F.forall(octets, lambda x: x <= 255) & ~F.exists(parts, lambda x: (F.length(x) > 1) & x.startswith("0")), octets, F.array(*[F.lit(256)] * 4))


def read_ssn(c: Column) -> Column:
    def of(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return _read("ssn", ok, F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)))

    return let(F.transform(F.split(c, "-"), lambda x: x.cast("int")), of)


def read_phone(c: Column) -> Column:
    """The last ten digits; a country code stays. Area codes not in use are taken too: they are written as numbers of people."""
    return _read("phone", F.lit(True), _digits(F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))), F.array(*[F.lit(10)] * 10))


def _read_day(day: Column, kind_fixed: Column) -> Column:
    """A day of the years 1 to 9999, by its place in its range of DAYS."""

    def of(at: Column) -> Column:
        p = F.lit(None)
        for first, a, b in DAYS:
            within = at - first
            p = F.when(within.between(0, a * b - 1), _read("date", F.lit(True), F.array(F.floor(within / b), within % b), F.array(F.lit(a), F.lit(b)), kind_fixed)).otherwise(p)
        return p

    return let(F.unix_date(day) + 25567, of)


def read_date_iso(c: Column) -> Column:
    return _read_day(F.try_to_date(c, "yyyy-MM-dd"), F.lit(0))


def read_date_slash(c: Column) -> Column:
    """Day first (fixed: 2) if the first number is above 12, month first (1) otherwise."""

    def of(p: Column) -> Column:
        first, second = F.lpad(F.get(p, F.lit(0)), 2, "0"), F.lpad(F.get(p, F.lit(1)), 2, "0")
        by_day = F.get(p, F.lit(0)).cast("int") > 12
        text = F.concat_ws("-", F.get(p, F.lit(2)), F.when(by_day, second).otherwise(first), F.when(by_day, first).otherwise(second))
        return _read_day(F.try_to_date(text, "yyyy-MM-dd"), F.when(by_day, 2).otherwise(1))

    return let(F.split(c, "/"), of)


def read_email(c: Column) -> Column:
    """Letters and digits of the local part in small letters, each within its class; the domain stays."""
    domain = F.substring_index(c, "@", -1)

    def of(ch: Column) -> Column:
        ok = domain.rlike(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\.?$") & F.exists(ch, lambda x: x.rlike("[a-z0-9]"))
        value = F.transform(ch, lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).when(x.between("a", "z"), F.ascii(x) - 97).otherwise(0))
        return _read("email", ok, value, F.transform(ch, lambda x: F.when(x.between("0", "9"), 10).when(x.between("a", "z"), 26).otherwise(1)))

    return let(_chars(F.lower(F.substring_index(c, "@", 1))), of)


READERS = (read_email, read_date_iso, read_date_slash, read_ipv4, read_ssn, read_phone, read_card)


def read(c: Column) -> Column:
    """struct<c, p>: a candidate and what its kind reads in it, null if it isn't valid. A candidate stands alone here, so what looks around it holds at its ends."""
    p = F.lit(None)
    for (_, pattern), reader in reversed(list(zip(KINDS, READERS, strict=True))):
        p = F.when(c.rlike(f"^(?:{pattern})$"), reader(c)).otherwise(p)
    return F.struct(c.alias("c"), p.alias("p"))


def written(x: Column, q: Column) -> Column:
    """The pseudonym of x, struct<c, p>, from its permuted values q."""
    c, p = x["c"], x["p"]
    kind, fixed = p["kind"], p["fixed"]
    first = F.lit(None).cast("int")
    for start, a, _ in DAYS:
        first = F.when(F.get(p["r"], F.lit(0)) == a, start).otherwise(first)
    day = F.date_from_unix_date((F.get(q, F.lit(0)) * F.get(p["r"], F.lit(1)) + F.get(q, F.lit(1)) + first - 25567).cast("int"))
    date = let(day, lambda d: F.when(fixed == 0, F.date_format(d, "yyyy-MM-dd")).when((fixed == 2) & (F.dayofmonth(d) > 12), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    area = F.get(q, F.lit(0)) + 1
    ssn = F.concat_ws("-", F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.get(q, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(q, F.lit(2)) + 1).cast("string"), 4, "0"))
    every = F.regexp_replace(c, "[^0-9]", "")
    front = F.concat(F.array(fixed), q)
    digits = F.when(kind == "phone", F.concat(F.substring(every, F.lit(1), F.length(every) - 10), _text(q))).otherwise(
        let(front, lambda f: F.concat(_text(f), ((10 - luhn(F.concat(f, F.array(F.lit(0)))) % 10) % 10).cast("string")))
    )
    local = F.transform(F.arrays_zip(_chars(F.lower(F.substring_index(c, "@", 1))).alias("c"), q.alias("q")), lambda z: F.when(z["c"].between("0", "9"), z["q"].cast("string")).when(z["c"].between("a", "z"), F.char(z["q"] + 97)).otherwise(z["c"]))
    email = F.concat(F.array_join(local, ""), F.lit("@"), F.substring_index(c, "@", -1))
    shown = F.when(kind.isNull(), c).when(kind == "email", email).when(kind == "date", date).when(kind == "ipv4", F.array_join(F.transform(q, lambda v: v.cast("string")), "."))
    return F.struct(kind.alias("kind"), shown.when(kind == "ssn", ssn).otherwise(_refill(c, digits)).alias("text"))


def replacement(c: Column, key: str) -> Column:
    """struct<kind, text>: the pseudonym of a candidate; kind is null where it isn't valid."""
    return let(read(c), lambda x: let(F.when(x["p"].isNotNull(), feistel(x["p"]["v"], x["p"]["r"], x["p"]["kind"], key)), lambda q: written(x, q)))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: str | None = "pii") -> DataFrame:
    """docs with `text` pseudonymised and, if it has a name, a column array<string> of the kinds replaced in order.

    Who knows the key can undo the permutation: it belongs with the secrets of whoever runs this.
    """
    free = lambda name: name if name not in docs.columns else free(name + "_")
    at, new = free("_found"), free("_new")
    t = F.col(text)
    some = t.rlike("[0-9@]")
    found = docs.withColumn(at, F.when(some, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    with_any = F.size(at) > 0
    found = found.withColumn(new, F.when(with_any, F.transform(at, lambda c: replacement(c, key))))
    between = F.split(t, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("a"), F.transform(new, lambda x: x["text"]).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    replaced = F.coalesce(F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return found.withColumns({text: F.when(with_any, joined).otherwise(t)} | ({kinds: replaced} if kinds else {})).drop(at, new)


def digest(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (pseudonymised), n_pii and a count for each kind, of every document."""
    out = pseudonymize(docs.select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *(count(k) for k in dict.fromkeys(k for k, _ in KINDS)))
