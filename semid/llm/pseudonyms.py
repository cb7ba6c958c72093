"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A validated value is read as a pair of numbers (high, low) below radices (A, B)
whose product is the number of values of its format; eight rounds of alternating
modular addition of a keyed hash permute these pairs. So a pseudonym has its
value's format and passes its checks, different values stay different, and equal
values stay equal in all documents. Letters of mail addresses are not numbers:
their local part becomes a keyed hash and the domain a reserved one.

These spellings are found; others stay in the text:

* mail addresses; IBANs, compact or in groups of four, whose check digits are right (in groups,
  a listed country's number ends after its length, whatever word follows);
* cards of 13 to 19 digits, with single spaces or hyphens, that pass Luhn's check;
* phones with + and a country code, compact or with separators, and ten digits as
  ``(743) 555-3824``, ``743-555-3824`` or ``743.555.3824``;
* social security numbers ``123-45-6789``; IPv4 addresses;
* dates of 1900 to 2099 as ``1999-12-31``, also before a time (``1999-12-31T10:00``), and
  day first as ``31/12/1999`` or ``31.12.1999``. ``12/31/1999``, which can't be read day first,
  is month first.

All values are found in the text as it came: a kind looks at what the kinds before it in
``KINDS`` left of it, never at their pseudonyms, and all values are replaced together at the
end. So an IBAN's groups are no card, and a phone's digits behind its + are none either.

All spellings of a value get one pseudonym. So a month-first date may become one that, taken
by itself, can be read either way. The key is read by a scalar subquery, so that
no plan, event log or explanation shows it.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

ROUNDS = 8
#: Proleptic days from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049


def _key(key: str | Column) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _prf(key: str | Column, tweak: str, round_no: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", _key(key), F.lit(tweak), round_no.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, a: Column, b: Column, key: str | Column, tweak: str) -> Column:
    """A keyed permutation of the pairs high < a, low < b, as a struct (hi, lo). ``a`` and ``b`` stay below 2**60."""

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        hi = F.when(even, F.pmod(acc["hi"] + _prf(key, tweak, r, acc["lo"]), a)).otherwise(acc["hi"])
        lo = F.when(even, acc["lo"]).otherwise(F.pmod(acc["lo"] + _prf(key, tweak, r, acc["hi"]), b))
        return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(high.cast("long").alias("hi"), low.cast("long").alias("lo")), step)


def permute_digits(digits: Column, key: str | Column, tweak: str) -> Column:
    """A string of 2 to 34 digits as another one of its length."""

    def run(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        tens = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
        pair = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"), tens(u), tens(v), key, tweak)
        return let(pair, lambda p: F.concat(F.lpad(p["hi"].cast("string"), u, F.lit("0")), F.lpad(p["lo"].cast("string"), v, F.lit("0"))))

    return let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum with the last digit as the check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""

    def run(d: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["out"], F.when(is_digit, F.substring(d, acc["i"], F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    return let(digits, run)


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return F.when(luhn_sum(only_digits(m)) % 10 == 0, fill(m, let(only_digits(m), new)))


def _phone(m: Column, key: Column) -> Column:
    """The country code stays; the digits behind it are permuted, as are all digits of a number without one."""
    head = F.regexp_extract(m, COUNTRY, 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, fill(rest, permute_digits(only_digits(rest), key, "phone")))


def _address(m: Column, key: Column) -> Column:
    """Four numbers of 0 to 255, as two pairs."""

    def run(o: Column) -> Column:
        n = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        pair = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "address")
        out = let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p["hi"] / 256), p["hi"] % 256, F.floor(p["lo"] / 256), p["lo"] % 256)]))
        return F.when(n[0].between(0, 255) & n[1].between(0, 255) & n[2].between(0, 255) & n[3].between(0, 255), out)

    return let(F.split(m, "[.]"), run)


def _social(m: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serial numbers 0001 to 9999."""

    def run(o: Column) -> Column:
        area, group, serial = (F.get(o, F.lit(i)).cast("long") for i in range(3))
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "social")

        def spell(p: Column) -> Column:
            i = F.floor(p["hi"] / 99)
            back = F.when(i >= 665, i + 2).otherwise(i + 1)
            return F.concat_ws("-", F.lpad(back.cast("string"), 3, "0"), F.lpad((p["hi"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["lo"] + 1).cast("string"), 4, "0"))

        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(pair, spell))

    return let(F.split(m, "-"), run)


def _date(m: Column, key: Column) -> Column:
    """Dates of 1900 to 2099 by their day's number: year first with hyphens, else day first, or month first where the second number is no month."""
    b = next(x for x in range(270, 1, -1) if DAYS % x == 0)
    sep = F.when(m.contains("-"), "-").otherwise(F.substring(m, 3, 1))
    month_first = (sep == "/") & (F.substring(m, 4, 2) > "12")

    def run(n: Column) -> Column:
        pair = feistel(F.floor(n / b), n % b, F.lit(DAYS // b), F.lit(b), key, "date")
        day = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["hi"] * b + p["lo"]).cast("int")))

        def spell(d: Column) -> Column:
            year, month, of_month = (F.date_format(d, x) for x in ("yyyy", "MM", "dd"))
            return F.when(sep == "-", F.concat_ws("-", year, month, of_month)).when(month_first, F.concat_ws("/", month, of_month, year)).otherwise(F.concat(of_month, sep, month, sep, year))

        return let(day, spell)

    day = F.when(sep == "-", F.try_to_date(m, "yyyy-MM-dd")).when(month_first, F.try_to_date(m, "MM/dd/yyyy")).otherwise(F.try_to_date(F.translate(m, ".", "/"), "dd/MM/yyyy"))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when(number.between(0, DAYS - 1), let(number, run))


def _iban(m: Column, key: Column) -> Column:
    """Country codes and letters stay; the digits of the account are permuted and the check digits worked out anew."""

    def mod97(x: Column) -> Column:
        codes = F.transform(F.split(x, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
        return F.aggregate(F.split(F.array_join(codes, ""), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * 10 + c.cast("int")) % 97))

    def run(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s) - 4)
        new = fill(account, permute_digits(only_digits(account), key, "iban"))

        def checked(acct: Column) -> Column:
            return F.concat(country, F.lpad((98 - mod97(F.concat(acct, country, F.lit("00")))).cast("string"), 2, "0"), acct)

        good = mod97(F.concat(account, country, F.substring(s, 3, 2))) == 1
        return F.when(good & F.length(only_digits(account)).between(2, 34), fill(m, only_digits(let(new, checked))))

    return let(F.replace(m, F.lit(" "), F.lit("")), run)


def _mail(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", _key(key), F.lit("mail"), F.lower(m)), 256), 1, 16), F.lit("@example.org"))


# Country calling codes, which are of one, two or three digits.
COUNTRY = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NATIONAL = "(?<![A-Za-z0-9+.-])(?:\\([0-9]{3}\\)[ -]?[0-9]{3}[ .-]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\\.[0-9]{3}\\.)[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])"
DAY, LATE_DAY, MONTH = "(?:0[1-9]|[12][0-9]|3[01])", "(?:1[3-9]|2[0-9]|3[01])", "(?:0[1-9]|1[0-2])"
# The lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped_iban() -> str:
    """IBANs in groups of four: of a listed country in as many groups as its length needs, of others in as many as there are."""
    rest = lambda n: f"(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    listed = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n)}" for n, names in IBAN_LENGTHS.items())
    return f"(?:{listed}|[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)"




@dataclass(frozen=True)
class Kind:
    """Values that match ``pattern`` and that ``permute`` gives a pseudonym (null: not valid). Every text with such a value matches ``hint``, which is quick to look for."""

    name: str
    pattern: str
    permute: Callable[[Column, str], Column]
    hint: str


#: In the order of their right to a stretch of text that several could claim.
KINDS = (
    Kind("mail", "(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", _mail, "@"),
    Kind("iban", f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_grouped_iban()})(?![A-Za-z0-9])", _iban, "[A-Z]{2}[0-9]{2}[A-Z0-9 ]"),
    Kind("phone", f"(?<![A-Za-z0-9])\\+(?:[0-9]{{1,3}}[ .-]?(?:\\([0-9]{{2,4}}\\)|[0-9]{{2,4}})(?:[ .-][0-9]{{2,5}}){{1,4}}|[1-9][0-9]{{7,14}})(?![A-Za-z0-9])|{NATIONAL}", _phone, "\\+[0-9]|\\([0-9]{3}\\)|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"),
    Kind("card", "(?<![A-Za-z0-9+.])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", _card, "[0-9](?:[ -]?[0-9]){12}"),
    Kind("social", "(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", _social, "[0-9]-[0-9]{2}-[0-9]{4}"),
    Kind("address", "(?<![A-Za-z0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\\.[0-9])", _address, "[0-9]\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]"),
    Kind("date", f"(?<![A-Za-z0-9-])(?:19|20)[0-9]{{2}}-{MONTH}-{DAY}(?![A-SU-Za-z0-9-]|T(?![0-9]{{2}}:))|(?<![A-Za-z0-9./-])(?:{DAY}/{MONTH}/|{MONTH}/{LATE_DAY}/|{DAY}\\.{MONTH}\\.)(?:19|20)[0-9]{{2}}(?![A-Za-z0-9/-]|\\.[0-9])", _date, "(?:19|20)[0-9]{2}-[01][0-9]-|[0-9][./][0-9]{2}[./](?:19|20)[0-9]"),
)
#: Stands for a found value while further kinds are looked for: no value holds it.
MARK = "\ue000"


def _marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))


def _found(text: Column, new: Column, kind: Kind, key: Column) -> Column:
    """The text with the kind's values marked, too, what all marks stand for, in order, and how many values the kind has."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("p"), matches.alias("m"))
    tried = F.transform(parts, lambda z, i: F.struct(i.alias("i"), z["p"].alias("p"), z["m"].alias("m"), F.when(z["m"].isNotNull(), kind.permute(z["m"], key)).alias("q"), _marks(z["p"]).alias("c")))

    def put(zs: Column) -> Column:
        marked = F.array_join(F.transform(zs, lambda z: F.concat(z["p"], F.when(z["q"].isNotNull(), MARK).otherwise(F.coalesce(z["m"], F.lit(""))))), "")
        own = F.filter(F.transform(zs, lambda z: z["q"]), lambda q: q.isNotNull())

        def merged(before: Column) -> Column:
            """Marks by their number, values by the number of marks before them."""
            old = F.transform(new, lambda v, j: F.struct(j.alias("a"), F.lit(1).alias("b"), F.lit(0).alias("i"), v.alias("v")))
            more = F.zip_with(zs, before, lambda z, at: F.struct((at + z["c"]).alias("a"), F.lit(0).alias("b"), z["i"].alias("i"), z["q"].alias("v")))
            return F.transform(F.sort_array(F.concat(old, F.filter(more, lambda x: x["v"].isNotNull()))), lambda x: x["v"])

        values = F.when(F.size(new) == 0, own).otherwise(let(running(F.transform(zs, lambda z: z["c"]), F.lit(0), lambda acc, c: acc + c), merged))
        return F.struct(marked.alias("text"), values.alias("new"), F.size(own).cast("long").alias("n"))

    return let(tried, put)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row its id, the ``carry`` columns, ``n_<kind>`` (values that passed their check and were permuted) and ``clean_text``.

    Values that fail their kind's check stay and do not count. Null texts stay null
    with no values; repeated rows get equal results; an empty table gives no rows;
    columns not named are ignored, whatever their names.
    """
    names = list(dict.fromkeys((id_col, *carry)))
    secret = docs.sparkSession.sql("SELECT * FROM VALUES (:k) AS t(k)", args={"k": key}).scalar()
    text, none = F.col(text_col), F.lit(0).cast("long")
    marks = F.when(F.contains(text, F.lit(MARK)), F.array_repeat(F.lit(MARK), _marks(text))).otherwise(F.array().cast("array<string>"))  # a text's own marks stand for themselves
    out = docs.select(F.struct(*[F.col(c).alias(c) for c in names]).alias("named"), F.struct(text.alias("text"), marks.alias("new"), none.alias("n")).alias("s"), secret.alias("key"), F.struct(none.alias("none")).alias("counts"))
    for kind in kinds:
        seen = F.col("s.text").rlike(kind.hint) & F.col("s.text").rlike(kind.pattern)
        out = out.withColumn("s", F.when(seen, _found(F.col("s.text"), F.col("s.new"), kind, F.col("key"))).otherwise(F.struct(F.col("s.text").alias("text"), F.col("s.new").alias("new"), none.alias("n"))))
        out = out.withColumn("counts", F.col("counts").withField(kind.name, F.col("s.n")))
    pieces = F.split("s.text", MARK, -1)
    clean = F.when(F.size("s.new") == 0, F.col("s.text")).otherwise(F.array_join(F.zip_with(pieces, "s.new", lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""))
    done = out.select("named", "counts", clean.alias("clean_text"))
    return done.select(*[F.col("named")[c].alias(c) for c in names], *[F.col("counts")[k.name].alias(f"n_{k.name}") for k in kinds], "clean_text")
