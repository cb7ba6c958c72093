"""Quality rules and pseudonyms: brute force, held-out accuracy, bijections."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import ODD  # noqa: F401
from pyspark.sql import functions as F

from semid.llm import pseudonyms as P
from semid.llm.quality_rules import FEATURES, Condition, DecisionList, fit, judge, learn


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_by_brute_force(spark, sf_dir, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += ODD + [(900, "a b c d e a b c d e"), (901, "a a a a a a"), (902, "x\nx\n \n \nx # $ | <>"), (903, "a b c d e f a b c d e g b c d e f")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(repr((r["doc_id"], *[r[c] for c in COLUMNS])) for r in judge(df, DecisionList()).collect())
    assert got == sorted(repr((i, *_base(t))) for i, t in docs)
    assert judge(none, DecisionList()).count() == 0 and judge(odd, DecisionList(), carry=("key",)).count() == len(ODD)


def test_learned_list_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = fit(docs, labels.where("doc_id % 2 = 0"))
    rows = judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert rules.rules and sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    assert sum(not r["kept"] for r in rows if r["quality"]) <= 0.01 * len(rows)


def test_learning_prunes_and_orders():
    row = lambda i, bad, **x: {f: 0.0 for f in FEATURES} | x | {"bad": bad, "held": i % 3 == 0}
    rows = [row(i, 1, symbol_ratio=0.5 + i / 1000) for i in range(30)] + [row(i, 0, symbol_ratio=i / 1000) for i in range(60)] + [row(i, 1, bang_ratio=0.9, symbol_ratio=0.01) for i in range(30)]
    rules = learn(rows)
    assert len(rules.rules) == 2 and all(rules.rejects(r) == bool(r["bad"]) for r in rows)
    assert learn([]).rules == learn([row(1, 0)]).rules == learn([row(i, 1) for i in range(9)]).rules == ()


def test_list_becomes_one_ordered_expression(spark):
    rules = DecisionList(((Condition("mean_word", True, 5.0), Condition("bar_ratio", False, 0.1)), (Condition("bang_ratio", True, 0.5),)))
    df = spark.createDataFrame([(6.0, 0.0, 0.0), (6.0, 0.2, 0.0), (1.0, 0.2, 0.6)], "mean_word double, bar_ratio double, bang_ratio double")
    assert [r[0] for r in df.select(rules.keeps()).collect()] == [False, True, False]


def test_feistel_is_a_bijection(spark):
    df = spark.range(73049).select(P.feistel(F.floor(F.col("id") / 17), F.col("id") % 17, F.lit(4297), F.lit(17), "k", "t").alias("p"))
    assert df.where("p.hi between 0 and 4296 and p.lo between 0 and 16").distinct().count() == 73049
    digits = spark.range(1000).select(P.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert digits.distinct().count() == 1000 and digits.where(F.length("d") != 3).count() == 0


def _luhn(d):
    x = [int(c) for c in d]
    return sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(reversed(x))) % 10 == 0


PRIVATE = [
    (1, "call +1 (743) 555-3824 or 4994226020900891 or 4994-2260-2090-0891, not 1234567890123456"), (2, "a.b@mail5.example.com 152.143.123.131, 300.1.1.1 and 123-45-6789, 666-12-3456, 1999-12-31 1999-02-30"),
    (3, None), (4, ""), (5, "GB82WEST12345698765432 GB83WEST12345698765432"), (6, "4994226020900891 and A.B@mail5.example.com"), (6, "4994226020900891 and A.B@mail5.example.com"), (7, "plain words, 12 and 2024"),
]


def test_pseudonyms_keep_formats_and_links(spark, none):
    df = spark.createDataFrame(PRIVATE, "doc_id bigint, text string").withColumn("id", F.lit(1))
    rows = [r.asDict() for r in P.pseudonymize(df, "secret").collect()]
    by = {r["doc_id"]: r for r in rows}
    a, b = by[1]["clean_text"], by[2]["clean_text"]
    m = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{16}) or (\d{4}-\d{4}-\d{4}-\d{4}), not 1234567890123456", a)
    assert m and m[1] != "+1 (743) 555-3824" and m[2] == m[3].replace("-", "") != "4994226020900891" and _luhn(m[2])
    assert m[2] in by[6]["clean_text"] and b.split(" ")[0] == by[6]["clean_text"].split(" ")[-1]
    m = re.fullmatch(r"\S+@example.org (\d+\.\d+\.\d+\.\d+), 300.1.1.1 and (\d{3}-\d{2}-\d{4}), 666-12-3456, (\d{4}-\d{2}-\d{2}) 1999-02-30", b)
    assert m and all(0 <= int(x) < 256 for x in m[1].split(".")) and m[3] != "1999-12-31"
    assert by[1]["n_card"] == 2 and by[2]["n_date"] == 1 and by[5]["n_iban"] == 1 and "GB83WEST12345698765432" in by[5]["clean_text"]
    assert by[3]["clean_text"] is None and by[4]["clean_text"] == "" and by[7]["clean_text"] == "plain words, 12 and 2024"
    assert P.pseudonymize(df, "other").where("doc_id = 1").first()["clean_text"] != a
    assert P.pseudonymize(none, "k").count() == 0


def test_no_planted_value_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.pseudonymize(docs, "k", carry=("text",)).collect()
    for r in out:
        for p in (r"[\w.]+@mail\d\.example\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}"):
            assert not set(re.findall(p, r["text"])) & set(re.findall(p, r["clean_text"]))


def _feistel(hi, lo, a, b, key, tweak):
    prf = lambda r, v: int(hashlib.sha256(f"{key}|{tweak}|{r}|{v}".encode()).hexdigest()[:15], 16)
    for r in range(8):
        hi, lo = ((hi + prf(r, lo)) % a, lo) if r % 2 == 0 else (hi, (lo + prf(r, hi)) % b)
    return hi, lo


def _digits(d, key, tweak):
    u = len(d) // 2
    hi, lo = _feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), key, tweak)
    return f"{hi:0{u}d}{lo:0{len(d) - u}d}"


def _refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c.isascii() and c.isdigit() else c for c in shape)


def _plain(m):
    return re.sub("[^0-9]", "", m)


def _new_card(m, key):
    d = _plain(m)
    if not _luhn(d):
        return None
    body = _digits(d[:-1], key, "card")
    return _refill(m, body + next(c for c in "0123456789" if _luhn(body + c)))


def _new_phone(m, key):
    two = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}
    n = 0 if m[0] != "+" else 2 if m[1] in "17" else 3 if int(m[1:3]) in two else 4
    return m[:n] + _refill(m[n:], _digits(_plain(m[n:]), key, "phone"))


def _new_address(m, key):
    n = [int(x) for x in m.split(".")]
    if max(n) > 255:
        return None
    return ".".join(str(x) for v in _feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "address") for x in divmod(v, 256))


def _new_social(m, key):
    area, group, serial = (int(x) for x in m.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return None
    hi, lo = _feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "social")
    return f"{areas[hi // 99]:03d}-{hi % 99 + 1:02d}-{lo + 1:04d}"


def _new_date(m, key):
    form = "%Y-%m-%d" if "-" in m else "%m/%d/%Y" if m[2] == "/" and int(m[3:5]) > 12 else f"%d{m[2]}%m{m[2]}%Y"
    try:
        n = (datetime.strptime(m, form) - datetime(1900, 1, 1)).days
    except ValueError:
        return None
    b = max(x for x in range(2, 271) if 73049 % x == 0)
    hi, lo = _feistel(n // b, n % b, 73049 // b, b, key, "date")
    return (datetime(1900, 1, 1) + timedelta(hi * b + lo)).strftime(form)


def _new_iban(m, key):
    value = lambda x: int("".join(str(int(c, 36)) for c in x))
    x = m.replace(" ", "")
    if value(x[4:] + x[:4]) % 97 != 1 or len(_plain(x[4:])) < 2:
        return None
    account = _refill(x[4:], _digits(_plain(x[4:]), key, "iban"))
    return _refill(m, _plain(f"{98 - value(account + x[:2] + '00') % 97:02d}{account}"))


def _new_mail(m, key):
    return "u" + hashlib.sha256(f"{key}|mail|{m.lower()}".encode()).hexdigest()[:16] + "@example.org"


NEW = {"mail": _new_mail, "iban": _new_iban, "card": _new_card, "phone": _new_phone, "social": _new_social, "address": _new_address, "date": _new_date}
MARKS = " \ue000 own \ue000"
SPELLINGS = [
    "+17435553824 and (743) 555-3824 and 743-555-3824 and 743.555.3824 and +1 (743) 555-3824", "+49151 234 5678 or +49 151 2345678, +358 40 123 4567; 1743-555-38241 and 743-555-3824-1",
    "DE89 3704 0044 0532 0130 00, DE89370400440532013000, DE88 3704 0044 0532 0130 00", "31/12/1999 31.12.1999 1999-12-31 1999-12-31T10:00 1999-12-31Tea 31/12.1999 30/02/1999 12/31/1999 01.02.2003.",
    "DE89 3704 0044 0532 0130 00 THE and GB82 WEST 1234 5698 7654 32 IBAN, BE71 0961 2345 6769 PAID, BE71 0961 2345 6769 12; XX00 1234 5678 AB", "02/30/1999 13/31/1999 12/31/1999/1",
    "é(743) 555-3824é mail a@b.co, c@d.co" + " 4994226020900891" * 300, "1.2.3.4 256.1.1.1 1.2.3.4.5 078-05-1120 900-12-1234 001-01-0001", "٣(743) 555-3824 ①",
]


# The twin's own patterns, by the spellings that the module's docstring lists, in the order of their right to a stretch of text.
EDGE, MONTH_DAY = "(?![A-Za-z0-9])", "(?:0[1-9]|[12][0-9]|3[01])"
OWN = {
    "mail": r"[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+",
    "iban": None,
    "phone": rf"(?<![A-Za-z0-9])\+(?:\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:[ .-]\d{{2,5}}){{1,4}}|[1-9]\d{{7,14}}){EDGE}"
    rf"|(?<![A-Za-z0-9+.-])(?:\(\d{{3}}\)[ -]?\d{{3}}[ .-]|\d{{3}}-\d{{3}}-|\d{{3}}\.\d{{3}}\.)\d{{4}}(?![A-Za-z0-9]|[.-]\d)",
    "card": rf"(?<![A-Za-z0-9+.])\d(?:[ -]?\d){{12,18}}{EDGE}",
    "social": r"(?<![A-Za-z0-9-])\d\d\d-\d\d-\d\d\d\d(?![A-Za-z0-9-])",
    "address": rf"(?<![A-Za-z0-9.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![A-Za-z0-9]|\.\d)",
    "date": rf"(?<![A-Za-z0-9-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-{MONTH_DAY}(?:(?=T\d\d:)|(?![A-Za-z0-9-]))"
    rf"|(?<![A-Za-z0-9./-])(?:{MONTH_DAY}([/.])(?:0[1-9]|1[0-2])\1|(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/)(?:19|20)\d\d(?![A-Za-z0-9/-]|\.\d)",
}


def _ibans(text):
    """(start, end) of what may be an IBAN: compact, or in groups of four, of a listed country at its length."""
    sizes = {c: n for n, names in P.IBAN_LENGTHS.items() for c in names.split()}
    at = 0
    while m := re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})\d\d", re.A).search(text, at):
        tries = [re.compile(r"[A-Z0-9]{11,30}" + EDGE).match(text, m.end())]
        if n := sizes.get(m[1]):
            tries.append(re.compile(rf"(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + EDGE).match(text, m.end()))
        tries.append(re.compile(r"(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?" + EDGE).match(text, m.end()))
        found = next((t for t in tries if t), None)
        if found:
            yield m.start(), found.end()
        at = found.end() if found else m.end()


def _pseudonymized(text, key):
    """(counts by kind, new text): spans on the text as it came; a claimed stretch is no other kind's, and stands as a bar for those."""
    seen, claimed, counts = text or "", {}, {}
    for kind, pattern in OWN.items():
        spans = _ibans(seen) if kind == "iban" else [m.span() for m in re.finditer(pattern, seen, re.A)]
        new = {(a, b): NEW[kind](text[a:b], key) for a, b in spans}
        new = {k: v for k, v in new.items() if v is not None}
        for a, b in new:
            seen = seen[:a] + "|" * (b - a) + seen[b:]
        claimed |= new
        counts[kind] = len(new)
    out, at = [], 0
    for (a, b), v in sorted(claimed.items()):
        out += [text[at:a], v]
        at = b
    return counts, text and "".join(out) + text[at:]


def _valid_iban(country, account):
    value = lambda x: int("".join(str(int(c, 36)) for c in x))
    return f"{country}{98 - value(account + country + '00') % 97:02d}{account}"


def test_pseudonyms_by_brute_force(spark, sf_dir, odd):
    """An independent version of patterns, overlaps and permutations over real, odd and hand-written texts."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(i and i + 5000, t) for i, t in ODD + PRIVATE] + [(9000 + i, t) for i, t in enumerate(SPELLINGS)]
    want = []
    for i, text in rows:
        counts, new = _pseudonymized(text, "k")
        want.append((i, [counts[k.name] for k in P.KINDS], new))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = P.pseudonymize(df, "k")
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], [r[f"n_{k.name}"] for k in P.KINDS], r["clean_text"])) for r in out.collect())
    clean = {r["doc_id"]: r["clean_text"] for r in out.where("doc_id >= 9000").collect()}
    a = re.fullmatch(r"\+1(\d{10}) and \((\d{3})\) (\d{3})-(\d{4}) and .*", clean[9000])
    assert a and a[1] == a[2] + a[3] + a[4] != "7435553824" and clean[9001].startswith("+49") and clean[9001].endswith("1743-555-38241 and 743-555-3824-1")
    assert P.pseudonymize(odd, "k", carry=("key", "n", "spans")).columns[:4] == ["doc_id", "key", "n", "spans"] and P.pseudonymize(odd, "k").count() == len(ODD)


def test_no_kind_is_found_in_another(spark):
    """Ten thousand valid account numbers in groups of four, and phones whose digits could be a card's."""
    rng = random.Random(4)
    plain = [_valid_iban("DE", f"{rng.randrange(10**18):018d}") for _ in range(10_000)]
    groups = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in plain]
    phones = [f"+49 {rng.randrange(100, 1000)} {rng.randrange(1000, 10000)} {rng.randrange(1000, 10000)} {rng.randrange(10, 100)}" for _ in range(3000)]
    rows = [(i, f"{a} / {b}") for i, (a, b) in enumerate(zip(groups, plain, strict=True))] + [(20_000 + i, p) for i, p in enumerate(phones)] + [(30_000, "; ".join(groups[:3000]) + MARKS)]
    out = P.pseudonymize(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), "k").collect()
    kinds = [k.name for k in P.KINDS]
    new = {}
    for r in out:
        counts = {k: r[f"n_{k}"] for k in kinds if r[f"n_{k}"]}
        if r["doc_id"] < 20_000:
            a, b = r["clean_text"].split(" / ")
            assert counts == {"iban": 2} and a.replace(" ", "") == b == _valid_iban("DE", b[4:]) and a != groups[r["doc_id"]]
            new[groups[r["doc_id"]]] = a
        elif r["doc_id"] < 30_000:
            assert counts == {"phone": 1} and r["clean_text"].startswith("+49") and len(r["clean_text"]) == len(phones[0])
    last = next(r for r in out if r["doc_id"] == 30_000)
    assert last["n_iban"] == 3000 and last["clean_text"] == "; ".join(new[g] for g in groups[:3000]) + MARKS


def test_one_text_of_a_million_characters(spark):
    text = " ".join(f"x{i}@y.org 078-05-{1000 + i % 9000} 1.2.{i % 256}.4 word" for i in range(20_000)) + "a" * 20_000
    r = P.pseudonymize(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert (r["n_mail"], r["n_social"], r["n_address"]) == (20_000,) * 3
    assert r["clean_text"] == _pseudonymized_pieces(text, "k")


def _pseudonymized_pieces(text, key):
    return " ".join(_pseudonymized(w, key)[1] for w in text.split(" "))


def test_month_first_dates_and_ibans_before_words(spark):
    text = "12/31/1999 1999-12-31 31/12/1999; DE89 3704 0044 0532 0130 00 THE; GB82 WEST 1234 5698 7654 32 IBAN; BE71 0961 2345 6769 PAID; BE71096123456769"
    r = P.pseudonymize(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert (r["n_date"], r["n_iban"]) == (3, 4)
    m = re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d{4})-(\d\d)-(\d\d) (\d\d)/(\d\d)/(\d{4}); (DE[\d ]{25}) THE; (GB\d\d WEST[\d ]{18}) IBAN; (BE[\d ]{17}) PAID; (BE\d{14})", r["clean_text"])
    assert m and (m[3], m[1], m[2]) == (m[4], m[5], m[6]) == (m[9], m[8], m[7]) and m[12].replace(" ", "") == m[13] and m[13] != "BE71096123456769"
    for n, names in P.IBAN_LENGTHS.items():
        for c in names.split():
            plain = f"{c}00" + "1" * (n - 4)
            spelled = " ".join(plain[i : i + 4] for i in range(0, n, 4))
            assert re.fullmatch(P._grouped_iban(), spelled) and re.match(P._grouped_iban() + "(?![A-Z0-9])", spelled + " WORD")[0] == spelled


def test_the_key_is_in_no_plan(spark):
    df = P.pseudonymize(spark.createDataFrame(PRIVATE, "doc_id bigint, text string"), "an uncommon key")
    assert "an uncommon key" not in df._jdf.queryExecution().toString()
