"""Personal data by DataFrame functions alone: patterns propose spans, checks confirm them, context adjusts scores.

Kinds email, ip, card and phone are the base: every span that passes its check stays, whatever its score. Kinds iban
(ISO 7064 modulo 97) and account (a bare number) are added where check and score allow: a score is the kind's prior plus
``CONTEXT`` if one of the kind's words stands in the ``NEARBY`` characters before. Added spans do not overlap base ones.

The patterns match what the plain forms match, without their backtracking: a run of characters is entered at its start
or where the last match ended (``\\G``), and never given back, so long runs cost linear time and no deep stack. Offsets
are code points; they come from the lengths of the pieces between matches.

A null or empty text has no spans. Texts are read whole. Repeated rows give repeated results, a null doc_id stays null. No
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns by kind
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
ACCOUNT = r"(?<![A-Za-z0-9.+@-])[0-9]{8,17}(?![A-Za-z0-9@-])"
#: The length of a country's IBAN, by the registry of ISO 13616 and the lengths others use. Codes not listed may have any from 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(x for names in IBAN_LENGTHS.values() for x in names.split())
#: A number of its country's length, whatever follows it after a character that is no letter or digit. A code that is
#: not listed takes what it can, up to where a listed one begins.
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    + rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_KNOWN})[0-9]{{2}}) ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
#: Kind -> (prior score, words of its context)
SCORES = {
    "email": (0.9, "mail|contact|write|address"),
    "ip": (0.5, "ip|server|host|address"),
    "card": (0.7, "card|credit|visa|payment|pay"),
    "phone": (0.7, "phone|tel|call|mobile|fax"),
    "iban": (0.8, "iban|bank|account|transfer"),
    "account": (0.2, "account|iban|bank|acct"),
}
CONTEXT, NEARBY, ACCEPT = 0.4, 40, 0.6
KINDS = ("email", "ip", "card", "phone", "iban", "account")
BASE = KINDS[:4]
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether a number with its first four characters moved to the end is 1 modulo 97, letters as 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(F.length(c) == 0, a).otherwise(step(a, c))) == 1


#: kind -> (pattern, a cheap test that every text with a match passes, check of a match)
FORMS = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(OCTETS)),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), lambda m: F.call_function("luhn_check", _digits(m))),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15)),
    "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _mod97),
    "account": (ACCOUNT, lambda t: t.rlike("[0-9]{8}"), lambda m: F.lit(True)),
}


def _spans(text: Column, kind: str) -> Column:
    """The kind's checked spans in order; only these are kept while the matches are walked."""
    pattern, maybe, check = FORMS[kind]
    prior, words = SCORES[kind]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["pos"] + F.length(x["gap"])).cast("int")
        end = (start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int")
        before = F.substring(text, F.greatest(start - NEARBY, F.lit(0)) + 1, F.least(start, F.lit(NEARBY)))
        score = F.lit(prior) + F.when(before.rlike(f"(?i)(?<![a-z])(?:{words})"), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))
        ok = x["hit"].isNotNull() & check(x["hit"])
        if kind not in BASE:
            ok = ok & (score >= ACCEPT)
        return F.struct(end.alias("pos"), F.when(ok, F.concat(acc["out"], F.array(span.cast(SPAN)))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(maybe(text), F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _found(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text, base (base spans) and found (all spans), each by start and then kind."""
    out = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    out = out.select("row", "text", *(_spans(F.col("text"), k).alias(k) for k in KINDS))
    out = out.select("row", "text", "iban", "account", F.array_sort(F.concat(*BASE)).alias("base"))
    added = F.filter(F.concat("iban", "account"), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # an account number inside an IBAN is no finding of its own
    alone = F.filter(added, lambda s: (s["kind"] == "iban") | ~F.exists("iban", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select("row", "text", "base", F.array_sort(F.concat("base", alone)).alias("found"))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with base (array of base spans) and found (all spans); own columns of these two names are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("base", "found")]
    return _found(docs).select(*(F.col("row").getField(c).alias(c) for c in own), "base", "found")


def _is(kind: str):
    return lambda found: found == kind


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans, and all spans as text."""
    found = _found(docs.select("doc_id", "text"))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of text replaced by its kind in brackets; overlapping spans become one.

    Every other column is passed through, whatever its name; a null text stays null.
    """
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        piece = F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        new = F.struct(s["end"].alias("pos"), F.concat(acc["out"], piece).alias("out"))
        return F.when(s["start"] >= acc["pos"], new).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1)))
    own = docs.schema["text"].dataType
    new = F.when(F.size("found") > 0, clean.cast(own)).otherwise(F.col("row.text"))
    return _found(docs).select(F.col("row").withField("text", new).alias("row")).select("row.*")
