"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (digit counts, Luhn for card numbers,
mod-97 for IBANs), and words near a span adjust its score. Base kinds (email, ip, card, phone)
stay whatever their score; the other kinds (iban, ssn) need ``min_score``.

Spans of a kind are leftmost and never overlap. Their places come from the lengths of the pieces
that the text falls into between matches, so a text is scanned twice per kind and only if a
cheap test says that the kind can occur. Patterns start at the edge of a run of characters (or
where the last match ended) and use possessive repeats, so scanning stays linear in long texts
without spaces; both give the same matches as the plain patterns.

Rows: a null or empty text has no spans. Every row is read on its own, also when it repeats a
``doc_id`` or has none. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.session import configure

BLOCK = 256
CONTEXT = 48         # characters before and after a span that are searched for context words


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str            # a text without a match of this has no span of the kind
    pattern: str
    score: float
    context: str         # words that raise the score
    base: bool = True


# IBAN lengths after country code and check digits (the IBAN registry).
IBAN_BODIES = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK",
    17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR",
    23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA",
    26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}


def iban_pattern() -> str:
    """IBANs of the length of their country, so that a word or number after one is no part of it.
    Other country codes may have any length, but end before an IBAN of a known country."""
    known = "|".join(" ".join(IBAN_BODIES.values()).split())
    fixed = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}"
                     for n, codes in IBAN_BODIES.items())
    other = (f"(?!{known})[A-Z]{{2}}[0-9]{{2}}"
             f"(?:(?! (?:{known})[0-9]{{2}}) ?[A-Z0-9]){{11,30}}")
    return f"(?<![A-Za-z0-9])(?:{fixed}|{other})(?![A-Za-z0-9])"


# Patterns, and words near a span that speak for it (English, German, French,
# Spanish).
KINDS = [
    Kind("email", "@",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         0.8, "mail|contact|kontakt|courriel|correo|write to"),
    Kind("ip", r"[0-9]\.[0-9]",
         r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         0.6, r"\bip\b|address|adresse|server|host|login|dirección"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}",
         r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
         0.7, "card|karte|carte|tarjeta|visa|mastercard|credit|pay|zahl"),
    Kind("phone", r"\+[0-9]",
         r"\+[0-9][\x20().0-9-]+[0-9]",
         0.6, "call|phone|tel|fax|mobile|cell|anruf|handy|appel|llam|móvil"),
    Kind("iban", "[A-Z]{2}[0-9]{2}",
         iban_pattern(),
         0.8, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
         r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         0.3, "ssn|social security|tax id|sozialversicherung|sécurité sociale|seguro social",
         base=False),
]
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    compact = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0),
                       lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    """Whether a proposed match passes the kind's validator."""
    if kind.name == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}")
    if kind.name == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind.name == "iban":
        return _mod97(match)
    return F.lit(True)


def _places(raw: Column) -> Column:
    """(start, end, i) of every match: running sums of the lengths of gaps and matches, built in
    blocks so that many matches cost no quadratic copying."""
    gaps, matches = raw["gaps"], raw["matches"]
    n = F.size(matches)
    kind = "struct<pos:int,out:array<struct<start:int,end:int,i:int>>>"

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), i.alias("i")))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        first = F.struct(F.element_at(acc, -1)["pos"].alias("pos"), F.array().alias("out")).cast(kind)
        return F.concat(acc, F.array(F.aggregate(
            F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1), first, step)))

    empty = F.array(F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(kind))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), empty, block)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda x: x["out"])))


def find_personal_data(docs: DataFrame, *, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with ``spans`` added (an input column of this name is replaced): an array of
    (start, rank, end, kind, score, base) by start, then kind; places are code points, the end
    exclusive."""
    configure(docs.sparkSession)
    names = [f"_pii_{k.name}" for k in KINDS]
    rows = docs.drop("spans").withColumn("_pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_pii_text")
    for kind, name in zip(KINDS, names):
        may = text.contains(kind.hint) if kind.hint == "@" else text.rlike(kind.hint)
        rows = rows.withColumn(name, F.when(may, F.struct(
            F.split(text, kind.pattern, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))))
    rows = rows.withColumns({f"{n}_at": _places(F.col(n)) for n in names})

    def spans(rank: int, kind: Kind, name: str) -> Column:
        raw = F.col(name)

        def describe(p: Column) -> Column:
            near = F.concat_ws(" ", F.right(F.get(raw["gaps"], p["i"]), F.lit(CONTEXT)),
                               F.left(F.get(raw["gaps"], p["i"] + 1), F.lit(CONTEXT)))
            bonus = F.when(F.lower(near).rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"),
                            F.lit(kind.name).alias("kind"),
                            F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"),
                            F.lit(kind.base).alias("base"))

        found = F.filter(F.col(f"{name}_at"),
                         lambda p: confirmed(kind, F.get(raw["matches"], p["i"])))
        found = F.transform(found, describe)
        if not kind.base:
            found = F.filter(found, lambda s: s["score"] >= min_score)
        return F.coalesce(found, F.array().cast(
            "array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>"))

    every = F.concat(*[spans(i, k, n) for i, (k, n) in enumerate(zip(KINDS, names))])
    return rows.withColumn("spans", F.array_sort(every)).drop(
        "_pii_text", *names, *[f"{n}_at" for n in names])


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
