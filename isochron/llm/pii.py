"""Personal data by regular expressions, checksums and context words, all in Spark SQL functions.

A kind is a pattern, a check and a score. Positions come from splitting the text
at the matches: the pieces between matches and the matches themselves alternate,
so running lengths give every span in code points. A text is put through a
kind's pattern only if a cheap test (a character the pattern needs) passes.

Patterns use possessive repeats where what follows can't start inside the
repeat; that changes no match and keeps the matcher off the stack for runs of
any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.rows import column, free

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``check`` confirms; ``context`` words before a span add to its score, ``against`` words lower it."""

    name: str
    pattern: str
    needs: str  # a pattern that any text with a match has; cheap
    check: str = "any"  # any, octets, luhn, digits, mod97
    prior: float = 1.0
    context: str = ""
    against: str = "example|sample|dummy|placeholder"


# Lengths of account numbers by country (ISO 13616 registry), with their check digits.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_PATTERN = r"\b(?:" + "|".join(f"(?:{v.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in _IBAN.items()) + r")\b"

#: Always reported, whatever the score.
BASE = (
    Kind("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "any", 0.8, "mail|contact|write"),
    Kind("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "octets", 0.5, "ip|host|server|address", "version|release|section|chapter"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][0-9 -]{10}", "luhn", 0.6, "card|visa|credit|pay", "isbn|serial|order|part|example|sample"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "digits", 0.6, "tel|phone|call|fax|mobile", "version|order|part|example|sample"),
)
#: Reported when prior plus context reaches the threshold.
ADDED = (
    Kind("iban", _IBAN_PATTERN, r"[A-Z]{2}[0-9]{2}", "mod97", 0.8, "iban|account|konto|bank"),
    Kind("tel", r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b", r"[0-9]{3}[ .-][0-9]{4}", "any", 0.3, "tel|phone|call|fax|mobile"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]{3}-[0-9]{2}-", "any", 0.3, "ssn|social|security"),
)
#: Code points before a span in which context words count.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4
CONTEXT_MALUS = 0.3
THRESHOLD = 0.6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(c: Column, least: int = 12, most: int = 19) -> Column:
    """Whether the digits of ``c`` number ``least`` to ``most`` and pass Luhn's check."""
    d = _digits(c)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            i % 2 == 0,
            F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * 2
            - F.when(F.substring(d, F.length(d) - i + 1, F.lit(1)) >= "5", 9).otherwise(0),
        ).otherwise(F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")),
    )
    return F.when(F.length(d).between(least, most), total % 10 == 0).otherwise(False)


def mod97_ok(c: Column) -> Column:
    """Whether ``c`` without blanks, first four characters moved to the end, is 1 modulo 97 (ISO 13616)."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    r = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(r, ""), lambda x: x != ""),
        F.lit(0),
        lambda acc, x: F.when(x.rlike("[0-9]"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97),
    )
    return F.when(F.length(s).between(15, 34), rest == 1).otherwise(False)


def _confirmed(kind: Kind, m: Column) -> Column:
    if kind.check == "octets":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.check == "luhn":
        return luhn_ok(m)
    if kind.check == "digits":
        return F.length(_digits(m)).between(9, 15)
    if kind.check == "mod97":
        return mod97_ok(m)
    return F.lit(True)


_SPAN = "struct<start:bigint,end:bigint,kind:string,text:string,score:double>"


def find_spans(text: Column, kind: Kind) -> Column:
    """Array of (start, end, kind, text, score) of the kind's confirmed spans; empty for null or empty text."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(start, F.lit(CONTEXT_CHARS)).cast("int")))
        near = lambda words, weight: F.when(before.rlike(rf"(?:^|[^a-z])(?:{words})"), weight).otherwise(0.0)
        score = F.lit(kind.prior) + near(kind.context, CONTEXT_BONUS) - near(kind.against, CONTEXT_MALUS)
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"), x["m"].alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score")
        ).cast(_SPAN)
        return F.struct(
            end.alias("pos"),
            F.when(_confirmed(kind, x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    pairs = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    return F.when(text.rlike(kind.needs), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))


def _with_spans(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Adds ``prefix`` + base and ``prefix`` + all: the confirmed spans of BASE, and those with the ones of ADDED that count, each in order."""
    for k in BASE + ADDED:
        df = df.withColumn(f"{prefix}_{k.name}", find_spans(text, k))
    order = {k.name: i for i, k in enumerate(BASE + ADDED)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def in_order(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("b"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    base, more = f"{prefix}base", f"{prefix}added"
    df = df.withColumn(base, in_order(F.concat(*[F.col(f"{prefix}_{k.name}") for k in BASE])))
    added = F.filter(F.concat(*[F.col(f"{prefix}_{k.name}") for k in ADDED]), lambda s: (s["score"] >= THRESHOLD) & ~_overlaps(s, F.col(base)))
    df = df.withColumn(more, added)
    return df.withColumn(f"{prefix}all", F.when(F.size(more) > 0, in_order(F.concat(base, more))).otherwise(F.col(base)))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``base`` and ``spans`` (arrays of start, end, kind, text, score).

    ``base`` holds the confirmed spans of BASE by start, then kind as listed;
    ``spans`` adds those of ADDED that reach THRESHOLD and overlap no base span.
    Null and empty texts have none. A long text is searched whole, kind by kind, in
    memory of a few times its size and its spans. Repeated rows stay repeated; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    df = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return _with_spans(df, F.col("text"), "_").select(F.col("id").alias(id_col), F.col("_base").alias("base"), F.col("_all").alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by ``<KIND>``; ``n_chars``, if there, follows the new text.

    A span that begins inside an earlier one is merged into it. Null texts stay null,
    texts without spans as they are. All other columns stay as they are, whatever
    their names: what is computed has names that no column begins with.
    """
    p = free("_pii", docs.columns)
    text = F.col(f"{p}text")
    df = _with_spans(docs.withColumn(f"{p}text", F.coalesce(column(text_col), F.lit(""))), text, p)
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.when(
            s["start"] >= acc["pos"],
            F.struct(s["end"].alias("pos"), F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    spans = F.col(f"{p}all")
    new = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))
    df = df.withColumn(f"{p}new", F.when(column(text_col).isNull(), F.lit(None)).when(F.size(spans) > 0, new).otherwise(column(text_col)))
    out = {text_col: F.col(f"{p}new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(f"{p}new").cast(docs.schema["n_chars"].dataType)
    return df.select(*[out.get(c, column(c)).alias(c) for c in docs.columns])


def op10_pii(docs: DataFrame) -> DataFrame:
    """The digest of ``pii_spans``: counts by base kind, SHA-256 of the base digest, all spans."""
    df = pii_spans(docs)
    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")

    counts = [count(k.name) for k in BASE]
    return df.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
