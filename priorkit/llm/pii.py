"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and ranges confirm
them, and context words in the characters before a span raise its score.
Positions count code points; they come from splitting a text by the same pattern
that extracts its matches, so both walk through the text once.

The patterns of the runs of characters that may start a match begin with a
look-behind or the end of the last match (`\\G`), and use possessive repeats:
the same leftmost matches, in time linear in the length of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

CONTEXT_CHARS = 40
#: A span that only context can confirm needs this score; a span of the four base kinds always stays.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a cheap pattern without which no match is possible
    context: str
    base: bool
    start_score: float
    tag: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", r"(?i)\b(?:e-?mail|mail|contact|write)\b", True, 0.8, "[EMAIL]"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"(?i)\b(?:ip|host|server|address|addr)\b", True, 0.7, "[IP]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", r"(?i)\b(?:card|visa|credit|debit|payment)\b", True, 0.8, "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)\b(?:phone|tel|call|fax|mobile)\b", True, 0.7, "[PHONE]"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}", r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", False, 0.3, "[IBAN]"),
    Kind("local_phone", r"(?<![+0-9().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}", r"(?i)\b(?:phone|tel|call|fax|mobile)\b", False, 0.3, "[PHONE]"),
)
BASE = tuple(k.name for k in KINDS if k.base)
_BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_SPAN = "array<struct<start:int,end:int,score:double>>"
#: Spans are gathered in runs of so many.
RUN = 128


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the letters and digits, rotated by four, give 1 modulo 97."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(match) < 16, False).otherwise(F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


def pushed(acc: Column, item: Column, kind: str) -> dict[str, Column]:
    """Fields `full` and `open` of the accumulator with one item more: arrays of RUN items, and the one being filled. Copies stay far below the square of the items."""
    end = F.size(acc["open"]) >= RUN
    return {
        "full": F.when(end, F.concat(acc["full"], F.array(acc["open"]))).otherwise(acc["full"]).cast(f"array<{kind}>"),
        "open": F.when(end, F.array(item)).otherwise(F.concat(acc["open"], F.array(item))).cast(kind),
    }


def all_of(acc: Column) -> Column:
    return F.flatten(F.concat(acc["full"], F.array(acc["open"])))


def spans_of(kind: Kind, text: Column) -> Column:
    """array<struct<start,end,score>> of one kind, ascending."""
    pairs = F.arrays_zip(F.split(text, kind.pattern).alias("p"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["p"])
        end = start + F.length(pair["m"])
        near = F.substring(pair["p"], -CONTEXT_CHARS, CONTEXT_CHARS).rlike(kind.context)
        checked = 0.3 if kind.name == "iban" else 0.0
        score = F.lit(kind.start_score + checked) + F.when(near, 0.2).otherwise(0.0)
        keep = confirmed(kind.name, pair["m"])
        if not kind.base:
            keep = keep & (score >= THRESHOLD)
        found = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"))
        taken = pair["m"].isNotNull() & keep
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), *(F.when(taken, v).otherwise(acc[k]).alias(k) for k, v in pushed(acc, found, _SPAN).items()))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("full"), none.alias("open"))
    walked = F.aggregate(pairs, empty, step, all_of)
    return F.when(text.rlike(kind.gate), walked).otherwise(none)


def named(kind: str) -> Column:
    return F.transform(f"__pii_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def count_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame) -> DataFrame:
    """`docs` with `pii`: array<struct<kind,start,end,score>> by kind in the order of KINDS, then start.

    Null and empty texts have an empty array. A column `pii` in the input is replaced, a
    rename away from being kept; `redact` keeps it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop("pii").withColumns({f"__pii_{k.name}": spans_of(k, text) for k in KINDS})
    return out.withColumn("pii", F.concat(*(named(k.name) for k in KINDS))).drop(*(f"__pii_{k.name}" for k in KINDS))


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, all its columns in place, with every span of `text` replaced by its kind's tag; overlapping spans become the first one's tag.

    n_chars, where present, is brought up to date. Null texts stay null.
    """
    span = "array<struct<start:int,end:int,kind:string>>"
    found = find_pii(docs.withColumnRenamed("pii", "__pii_own"))
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def join_up(acc: Column, s: Column) -> Column:
        last = acc["last"]
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        over = F.coalesce(last["end"] > s["start"], F.lit(False))
        done = {k: F.when(over | last.isNull(), acc[k]).otherwise(v).alias(k) for k, v in pushed(acc, last, span).items()}
        return F.struct(*done.values(), F.when(over, grown).otherwise(s).alias("last"))

    empty = F.struct(F.array().cast(f"array<{span}>").alias("full"), F.array().cast(span).alias("open"), F.lit(None).cast("struct<start:int,end:int,kind:string>").alias("last"))
    joined_up = F.aggregate(order, empty, join_up, lambda acc: F.when(acc["last"].isNull(), F.array().cast(span)).otherwise(F.concat(all_of(acc), F.array(acc["last"]))))
    found = found.withColumn("__pii_cut", joined_up)
    tag = lambda k: F.coalesce(*[F.when(k == x.name, F.lit(x.tag)) for x in KINDS])
    cut = F.col("__pii_cut")
    pieces = F.transform(
        cut,
        lambda s, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, 0).otherwise(F.try_element_at(cut, i)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.try_element_at(cut, i)["end"])),
            tag(s["kind"]),
        ),
    )
    tail = F.substring(F.col("text"), F.element_at(cut, -1)["end"] + 1, F.length("text"))
    clean = F.when(F.size(cut) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    out = found.withColumn("text", clean).drop("pii", "__pii_cut").withColumnRenamed("__pii_own", "pii")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark, sf_dir):
    """Spans of every row. Null and empty texts have none: counts of 0 and the digest of an empty string.

    Each row is judged by its own text, so null ids and repeated rows are rows like others;
    very long texts are read whole; an empty table gives an empty one; other columns are not read.
    """
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )


QUERIES = {"op4_pii": op4_pii}
ORACLES = {}
