"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spans that score less than this are not reported.
LEAST_SCORE = 0.5
#: Code points before a span in which context words count.
NEARBY = 48
#: What a context word nearby adds to a span's score.
CONTEXT = 0.3


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` finds what ``says`` in the contract finds, written so that a
    Java matcher reads a text once: possessive where no other split can
    match, and never begun inside a run that was already tried.
    ``base`` kinds are reported whatever the context.
    """

    name: str
    pattern: str
    score: float
    base: bool = False
    context: str = ""


_PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: Characters of an IBAN by the registry, of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: By the country's length where the span may end there, else the longest run, as not every country's length is known.
_IBAN = "|".join(rf"(?:{v.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, v in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, base=True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.6, base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, base=True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})", 0.8),
    Kind("national_phone", r"(?<![0-9A-Za-z+().-])(?<![0-9+)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])", 0.3, context=r"(?i)\b(phone|tel|telephone|call|mobile|fax|telefon|tél|teléfono)\b"),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", 0.35, context=r"(?i)\b(ssn|social security|tax id|taxpayer)\b"),
]
BASE = [k.name for k in KINDS if k.base]

_SPANS = "array<struct<start:bigint,end:bigint,found:string,near:string>>"
_GAPS = "array<struct<gap:string,found:string>>"
#: Matches whose starts are summed together; more are summed in blocks, then over blocks.
BLOCK = 256


def gaps_of(text: Column, pattern: str) -> Column:
    """What lies before each leftmost non-overlapping match of a pattern, and the match: array of (gap, found)."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x["found"].isNotNull())).otherwise(F.array().cast(_GAPS))


def _blocks(array: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(array), F.lit(1)) - 1) / BLOCK).cast("int"))


def _tail(gaps: Column, i: Column) -> Column:
    """The NEARBY code points before the i-th match. A match has a character at least, and those that need words nearby have eleven: a few gaps hold them."""
    back = F.least(i, F.lit(NEARBY // 11 + 1))
    before = F.transform(F.slice(gaps, i - back + 1, back), lambda x: F.concat(x["gap"], x["found"]))
    return F.right(F.concat(F.array_join(before, ""), F.get(gaps, i)["gap"]), F.lit(NEARBY))


def matches(gaps: Column, context: str = "") -> Column:
    """``gaps_of`` a text as array of (start, end, found, near) in code points, end exclusive; near is what precedes, if a context is asked for.

    The lengths of the matches and of the gaps between them give the starts,
    summed in blocks so that a text with very many matches costs little more than in proportion.
    ``gaps`` must be a column of its own: it is named outside the lambdas too, or the optimizer would compute it again for each block.
    """
    blocks = F.transform(
        _blocks(gaps),
        lambda b: F.aggregate(
            F.slice(gaps, b * BLOCK + 1, BLOCK),
            F.struct(F.lit(0).cast("bigint").alias("at"), (b * BLOCK).alias("i"), F.array().cast(_SPANS).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("at"),
                (a["i"] + 1).alias("i"),
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["gap"])).alias("start"),
                            (a["at"] + F.length(x["gap"]) + F.length(x["found"])).alias("end"),
                            x["found"].alias("found"),
                            (_tail(gaps, a["i"]) if context else F.lit(None).cast("string")).alias("near"),
                        )
                    ),
                ).alias("out"),
            ),
        ),
    )
    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")),
        lambda a, g: F.struct(
            (a["at"] + g["at"]).alias("at"),
            F.concat(a["out"], F.array(F.transform(g["out"], lambda s: F.struct((a["at"] + s["start"]).alias("start"), (a["at"] + s["end"]).alias("end"), s["found"].alias("found"), s["near"].alias("near"))))).alias("out"),
        ),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(F.size(gaps) > 0, whole).otherwise(F.array().cast(_SPANS))


def _events(own: Column, base: Column) -> Column:
    """Both kinds of spans in one order: a span of ``own`` by its end, after the spans of ``base`` that start before that."""
    mine = F.transform(own, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), x["start"].alias("other"), x.alias("span")))
    others = F.transform(base, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("base"), x["end"].alias("other"), F.get(own, F.lit(-1)).alias("span")))
    return F.when((F.size(own) > 0) & (F.size(base) > 0), F.array_sort(F.concat(mine, others)))


def _clear(own: Column, events: Column) -> Column:
    """``own`` without the spans that overlap one of the others.

    A span overlaps one if, of those that start before its end, the greatest
    end lies beyond its start. The greatest end so far is carried along the
    sorted events, in blocks as in ``matches``.
    """
    none = F.lit(-1).cast("bigint")
    tops = F.transform(_blocks(events), lambda b: F.array_max(F.transform(F.slice(events, b * BLOCK + 1, BLOCK), lambda e: F.when(e["base"] == 1, e["other"]).otherwise(none))))
    before = F.aggregate(tops, F.array(none), lambda a, top: F.concat(a, F.array(F.greatest(F.element_at(a, -1), top))))
    kept = F.transform(
        F.arrays_zip(_blocks(events).alias("b"), F.slice(before, 1, F.size(_blocks(events))).alias("top")),
        lambda z: F.aggregate(
            F.slice(events, z["b"] * BLOCK + 1, BLOCK),
            F.struct(z["top"].alias("top"), F.slice(own, 1, 0).alias("out")),
            lambda a, e: F.when(e["base"] == 1, F.struct(F.greatest(a["top"], e["other"]).alias("top"), a["out"].alias("out")))
            .when(a["top"] > e["other"], a)
            .otherwise(F.struct(a["top"].alias("top"), F.concat(a["out"], F.array(e["span"])).alias("out"))),
            lambda a: a["out"],
        ),
    )
    return F.when(events.isNull(), own).otherwise(F.flatten(kept))


def luhn(digits: Column) -> Column:
    """True where a string of digits has a right Luhn check digit."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(_doubled(F.substr(digits, i, F.lit(1)).cast("int"))),
    )
    return total % 10 == 0


def _doubled(d: Column) -> Column:
    return F.when(d > 4, 2 * d - 9).otherwise(2 * d)


def mod97(found: Column) -> Column:
    """True where an IBAN's digits, letters counting from A = 10, leave 1 modulo 97."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    left = F.aggregate(
        F.array_remove(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return left == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def _confirms(k: Kind) -> Callable[[Column], Column]:
    return lambda x: confirmed(k.name, x["found"])


def _scores(k: Kind) -> Callable[[Column], Column]:
    def scored(x: Column) -> Column:
        more = F.when(x["near"].rlike(k.context), F.lit(CONTEXT)).otherwise(F.lit(0.0)) if k.context else F.lit(0.0)
        return F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(k.score) + more).alias("score"))

    return scored


def _is_kind(name: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == name


def _spans(documents: DataFrame) -> DataFrame:
    """(_row, _pii): each whole row, and the spans of its text."""
    text = documents.select(F.struct(*documents.columns).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    out = text.select("_row", *[gaps_of(F.col("_t"), k.pattern).alias(f"_g_{k.name}") for k in KINDS])
    spans = [F.transform(F.filter(matches(F.col(f"_g_{k.name}"), k.context), _confirms(k)), _scores(k)) for k in KINDS]
    spans = [s if k.base else F.filter(s, lambda x: x["score"] >= LEAST_SCORE) for k, s in zip(KINDS, spans)]
    out = out.select("_row", *[s.alias(f"_s_{k.name}") for k, s in zip(KINDS, spans)])
    out = out.withColumn("_base", F.concat(*[F.col(f"_s_{n}") for n in BASE]))
    added = [k.name for k in KINDS if not k.base]
    out = out.withColumns({f"_e_{n}": _events(F.col(f"_s_{n}"), F.col("_base")) for n in added})
    arrays = [F.col("_base"), *[_clear(F.col(f"_s_{n}"), F.col(f"_e_{n}")) for n in added]]
    # Through the explode no later filter on the spans is pushed down, where it would be evaluated again.
    return out.select("_row", F.explode_outer(F.array(F.concat(*arrays))).alias("_pii"))


def with_spans(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_pii``: array of (kind, start, end, score) in order of kind, then start.

    A base kind's span is reported if its check holds; other kinds need
    LEAST_SCORE, which some reach only with a context word in the NEARBY code
    points before them, and do not overlap a base span. A null or empty text
    has no spans. Each row is judged by itself; columns of any name but ``_pii`` do no harm.
    """
    return _spans(documents).select("_row.*", "_pii")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first's kind."""
    text = F.col("_row.text")
    merged = F.aggregate(
        F.array_sort(F.transform("_pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.concat(a["out"], F.array(F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.concat(F.lit("<"), x["kind"], F.lit(">")))).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))),
    )
    clean = F.when(F.size("_pii") > 0, merged).otherwise(text).alias("text")
    return _spans(documents).select(*[clean if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_pii", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter("_pii", _is_kind(n))).cast("bigint").alias(f"n_{n}") for n in BASE]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("_pii")).alias("spans"))
