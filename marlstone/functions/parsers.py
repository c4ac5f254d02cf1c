"""Answer parsers: reply texts to labels, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

LABELS = ("SUPPORTED", "HALLUCINATED")
# Words that stand for a label by themselves, and Korean hints in the order they are tried.
SYNONYMS = {"SUPPORTED": ["SUPPORT", "SUPPORTS", "TRUE", "YES"], "HALLUCINATED": ["HALLUCINATION", "UNSUPPORTED", "FALSE", "NO"]}
HINTS = [("HALLUCINATED", ["환각", "뒷받침되지 않", "지지되지 않", "사실이 아", "불일치"]), ("SUPPORTED", ["뒷받침", "지지됨", "일치", "사실임"])]


def hallucination_label(text: Column) -> Column:
    """SUPPORTED, HALLUCINATED or null.

    One label as a whole word decides; if both stand in the reply, the one it
    ends with; if none does, a reply that is just a synonym, then a Korean
    hint, those of HALLUCINATED first as one of the others is part of them.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\b(SUPPORTED|HALLUCINATED)\b"), F.lit(1)), F.upper))
    upper = F.upper(strip(text))
    tail = F.regexp_replace(upper, "[.。!?\"'` \n]+$", "")
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).when(F.size(found) == 1, F.get(found, F.lit(0)))
    for label in LABELS:
        out = out.when((F.size(found) > 1) & tail.endswith(label), F.lit(label))
    out = out.when(F.size(found) > 1, F.lit(None).cast("string"))
    for label, words in SYNONYMS.items():
        out = out.when(upper.isin(words), F.lit(label))
    for label, hints in HINTS:
        out = out.when(text.rlike("|".join(hints)), F.lit(label))
    return out


def _answers(pairs: Column, size: Column, labels: Column) -> Column:
    """Array of (item, label) strings to an array of 0-based labels by item; of several in range, the first."""
    valid = F.filter(pairs, lambda p: p["item"].between(F.lit(1), size) & p["label"].between(F.lit(1), labels))
    first = F.transform(F.sequence(F.lit(1), size), lambda i: F.get(F.filter(valid, lambda p: p["item"] == i), F.lit(0))["label"] - 1)
    return first


def batch_answers(text: Column, size: Column | int, labels: Column | int) -> Column:
    """Array of ``size`` 0-based labels, null where no usable answer stands.

    Lines ``item: label`` (also with . ) or -, and after a bullet) are read
    strictly; only if no line gives an answer, such pairs anywhere in the text.
    """
    size, labels = (x if isinstance(x, Column) else F.lit(x) for x in (size, labels))
    t = F.coalesce(text, F.lit(""))
    strict = r"^\s*[*\-•]?\s*(\d{1,3})\s*[:.)\-]\s*(\d{1,3})\s*$"
    lines = F.filter(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: x.rlike(strict))
    by_line = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, strict, 1).cast("int").alias("item"), F.regexp_extract(x, strict, 2).cast("int").alias("label")))
    loose = r"(\d{1,3})\s*[:.)\-]\s*(\d{1,3})"
    anywhere = F.zip_with(
        F.regexp_extract_all(t, F.lit(loose), F.lit(1)),
        F.regexp_extract_all(t, F.lit(loose), F.lit(2)),
        lambda a, b: F.struct(a.cast("int").alias("item"), b.cast("int").alias("label")),
    )
    own = _answers(by_line, size, labels)
    return F.when(F.exists(own, lambda x: x.isNotNull()), own).otherwise(_answers(anywhere, size, labels))


def batch_json_answers(text: Column, size: Column | int, label_space: Column) -> Column:
    """Array of 0-based labels from ``{"answers": [...]}``; a list of another length, or no list, voids the batch; an unknown label is null."""
    size = size if isinstance(size, Column) else F.lit(size)
    t = strip(text)
    fenced = F.regexp_replace(F.regexp_replace(t, "^`+|`+$", ""), r"(?s)^[^\n]*\n", "")
    body = F.when(t.startswith("```") & t.contains("\n"), fenced).otherwise(t)
    block = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    listed = F.try_variant_get(F.try_parse_json(block), "$.answers", "array<variant>")
    given = F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    found = F.transform(given, lambda x: F.when(F.array_position(label_space, x) > 0, F.array_position(label_space, x).cast("int") - 1))
    empty = F.transform(F.sequence(F.lit(1), size), lambda i: F.lit(None).cast("int"))
    return F.when(F.size(listed) == size, found).otherwise(empty)


def single_label(text: Column, label_space: Column) -> Column:
    """0-based label of a reply that is just a label, maybe in quotes; else null."""
    bare = strip(F.regexp_replace(strip(text), "^[`\"']+|[`\"']+$", ""))
    at = F.array_position(label_space, bare)
    return F.when((F.coalesce(text, F.lit("")) != "") & (at > 0), at.cast("int") - 1)


DIMENSIONS = ("factual_consistency", "key_information_coverage", "conciseness", "overall_quality")


def judgement(text: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Struct of integer scores 1 to 5 and a rationale of at most 500 characters; null unless all scores are there. Fractions are cut off."""
    t = F.regexp_replace(strip(text), "^`+(?:json)?|`+$", "")
    held = F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0))
    scores = [F.try_variant_get(held, f"$.{d}", "double").cast("int") for d in dimensions]
    ok = scores[0].between(1, 5)
    for s in scores[1:]:
        ok = ok & s.between(1, 5)
    rationale = F.substring(F.coalesce(F.try_variant_get(held, "$.rationale", "string"), F.lit("")), 1, 500)
    return F.when(ok, F.struct(*[s.alias(d) for s, d in zip(scores, dimensions)], rationale.alias("rationale")))
