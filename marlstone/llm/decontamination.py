"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders. Windows of eight
template tokens are compared by hash, and what stands in the placeholders
must change consistently, so that a question with other numbers is caught
and a chance likeness is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_key

#: Template tokens in a window.
WINDOW = 8
#: Of a window's tokens, those that must be literal.
LEAST_LITERAL = 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: A window table of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Bits of the filter that spares most windows of clean documents the join.
FILTER_BITS = 20

#: Marks before values, and what joins the parts of a value of several words.
NAME, NUMBER, UNIT, JOIN = "\u0001", "\u0002", "\u0003", "\u0004"
#: Words that stand for numbers, and those that may stand between the parts of a name.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
PARTICLES = "van von de der den del da di la le bin ibn al".split()
#: Units that count as such after a number.
UNITS = ["%", "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "miles", "mile", "meters", "metres", "dollars", "euros", "cents", "pounds"]


#: What stands between tokens; a point, comma, colon or slash between digits does not.
BETWEEN = r"[^\p{L}\p{N}\x01-\x04.,:/]+|[.,:/](?:(?![0-9])|(?<=[^0-9][.,:/]))"


#: Number words by their first letters, which most other words have not, and where a number in digits or words begins, in one pass.
_WORDS = "|".join(f"{c}(?:{'|'.join(w[1:] for w in NUMBER_WORDS if w[0] == c)})" for c in sorted({w[0] for w in NUMBER_WORDS}))
_NUMBER_STARTS = rf"(?=[0-9])(?:(?<![\p{{L}}\p{{N}}.,:/])|(?<=[^0-9][.,:/]))|(?<![\p{{L}}\p{{N}}\x01\x04])(?=(?:{_WORDS})(?![\p{{L}}\p{{N}}]))"


def marked(text: Column) -> Column:
    """The lower-cased text with a mark before each name, number and unit; a name or number of several words is one.

    A capitalised word is a name wherever it stands, as names begin sentences
    too; capitalised words in a row, particles between them included, are one.
    Numbers are written in digits, their groups set apart by spaces or not, or in words.
    """
    t = F.coalesce(text, F.lit(""))
    held = t.contains(NAME) | t.contains(NUMBER) | t.contains(UNIT) | t.contains(JOIN)
    t = F.when(held, F.regexp_replace(t, r"[\x01-\x04]", " ")).otherwise(t)
    t = F.regexp_replace(t, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}])", NAME)
    t = F.regexp_replace(t, rf"(\x01\p{{L}}++) ({'|'.join(PARTICLES)}) \x01", f"$1{JOIN}$2 {NAME}")
    t = F.regexp_replace(t, r"((?:\x01|\G(?!^))[\p{L}\x04]++) \x01", f"$1{JOIN}")
    t = F.regexp_replace(F.lower(t), _NUMBER_STARTS, NUMBER)
    t = F.regexp_replace(t, r"(?:(?=\x02)|\G(?!^))(\x02[0-9]{1,3}|\G(?!^)[0-9]{3}|(?:\x02|\G(?!^))[a-z]++) \x02(?=[0-9]{3}(?![0-9\p{L}])|[a-z])", f"$1{JOIN}")
    return F.regexp_replace(t, rf"(\x02(?:[0-9\x04][0-9.,:/\x04]*|[a-z\x04]++)) ?({'|'.join(UNITS)})(?=\s|$)", f"$1 {UNIT}$2")


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, BETWEEN), "")


def template(line: Column) -> Column:
    """The marked text with the values behind the marks left out; it has the same tokens."""
    return F.regexp_replace(line, r"([\x01-\x03])[\p{L}\p{N}\x04]*(?:(?<=[0-9])[.,:/][0-9][\p{L}\p{N}\x04]*)*", "$1")


def windows_of(documents: DataFrame, sizes: list[int], wanted: Column | None = None) -> DataFrame:
    """``documents`` with ``_win``: array of (size, pos, hash, raw, rich) over windows of so many template tokens; rich ones have enough literal tokens.

    ``wanted`` is a filter on hashes that is applied before the windows' own
    tokens are copied. Explode the result with explode_outer: for a plain
    explode the optimizer would infer a filter on the array and evaluate the
    whole expression again, inside its own lambdas, to push it to the scan.
    """
    own = documents.withColumn("_line", marked(F.col("text"))).withColumn("_tok", _tokens(template(F.col("_line"))))
    own = own.withColumn("_h", F.transform("_tok", lambda x: F.xxhash64(x)))
    hits = []
    for size in sizes:
        name = f"_all{size}"
        hashes = F.transform(F.sequence(F.lit(0), F.size("_h") - size), lambda i: F.xxhash64(F.lit(size), F.slice("_h", i + 1, F.lit(size))))  # noqa: B023
        own = own.withColumn(name, F.when(F.size("_h") >= size, hashes).otherwise(F.array().cast("array<bigint>")))
        positions = F.sequence(F.lit(0), F.size(name) - 1)
        held = F.filter(positions, lambda i: _in_filter(F.get(name, i), wanted)) if wanted is not None else positions  # noqa: B023
        places = F.when(F.size(name) > 0, held).otherwise(F.array().cast("array<int>"))
        hits.append(F.transform(places, lambda i: F.struct(F.lit(size).alias("size"), i.alias("pos"), F.get(name, i).alias("hash"))))  # noqa: B023
    own = own.withColumn("_hit", F.concat(*hits))
    own = own.withColumn("_raw", F.when(F.size("_hit") > 0, _tokens(F.col("_line"))))
    full = F.transform("_hit", lambda x: F.struct(x["size"].alias("size"), x["pos"].alias("pos"), x["hash"].alias("hash"), F.slice("_raw", x["pos"] + 1, x["size"]).alias("raw")))
    rich = lambda x: F.size(F.filter(x["raw"], lambda w: F.ascii(w) > 3)) >= F.least(F.lit(LEAST_LITERAL), x["size"])
    full = F.transform(full, lambda x: F.struct(*[x[c].alias(c) for c in ("size", "pos", "hash", "raw")], rich(x).alias("rich")))
    # Named twice, _raw is computed once for a row; named only inside the lambda, the optimizer would move it in there.
    return own.withColumn("_win", F.when(F.size("_raw") > 0, full)).drop("_line", "_tok", "_h", "_hit", "_raw", *[f"_all{size}" for size in sizes])


def _in_filter(h: Column, words: Column) -> Column:
    at = h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("bigint"))
    word = F.get(words, F.shiftright(at, 6).cast("int"))
    return F.call_function("getbit", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def _filter_words(windows: DataFrame) -> Column:
    """The filter's 2**FILTER_BITS bits as a literal array; its size is fixed, whatever the benchmark's."""
    at = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("bigint"))
    bits = windows.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).alias("bit"))
    held = {r[0]: r[1] for r in bits.groupBy("word").agg(F.bit_or("bit")).collect()}
    signed = (held.get(k, 0) for k in range(1 << (FILTER_BITS - 6)))
    return F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in signed) + ")")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_k1, _k2, item_id, n_matched, n_windows, changed): which text holds which benchmark item.

    Texts are named by a hash, so repeated rows and null ids do no harm. An
    item counts as held if COVERAGE of its rich windows are found in places where
    every value of the item stands for one value of the text: the alignment with most windows counts if its
    values are consistent, and any further one whose values agree with those counted so far;
    or if COVERAGE of all its windows are found word for word. An item without
    a rich window is held if its whole template is found in a row, with values
    as above. changed tells whether a value differs. Items of under WINDOW tokens are one window of
    their own length; items without a token, or null, are never found; an item that is listed twice counts once.
    """
    scratch = Scratch(documents.sparkSession)
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    items = items.withColumn("_size", F.least(F.size(_tokens(template(marked(F.col("text"))))), F.lit(WINDOW)))
    sizes = sorted(r[0] for r in items.select("_size").distinct().collect() if r[0] > 0)
    if not sizes:
        kinds = {"_k1": "bigint", "_k2": "int", "item_id": "bigint", "n_matched": "bigint", "n_windows": "bigint", "changed": "boolean"}
        return documents.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    # Without case there are no names, so copies in another case are met by a second form of the item. Each form of each text counts by itself.
    forms = F.array(F.struct(F.lit(0).alias("n"), "text"), F.struct(F.lit(1).alias("n"), F.lower("text").alias("text")))
    forms = items.where("_size > 0").select("item_id", F.explode(F.when(marked(F.col("text")) == marked(F.lower("text")), F.slice(forms, 1, 1)).otherwise(forms)).alias("f"), F.xxhash64("text").alias("form"))
    forms = forms.select("item_id", F.xxhash64("form", "f.n").alias("form"), "f.text").withColumn("_size", F.least(F.size(_tokens(template(marked(F.col("text"))))), F.lit(WINDOW)))
    own = windows_of(forms, list(range(1, WINDOW + 1)) if min(sizes) < WINDOW else sizes).select("item_id", "_size", "form", F.explode_outer("_win").alias("w")).where("w.size = _size")
    own = scratch.put(own.select("item_id", "form", F.col("w.pos").alias("item_pos"), F.col("w.hash").alias("hash"), F.col("w.raw").alias("item_raw"), F.col("w.rich").alias("rich"), "_size").distinct())
    sizes = sorted(r[0] for r in own.select("_size").distinct().collect())
    own = own.drop("_size")
    rows = own.count()
    hits = windows_of(documents.select("text", *text_key(F.col("text"))), sizes, _filter_words(own)).select("_k1", "_k2", F.explode_outer("_win").alias("w")).where("w is not null")
    hits = hits.select("_k1", "_k2", F.col("w.pos").alias("pos"), F.col("w.hash").alias("hash"), F.col("w.raw").alias("raw"))
    total = own.groupBy("item_id", "form").agg(F.count("*").alias("n_all"), F.count_if("rich").alias("n_rich"))
    own, total = (F.broadcast(own), F.broadcast(total)) if rows <= BROADCAST_ROWS else (own, total)
    met = hits.join(own, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    slots = F.filter(F.arrays_zip(F.col("item_raw").alias("b"), F.col("raw").alias("d")), lambda x: F.ascii(x["b"]) <= 3)
    met = met.select("_k1", "_k2", "item_id", "form", "item_pos", "shift", "rich", (F.col("raw") == F.col("item_raw")).alias("plain"), slots.alias("slots"))
    by_shift = met.groupBy("_k1", "_k2", "item_id", "form", "shift").agg(
        F.collect_set("item_pos").alias("at"),
        F.collect_set(F.when(F.col("rich"), F.col("item_pos"))).alias("rich_at"),
        F.collect_set(F.when(F.col("plain"), F.col("item_pos"))).alias("plain_at"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    run = F.struct(F.size("rich_at").alias("n_rich"), F.size("at").alias("n"), (-F.col("shift")).alias("shift"), "at", "rich_at", "slots")
    by_item = by_shift.groupBy("_k1", "_k2", "item_id", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("plain_at")))).alias("n_plain"),
        F.sort_array(F.collect_list(F.when(_steady(F.col("slots")), run)), asc=False).alias("runs"),
        F.max("slots").alias("any_slots"),
    )
    held = F.aggregate(
        F.when(F.size("runs") > 0, F.slice("runs", 2, F.size("runs"))).otherwise(F.col("runs")),
        F.struct(F.coalesce(F.get("runs", F.lit(0))["at"], F.array().cast("array<int>")).alias("at"), F.coalesce(F.get("runs", F.lit(0))["rich_at"], F.array().cast("array<int>")).alias("rich_at"), F.coalesce(F.get("runs", F.lit(0))["slots"], F.slice("any_slots", 1, 0)).alias("slots")),
        lambda a, x: F.when(
            _steady(F.array_union(a["slots"], x["slots"])),
            F.struct(F.array_union(a["at"], x["at"]).alias("at"), F.array_union(a["rich_at"], x["rich_at"]).alias("rich_at"), F.array_union(a["slots"], x["slots"]).alias("slots")),
        ).otherwise(a),
    )
    by_item = by_item.select("_k1", "_k2", "item_id", "form", "n_plain", F.coalesce(F.get("runs", F.lit(0))["n"], F.lit(0)).alias("n_run"), held.alias("held")).join(total, ["item_id", "form"])
    by_item = by_item.withColumns({"n_any": F.size("held.at"), "n_rich_at": F.size("held.rich_at")})
    plain = F.col("n_plain") >= COVERAGE * F.col("n_all")
    # An item without a rich window is held if all of its template is found in a row.
    like = F.when(F.col("n_rich") > 0, F.col("n_rich_at") >= COVERAGE * F.col("n_rich")).otherwise(F.col("n_run") == F.col("n_all"))
    one = by_item.where(like | plain)
    by_rich = like & (F.col("n_rich") > 0)
    n_matched = F.when(by_rich, F.col("n_rich_at")).when(like, F.col("n_any")).otherwise(F.col("n_plain"))
    changed = like & F.exists("held.slots", lambda x: x["b"] != x["d"])
    windows = F.when(by_rich, F.col("n_rich")).otherwise(F.col("n_all"))
    row = F.struct(n_matched.cast("bigint").alias("n_matched"), windows.alias("n_windows"), changed.alias("changed"))
    best = one.groupBy("_k1", "_k2", "item_id").agg(F.max_by(row, F.struct(n_matched / windows, ~changed, n_matched)).alias("r"))
    return scratch.put(best.select("_k1", "_k2", "item_id", "r.*"))


def _steady(slots: Column) -> Column:
    """Each value of the item stands for one value of the text."""
    return F.size(F.array_distinct(F.transform(slots, lambda x: x["b"]))) == F.size(slots)


def per_text(found: DataFrame) -> DataFrame:
    """One row for each text that holds an item; its items in order, the best coverage, whether any was changed."""
    return found.groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max(F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        F.max("changed").alias("changed"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark item. Clean rows stay, repeated and null ones too, with columns of any name."""
    found = per_text(leaks(documents, benchmark)).select("_k1", "_k2")
    own = documents.select(F.struct(*documents.columns).alias("_row"), *text_key(F.col("text")))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return own.join(found, ["_k1", "_k2"], "left_anti").select("_row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = per_text(leaks(documents, table(spark, sf_dir, "benchmark")))
    own = documents.select("doc_id", *text_key(F.col("text")))
    return own.join(found, ["_k1", "_k2"], "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
    )
