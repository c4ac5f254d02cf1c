"""Chat formatting: layouts recognised by a hash of their field paths, one template, exact reading back."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted paths of the leaf fields, ``[]`` standing for an array's elements."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A declarative mapping from one layout of fields to turns.

    rows: the columns (key, order, role, text) of a table with a row for each
    turn; items: (array, role, text) of nested messages; turns: (role, field)
    in their order, a field being left out where it is null.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("prompt and response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system prompt", ("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
BY_FINGERPRINT = {fingerprint(list(x.paths)): x for x in LAYOUTS}

#: Names of roles in other layouts, and what they are here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def rivals(layout: Layout) -> list[Layout]:
    """The layouts that say something which ``layout`` leaves out: where one of them fits too, it is not the layout."""
    return [x for x in LAYOUTS if not set(x.paths) <= set(layout.paths)]


def select_layout(schema: T.StructType, key: str | None) -> Layout:
    """The mapping whose fingerprint the schema has, the key column and unrelated ones left out.

    Extra columns do not matter: a layout fits if its fingerprint is that of
    the paths which the schema shares with it, and of layouts that fit the one that holds all others is taken. An unknown
    layout raises ValueError, and so do two that fit with neither holding the other (a prompt with a response and
    a completion, say), as either would drop texts of the other.
    """
    paths = [p for p in field_paths(schema) if p != (key or "").lower() or "turn" in field_paths(schema)]
    if found := BY_FINGERPRINT.get(fingerprint(paths)):
        return found
    fitting = [x for x in LAYOUTS if fingerprint(list(set(x.paths) & set(field_paths(schema)))) == fingerprint(list(x.paths))]
    if not fitting:
        raise ValueError(f"no layout has the fields {paths}")
    whole = [x for x in fitting if not any(y in fitting for y in rivals(x))]
    if not whole:
        raise ValueError(f"the fields {paths} fit several layouts: {', '.join(x.name for x in fitting)}")
    return whole[0]


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) in canonical roles, whatever the layout.

    Roles in a table of turn rows are kept as they are; nested layouts' own
    names for roles are mapped by ROLES. A conversation is one row of the
    result, so its turns meet in one task, which holds one conversation at a time.

    Turns that are rows are put in order of turn (null first); rows that
    repeat a turn stand side by side in order of role and text. A null text
    or role is empty; rows with a null key form one conversation. An array or
    element that is null gives no turn.
    """
    layout = select_layout(df.schema, key)
    if layout.rows:
        own, order, role, text = layout.rows
        one = F.struct(F.col(order).alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
        grouped = df.groupBy(F.col(own).alias(key)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
        return grouped.select(key, F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if layout.items:
        name, role, text = layout.items
        items = F.filter(F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)), lambda x: x.isNotNull())
        turns = F.transform(items, lambda x: F.struct(_role(x[role]).alias("role"), _text(x[text]).alias("text")))
    else:
        turns = F.filter(
            F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text"))) for r, f in layout.turns]),
            lambda x: x.isNotNull(),
        )
    return df.select(F.col(key), turns.cast(TURNS).alias("turns"))


def json_paths(column: str) -> Column:
    """Field paths of a JSON text as ``field_paths`` gives them for a schema: its keys, and in place of an array of messages the keys of all its elements.

    Keys count as they are written. Null where the text is no JSON object.
    """
    keys = F.json_object_keys(column)
    arrays = sorted({x.items[0] for x in LAYOUTS if x.items})
    inner = []
    for name in arrays:
        elements = F.from_json(column, f"`{name}` array<string>")[name]
        fields = F.array_distinct(F.flatten(F.transform(F.filter(elements, lambda e: e.isNotNull()), lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>")))))
        inner.append(F.coalesce(F.transform(fields, lambda f: F.concat(F.lit(f"{name}[]."), f)), F.array().cast("array<string>")))  # noqa: B023
    return F.concat(F.array_except(keys, F.array(*[F.lit(n) for n in arrays])), *inner)


def from_json_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, turns) from JSON texts of mixed layouts: a hash of each row's own field paths selects its mapping.

    Paths that no layout has are left out before the hash, so further keys do not matter; of several layouts that a row's paths
    contain, the one that holds all others is taken. A text that is no JSON object, or whose paths, inner ones too, make no layout
    or two of which neither holds the other, gives null turns. Elements that are no objects give no turn; a field that is null or missing in some elements is empty.
    A text that is itself an array or object (a message's content in parts, say) is kept as its JSON text.
    """
    own = df.select(key, F.col(column).alias("_raw"), json_paths(column).alias("_paths"))
    nested = [x for x in LAYOUTS if not x.rows]

    def fits(x: Layout) -> Column:
        held = F.array_intersect("_paths", F.array(*[F.lit(p) for p in sorted(x.paths)]))
        return F.substring(F.sha2(F.array_join(F.array_sort(held), "\n"), 256), 1, 16) == fingerprint(list(x.paths))

    own = own.withColumn("_fits", F.struct(*[fits(x).alias(x.name) for x in nested]))
    out = None
    for x in nested:
        test = F.col("_fits")[x.name]
        for y in rivals(x):
            test = test if y.rows else test & ~F.col("_fits")[y.name]
        if x.items:
            name, role, text = x.items
            elements = F.filter(F.from_json("_raw", f"`{name}` array<string>")[name], lambda e: F.json_object_keys(e).isNotNull())
            turns = F.transform(elements, lambda e: F.struct(_role(F.get_json_object(e, f"$.{role}")).alias("role"), _text(F.get_json_object(e, f"$.{text}")).alias("text")))  # noqa: B023
        else:
            parts = [F.when(F.get_json_object("_raw", f"$.{f}").isNotNull(), F.struct(F.lit(r).alias("role"), F.get_json_object("_raw", f"$.{f}").alias("text"))) for r, f in x.turns]
            turns = F.filter(F.array(*parts), lambda i: i.isNotNull())
        turns = turns.cast(TURNS)
        out = F.when(test, turns) if out is None else out.when(test, turns)
    return own.select(key, out.alias("turns"))


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[role], role, F.lit(""))


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    """A role ends at the first line end, so its own are written as ``\\e``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\e"))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\e", "$1\n"), r"\\([\\|])", "$1")


def format_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): the conversation in the template, and the loss mask.

    loss is an array of (start, length) in code points over the escaped
    assistant texts, in order; the mask covers the text alone, not the marks.
    """
    piece = F.transform(
        "turns",
        lambda x: F.struct(
            F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"] == F.lit("assistant")).alias("loss"),
        ),
    )
    made = df.select(key, piece.alias("p"))
    return made.select(
        key,
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        _mask("p").alias("loss"),
    )


#: Turns whose starts are summed together; a conversation's are summed in blocks of so many, then over blocks.
BLOCK = 256


def _mask(pieces: str) -> Column:
    """Starts are running sums, taken in two levels so that the work stays near linear in the number of turns."""
    size = f"length(x.head) + length(x.body) + {len(END)}"
    blocks = f"transform(sequence(0, greatest(size({pieces}) - 1, 0) div {BLOCK}), b -> slice({pieces}, b * {BLOCK} + 1, {BLOCK}))"
    inner = (
        f"transform({blocks}, g -> aggregate(g, named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,length:bigint>>)), "
        f"(a, x) -> named_struct('at', a.at + {size}, 'out', case when x.loss then "
        "concat(a.out, array(named_struct('start', a.at + length(x.head), 'length', cast(length(x.body) as bigint)))) else a.out end)))"
    )
    return F.expr(
        f"aggregate({inner}, named_struct('at', 0L, 'out', cast(array() as array<array<struct<start:bigint,length:bigint>>>)), "
        "(a, g) -> named_struct('at', a.at + g.at, 'out', concat(a.out, array(transform(g.out, s -> named_struct('start', a.at + s.start, 'length', s.length))))), "
        "a -> flatten(a.out))"
    )


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, turns, loss_texts) from ``formatted`` and ``loss`` alone.

    The text is split at its end marks, which no escaped text contains, so
    it is read once however long it is. What is under the loss is told by the
    mask, not by roles: spans and pieces are put in one order by their starts, and a span
    that begins where a piece's text does and has its length is that text; any other
    span is cut out of the formatted text.
    """
    cut = F.split("formatted", r"<\|im_end\|>\n")
    split = df.select(key, "formatted", "loss", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))).alias("cut"))
    pieces = F.transform("cut", lambda x: F.struct(F.concat(F.substring_index(x, "\n", 1), F.lit("\n")).alias("head"), F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2).alias("body"), F.lit(True).alias("loss")))
    split = split.select(key, "formatted", "loss", pieces.alias("p")).withColumn("own", _mask("p"))
    marks = (
        "array_sort(concat(transform(loss, s -> named_struct('at', s.start, 'kind', 0, 'n', s.length, 'body', '')), "
        "transform(own, (s, i) -> named_struct('at', s.start, 'kind', 1, 'n', s.length, 'body', get(p, i).body))))"
    )
    split = split.withColumn("m", F.expr(marks))
    texts = (
        "transform(filter(sequence(0, greatest(size(m) - 1, 0)), i -> get(m, i).kind = 0), i -> "
        "case when get(m, i + 1).kind = 1 and get(m, i + 1).at = get(m, i).at and get(m, i + 1).n = get(m, i).n then get(m, i + 1).body "
        "else substr(formatted, int(get(m, i).at) + 1, int(get(m, i).n)) end)"
    )
    return split.select(
        key,
        "formatted",
        F.transform("p", lambda x: F.struct(_unescape_role(F.substr(x["head"], F.lit(len(START) + 1), F.length(x["head"]) - len(START) - 1)).alias("role"), unescape(x["body"]).alias("text"))).alias("turns"),
        F.transform(F.expr(texts), unescape).alias("loss_texts"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    back = read_back(format_turns(canonical(rows.unionByName(extra))))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
