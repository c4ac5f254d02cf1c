"""Quality rules: statistics of a text, and a decision list learned from labelled ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table, texts_of, words

#: At most so many labelled documents train the list.
SAMPLE_ROWS = 20_000
#: What a rule's share of bad documents must reach among those it was not grown on.
PRECISION = 0.98
#: Cut points tried for each feature.
CUTS = 24
MAX_RULES, MAX_CONDITIONS, MIN_COVER = 12, 4, 8

FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "bare_share", "line_words"]


#: Words from which windows are sorted by whole hashes and not by ones packed with their position.
LONG_TEXT = 20_000


def _repeated() -> Column:
    """Positions, in order, of the 3-word windows of ``_w`` that occur twice or more.

    Windows are sorted by hash, packed with the position in one integer or, in a text of over
    LONG_TEXT words, as whole 64 bits beside it; neighbours of equal hash are compared word for word.
    """
    window = "xxhash64(get(_w, int(i)), get(_w, int(i) + 1), get(_w, int(i) + 2))"
    places = "transform(sequence(0L, _n - 3), i -> {})"
    packed = "sort_array(" + places.format(f"pmod({window}, 9223372036854775807 div _n) * _n + i") + ")"
    whole = "array_sort(" + places.format(f"named_struct('h', {window}, 'i', i)") + ")"
    same = " and ".join(f"get(_w, int({{0}}) + {k}) = get(_w, int({{1}}) + {k})" for k in range(3))

    def again(rows: str, hash_of: str, at: str) -> str:
        def meets(j: str) -> str:
            x, y = "get(s, k)", f"get(s, {j})"
            return f"({hash_of.format(x)} = {hash_of.format(y)} and {same.format(at.format(x), at.format(y))})"

        found = f"filter(sequence(0, size(s) - 1), k -> (k > 0 and {meets('k - 1')}) or (k < size(s) - 1 and {meets('k + 1')}))"
        # One element: the sorted array has a name, and is made once.
        return f"sort_array(flatten(transform(array({rows}), s -> transform({found}, k -> {at.format('get(s, k)')}))))"

    return F.expr(
        f"case when _n > {LONG_TEXT} then {again(whole, '{}.h', '{}.i')} when _n > 3 then {again(packed, '({} div _n)', '({} % _n)')} else cast(array() as array<bigint>) end"
    )


def _counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """(_row, _q): each whole row, and the counts of its text."""
    base = documents.select(F.struct(*documents.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_w", words(F.col("_t")))
    base = base.withColumn("_n", F.size("_w").cast("bigint"))
    base = base.withColumn("_r", _repeated())
    covered = F.expr("case when size(_r) = 0 then 0L else aggregate(sequence(1, size(_r)), 0L, (s, i) -> s + least(3L, coalesce(get(_r, i) - get(_r, i - 1), 3L))) end")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("_l", lines)
    count_of = lambda cls: F.length(F.regexp_replace("_t", f"[^{cls}]+", "")).cast("bigint")
    # Through the explode no later filter on these counts is pushed down, where it would be evaluated again inside the lambdas above.
    return base.select(
        "_row",
        F.explode_outer(F.array(F.struct(
            F.col("_n").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
            count_of(r"#*$%&|<>").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_l").cast("bigint").alias("n_lines"),
            count_of("A-Z").alias("n_upper"),
            count_of("!?").alias("n_marks"),
            F.size(F.filter("_w", lambda x: F.length(x) == 1)).cast("bigint").alias("n_bare"),
        ))).alias("_q"),
    )


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` and a struct ``_q`` of whole-text counts, in one row-local pass of built-in functions.

    n_repeat_words counts the words in any 3-word window whose words occur
    twice or more in the text. A null text is empty. Columns of any name but ``_q`` do no harm.
    """
    return _counted(documents, text).select("_row.*", "_q")


def feature_columns() -> dict[str, Column]:
    """The features a rule may test, each a double; 0 where a text has no word."""
    q = lambda name: F.col(f"_q.{name}").cast("double")
    share = lambda a, b: F.when(q(b) > 0, q(a) / q(b)).otherwise(F.lit(0.0))
    return {
        "n_words": q("n_words"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "bare_share": share("n_bare", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > F.lit(self.cut) if self.above else features[self.feature] <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def learn_rules(rows: list[tuple[dict[str, float], bool]], precision: float = PRECISION) -> list[Rule]:
    """Sequential covering: rules that single out the bad rows, in the order they were found.

    Each round grows a conjunction on two thirds of what no earlier rule
    covers, by the gain of FOIL, drops conditions from its end while that
    does not lower (p - n) / (p + n) on the last third, and ends when a rule
    falls short of ``precision`` there. Every third row prunes, so equal
    input gives equal rules. No bad row: no rule.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < MAX_RULES:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        if sum(bad for _, bad in grow) < MIN_COVER:
            break
        rule = _prune(_grow(grow), prune)
        hit = [bad for row, bad in left if all(c.holds(row) for c in rule)]
        held = [bad for row, bad in prune if all(c.holds(row) for c in rule)]
        if not rule or len(hit) < MIN_COVER or sum(hit) < precision * len(hit) or sum(held) < precision * len(held):
            break
        rules.append(rule)
        left = [(row, bad) for row, bad in left if not all(c.holds(row) for c in rule)]
    return rules


def _grow(rows: list[tuple[dict[str, float], bool]]) -> Rule:
    import numpy as np

    values = np.array([[row[f] for f in FEATURES] for row, _ in rows])
    bad = np.array([b for _, b in rows])
    live = np.ones(len(rows), bool)
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        if n0 == 0 or p0 == 0:
            break
        best = (1e-9, None, None)
        for k, feature in enumerate(FEATURES):
            column = values[:, k]
            points = np.unique(np.concatenate((np.quantile(column[live & bad], np.linspace(0, 1, CUTS)), np.quantile(column[live & ~bad], np.linspace(0, 1, CUTS)))))
            cuts = (points[:-1] + points[1:]) / 2 if len(points) > 1 else points
            for cut in cuts.tolist():
                over = column > cut
                for above in (True, False):
                    now = live & (over if above else ~over)
                    p, n = int((now & bad).sum()), int((now & ~bad).sum())
                    if p >= MIN_COVER:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Condition(feature, above, cut), now)
        if best[1] is None:
            break
        rule.append(best[1])
        live = best[2]
    return tuple(rule)


def _prune(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    def worth(part: Rule) -> float:
        hit = [bad for row, bad in rows if all(c.holds(row) for c in part)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules learned from at most ``bound`` labelled documents (quality 0 is bad).

    Of a doc_id with several texts the least statistics count, so the rules do not depend on the order of rows and no repeated id passes the bound.
    """
    sample = labelled_sample(documents.sparkSession, labels, F.col("quality").isNotNull(), bound, ["quality"])
    found = with_statistics(texts_of(documents, sample).select("doc_id", "text", "quality"))
    features = F.struct(*[c.alias(n) for n, c in feature_columns().items()])
    rows = found.select("doc_id", "quality", features.alias("f")).groupBy("doc_id", "quality").agg(F.min("f").alias("f")).select("doc_id", "quality", "f.*").collect()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    return learn_rules([({f: r[f] for f in FEATURES}, r["quality"] == 0) for r in rows])


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids, so that growing and pruning rows are mixed alike whatever the ids' order."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    features = feature_columns()
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(features)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with ``_q`` and ``_kept``.

    A null text has no words and fails. A repeated row is judged like its
    twin. Without labels the list is empty and the fixed rule alone decides.
    """
    return with_statistics(documents).withColumn("_kept", ~base_failed() & verdict(fit(documents, labels)))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the fixed rule and the learned list keep, whatever their columns' names."""
    return _counted(documents).where(~base_failed() & verdict(fit(documents, labels))).select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in counts], base_failed().alias("base_failed"), F.col("_kept").alias("kept"))
