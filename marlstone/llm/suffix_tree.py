"""Language-model scores from a probabilistic suffix tree over words.

The root is a unigram model of every training token. Contexts grow from it word
by word, as far as the corpus bears them: a context that occurs LEAST_CONTEXT times
and lengthens a state becomes a state itself if its next-symbol distribution diverges from
that of its suffix, as seen in the symbols that followed it LEAST_COUNT times. A
state lists the symbols whose probability it changes and leaves the rest to its
suffix. A text is scored from the longest state that its last words end with.

Both floors are numbers of occurrences, so states and symbols grow with the corpus,
and so does their depth; growth ends at the first depth without a state.
A token's log probability is a sum over the word strings that end with it: for each
state its log weight left to the suffix, for each listed symbol what it adds to
that. So the tree is a table of values by the hash of a word string, and a
text's score a sum of looked-up values. The SENT most frequent strings and words
go along with every task; the others are asked for by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import Scratch, bounded_batches, table
from .hashing import batch_words, joined_hashes, mixed, pair_hashes

#: At most so many words and so many strings, of 16 bytes each and the most frequent, are sent to every task; the others are asked for. The scores do not depend on it.
SENT = 1_000_000, 2_000_000
#: Fewer occurrences than this of a symbol after a context are no evidence, in a corpus of any size.
LEAST_COUNT = 5
#: The same for a context.
LEAST_CONTEXT = 20
#: A symbol is listed if its probability changes by this factor at least,
RATIO = 1.5
#: and a state is kept if its listed symbols bring this divergence, in nats for each use.
DIVERGENCE = 0.02
#: Bits of a filter on string hashes, as a power of two, at most; it spares rows a shuffle and leaves none out.
FILTER_BITS = 28
#: Rows that a counting task adds up before it sends, and tokens of the texts that are scored together.
HELD, CHUNK = 2_000_000, 1_000_000

#: Stands for the end of a text; no word holds a space.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
#: Kinds of blobs while texts are scored: asked for and answered, of words and of strings, and the texts themselves.
WORDS, STRINGS, ASK_WORDS, ASK_STRINGS, TEXTS = range(5)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a batch's tokens, each text's words and then END, and how many each text has."""
    words, n = batch_words(column)
    return np.insert(words, np.cumsum(n), END), n + 1


def places_of(n: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def strings_of(tokens: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to depth + 1, the hashes of the strings of so many tokens, and the index of the last token of each.

    The hash of a string is that of its two parts without the last and without the first token.
    """
    hashes, at = tokens, np.arange(len(tokens))
    yield hashes, at
    for k in range(1, depth + 1):
        hashes = pair_hashes(hashes)
        inside = place[k:] >= k
        yield hashes[inside], np.flatnonzero(inside) + k


def is_training() -> Column:
    """crc32 of doc_id as text, modulo 5, is not 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rows of equal key added up: (key, columns, n) in order of the key, which is the column or the hash of both."""
    key = columns[0] if len(columns) == 1 else joined_hashes(*columns)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(key) else n


def counted(texts: DataFrame, keys_of: Callable, names: tuple[str, ...], least: int, parts: int) -> DataFrame:
    """(key, *names, n): how often each key occurs, where that is ``least`` times at least.

    ``keys_of(tokens, place)`` gives one column of hashes, the key itself, or two, whose joined hash is the key. A task
    adds up before it sends; what it sends is cut by the key's hash, so no part depends on how often a key occurs.
    """
    bounded_batches(texts.sparkSession)
    width, most = max(len(names), 1), HELD

    def sent(columns: list[np.ndarray], n: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        return blobs.batches_of(blobs.dealt(blobs.part_of(key, parts), 0, *columns, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, np.uint64)] * width, np.empty(0, np.int64)
        (columns, n), held, rows = none, [], 0
        key = np.empty(0, np.uint64)
        for b in batches:
            tokens, sizes = tokens_of(b.column(0))
            held.append(keys_of(tokens, places_of(sizes)))
            rows += len(held[-1][0])
            if rows > most:
                key, columns, n = _summed([np.concatenate(c) for c in zip(columns, *held)], np.concatenate((n, np.ones(rows, np.int64))))
                held, rows = [], 0
                if len(n) > most:
                    yield from sent(columns, n, key)
                    columns, n = none
        key, columns, n = _summed([np.concatenate(c) for c in zip(columns, *held)], np.concatenate((n, np.ones(rows, np.int64))))
        yield from sent(columns, n, key)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gathered(batches)
        if not found:
            return
        key, columns, n = _summed(found[0][:-1], found[0][-1])
        enough = n >= least
        out = [x[enough].view(np.int64) for x in (key, *(columns if names else []), n)]
        for k in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in out], names=["key", *names, "n"])

    made = blobs.met(texts.select("text").mapInArrow(count, blobs.SHAPE), parts)
    return made.mapInArrow(add, ", ".join(f"{c} bigint" for c in ("key", *names, "n")))


def filter_of(table_: DataFrame) -> np.ndarray:
    """Bits that are set for every key of the table, and for few others."""
    bits = min(max((16 * table_.count()).bit_length(), 16), FILTER_BITS)
    at = F.shiftrightunsigned("key", 64 - bits)
    rows = table_.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")))).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def lookup(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 where it is not; keys are looked up in order, which spares the cache."""
    out = np.full(len(keys), -1)
    if len(table_):
        order = np.argsort(keys)
        held = keys[order]
        at = np.minimum(np.searchsorted(table_, held), len(table_) - 1)
        hit = table_[at] == held
        out[order[hit]] = at[hit]
    return out


def floor_of(rows: DataFrame, most: int) -> int:
    """A least n that at most ``most`` rows reach, from counts of rows by the upper bits of n."""
    bits = F.greatest(F.lit(0), F.length(F.conv(F.col("n").cast("string"), 10, 2)) - 8).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), bits), bits)
    held, floor = 0, None
    for n, rows_ in sorted(rows.groupBy(low).count().collect(), reverse=True):
        held += rows_
        if held > most:
            return n + 1 if floor is None else floor
        floor = n
    return 0


def _sorted(found: pa.Table) -> list[np.ndarray]:
    """The columns of (key, value) in order of the unsigned key."""
    key, value = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(key)
    return [key[order], value[order]]


@dataclass
class Tree:
    """What every task gets: totals, frequent words with counts, frequent strings with values, and a filter of all strings."""

    total: int
    distinct: int
    depth: int
    words: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    known: np.ndarray

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


@dataclass
class Rest:
    """What is too much to send: tables (key, n) of the other words and (key, value) of the other strings."""

    words: DataFrame
    strings: DataFrame


def fit(training: DataFrame, scratch: Scratch) -> tuple[Tree, Rest, DataFrame]:
    """The tree of all rows of ``training`` (text): what goes to every task, the rest, and its states (key, n, depth, back)."""
    spark = training.sparkSession
    unigrams = scratch.put(counted(training, lambda tokens, place: [tokens], (), 1, blobs.parts_for(spark)))
    total, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts, zero = blobs.parts_for(spark, total), F.lit(0.0)
    # Strings of a state and a symbol after it, with the log10 probability that the tree so far gives to that symbol.
    level = unigrams.where(F.col("n") >= LEAST_COUNT).select("key", "n", F.log10((F.col("n") + 0.5) / float(total + 0.5 * (distinct + 1))).alias("log"), F.lit(True).alias("open"))
    values = level.select("key", "n", F.lit(0.0).alias("value")).limit(0)
    states = level.select("key", "n", F.lit(0).alias("depth"), zero.alias("back")).limit(0)
    depth = 0
    while True:
        symbols, contexts = level.where("open").select(F.col("key").alias("suffix"), F.col("log").alias("q")), level.where(F.col("n") >= LEAST_CONTEXT).select(F.col("key").alias("ctx"), F.col("n").alias("total"))
        keys_of = _followed(depth + 1, filter_of(contexts.withColumnRenamed("ctx", "key")), filter_of(symbols.withColumnRenamed("suffix", "key")))
        grams = scratch.put(counted(training, keys_of, ("ctx", "suffix"), LEAST_COUNT, parts))
        if not grams.head(1):
            break
        both = grams.join(symbols, "suffix").join(contexts, "ctx").withColumn("p", F.log10((F.col("n") - 0.5) / (F.col("total") + 1.0)))
        both = scratch.put(both.withColumn("listed", F.abs(F.col("p") - F.col("q")) >= float(np.log10(RATIO))))
        scratch.drop(grams)
        own = scratch.put(_states(both.where("listed")))
        if not own.head(1):
            break
        depth += 1
        listed = F.col("listed") & F.col("back").isNotNull()
        log = F.when(listed, F.col("p")).otherwise(F.col("q") + F.coalesce("back", zero))
        known_by = both.join(own.select("ctx", "back"), "ctx", "left")
        level = scratch.put(known_by.select("key", "n", log.alias("log"), (log - F.col("q") - F.coalesce("back", zero)).alias("more"), listed.alias("listed"), F.col("back").isNotNull().alias("open")))
        scratch.drop(both)
        own = own.select(F.col("ctx").alias("key"), F.col("total").alias("n"), F.lit(depth).alias("depth"), "back")
        states = states.union(own)
        values = values.union(own.select("key", "n", F.col("back").alias("value"))).union(level.where("listed").select("key", "n", F.col("more").alias("value")))
    model = scratch.put(values.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")))
    floors = [floor_of(rows, most) for rows, most in zip((unigrams.where(F.col("n") >= LEAST_COUNT), model), SENT)]
    floors[0] = max(floors[0], LEAST_COUNT)
    words = _sorted(unigrams.where(F.col("n") >= floors[0]).select("key", "n").toArrow())
    strings = _sorted(model.where(F.col("n") >= floors[1]).select("key", "value").toArrow())
    rest = Rest(unigrams.where(F.col("n") < floors[0]).select("key", "n"), model.where(F.col("n") < floors[1]).select("key", "value"))
    return Tree(total, distinct, depth, *words, *strings, filter_of(model)), rest, states


def _followed(depth: int, contexts: np.ndarray, symbols: np.ndarray) -> Callable:
    """(ctx, suffix) of strings of depth + 1 words: the context and, if it is one, the suffix' string with the symbol are known."""

    def keys_of(tokens: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        for part, at in strings_of(tokens, place, depth - 1):
            pass
        if len(part) < 2:
            return [part[:0]] * 2
        ok = (at[1:] == at[:-1] + 1) & (place[at[1:]] >= depth)
        ok[ok] = in_filter(contexts, part[:-1][ok])
        ok[ok] = in_filter(symbols, part[1:][ok])
        return [part[:-1][ok], part[1:][ok]]

    return keys_of


def _states(listed: DataFrame) -> DataFrame:
    """(ctx, total, back): contexts whose listed symbols bring enough divergence, with the log10 weight left to the suffix."""
    p, q = F.pow(F.lit(10.0), F.col("p")), F.pow(F.lit(10.0), F.col("q"))
    own = listed.groupBy("ctx").agg(F.max("total").alias("total"), F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * (F.col("p") - F.col("q"))).alias("d"))
    rest_p, rest_q = F.greatest(1 - F.col("p"), F.lit(1e-6)), F.greatest(1 - F.col("q"), F.lit(1e-6))
    back = F.log10(rest_p / rest_q)
    return own.where((F.col("d") + rest_p * back) * float(np.log(10)) >= DIVERGENCE).select("ctx", "total", back.alias("back"))


def _table_blobs(rows: DataFrame, kind: int, parts: int) -> DataFrame:
    """A table (key, value) as blobs, cut by its key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            key, value = (np.concatenate(c) for c in zip(*held))
            return blobs.batches_of(blobs.dealt(blobs.part_of(key, parts), kind, key, value))

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            n += b.num_rows
            if n > 1_000_000:
                yield from sent()
                held, n = [], 0
        if n:
            yield from sent()

    return rows.mapInArrow(each, blobs.SHAPE)


def _asked(own: DataFrame, tree: Tree, parts: int) -> DataFrame:
    """Blobs of what the sent part of the tree gives to each text, and of the words and strings still to be looked up.

    A text is named by its task and chunk and its index in the chunk. A
    word or string that a text holds several times is asked for once.
    """
    size = CHUNK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        texts, asks, n, tokens_held = [], ([], []), 0, 0

        def sent() -> Iterator[pa.RecordBatch]:
            def rows():
                columns = [np.concatenate(c) for c in zip(*texts)]
                name = np.full(n, chunk, np.int64)
                to = blobs.part_of(mixed(name.view(np.uint64)), parts)
                yield from blobs.dealt(to, TEXTS, name, np.arange(n, dtype=np.uint32), *columns)
                for kind, held in zip((ASK_WORDS, ASK_STRINGS), asks):
                    if held:
                        key, index = (np.concatenate(c) for c in zip(*held))
                        # Equal asks come together; where keys share their upper bits some may not, and stay apart.
                        bits = np.uint64(max(n.bit_length(), 1))
                        order = np.argsort((key >> bits << bits) | index)
                        key, index = key[order], index[order]
                        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (index[1:] != index[:-1])))) if len(key) else order
                        times = np.diff(np.append(first, len(key))).astype(np.uint32)
                        key, index = key[first], index[first]
                        yield from blobs.dealt(blobs.part_of(key, parts), kind, key, index, times, np.full(len(key), chunk, np.int64))

            return blobs.batches_of(rows())

        for b in batches:
            tokens, sizes = tokens_of(b.column(1))
            row = np.repeat(np.arange(b.num_rows), sizes)
            at = lookup(tree.words, tokens)
            known = at >= 0
            logs = np.full(len(tokens), tree.base_log(np.zeros(1))[0])
            logs[known] = tree.base_log(tree.counts[at[known]])
            base = np.bincount(row, logs, b.num_rows)
            asks[0].append((tokens[~known], (row[~known] + n).astype(np.uint32)))
            gain = np.zeros(b.num_rows)
            for keys, last in strings_of(tokens, places_of(sizes), tree.depth):
                near = np.flatnonzero(in_filter(tree.known, keys))
                keys, owner = keys[near], row[last[near]]
                at = lookup(tree.keys, keys)
                hit = at >= 0
                gain += np.bincount(owner[hit], tree.values[at[hit]], b.num_rows)
                asks[1].append((keys[~hit], (owner[~hit] + n).astype(np.uint32)))
            ids = b.column(0)
            flags = np.asarray(b.column(2)).astype(np.uint8) + 2 * np.asarray(ids.is_null()).astype(np.uint8)
            texts.append((ids.fill_null(0).to_numpy(), flags, sizes, np.bincount(row[known], minlength=b.num_rows), base, gain))
            n += b.num_rows
            tokens_held += len(tokens)
            if tokens_held > size:
                yield from sent()
                chunk, texts, asks, n, tokens_held = chunk + 1, [], ([], []), 0, 0
        if n:
            yield from sent()

    return own.mapInArrow(each, blobs.SHAPE)


def _answered(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What was asked for and is known, sent back to its chunk; texts go on to theirs."""
    found = blobs.gathered(batches)

    def rows():
        for kind, ask in ((WORDS, ASK_WORDS), (STRINGS, ASK_STRINGS)):
            if kind in found and ask in found:
                order = np.argsort(found[kind][0])
                key, value = (c[order] for c in found[kind])
                asked, index, times, chunk = found[ask]
                at = lookup(key, asked)
                hit = at >= 0
                columns = [c[hit] for c in (chunk, index, times)]
                yield from blobs.dealt(blobs.part_of(mixed(columns[0].view(np.uint64)), parts), kind, *columns, value[at[hit]].astype(np.float64 if kind == STRINGS else np.int64))
        if TEXTS in found:
            yield from blobs.dealt(blobs.part_of(mixed(found[TEXTS][0].view(np.uint64)), parts), TEXTS, *found[TEXTS])

    return blobs.batches_of(rows())


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row's whole text.

    Scores are log10 probabilities. A null text counts as empty: one end
    token. Repeated rows train and score each by itself; with no training
    row, every token has the same probability and score equals base_score.
    Other columns are left out; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (~is_training()).alias("held_out"))
    tree, rest, _ = fit(own.where("not held_out").select("text"), scratch)
    parts = blobs.parts_for(spark, tree.total // 2 * (1 + tree.depth))  # a word and a string of each depth may be asked for at each token
    bounded_batches(spark)
    made = _asked(own, tree, parts).union(_table_blobs(rest.words, WORDS, parts)).union(_table_blobs(rest.strings, STRINGS, parts))
    answers = blobs.met(blobs.met(made, parts).mapInArrow(lambda batches: _answered(batches, parts), blobs.SHAPE), parts)
    total, unseen, bottom = tree.total, 0.5, float(tree.total + 0.5 * (tree.distinct + 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gathered(batches)
        if TEXTS not in found:
            return
        order = np.lexsort((found[TEXTS][1], found[TEXTS][0]))
        chunk, _, ids, flags, sizes, known, base, gain = (c[order] for c in found[TEXTS])
        chunks, start = np.unique(chunk, return_index=True)
        more = np.zeros(len(ids))
        if WORDS in found:
            of, index, times, n = found[WORDS]
            at = start[np.searchsorted(chunks, of)] + index
            known = known + np.bincount(at, times, len(ids)).astype(np.int64)
            base = base + np.bincount(at, times * (np.log10((n + 0.5) / bottom) - np.log10(unseen / bottom)), len(ids))
        if STRINGS in found:
            of, index, times, value = found[STRINGS]
            more = np.bincount(start[np.searchsorted(chunks, of)] + index, times * value, len(ids))
        for k in range(0, len(ids), 10_000):
            cut = slice(k, k + 10_000)
            columns = [pa.array(ids[cut], mask=(flags[cut] & 2) > 0), pa.array((flags[cut] & 1) > 0), *(pa.array(c[cut].astype(np.int64)) for c in (sizes, known)), pa.array(np.full(len(ids[cut]), total)), pa.array(base[cut]), pa.array((base + gain + more)[cut])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers.mapInArrow(each, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
