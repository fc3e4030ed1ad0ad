"""Collocations: phrases counted by a multikey quicksort of suffix pointers.

Every word of a text begins a suffix, of which the first ``MAX_WORDS`` words within
its piece matter.  Suffixes are routed over the cluster by their leading words, so that
all suffixes that begin alike meet in one task; there a three-way quicksort, word by
word, splits the pointers, and the size of an equal partition at depth ``d`` is the
count of a phrase of ``d`` words.  Partitions below the least count are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import mapped, stored
from millrace.llm.filters import hash_bitmap, may_hold, xxhashes
from millrace.llm.words import byte_kinds, lowered_words

MAX_WORDS = 4
LEAST = 30
KEEP = 2000
COVERED_PERCENT = 80
SCALE = 2_000_000
UNKNOWN = "und"
# Leading words with this share of all suffixes, or more, are routed by one more word.
HOT_SHARE = 1000
# Suffixes that a task is meant to sort.
TASK_SUFFIXES = 1_500_000
# Pointers that are sorted at once instead of being partitioned further.
SMALL = 1 << 13
_KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_SPARK_SEED = 42


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The texts of a batch by language."""
    langs, texts = batch.column(0), batch.column(1)
    for lang in pc.unique(langs).to_pylist():
        yield lang, texts.filter(pc.equal(langs, lang))


def _next_words(ids: np.ndarray, follows: np.ndarray, usable: np.ndarray) -> list[np.ndarray]:
    """For each word, its own number from 1 and those of the next ones in its piece.

    0 stands for no word; a word that isn't usable ends the suffixes before it.
    """
    first = np.where(usable, ids + 1, 0)
    columns = [first]
    on = first > 0
    for step in range(1, MAX_WORDS):
        on = on.copy()
        on[len(on) - step :] = False
        n = len(on) - step
        if n > 0:
            on[:n] &= follows[step:] & (first[step:] > 0)
        column = np.zeros_like(first)
        if n > 0:
            column[:n] = np.where(on[:n], first[step:], 0)
        columns.append(column)
    return columns


def _joined(forms: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """Words by number, joined by spaces; 0 is left out."""
    parts = [forms.take(pa.array(c - 1, pa.int64(), mask=c == 0)) for c in columns]
    joined = pc.binary_join_element_wise(
        *parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip"
    )
    return joined.cast(pa.binary()).view(pa.string())


def _grams(lang: str, depths: list[int], grams: list[pa.Array], counts: list) -> pa.RecordBatch:
    n = sum(map(len, grams))
    depth = np.repeat(np.array(depths, np.int32), [len(g) for g in grams])
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.concat_arrays(grams), pa.array(depth),
         pa.array(np.concatenate(counts).astype(np.int64))],
        ["lang", "gram", "depth", "n"],
    )


def word_counts(docs: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """lang, gram, depth, n: every word's count, and the leading words that may be hot.

    A gram of two or three words is counted where it has 1 / (2 ``hot_share``) of a
    batch, so that its sum falls short of its count by that share of all at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _languages(batch):
                words = lowered_words(texts, _KINDS)
                if not len(words.ids):
                    continue
                own = np.bincount(words.ids, minlength=len(words.forms))
                depths = [1]
                grams = [words.forms.cast(pa.binary()).view(pa.string())]
                counts = [own]
                least = max(2, len(words.ids) / (2 * hot_share))
                often = own[words.ids] >= least
                columns = _next_words(words.ids, words.follows, often)
                rows = np.flatnonzero(columns[1])
                for depth in (2, 3):
                    key = columns[0][rows] << 32 | columns[1][rows]
                    if depth == 3:
                        key = key_of[rows] << 32 | columns[2][rows]
                    _, at, which, n = np.unique(
                        key, return_index=True, return_inverse=True, return_counts=True
                    )
                    hot = n >= least
                    picked = rows[at[hot]]
                    depths.append(depth)
                    grams.append(_joined(words.forms, [c[picked] for c in columns[:depth]]))
                    counts.append(n[hot])
                    if depth == 2:
                        key_of = np.zeros(len(words.ids), np.int64)
                        key_of[rows] = which
                        rows = rows[hot[which] & (columns[2][rows] > 0)]
                yield _grams(lang, depths, grams, counts)

    return (
        mapped(docs, run, "lang string, gram string, depth int, n long")
        .groupBy("lang", "gram", "depth")
        .agg(F.sum("n").alias("n"))
    )


def _routes(
    forms: pa.Array, columns: list[np.ndarray], hot: list[tuple[str, ...]]
) -> np.ndarray:
    """Number of leading words that each suffix is routed by."""
    route = np.full(len(columns[0]), 2, np.int32)
    if hot:
        number = {w: i + 1 for i, w in enumerate(forms.to_pylist())}
        for gram in sorted(hot, key=len):
            ids = [number.get(w.encode()) for w in gram]
            if None not in ids:
                same = columns[0] == ids[0]
                for column, i in zip(columns[1:], ids[1:], strict=False):
                    same &= column == i
                route[same] = len(gram) + 1
    return route


def suffixes(
    docs: DataFrame, bitmap: np.ndarray, hot: dict[str, list[tuple[str, ...]]]
) -> DataFrame:
    """lang, gram, depth, n: the suffixes of two words or more, equal ones merged.

    ``gram`` is a suffix's words up to the maximum depth, ``depth`` how many of them
    route it, ``n`` how often a batch has it.  Words that can't be frequent end a
    suffix: no phrase with them is.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast((bitmap, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_of = held.value
        for batch in batches:
            for lang, texts in _languages(batch):
                words = lowered_words(texts, _KINDS)
                if not len(words.ids):
                    continue
                seed = xxhash.xxh64_intdigest(lang.encode(), _SPARK_SEED)
                frequent = may_hold(bits, xxhashes(words.forms, seed))
                columns = _next_words(words.ids, words.follows, frequent[words.ids])
                long = columns[1] > 0
                columns = [c[long] for c in columns]
                if not len(columns[0]):
                    continue
                upper = columns[0] << 32 | columns[1]
                lower = columns[2] << 32 | columns[3]
                order = np.lexsort((lower, upper))
                upper, lower = upper[order], lower[order]
                new = np.ones(len(order), bool)
                new[1:] = (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])
                at = np.flatnonzero(new)
                columns = [c[order[at]] for c in columns]
                route = _routes(words.forms, columns, hot_of.get(lang, []))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), _joined(words.forms, columns),
                     pa.array(route), pa.array(np.diff(np.append(at, len(order))))],
                    ["lang", "gram", "depth", "n"],
                )

    return mapped(docs, run, "lang string, gram string, depth int, n long")


def quicksort_counts(
    keys: list[np.ndarray], weights: np.ndarray, route: np.ndarray, least: int,
    small: int = SMALL,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointer, words, count) of the equal partitions of a multikey quicksort.

    ``keys`` has the language and then the words of each suffix, 0 where it has ended.
    A partition whose weights are below ``least`` is abandoned, unless a suffix in it
    is routed by more words than the partition has in common: then its count here is
    a part of the whole, and is returned whatever its size.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        pointers, depth = stack.pop()
        weight = weights[pointers]
        if weight.sum() < least and not (route[pointers] > 2).any():
            continue
        if len(pointers) <= small:
            found.append(_sorted_counts(keys, weights, route, least, pointers, depth))
            continue
        key = keys[depth][pointers]
        pivot = np.partition(key[:: max(1, len(key) // 99)], len(key[:: max(1, len(key) // 99)]) // 2)
        middle = pivot[len(pivot) // 2]
        below, equal = key < middle, key == middle
        stack.append((pointers[below], depth))
        stack.append((pointers[~(below | equal)], depth))
        same = pointers[equal]
        if depth and not middle:
            continue
        total = weight[equal].sum()
        part = depth < route[same[0]]
        if depth > 1 and (part or total >= least):
            found.append((same[:1], np.array([depth]), np.array([total])))
        if depth + 1 < len(keys) and (total >= least or (route[same] > 2).any()):
            stack.append((same, depth + 1))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted_counts(
    keys: list[np.ndarray], weights: np.ndarray, route: np.ndarray, least: int,
    pointers: np.ndarray, depth: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The equal partitions of a few pointers that agree before ``depth``."""
    columns = [k[pointers] for k in keys]
    order = np.lexsort(columns[: max(depth - 1, 0) : -1] if depth else columns[::-1])
    pointers = pointers[order]
    weight, routed = weights[pointers], route[pointers]
    new = np.zeros(len(order), bool)
    new[0] = True
    found = []
    for d in range(depth, len(keys)):
        key = columns[d][order]
        new[1:] |= key[1:] != key[:-1]
        if d > 1:
            at = np.flatnonzero(new)
            total = np.add.reduceat(weight, at)
            kept = (key[at] > 0) & ((total >= least) | (d < routed[at]))
            found.append((pointers[at[kept]], np.full(kept.sum(), d), total[kept]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(table: pa.Table, least: int) -> pa.RecordBatch:
    """The phrases of the suffixes that were routed to a task."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    split = pc.split_pattern(table.column("gram").combine_chunks(), " ")
    words = split.flatten().dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False)
    starts = split.offsets.to_numpy()
    lengths = np.diff(starts)
    starts = starts[:-1] - starts[0]
    keys = [langs.indices.to_numpy(zero_copy_only=False).astype(np.int32)]
    for d in range(MAX_WORDS):
        key = np.zeros(len(lengths), np.int32)
        has = lengths > d
        key[has] = ids[starts[has] + d] + 1
        keys.append(key)
    at, depth, count = quicksort_counts(
        keys,
        table.column("n").to_numpy(),
        table.column("depth").to_numpy(),
        least,
    )
    forms = words.dictionary.cast(pa.large_string()).cast(pa.large_binary())
    columns = [np.where(depth >= d, keys[d][at], 0).astype(np.int64) for d in range(1, MAX_WORDS + 1)]
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(keys[0][at])), _joined(forms, columns),
         pa.array(depth.astype(np.int32)), pa.array(count.astype(np.int64))],
        ["lang", "phrase", "words", "f"],
    )


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, hot_share: int = HOT_SHARE,
    task_suffixes: int = TASK_SUFFIXES,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``MAX_WORDS`` words with at least ``least`` occurrences.

    ``docs`` has lang and text without nulls.  Result: the stored phrases (lang, phrase,
    words, f) and the words of each language (lang, n).
    """
    spark = docs.sparkSession
    singles = stored(word_counts(docs, hot_share), "phrase-words")
    words = singles.where("depth = 1")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    bitmap = hash_bitmap(frequent, F.xxhash64("lang", "gram"))
    # Each of these has 1 / hot_share of all suffixes: a few thousand at most.
    hot: dict[str, list[tuple[str, ...]]] = {}
    often = singles.where((F.col("depth") > 1) & (F.col("n") >= max(2, total / hot_share)))
    for lang, gram in often.select("lang", "gram").collect():
        hot.setdefault(lang, []).append(tuple(gram.split(" ")))
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_suffixes)
    )
    routed = suffixes(docs, bitmap, hot).repartition(
        parts, F.col("lang"), F.expr("substring_index(gram, ' ', depth)")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield _counted(pa.Table.from_batches(held), least)

    counted = routed.mapInArrow(run, "lang string, phrase string, words int, f long")
    # Only the hot leading words were counted in parts.
    phrases = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    alone = frequent.select("lang", F.col("gram").alias("phrase"), F.lit(1).alias("words"),
                            F.col("n").alias("f"))
    kept = phrases.where(F.col("f") >= least).unionByName(alone)
    return stored(kept, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
    keep: int = KEEP, covered: int = COVERED_PERCENT, hot_share: int = HOT_SHARE,
    task_suffixes: int = TASK_SUFFIXES,
) -> DataFrame:
    """The best collocations of each language, by their weakest cut.

    A candidate is a phrase of 2 to ``MAX_WORDS`` words with a >= ``least``
    occurrences.  Cut after any of its words it has parts that occur l and r times;
    the cut with the smallest ``SCALE`` * a / (l + r), rounded down, counts, of equals
    the first.  Candidates of which ``covered`` percent lie inside one longer candidate
    are dropped.  Numbers are exact: sums are longs, products decimals.

    Result: lang, rank from 1 (by score, a, phrase), phrase, a, l, r, n (words of the
    language), score; ``keep`` rows a language at most.  A null language is
    ``UNKNOWN``; null and empty texts have no words; repeated rows count again; other
    columns are ignored; an empty table gives an empty result.  A task sorts about
    ``task_suffixes`` suffixes; memory also follows the longest text, times 10.
    """
    docs = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    phrases, totals = frequent_phrases(docs, least, hot_share, task_suffixes)
    candidates = phrases.where("words > 1").withColumnRenamed("f", "a")
    cuts = candidates.select(
        "lang", "phrase", "words", "a",
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).selectExpr(
        "*", "substring_index(phrase, ' ', k) as head",
        "substring_index(phrase, ' ', k - words) as tail",
    )
    part = lambda name: phrases.select(
        F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"),
        F.col("f").alias(name),
    )
    heads, tails = part("l"), part("r")
    whole = stored(
        cuts.join(heads, (F.col("lang") == F.col("l_lang")) & (F.col("head") == F.col("l_phrase"))),
        "phrase-cuts",
    ).join(tails, (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_phrase")))
    score = F.expr(
        f"cast(a as decimal(20, 0)) * {SCALE}BD div (cast(l as decimal(20, 0)) + r)"
    )
    scored = (
        whole.groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )
    inner = (
        candidates.where("words > 2")
        .select(
            "lang", "phrase", "words", "a",
            F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"),
        )
        .select("*", F.explode(F.expr("sequence(m, words)")).alias("end"))
        .groupBy(
            F.col("lang").alias("in_lang"),
            F.expr(
                "substring_index(substring_index(phrase, ' ', `end`), ' ', -m)"
            ).alias("in_phrase"),
        )
        .agg(F.max("a").alias("longer"))
    )
    alone = scored.join(
        inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left"
    ).where(
        f"longer is null or cast(longer as decimal(20, 0)) * 100BD"
        f" < cast(a as decimal(20, 0)) * {covered}BD"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each part of a language, so that no task ranks all of one.
    dealt = alone.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    within = Window.partitionBy("lang", "part").orderBy(*order)
    best = dealt.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= keep)
    ranked = best.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ).where(F.col("rank") <= keep)
    return ranked.join(
        totals.select(F.col("lang").alias("n_lang"), "n"), F.col("lang") == F.col("n_lang")
    ).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
