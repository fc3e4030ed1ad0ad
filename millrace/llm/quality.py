"""Quality rules: base counts, and divergence from the language's usual text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import mapped, stored

# Fixed values of the base rules.
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Common words of languages: a histogram has a bin for each and one for the rest.  Those
# of other languages are the words that most of the corpus's own texts have.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or"
    " his from at which but have an had they you were their one all we can her has there"
    " been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine"
    " als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie"
    " einem über einen so zum war haben nur oder aber vor zur bis mehr durch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur"
    " ne se ce il sont la avec son aux d l mais comme on tout nous sa ou leur ont était"
    " elle cette ces y deux fait être si même sans",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como"
    " más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos"
    " también fue había era muy hasta desde está mi",
}
_SLOTS = max(len(set(v.split())) for v in COMMON_WORDS.values()) + 1
# Tags that name no language.
UNKNOWN = ("", "und", "mul", "mis", "zxx")

# Character classes.  Digits, hyphens, quotes and the like count as letters of words:
# numbers and addresses are no sign of bad text.  A code point beyond the table is a
# letter of another script.
CLASSES = ("word", "upper", "blank", "line", "stop", "symbol", "letter")
_WORD, _UPPER, _BLANK, _LINE, _STOP, _SYMBOL, _LETTER = range(len(CLASSES))


def _class_table() -> np.ndarray:
    table = np.full(0x250, _LETTER, np.int64)
    for code in range(0x250):
        c = chr(code)
        if c in "\n\r":
            table[code] = _LINE
        elif c.isspace():
            table[code] = _BLANK
        elif c in SYMBOLS or code < 32:
            table[code] = _SYMBOL
        elif c in ".,;:!?":
            table[code] = _STOP
        elif c.isupper():
            table[code] = _UPPER
        elif c.islower() or c.isdigit() or not c.isalpha():
            table[code] = _WORD
    return table


_CLASS = _class_table()
_SPACE = np.isin(np.arange(0x250), [9, 10, 11, 12, 13, 32])
_IS_SYMBOL = np.isin(np.arange(0x250), [ord(c) for c in SYMBOLS])
_AROUND = "\"'().,;:!?"
# Shares are whole numbers, so that their sums are exact in any order.
UNIT = 1_000_000

# Verdict: a document is rejected if it is long enough to be judged and if it is far
# from its language's reference (Jensen-Shannon distance, 0 to 1) in its common words
# and in its characters.  The chance distance of a short text shrinks with the root of
# its length, and so does the allowance for characters.
MIN_JUDGED_WORDS = 30
MAX_WORD_DISTANCE = 0.25
MAX_CHAR_DISTANCE = 0.06
# Where the characters alone decide: on the labels, no good text is so far.
MAX_CHAR_DISTANCE_ALONE = 0.1
CHAR_ALLOWANCE = 0.6
# A reference from fewer distinct texts says nothing.
MIN_REFERENCE = 20

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more.

    ``ids``: the words by number, equal words by equal numbers.
    """
    if len(ids) <= window or int(ids.max()) + 1 == len(ids):
        return 0
    # Windows by rank: pairs of ranks of halves are ranked again, so equality is exact.
    ranks, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size += step
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.bincount(starts, minlength=len(ids) + 1)
    edges -= np.bincount(starts + window, minlength=len(ids) + 1)
    return int(np.count_nonzero(np.cumsum(edges) > 0))


def describe(text: str | None, common: dict[str, int]) -> tuple[list[int], list[int], list[int]]:
    """(base counts, character-class shares, common-word shares) of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes[codes < len(_CLASS)]
    counts = np.bincount(low, minlength=len(_CLASS))
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                repeated_lines += 1
            else:
                seen.add(line)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    base = [
        len(words),
        len(codes) - int(counts[_SPACE].sum()),
        int(counts[_IS_SYMBOL].sum()),
        repeated_lines,
        repeated_words(ids),
    ]
    chars = np.bincount(_CLASS, weights=counts, minlength=len(CLASSES))
    chars[_LETTER] += len(codes) - len(low)
    slots = np.zeros(_SLOTS)
    if words:
        plain = map(plain_word, number)
        slot_of = np.fromiter((common.get(w, _SLOTS - 1) for w in plain), np.int64, len(number))
        slots = np.bincount(slot_of, weights=np.bincount(ids), minlength=_SLOTS)
    return base, _shares(chars), _shares(slots)


def _shares(counts: np.ndarray) -> list[int]:
    total = counts.sum()
    return np.rint(counts * (UNIT / total)).astype(np.int64).tolist() if total else [0] * len(counts)


def base_language(tag: Column) -> Column:
    """The primary language of a tag such as EN or en-US; null if it names none."""
    first = F.lower(F.trim(F.split(tag.cast("string"), "[-_]")[0]))
    return F.when(~first.isin(*UNKNOWN), first)


def plain_word(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass").strip(_AROUND).lower()


def common_words(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> dict[str, list[str]]:
    """The common words of the languages that ``COMMON_WORDS`` lacks, most common first.

    Words are counted by the distinct texts that have them, of those that pass the base
    rules; languages with too few such texts have no words.
    """
    lang = base_language(F.col(lang_col))
    texts = df.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON_WORDS) & F.col("text").isNotNull()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                if len(ids) < MIN_WORDS or 100 * repeated_words(ids) > REPEAT_PERCENT * len(ids):
                    continue
                # The empty word counts the texts.
                found.update((lang, w) for w in {"", *map(plain_word, number)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()),
                 pa.array([k[1] for k in found], pa.string()),
                 pa.array(found.values(), pa.int64())],
                ["lang", "word", "n"],
            )

    counts = (
        mapped(texts.distinct(), run, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    counts = stored(counts, "quality-words")
    enough = counts.where((F.col("word") == "") & (F.col("n") >= MIN_REFERENCE)).select("lang")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = (
        counts.where("word <> ''").join(enough, "lang", "left_semi")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") < _SLOTS)
    )
    words: dict[str, list[str]] = {}
    # One row for each language and bin at most.
    for r in sorted(best.collect(), key=lambda r: (r.lang, r["rank"])):
        words.setdefault(r.lang, []).append(r.word)
    return words


def with_measures(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of ``df``: id, language, text hash, counts and histograms.

    ``base_lang`` is the primary language, by which texts are compared.  Where there is
    no list of its common words, ``words`` is empty.  Texts of no language may be of any
    script: all their letters are in one class.
    """
    lists = {lang: words.split() for lang, words in COMMON_WORDS.items()}
    lists |= common_words(df, text_col, lang_col)
    tables = {k: {w: i for i, w in enumerate(dict.fromkeys(v))} for k, v in lists.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            base, chars, words = [], [], []
            for lang, text in zip(langs, batch.column(4), strict=True):
                b, c, w = describe(text.as_py(), tables.get(lang, {}))
                if lang is None:
                    c[_WORD] += c[_UPPER] + c[_LETTER]
                    c[_UPPER] = c[_LETTER] = 0
                base.append(b)
                chars.append(c)
                words.append(w if lang in tables else [0] * _SLOTS)
            counts = np.array(base, np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *[pa.array(counts[:, k]) for k in range(len(_COUNTS))],
                 pa.array(chars, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))],
                ["doc_id", "lang", "base_lang", "text_hash", *_COUNTS, "chars", "words"],
            )

    text = F.col(text_col).cast("string")
    picked = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        base_language(F.col(lang_col)).alias("base_lang"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    return mapped(
        picked,
        run,
        f"doc_id long, lang string, base_lang string, text_hash long, {kinds}, chars array<long>,"
        " words array<long>",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def references(measures: DataFrame) -> DataFrame:
    """The mean histograms of each language's distinct texts that pass the base rules.

    A text counts once however many copies it has.  Result: ref_lang, ref_chars,
    ref_words (shares of 1), for languages with enough texts.
    """

    def mean(name: str) -> Column:
        return F.col(name) / F.col("n") / float(UNIT)

    once = measures.where(~F.col("base_failed")).dropDuplicates(["base_lang", "text_hash"])
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(_SLOTS)]
    return (
        once.groupBy(F.col("base_lang").alias("ref_lang"))
        .agg(F.count("*").alias("n"), *sums)
        .where(F.col("n") >= MIN_REFERENCE)
        .select(
            "ref_lang",
            F.array(*[mean(f"c{i}") for i in range(len(CLASSES))]).alias("ref_chars"),
            F.array(*[mean(f"w{i}") for i in range(_SLOTS)]).alias("ref_words"),
        )
    )


def js_distance(left: str, right: str) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram in shares of ``UNIT`` and one in
    shares of 1; null if either is null or the former has no entry.
    """

    def half(x: Column, y: Column) -> Column:
        p = x / float(UNIT)
        m = (p + y) / 2
        return (_term(p, m) + _term(y, m)) / 2

    found = F.aggregate(F.zip_with(left, right, half), F.lit(0.0), lambda a, x: a + x)
    # Rounding may leave equal histograms a trace below zero.
    root = F.sqrt(F.when(found < 0, 0.0).otherwise(found))
    return F.when(F.array_max(left) > 0, root)


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Judge every document by base rules and by its distance from its language.

    Words are runs without ASCII white space.  The histograms of a text (classes of
    characters; common words of its declared language and all others) are compared
    with the means over the whole corpus's distinct texts of that language.  Its common
    words are given for some languages, and for the others those that most of their
    texts have.  Texts too short to have a stable histogram, and languages with too few
    texts, are not judged by distance.

    Result, one row per row of ``df``: doc_id, text_hash, lang, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.
    Null and empty texts have no words and fail.  Languages are compared by their primary
    tag, so EN and en-US are en.  A null language, or a tag that names none, is a
    language of its own without common words: word_distance is null, and the characters
    alone decide.  Repeated rows stay and are judged alike; other columns of ``df`` are
    ignored; an empty table gives an empty result.
    """
    measures = stored(
        with_measures(df, id_col, text_col, lang_col).withColumn("base_failed", base_failed()),
        "quality-measures",
    )
    known = references(measures)
    judged = measures.join(
        known, measures["base_lang"].eqNullSafe(known["ref_lang"]), "left"
    )
    beyond = F.col("char_distance") - CHAR_ALLOWANCE / F.sqrt("n_words")
    far = (F.col("n_words") >= MIN_JUDGED_WORDS) & F.when(
        F.col("word_distance").isNull(), beyond > MAX_CHAR_DISTANCE_ALONE
    ).otherwise((F.col("word_distance") > MAX_WORD_DISTANCE) & (beyond > MAX_CHAR_DISTANCE))
    return (
        judged.withColumn("char_distance", js_distance("chars", "ref_chars"))
        .withColumn("word_distance", js_distance("words", "ref_words"))
        .select(
            "doc_id", "text_hash", "lang", *_COUNTS, "base_failed", "char_distance", "word_distance",
            (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        )
    )
