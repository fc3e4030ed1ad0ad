"""Language of web pages: text, markup and address as evidence in one posterior."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.extract import main_text
from millrace.llm.quality import base_language

# The text model is fitted on about so many labelled documents, chosen by a hash of the
# id, and on about so many of each language, or all if there are fewer.  It keeps at most
# so many n-grams, and every language.
SAMPLE_ROWS = 8_000
LANGUAGE_ROWS = 2_000
MAX_GRAMS = 30_000
GRAM_SIZES = (1, 2, 3)
GRAM_PRIOR = 0.5
# N-grams of a text overlap, so each says less than if it stood alone.
TEMPER = 0.25
# Weight of the level above, in pages, when a host's or domain's counts are smoothed.
SMOOTHING = 5.0
# Pages added to each cell of the tables of declared languages and suffixes.
CELL_PRIOR = 1.0
# Shares are summed as whole numbers, so that sums are exact in any order.
UNIT = 1_000_000
# Hosts whose row may be broadcast: a few hundred bytes each.
BROADCAST_HOSTS = 50_000
NONE = "none"
OTHER = "other"
_HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.IGNORECASE)
_META_LANG = re.compile(
    r"<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?content-language\b)[^>]*?"
    r"\bcontent\s*=\s*[\"']?\s*([A-Za-z]{2,8})",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+")
# What counts in a head, its end, and what only looks like either: comments and the text
# of some elements are passed over as a whole.
_HEAD_PARTS = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|title|textarea|template|noscript)\b.*?(?:</\1\b|\Z)"
    r"|(?P<tag><(?:html|meta)\b[^>]*)|(?P<end></head\b|<body\b)",
    re.IGNORECASE | re.DOTALL,
)


def grams_of(text: str | None) -> Counter:
    """Character n-grams of the words of a text, with marks at their ends."""
    words = Counter(_WORD.findall((text or "").lower()))
    found: Counter = Counter()
    for word, n in words.items():
        marked = f" {word} "
        for size in GRAM_SIZES:
            for i in range(len(marked) - size + 1):
                found[marked[i : i + size]] += n
    del found[" "]
    return found


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    rows: dict[str, int]  # n-gram -> row of the table
    table: np.ndarray  # log probability by n-gram and language

    def log_likelihood(self, text: str | None) -> np.ndarray:
        """Tempered log likelihoods of a text in each language, the greatest being 0."""
        found = [(self.rows[g], n) for g, n in grams_of(text).items() if g in self.rows]
        if not found:
            return np.zeros(len(self.languages))
        at, counts = (np.array(x) for x in zip(*found, strict=True))
        total = TEMPER * (counts @ self.table[at])
        return total - total.max()


def _drawn_by_language(labelled: DataFrame, limit: int, each: int) -> DataFrame:
    """About ``limit`` of the rows in all, and about ``each`` of every language.

    Rows are kept or not by a hash of their id, each by itself.
    """
    # A row for each language.
    sizes = [(r.lang, r["count"]) for r in labelled.groupBy("lang").count().collect()]
    total = sum(n for _, n in sizes)
    quotas = [(lang, n, min(n, max(each, -(-limit * n // total)))) for lang, n in sizes]
    quota = labelled.sparkSession.createDataFrame(quotas, "lang string, size long, quota long")
    chosen = F.pmod(F.xxhash64("doc_id"), F.col("size")) < F.col("quota")
    return labelled.join(F.broadcast(quota), "lang").where(chosen).select("lang", "text")


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    limit: int = SAMPLE_ROWS, each: int = LANGUAGE_ROWS,
) -> TextModel:
    """N-gram probabilities of the languages of the labelled documents.

    About ``limit`` documents are drawn, and more of the languages that would have fewer
    than ``each`` among them.  Tags such as en-US or EN are their primary language; und
    and the like name none, and their documents are left out.  The n-grams kept are those with the greatest share of any
    language's, so that no language is left without.
    """
    labelled = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        base_language(F.col(lang_col)).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    train = _drawn_by_language(labelled.dropna(), limit, each)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(lang, Counter()).update(grams_of(text))
            rows = [(a, g, n) for a, grams in found.items() for g, n in grams.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int64())],
                ["lang", "gram", "n"],
            )

    counts = train.select("lang", "text").mapInArrow(
        counted, "lang string, gram string, n long"
    )
    counts = stored(
        counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams"
    )
    # A row for each language.
    sums = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = {r.lang: float(r.n) for r in sums.collect()}
    of = sums.select(F.col("lang").alias("of_lang"), F.col("n").alias("all_n"))
    common = (
        counts.join(F.broadcast(of), F.col("lang") == F.col("of_lang"))
        .groupBy("gram").agg(F.max(F.col("n") / F.col("all_n")).alias("most"))
        .orderBy(F.desc("most"), "gram").limit(MAX_GRAMS).select("gram")
    )
    # In columns: some 20 bytes for each n-gram that is kept and each of its languages,
    # of which there are MAX_GRAMS times the languages at most.
    kept = counts.join(F.broadcast(common), "gram").select("gram", "lang", "n").toArrow()
    languages = tuple(sorted(totals))
    grams = kept.column("gram").combine_chunks().dictionary_encode()
    named = kept.column("lang").combine_chunks().dictionary_encode()
    rows = {g: i for i, g in enumerate(sorted(grams.dictionary.to_pylist()))}
    place = {x: i for i, x in enumerate(languages)}
    row_of = np.array([rows[g] for g in grams.dictionary.to_pylist()], int)
    column_of = np.array([place[x] for x in named.dictionary.to_pylist()], int)
    table = np.full((len(rows), len(languages)), GRAM_PRIOR)
    if rows:
        table[row_of[grams.indices], column_of[named.indices]] += kept.column("n").to_numpy()
    return TextModel(languages, rows, np.log(table / table.sum(axis=0)) if rows else table)


def declared_language(html: str | None) -> str:
    """The primary language that the markup declares, or "none".

    The page is read up to the end of its head, or whole if there is no such end.
    """
    meta = None
    for part in _HEAD_PARTS.finditer(html or ""):
        if part["end"]:
            break
        if part["tag"]:
            found = _HTML_LANG.match(part["tag"])
            if found:
                return found[1].lower()
            meta = meta or _META_LANG.match(part["tag"])
    return meta[1].lower() if meta else NONE


def address_parts(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty where there is none.

    The domain is the last two labels, or three where the second level is a short
    label under a country's suffix, as in co.uk.
    """
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    size = 3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 2
    return host, ".".join(labels[-size:]), labels[-1]


def _evidence(
    pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str
) -> DataFrame:
    known = set(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, htmls = batch.column(1).to_pylist(), batch.column(2)
            logs, shares, declared = [], [], []
            for html in htmls:
                page = html.as_py()
                log = model.log_likelihood(main_text(page))
                share = np.exp(log)
                logs.append(log.tolist())
                shares.append(np.rint(share / share.sum() * UNIT).astype(int).tolist())
                said = declared_language(page)
                declared.append(said if said in known or said == NONE else OTHER)
            host, domain, suffix = zip(*map(address_parts, urls)) if urls else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(logs, pa.list_(pa.float64())),
                 pa.array(shares, pa.list_(pa.int64())), pa.array(declared, pa.string()),
                 pa.array(host, pa.string()), pa.array(domain, pa.string()),
                 pa.array(suffix, pa.string())],
                ["page_id", "url", "logs", "shares", "declared", "host", "domain", "suffix"],
            )

    picked = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return picked.mapInArrow(
        run,
        "page_id long, url string, logs array<double>, shares array<long>, declared string,"
        " host string, domain string, suffix string",
    )


def _sums(n: int, column: str = "shares") -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def _hosts(evidence: DataFrame, n: int) -> DataFrame:
    """One row per host: the summed shares of the host, of its domain and its suffix.

    Pages are summed to hosts, hosts to domains, hosts to suffixes.
    """
    hosts = evidence.groupBy("host", "domain", "suffix").agg(_sums(n).alias("host_sums"))
    hosts = stored(hosts, "langid-hosts")
    domains = hosts.groupBy(F.col("domain").alias("d")).agg(
        _sums(n, "host_sums").alias("domain_sums")
    )
    suffixes = hosts.groupBy(F.col("suffix").alias("s")).agg(
        _sums(n, "host_sums").alias("suffix_sums")
    )
    return (
        hosts.join(domains, F.col("domain") == F.col("d"))
        .join(suffixes, F.col("suffix") == F.col("s"))
        .select(F.col("host").alias("h"), "host_sums", "domain_sums", "suffix_sums")
    )


def _smoothed(sums: Column, own: Column, above: Column) -> Column:
    """Shares of the languages without the page's own, towards those of the level above."""
    rest = F.zip_with(sums, own, lambda a, b: a - b)
    total = F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x)
    mixed = F.zip_with(rest, above, lambda a, p: a / UNIT + p * SMOOTHING)
    return F.transform(mixed, lambda x: x / (total / UNIT + SMOOTHING))


def page_languages(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", limit: int = SAMPLE_ROWS,
) -> DataFrame:
    """The most probable language of every page.

    The posterior multiplies the likelihood of the main text, the likelihoods of the
    declared language and of the address's suffix, and the prior of the host.  The
    tables of the latter are summed over all pages from what their texts say: declared
    language by text language, suffix by text language, and a host's prior from its
    pages, smoothed towards its domain's, and that towards all pages'.  A page's own
    text is left out of its host's and domain's sums.

    Result, one row per row of ``pages``: page_id, url, lang, confidence (the
    posterior), text_lang, declared_lang ("none" or "other" if not a known one).  Null
    and empty pages have no text and go by the rest; a null address is a host of its
    own; ties go to the first language by name.  Repeated rows stay, other columns are
    ignored, an empty table gives an empty result.  Without labelled documents there
    is no language to name, and lang is null.
    """
    model = learn(docs, limit=limit)
    n = len(model.languages)
    evidence = stored(_evidence(pages, model, id_col, url_col, html_col), "langid-evidence")
    if not n:
        return evidence.select(
            "page_id", "url", F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"),
            F.col("declared").alias("declared_lang"),
        )
    # A row for each known language at most.
    said = {
        r.declared: r.s
        for r in evidence.groupBy("declared").agg(_sums(n).alias("s")).collect()
    }
    total = np.array([sum(s[i] for s in said.values()) for i in range(n)], float) / UNIT
    overall = (total + 1) / (total.sum() + n)
    choices = len(said) or 1
    likely = {
        k: np.log((np.array(s) / UNIT + CELL_PRIOR) / (total + CELL_PRIOR * choices))
        for k, s in said.items()
    }
    declared = F.create_map(
        *[x for k, v in likely.items() for x in (F.lit(k), F.array(*map(F.lit, v.tolist())))]
    )
    hosts = _hosts(evidence, n)
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = evidence.join(hosts, F.col("host") == F.col("h"))
    general = F.array(*map(F.lit, overall.tolist()))
    domain = _smoothed(F.col("domain_sums"), F.col("shares"), general)
    suffix = F.zip_with(
        "suffix_sums",
        F.array(*map(F.lit, total.tolist())),
        lambda a, t: F.log((a / UNIT + CELL_PRIOR) / (t + CELL_PRIOR)),
    )
    scored = (
        joined.withColumn("by_domain", domain)
        .withColumn("prior", _smoothed(F.col("host_sums"), F.col("shares"), F.col("by_domain")))
        .withColumn("by_suffix", suffix)
        .withColumn("by_markup", F.element_at(declared, F.col("declared")) if likely else general)
    )
    log_sum = F.zip_with("logs", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b)
    log_sum = F.zip_with(log_sum, "by_suffix", lambda a, b: a + b)
    log_sum = F.zip_with(log_sum, "by_markup", lambda a, b: a + b)
    scored = scored.withColumn("score", log_sum).withColumn("best", F.array_max("score"))
    names = F.array(*map(F.lit, model.languages))
    weight = F.aggregate(
        F.transform("score", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x
    )
    first = lambda values, most: F.element_at(
        names, F.array_position(values, most).cast("int")
    )
    return scored.select(
        "page_id",
        "url",
        first(F.col("score"), F.col("best")).alias("lang"),
        (1 / weight).alias("confidence"),
        first(F.col("logs"), F.array_max("logs")).alias("text_lang"),
        F.col("declared").alias("declared_lang"),
    )


def plain_posterior(
    logs: Iterable[float], prior: Iterable[float], *likelihoods: Iterable[float]
) -> list[float]:
    """The fusion for one page: normalised products of a prior and likelihoods."""
    scores = [
        a + math.log(p) + sum(rest)
        for a, p, *rest in zip(logs, prior, *likelihoods, strict=True)
    ]
    top = max(scores)
    weights = [math.exp(s - top) for s in scores]
    return [w / sum(weights) for w in weights]
