"""Languages of pages against the declared ones and against a plain fusion."""

import math
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import langid as L
from millrace.llm.queries import QUERIES
from tests.conftest import SF, SF_SMALL


def test_text_alone_finds_the_language_that_the_markup_declares(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    model = L.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    right = 0
    for page in pages:
        log = model.log_likelihood(L.main_text(page.html))
        right += model.languages[int(np.argmax(log))] == L.declared_language(page.html)
    assert right / len(pages) > 0.97


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op7_bayes_langid"](spark, SF).collect()}
    assert len(got) == len(pages)
    right = sum(got[p.page_id].lang == L.declared_language(p.html) for p in pages)
    assert right / len(pages) > 0.98
    assert all(0.25 <= r.confidence <= 1 for r in got.values())


def test_query_equals_a_plain_fusion(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    frame = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages = frame.collect()
    got = {r.page_id: r for r in L.page_languages(frame, docs).collect()}
    model = L.learn(docs)
    n = len(model.languages)
    seen = []
    sums = {k: defaultdict(lambda: [0] * n) for k in ("all", "host", "domain", "suffix", "said")}
    for p in pages:
        logs = model.log_likelihood(L.main_text(p.html))
        share = [round(x * L.UNIT) for x in (np.exp(logs) / np.exp(logs).sum()).tolist()]
        keys = dict(zip(("host", "domain", "suffix"), L.address_parts(p.url)))
        keys |= {"all": "", "said": L.declared_language(p.html)}
        for k, v in keys.items():
            sums[k][v] = [a + b for a, b in zip(sums[k][v], share)]
        seen.append((p, logs.tolist(), share, keys))
    total = [x / L.UNIT for x in sums["all"][""]]
    overall = [(t + 1) / (sum(total) + n) for t in total]

    def smoothed(counts, own, above):
        rest = [(a - b) / L.UNIT for a, b in zip(counts, own)]
        return [(r + 5 * p) / (sum(rest) + 5) for r, p in zip(rest, above)]

    for p, logs, share, keys in seen:
        by_domain = smoothed(sums["domain"][keys["domain"]], share, overall)
        prior = smoothed(sums["host"][keys["host"]], share, by_domain)
        suffix = [math.log((a / L.UNIT + 1) / (t + 1))
                  for a, t in zip(sums["suffix"][keys["suffix"]], total)]
        said = [math.log((a / L.UNIT + 1) / (t + len(sums["said"])))
                for a, t in zip(sums["said"][keys["said"]], total)]
        want = L.plain_posterior(logs, prior, suffix, said)
        row = got[p.page_id]
        assert row.lang == model.languages[want.index(max(want))]
        assert math.isclose(row.confidence, max(want), rel_tol=1e-9)


def test_no_language_is_left_out(spark):
    codes = [a + b for a in "abcdefghij" for b in "klmnopqr"]
    own = {c: " ".join(c + x + c for x in "stuvwxyz") for c in codes}
    rows = [(i, own["ak"] * 20, "ak") for i in range(3000)]
    rows += [(5000 + i, own[c], c) for i, c in enumerate(codes * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Of all documents drawn alike, 100 would have about two of the 158 of small languages.
    for each in (1, 50):
        model = L.learn(docs, limit=100, each=2 * each)
        assert model.languages == tuple(codes)
        for c in codes:
            assert model.languages[int(np.argmax(model.log_likelihood(own[c])))] == c
    drawn = L._drawn_by_language(docs, 100, 50).groupBy("lang").count().collect()
    sizes = {r.lang: r["count"] for r in drawn}
    assert sizes.pop("ak") < 200 and set(sizes.values()) == {2} and len(sizes) == 79


@pytest.mark.parametrize(
    "url, parts",
    [("https://m.a.example.co.uk/x", ("m.a.example.co.uk", "example.co.uk", "uk")),
     ("http://EXAMPLE.de:80", ("example.de", "example.de", "de")), (None, ("", "", "")),
     ("http://[bad", ("", "", "")), ("no address", ("", "", ""))],
)
def test_address(url, parts):
    assert L.address_parts(url) == parts


@pytest.mark.parametrize(
    "html, lang",
    [("<HTML dir=ltr LANG='de-AT'>", "de"), ("<html><p lang=fr>", "none"), (None, "none"),
     ("<meta http-equiv=content-language content='es'>", "es")],
)
def test_declared(html, lang):
    assert L.declared_language(html) == lang


@pytest.mark.parametrize(
    "html, lang",
    [(f"<!-- {'x ' * 5000} --><html lang=it>", "it"),
     (f"<html><head><script>{'f(1);' * 5000}</script><style>{'p{}' * 5000}</style>"
      "<meta content=x http-equiv=refresh><meta http-equiv='content-language' content='pt-BR'>", "pt"),
     ("<!--<html lang=en>--><script>'<html lang=fr>'</script><html lang=de>", "de"),
     (f"<head><title>{'t ' * 5000}</title></head><body><meta http-equiv=content-language content=fr>", "none"),
     ("<script>" * 50_000 + "<html lang=de>", "none"), ("<meta " * 50_000, "none"), ("<!--" * 50_000, "none")],
)
def test_declared_anywhere_in_the_head(html, lang):
    assert L.declared_language(html) == lang


def test_evidence_decides_where_there_is_no_text(spark):
    words = {"en": "the house is on the hill", "de": "das haus steht auf dem berg"}
    docs = spark.createDataFrame(
        [(i, words[k], k) for i, k in enumerate(["en", "de"] * 10)] + [(99, None, "xx"), (98, "x", None)],
        "doc_id long, text string, lang string")
    pages = [(i, f"http://{k}.example.{k}/", f"<html lang={k}><p>{words[k]}") for i, k in enumerate(["en", "de"] * 20)]
    pages += [(100, "http://de.example.de/z", ""), (101, "http://new.example.org", "<html lang=de>"),
              (102, None, None), (None, None, None), (0, *pages[0][1:]),
              (103, "http://en.example.en/", "<html lang=zz><p>das haus")]
    frame = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, lang string")
    got = L.page_languages(frame, docs).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert by_id[100].lang == by_id[101].lang == by_id[103].text_lang == "de"
    assert by_id[103].declared_lang == "other" and by_id[None].declared_lang == "none"
    assert all(by_id[i].lang == ["en", "de"][i % 2] for i in range(40))
    assert L.page_languages(frame.limit(0), docs).collect() == []
    assert all(r.lang is None for r in L.page_languages(frame, docs.limit(0)).collect())


@pytest.mark.parametrize("head, want", [
    ("<meta http-equiv=content-language content=de-AT>", "de"),
    ("<meta content='fr-CA' http-equiv='Content-Language'>", "fr"),
    ("<meta name=x content=es><html lang=en-US>", "en"),
    ("<meta content=es name=language>", "none"),
])
def test_declared_in_either_order(head, want):
    assert L.declared_language(head + "</head><body>") == want


def test_tags_are_primary_languages_and_und_is_none(spark):
    rows = [(i, "the cat and the dog", tag) for i, tag in enumerate(["en", "EN", "en-US", "en_GB"])]
    rows += [(9, "der hund und die katze", "de"), (10, "zzz", "und"), (11, "zzz", None), (12, "zzz", "")]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en")
    pages = spark.createDataFrame(
        [(1, "http://a.org/x", "<html lang=en-US><p>the cat and the dog</p>")], "page_id long, url string, html string"
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.page_languages(pages, docs).first().lang == "en"


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrst"
    # A word of its own for each, since digits are no part of a word.
    code = lambda i: letters[i % 20] + letters[i // 20 % 10] * 2
    rows = [(i, f"the {code(i % 200)}", "q" + code(i % 200)[:2]) for i in range(400)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 200
    found = model.languages[int(np.argmax(model.log_likelihood(code(7))))]
    assert found == "q" + code(7)[:2]
