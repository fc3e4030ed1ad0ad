"""The stages one after another, each against a plain version on its own input."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from millrace.llm import decontaminate as D
from tests.conftest import SF_SMALL
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix import plain


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The input of every stage and the last one's result, as lists of rows."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns_stay(spark, tables):
    names = spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns
    for rows in tables[:-1]:
        assert list(rows[0].asDict()) == names


def test_rejected_documents_go(spark, tables):
    from millrace.llm.quality import quality_rules

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [r.doc_id for r in quality_rules(docs).where("kept").collect()]
    assert ids(tables[1]) == sorted(kept)
    assert 0 < len(kept) < len(tables[0])


def test_one_document_of_each_group_stays(tables):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in tables[1]]
    assert ids(tables[2]) == sorted(set(plain_components(prints).values()))
    assert len(tables[2]) < len(tables[1])


def test_repeated_strings_go(tables):
    before = sorted(tables[2], key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in tables[3]}
    want = plain([r.text for r in before], 400)
    assert len(after) == len(before)
    for row, (_, _, _, kept) in zip(before, want):
        got = after[row.doc_id]
        assert got.text == kept.decode("utf-8", "ignore")
        assert got.n_chars == len(got.text)
        assert (got.lang, got.source) == (row.lang, row.source)


def test_contaminated_documents_go(spark, tables):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    sought = [" " + " ".join(D.words_of(i.text)) + " " for i in items]
    holds = {
        r.doc_id for r in tables[3]
        if any(x in " " + " ".join(D.words_of(r.text)) + " " for x in sought)
    }
    assert holds and ids(tables[4]) == sorted(set(ids(tables[3])) - holds)


def test_tokens_of_the_rest(tables):
    texts = {r.doc_id: r.text for r in tables[4]}
    assert ids(tables[5]) == sorted(texts)
    for row in tables[5]:
        assert row.n_tokens == len(LIBRARY.encode_ordinary(texts[row.doc_id]))


def test_run_gives_the_last_stage(spark, tables):
    got = P.run(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tables[-1]))


def test_edge_rows(spark):
    text = " ".join(f"word{i} the of and" for i in range(40))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, text, "en", "s", 5, "x"), (2, text, "en", None, None, None),
            (None, text, None, "s", 1, "y"), (3, None, "en", "s", 0, "z"), (4, "", "en", "s", 0, "")]
    for frame in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = frame
        found = defaultdict(list)
        for name, stage in P.STAGES:
            docs = stage(spark, docs, SF_SMALL)
            found[name] = [r.doc_id for r in docs.collect()]
            assert name == "byte_bpe" or docs.columns == frame.columns
        if frame.count():
            assert sorted(found["quality_rules"], key=repr) == [1, 2, None]
            assert found["simhash_near_dedup"] == found["byte_bpe"] == [1]
