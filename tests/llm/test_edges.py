"""Every operator on null ids and texts, empty and very long texts, repeated rows, and columns whose names clash with its own."""

import math
import os
from collections import Counter
from html.parser import HTMLParser

import pytest

import corpus_pipeline
from ampliflow.llm import html_extract, license_scan, line_crf, maxent_lm, packing, quality_rules, simhash_dedup, suffix_dedup
from ampliflow.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
LONG = "A long story goes on, and on and on.\n" * 20_000
ROWS = [
    (1, "The lake was calm this morning and we walked along it for an hour."), (None, "Nobody else was there, which was nice."), (None, None), (2, None), (3, ""), (4, " \n\t "),
    (5, LONG), (6, "word"), (1, "The lake was calm this morning and we walked along it for an hour."), (1, "Another text of the same id."), (None, "Nobody else was there, which was nice."),
]
#: Names that the operators use inside or give out.
CLASHES = ("score", "doc", "tie", "out", "block", "n", "held_out", "predicted", "text_", "fp", "component_id", "clean_text", "n_bytes", "qr_kept", "ls_licenses", "_ids", "_text", "_label", "part", "hot", "size", "member", "length", "piece")


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(k, t, *["x"] * len(CLASHES)) for k, t in ROWS], schema).repartition(3)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (6, 0, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "op3": maxent_lm.op3_query, "op5": lambda d: line_crf.op5_query(d, labels), "op6": suffix_dedup.op6_query, "op7": quality_rules.op7_query, "op8": simhash_dedup.op8_query,
        "op9": license_scan.op9_query, "op10": lambda d: packing.best_fit_packing(d, tokenizer_path("byte_bpe_50k.json")),
    }


@pytest.mark.parametrize("name", ["op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_all_rows_come_back(spark, docs, name):
    run = operators(spark)[name]
    got = [r["doc_id"] for r in run(docs).collect() if name != "op10" or r["piece"] == 0]
    assert Counter(got) == Counter(k for k, _ in ROWS)
    assert run(docs.where("doc_id < 0")).collect() == []


def test_equal_texts_have_equal_results(spark, docs):
    """Repeated rows don't depend on each other, and an id says nothing about a text."""
    for name in ("op3", "op5", "op7", "op8", "op9"):
        rows = [tuple(v for k, v in r.asDict().items() if k != "doc_id") for r in operators(spark)[name](docs.where("text LIKE 'Nobody%'")).collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_base_scores_of_edge_rows(docs):
    got = maxent_lm.op3_query(docs).collect()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["score"] < 0 for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t in ROWS)


def test_caller_columns_stay(docs):
    found = license_scan.license_scan(docs)
    assert {r["_ids"] for r in found.collect()} == {"x"} and set(docs.columns) <= set(found.columns)


class _Article(HTMLParser):
    """Text between article tags, a word at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.inside and tag in ("p", "h1", "br", "li", "div"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article" and self.inside > 0

    def handle_data(self, data):
        if self.inside:
            self.words.append(data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_articles_of_pages(spark, folder):
    """On all pages of the driver's tables the text is that of the article element, white space aside."""
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").repartition(4)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    wrong = 0
    for r in html_extract.op2_query(pages).collect():
        article = _Article()
        article.feed(html[r["page_id"]])
        wrong += "".join("".join(article.words).split()) != "".join(r["text"].split())
        assert r["text"] == " ".join(r["text"].split(" ")).strip() and r["n_chars"] == len(r["text"])
    assert wrong == 0


def test_extraction_of_edge_rows(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article>" + "<p>Some words that go on for a while, as text does.</p>" * 20_000 + "</article></body></html>"
    rows = [(None, None, page), (1, "u", page), (1, "u", page), (2, "u", None), (3, "u", " "), (4, "u", "no markup at all"), (5, "u", "<" * 5000), (6, "u", "&#0;&#x110000;&nosuch;")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.op2_query(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {len(r["text"]) for r in got if r["page_id"] in (None, 1)} == {len("Some words that go on for a while, as text does. " * 20_000) - 1}


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
