"""The service functions on a small collection."""

import pytest

from loomtext import api
from loomtext.operators.pipeline import Pipeline
from loomtext.operators.tagging import HmmTagger

DOCS = [("a", "The numerators are added. 1/2+1/3=2/5"), ("b", "A common denominator helps."), ("c", "Nothing here")]


@pytest.fixture(scope="module")
def service(spark):
    return api.Service(spark.createDataFrame(DOCS, "doc_id string, text string"))


def test_search_with_snippets(service):
    plain = Pipeline("plain")
    rows = service.search("common denominator", plain).collect()
    assert [r.doc_id for r in rows] == ["b"] and rows[0].snippet.hit == "common"
    assert service.query_type("a AND b") == "Boolean AND"
    docs, forms = service.term("denominator", plain)
    assert [(r.doc_id, r.tf) for r in docs.collect()] == [("b", 1)] and forms.first().n == 1
    assert service.index_summary(plain)["totals"].first().terms > 5


def test_own_pipeline(service):
    engine, stages = service.run_pipeline(stopwords="nltk", normalizer="porter", order="norm_then_stop")
    assert {r.stage for r in stages.collect()} == {"tokenized", "lowercased", "stopwords_removed", "normalized", "index_terms"}
    assert {r.doc_id for r in engine.search("numerator adding").collect()} == set() and {r.doc_id for r in engine.search("numerator AND adding").collect()} == {"a"}
    with pytest.raises(ValueError):
        service.run_pipeline(colour="red")


def test_upload_and_limits(spark, service):
    r = service.upload("x.md", b"# T\n*hi*").first()
    assert r.title == "T" and r.clean.text == "T\nhi"
    with pytest.raises(ValueError):
        service.upload("x.txt", b"0" * (api.UPLOAD_BYTES + 1))
    with pytest.raises(ValueError):
        api.tokenize(spark, "x", ["no such"])
    with pytest.raises(ValueError):
        api.stem(["w"] * 201)


def test_text_calls(spark, service):
    assert api.tokenize(spark, "3/4 of it", ["custom", "whitespace"]).count() == 2
    assert api.preprocess(spark, "being added", Pipeline("p", stopwords="nltk", normalizer="regexp")).count() == 2
    assert "CD" in {r.tag for r in api.pos(spark, "add 3/4").collect()}
    assert {r.text for r in api.ner(spark, "a MathDial log and fractions, $3,650", [("MathDial", "DATASET"), ("fraction", "CONCEPT")]).collect()} == {"MathDial", "fractions", "$3,650"}
    assert api.evidence_record(spark, "1/2+1/3=2/5").first().record.interpretation.detectors[0].hypothesis.startswith("M01")
    assert api.syntax(spark, "add the tops")[0].count() == 1
    assert "".join(api.subwords(service.docs, ["added"], 50)[0]["pieces"]) == "added</w>"


def test_hmm():
    t = HmmTagger([[("the", "DT"), ("dog", "NN")], [("a", "DT"), ("cat", "NN")], [("dogs", "NNS"), ("run", "VB")]] * 3)
    assert t.tag(["the", "cat"]) == ["DT", "NN"] and t.tag([]) == []
