"""Cleaning, tokenizers, stemmers, loaders and merges on small cases."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import normalize as N
from loomtext.functions import tokenizers as K
from loomtext.operators.bpe import Merges
from loomtext.operators.tagging import BackoffTagger
from loomtext.plans import catalog
from loomtext.sources import loaders as L


@pytest.mark.parametrize("text, tokens", catalog.TOKEN_CASES[:11])
def test_hybrid_keeps_domain_tokens(text, tokens):
    own = K.hybrid_tokens(text)
    assert max(tokens.split("|"), key=len) in own or set(tokens.split("|")) <= set(own)


def test_hybrid_splits_comma_lists_and_minus():
    assert K.hybrid_tokens("5/4,3/2 and -3/4") == ["5/4", ",", "3/2", "and", "-", "3/4"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("3/4", "3/4")])
def test_porter(word, stem):
    assert N.porter(word) == stem


def test_merges_by_hand():
    m = Merges.train({"low": 5, "lower": 2, "newest": 6, "widest": 3}, 4)
    assert m.merges[0] == ("e", "s") and m.merges[1] == ("es", "t") and m.merges[2] == ("est", "</w>")
    assert "".join(m.encode_word("lowest")) == "lowest</w>" and "est</w>" in m.encode_word("lowest")


def test_merges_counts_stay_right():
    words = {"aaaa": 3, "abab": 2, "baab": 4, "bbbb": 1}
    got = Merges.train(words, 10).merges
    state = {w: [*w, "</w>"] for w in words}
    for pair in got:
        count = {}
        for w, s in state.items():
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + words[w]
        best = max(count.values())
        assert pair == min(p for p, c in count.items() if c == best)
        for w, s in state.items():
            out, i = [], 0
            while i < len(s):
                both = i + 1 < len(s) and (s[i], s[i + 1]) == pair
                out.append(s[i] + s[i + 1] if both else s[i])
                i += 1 + both
            state[w] = out


def test_backoff_uses_context():
    t = BackoffTagger([[("the", "DT"), ("run", "NN")], [("to", "TO"), ("run", "VB")], [("to", "TO"), ("run", "VB")]])
    assert t.tag(["the", "run"]) == ["DT", "NN"] and t.tag(["to", "run"]) == ["TO", "VB"] and t.tag(["3/4", "xing"]) == ["CD", "VBG"]


def test_loader_rejects_unknown_suffix():
    with pytest.raises(ValueError):
        L.parse("a.exe", b"")


def test_office_files():
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>Sentence</t></is></c><c r="B1" t="inlineStr"><is><t>Speaker</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>hi  you</t></is></c><c r="B2" t="inlineStr"><is><t>T</t></is></c></row><row><c r="A3" t="inlineStr"><is><t>yes</t></is></c></row></sheetData></worksheet>')
    assert L.parse("s.xlsx", b.getvalue())["text"] == "Teacher: hi you\nStudent: yes"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<d><body><p><r><t>One</t></r></p><tbl><tr><tc><p><t>h</t></p></tc></tr><tr><tc><p><t>a.</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></body></d>")
    assert L.parse("d.docx", b.getvalue())["text"] == "One\na. b."


def test_records(spark, tmp_path):
    import json

    files = [
        ("a.jsonl", b'{"question": " q ", "conversation": "T: (probe) why|EOM|S: so: it is|EOM| "}\n\n{"question": "r", "student_profile": "P", "conversation": null}'),
        ("b.csv", b"a,b\n1,x\n2,\n"),
        ("c.csv", b"question,student_incorrect_solution,teacher_described_confusion,self-correctness\nq, w ,c,Yes\n"),
        ("d.json", json.dumps([{"Misconception ID": "MaE01", "Topic": "T", "Misconception": " m ", "Question": "a\n b", "Incorrect Answer": "1", "Correct Answer": 2, "Source": "s"}]).encode()),
        ("e.json", json.dumps({"learner_name": "Asha", "learner_id": "L1", "tutor": "Bot", "platform": "P", "sessions": [{"session": 1, "date": "2026-01-01", "turns": [{"t": "10:00", "speaker": "tutor", "text": "hi"}, {"t": "10:01", "speaker": "learner", "text": "yo"}]}]}).encode()),
        ("f.json", json.dumps({"a": ["x", {"b": "y"}, 3], "c": "z"}).encode()),
    ]
    got = {r.filename: r for r in L.load_bytes(spark, files).collect()}
    assert got["a.jsonl"].text == "Problem: q\nConversation:\nT: why\nS: so: it is\n\nProblem: r\nProfile: P"
    assert json.loads(got["a.jsonl"].meta["dialogue_acts_removed"]) == {"probe": 1} and got["a.jsonl"].meta["records"] == "2"
    assert got["b.csv"].text == "a: 1\nb: x\n\na: 2"
    assert got["c.csv"].text == "Problem: q\nIncorrect solution: w\nConfusion: c\nSolved: Yes"
    assert got["d.json"].text == "Misconception MaE01 (T): m\nQuestion: a b\nIncorrect answer: 1\nCorrect answer: 2\nSource: s"
    assert got["e.json"].text == "Learner: Asha (L1). Tutor: Bot. Platform: P.\nSession 1 on 2026-01-01\n[10:00] Bot: hi\n[10:01] Asha: yo"
    assert got["f.json"].text == "a: x\nb: y\nc: z"
    (tmp_path / "m.jsonl").write_bytes(files[0][1])
    (tmp_path / "n.jsonl").write_text('{"question": "third"}\n')
    assert [(r.doc_id, r.title) for r in L.load_dialogues(spark, str(tmp_path)).orderBy("doc_id").collect()] == [("MD00001", "q"), ("MD00002", "r"), ("MD00003", "third")]


def test_xml_dialects():
    book = """<document xmlns="http://cnx.rice.edu/cnxml" xmlns:m="http://www.w3.org/1998/Math/MathML"><title>Adding</title><metadata><x>no</x><content-id>m1</content-id><abstract>Short.</abstract></metadata>
<content><section><title>One</title><para>Take <m:math><m:mfrac><m:mn>1</m:mn><m:mn>2</m:mn></m:mfrac></m:math> of it.<media alt="a pie"><image/></media></para><list><item>a</item><item>b</item></list></section></content></document>"""
    r = L.parse("book.cnxml", book.encode())
    assert r["title"] == "Adding" and r["text"].split() == "Adding Short. One Take 1/2 of it. a b".split()
    assert (r["meta"]["math_expressions"], r["meta"]["alt_texts_removed"], r["meta"]["module"]) == ("1", "1", "m1")
    assert [x.strip() for x in r["text"].split("\n") if x.strip()] == ["Adding", "Short.", "One", "Take 1/2 of it.", "a", "b"]
    acl = '<collection source="ACL Anthology" title="C"><volume id="V1"><paper><title>On <b>x</b></title><author><first>A</first><last>B</last><affiliation>U</affiliation></author><author><last>C</last></author><abstract>t  u</abstract></paper></volume></collection>'
    r = L.parse("c.xml", acl.encode())
    assert r["text"] == "On x\nAuthors: A B (U); C\nVenue: V1\nt u\n" and r["meta"]["papers"] == "1" and r["title"] == "C"
    assert L.parse("d.xml", b"<r><a>x</a><b>y</b></r>")["text"] == "x y"


def test_orders_differ(spark):
    """Only the stem of a stop word leaks, and only if stop words go first by their surface."""
    from loomtext.operators.pipeline import Pipeline, tokens

    d = spark.createDataFrame([(1, "doings added")], "doc_id long, text string")
    got = {}
    for order in ("stop_then_norm", "norm_then_stop"):
        t = tokens(d, Pipeline("x", stopwords="nltk", normalizer="regexp", order=order))
        got[order] = [r.term for r in t.orderBy("pos").collect() if r.term]
    assert got == {"stop_then_norm": ["doing", "add"], "norm_then_stop": ["add"]}


def test_empty_documents(spark):
    from loomtext.operators.index import PositionalIndex
    from loomtext.operators.pipeline import Pipeline

    d = spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string")
    ix = PositionalIndex.build(d, Pipeline("x"))
    assert ix.size().first().n == 3
    assert {(r.doc_id, r.doc_len) for r in ix.doc_len().collect()} == {(1, 0), (2, 0), (3, 2)}


def test_snippet(spark):
    from loomtext.operators.search import snippet

    r = spark.createDataFrame([("x" * 200 + " the Right word " + "y" * 200,)], "t string").select(snippet(F.col("t"), ["right", "right word"], 5).alias("s")).first().s
    assert r.hit == "Right word" and r.before == "… the " and r.after == " yyyy…"


def test_hmm_equals_all_paths(spark):
    """Batches of sentences of any length against every path, and the registered query against a plain count of all tokens."""
    import itertools
    import random
    from math import log

    import pyarrow as pa

    from loomtext.operators.tagging import HmmTagger

    rng = random.Random(5)
    vocab = ["the", "Dog", "runs", "3", "adding", "of"]
    m = HmmTagger([[(w, rng.choice(["A", "B", "C"])) for w in rng.choices(vocab, k=rng.randint(1, 6))] for _ in range(30)])

    def value(words, path):
        return sum(log((m.step[p, t] + 0.1) / (m.out[p] + 1)) + log(((m.emit[t, w.lower()] if w.lower() in m.words else 0.1 * m.end[t, m._ending(w)]) + 1e-3) / (m.n[t] + 1)) for w, p, t in zip(words, ("<s>", *path), path))

    sents = [rng.choices([*vocab, "zzz", "Xy", "7up"], k=rng.randint(0, 6)) for _ in range(60)]
    for most in (1 << 20, 7):
        got = m.tag_all(pa.array([*sents, None], pa.list_(pa.string())).slice(1), most).to_pylist()
        assert got[-1] is None and [len(x) for x in got[:-1]] == [len(x) for x in sents[1:]]
        for words, path in zip(sents[1:], got):
            assert value(words, path) == pytest.approx(max(value(words, p) for p in itertools.product("ABC", repeat=len(words))))
    long = ["the", "Dog"] * 500
    assert spark.createDataFrame([(long,)], "w array<string>").select(m.column(F.col("w")).alias("t")).first().t == m.tag(long)


def test_hmm_tags_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    n = catalog.QUERIES["hmm_tags"](spark, sf).agg(F.sum("n")).first()[0]
    assert n == catalog.toks(spark, sf).count()
