import random

from cartulary.llm import queries, toxicity
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS

LABELS = "doc_id long, toxic int"


def corpus(n=600):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        toxic = i % 5 == 0
        word = ["grubbler", "SnarfTing", "grubbling", "snárftest"][i // 5 % 4] if toxic else "plain"
        filler = [f"w{rng.randrange(3000)}" for _ in range(12)]
        rows.append((i, f"some {' '.join(filler[:6])} and {word} more {' '.join(filler[6:])} here"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_folding():
    assert toxicity.fold("clown") == toxicity.fold("C1OWN") == toxicity.fold("ciоwn") == toxicity.fold("c|0wn")
    assert toxicity.fold("1D10T Ïdíòt іԁіοt ＩＤＩＯＴ i​d́iot @$$") == "idiot idiot idiot idiot idiot ass"


def test_exceptions_and_word_starts():
    clown = toxicity.fold("clown")
    lexicon = toxicity.Lexicon({clown: 5.0, clown + "i": 6.0}, slope=3.0, prior=-3.0)
    places = [lexicon.matches(toxicity.fold(t)) for t in ("a Clown", "xclown", "a clown fish swims", "clown fishes", "c1owning", "clown clown fish")]
    assert places == [[(2, clown)], [], [], [(0, clown)], [(0, clown + "i")], [(0, clown)]]
    assert lexicon.score("a clown") > 0.5 > lexicon.score("a clown fish") == lexicon.score("") == lexicon.score("   ")


def test_longer_texts_need_more():
    lexicon = toxicity.Lexicon({"scum": 5.0})
    assert lexicon.score("scum") > lexicon.score("scum " + "word " * 50) > lexicon.score("word " * 50)


def test_learning_and_cases(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None), (1, None), (2, "")], DOCS)
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1), (10**6, 1)], LABELS)
    lexicon = toxicity.fit(docs, known)
    assert lexicon.entries and all("grubbier".startswith(e) or "grubbiing".startswith(e) or "snarfting".startswith(e) or "snarftest".startswith(e) for e in lexicon.entries)
    scored = toxicity.score(docs.withColumn("score", F.lit("clash")), lexicon).collect()
    truth = dict(labels)
    for r in scored:
        assert 0 <= r.score <= 1
        if r.text and r.doc_id in truth and r.text.startswith("some"):
            assert (r.score >= 0.5) == (truth[r.doc_id] == 1)
        if not r.text:
            assert r.score < 0.5
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 120 + 3


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "words"), (2, None)], DOCS)
    for labels in ([], [(1, 0)], [(None, 1)]):
        lexicon = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        assert all(r.score < 0.5 for r in toxicity.score(docs, lexicon).collect())
    assert toxicity.drop_toxic(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_held_out_accuracy(spark, sf):
    """On labelled rows of the fold that nothing was learned from, at sf0.1."""
    sf = sf.replace("sf0.001", "sf0.1")
    got = queries.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    caught = [r.predicted for r in got if r.toxic == 1]
    assert len(got) > 500 and right / len(got) > 0.97
    assert sum(caught) / len(caught) > 0.85
    assert sum(r.predicted for r in got if r.toxic == 0) / len(got) < 0.01
