"""The corpus pipeline, stage by stage, against plain Python."""

from collections import Counter

import corpus_pipeline
import pytest
from cartulary.llm import lines, toxicity
from cartulary.llm.queries import table, tokenizer
from tests.llm.helpers import edits, groups
from tests.llm.test_decontam import brute as hits
from tests.llm.test_near import near_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_lines(distinct):
    """Links of different lines within two edits, by all pairs that letter counts allow."""
    long = sorted((x for x in distinct if len(x) >= lines.MIN_CHARS), key=len)
    bags = [Counter(x) for x in long]
    out = []
    for i, a in enumerate(long):
        for j in range(i + 1, len(long)):
            if len(long[j]) - len(a) > lines.EDITS:
                break
            apart = (bags[i] - bags[j]).total() + (bags[j] - bags[i]).total()
            if apart <= 2 * lines.EDITS and edits(a, long[j]) <= lines.EDITS:
                out.append((a, long[j]))
    return out


def without_repeats(rows):
    distinct = {x for _, t in rows for x in (t or "").split("\n") if x.strip(" ")}
    label, seen, out, whole = groups(distinct, near_lines(distinct)), set(), {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        if t in whole:  # a copy keeps what the first one keeps
            out[i] = whole[t]
            continue
        kept = []
        for x in t.split("\n"):
            if x.strip(" ") and label[x] in seen:
                continue
            kept.append(x)
            if x.strip(" "):
                seen.add(label[x])
        out[i] = whole[t] = "\n".join(kept)
    return out | {i: None for i, t in rows if t is None}


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage was given and made, written and read again."""
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for _, made in steps[:-1]:
        assert sorted(made.columns) == sorted(COLUMNS)


def test_toxicity_stage(spark, sf, steps):
    larger = sf.replace("sf0.001", "sf0.01")  # with labels enough to learn from
    docs = table(spark, larger, "documents")
    for at, (given, made) in ((sf, steps[0]), (larger, (docs, corpus_pipeline.drop_toxic(spark, docs, larger)))):
        lexicon = toxicity.fit(given, table(spark, at, "labels"))
        want = {r.doc_id for r in given.collect() if lexicon.score(r.text or "") < 0.5}
        assert {r.doc_id for r in made.collect()} == want
    assert len(want) < 0.95 * docs.count()


def test_line_stage(steps):
    given, made = steps[1]
    want = without_repeats([(r.doc_id, r.text) for r in given.collect()])
    got = {r.doc_id: r.text for r in made.collect()}
    assert got == want
    assert sum(a != b.text for a, b in ((got[r.doc_id], r) for r in given.collect())) > 3


def test_near_stage(steps):
    given, made = steps[2]
    classes = near_classes([(r.doc_id, r.text) for r in given.collect()])
    assert {r.doc_id for r in made.collect()} == {i for i, c in classes.items() if i == c}


def test_decontamination_stage(spark, sf, steps):
    given, made = steps[3]
    rows = given.collect()
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    found = hits([r.text for r in rows], items)
    want = {r.doc_id for r, (n, h, _) in zip(rows, found, strict=True) if not (h and 20 * h >= n)}
    assert {r.doc_id for r in made.collect()} == want


def test_bpe_stage(steps):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in steps[4][0].collect()}
    got = {r.doc_id: r for r in steps[4][1].collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.ids == library.encode(texts[i] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, sf, steps):
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in steps[-1][1].collect()}


def test_odd_rows_and_empty_tables(spark, tmp_path):
    long = "a passage that is long enough to be a line of its own in every document"
    rows = [(1, f"{long}\none", "en", "s", 9), (None, None, None, None, None), (2, "", "", "", 0), (3, " \n\t\n", "en", "s", 4), (1, f"{long}\none", "en", "s", 9), (4, "word " * 30000, "en", "s", 150000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = spark.createDataFrame([(*r, i, "x", 1.0) for i, r in enumerate(rows)], f"{schema}, ids long, `class` string, score double")
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = extra
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        if k < 4:
            assert docs.columns == columns and docs.count() == len(rows)
    assert docs.count() == len(rows)
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.count() == 0
