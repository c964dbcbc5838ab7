import random

from cartulary.llm import decontam
from hypothesis import given
from hypothesis import strategies as st
from tests.llm.helpers import DOCS, words

ITEM = "item_id long, text string"


def brute(texts, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@given(st.lists(st.text(alphabet="abz ", max_size=80), max_size=6), st.lists(st.text(alphabet="ab ", max_size=50), max_size=5))
def test_any_text(texts, phrases):
    items = list(enumerate(phrases))
    got = decontam.judge(texts, decontam.Phrases(items))
    assert [(n, sum(b - a for a, b in s), i) for n, s, i in got] == brute(texts, items)


def test_index_ranks_and_places():
    import numpy as np

    rng = np.random.default_rng(3)
    seq = np.append(rng.integers(0, 6, 500), 0)
    index = decontam.FmIndex(seq, 5)
    phrases = decontam.Phrases([])
    phrases.symbols, phrases.lens = np.array([[1, 2, 0], [3, 0, 0], [2, 2, 2], [5, 1, 4]]), np.array([2, 1, 3, 3])
    lo, hi = index.search(phrases)
    for row, n, a, b in zip(phrases.symbols, phrases.lens, lo, hi, strict=True):
        want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == row[:n]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_tables_cases_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    phrase = " ".join(rng.choice(["Alpha", "béta", "c3", "d"]) for _ in range(20))
    items = [(1, phrase), (1, "x y"), (2, phrase[5:]), (3, None), (4, ""), (None, "kept out"), (5, "x Y"), (10, "lone")]
    texts = [None, "", "!!!", f"so, {phrase.replace(chr(65), chr(97))}.", "X-y", "kept out", "lone " * 30, f"{'pad ' * 400}x y", phrase, phrase]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "x y", None)], "doc_id long, text string, report string")
    bench = spark.createDataFrame(items, ITEM)
    want = brute([*texts, "x y"], [x for x in items if x[0] is not None])
    for size in (decontam.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.scan(docs, bench, report="found").collect()
        by = {r.doc_id: (r.found.n_words, r.found.n_hit, r.found["items"]) for r in got}
        assert by == {**dict(enumerate(want[:-1])), None: want[-1]}
        assert got[0].report in ("extra", None)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 7]
    none = spark.createDataFrame([], ITEM)
    assert decontam.drop_contaminated(docs, none).count() == len(texts) + 1
    assert decontam.scan(spark.createDataFrame([], DOCS), bench).collect() == []
