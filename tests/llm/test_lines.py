import random

import numpy as np
import pytest
from cartulary.llm import lines
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, edits, groups


def mutate(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcdé ")
        elif kind < 0.7:
            out.insert(at, rng.choice("abcdé"))
        else:
            del out[at]
    return "".join(out)


def corpus(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 60))) for _ in range(n)]
    rows = [(i, "\n".join([rng.choice(base), mutate(rng, rng.choice(base), rng.randint(0, 4)), rng.choice(["short", "x" * 40 + "😀" + "y" * rng.randint(0, 2), ""])])) for i in range(120)]
    return rows


def expected(rows, edit_limit=lines.EDITS, least=lines.MIN_CHARS):
    seen = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                seen[(i, p)] = line
    distinct = sorted(set(seen.values()))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edit_limit and edits(a, b) <= edit_limit]
    return seen, links, groups(distinct, links)


def test_edit_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(4, 24)))
        b = mutate(rng, a, rng.randint(0, 5))
        pairs.append(max((a, b), (b, a), key=lambda p: len(p[0])))
    pairs = [(a, b) for a, b in pairs if len(a) - len(b) <= 2 and len(a) > 2]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        true = edits(r.a, r.b)
        assert r.d == true if true <= 2 else r.d > 2, (r, true)


def test_links_and_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        seen, links, want = expected(rows)
        docs = spark.createDataFrame(rows, DOCS)
        occ = lines.occurrences(docs).cache()
        names = {r.h: r.line for r in occ.select("h", "line").distinct().collect()}
        got = {tuple(sorted((names[r.a], names[r.b]))) for r in lines.line_links(occ).collect()}
        assert got == set(links)
        assert len(got) > 10
        found = {(r.doc_id, r.pos): r for r in lines.line_classes(docs).collect()}
        assert found.keys() == seen.keys()
        label = {}
        for at, r in found.items():
            assert label.setdefault(r["class"], want[seen[at]]) == want[seen[at]]
        assert len(label) == len(set(want[v] for v in seen.values()))
        first = {}
        for at in sorted(found):
            c = found[at]["class"]
            assert found[at]["repeats"] == (c in first)
            first.setdefault(c, at)


def test_report_and_cases(spark):
    long = "one line of text that is long enough to count"
    rows = [(1, f"{long}\nkeep this line as it is since nothing equals it"), (2, f"{long}!\nanother line that stays because it is its own"), (3, None), (4, ""), (5, " \n "), (6, long), (6, long), (None, long)]
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].repeated == [] and got[2].repeated == [0] and got[6].repeated == [0]
    assert got[1].n_links == 1 and got[2].n_links == 1
    assert [got[i].n_lines for i in (3, 4, 5)] == [0, 0, 0]
    assert lines.report(spark.createDataFrame([], DOCS)).collect() == []


def test_drop_lines_keeps_columns_and_copies(spark):
    long = "a line of boilerplate that stands in many documents"
    own = [f"the own text of document number {i} which is long enough to stay, {'w' * (5 * i)}" for i in range(4)]
    rows = [(i, f"{long}\n{own[i]}", i, "x") for i in range(3)] + [(9, f"{long}\n{own[0]}", 9, "copy"), (None, long, 0, "n"), (10, None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, `class` string")
    got = {r.doc_id: r for r in lines.drop_lines(docs).collect()}
    assert lines.drop_lines(docs).columns == docs.columns
    assert got[0].text == f"{long}\n{own[0]}" and got[1].text == own[1] and got[2].text == own[2]
    assert got[9].text == got[0].text  # a copy as a whole is left to the document stage
    assert got[None].text == long and got[10].text is None


def test_drop_lines_however_much_repeats(spark):
    rows = [(1, "first line\nfirst line\nfirst line\nown"), (2, "first line\nmine"), (3, "first line\nown"), (4, "other")]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "first line\nown", 2: "mine", 3: "", 4: "other"}


def test_rows_of_one_id_keep_their_own_lines(spark):
    shared = "a line of boilerplate that stands in many documents"
    rows = [(1, f"only in the first row of the two\n{shared}", 1, "x"), (1, f"{shared}\nonly in the second row of the two", 2, "y"), (2, f"{shared}\nmine", 3, "z"), (2, f"{shared}\nmine", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, gone_id string")
    got = {r.gone: r.text for r in lines.drop_lines(docs).collect()}
    assert lines.drop_lines(docs).columns == docs.columns
    assert "only in the first row of the two" in got[1] and "only in the second row of the two" in got[2]
    assert sum(shared in t for t in got.values()) == 1  # of the two rows, the one whose text comes first
    assert got[3] == got[4] == "mine"
    report = lines.report(docs).collect()
    assert len(report) == 4 and all(r.n_lines == 2 for r in report)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        lines.report(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_very_long_lines(spark):
    rng = random.Random(8)
    whole = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    other = whole[:1000] + "xy" + whole[1000:]
    far = whole[:9] + "1" + whole[10:5000] + "2" + whole[5001:900000] + "3" + whole[900001:]
    rows = [(1, whole), (2, f"{other}\nown line of the second document, which stays"), (3, far)]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: whole, 2: "own line of the second document, which stays", 3: far}


def family(seed, n, base_size=90):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(base_size))
    out = {base}
    while len(out) < n:
        a = list(rng.choice(sorted(out)[:50]) if rng.random() < 0.1 else base)
        for _ in range(rng.choice((1, 1, 1, 2, 6))):
            a[rng.randrange(len(a))] = rng.choice("abcdefghijklmnop ")
        out.add("".join(a))
    return sorted(out)


def substitutions(texts):
    """Links of texts of one length that differ in at most two places."""
    codes = np.array([[ord(c) for c in t] for t in texts])
    out = []
    for i in range(len(texts)):
        apart = (codes[i + 1 :] != codes[i]).sum(1)
        out += [(texts[i], texts[i + 1 + j]) for j in np.flatnonzero(apart <= 2)]
    return out


@pytest.mark.parametrize(("n", "dense"), [(2000, lines.DENSE), (150, 20)])
def test_a_large_family_has_the_components_of_all_pairs(spark, monkeypatch, n, dense):
    monkeypatch.setattr(lines, "DENSE", dense)  # few, so that keys are cut finer several times
    texts = family(3, n)
    want = groups(texts, substitutions(texts))
    occ = lines.occurrences(spark.createDataFrame(list(enumerate(texts)), DOCS)).cache()
    names = {r.h: r.line for r in occ.select("h", "line").collect()}
    links = [(names[r.a], names[r.b]) for r in lines.line_links(occ).collect()]
    assert len(links) < 40 * n  # not the pairs of the family
    assert groups(texts, links) == want and len(set(want.values())) > 1


@pytest.mark.parametrize(("n", "dense"), [(300, lines.DENSE), (150, 20)])
def test_the_report_counts_every_link_of_a_family(spark, monkeypatch, n, dense):
    monkeypatch.setattr(lines, "DENSE", dense)
    texts = family(4, n)
    want = dict.fromkeys(texts, 0)
    for pair in substitutions(texts):
        for t in pair:
            want[t] += 1
    docs = spark.createDataFrame([*enumerate(texts), (n, texts[0])], DOCS)  # a copy of a line is no other line
    got = {r.doc_id: r for r in lines.report(docs).collect()}
    assert [got[i].n_links for i in range(n)] == [want[t] for t in texts] and got[n].n_links == want[texts[0]]
    assert sum(want.values()) > 20 * n


def test_few_repeated_places_do_not_shuffle_the_texts(spark, monkeypatch):
    rows = [(i, f"a line of boilerplate that stands in many documents\nown line of number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {}
        for most in (lines.BROADCAST_PLACES, 0):
            monkeypatch.setattr(lines, "BROADCAST_PLACES", most)
            out = lines.drop_lines(docs)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan) == (most > 0)
            got[most] = sorted((r.doc_id, r.text) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len({str(x) for x in got.values()}) == 1
    assert [t for _, t in got[0]] == [rows[0][1]] + [f"own line of number {i}" for i in range(1, 40)]


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_rounds_meet_under_the_keys_of_all_segments(spark, monkeypatch, edits):
    """Every round has keys of some segments, and together they have all, each in one round."""
    asked = []
    one = lines._met
    monkeypatch.setattr(lines, "_met", lambda own, e, least, segments: asked.append(list(segments)) or one(own, e, least, segments))
    texts = [t + "abcdefgh" for t in family(5, 12)]
    occ = lines.occurrences(spark.createDataFrame(list(enumerate(texts)), DOCS)).cache()
    found = lines.met(occ, occ.select("doc_id", "h", "n"), edits, 32)
    assert sorted(sum(asked, [])) == list(range(edits + 1)) and len(asked) == min(2, edits // 2 + 1)
    whole = one(occ, edits, 32, range(edits + 1))
    assert sorted(found.collect()) == sorted(whole.collect())
