"""Near duplicates, repeated passages, components, word hashes and neighbours against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cartulary import session
from cartulary.llm import components as components_module
from cartulary.llm import additive, omh, passages, queries
from cartulary.llm.components import components
from cartulary.llm.words import hash_words
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, edits, groups, words


def near_classes(rows):
    own = {i: words(t) for i, t in rows if i is not None}
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in own.items()}
    same, links, holders, shared = {}, [], defaultdict(list), Counter()
    for i in sorted(own):
        if own[i]:
            links.append((same.setdefault(tuple(own[i]), i), i))
    for i in same.values():
        for g in grams[i]:
            holders[g].append(i)
    for ids in holders.values():
        for k, a in enumerate(sorted(ids)):
            for b in sorted(ids)[k + 1 :]:
                shared[a, b] += 1
    links += [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(grams[a]) + len(grams[b]) - n) and edits(own[a], own[b]) <= 0.2 * max(len(own[a]), len(own[b]))]
    return groups(own, links)


def replaced(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_word_hashes():
    texts = ["", "a", " ", "A b", "b a", "é É", "x1-y"] + ["".join(random.Random(i).choices("ab é1.", k=60)) for i in range(50)]
    hashes, starts = hash_words(texts)
    name = {}
    for i, t in enumerate(texts):
        own = hashes[starts[i] : starts[i + 1]].tolist()
        assert len(own) == len(words(t))
        for w, h in zip(words(t), own, strict=True):
            assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)
    assert hash_words([])[1].tolist() == [0]


def test_banded_distances():
    rng = random.Random(3)
    left, right, most = [], [], []
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(0, 3)] * rng.randint(0, 2)
        left.append(np.array(a, np.uint32))
        right.append(np.array(b, np.uint32))
        most.append(rng.randint(0, 8))
    for a, b, m, d in zip(left, right, most, omh.distances(left, right, np.array(most)).tolist(), strict=True):
        true = edits(a.tolist(), b.tolist())
        assert d == true if true <= m else d > m


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    want = groups({x for p in links for x in p}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_on_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op8_omh(spark, sf).collect()}
    assert got == near_classes(rows)


def test_near_duplicates_in_groups_and_cases(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(50)) for _ in range(60))
    rows = [(0, None), (1, ""), (2, "..."), (3, "two words"), (4, "Two, words!"), (None, "two words"), (3, "two words")]
    for g in range(12):
        base = " ".join(f"g{g}w{rng.randrange(400)}" for _ in range(120))
        rows += [(100 * (g + 1) + c, replaced(rng, base, rng.randint(0, 2)) + (" " + passage if g < 6 else "")) for c in range(25)]
    rows.append((9000, " ".join(f"long{rng.randrange(900)}" for _ in range(20000))))
    docs = spark.createDataFrame(rows, DOCS).withColumn("words", F.lit("clash"))
    got = {r.doc_id: r.class_id for r in omh.classes(docs).collect()}
    want = near_classes(rows)
    assert got == want
    kept = omh.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(i for i, _ in rows if i is None or want[i] == i)
    assert omh.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_near_rows_of_one_id_with_different_texts(spark):
    one, two = " ".join(f"s{k}" for k in range(60)), " ".join(f"t{k}" for k in range(60))
    rows = [(0, one), (1, one), (1, two), (2, f"{two} more"), (3, "alone among all others here"), (3, "and its second row of text")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.class_id) for r in omh.classes(docs).collect()) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 3), (3, 3)]
    kept = sorted((r.doc_id, r.text) for r in omh.keep_first(docs).collect())
    assert kept == sorted([rows[0], rows[2], rows[4], rows[5]])


def test_near_pairs_in_a_large_family(spark):
    """Every pair of copies in a family that shares most of its text, but less than the limit, is found."""
    rng = random.Random(11)
    base = [f"t{rng.randrange(10**7)}" for _ in range(300)]
    rows = []
    for k in range(150):
        own, at = list(base), rng.sample(range(10), 2)
        for c in at:  # a run of own words in two of ten places
            own[30 * c : 30 * c + 15] = [f"p{rng.randrange(10**7)}" for _ in range(15)]
        for c in range(2):
            copy = list(own)
            for j in rng.sample(range(300), 3):
                copy[j] = f"c{rng.randrange(10**7)}"
            rows.append((2 * k + c, " ".join(copy)))
    want = near_classes(rows)
    assert len(set(want.values())) > 50
    got = {r.doc_id: r.class_id for r in omh.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_near_rounds_in_crowds(spark, monkeypatch):
    """Classes are those of all pairs, whatever the rounds have met before the rest is listed."""
    rng = random.Random(12)
    rows = []
    for f in range(2):
        base = " ".join(f"f{f}w{rng.randrange(10**7)}" for _ in range(100))
        rows += [(1000 * f + i, replaced(rng, base, rng.randint(1, 4))) for i in range(90)]
    want = near_classes(rows)
    assert 10 < len(set(want.values())) < 170
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(omh, "GROUP", 4)
    for part, few, slow in ((8, 0, 0.999), (8, 0, 0.75), (128, 10**9, 0.75)):
        monkeypatch.setattr(omh, "PART", part)
        monkeypatch.setattr(omh, "FEW", few)
        monkeypatch.setattr(omh, "SLOW", slow)
        assert {r.doc_id: r.class_id for r in omh.classes(docs).collect()} == want


def test_edits_within_a_limit(monkeypatch):
    rng = random.Random(13)
    for i in range(600):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 90))]
        b = [rng.randint(0, 6) if rng.random() < 0.1 else x for x in a if rng.random() > 0.08] + [rng.randint(0, 6)] * rng.randint(0, 2)
        most, true = rng.randint(0, 40), edits(a, b)
        if i == 400:
            monkeypatch.setattr(passages, "LONG", 20)  # longer ones by bands
        for x, y in ((a, b), (b, a)):
            assert passages.edits_within(np.array(x, np.uint32), np.array(y, np.uint32), most) == min(true, most + 1)


def test_passages_remove_scratch_tables(spark):
    """What only finished steps read, seeds and keys above all, is not on disk when the passages are there."""
    shared = [" ".join(f"g{g}w{k}" for k in range(60)) for g in range(3)]
    rows = [(i, f"{shared[i % 3]} " + " ".join(f"o{i}x{k}" for k in range(30))) for i in range(60)]
    before = set(session._live)
    out = passages.repeats(spark.createDataFrame(rows, DOCS))
    left = Counter(p.rpartition("/")[2].partition("-")[0] for p in session._live if p not in before)
    assert not left.keys() & {"seeds", "reps", "keys", "key_counts", "centres", "runs"}, left
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_chains_keep_order():
    xs, ys = np.array([1, 5, 9, 9, 30, 31, 32, 200]), np.array([101, 105, 109, 400, 3, 4, 5, 300])
    found = [[(int(xs[j]), int(ys[j])) for j in chain] for chain in passages.linked(xs, ys, xs, ys)]
    assert [(1, 101), (5, 105), (9, 109)] in found and [(30, 3), (31, 4), (32, 5)] in found
    assert sorted(p for c in found for p in c) == sorted(zip(xs.tolist(), ys.tolist(), strict=True))


def test_seeds_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(1)
    shared = rng.integers(1 << 63, 1 << 64, 300, dtype=np.uint64)
    alone = set(shared[passages.picked(shared, np.array([0, 300]))].tolist())
    around = np.concatenate([rng.integers(0, 1 << 62, 40, dtype=np.uint64), shared, rng.integers(0, 1 << 62, 9, dtype=np.uint64)])
    there = set(around[passages.picked(around, np.array([0, 349]))].tolist())
    assert alone <= there and len(alone) >= 300 // passages.WINDOW  # none is below the share, so all are minimizers
    assert passages.picked(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == []


def test_passage_whose_halves_stand_elsewhere(spark):
    """Documents that alone share a passage meet, though its halves are in thirty others each."""
    rng = random.Random(21)
    rows, pairs = [], []
    for g in range(12):
        halves = [[f"g{g}h{h}w{k}" for k in range(30)] for h in range(2)]
        at = 1000 * g
        for c in range(62):
            own = [f"o{at + c}x{k}" for k in range(80)]
            part = halves[0] + halves[1] if c < 2 else halves[c % 2]
            cut = rng.randrange(80)
            rows.append((at + c, " ".join(own[:cut] + part + own[cut:])))
        pairs.append((at, at + 1))
    got = {(r.doc_id, r.other_id) for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_recall_by_edit_rate(spark):
    """Copies of 80 words with one word in n replaced: documents found."""
    rng = random.Random(31)
    rows, kind = [], {}
    for n in (25, 15, 10, 7):
        for g in range(60):
            base = [f"n{n}g{g}w{rng.randrange(10**6)}" for _ in range(80)]
            other = [f"e{n}x{g}y{k}" if k % n == n // 2 else w for k, w in enumerate(base)]
            for part in (base, other):
                i = len(rows)
                own = [f"o{i}x{k}" for k in range(100)]
                rows.append((i, " ".join(own[:50] + part + own[50:])))
                kind[i] = n
    got = {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    recall = {n: sum(kind[i] == n for i in got) / 120 for n in (25, 15, 10, 7)}
    assert min(recall.values()) >= 0.9 and recall[25] == recall[15] == 1, recall


def test_rows_of_one_id_with_different_texts(spark):
    shared, other = " ".join(f"s{k}" for k in range(60)), " ".join(f"t{k}" for k in range(60))
    rows = [(1, f"a b c {shared}"), (1, f"{other} d e f"), (2, f"x y {shared} z"), (3, f"q {other} r")]
    got = {(r.doc_id, r.other_id) for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 2), (2, 1), (1, 3), (3, 1)}
    assert passages.repeats(spark.createDataFrame([(1, f"a {shared}"), (1, f"{shared} b")], DOCS)).collect() == []


def test_passages_on_tables(spark, sf):
    """Every window of 50 words that two documents share lies in a reported span; every span reported is a repeat."""
    rows = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_passages(spark, sf).collect()
    seen, covered = defaultdict(set), defaultdict(set)
    for i, w in rows.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.end))
        a, b = rows[r.doc_id][r.start : r.end], rows[r.other_id][r.other_start : r.other_end]
        assert r.doc_id != r.other_id and min(len(a), len(b)) >= 50
        if max(len(a), len(b)) < 400:
            assert edits(a, b) == r.edits <= 0.2 * max(len(a), len(b))
    for i, w in rows.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= covered[i]


def test_passages_planted_and_cases(spark):
    rng = random.Random(6)
    common = [f"c{rng.randrange(500)}" for _ in range(70)]
    rows = [(0, None), (1, ""), (2, "short text " * 3), (None, " ".join(common))]
    for i in range(10, 60):
        own = [f"o{i}x{rng.randrange(1000)}" for _ in range(150)]
        at, part = rng.randrange(150), list(common)
        if i % 2:
            part[rng.randrange(20, 50)] = "edited"
        rows.append((i, " ".join(own[:at] + (part if i >= 20 else []) + own[at:])))
    rows += [(60, rows[-1][1]), (61, rows[-1][1]), (61, rows[-1][1])]
    got = passages.repeats(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(1))).collect()
    assert {r.doc_id for r in got} == set(range(20, 62))
    assert all(r.end - r.start >= 68 for r in got)
    assert passages.repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_passages_apart_in_both_texts(spark):
    """Two exact passages with different words between them are found, whatever the gap."""
    rng = random.Random(8)

    def own(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    rows, want = [], {}
    for k, (size, gap) in enumerate([(60, 40), (60, 130), (60, 260), (200, 150), (200, 500)]):
        a, b = own(size), own(size)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(own(30) + a + own(gap) + b + own(30))))
            want[i] = set(range(30, 30 + size)) | set(range(30 + size + gap, 30 + 2 * size + gap))
    covered = defaultdict(set)
    for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect():
        assert r.edits <= 0.2 * (r.end - r.start)
        covered[r.doc_id] |= set(range(r.start, r.end))
    assert all(want[i] <= covered[i] for i in want)


def test_passages_of_common_sentences(spark):
    """Two documents that alone share a run of three sentences meet, though each sentence is in many others."""
    rng = random.Random(9)
    stock = [" ".join(f"s{k}w{rng.randrange(10**6)}" for _ in range(20)) for k in range(60)]
    rows, planted = [], {}
    for i in range(400):
        rows.append((i, " ".join(rng.sample(stock, 8))))
    for k in range(20):
        run = " ".join(rng.sample(stock, 3))
        for i in (1000 + 2 * k, 1001 + 2 * k):
            own = [f"o{i}x{j}" for j in range(60)]
            rows.append((i, " ".join([*own[:30], run, *own[30:]])))
            planted[i] = i ^ 1
    got = {(r.doc_id, r.other_id) for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert all((a, b) in got for a, b in planted.items())


def test_passages_with_edits_up_to_the_limit(spark):
    """Recall of isolated pairs with 60 shared words, by the number of substitutions."""
    rng = random.Random(10)
    rows, found = [], Counter()
    for n, edited in enumerate((6, 9, 12)):
        for k in range(100):
            base = [f"b{rng.randrange(10**7)}" for _ in range(60)]
            other = list(base)
            for j in rng.sample(range(60), edited):
                other[j] = f"e{rng.randrange(10**7)}"
            for c, part in enumerate((base, other)):
                own = [f"o{rng.randrange(10**7)}" for _ in range(80)]
                rows.append((1000 * n + 2 * k + c, " ".join([*own[:40], *part, *own[40:]])))
    pairs = {(r.doc_id, r.other_id) for r in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    for a, b in pairs:
        assert a ^ 1 == b
        found[a // 1000] += a < b
    print(found)
    assert found[0] >= 98 and found[1] >= 95 and found[2] >= 75


def exact(vectors, queries_, k):
    out = {}
    for q in queries_:
        ids = np.array([i for i in sorted(vectors) if i != q])
        scores = np.array([float((np.float64(vectors[i]) * np.float64(vectors[q])).sum()) for i in ids])
        order = np.lexsort((ids, -scores))[:k]
        out[q] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_neighbours_recall(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in sorted(queries.op9_additive(spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert abs(s - float((np.float64(vectors[i]) * np.float64(vectors[q])).sum())) < 1e-12


def test_codes_approximate():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 16)).astype(np.float32)
    books = additive.fit(data, books=4, words=32)
    codes, norms = books.encode(data)
    near = books.approximate(codes)
    assert ((data - near) ** 2).sum() < 0.5 * (data**2).sum()
    assert np.allclose(norms, (near**2).sum(1), rtol=1e-4)
    assert np.allclose(books.distances(data[:5], codes, norms), ((near[:, None] - data[None, :5]) ** 2).sum(2), atol=1e-2)


def test_neighbour_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (3, [2.0, 0.0])]
    made, books, dim = additive.index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in additive.search(made, books, dim, made.where("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 3, 2.0), (0, 2, 4, 2.0), (0, 3, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 4, 2.0), (20, 3, 0, 1.0)]
    for empty in ([], [(1, None), (20, [0.0, 0.0])]):
        made, books, dim = additive.index(spark.createDataFrame(empty, "vec_id long, embedding array<float>"))
        assert additive.search(made, books, dim, made, 20).collect() == []


@pytest.mark.parametrize("many", [200_000, 20])
def test_components_of_few_and_many_links(spark, monkeypatch, many):
    monkeypatch.setattr(components_module, "MANY", many)
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (3, 2), (2, 3), (2, 3)]
    found = components_module.components(spark.createDataFrame(chain, "a long, b long"))
    expected = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {2: 2, 3: 2}
    assert sorted(map(tuple, found.select("node", "component").collect())) == sorted(expected.items())
    assert components_module.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_near_keeps_words_of_candidates_only(spark):
    """The table of sketches holds no texts; equal rows of one doc_id give their words once."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m n"), (3, None)], DOCS)
    table = omh.sketches(docs)
    assert table.columns == ["doc_id", "t", "same", "sketch"]
    known = table.select("doc_id", "t")
    got = omh.words_of(docs, known, known.where("doc_id = 1").distinct(), "doc_id", "text").collect()
    assert [r.doc_id for r in got] == [r.same for r in table.where("doc_id = 1").select("same").distinct().collect()]
    assert [len(r.words) for r in got] == [28]
