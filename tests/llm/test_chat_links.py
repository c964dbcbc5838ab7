"""Reply trees, templates, URL rules and propagation."""

import hashlib
import random

import numpy as np
from cartulary.llm import chat, links, queries
from pyspark.sql import functions as F

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double"
CONTROL = ["</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|im_start|>", "<|", "<\\|", "[\\\\INST]", "a\\b", "\n", "é😀", "<s>", "$1", ""]


def esc(s):
    import re

    return re.sub(r"(<|\[)(\\*)(\||/?s>|/?INST\])", r"\1\\\2\3", s)


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices(CONTROL, k=rng.randint(0, 8)))) for i in range(300)]
    df = spark.createDataFrame(texts, "i int, t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and r.e == esc(r.t)
        assert not any(c in r.e for c in ("<|", "</s>", "[INST]", "[/INST]"))


def test_trees_ranked(spark):
    nodes = [
        (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "more", 9.0), (1, 5, 4, "assistant", "end", 2.0),
        (2, 1, 99, "user", None, None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (3, 3, 2, "user", "hangs on a loop", 0.0),
        (None, 1, None, None, "no tree", 0.0), (None, 2, 1, "assistant", "x", 0.0),
    ]
    got = sorted(((r.tree_id if r.tree_id is not None else -1, r.branch_rank, r.leaf_id, r.n_turns) for r in chat.format_trees(spark.createDataFrame(nodes, NODES)).collect()))
    assert got == [(-1, 1, 2, 2), (1, 1, 5, 4), (1, 2, 3, 2), (2, 1, 1, 1)]
    best = chat.format_trees(spark.createDataFrame(nodes, NODES), max_paths=1).where("tree_id = 1").head()
    assert best.formatted == "".join(f"<|im_start|>{r}<|im_sep|>{t}<|im_end|>\n" for r, t in (("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "end")))
    assert [best.formatted[s.start : s.start + s.length] for s in best.loss_spans] == ["a", "end"]
    assert chat.format_trees(spark.createDataFrame([], NODES)).collect() == []


def test_conversations_against_plain_python(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choices(CONTROL, k=4))])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += rows[:5] + [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(None, 0, "user", "x")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op2_chat(spark, path).collect()}
    said = "</s>[INST] ok [/INST]"
    by = {}
    for c, t, r, x in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by.setdefault(c, []).append((t, r is not None, r or "", x is not None, x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, _, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        text = "".join(f"<|im_start|>{esc(r)}<|im_sep|>{esc(x)}<|im_end|>\n" for r, x in turns)
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == len(text) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_urls_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "ftp://example.com/de/1#a": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://x.org/fr/?a://b/c": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.org?u": ("x.org", "", None, "allow"),
        "http://net": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http:///p": ("", "/p", None, "allow"),
        "a\nb://É.net/\n#": ("É.net", "/\n", "net/", "block"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in links.judge(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    assert links.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_distrust_runs_against_links(spark):
    def a(*hosts):
        return "".join(f'<a class="x" href="http://{h}/p">t</a>' for h in hosts)

    pages = [
        (1, "http://farm.com/", a("bad.net", "bad.net", "farm.com")), (2, "http://feeder.com/", a("farm.com")), (3, "http://good.org/fr/", a("friend.com")),
        (4, "http://friend.com/", "<a href='/own'>x</a>"), (5, "http://bad.net/", a("victim.com")), (6, "http://victim.com/", None), (7, "http://lone.com/", ""),
    ]
    got = {r.page_id: r for r in links.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow"}
    edges = {("farm.com", "bad.net"): 2, ("feeder.com", "farm.com"): 1, ("good.org", "friend.com"): 1, ("bad.net", "victim.com"): 1}
    hosts = sorted({h for e in edges for h in e})
    for name, seeds, pairs in (("trust", {"good.org": 1.0}, edges), ("distrust", {"bad.net": 1.0}, {(b, a_): n for (a_, b), n in edges.items()})):
        move = np.zeros((len(hosts), len(hosts)))
        totals = {}
        for (s, d), n in edges.items():
            key = s if name == "trust" else d
            totals[key] = totals.get(key, 0) + n
        for (s, d), n in pairs.items():
            move[hosts.index(d), hosts.index(s)] = n / totals[s]
        v = np.array([seeds.get(h, 0.0) for h in hosts])
        rank = v.copy()
        for _ in range(200):
            rank = 0.85 * move @ rank + 0.15 * v
        for r in got.values():
            if r.host in hosts:
                assert abs(r[name] - rank[hosts.index(r.host)]) < 1e-12


def test_verdicts_of_a_linked_web_equal_brute_force(spark):
    """Several hundred hosts in loops and long chains: every verdict by dense PageRank."""
    rng = random.Random(17)
    hosts = [f"h{i}.{rng.choice(('com', 'com', 'com', 'net', 'org', 'info'))}" for i in range(200)]
    out = {h: [rng.choice(hosts) for _ in range(rng.choice((0, 1, 1, 2)))] for h in hosts}
    for a, b in zip(hosts[:30], hosts[1:31], strict=True):  # a chain longer than twelve links
        out[a] = [b]
    pages = [(i, f"http://{h}/{rng.choice(('', 'fr/', 'en/'))}", "".join(f"<a href='http://{x}/'>t</a>" for x in out[h])) for i, h in enumerate(hosts)]
    got = {r.page_id: r for r in links.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    verdict = {}
    for i, u, _ in pages:
        host, path = hosts[i], "/" + u.split("/", 3)[3]
        verdict[host] = "allow" if host.endswith(".org") and path.startswith("/fr/") else "block" if host.endswith(".net") else None
    at = {h: i for i, h in enumerate(hosts)}
    score = {}
    for kind, seed in (("trust", "allow"), ("distrust", "block")):
        move = np.zeros((200, 200))
        pairs = [(a, b) if kind == "trust" else (b, a) for a in hosts for b in out[a] if a != b]
        for s, d in pairs:
            move[at[d], at[s]] += 1
        move /= np.maximum(move.sum(0), 1)
        v = np.array([1.0 if verdict[h] == seed else 0.0 for h in hosts])
        v /= v.sum()
        rank = v.copy()
        for _ in range(300):
            rank = 0.85 * move @ rank + 0.15 * v
        score[kind] = rank
    for i, h in enumerate(hosts):
        apart = score["distrust"][i] - score["trust"][i]
        assert got[i].verdict == (verdict[h] or ("block" if apart > 0 else "allow")) or abs(apart) < 1e-5, h
    assert sum(r.rule is None and r.verdict == "block" for r in got.values()) > 10
