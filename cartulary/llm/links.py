"""URL filters: rules for hosts and paths, and trust propagated over the link graph for hosts that no rule names.

Host edges come from the hyperlinks of pages, counted per pair of hosts before
they are joined, so a host with a third of all pages is one row per neighbour.
Personalised PageRank spreads trust from the hosts most of whose pages the rules
allow along links; distrust starts at the hosts most of whose pages the rules
block and runs against the links: who links to the distrusted is distrusted.
Rounds go on until ranks settle. A host is blocked where its distrust exceeds its trust by more than a threshold.

Defined cases: a null url or one without "://" has an empty host and path, fits
no rule and is allowed; null or empty html has no links; links to the own host
carry nothing; repeated pages count as often as they come; without edges only
seeds have scores, without seeds none, and the method allows; no pages give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import cut

#: The sum of what a round moves at which ranks count as settled; all ranks sum to 1.
ERROR = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of hyperlinks between two different hosts. pages: host, html."""
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^\s"'>]+)"""
    links = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    pairs = links.select("src", host_of(whole).alias("dst")).where("dst <> '' AND dst <> src")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, error: float) -> DataFrame:
    """Personalised PageRank: host and rank, once a round moves no more than error in all. edges: src, dst, share (of src's weight); seeds: host, weight, summing to 1.

    Each round moves at most damping times as much as the one before, so rounds end.
    """
    rank, moving = seeds.select("host", F.col("weight").alias("rank")), error + 1
    while moving > error:
        before = rank
        moved = edges.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        held = seeds.select("host", (F.col("weight") * (1 - damping)).alias("rank"))
        rank = cut(moved.unionAll(held).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        step = rank.unionAll(before.select("host", -F.col("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("d"))
        moving = step.agg(F.sum("d").alias("d")).head().d or 0.0
    return rank


def host_scores(pages: DataFrame, damping: float = 0.85, error: float = ERROR) -> DataFrame:
    """host, trust and distrust of hosts that the link graph reaches. pages: host, html, verdict (of the rule or null)."""
    edges = cut(host_edges(pages), "edges")
    judged = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust")
    )
    judged = cut(judged.where("2 * trust > n OR 2 * distrust > n"), "seeds")
    out, linked = [], not edges.isEmpty()
    for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        seeds = judged.where(F.col(kind) * 2 > F.col("n")).select("host")
        weight = 1.0 / max(1, seeds.count())
        seeds = seeds.withColumn("weight", F.lit(weight))
        rank = seeds.select("host", (F.col("weight") * (1 - damping)).alias("rank"))
        if linked:
            sums = edges.groupBy(a).agg(F.sum("n").alias("total"))
            ways = cut(edges.join(sums, a).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("total")).alias("share")), "ways")
            rank = propagate(ways, seeds, damping, error)
        out.append(rank.withColumnRenamed("rank", kind))
    both = out[0].join(out[1], "host", "full_outer")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.0, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("page_id", "host", "path", "html", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    scores = host_scores(ruled)
    joined = ruled.drop("html").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust - trust > threshold, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
