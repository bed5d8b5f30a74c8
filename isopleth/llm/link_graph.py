"""URL filter by link-graph propagation: personalised PageRank of trust, and of distrust against the links.

Pages that an allow rule fits seed trust at their hosts, pages that a block rule fits seed distrust. Trust
flows along host edges, distrust from a linked host back to those that link to it. Edges are the links between
pages of different hosts, and one both ways between a host and the domain above it, up to two labels: who
answers for a domain answers for its subdomains, in part, so such an edge carries DOMAIN_SHARE of what it is
given. A host is blocked when its distrust exceeds its trust by the
threshold; pages that no rule fits get their host's verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 1.0
#: Least mass of a host that mass reaches, well above the numbers that doubles hold with fewer digits.
LEAST_MASS = 1e-290
#: What an edge between a host and the domain above it carries on; the rest returns to the seeds.
DOMAIN_SHARE = 0.25
#: Hops between two looks at what still moves. Longer names are none of the domain name system and have no domains above them.
HOPS, LONGEST_NAME = 4, 253
#: Verdicts are broadcast to the pages up to this number of hosts.
BROADCAST_HOSTS = 200_000
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _by_rule(rules: Sequence[Rule], value) -> Column:
    """Value of the longest rule that fits columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(fits, value(rule)).otherwise(out)
    return out


def judged_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`pages` with host, path, rule and by_rule (the rule's verdict, null where none fits)."""
    located = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return located.withColumn("rule", _by_rule(rules, lambda r: F.lit(r.host + r.path))).withColumn("by_rule", _by_rule(rules, lambda r: F.lit(r.verdict)))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, counted. Relative links stay on their host and count for nothing, in a text of any length."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    found = pages.select(host_of(F.col("url")).alias("src"), link.alias("link")).where(F.col("link").startswith("//") | F.col("link").contains("://"))
    hosts = found.select("src", host_of(absolute).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return hosts.groupBy("src", "dst").agg(F.count("*").alias("links"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, links): every name of `hosts` (host), and every domain above it of two labels or more, with the domain next above, both ways."""
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    named = hosts.where(F.length("host") <= LONGEST_NAME).select(labels.alias("labels")).where("size(labels) > 2 and not exists(labels, x -> x = '')")
    chain = named.select(above.alias("chain")).select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("low"), F.slice("chain", 2, F.size("chain")).alias("high"))).alias("x"))
    steps = chain.select(F.col("x.low").alias("src"), F.col("x.high").alias("dst")).distinct()
    return steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("links", F.lit(1).cast("long"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, mass): personalised PageRank of `seeds` (kind, host, seed) over `edges` (kind, src, dst, links, carried), each kind's total mass that of its seeds.

    A host's mass is dealt to its edges by links; of that an edge carries on its carried in links. What is not
    carried, and mass at hosts without outgoing edges, returns to the seeds, which comes to letting it go and
    scaling the rest up. Runs until no hop adds more than `tolerance` of a host's mass, so none is newly reached either,
    however many hops that takes. A host that mass reaches keeps at least LEAST_MASS, so it differs from one
    out of reach. `seeds` lists every host of the edges. One row per host is kept in the checkpoint folder for
    every hop.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    flows = checkpoint(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("carried") / F.col("all_links")).alias("share")))
    seed = F.col("seed").cast("double")
    ranks = seeds = checkpoint(seeds.select("kind", "host", seed.alias("mass"), seed.alias("fresh")))
    while True:
        for _ in range(HOPS):
            # merged, not broadcast: very many hops would leave the driver as many broadcast tables to hold
            sent = ranks.where("fresh > 0").select("kind", F.col("host").alias("src"), "fresh").hint("merge")
            moved = flows.join(sent, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("fresh") * F.col("share"))).alias("come"))
            fresh = F.when(F.col("come").isNull(), 0.0).when(F.col("mass") == 0, F.greatest("come", F.lit(LEAST_MASS))).otherwise(F.col("come"))
            ranks = checkpoint(ranks.join(moved.hint("merge"), ["kind", "host"], "left").select("kind", "host", (F.col("mass") + fresh).alias("mass"), fresh.alias("fresh")))
        if not ranks.where(F.col("fresh") > F.lit(tolerance) * F.col("mass")).limit(1).count():
            break
    # one row a kind
    given, held = (df.groupBy("kind").agg(F.sum("mass").alias(name)) for df, name in ((seeds, "given"), (ranks, "held")))
    scaled = F.when(F.col("held") > 0, F.col("mass") * (F.col("given") / F.col("held"))).otherwise(F.col("mass"))
    return ranks.join(F.broadcast(given.join(held, "kind")), "kind").select("kind", "host", scaled.alias("mass"))


def host_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host of a page or of a link, and of the domains above them."""
    judged = judged_urls(pages.select("url"), rules).where("host <> ''")
    counts = checkpoint(judged.groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    links = checkpoint(host_links(pages))
    names = counts.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    both_ways = domain_links(names).withColumn("carried", DOMAIN_SHARE * F.col("links"))
    every_edge = links.withColumn("carried", F.col("links").cast("double")).unionByName(both_ways)
    edges = checkpoint(every_edge.groupBy("src", "dst").agg(F.sum("links").alias("links"), F.sum("carried").alias("carried")))
    every = names.union(edges.select("src")).union(edges.select("dst")).distinct()
    hosts = checkpoint(every.join(counts, "host", "left").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("allowed", "blocked"))))
    seeds = hosts.select("host", F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("seed")) for kind, c in (("trust", "allowed"), ("distrust", "blocked"))))))
    along, against = (edges.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "links", "carried") for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src")))
    mass = propagate(seeds, along.unionByName(against))
    both = mass.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind) for kind in ("trust", "distrust")))
    verdict = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return both.select("host", "trust", "distrust", verdict.alias("host_verdict"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of `pages` (page_id, url, html).

    A rule's verdict stands; else the host's. Urls that are null or without :// have an empty host, which no
    rule or link reaches: allow. Null pages link nowhere. Equal distrust and trust allow; repeated rows count as
    often as they stand there and stay; other columns do not come along. An empty table gives no rows.
    """
    hosts = checkpoint(host_verdicts(pages, rules, threshold))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    judged = judged_urls(pages.select("page_id", "url"), rules)
    verdict = F.coalesce("by_rule", "host_verdict", F.lit("allow"))
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
