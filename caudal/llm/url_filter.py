"""URL filtering: rules where they fit, elsewhere trust and distrust spread over host links.

Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are
distrusted ones. Personalised PageRank carries trust along links (what good hosts link to is
likely good) and distrust against them (who links to bad hosts is likely bad). A host where
distrust outweighs trust by the threshold is blocked. Only Spark's own operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caudal.llm.common import stored
from caudal.llm.urls import host_of, path_of

# Share of a host's rank that its links pass on; the rest returns to the seeds.
DAMPING = 0.85
# The walk ends when no host's rank grows by more than this share of itself. A host that a step
# reaches first grows by all of it, so the walk goes on until every host that can be reached is.
CONVERGED = 1e-3
# A host is blocked when distrust is more than this share of trust and distrust together.
BLOCK_SHARE = 0.5
# Hosts that href attributes name; relative links stay on their host and say nothing.
_LINKED = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def match_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each (host, path): adds ``rule`` and ``rule_verdict``.

    ``rules`` has rule (host and path prefix, like ``example.org/en/``) and verdict. A host is
    looked up by each of its suffixes and a path by its prefixes of just those lengths that
    the suffix has rules of, so the work does not follow the number of rules of one host.
    """
    parts = rules.select(
        "rule", F.col("verdict").alias("rule_verdict"),
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("prefix"),
    )
    lengths = parts.select("suffix", F.char_length("prefix").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = (
        addresses.withColumn("suffix", F.explode(suffixes))
        .join(lengths, "suffix").filter(F.char_length("path") >= F.col("n"))
        .withColumn("prefix", F.expr("left(path, n)"))
        .join(parts, ["suffix", "prefix"])
    )
    longest = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("rule").alias("n"), "rule", "rule_verdict")).alias("best")
    )
    best = longest.select("host", "path", "best.rule", "best.rule_verdict")
    return addresses.join(best, ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many links pages of one host have to another."""
    linked = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINKED), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(linked).alias("to"))
    return (
        links.select("src", host_of(F.concat(F.lit("://"), "to")).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("weight"))
    )


def personalised_rank(
    edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING,
    converged: float = CONVERGED,
) -> DataFrame:
    """(host, rank) from ``seeds`` (host, seed): what a walk that returns to the seeds visits.

    Ranks are in the units of the seeds and add up to their sum. Each step passes on what the
    step before brought, the first one the seeds, and a rank is the sum of all that came; what
    returns to the seeds repeats the same walk and only scales it. Incoming rank is added up per
    host before each shuffle, so a host with very many links is a sum and not a group. Each step
    is a stored table. There is no limit of steps: what a step brings shrinks by ``damping``.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = stored(
        edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")),
        "link-shares",
    )
    seed = F.col("seed").cast("double")
    ranks = stored(seeds.select("host", seed.alias("rank"), seed.alias("came")), "ranks")
    if shares.isEmpty():
        return ranks.select("host", "rank")
    total = F.lit(ranks.agg(F.sum("rank")).first()[0])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    while True:
        moved = (
            shares.join(ranks.filter("came > 0").select(F.col("host").alias("src"), "came"), "src")
            .groupBy(F.col("dst").alias("host"))
            .agg((damping * F.sum(F.col("came") * F.col("share"))).alias("came"))
        )
        ranks = stored(
            ranks.select("host", "rank").join(moved, "host", "full_outer").select(
                "host", (zero("rank") + zero("came")).alias("rank"), zero("came").alias("came")
            ),
            "ranks",
        )
        if ranks.filter(F.col("came") > converged * F.col("rank")).isEmpty():
            visits = ranks.agg(F.sum("rank")).first()[0]
            return ranks.select("host", (F.col("rank") * total / F.lit(visits)).alias("rank"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, block_share: float = BLOCK_SHARE,
    damping: float = DAMPING,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, method: one row per row of ``pages``.

    ``verdict`` is the rule's where one fits (``method`` rule), else the host's: block when
    distrust / (trust + distrust) is above ``block_share``, allow otherwise (``method`` links).
    A host that neither rank reaches is allowed, as is a row without an address, whose host and
    path are empty. A NULL html has no links. Repeated rows are returned each; other columns
    are not looked at; an empty table gives no rows, and with no rules everything is allowed.
    """
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"
    )
    addresses = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    matched = stored(match_rules(addresses, rules), "url-rules")
    edges = stored(host_links(rows), "host-links")

    def seeds(verdict: str) -> DataFrame:
        chosen = matched.filter((F.col("rule_verdict") == verdict) & (F.col("host") != ""))
        return chosen.groupBy("host").agg(F.sum("pages").alias("seed"))

    trust = personalised_rank(edges, seeds("allow"), damping=damping)
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(backwards, seeds("block"), damping=damping)
    hosts = stored(
        trust.select("host", F.col("rank").alias("trust"))
        .join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full_outer")
        .fillna(0.0, ["trust", "distrust"]),
        "host-ranks",
    )
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    by_links: Column = F.when(share > block_share, "block").otherwise("allow")
    judged = rows.select("page_id", "host", "path").join(
        matched.select("host", "path", "rule", "rule_verdict"), ["host", "path"], "left"
    ).join(hosts, "host", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", by_links).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        F.when(F.col("rule").isNull(), "links").otherwise("rule").alias("method"),
    )
