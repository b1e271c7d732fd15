"""URL filter (operator 6): rules on hosts and paths, and trust that spreads over the links of hosts.

Each url is judged by the longest rule that fits its host (or a parent of it) and its path. Urls
that no rule fits are judged by their host: trust flows along links from hosts whose pages rules
mostly allow (personalised PageRank), distrust flows against the links from hosts whose pages
rules mostly block (who links to a blocked host is suspect). A host is blocked if its distrust
passes its trust by the threshold. All of it is DataFrame operations.

Scores are walks' expected visits: score = (1 - damping) * seed + damping * what flows in, where a
seed is the share of a host's pages that rules allow (or block), from 0 to 1; mass at hosts
without links ends. So scores do not shrink as seeds are added, and with the default threshold,
half a full seed's own score, a host without links is blocked if more than half of its pages are
blocked by rules, net of those allowed.

Defined results: a null url, or one without `://`, has an empty host and path and is allowed
unless a rule says otherwise; null ids and repeated rows are kept as they are; a null page has
no links; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import cut, written

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 20  # of a walk of fixed length
#: Iterations stop when no score moves by more than this.
TOLERANCE = 1e-6
#: A guard, not a cut: 0.85 to this power, times all hosts there are, is far below the tolerance.
MOST_ROUNDS = 300
THRESHOLD = (1 - DAMPING) / 2
CUT_EVERY = 5

_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))


def _lower(x: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lower(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def match(rules: Sequence[tuple[str, str]], host_: Column, path_: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules are a stated list, held in the plan."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links of pages between different hosts; counted before the shuffle."""
    found = pages.select(host(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), 1)).alias("dst"))
    found = found.withColumn("dst", _lower(F.col("dst")))
    return found.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds(host, trust, distrust) and edges(src, dst, n).

    rounds: the walk's length at most; None goes on until no score moves by more than the tolerance between
    two cuts (about 85 rounds on a cycle), and raises if that never comes.

    Both flows run as one: a flow's kind is part of the key. A round joins the shares of the links
    with the scores and sums what flows in, before the shuffle as far as it can; the plan is cut
    every few rounds. A host with very many links is one key of that join, which Spark splits.
    """
    ahead = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    both = ahead.union(back)
    total = both.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    share = written(both.join(total, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("share")), "host-links")
    seed = seeds.select("host", F.expr("stack(2, 'trust', double(trust), 'distrust', double(distrust)) AS (kind, seed)")).where("seed > 0")
    seed = seed.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    if share.isEmpty():
        score = seed
    else:
        seed = score = last = cut(seed)
        for k in range(1, (rounds or MOST_ROUNDS) + 1):
            flow = share.join(score.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            new = flow.union(seed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k % CUT_EVERY == 0 or k == rounds:
                # against the last cut, so that no round is computed twice
                new = cut(new)
                moved = new.join(last.withColumnRenamed("score", "old"), ["kind", "host"], "left").where(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) > tolerance)
                score = last = new
                if moved.isEmpty():
                    break
            else:
                score = new
        else:
            if rounds is None:
                raise RuntimeError(f"scores still move after {MOST_ROUNDS} rounds")
    return score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages."""
    h, p = host(F.col(url_col)), path(F.col(url_col))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), h.alias("host"), p.alias("path")).withColumn("m", match(rules, F.col("host"), F.col("path")))
    slim = slim.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled"))
    of = lambda v: F.avg(F.coalesce((F.col("ruled") == v).cast("double"), F.lit(0.0)))
    seeds = slim.where("host <> ''").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    scores = written(propagate(seeds, host_edges(pages, url_col, html_col), rounds=None), "host-scores").withColumnRenamed("host", "scored")
    net = F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0))
    verdict = F.coalesce(F.col("ruled"), F.when(net > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return slim.join(scores, F.col("host") == F.col("scored"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
