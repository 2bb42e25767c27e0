"""URLs judged by rules and, where no rule fits, by a path-template tree with labelled purity.

The tree has a root for each host and a level for each path segment, down to the last one. A segment becomes a wildcard if it
looks like a value (holds a digit) or if its siblings are mostly different from one another; below a wildcard the branches
of all its values are one. Segments that all paths of a branch share are followed in one step. Branches whose share of bad labels doesn't differ significantly from that of their siblings
are merged; a value whose share does, on enough labels, keeps a branch of its own. A template is rejected if its smoothed
share of bad labels is high. All of it is grouping and joining; what is joined is written first, so that joins read
plain shuffles, which Spark can split where a host or template is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.storage import dropped, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with all its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for a null or one without ://; only A-Z are lower-cased, and in the host alone."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _first_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one that is put on top is the longest
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def templates(urls: DataFrame, *, fan_out: int = 16, repeat: float = 4.0, z: float = 1.96, least_labels: int = 8) -> DataFrame:
    """(host, segments, n, labelled, bad, template) of each path, from rows (host, segments, bad), bad null where unlabelled.

    A node's children are one wildcard if there are over fan_out of them (all that hold a digit count as one) with fewer
    than repeat rows each on average. A child that would be part of a wildcard stands alone if its share of bad labels is
    apart from its siblings' and at least least_labels labels tell so. A segment without siblings has its name at once, so
    a round follows each node down to where its paths fork: rounds count the forks on a path, not its segments.
    """
    done = []
    rows = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = written(rows.select("*", F.lit("").alias("template"), F.lit(0).alias("level"), (F.size("segments") == 0).alias("ended")), "branches")
    digit = lambda s: s.rlike("[0-9]")
    while True:
        done.append(rows.filter("ended").drop("ended", "level"))
        todo = rows.filter("NOT ended").withColumn("seg", F.get("segments", "level"))
        if todo.isEmpty():
            break
        node = todo.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.count("*").alias("paths"))
        node = written(node.withColumn("value", digit(F.col("seg"))), "nodes")
        kids = F.count_if(~F.col("value")) + F.max(F.col("value").cast("int"))
        parent = node.groupBy("host", "template").agg(kids.alias("kids"), F.count("*").alias("segs"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad", "paths")))
        parent = written(parent, "parents")
        wild = F.col("value") | ((F.col("kids") > fan_out) & (F.col("all_n") < repeat * F.col("kids")))
        # the branch against its siblings: two shares that differ by less than z standard errors are one
        rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), rest_n)))
        apart = F.coalesce(F.abs(F.try_divide("bad", "labelled") - F.try_divide(rest_bad, rest_n)) > z * error, F.lit(False))
        alone = wild & apart & (F.least(F.col("labelled"), rest_n) >= least_labels)
        merged = ~alone & (wild | ((F.col("all_labelled") > 0) & ~apart & (F.col("kids") > 1)))
        forks = _forks(todo, parent)
        named = node.join(parent, ["host", "template"])
        named = named.withColumn("fork", F.lit(None).cast("int")) if forks is None else named.join(forks, ["host", "template"], "left")
        steps = F.when(F.col("segs") > 1, F.lit(1)).otherwise(F.col("fork"))
        named = written(named.select("host", "template", "seg", F.when(merged, F.lit("*")).otherwise(F.col("seg")).alias("name"), steps.alias("steps")), "named")
        left = F.size("segments") - F.col("level")
        took = F.least(F.coalesce("steps", left), left)
        names = F.transform(F.slice("segments", F.col("level") + 1, took), lambda s: F.when(digit(s), F.lit("*")).otherwise(s))
        name = F.when(F.col("steps") == 1, F.col("name")).otherwise(F.array_join(names, "/"))
        nxt = todo.join(named, ["host", "template", "seg"]).select("host", "segments", "n", "labelled", "bad", F.concat("template", F.lit("/"), name).alias("template"), (F.col("level") + took).alias("level"), (took == left).alias("ended"))
        rows = written(nxt, "branches")
        for table in (node, parent, named, forks):
            dropped(table)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _forks(todo: DataFrame, parent: DataFrame) -> DataFrame | None:
    """(host, template, fork) of the nodes with several paths and one next segment: how many segments their paths share
    before two of them differ, null if all of them lie on one path. None if there are no such nodes.

    Each path is compared with the longest one of its node: what agrees with that so far agrees with one another.
    """
    chains = parent.filter("segs = 1 AND all_paths > 1").select("host", "template")
    if chains.isEmpty():
        return None
    paths = written(todo.join(chains, ["host", "template"], "left_semi").select("host", "template", F.slice("segments", F.col("level") + 1, F.size("segments") - F.col("level")).alias("rest")), "chains")
    longest = written(paths.groupBy("host", "template").agg(F.max_by("rest", F.size("rest")).alias("longest")), "longest")
    differs = F.zip_with("rest", F.slice("longest", 1, F.size("rest")), lambda a, b: a != b)
    at = F.nullif(F.array_position(differs, F.lit(True)), F.lit(0)) - 1
    out = written(paths.join(longest, ["host", "template"]).groupBy("host", "template").agg(F.min(at).cast("int").alias("fork")), "forks")
    dropped(paths)
    dropped(longest)
    return out


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "toxic", *, rules: tuple[UrlRule, ...] = RULES, prior: float = 2.0, reject: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity): one row for each page.

    A rule's verdict comes first, the longest rule winning. Otherwise a page is blocked if its template's share of bad
    labels, smoothed by prior pseudo-pages of its host's and the corpus's share, is over reject. Labels are rows
    of the label table (a page counts as bad if any of its labels is 1) and, for pages that a rule decides, the rule's verdict.

    A null url or one without :// has an empty host and path and forms a host of its own. Ids may be null or repeat: rows
    come out once each. Other columns are ignored; an empty table gives an empty one, without labels all is allowed.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = _first_rule(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), segments.alias("segments"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label"))
    rows = rows.join(known, "id", "left")
    bad = F.coalesce("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    leaves = templates(rows.withColumn("bad", bad))
    by_template = written(leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "by_template")
    by_host = written(by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad")), "by_host")
    overall = by_host.agg(F.coalesce(F.try_divide(F.sum("host_bad"), F.sum("host_labelled")), F.lit(0.0)).alias("share"))
    host_share = (F.col("host_bad") + prior * F.col("share")) / (F.col("host_labelled") + prior)
    purity = (F.col("bad") + prior * host_share) / (F.col("labelled") + prior)
    judged = by_template.join(by_host, "host").crossJoin(F.broadcast(overall)).select("host", "template", purity.alias("purity"))
    judged = written(judged, "judged")
    place = leaves.select("host", "segments", "template").join(judged, ["host", "template"])
    out = rows.join(place, ["host", "segments"], "left")
    method = F.when(F.col("purity") > reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")

