"""Chains of versions: closure over links, order, outcome."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from marginalia.operators.diff import in_pieces
from marginalia.session import checkpoint_dir, written

MAX_STOPS = 12
OUT = ("reject", "desk-reject", "withdrawn")


def reach(seeds: DataFrame, links: DataFrame, *, stop_at: int | None = MAX_STOPS, hops: int = 12) -> DataFrame:
    """(root, id): papers reachable from each seed over links in either direction, in up to so many hops.

    A root stops growing after the hop in which it has reached stop_at papers (none: it goes on), so a hop may go over that
    number.
    """
    both = links.select(F.col("earlier").alias("x"), F.col("later").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    # papers that the last hop found, with the number found so far; links go both ways, so only it and the hop before can be met again
    edge = written(seeds.select(F.col("id").alias("root"), "id").distinct().withColumn("n", F.lit(1).cast("long")), "reach")
    levels, last = [edge], edge.limit(0)
    root = Window.partitionBy("root")
    for _ in range(hops):
        grows = edge if stop_at is None else edge.filter(F.col("n") < stop_at)
        near = grows.join(both, F.col("id") == F.col("x")).select("root", F.col("y").alias("id"), F.lit(0).cast("long").alias("n"))
        met = near.unionByName(grows).unionByName(last).repartition("root").groupBy("root", "id").agg(F.max("n").alias("n"))
        met = met.withColumn("all", F.max("n").over(root) + F.count_if(F.col("n") == 0).over(root))
        found = written(met.filter("n = 0").select("root", "id", F.col("all").alias("n")), "reach")
        if found.isEmpty():
            break
        levels.append(found)
        edge, last = found, grows
    return reduce(DataFrame.unionByName, levels).select("root", "id")


def components(links: DataFrame) -> DataFrame:
    """(id, root): each linked paper with the smallest id that it reaches over links (earlier, later) in either direction.

    Trees of parents are hooked on one another and made flat in the same round, so a chain of n papers takes about log n rounds;
    no pairs of a component are made, and papers without links aren't there.
    """
    checkpoint_dir(links.sparkSession)
    both = links.select(F.col("earlier").alias("u"), F.col("later").alias("v")).filter("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    tree = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("root")).checkpoint()
    while True:
        above = tree.select("id", "root").join(tree.select(F.col("id").alias("root"), F.col("root").alias("grand")), "root")
        near = both.join(above.select(F.col("id").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("least"))
        near = above.join(near, above["id"] == near["u"]).select("id", "root", F.least("least", "grand").alias("least"))
        lower = near.select("id", "least").unionByName(near.select(F.col("root").alias("id"), "least"))
        new = lower.groupBy("id").agg(F.min("least").alias("low")).join(tree, "id").select("id", F.least("low", "root").alias("root"), (F.col("low") < F.col("root")).alias("moved")).checkpoint()
        done = new.filter("moved").isEmpty()
        tree = new.select("id", "root")
        if done:
            return tree


def _kahn(ids, years, before) -> list[int]:
    """Places of one chain's stops in order: ready stops by (year, id), what is left on a cycle after them by (year, id)."""
    place = {int(i): k for k, i in enumerate(ids)}
    key = [(int(y), int(i)) for y, i in zip(years, ids, strict=True)]
    after, waits = [[] for _ in key], [0] * len(key)
    for k, e in enumerate(before):
        for j in {place[int(x)] for x in e if int(x) in place}:
            after[j].append(k)
            waits[k] += 1
    ready, out = [(key[k], k) for k, w in enumerate(waits) if not w], []
    heapq.heapify(ready)
    while ready:
        _, k = heapq.heappop(ready)
        out.append(k)
        for j in after[k]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, (key[j], j))
    return out + sorted(set(range(len(key))).difference(out), key=key.__getitem__)


@F.pandas_udf(ArrayType(IntegerType()))
def _places(ids: pd.Series, years: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([np.array(_kahn(*chain), np.int32) for chain in zip(ids, years, before, strict=True)], dtype=object)


def chain_order(members: DataFrame, links: DataFrame) -> DataFrame:
    """(root, id, stop): topological order of each root's stops; members has root, id, year, about MAX_STOPS a root."""
    inner = links.join(members.select("root", F.col("id").alias("later")), "later").join(members.select("root", F.col("id").alias("earlier")), ["root", "earlier"])
    before = inner.groupBy("root", F.col("later").alias("id")).agg(F.collect_set("earlier").alias("before"))
    rows = members.join(before, ["root", "id"], "left").withColumn("before", F.coalesce("before", F.array().cast("array<long>"))).select("root", "id", "year", "before")
    chain = rows.groupBy("root").agg(F.collect_list(F.struct("id", "year", "before")).alias("s"))
    places = chain.select("root", F.col("s.id").alias("ids"), _places("s.id", "s.year", "s.before").alias("places"))
    return places.select("root", F.posexplode("places").alias("stop", "place"), "ids").select("root", F.col("ids")[F.col("place")].alias("id"), (F.col("stop") + 1).alias("stop"))


def outcome(stops: DataFrame) -> DataFrame:
    """(root, outcome) from ordered decisions: single, improved (accepted in the end after a rejection), still_rejected or mixed."""
    out = F.coalesce(F.col("decision").isin(*OUT), F.lit(False))
    rows = stops.groupBy("root").agg(F.count("*").alias("n"), F.max_by("decision", "stop").alias("last"), F.count_if(out).alias("rejected"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("last").startswith("accept") & (F.col("rejected") > 0), "improved").when(F.col("rejected") == F.col("n"), "still_rejected").otherwise("mixed")
    return rows.select("root", kind.alias("outcome"))


# What is said of a journey.
IMPROVED, STILL, MIXED = "{}에서 {} 뒤 {}에 다시 내서 {}됐습니다.", "{}번 투고했지만 아직 통과 기록이 없습니다 ({}).", "{}번의 투고 기록이 있습니다 ({})."


def _filled(text: str, *parts: Column) -> Column:
    pieces = text.split("{}")
    return F.concat(F.lit(pieces[0]), *[x for p, piece in zip(parts, pieces[1:], strict=True) for x in (p.cast("string"), F.lit(piece))])


def _kind(s: Column) -> Column:
    """The outcome of a list of stops in order, as outcome() gives it."""
    last, rejected = F.element_at(s, -1)["decision"], F.size(F.filter(s, lambda x: F.coalesce(x["decision"].isin(*OUT), F.lit(False))))
    return F.when(F.size(s) == 1, "single").when(last.startswith("accept") & (rejected > 0), "improved").when(rejected == F.size(s), "still_rejected").otherwise("mixed")


def _message(s: Column, kind: Column) -> Column:
    route = lambda f: F.array_join(F.transform(s, f), " → ")
    first, last = s[0], F.element_at(s, -1)
    message = F.when(kind == "improved", _filled(IMPROVED, first["venue"], first["decision"], last["venue"], last["decision"]))
    message = message.when(kind == "still_rejected", _filled(STILL, F.size(s), route(lambda x: x["venue"])))
    return message.when(kind == "mixed", _filled(MIXED, F.size(s), route(lambda x: F.concat_ws(" ", x["venue"], x["decision"]))))


def whole_journeys(members: DataFrame, papers: DataFrame, links: DataFrame, ratings: DataFrame, venues: DataFrame) -> DataFrame:
    """chain_order and journeys of members (root, id) in one grouping: what is said of a paper is worked out once, then sent to its roots.

    papers: id, year, venue, decision; links, ratings and venues as for journeys. The wide rows are shuffled once, by root.
    """
    ways = links.select(F.col("later").alias("id"), F.col("earlier").alias("other"), "method", F.lit(True).alias("before"))
    ways = ways.unionByName(links.select(F.col("earlier").alias("id"), F.col("later").alias("other"), "method", F.lit(False).alias("before")))
    ways = ways.groupBy("id", "other").agg(F.min("method").alias("method"), F.max("before").alias("before"))
    ways = ways.groupBy("id").agg(F.collect_list(F.struct("other", "method", "before")).alias("ways"))
    facts = papers.select("id", "year", "venue", "decision").join(ways, "id", "left").join(ratings.select("id", "avg_rating", "rating_count"), "id", "left").join(F.broadcast(venues.select("venue", "rating_mean")), "venue", "left")
    versus = F.round(F.col("avg_rating") - F.col("rating_mean"), 2).alias("rating_vs_venue")
    none = F.array().cast("array<struct<other: bigint, method: string, before: boolean>>")
    facts = facts.select("id", "year", "venue", "decision", F.round("avg_rating", 2).alias("avg_rating"), F.coalesce("rating_count", F.lit(0)).alias("rating_count"), versus, F.coalesce("ways", none).alias("ways"))
    chain = members.join(facts, "id").groupBy("root").agg(F.collect_list(F.struct(*facts.columns)).alias("c"))
    before = F.transform("c", lambda x: F.transform(F.filter(x["ways"], lambda w: w["before"]), lambda w: w["other"]))
    chain = chain.withColumn("places", _places("c.id", "c.year", before))
    chain = chain.select("root", F.transform("places", lambda k: F.col("c")[k]).alias("s")).withColumn("outcome", _kind(F.col("s")))
    rows = chain.select("root", "outcome", _message(F.col("s"), F.col("outcome")).alias("message"), F.posexplode(F.transform("s", _with_method)).alias("k", "x"))
    kept = [F.col("x")[c].alias(c) for c in ("id", "venue", "decision", "avg_rating", "rating_count", "rating_vs_venue", "method")]
    return rows.select("root", (F.col("k") + 1).alias("stop"), *kept, (F.col("root") == F.col("x.id")).alias("is_query"), "outcome", "message")


def _with_method(x: Column, k: Column) -> Column:
    """A stop of s with the method of its direct link to the one before it."""
    own = F.filter(x["ways"], lambda w: (k > 0) & (w["other"] == F.try_element_at(F.col("s"), F.greatest(k, F.lit(1)))["id"]))
    return F.struct(*[x[c].alias(c) for c in ("id", "venue", "decision", "avg_rating", "rating_count", "rating_vs_venue")], F.get(own, F.lit(0))["method"].alias("method"))


def _ordered(stops: list[dict], links: list[dict]) -> list[dict]:
    """Places of one part's stops in order, each with the method of its direct link to the one before."""
    ids = [x["id"] for x in stops]
    before: dict[int, list[int]] = {i: [] for i in ids}
    methods: dict[tuple[int, int], str] = {}
    for x in links:
        before[x["later"]].append(x["earlier"])
        pair = min(x["earlier"], x["later"]), max(x["earlier"], x["later"])
        if x["method"] is not None:
            methods[pair] = min(methods.get(pair, x["method"]), x["method"])
    places = _kahn(ids, [x["year"] or 0 for x in stops], [before[i] for i in ids])
    prev = [None, *(ids[k] for k in places)]
    return [{"place": k, "method": methods.get((min(p, ids[k]), max(p, ids[k]))) if p is not None else None} for p, k in zip(prev, places)]  # noqa: B905


def _order(stops: Column, links: Column) -> Column:
    kind = pa.list_(pa.struct([("place", pa.int32()), ("method", pa.string())]))

    @arrow_udf("array<struct<place: int, method: string>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return in_pieces(_ordered, x, y, kind)

    return run(stops, links)


def part_journeys(papers: DataFrame, links: DataFrame | Callable[[Column], Column], venues: DataFrame) -> DataFrame:
    """The journeys of whole_journeys for parts that links join, without a cap: each paper is the root of all stops of its part.

    papers: part, id (once in the table), year, venue, decision, avg_rating, rating_count; venues as for journeys. links: part,
    earlier, later, method, both ends in the part; or what makes an array of the last three from a part's ids in order, and
    then only papers are shuffled. Order, outcome and message are the same for all roots of a part and worked out once; the
    rows of its roots, as many as the square of its papers, are made last.
    """
    facts = papers.join(F.broadcast(venues.select("venue", "rating_mean")), "venue", "left")
    versus = F.round(F.col("avg_rating") - F.col("rating_mean"), 2).alias("rating_vs_venue")
    stop = F.struct("id", "year", "venue", "decision", F.round("avg_rating", 2).alias("avg_rating"), F.coalesce("rating_count", F.lit(0)).alias("rating_count"), versus)
    rows, lists = facts.select("part", stop.alias("stop")), [F.collect_list("stop").alias("c")]
    if isinstance(links, DataFrame):
        rows = rows.unionByName(links.select("part", F.struct("earlier", "later", "method").alias("link")), allowMissingColumns=True)
        lists.append(F.collect_list("link").alias("l"))
    parts = rows.repartition("part").groupBy("part").agg(*lists)
    if not isinstance(links, DataFrame):
        parts = parts.withColumn("l", links(F.array_sort(F.transform("c", lambda x: x["id"]))))
    order = _order(F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["year"].alias("year"))), F.col("l"))
    shown = ("id", "venue", "decision", "avg_rating", "rating_count", "rating_vs_venue")
    told = parts.select("c", order.alias("o")).select(F.transform("o", lambda o: F.struct(*[F.col("c")[o["place"]][n].alias(n) for n in shown], o["method"].alias("method"))).alias("s"))
    told = told.withColumn("outcome", _kind(F.col("s")))
    told = told.select("s", "outcome", _message(F.col("s"), F.col("outcome")).alias("message"), F.explode_outer("s.id").alias("root"))  # no part is empty; a plain explode puts a filter below it, which orders all parts again
    out = told.select("root", "outcome", "message", F.posexplode_outer("s").alias("k", "x"))
    return out.select("root", (F.col("k") + 1).alias("stop"), *[F.col("x")[n].alias(n) for n in (*shown, "method")], (F.col("root") == F.col("x.id")).alias("is_query"), "outcome", "message")


def journeys(stops: DataFrame, links: DataFrame, ratings: DataFrame, venues: DataFrame) -> DataFrame:
    """Stops (root, id, stop, venue, decision) with ratings, evidence of links, and the journey's outcome and message.

    ratings: id, avg_rating, rating_count; venues: venue, rating_mean. rating_vs_venue is the mean rating over the venue's;
    it and avg_rating are rounded to two places, method is that of a direct link to the stop before.
    """
    rows = adjacent_links(stops, links).join(ratings.select("id", "avg_rating", "rating_count"), "id", "left").join(venues.select("venue", "rating_mean"), "venue", "left")
    rows = rows.withColumn("rating_vs_venue", F.round(F.col("avg_rating") - F.col("rating_mean"), 2)).withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("stop", "venue", "decision")))
    whole = stops.groupBy("root").agg(listed.alias("s")).withColumn("outcome", _kind(F.col("s")))
    rows = rows.join(whole.select("root", "outcome", _message(F.col("s"), F.col("outcome")).alias("message")), "root").withColumn("is_query", F.col("root") == F.col("id"))
    return rows.select("root", "stop", "id", "venue", "decision", F.round("avg_rating", 2).alias("avg_rating"), "rating_count", "rating_vs_venue", "method", "is_query", "outcome", "message")


def adjacent_links(stops: DataFrame, links: DataFrame) -> DataFrame:
    """Stops with the method of their link to the stop before, where the two are linked directly."""
    prev = F.lag("id").over(Window.partitionBy("root").orderBy("stop"))
    either = links.select(F.col("earlier").alias("p"), F.col("later").alias("q"), "method").unionByName(links.select(F.col("later").alias("p"), F.col("earlier").alias("q"), "method"))
    either = either.groupBy("p", "q").agg(F.min("method").alias("method"))
    rows = stops.withColumn("prev", prev)
    return rows.join(either, (F.col("prev") == F.col("p")) & (F.col("id") == F.col("q")), "left").drop("p", "q")
