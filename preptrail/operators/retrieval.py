"""Waterfall retrieval: own problems, then those of peers, then any of the same difficulty."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.functions import clean, vectors
from preptrail.operators.encode import TextEncoder, add_vectors
from preptrail.operators.ranking import ranked, top_n
from preptrail.operators.search import SearchSpec, search
from preptrail.session import cut_lineage, few

OWN, PEER, GLOBAL = 1, 2, 3
DETAILS = ("dedup", "found_company", "url", "frequency")
#: Rows looked for at first beyond those that a request lacks, and requests whose ids are sent to what was found.
FIRST_ROOM = 4
MAX_SHORT_SENT = 200_000
#: Companies, with their labels, that are sent to all tasks.
MAX_LABELS_SENT = 500_000


def query_text(company: Column, difficulty: Column) -> Column:
    return F.concat_ws(" | ", company, difficulty)


def own_top(index: DataFrame, requests: DataFrame, carry: tuple[str, ...] = (), distinct: str | None = None) -> DataFrame:
    """Best rows of the requested company and difficulty, filtered before ranking."""
    return search(index, requests, F.col("n"), SearchSpec(on=("company", "difficulty"), distinct=distinct, carry=carry))


def peer_top(
    index: DataFrame,
    requests: DataFrame,
    k: Column,
    labels: DataFrame | None = None,
    peers: DataFrame | None = None,
    distinct: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best rows of the peers of the requested company.

    ``peers`` (company, peer) names them, such as the capped list of the nearest ones; ``labels``
    (company, cluster) takes every other company of the cluster, found by one equi-join key.
    """
    if peers is not None:
        named = requests.join(peers.select("company", "peer"), "company")
        named = named.drop("company").withColumnRenamed("peer", "company")
        return search(index, named, k, SearchSpec(on=("company", "difficulty"), distinct=distinct, carry=carry))
    in_cluster = labels.select("company", "cluster")
    # Companies are few beside the rows of the index, whose vectors then need no shuffle to meet their clusters.
    return search(
        index.join(few(in_cluster, MAX_LABELS_SENT), "company"),
        requests.join(in_cluster, "company"),
        k,
        SearchSpec(on=("cluster", "difficulty"), differ="company", distinct=distinct, carry=carry),
    )


def expanded_requests(requests: DataFrame, found: DataFrame, index: DataFrame, encode: TextEncoder) -> DataFrame:
    """Requests whose vector also covers the documents found so far.

    The vector is that of the request text followed by the documents. Token sums are added per
    request, so the long text itself is never put together.
    """
    parts = requests.select("query_id", "text").unionByName(
        found.join(requests.select("query_id"), "query_id", "left_semi")
        .join(index.select("id", F.col("document").alias("text")), "id")
        .select("query_id", "text")
    )
    total = add_vectors(parts.select("query_id", encode.sums(F.col("text")).alias("vector")), "query_id", "vector")
    unit = total.select("query_id", vectors.l2_normalize(F.col("vector")).alias("vector"))
    return requests.drop("vector").join(unit, "query_id")


def global_top(
    index: DataFrame, requests: DataFrame, k: Column, distinct: str | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    return search(index, requests, k, SearchSpec(on=("difficulty",), distinct=distinct, carry=carry))


def _short(requests: DataFrame, found: DataFrame) -> DataFrame:
    have = found.groupBy("query_id").agg(F.count("*").alias("have"))
    short = requests.join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return short.filter(F.col("have") < F.col("n"))


def _filled(short: DataFrame, found: DataFrame, look: Callable[[DataFrame, Column], DataFrame], tier: int, n_max: int) -> DataFrame:
    """Rows whose link is new for the query, up to the number still missing.

    ``look`` gives the best rows of distinct links for requests. Few more than are missing are asked for first; a request
    left short although there may be more rows asks for more, at last for ``n``: links found before hide at most as
    many as rows were found.
    """
    order, parts, room = [F.col("score").desc(), F.col("id")], [], FIRST_ROOM
    asked = short.withColumn("open", F.col("n") - F.col("have"))
    while True:
        k = F.least(F.col("n"), F.col("open") + F.lit(room))
        candidates = cut_lineage(look(asked, k).drop("rank"), "candidates")
        fresh = candidates.join(found.select("query_id", "dedup"), ["query_id", "dedup"], "left_anti")
        ranked = top_n(fresh, ["query_id"], order, n_max, salts=1)
        rows = ranked.join(asked.select("query_id", "open"), "query_id").filter(F.col("rank") <= F.col("open")).drop("open")
        seen = candidates.groupBy("query_id").agg(F.count("*").alias("_seen"))
        new = fresh.groupBy("query_id").agg(F.count("*").alias("_new"))
        late = asked.select("query_id", "open", "n", k.alias("_k")).join(seen, "query_id").join(new, "query_id", "left")
        late = late.filter((F.col("_seen") >= F.col("_k")) & (F.col("_k") < F.col("n")) & (F.coalesce("_new", F.lit(0)) < F.col("open")))
        late = cut_lineage(late.select("query_id").distinct(), "late")
        if late.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, rows]).withColumn("tier", F.lit(tier))
        parts.append(rows.join(late, "query_id", "left_anti"))
        asked, room = cut_lineage(asked.join(late, "query_id", "left_semi"), "asked"), 16 * room


def retrieve(
    index: DataFrame,
    requests: DataFrame,
    encode: TextEncoder,
    labels: DataFrame | None = None,
    peers: DataFrame | None = None,
) -> DataFrame:
    """Up to ``n`` problems per request (query_id, company, difficulty, n), for all requests at once.

    A tier only runs for requests the earlier ones left short. Rows of a later tier count once per
    id and link, and never repeat a link found before. The result is ordered by frequency.

    Rows of a tier are stored once; only those of requests that are still short are read by the next one.
    """
    text = query_text(F.col("company"), F.col("difficulty"))
    asked = cut_lineage(requests.withColumn("text", text).withColumn("vector", encode(text)), "requests")
    base = index.withColumns(
        {"dedup": clean.dedup_key(F.col("url"), F.col("id")), "found_company": F.col("company")}
    )
    n_max = asked.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    # The link's key is made from the link again: rows are shuffled and stored without it.
    details = [c for c in DETAILS if c != "dedup"]
    own = own_top(base, asked, details, "id" if labels is not None and peers is None else None)
    own = cut_lineage(own.withColumn("tier", F.lit(OWN)), "own").withColumn("dedup", clean.dedup_key(F.col("url"), F.col("id")))
    parts, short = [own], cut_lineage(_short(asked, own), "short")

    def held(short: DataFrame, found: DataFrame) -> DataFrame:
        """What was found for requests that are still short."""
        ids = few(short.select("query_id").distinct(), MAX_SHORT_SENT)
        return cut_lineage(found.join(ids, "query_id", "left_semi"), "held")

    found = held(short, own)
    if labels is not None or peers is not None:
        more = _filled(short, found, lambda some, k: peer_top(base, some, k, labels, peers, "dedup", DETAILS), PEER, n_max)
        parts.append(cut_lineage(more, "peer"))
        found = found.unionByName(parts[-1])
        short = cut_lineage(_short(short.drop("have"), found), "short")
        found = held(short, found)
    expanded = cut_lineage(expanded_requests(short, found, index, encode), "expanded")
    more = _filled(expanded, found, lambda some, k: global_top(base, some, k, "dedup", DETAILS), GLOBAL, n_max)
    parts.append(cut_lineage(more, "global"))

    order = [F.coalesce("frequency", F.lit(0.0)).desc(), F.col("tier"), F.col("rank")]
    return (
        ranked(reduce(DataFrame.unionByName, parts), ["query_id"], order, "position", n_max)
        .join(requests.select("query_id", "company", "difficulty"), "query_id")
        .select("query_id", "company", "difficulty", "position", "id", "found_company", "url", "frequency", "tier", "rank", "score")
    )
