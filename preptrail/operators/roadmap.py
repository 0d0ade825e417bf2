"""Problem roadmaps for many interviews in one job."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from preptrail import schemas as S
from preptrail.functions import clean
from preptrail.operators.encode import TextEncoder
from preptrail.operators.ranking import first_per_key, ranked, top_n
from preptrail.operators.retrieval import MAX_LABELS_SENT, retrieve
from preptrail.session import cut_lineage, few

#: Rows of found lists that a task holds at a time, and interviews that one copy of a company's lists serves.
LOT_ROWS = 60_000
SLICE_INTERVIEWS = 2_000
#: Rows of the highest frequencies among which a fill list is sought first, as a multiple of its size.
LIST_ROOM = 4

def difficulty_requests(counts: DataFrame) -> DataFrame:
    """One row per interview and difficulty with the number of problems asked for."""
    parts = [
        F.struct(F.lit(i).alias("part"), F.lit(d).alias("difficulty"), F.col(d.lower()).alias("n"))
        for i, d in enumerate(S.DIFFICULTIES)
    ]
    return (
        counts.select("interview_id", "company", F.explode(F.array(*parts)).alias("p"))
        .select("interview_id", "company", "p.*")
        .filter(F.col("n") > 0)
    )


def ordered_fetch(problems: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for a list of (position, id), in list order; unknown ids are skipped."""
    return ids.join(problems, "id").orderBy("position")


def first_links(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per link within each key; rows without a link all stay."""
    return first_per_key(rows, [*keys, "dedup"], order)


def _group() -> Column:
    """The list that fills a company's roadmaps: that of its cluster, or its own outside all clusters."""
    return F.coalesce(F.concat(F.lit("c:"), F.col("cluster").cast("string")), F.concat(F.lit("o:"), F.col("company")))


def _fill_lists(problems: DataFrame, labels: DataFrame, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent problems per cluster, one per link, in order.

    The list is the same for every interview of a cluster, so it is ranked once per cluster and
    only its first ``size`` rows are joined to interviews. A company outside all clusters has a
    list of its own. Links are only told apart among the rows of the highest frequencies, enough of them for all lists.
    """
    place = F.coalesce(-F.col("frequency"), F.lit(float("inf")))
    pool = problems.join(few(labels.select("company", "cluster"), MAX_LABELS_SENT), "company", "left")
    pool = pool.select(_group().alias("group"), "id", "frequency", clean.dedup_key(F.col("url"), F.col("id")).alias("dedup"), *carry)
    levels = cut_lineage(pool.groupBy("group", place.alias("_place")).agg(F.count("*").alias("_n")), "levels")
    before = F.sum("_n").over(W.partitionBy("group").orderBy("_place")) - F.col("_n")
    wanted = LIST_ROOM * size
    while True:
        levels = levels.withColumn("_before", before)
        bounds = levels.groupBy("group").agg(
            F.max(F.when(F.col("_before") < wanted, F.col("_place"))).alias("_bound"), F.max("_place").alias("_last")
        )
        bounds = few(cut_lineage(bounds, "bounds"), MAX_LABELS_SENT)
        some = pool.join(bounds, "group").filter(place <= F.col("_bound")).drop("_bound", "_last")
        order = [place, F.col("id")]
        lists = cut_lineage(top_n(first_links(some, ["group"], order), ["group"], order, size, "fill_rank"), "fill")
        open_ = bounds.filter("_bound < _last").join(lists.groupBy("group").agg(F.count("*").alias("_have")), "group")
        if open_.filter(F.col("_have") < size).isEmpty():
            return lists
        wanted *= 8


def _lots(requests: DataFrame, asked: DataFrame, grouped: DataFrame) -> DataFrame:
    """Company, group, ``_slices`` of its interviews and ``_lots`` of its group.

    A lot is what one task holds at a time: whole lists of companies of a group, with at most ``SLICE_INTERVIEWS``
    interviews for each time a list is sent.
    """
    rows = requests.groupBy("company").agg(F.sum("n").alias("_rows"))
    slices = F.ceil(F.count("*") / SLICE_INTERVIEWS).cast("int")
    sized = asked.groupBy("company").agg(slices.alias("_slices")).join(rows, "company", "left").join(grouped, "company")
    work = F.sum((F.coalesce("_rows", F.lit(0)) + SLICE_INTERVIEWS / 8) * F.col("_slices"))
    lots = sized.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(work / LOT_ROWS)).cast("int").alias("_lots"))
    return sized.join(lots, "group").select("company", "group", "_slices", "_lots")


def _assembled(held: pa.Table, asked: pa.Table, carry: tuple[str, ...], flat: bool, schema: pa.Schema) -> pa.Table:
    """Roadmaps of the interviews of one lot.

    ``held`` has the lists found for companies (``part``, ``tier``, ``rank``) and, without a company, the list that
    fills. All interviews advance at once: rows are numbers of ``held`` behind each other, interview by interview.
    """
    held, asked = held.combine_chunks(), asked.combine_chunks()
    links = held["dedup"].combine_chunks().dictionary_encode()
    link = links.indices.fill_null(len(links.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    n_links = len(links.dictionary) + 1
    both = pa.concat_arrays([held["company"].combine_chunks(), asked["company"].combine_chunks()]).dictionary_encode().indices
    company = both.fill_null(-1).to_numpy(zero_copy_only=False)
    company, own = company[: len(held)], company[len(held) :]
    part, tier, rank = (held[c].to_numpy() for c in ("part", "tier", "rank"))
    frequency = np.nan_to_num(held["frequency"].fill_null(0.0).to_numpy(), nan=np.nan)
    n_companies = int(max(company.max(initial=-1), own.max(initial=-1))) + 1

    def within(keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys among their equals."""
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys)))

    rows = np.flatnonzero(company >= 0)
    rows = rows[np.lexsort((rank[rows], tier[rows], part[rows], company[rows]))]
    pick = np.zeros(len(held), np.int64)
    pick[rows] = within(company[rows].astype(np.int64) * 3 + part[rows]) + 1
    rows = rows[np.lexsort((pick[rows], -frequency[rows], part[rows], company[rows]))]
    sizes = np.bincount(company[rows], minlength=n_companies)
    starts = np.cumsum(sizes) - sizes

    # The lists of an interview's company, cut to what it asks for.
    wanted = np.stack([asked[d.lower()].to_numpy() for d in S.DIFFICULTIES])
    total, n = asked["total"].to_numpy(), len(asked)
    taken = np.repeat(np.arange(n), sizes[own])
    chosen = rows[np.repeat(starts[own], sizes[own]) + within(taken)]
    kept = pick[chosen] <= wanted[part[chosen], taken]
    taken, chosen = taken[kept], chosen[kept]
    # Of rows that share a link the first one stays; only links that a company's lists repeat are compared.
    shared = company[rows].astype(np.int64) * n_links + link[rows]
    values, inverse, count = np.unique(shared, return_inverse=True, return_counts=True)
    repeats = np.zeros(len(held), dtype=bool)
    repeats[rows] = count[inverse] > 1
    some = np.flatnonzero(repeats[chosen])
    first = np.unique(taken[some] * n_links + link[chosen[some]], return_index=True)[1]
    kept = np.ones(len(chosen), dtype=bool)
    kept[np.delete(some, first)] = False
    taken, chosen = taken[kept], chosen[kept]
    have = np.bincount(taken, minlength=n)

    # The first rows of the list that fills whose links were not chosen.
    fill = np.flatnonzero(company < 0)
    fill = fill[np.argsort(rank[fill], kind="stable")]
    fill_rank = rank[fill]
    at = np.full(n_links, -1)
    at[link[fill]] = np.arange(len(fill))
    at[n_links - 1] = -1  # missing keys are equal to none
    lacking = np.maximum(total - have, 0)
    reach = np.searchsorted(fill_rank, total, side="right")
    hidden = at[link[chosen]]
    blocked = (hidden >= 0) & (lacking[taken] > 0)
    looked = np.where(lacking > 0, np.minimum(reach, lacking + np.bincount(taken[blocked], minlength=n)), 0)
    filled = np.repeat(np.arange(n), looked)
    place = within(filled)
    free = ~np.isin(filled * (len(fill) + 1) + place, taken[blocked] * (len(fill) + 1) + hidden[blocked])
    filled, place = filled[free], place[free]
    kept = within(filled) < lacking[filled]
    filled, place = filled[kept], place[kept]

    added = np.bincount(filled, minlength=n)
    length = have + added
    starts = np.cumsum(length) - length
    position = np.concatenate([within(taken), within(filled) + have[filled]])
    target = starts[np.concatenate([taken, filled])] + position
    row, late, placed = np.empty(len(target), np.int64), np.empty(len(target), dtype=bool), np.empty(len(target), np.int32)
    row[target] = np.concatenate([chosen, fill[place]])
    late[target] = np.arange(len(target)) >= len(chosen)
    placed[target] = position + 1
    columns = [held["id"].combine_chunks().take(row), pa.array(late), *(held[c].combine_chunks().take(row) for c in carry)]
    if flat:
        interviews = asked["interview_id"].combine_chunks().take(np.repeat(np.arange(n), length))
        return pa.Table.from_arrays([interviews, pa.array(placed), *columns], schema=schema)
    found = np.flatnonzero(length)
    edges = pa.array(np.append(starts[found], len(target)).astype(np.int32))
    fields = schema.field("route").type.value_type
    stops = pa.StructArray.from_arrays(columns, fields=[fields.field(i) for i in range(fields.num_fields)])
    return pa.Table.from_arrays([asked["interview_id"].combine_chunks().take(found), pa.ListArray.from_arrays(edges, stops)], schema=schema)


def _merged(counts: DataFrame, found: DataFrame, lists: DataFrame, labels: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Roadmaps of interviews whose id is missing or repeats, or whose company has several labels: rows of equal ids
    are one roadmap, and each of them is filled."""
    parts = difficulty_requests(counts)
    pick = F.row_number().over(W.partitionBy("company", "difficulty").orderBy("tier", "rank"))
    picked = parts.join(found.withColumn("pick", pick), ["company", "difficulty"]).filter(F.col("pick") <= F.col("n"))
    order = [F.col("part"), -F.coalesce("frequency", F.lit(0.0)), F.col("pick")]
    chosen = picked.select("interview_id", "part", "frequency", "pick", "id", "dedup", *carry)
    chosen = cut_lineage(first_links(chosen, ["interview_id"], order), "chosen")
    longest = chosen.groupBy("interview_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    selected = ranked(chosen, ["interview_id"], order, "position", longest)
    selected = selected.select("interview_id", "position", "id", F.lit(False).alias("filled"), *carry)

    have = chosen.groupBy("interview_id").agg(F.count("*").alias("have"))
    short = counts.join(have, "interview_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.filter(F.col("have") < F.col("total")).join(labels.select("company", "cluster"), "company", "left")
    short = short.select("interview_id", "have", "total", _group().alias("group"))
    # Every chosen row hides at most one link of the list, so ``total`` links are always enough.
    candidates = short.join(lists, "group").filter(F.col("fill_rank") <= F.col("total"))
    fresh = candidates.join(chosen.select("interview_id", "dedup"), ["interview_id", "dedup"], "left_anti")
    longest = fresh.groupBy("interview_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    filled = (
        ranked(fresh, ["interview_id"], [F.col("fill_rank")], "pos", longest)
        .filter(F.col("pos") <= F.col("total") - F.col("have"))
        .select("interview_id", (F.col("have") + F.col("pos")).cast("int").alias("position"), "id", F.lit(True).alias("filled"), *carry)
    )
    return selected.unionByName(filled).withColumnRenamed("id", "problem_id")


def _roads(
    counts: DataFrame, index: DataFrame, problems: DataFrame, labels: DataFrame, encode: TextEncoder, carry: tuple[str, ...], flat: bool
) -> DataFrame:
    asked = counts.select("interview_id", "company", *S.DEFAULT_COUNTS)
    counts = cut_lineage(asked, "counts")
    pair = ["company", "difficulty"]
    requests = difficulty_requests(counts).groupBy(*pair).agg(F.max("n").alias("n")).withColumn("query_id", F.concat_ws("|", *pair))
    requests = cut_lineage(requests, "asked")
    found = retrieve(index, requests, encode, labels=labels)
    missing = [c for c in carry if c not in found.columns]
    if missing:
        raise ValueError(f"found problems do not carry {missing}")
    found = found.filter(F.col("company").isNotNull())
    found = found.withColumn("dedup", clean.dedup_key(F.col("url"), F.col("id"))).select(*dict.fromkeys([*pair, "tier", "rank", "id", "dedup", "frequency", *carry]))
    size = counts.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    more = tuple(c for c in carry if c != "frequency")
    lists = _fill_lists(problems, labels, size, more)

    known = labels.select("company", "cluster")
    several = known.groupBy("company").count().filter("count > 1").select("company")
    again = counts.groupBy("interview_id").count().filter("count > 1").select("interview_id")
    odd = counts.join(again, "interview_id", "left_semi").select("interview_id")
    odd = odd.union(counts.join(several, "company", "left_semi").select("interview_id")).distinct()
    odd = cut_lineage(odd, "odd")
    strange = not odd.isEmpty() or not counts.filter("interview_id is null").isEmpty()
    plain = counts.filter("interview_id is not null and company is not null")
    plain = plain.join(few(odd, MAX_LABELS_SENT), "interview_id", "left_anti") if strange else plain

    grouped = plain.select("company").distinct().join(known, "company", "left").select("company", _group().alias("group"))
    lots = few(cut_lineage(_lots(requests, plain, grouped), "lots"), MAX_LABELS_SENT)

    def lot(number: Column) -> Column:
        return F.pmod(F.xxhash64("company", number), F.col("_lots")).cast("int")

    part = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(S.DIFFICULTIES) for x in (d, i)]), F.col("difficulty"))
    columns = ["company", part.alias("part"), "tier", "rank", "id", "dedup", F.coalesce("frequency", F.lit(0.0)).alias("frequency")]
    # Slices of a company that share a lot share its lists there.
    met = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_slices") - 1), lot))
    sent = found.join(lots, "company").select("group", F.explode(met).alias("_lot"), *columns, *more)
    every = lots.select("group", "_lots").distinct().join(lists, "group")
    every = every.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("_lot"), F.lit(None).cast("string").alias("company"),
        F.lit(0).alias("part"), F.lit(0).alias("tier"), F.col("fill_rank").alias("rank"), "id", "dedup", F.lit(0.0).alias("frequency"), *more,
    )
    slice_of = F.pmod(F.xxhash64("interview_id"), F.col("_slices")).cast("int")
    interviews = plain.join(lots, "company").select(F.col("group").alias("group"), lot(slice_of).alias("_lot"), *plain.columns)

    stop = [T.StructField("problem_id", found.schema["id"].dataType), T.StructField("filled", T.BooleanType()), *(found.schema[c] for c in more)]
    first = T.StructField("interview_id", counts.schema["interview_id"].dataType)
    fields = [first, T.StructField("position", T.IntegerType()), *stop] if flat else [first, T.StructField("route", T.ArrayType(T.StructType(stop)))]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def assemble(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _assembled(held, asked, more, flat, arrow) if len(asked) and len(held) else arrow.empty_table()

    roads = sent.unionByName(every).groupBy("group", "_lot").cogroup(interviews.groupBy("group", "_lot")).applyInArrow(assemble, schema)
    if not strange:
        return roads
    rest = counts.join(odd, "interview_id", "left_semi").unionByName(counts.filter("interview_id is null"))
    merged = _merged(cut_lineage(rest, "merged"), found, lists, labels, more)
    if flat:
        return roads.unionByName(merged)
    stops = F.struct("position", "problem_id", "filled", *more)
    merged = merged.groupBy("interview_id").agg(F.array_sort(F.collect_list(stops)).alias("route"))
    names = [f.name for f in stop]
    return roads.unionByName(merged.select("interview_id", F.transform("route", lambda s: F.struct(*[s[n].alias(n) for n in names])).alias("route")))


def recommend(
    counts: DataFrame,
    index: DataFrame,
    problems: DataFrame,
    labels: DataFrame,
    encode: TextEncoder,
) -> DataFrame:
    """Roadmap of every interview: interview_id, position, problem_id, filled.

    ``counts`` is (interview_id, company, easy, medium, hard, total). Problems are retrieved once
    per (company, difficulty) for the largest number any interview asks for; an interview takes a
    prefix of that list, re-ranks it by frequency, keeps the first row per link over all
    difficulties and is then filled up to its total with the most frequent other problems of its
    company and peers. A list is never cut to the total.

    Interviews meet the lists of their companies in the task that holds these, so what an interview takes is
    neither shuffled nor stored.
    """
    return _roads(counts, index, problems, labels, encode, (), True)


def routes(
    counts: DataFrame, index: DataFrame, problems: DataFrame, labels: DataFrame, encode: TextEncoder, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The rows of ``recommend`` as one row per interview: interview_id, route; a stop has problem_id, filled and the
    columns ``carry`` of its problem. Interviews without a stop are left out."""
    return _roads(counts, index, problems, labels, encode, carry, False)
