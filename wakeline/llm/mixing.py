"""Mixing sources to target weights (operator 4) by capped water-filling.

The sources, by code point with null last, weigh 1, 2, 3, repeating. They share the size of the
whole corpus by weight; a source stops at three times its own size and the excess is shared
again by weight until none is above. In closed form: with the sources by cap over weight, the
first k are capped for the least k at which the rest's shares all fit.

Sampling: a source with target t and size s takes every row floor(t / s) times, and the
remaining fraction once more, in the order of a seeded hash. Rows fall into buckets of about a
thousand by that hash (of the id; of the text where the id is null); buckets are taken whole while
they fit, and in the bucket where the quota runs out rows are taken in hash order as they fit. Rows are
chosen, not ids: of n rows that are equal in id, size and text as many are taken as fit. A bucket that rows
of one id crowd is cut once more, by a hash of the text. Running sums go over stretches of buckets,
then over the buckets of one stretch, then over the parts of one bucket, so no task sees all
buckets of a source, and what is gathered is a few thousand different texts at most. Reruns agree;
no row is dropped but by the mix itself.

Defined results: a null text has size 0; a source of size 0 has target 0; rows that share an id are
rows like any others, and of equal ones it does not matter which are taken; an empty table gives
an empty table; mixed() keeps all columns (names that start with two underscores are reserved).
Sources are ordered in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import cut, n_words, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
BUCKET = 1024  # rows of a bucket, about
CROWD = 4 * BUCKET  # rows of a bucket, or of a part of one, beyond which it is cut
STRETCH = 12  # bits of the buckets in one stretch
_HALF = 20  # bits of half a hash


def _number(hexadecimal: Column) -> Column:
    """The first 40 bits of an MD5, the same in any engine that has one."""
    return F.conv(F.substring(hexadecimal, 1, 10), 16, 10).cast("long")


def slim_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and the hashes u (of the id, else of the text) and v (of the text)."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return x.select("doc_id", "source", n_words(F.col("text")).alias("size"), *_hashes(F.col("doc_id"), F.col("text")))


def _hashes(id_col: Column, text: Column) -> list[Column]:
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), own))
    return [_number(F.md5(F.concat(F.lit(SEED + ":"), name).cast("binary"))).alias("u"), _number(own).alias("v")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, docs, source_size, weight, target of sizes(source, size)."""
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    # a row a source: small enough to be ordered in one task
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    # what is from here on is what there is less what was before: frames that reach ahead take a square of the time
    level = (F.sum("source_size").over(every) - before("cap")) / (F.sum("weight").over(every) - before("weight"))
    by = by.withColumn("level", level)
    # the level at which this source and all after it are filled; it holds from the first source that fits
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    final = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(final * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return by.select("source", "docs", "source_size", "weight", target.alias("target"))


def _crossing(sums: DataFrame, at: str, upto: str) -> DataFrame:
    """Of sums(plan_source, at, n, docs, upto) the row of each source in which the running sum of n in the order of
    `at` passes `upto`: plan_source, at, room (what is left of upto before it) and docs."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("plan_source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = sums.withColumn("before", before).where((F.col("before") <= F.col(upto)) & (F.col("before") + F.col("n") > F.col(upto)))
    return x.select("plan_source", at, (F.col(upto) - F.col("before")).alias("room"), "docs")


def _within(rows: DataFrame, last: DataFrame, *at: str) -> DataFrame:
    """rows of the places `at` of last, with last's other columns."""
    same = F.col("plan_source").eqNullSafe(F.col("l_plan_source"))
    for c in at:
        same &= F.col(c) == F.col(f"l_{c}")
    return rows.join(last.withColumnsRenamed({c: f"l_{c}" for c in ("plan_source", *at)}), same).drop("l_plan_source", *(f"l_{c}" for c in at))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row a source: plan_source, source_size, target, whole, quota, buckets, last_bucket, subs, last_sub, chosen.

    sizes(doc_id, source, size, u, v) is read several times, so it should be a written table. Rows of a
    bucket before last_bucket, and in it those of a part before last_sub, are taken once more; in that part
    `taken` of the n rows of each entry of chosen are.
    """
    t = targets(sizes, weights, cap)
    t = t.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    t = t.withColumn("whole", F.floor("ratio").cast("long")).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    # written, so that its size is known: joins broadcast it while small, and else split a hot source
    t = written(t.withColumn("buckets", F.ceil(F.col("docs") / BUCKET)).drop("ratio", "docs", "weight").withColumnRenamed("source", "plan_source"), "mixing-targets")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("bucket", bucket(F.col("u"), F.col("buckets")))
    rows = rows.withColumn("stretch", F.shiftright("bucket", STRETCH))
    total = [F.sum("size").alias("n"), F.count("*").alias("docs")]
    stretch = _crossing(rows.groupBy("plan_source", "stretch", "quota").agg(*total), "stretch", "quota").drop("docs")
    inside = _within(rows, stretch, "stretch")
    last = _crossing(inside.groupBy("plan_source", "bucket", "room").agg(*total), "bucket", "room")
    last = written(last.withColumn("subs", F.ceil(F.col("docs") / CROWD)).drop("docs"), "mixing-buckets")
    inside = _within(rows.select("plan_source", "bucket", "doc_id", "size", "u", "v"), last, "bucket").withColumn("sub", bucket(F.col("v"), F.col("subs")))
    sub = _crossing(inside.groupBy("plan_source", "sub", "room").agg(*total), "sub", "room").drop("docs")
    entries = _within(inside.drop("room"), sub, "sub").groupBy("plan_source", "sub", "room", "u", "size", "doc_id", "v").agg(F.count("*").alias("n"))
    # different texts of a part of a bucket: some thousands at most, however often each stands
    listed = entries.groupBy("plan_source", "sub", "room").agg(F.array_sort(F.collect_list(F.struct("u", "size", _known(F.col("doc_id")).alias("doc_id"), "v", "n"))).alias("list"))
    start = F.struct(F.floor("room").cast("long").alias("room"), F.array().cast("array<struct<doc_id:bigint,size:bigint,v:bigint,taken:bigint,n:bigint>>").alias("of"))

    def take(s: Column, x: Column) -> Column:
        fit = F.least(x["n"], F.call_function("div", s["room"], x["size"]))
        entry = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["v"].alias("v"), fit.alias("taken"), x["n"].alias("n"))
        return F.when((x["size"] > 0) & (x["size"] <= s["room"]), F.struct((s["room"] - fit * x["size"]).alias("room"), F.concat(s["of"], F.array(entry)).alias("of"))).otherwise(s)

    chosen = listed.select(F.col("plan_source").alias("c_source"), F.col("sub").alias("last_sub"), F.aggregate("list", start, take)["of"].alias("chosen"))
    where = last.select(F.col("plan_source").alias("l_source"), F.col("bucket").alias("last_bucket"), "subs")
    out = t.join(where, F.col("plan_source").eqNullSafe(F.col("l_source")), "left").join(chosen, F.col("plan_source").eqNullSafe(F.col("c_source")), "left")
    return out.drop("l_source", "c_source")


def bucket(u: Column, buckets: Column) -> Column:
    """floor(u * buckets / 2^40) for u below 2^40, in two halves that stay below 2^63 for 2^42 buckets."""
    low = F.shiftright(u.bitwiseAND(F.lit((1 << _HALF) - 1)) * buckets, _HALF)
    return F.shiftright(F.shiftright(u, _HALF) * buckets + low, _HALF)


def _known(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(-(1 << 63)))


def _found(id_col: Column, size: Column, v: Column) -> Column:
    """The entry of a row among those chosen, or null."""
    return F.get(F.filter("chosen", lambda x: (x["doc_id"] == _known(id_col)) & (x["size"] == size) & (x["v"] == v)), 0)


def _times(id_col: Column, size: Column, u: Column, v: Column) -> Column:
    """How often the plan takes a row of its source; null where some of several equal rows are taken once more."""
    b, s, entry = bucket(u, F.col("buckets")), bucket(v, F.col("subs")), _found(id_col, size, v)
    no, yes = F.lit(0), F.lit(1)
    # no last bucket: the quota takes all of the source, or its size is 0
    more = F.when(F.col("last_bucket").isNull(), (F.col("quota") > 0).cast("int")).when(b < F.col("last_bucket"), yes).when(b > F.col("last_bucket"), no)
    more = more.when(s < F.col("last_sub"), yes).when(s > F.col("last_sub"), no).when(entry.isNull(), no).when(entry["taken"] == entry["n"], yes)
    return F.when(F.col("source_size") > 0, F.col("whole") + more).otherwise(F.lit(0)).cast("long")


def _share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, whole, more, ..) with times: of the rows of equal keys the first `more` are taken once more.

    rows is cut, so its partitions are fixed: counts by partition tell where each starts, and rows are numbered
    within partitions, however many share a key.
    """
    rows = cut(rows).withColumn("__part", F.spark_partition_id())
    rows = rows.withColumn("__no", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.lit(0))))
    counts = cut(rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n")))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    starts = counts.withColumn("__before", before).toDF(*(f"__s{k}" for k in range(len(keys))), "__spart", "__sn", "__before")
    same = F.col("__part") == F.col("__spart")
    for k, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"__s{k}"))
    both = rows.join(starts, same)
    return both.withColumn("__times", F.col("__whole") + (F.col("__before") + F.col("__no") <= F.col("__more")).cast("long"))


def _timed(rows: DataFrame, plans: DataFrame, id_col: Column, size: Column, u: Column, v: Column, keep: list[str]) -> DataFrame:
    """rows, joined with their plan, with __times."""
    timed = rows.withColumn("__times", _times(id_col, size, u, v))
    if plans.where(F.exists("chosen", lambda x: x["taken"] < x["n"])).isEmpty():
        return timed.select(*keep, "__times")
    keys = {"__k0": F.col("plan_source"), "__k1": id_col, "__k2": size, "__k3": v}
    some = timed.where("__times IS NULL").withColumns(keys | {"__more": _found(id_col, size, v)["taken"], "__whole": F.col("whole")})
    some = _share(some.select(*keep, *keys, "__more", "__whole"), list(keys))
    return timed.where("__times IS NOT NULL").select(*keep, "__times").unionByName(some.select(*keep, "__times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken of each row of docs.

    Texts are read once; ids, sources, sizes and hashes are written to the shared folder. A source's plan
    is joined on the source: broadcast while sources are few, split where one is hot.
    """
    slim = cut(slim_rows(docs, id_col, text_col, source_col))
    plans = written(plan(slim), "mixing-plan")
    both = slim.join(plans, F.col("source").eqNullSafe(F.col("plan_source")))
    found = _timed(both, plans, *map(F.col, ("doc_id", "size", "u", "v")), ["doc_id", "source", "size", "source_size", "target"]).withColumnRenamed("__times", "times")
    return found.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, all columns, each as often as the mix takes it. No text is shuffled but those of
    which some of several equal rows are taken."""
    plans = written(plan(cut(slim_rows(docs, id_col, text_col, source_col))), "mixing-plan")
    names = docs.columns
    a, p = docs.alias("a"), plans.select(F.struct("*").alias("__plan"))
    both = a.join(p, F.col(f"a.`{source_col}`").cast("string").eqNullSafe(F.col("__plan.plan_source")))
    both = both.select(F.struct(*[F.col(f"a.`{c}`") for c in names]).alias("__row"), "__plan.*")
    ident, text = F.col(f"__row.`{id_col}`").cast("long"), F.col(f"__row.`{text_col}`").cast("string")
    found = _timed(both, plans, ident, n_words(text), *_hashes(ident, text), ["__row"])
    return found.withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select("__row.*")
