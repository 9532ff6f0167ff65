"""Mixing sources to target weights by systematic sampling.

Each document's expected copies are prefix-summed within its source, one random offset is
added, and a document is emitted once for each integer boundary that its stretch crosses.
Built-in functions only. The order inside a source is by size, so the sample is spread over
short and long documents and its words come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds, for each name in sums, the sum over all rows before (in `order`) as <name>.

    The rows are range-partitioned by the order, so a hot key spreads over partitions; each
    partition's total is added up first, and what a task sums is one partition.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, name)
    totals = parts.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(totals), "_part")
    for k, v in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_o_{k}"))
    return out.drop("_part", *[f"_o_{k}" for k in sums])


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, source_rows, before (rows of the sources before it) and target.

    Sources in code point order, null last, weigh `weights`, repeating, and share `share`
    times all words; a target stops at `most` times its source, and the excess is shared
    again by weight. Sorted by the size at which each source stops, one pass of running
    sums finds the level at which the rest share."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    code = [F.col("source").asc_nulls_last()]
    by = with_running(by, code, {"place": F.lit(1), "before": F.col("source_rows")}, "sources")
    w = F.array(*[F.lit(float(x)) for x in weights])[(F.col("place") % len(weights)).cast("int")]
    by = by.withColumn("w", w).withColumn("stop", F.col("source_size") * most / F.col("w"))
    by = with_running(by, [F.col("stop"), F.col("place")], {"w_before": F.col("w"), "s_before": F.col("source_size")}, "stops")
    by = stored(by, "levels")
    total = by.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.col("all_size") * share - F.col("s_before") * most) / (F.col("all_w") - F.col("w_before"))
    first = by.crossJoin(F.broadcast(total)).where(F.col("stop") > level)  # total is one row
    first = first.agg(F.min_by(level, F.struct("stop", "place")).alias("level"))
    by = by.crossJoin(F.broadcast(first))
    target = F.when(F.col("level").isNull() | (F.col("stop") <= F.col("level")), F.col("source_size") * most).otherwise(F.col("level") * F.col("w"))
    return by.select("source", "source_size", "source_rows", "before", target.alias("target"))


def mixed(docs: DataFrame, seed: str = "mix-1", carry: tuple[str, ...] = (), **targets) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes the document, at
    most twice) and taken (words that it takes) for each row of docs (doc_id, text, source),
    beside doc_id, source and the row's own columns that `carry` names.

    Null texts have size 0, a null source is a source of its own, and a source without words
    gives no copies. Repeated rows count as documents of their own. Reruns agree: the random
    offset of a source is a hash of the seed and its name. An empty table gives no rows.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    placed = stored(with_running(d, order, {"row": F.lit(1)}, "sized"), "placed")
    by = stored(source_targets(placed, **targets), "targets").withColumnRenamed("source", "s")
    out = placed.join(by, F.col("source").eqNullSafe(F.col("s")))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    k = (F.col("row") - F.col("before")).cast("double")
    copies = F.floor((k + 1) * F.col("e") + F.col("u")) - F.floor(k * F.col("e") + F.col("u"))
    out = out.withColumn("e", e).withColumn("u", u).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
r as (select *, row_number() over (partition by source order by size, doc_id) - 1 as k from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s),
o as (select *, source_size * 2.0::double / w as stop from w),
b as (select *, coalesce(sum(w) over v, 0) as w_before, coalesce(sum(source_size) over v, 0) as s_before, sum(w) over () as all_w, sum(source_size) over () as all_size
      from o window v as (order by stop, place rows between unbounded preceding and 1 preceding)),
l as (select *, (all_size * 1.5::double - s_before * 2.0::double) / (all_w - w_before) as level from b),
f as (select arg_min(level, (stop, place)) as lv from l where stop > level),
t as (select source, source_size, case when lv is null or stop <= lv then source_size * 2.0::double else lv * w end as target,
      ('0x' || substr(md5('mix-1' || coalesce('=' || source, '')), 1, 8))::bigint / 4294967296.0::double as u from l, f),
j as (select doc_id, size, source_size, target, k, u, case when source_size > 0 then target / source_size else 0.0::double end as e
      from r join t on r.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target, ((floor((k + 1)::double * e + u) - floor(k::double * e + u)) * size)::bigint as taken from j
"""
