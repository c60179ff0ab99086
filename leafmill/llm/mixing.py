"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in order of size; each is worth target / source_size expected copies. The running
sum of expected copies, moved by one random offset, crosses an integer boundary once for every copy. As neighbours in
this order have nearly one size, the words taken differ from the target by about one document at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, blocks, prepare, released


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offs in blocks(batch.column(2)):
            inside = ~IS_SPACE[data]
            first = np.ones(len(data), bool)
            first[1:] = ~inside[:-1]
            first[offs[:-1][offs[:-1] < len(data)]] = True
            total = np.concatenate([[0], np.cumsum(inside & first)])
            counts.append(np.diff(total[offs]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "source", "size"])


def _digits(text: Column, n: int = 6) -> Column:
    """The first n hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("double")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with their place `at`, from 0, by code point, null last. Tasks number ranges; where each range starts follows from the sizes of those before, a row for each task."""
    key = F.col("source").asc_nulls_last()
    own = sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part, starts, n = F.shiftright("at", 33), [], 0
    for r in own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts += [F.lit(r.part), F.lit(n)]
        n += r.n
    return own.withColumn("at", F.create_map(*starts)[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) if starts else own


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes (source, source_size) with target: shares of the total by weight, capped at cap times the size, the excess shared again.

    Each round is one aggregation over a row for each source: those whose share reaches their cap are capped, what they
    leave is shared among the others, until no more are capped. A round either takes a third of the remaining weight or moves
    the level by half as much as the one before, so rounds grow with the logarithm of the weights and sizes. Sums are
    decimals of 38 digits. No rows give no rows.
    """
    n = len(weights)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % n + 1).cast("int"))
    own = _numbered(sizes).select("source", "source_size", pick.cast("decimal(20,0)").alias("weight"), (F.col("source_size").cast("decimal(19,0)") * F.lit(cap).cast("decimal(9,0)")).alias("cap")).checkpoint()
    total = own.agg(F.sum(F.col("source_size").cast("decimal(19,0)")), F.sum("weight"), F.lit(0)).first()
    left, free, met = int(total[0] or 0), int(total[1] or 0), 0
    while True:
        exact = lambda v: F.lit(str(v)).cast("decimal(38,0)")
        capped = F.col("cap") * exact(free) <= exact(left) * F.col("weight")
        taken, weight, now = own.filter(capped).agg(F.sum("cap"), F.sum("weight"), F.count("*")).first()
        if now == met:
            break
        met, left, free = now, int((total[0] or 0) - (taken or 0)), int((total[1] or 0) - (weight or 0))
    shared = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(max(free, 1)))
    return own.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """docs (doc_id, text, source, ...) to doc_id, source, size, source_size, target, copies, taken: one row for each row.

    size: words [^\\x20\\x09-\\x0D]+, 0 for null. Sources by code point, null last, weigh weights in turn. No document has
    more than cap copies. taken = copies * size. The offset comes from the source's name, so reruns agree. Rows without
    words belong to the order and may have copies, worth 0 words. Rows that repeat a doc_id count one by one; which of
    them gets a copy does not matter where they are equal. Other columns are ignored. No rows give no rows.
    """
    prepare(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(released(_word_counts), "doc_id long, source string, size long").checkpoint()
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")).checkpoint(), weights, cap).checkpoint()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the id of a row in its sorted part, and each source's count in each part, make its rank in the source
    placed = sized.repartitionByRange(parts, "source", "size", "doc_id").sortWithinPartitions("source", "size", "doc_id").withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), "source").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("shift", offset - F.col("start")).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("part", F.col("source").alias("own"), "shift", "source_size", "target").checkpoint()
    ranked = placed.join(runs, (part == F.col("part")) & F.col("source").eqNullSafe(F.col("own"))).withColumn("rank", F.col("at") + F.col("shift"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _digits(F.coalesce("source", F.lit("\x00null"))) / F.lit(16777216.0)
    crossed = F.floor(start + each * (F.col("rank") + 1)) - F.floor(start + each * F.col("rank"))
    copies = F.when(each >= cap, F.lit(cap).cast("long")).otherwise(crossed)
    return ranked.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, source_size * 3 as cap from s),
l as (
  select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as remains,
    sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as behind
  from w
), c as (select *, cap * behind <= remains * weight as capped from l),
f as (select remains as level, behind as level_w from c where not capped order by behind desc limit 1),
t as (select source, source_size, case when capped then cap::double else (select level from f)::double * weight / (select level_w from f) end as target from c),
r as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as each,
    row_number() over (partition by d.source order by size, doc_id) - 1 as rnk, ('0x' || substr(md5(coalesce(d.source, chr(0) || 'null')), 1, 6))::bigint / 16777216.0::double as start
  from d join t on d.source is not distinct from t.source
), k as (select *, case when each >= 3 then 3 else (floor(start + each * (rnk + 1)) - floor(start + each * rnk))::bigint end as copies from r)
select doc_id, source, size, source_size, target, copies::bigint as copies, (copies * size)::bigint as taken from k
"""
