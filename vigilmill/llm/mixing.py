"""Mixing sources to target weights by Pareto order sampling.

A source is to give `target` words of the `source_size` it has.  Each of its documents is first taken in
floor(target / source_size) certain whole copies.  What is left of the target is a sample without
replacement of fixed size in words: document i has inclusion probability p_i (larger for longer documents,
so that the word total varies little), draws a uniform number u_i from a hash of its id, and documents are
taken in the order of (u_i / (1 - u_i)) / (p_i / (1 - p_i)) until the words left are used up.

The order is never materialised for a source: two rounds of histograms of the rank find, for every source,
the bin in which the words run out, and only the rows of that bin are put in order.  So a source with any
share of the rows is handled by partial aggregates.  Last, one further document may close the gap that
whole documents leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.llm.common import cut, free_names

BINS = 4096
CERTAIN_BELOW = 1e-9
#: Tables of one row per source are broadcast up to this many rows (some MB), else joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size): shares of share * all words by weight.

    Sources in code point order, null last, weigh `weights` in turn.  A target stops at most * source_size; the excess goes to
    the others by weight until none is above (sources in order of most * size / weight are capped as long as
    the level of the rest is above theirs).  The windows run over one row per source.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source whose cap is not below the level fixes it; if there is none, all are capped.
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return w.select("source", "weight", "source_size", F.round(target, 6).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of an MD5, the same on every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def pareto_mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, text_key, source, size, source_size, target, copies, taken.

    Null texts and texts without a word have size 0: they are taken in the certain copies alone and never
    sampled.  Rows that share a doc_id and a text share their draw.  A null source is a source.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    rows = cut(rows)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("texts"))
    counts = totals.select("source", "texts").withColumnRenamed("source", "_s")
    plan = source_targets(totals.select("source", "source_size"), weights, share, most)
    plan = plan.join(counts, plan["source"].eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio + F.lit(CERTAIN_BELOW)).cast("bigint"))
    plan = plan.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = cut(plan.withColumnRenamed("source", "_s"))  # one row per source
    small = plan.count() <= BROADCAST_SOURCES
    beside = F.broadcast if small else (lambda df: df)

    mixed = rows.join(beside(plan), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    mean = F.col("source_size") / F.col("texts")
    p = F.col("left") / F.col("source_size") * F.sqrt(F.col("size") / mean)
    p = F.least(F.lit(1.0 - 1e-9), F.greatest(F.lit(1e-9), p))
    u = uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), seed)
    odds = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    # Odds in (0, inf) keep their order as q in (0, 1).
    drawn = (F.col("left") > 0) & (F.col("size") > 0)
    mixed = mixed.withColumn("q", F.when(drawn, odds / (F.lit(1.0) + odds)))
    sampled = F.col("q").isNotNull()

    last = beside(cut(_last_taken(mixed.where(sampled).select("source", "q", "doc_id", "text_key", "size", "left"), beside)))
    mixed = mixed.join(last, mixed["source"].eqNullSafe(last["_s"]), "left").drop("_s")
    rank = F.struct("q", "doc_id", "text_key")
    base = sampled & F.coalesce(rank <= F.col("stop"), F.lit(False))
    # The document, not yet taken, nearest in size to the words that are still missing.
    rest = F.col("left") - F.coalesce(F.col("sum_taken"), F.lit(0))
    gap = F.abs(F.col("size") - rest)
    closes = sampled & ~base & (gap < F.abs(rest))
    closing = (
        mixed.where(closes)
        .groupBy("source")
        .agg(F.min(F.struct(gap.alias("gap"), F.col("q").alias("q"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))).alias("c"))
        .select(F.col("source").alias("_s"), F.struct("c.q", "c.doc_id", "c.text_key").alias("closer"))
    )
    mixed = mixed.join(beside(closing), mixed["source"].eqNullSafe(closing["_s"]), "left").drop("_s")
    extra = (base | (sampled & F.coalesce(rank.eqNullSafe(F.col("closer")), F.lit(False)))).cast("bigint")
    copies = F.col("whole") + extra
    return mixed.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _last_taken(rows: DataFrame, beside) -> DataFrame:
    """For each source (`_s`) the rank struct `stop` of the last document in order that fits wholly, and the words up to it (`sum_taken`)."""

    def bins(scaled: Column) -> Column:
        return F.least(F.lit(BINS - 1), F.floor(scaled * F.lit(BINS))).cast("int")

    first = bins(F.col("q"))
    second = bins(F.col("q") * F.lit(BINS) - first)
    h = rows.withColumn("b1", first).withColumn("b2", second)
    # The two levels of the histogram have at most BINS**2 bins a source; their counts are sums, so a hot source is combined before the shuffle.
    coarse = h.groupBy("source", "b1").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("b1")
    hit1 = (
        coarse.withColumn("done", F.sum("n").over(upto) - F.col("n"))
        .withColumn("over", F.col("done") + F.col("n") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.when(F.col("over"), F.struct("b1", "done"))).alias("x"))
        .select(F.col("source").alias("_s"), F.col("x.b1").alias("c1"), F.col("x.done").alias("done1"))
    )
    fine = h.join(beside(hit1), h["source"].eqNullSafe(hit1["_s"]) & (F.col("b1") == F.col("c1"))).drop("_s")
    counted = fine.groupBy("source", "b1", "b2").agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first("done1").alias("done1"))
    upto2 = Window.partitionBy("source").orderBy("b2")
    hit2 = (
        counted.withColumn("done", F.col("done1") + F.sum("n").over(upto2) - F.col("n"))
        .withColumn("over", F.col("done") + F.col("n") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.when(F.col("over"), F.struct("b2", "done"))).alias("x"))
        .select(F.col("source").alias("_s"), F.col("x.b2").alias("c2"), F.col("x.done").alias("done2"))
    )
    # Rows of the one fine bin in which a source's words run out: about a BINS**2-th of its rows.
    tail = fine.join(beside(hit2), fine["source"].eqNullSafe(hit2["_s"]) & (F.col("b2") == F.col("c2"))).drop("_s")
    ordered = Window.partitionBy("source").orderBy("q", "doc_id", "text_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = tail.withColumn("done", F.col("done2") + F.sum("size").over(ordered))
    fits = (
        tail.groupBy("source")
        .agg(
            F.max(F.when(F.col("done") <= F.col("left"), F.struct("done", F.struct("q", "doc_id", "text_key").alias("stop")))).alias("x"),
            F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("done2").alias("done2"),
        )
    )
    # If not even the bin's first row fits, all before the bin are taken.
    edge = (F.col("b1") + F.col("b2") / F.lit(float(BINS))) / F.lit(float(BINS))
    nothing = F.struct(edge.alias("q"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("text_key"))
    hit = fits.select(F.col("source").alias("_s"), F.coalesce(F.col("x.stop"), nothing).alias("stop"), F.coalesce(F.col("x.done"), F.col("done2")).cast("double").alias("sum_taken"))
    # A source none of whose bins runs over is taken whole.
    whole = hit1.where("c1 is null").join(rows.groupBy("source").agg(F.sum("size").alias("n")), F.col("_s").eqNullSafe(F.col("source")))
    everything = F.struct(F.lit(2.0).alias("q"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("text_key"))
    return hit.unionByName(whole.select("_s", everything.alias("stop"), F.col("n").cast("double").alias("sum_taken")))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it (not at all included); columns are those of docs, whatever their names."""
    copies_, id_, key_, mine_, nth_ = free_names(docs.columns, "copies", "id", "key", "mine", "nth")
    found = pareto_mix(docs, **options).groupBy("doc_id", "text_key").agg(F.max("copies").alias(copies_))
    found = found.where(F.col(copies_) > 0).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), copies_)
    tagged = docs.withColumn(mine_, F.xxhash64("text"))
    same = (F.col(mine_) == F.col(key_)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    chosen = tagged.join(found, same)
    return chosen.withColumn(nth_, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies_)))).select(*docs.columns)


#: The rows of `pareto_mix` (doc_id, size, source_size, target, taken) in DuckDB's SQL, for distinct doc_ids.
ORACLE_SQL = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, count(*) filter (size > 0) as texts from d group by source),
s1 as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s0),
s2 as (select *, 1.5::double * sum(source_size) over () as budget,
  coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0) as filled,
  sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as open_weight from s1),
s3 as (select *, (budget - filled) / open_weight as lv from s2),
s4 as (select min_by(lv, cap / weight) filter (lv * weight <= cap) as level from s3),
s5 as (select source, source_size, texts, round(coalesce(least(cap, level * weight), cap), 6) as target from s3 cross join s4),
p as (select *, case when source_size > 0 then floor(target / source_size + 1e-9)::bigint else 0 end as whole from s5),
q as (select *, greatest(0.0::double, target - whole * source_size) as left_words from p),
r as (select d.doc_id, d.source, d.size, q.source_size, q.target, q.whole, q.left_words,
  (('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u,
  least(1.0::double - 1e-9, greatest(1e-9::double, q.left_words / q.source_size * sqrt(d.size / (q.source_size * 1.0::double / q.texts)))) as pi
  from d join q on d.source is not distinct from q.source),
o as (select *, case when left_words > 0 and size > 0 then (u / (1.0 - u)) / (pi / (1.0 - pi)) end as odds from r),
x as (select *, odds / (1.0 + odds) as rank from o),
c as (select *, sum(case when rank is not null then size end) over (partition by source order by rank nulls last, doc_id rows unbounded preceding) as done from x),
b as (select *, rank is not null and done <= left_words as base from c),
m as (select source, coalesce(sum(size) filter (base), 0) as got from b group by source),
g as (select b.*, left_words - got as missing, abs(size - (left_words - got)) as gap from b join m on b.source is not distinct from m.source),
k as (select source, min({'gap': gap, 'rank': rank, 'doc_id': doc_id}) as best from g where rank is not null and not base and gap < abs(missing) group by source)
select g.doc_id, size, source_size, target, ((whole + case when base or coalesce(best.doc_id = g.doc_id, false) then 1 else 0 end) * size)::bigint as taken
from g left join k on g.source is not distinct from k.source
"""
