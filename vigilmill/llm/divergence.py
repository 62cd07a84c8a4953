"""Divergence of the sources of a language, by sort-based streaming over term runs.

Documents become entries (language, term, source, document) with a count.  Entries are sorted and scanned in runs: once over
each buffer of documents in the task that reads them, so that what is shuffled has at most one row for a term of a source and
buffer, and once more behind a shuffle by (language, term) with a secondary sort.  The scan gives document frequency and counts
of each term and source.  A last scan over the kept terms, again in runs of (language, term), emits partial sums
of pairs of sources and the best terms of each source, which are combined before they are shuffled.

A pair's sum runs over all kept terms, but most terms miss in most sources.  With f(a, b) for a term of counts a and b,
summed over terms,

    sum f(a, b) = sum over a of h_s(a) f(a, 0) + sum over b of h_t(b) f(0, b) + (V - T_s - T_t) f(0, 0)
                  + sum over terms of both of [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]

where h_s(a) is how many kept terms have count a in source s and T_s how many it has at all.  So only terms that both have are
met pair by pair; the rest is a join on histograms of counts.  All of it is exact in integers.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.llm.blocks import beside
from vigilmill.llm.common import cut

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: Entries of a task's buffer before they are sorted and scanned.
BUFFER_ENTRIES = 1 << 21
#: Sources of a language that meet in one task of the join of sources.
SOURCES_A_TASK = 4096

#: Bytes of a term stay, A-Z in lower case; all others part terms.  Every byte of a character beyond ASCII is of a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("documents", pa.int64()), ("n", pa.int64())])
PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to runs (lang, term, source): documents that have the term, and its occurrences."""
    groups: dict = {}  # (lang, source) and terms of the buffer, numbered as they come
    terms: dict = {}
    of, counts, lengths, owners = array("q"), array("q"), array("q"), array("q")  # entries; entries and group of each document

    def scan() -> pa.RecordBatch:
        # Documents stand in the order they were read, and the sort is stable: a run is sorted by document.
        key = np.frombuffer(of, np.int64) * len(groups) + np.repeat(np.frombuffer(owners, np.int64), np.frombuffer(lengths, np.int64))
        n = np.frombuffer(counts, np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        term, group = np.divmod(key[starts], len(groups))
        langs, sources = (pa.array(side, pa.string()).take(pa.array(group)) for side in zip(*groups))
        spelled = pa.array(list(terms), pa.binary()).take(pa.array(term)).cast(pa.string())
        documents = pa.array(np.diff(np.r_[starts, len(key)]))
        return pa.record_batch([langs, spelled, sources, documents, pa.array(np.add.reduceat(n, starts))], schema=RUNS)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = Counter(text.translate(TERM_BYTES).split())
            if not found:
                continue
            owners.append(groups.setdefault((lang, source), len(groups)))
            lengths.append(len(found))
            of.extend([terms.setdefault(t, len(terms)) for t in found])
            counts.extend(found.values())
            if len(of) >= BUFFER_ENTRIES:
                yield scan()
                groups, terms = {}, {}
                of, counts, lengths, owners = array("q"), array("q"), array("q"), array("q")
    if of:
        yield scan()


def _changes(table: pa.Table, *columns: str) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns; the first does."""
    found = np.zeros(len(table), dtype=bool)
    found[:1] = True
    for name in columns:
        values = table.column(name).combine_chunks()
        found[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return found


def _merged(table: pa.Table) -> pa.Table:
    """Rows of a run of (term, lang, source) as one."""
    starts = np.flatnonzero(_changes(table, "term", "lang", "source"))
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)) for c in ("documents", "n")}
    rows = table.select(["lang", "term", "source"]).take(pa.array(starts))
    return pa.table([*rows.columns, sums["documents"], sums["n"]], schema=RUNS)


def _merge(least: int):
    """Sorted partial runs to the terms that enough documents of the language have: one row a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = RUNS.empty_table()  # the run of (term, lang) that the next batch may go on with

        def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(_changes(table, "term", "lang"))
            documents = np.add.reduceat(table.column("documents").to_numpy(), starts)
            enough = np.repeat(documents >= least, np.diff(np.r_[starts, len(table)]))
            yield from table.filter(pa.array(enough)).to_batches()

        for batch in batches:
            if batch.num_rows:
                table = _merged(pa.concat_tables([held, pa.Table.from_batches([batch], RUNS)]))
                last = int(np.flatnonzero(_changes(table, "term", "lang"))[-1])
                if last:
                    yield from kept(table.slice(0, last))
                held = table.slice(last)
        if len(held):
            yield from kept(held)

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, documents, n) of the terms that at least `least` documents of the language have; n occurrences."""
    read = docs.select(_empty("lang"), _empty("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    runs = read.mapInArrow(_read, "lang string, term string, source string, documents bigint, n bigint")
    # Runs are the same with the term first, which tells rows apart sooner.
    dealt = runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    return dealt.mapInArrow(_merge(least), "lang string, term string, source string, documents bigint, n bigint")


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) in decimals, exact for any count; 1 where there is no term."""
    above = (n + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", above, below).cast("bigint")).otherwise(F.lit(1))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, present, lang_total, terms, p0) of every (lang, source) of docs, even without terms.

    total: occurrences of kept terms; present: kept terms that it has; terms: kept terms of the language; p0: p of a term it has not.
    """
    groups = docs.select(_empty("lang"), _empty("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    vocabulary = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    found = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "present", "lang_total", "terms"])
    return found.withColumn("p0", _p(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))


def _near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tops:
    """The best terms of each source that a task has met: value descending, term ascending."""

    def __init__(self, top: int):
        self.top, self.held = top, {}

    def add(self, key: tuple, rows: list[tuple]) -> None:
        """rows: (-value, term as bytes)"""
        self.held[key] = sorted(self.held.get(key, []) + rows)[: self.top]

    def take(self) -> list[tuple]:
        out = [(*key, "term", term.decode(), -value) for key, rows in self.held.items() for value, term in rows]
        self.held.clear()
        return out


def _scan(top: int):
    """Runs of (lang, term) to partial pair sums of the terms that two sources have, and to the best terms of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        tops = Tops(top)
        held: list[pa.RecordBatch] = []

        def scan(table: pa.Table) -> None:
            lang, term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
            l, t, s = (np.asarray(c.indices) for c in (lang, term, source))  # noqa: E741
            langs, terms, sources = (c.dictionary.to_pylist() for c in (lang, term, source))
            p, p0, q = (table.column(c).to_numpy() for c in ("p", "p0", "q"))
            at, d, size = np.arange(len(t)), 1, len(sources)
            # Rows of a run stand side by side: each distance d gives the pairs of a run that are d apart.
            while len(at := at[at + d < len(t)]) and len(at := at[(t[at] == t[at + d]) & (l[at] == l[at + d])]):
                a, b = at, at + d
                value = _near(p[a], p[b]) - _near(p[a], p0[b]) - _near(p0[a], p[b]) + _near(p0[a], p0[b])
                key = (l[a].astype(np.int64) * size + s[a]) * size + s[b]
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                for k, v in zip(key[order][starts].tolist(), np.add.reduceat(value[order], starts).tolist()):
                    group, two = divmod(k, size)
                    pairs[langs[group // size], sources[group % size], sources[two]] += v
                d += 1
            above = np.flatnonzero(p > q)
            f = _near(p[above], q[above])
            code = l[above].astype(np.int64) * size + s[above]
            # Only the best of a source in these rows, ties included, are compared by their terms.
            order = np.lexsort((-f, code))
            edges = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True]) if len(order) else []
            for lo, hi in zip(edges, edges[1:]):
                mine = order[lo:hi]
                least = f[mine[min(top, len(mine)) - 1]]
                mine = mine[: np.searchsorted(-f[mine], -least, side="right")]
                key = langs[int(code[mine[0]]) // size], sources[int(code[mine[0]]) % size]
                tops.add(key, [(-int(f[i]), terms[t[above[i]]].encode()) for i in mine])

        def emitted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch.column("lang"), batch.column("term")
            # The last run may go on in the next batch.
            n = batch.num_rows
            last = n - 1
            while last and term[last - 1].as_py() == term[n - 1].as_py() and lang[last - 1].as_py() == lang[n - 1].as_py():
                last -= 1
            if last:
                scan(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif held and (held[-1].column("term")[0].as_py(), held[-1].column("lang")[0].as_py()) != (term[0].as_py(), lang[0].as_py()):
                scan(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
            if len(pairs) > BUFFER_ENTRIES or len(tops.held) * top > BUFFER_ENTRIES:
                yield from emitted([(a, b, "pair", c, v) for (a, b, c), v in pairs.items()] + tops.take())
                pairs.clear()
        if held:
            scan(pa.Table.from_batches(held))
        yield from emitted([(a, b, "pair", c, v) for (a, b, c), v in pairs.items()] + tops.take())

    return run


def _source_pairs(groups: DataFrame, count: int) -> DataFrame:
    """Ordered pairs of different sources of a language; a language's sources meet in several tasks, of SOURCES_A_TASK rows of the one side each."""
    salts = 1 + count // SOURCES_A_TASK
    one = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)))
    two = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("present").alias("item_present"), F.col("p0").alias("item_p0"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    two = two.withColumn("salt", F.col("salt").cast("bigint"))
    return one.join(two, ["lang", "salt"]).where(F.col("source") != F.col("item")).drop("salt")


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, each other source of the language; part `term`, the `top` terms above the language's share.

    Null texts, languages and sources are empty strings and groups like others.  A row is a document, repeated rows are several; doc_id is
    not read.  A language without kept terms has pairs of value 0 and no terms; an empty table gives no row.  Ties go by item.
    """
    kept = cut(kept_terms(docs, least))
    groups = cut(group_sizes(docs, kept))
    n_groups = groups.count()
    near = F.broadcast if n_groups <= 50_000 else (lambda df: df)

    rated = kept.join(near(groups.select("lang", "source", "total", "terms", "p0")), ["lang", "source"])
    rated = rated.withColumn("p", _p(F.col("n"), F.col("total"), F.col("terms")))
    shares = kept.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    whole = groups.select("lang", "lang_total", "terms").distinct()
    shares = shares.join(near(whole), "lang").select("lang", "term", _p(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    runs = rated.select("lang", "term", "source", "p", "p0").join(shares, ["lang", "term"]).repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    parts = cut(runs.mapInArrow(_scan(top), "lang string, source string, part string, item string, value bigint"))

    best = parts.where(F.col("part") == "term")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # f(a, 0) over a source's histogram of counts, for each other source.
    histogram = rated.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("same"))
    pairs = cut(_source_pairs(groups, n_groups))
    alone = histogram.join(beside(pairs.select("lang", "source", "item", "item_p0")), ["lang", "source"])
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("same") * _f(F.col("p"), F.col("item_p0"))).alias("value"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = parts.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    absent = (F.col("terms") - F.col("present") - F.col("item_present")) * _f(F.col("p0"), F.col("item_p0"))
    rest = pairs.select("lang", "source", "item", absent.alias("value"))
    total = rest.unionByName(alone).unionByName(turned).unionByName(both).unionByName(back)
    total = total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    total = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return total.unionByName(best.select(*total.columns))


#: The same rows in DuckDB, with 128-bit integers.
ORACLE_SQL = """
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), entries as (
  select lang, source, term, d, count(*) as n
  from (select lang, source, d, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs)
  group by all
), vocabulary as (
  select lang, term, sum(n)::hugeint as lang_n from entries group by all having count(*) >= 10
), langs as (
  select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as total from vocabulary group by all
), groups as (
  select distinct lang, source from docs
), counts as (
  select g.lang, g.source, v.term, v.lang_n, coalesce(e.n, 0)::hugeint as n
  from groups g join vocabulary v using (lang)
  left join (select lang, source, term, sum(n) as n from entries group by all) e on e.lang = g.lang and e.source = g.source and e.term = v.term
), sized as (
  select *, sum(n) over (partition by lang, source)::hugeint as total from counts
), rated as (
  select s.lang, s.source, s.term, s.n, 1 + (1000000000::hugeint * (s.n + 2)) // (s.total + 2 * l.v) as p,
         1 + (1000000000::hugeint * (s.lang_n + 2)) // (l.total + 2 * l.v) as q
  from sized s join langs l using (lang)
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from rated a join rated b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from rated where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from (from pairs union all from terms)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
