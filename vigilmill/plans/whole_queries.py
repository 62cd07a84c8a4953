"""Whole forms of queries whose registered SQL is held to a cap or an id subset: same operators, all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions import text as tx
from vigilmill.operators.memory import SOURCE_CAP
from vigilmill.plans.catalog_queries import _HOST, _hosts
from vigilmill.plans.registry import query
from vigilmill.streaming.session import MOST


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P'")
def all_approvals_with_request(t):
    """Every pending approval with what asked for it."""
    j = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_name", "c_mktsegment")


@query("""select distinct 'v' || (p_size % 12) || '.' || (p_partkey % 30) || '.0' as version, (p_size % 12)::int as major, (p_partkey % 30)::int as minor from part""")
def all_versions_in_order(t):
    """Every release by the numbers in its name."""
    v = t.part.select(F.concat(F.lit("v"), (F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), F.lit(".0")).alias("version")).distinct()
    key = F.transform(F.regexp_extract_all("version", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return v.withColumn("key", key).orderBy("key").select("version", F.col("key")[0].alias("major"), F.col("key")[1].alias("minor"))


@query(f"""with {_HOST}, k as (select distinct host, path from h where page_id in (select page_id from pages where contains(lower(html), '<script'))), j as (select h.page_id, case when k.path not in ('', '/') and (h.path = k.path or starts_with(h.path, rtrim(k.path, '/') || '/')) then 1 else 2 end as p from h join k using (host))
 select page_id, case when min(p) = 1 then 'path' else 'host' end as traced from j group by 1""")
def all_traced_urls(t):
    """URLs on the host of any page with a script, and whether at or below the path of one: equi joins on host and path prefix."""
    h = _hosts(t)
    marked = t.pages.where(F.lower("html").contains("<script")).select("page_id")
    known = h.join(marked, "page_id", "left_semi").select("host", "path").distinct()
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = known.where(~F.col("path").isin("", "/")).select("host", F.inline(F.array(key("below", F.expr("rtrim('/', path)")), key("same", F.col("path"))))).distinct()
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: key("below", F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    near = h.select("page_id", "host", F.inline(F.concat(above, F.array(key("same", F.col("path")))))).join(keys, ["host", "kind", "key"], "left_semi").select("page_id", F.lit("path").alias("traced")).distinct()
    traced = h.join(known.select("host").distinct(), "host", "left_semi").select("page_id").distinct()
    return traced.join(near, "page_id", "left").select("page_id", F.coalesce("traced", F.lit("host")).alias("traced"))


#: Vectors of a block: two blocks and their products fit a task.
BLOCK = 1024


@query("""with v as (select vec_id, embedding::double[] as e, label from embeddings),
 s as (select q.vec_id, max(round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 6)) as sim from v q join v i on i.label <> 0 where q.label = 0 group by 1)
 select vec_id from v where label = 0 and vec_id not in (select vec_id from s where sim >= 0.92)""")
def kept_injection_vectors(t):
    """Injection vectors (label 0) that are not within cosine 0.92 of a benign one: every pair, block by block."""
    def blocked(rows, name):
        n = max(1, -(-rows.count() // BLOCK))
        return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n))).agg(F.collect_list("vec_id").alias(f"{name}_id"), F.flatten(F.collect_list(F.col("embedding").cast("array<double>"))).alias(name)).select(f"{name}_id", name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a, b = r.q.reshape(len(r.q_id), -1), r.i.reshape(len(r.i_id), -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = np.round(a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)), 6)
                yield pd.DataFrame({"vec_id": np.asarray(r.q_id)[(sim >= 0.92).any(axis=1)]})

    v = t.embeddings.select("vec_id", "embedding", "label")
    injected = v.where("label = 0")
    pairs = blocked(injected, "q").crossJoin(blocked(v.where("label <> 0"), "i"))
    near = pairs.mapInPandas(run, f"vec_id {dict(v.dtypes)['vec_id']}")
    return injected.select("vec_id").join(near, "vec_id", "left_anti")


@query("""select doc_id, case when length(text) > 20000 then left(text, 10000) || chr(10) || right(text, 10000) else text end as seen from documents where text is not null""")
def full_head_tail_window(t):
    """Texts as the threat memory sees them, at the operator's own limit."""
    return t.documents.where("text is not null").select("doc_id", tx.head_and_tail(F.col("text")).alias("seen"))


@query(f"""with d as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) select source, doc_id from d where n <= {SOURCE_CAP}""")
def full_source_quota_keep(t):
    """The strongest items of each source stay, at the memory's own cap."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SOURCE_CAP).select("source", "doc_id")


@query(f"""with n as (select user_id, event_type, max((ts, event_id)) as m from events group by 1, 2), r as (select user_id, event_type, row_number() over (partition by user_id order by m desc) as k, count(*) over (partition by user_id) as held from n)
 select user_id, event_type, held > {MOST} as incomplete from r where k <= {MOST}""")
def full_newest_bounded_set(t):
    """The values seen last in each session, at the stream's own bound; dropping any marks the session incomplete."""
    n = t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    w = Window.partitionBy("user_id")
    r = n.withColumn("k", F.row_number().over(w.orderBy(F.desc("m")))).withColumn("held", F.count("*").over(w))
    return r.where(F.col("k") <= MOST).select("user_id", "event_type", (F.col("held") > MOST).alias("incomplete"))
