"""Studies of guards and releases: runs are `lineitem` rows (a build is a supplier, a cell a part, a repetition the line number, the outcome a flag), fixtures `orders`, guards by priority."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions import stats
from vigilmill.operators import decisions as dec
from vigilmill.plans.registry import query

_RUN = """r as (select l_orderkey as id, l_suppkey % 9 as build, l_partkey % 8 as cell, l_linenumber as rep, l_linestatus as arm, l_shipdate as tm,
 case when l_quantity > 45 then 'INVALID' when l_returnflag = 'R' then 'BLOCKED' when l_returnflag = 'A' then 'PROMPTED' else 'RAN' end as outcome from lineitem)"""


def _runs(t):
    outcome = F.when(F.col("l_quantity") > 45, "INVALID").when(F.col("l_returnflag") == "R", "BLOCKED").when(F.col("l_returnflag") == "A", "PROMPTED").otherwise("RAN")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 9).alias("build"), (F.col("l_partkey") % 8).alias("cell"), F.col("l_linenumber").alias("rep"), F.col("l_linestatus").alias("arm"), F.col("l_shipdate").alias("at"), outcome.alias("outcome"))


@query(f"""with {_RUN}, v as (select * from r where outcome <> 'INVALID') select build, cell, arm, bool_and(outcome in ('BLOCKED', 'PROMPTED')) as survived, count(*) as n from v group by all""")
def cell_matrix(t):
    """A cell of a build and arm survives if every valid repetition was held."""
    v = _runs(t).where("outcome <> 'INVALID'")
    return v.groupBy("build", "cell", "arm").agg(F.bool_and(F.col("outcome").isin("BLOCKED", "PROMPTED")).alias("survived"), F.count("*").alias("n"))


@query(f"""with {_RUN}, m as (select build, cell, outcome from (select build, cell, outcome, row_number() over (partition by build, cell order by id, rep) as n from r where outcome <> 'INVALID') where n = 1),
 g as (select b.build, c.cell from (select distinct build from r) b cross join (select distinct cell from r) c)
 select g.build, g.cell, coalesce(m.outcome, i.outcome, 'UNMEASURED') as outcome, m.outcome is null and i.outcome is not null as inherited from g left join m on m.build = g.build and m.cell = g.cell and g.cell < 6 left join m i on i.build = g.build and i.cell = 0""")
def inherited_cells(t):
    """The first valid outcome of each cell; cells of failures have none of their own and inherit their representative's."""
    r = _runs(t)
    w = Window.partitionBy("build", "cell").orderBy("id", "rep")
    m = r.where("outcome <> 'INVALID'").withColumn("n", F.row_number().over(w)).where("n = 1").select("build", "cell", "outcome")
    grid = r.select("build").distinct().crossJoin(F.broadcast(r.select("cell").distinct()))  # builds by cells of the grid
    own = m.where("cell < 6").withColumnRenamed("outcome", "own")
    rep = m.where("cell = 0").select("build", F.col("outcome").alias("rep"))
    j = grid.join(own, ["build", "cell"], "left").join(rep, "build", "left")
    return j.select("build", "cell", F.coalesce("own", "rep", F.lit("UNMEASURED")).alias("outcome"), (F.col("own").isNull() & F.col("rep").isNotNull()).alias("inherited"))


@query(f"""with {_RUN}, m as (select build, cell, bool_or(outcome = 'RAN') filter (arm = 'O') as theirs_failed, bool_and(outcome <> 'RAN') filter (arm = 'F') as ours_held from r where outcome <> 'INVALID' group by 1, 2)
 select count(*) filter (theirs_failed) as pairs, count(*) filter (theirs_failed and ours_held) as survived from m""")
def headline_survival(t):
    """Of the cells and builds where the other guard's verdict did not survive, how often ours does."""
    v = _runs(t).where("outcome <> 'INVALID'")
    ran = F.col("outcome") == "RAN"
    m = v.groupBy("build", "cell").agg(F.bool_or(F.when(F.col("arm") == "O", ran)).alias("f"), F.bool_and(F.when(F.col("arm") == "F", ~ran)).alias("h"))
    return m.agg(F.count_if("f").alias("pairs"), F.count_if(F.col("f") & F.col("h")).alias("survived"))


@query(f"""with {_RUN}, l as (select build from r group by 1 having not bool_or(outcome = 'INVALID' and cell = 0 and rep = 7 and arm = 'F' and day(tm) = 1)) select build, cell, count(*) as n from r where build in (select build from l) group by 1, 2""")
def live_builds(t):
    """Runs of the builds whose every control run reached the hook."""
    r = _runs(t)
    control = F.expr("cell = 0 and rep = 7 and arm = 'F' and day(at) = 1")
    live = r.groupBy("build").agg(F.bool_or(control & (F.col("outcome") == "INVALID")).alias("dead")).where("not dead").select("build")
    return r.join(live, "build", "left_semi").groupBy("build", "cell").agg(F.count("*").alias("n"))


@query(f"""with {_RUN}, c as (select build, cell, case when count(*) filter (outcome <> 'INVALID') = 0 then 'none' when count(distinct outcome) filter (outcome <> 'INVALID') = 1 then min(outcome) filter (outcome <> 'INVALID') else 'mixed' end as o from r where rep = 7 and day(tm) = 1 group by 1, 2),
 j as (select build, max(o) filter (cell = 0) as r0, max(o) filter (cell = 1) as r1 from c group by 1) select build, case when r0 is null or r1 is null or r0 in ('mixed', 'none') or r1 in ('mixed', 'none') then 'unclear' when r0 = r1 then 'same' else 'DIFFER' end as controls from j""")
def control_comparison(t):
    """The two controls of a build: same, DIFFER, or unclear where one is mixed or missing."""
    valid = F.when(F.col("outcome") != "INVALID", F.col("outcome"))
    c = _runs(t).where("rep = 7 and day(at) = 1").groupBy("build", "cell").agg(F.count(valid).alias("n"), F.min(valid).alias("a"), F.max(valid).alias("b"))
    o = F.when(F.col("n") == 0, "none").when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed")
    j = c.withColumn("o", o).groupBy("build").agg(F.max(F.when(F.col("cell") == 0, F.col("o"))).alias("r0"), F.max(F.when(F.col("cell") == 1, F.col("o"))).alias("r1"))
    unclear = F.col("r0").isNull() | F.col("r1").isNull() | F.col("r0").isin("mixed", "none") | F.col("r1").isin("mixed", "none")
    return j.select("build", F.when(unclear, "unclear").when(F.col("r0") == F.col("r1"), "same").otherwise("DIFFER").alias("controls"))


@query(f"""with {_RUN}, k as (select cell, build, bool_or(outcome = 'BLOCKED') filter (arm = 'F') as blocked_with, bool_or(outcome = 'RAN') filter (arm = 'O') as ran_without from r where cell >= 4 group by 1, 2)
 select build, bool_or(coalesce(blocked_with and ran_without, false)) as effect from k group by 1""")
def setting_effects(t):
    """Whether a setting matters in a build: some failure is blocked with it and runs without."""
    k = _runs(t).where("cell >= 4").groupBy("cell", "build").agg(F.bool_or(F.when(F.col("arm") == "F", F.col("outcome") == "BLOCKED")).alias("w"), F.bool_or(F.when(F.col("arm") == "O", F.col("outcome") == "RAN")).alias("o"))
    return k.groupBy("build").agg(F.bool_or(F.coalesce(F.col("w") & F.col("o"), F.lit(False))).alias("effect"))


@query(f"""with {_RUN}, c as (select build, cell, outcome, count(*) as n from r where outcome <> 'INVALID' group by 1, 2, 3), t as (select build, cell, count(*) as total, count(*) filter (outcome = 'INVALID') as bad from r group by 1, 2),
 m as (select build, cell, max(n) as top, sum(n) as valid, arg_max(outcome, (n, outcome)) as modal from c group by 1, 2)
 select t.build, t.cell, m.modal, case when m.valid is null then 'invalid' when bad > 0.25 * total then 'invalid_heavy' when top >= 0.8 * valid then 'scored' else 'flaky' end as status from t left join m using (build, cell)""")
def cell_status(t):
    """The modal outcome of a cell, and whether it is scored, flaky or carried by invalid runs."""
    r = _runs(t)
    c = r.where("outcome <> 'INVALID'").groupBy("build", "cell", "outcome").agg(F.count("*").alias("n"))
    m = c.groupBy("build", "cell").agg(F.max("n").alias("top"), F.sum("n").alias("valid"), F.max_by("outcome", F.struct("n", "outcome")).alias("modal"))
    total = r.groupBy("build", "cell").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "INVALID").alias("bad"))
    status = dec.ladder((F.col("valid").isNull(), "invalid"), (F.col("bad") > 0.25 * F.col("total"), "invalid_heavy"), (F.col("top") >= 0.8 * F.col("valid"), "scored"), otherwise="flaky")
    return total.join(m, ["build", "cell"], "left").select("build", "cell", "modal", status.alias("status"))


@query(f"""with {_RUN}, h as (select build, cell, count(*) filter (arm = 'F') as yes, count(*) filter (arm = 'O') as no from r where rep = 7 and day(tm) = 1 group by 1, 2)
 select build, cell, case when yes + no = 0 then null when no = 0 then 'true' when yes = 0 then 'false' else 'partial' end as invoked from h""")
def hook_invoked(t):
    """Whether the hook ran in all, none or some of a cell's repetitions."""
    h = _runs(t).where("rep = 7 and day(at) = 1").groupBy("build", "cell").agg(F.count_if(F.col("arm") == "F").alias("yes"), F.count_if(F.col("arm") == "O").alias("no"))
    return h.select("build", "cell", F.when(F.col("yes") + F.col("no") == 0, None).when(F.col("no") == 0, "true").when(F.col("yes") == 0, "false").otherwise("partial").alias("invoked"))


@query("""select l_orderkey as id, l_linenumber as rep, case when l_quantity > 45 then 'INVALID' when l_returnflag = 'R' and l_discount > 0.05 then 'BLOCKED' when l_returnflag = 'A' then 'PROMPTED' when l_tax > 0.07 then 'HUNG' when l_returnflag = 'N' then 'RAN' else 'INVALID' end as outcome from lineitem""")
def run_outcomes(t):
    """The outcome of a run from its evidence, in order: invalid, blocked, prompted, hung, ran."""
    f = F.col("l_returnflag")
    o = dec.ladder((F.col("l_quantity") > 45, "INVALID"), ((f == "R") & (F.col("l_discount") > 0.05), "BLOCKED"), (f == "A", "PROMPTED"), (F.col("l_tax") > 0.07, "HUNG"), (f == "N", "RAN"), otherwise="INVALID")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rep"), o.alias("outcome"))


_FIX = """f as (select o_orderkey as id, o_custkey % 2 = 0 as harmful, o_orderstatus as category from orders), g as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) as guard),
 d as (select l_orderkey as id, case l_linenumber % 3 when 0 then '1-URGENT' when 1 then '2-HIGH' else '3-MEDIUM' end as guard, max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end) as rank from lineitem group by 1, 2),
 j as (select f.id, g.guard, harmful, category, case coalesce(d.rank, 0) when 2 then 'deny' when 1 then 'ask' else 'allow' end as class, d.rank is not null as invoked from f cross join g left join d on d.id = f.id and d.guard = g.guard)"""


def _decided(t):
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM")
    f = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2 == 0).alias("harmful"), F.col("o_orderstatus").alias("category"), F.explode(F.array(*map(F.lit, names))).alias("guard"))
    guard = F.element_at(F.array(*map(F.lit, names)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), guard.alias("guard")).agg(F.max(F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("rank"))
    j = f.join(d, ["id", "guard"], "left")
    return j.withColumn("class", F.when(F.col("rank") == 2, "deny").when(F.col("rank") == 1, "ask").otherwise("allow")).withColumn("invoked", F.col("rank").isNotNull())


@query(f"with {_FIX} select id, guard, class, invoked from j")
def fixture_decisions(t):
    """Every fixture with each guard's decision; a guard that was not invoked allows."""
    return _decided(t).select("id", "guard", "class", "invoked")


@query(f"""with {_FIX} select guard, coalesce(category, 'all') as category, count(*) filter (harmful and class = 'deny') as harmful_deny, count(*) filter (harmful and class = 'ask') as harmful_ask, count(*) filter (harmful and class = 'allow') as harmful_allow,
 count(*) filter (not harmful and class = 'deny') as benign_deny, count(*) filter (not harmful and class = 'ask') as benign_ask, count(*) filter (not harmful and class = 'allow') as benign_allow from j group by grouping sets ((guard, category), (guard))""")
def guard_tally(t):
    """Harmful and benign fixtures by each guard's answer, by category and overall."""
    counts = [F.count_if((F.col("harmful") == h) & (F.col("class") == c)).alias(f"{n}_{c}") for h, n in ((True, "harmful"), (False, "benign")) for c in ("deny", "ask", "allow")]
    j = _decided(t)
    g = j.groupingSets([["guard", "category"], ["guard"]], "guard", "category").agg(*counts)
    return g.select("guard", F.coalesce("category", F.lit("all")).alias("category"), *[f"{n}_{c}" for n in ("harmful", "benign") for c in ("deny", "ask", "allow")])


@query(f"""with {_FIX}, m(class, mode, outcome) as (values ('deny', 'headless', 'BLOCKED'), ('ask', 'headless', 'RAN'), ('allow', 'headless', 'RAN'), ('deny', 'interactive', 'BLOCKED'), ('ask', 'interactive', 'PROMPTED'), ('allow', 'interactive', 'RAN'))
 select guard, mode, outcome, count(*) as n from j join m using (class) group by all""")
def effective_outcomes(t):
    """Decisions as what they come to in each mode of a harness."""
    m = t.spark.createDataFrame([(c, mode, o) for mode, os in (("headless", ("BLOCKED", "RAN", "RAN")), ("interactive", ("BLOCKED", "PROMPTED", "RAN"))) for c, o in zip(("deny", "ask", "allow"), os)], "class string, mode string, outcome string")
    return _decided(t).join(F.broadcast(m), "class").groupBy("guard", "mode", "outcome").agg(F.count("*").alias("n"))


@query(f"""with {_FIX}, p as (select a.id, a.class <> 'allow' as x, b.class <> 'allow' as y from j a join j b on a.id = b.id and a.guard = '1-URGENT' and b.guard = '2-HIGH' where a.harmful)
 select count(*) as items, count(*) filter (x and not y) as only_a, count(*) filter (y and not x) as only_b from p""")
def paired_guards(t):
    """Two guards on the same harmful fixtures: flagged by one alone."""
    j = _decided(t).where("harmful").withColumn("f", F.col("class") != "allow")
    p = j.groupBy("id").agg(F.max(F.when(F.col("guard") == "1-URGENT", F.col("f"))).alias("x"), F.max(F.when(F.col("guard") == "2-HIGH", F.col("f"))).alias("y"))
    return p.agg(F.count("*").alias("items"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(F.col("y") & ~F.col("x")).alias("only_b"))


@query("""with s as (select c.n_name, c.k as wins, d.k as losses from (select n_name, count(*) as k from customer join nation on c_nationkey = n_nationkey group by 1) c join (select n_name, count(*) as k from supplier join nation on s_nationkey = n_nationkey group by 1) d using (n_name)),
 l as (select n_name, wins, losses, least(wins, losses) as low, wins + losses as n from s)
 select n_name, round(least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from range(0, low + 1) r(i))), 6) as p from l""")
def sign_tests_by_nation(t):
    """The exact sign test of wins and losses, also where one half to the n underflows."""
    n = t.nation.select("n_nationkey", "n_name")
    w = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("wins"))
    l_ = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("losses"))
    return w.join(l_, "n_name").select("n_name", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("""with c as (select source, row_number() over (order by source) - 1 as i, count(*) as n, sum(toxic)::bigint as k, sum(1 - quality)::bigint as q from labels join documents using (doc_id) group by source),
 m as (select count(*) as c from c), d as (select r, j, ('0x' || substr(md5(r || ':' || j), 1, 8))::bigint % c as i from range(2000) a(r) cross join m cross join lateral (select unnest(range(c)) as j) x),
 b as (select r, (sum(k) - sum(q)) * 1.0::double / sum(n) as gap from d join c using (i) group by r), o as (select gap, row_number() over (order by gap) - 1 as pos from b)
 select round(min(gap) filter (pos = 50), 6) as low, round(min(gap) filter (pos = 1949), 6) as high, round((select count(*) filter (gap >= 0) * 1.0::double / count(*) from b), 6) as share from o""")
def paired_bootstrap_gap(t):
    """Percentile interval of the difference of two detectors' rates over 2,000 draws of sources, the same draws for both, and the share of draws not below zero."""
    per = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"), F.sum(1 - F.col("quality")).alias("q"))
    return stats.cluster_bootstrap_gap(per, "source", "k", "q", "n", 2000)


@query("""with x as (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as attempt from events),
 s as (select user_id, min(attempt) filter (event_type = 'error') as first_evasion, count(*) as attempts from x group by 1) select user_id, first_evasion, attempts, first_evasion is not null and first_evasion <= 10 as within_ten from s""")
def evasion_attempts(t):
    """Attempts until the first valid evasion of each seed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = t.events.withColumn("attempt", F.row_number().over(w)).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("attempt"))).cast("bigint").alias("first_evasion"), F.count("*").alias("attempts"))
    return s.withColumn("within_ten", F.coalesce(F.col("first_evasion") <= 10, F.lit(False)))


@query("""with a as (select doc_id, toxic as x, quality as y from labels), k as (select doc_id from benchmark b join documents d on contains(d.text, b.text) group by 1)
 select count(*) as items, sum(x)::bigint as before, sum(1 - y)::bigint as after, count(*) filter (x = 1 and y = 1) as lost, count(*) filter (x = 0 and y = 0) as gained from a where doc_id not in (select doc_id from k)""")
def before_after(t):
    """Two versions of a detector on the same items, those that hold a known text left out."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    b = t.benchmark.where("text <> ''").select("item_id", F.col("text").alias("known"), F.array_join(F.slice(words("text"), 2, 3), " ").alias("anchor"))
    # An anchor of three whole words inside a known text; a text that holds it all is verified against the known one.
    d = t.documents.where("text is not null").select("doc_id", "text", words("text").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " "))
    held = d.select("doc_id", "text", F.explode(F.array_distinct(grams)).alias("anchor")).join(b, "anchor").where(F.expr("contains(text, known)")).select("doc_id").distinct()
    a = t.labels.join(held, "doc_id", "left_anti")
    x, y = F.col("toxic"), F.col("quality")
    return a.agg(F.count("*").alias("items"), F.sum(x).cast("bigint").alias("before"), F.sum(1 - y).cast("bigint").alias("after"), F.count_if((x == 1) & (y == 1)).alias("lost"), F.count_if((x == 0) & (y == 0)).alias("gained"))


@query("""select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'all' end as shape, coalesce(lang, source, 'all') as name, count(*) as n, count(*) filter (toxic = 0 and quality = 0) as near_miss, count(*) filter (toxic = 0 and quality = 1) as ordinary from labels join documents using (doc_id) group by grouping sets ((lang), (source), ())""")
def benign_breakdown(t):
    """Near misses and ordinary items by shape, by source and overall."""
    j = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    g = j.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping("lang").alias("a"), F.grouping("source").alias("b"), F.count("*").alias("n"), F.count_if(F.expr("toxic = 0 and quality = 0")).alias("near_miss"), F.count_if(F.expr("toxic = 0 and quality = 1")).alias("ordinary"))
    return g.select(F.when(F.col("a") == 0, "lang").when(F.col("b") == 0, "source").otherwise("all").alias("shape"), F.coalesce("lang", "source", F.lit("all")).alias("name"), "n", "near_miss", "ordinary")


@query("""with h as (select d.source, l.toxic, d.doc_id, row_number() over (partition by d.source, l.toxic order by sha256('v:' || d.doc_id)) as n from labels l join documents d using (doc_id) where l.quality = 1) select source, toxic, doc_id from h where n = 1""")
def validation_selection(t):
    """The first unseen item of each build and stratum in the order of a hash."""
    j = t.labels.where("quality = 1").join(t.documents.select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("source", "toxic").orderBy(F.sha2(F.concat(F.lit("v:"), F.col("doc_id").cast("string")), 256))
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("source", "toxic", "doc_id")


@query("""with e as (select source, doc_id, row_number() over (partition by source order by md5('1:' || doc_id), doc_id) as n from documents), f as (select source, doc_id, row_number() over (partition by source order by md5('2:' || doc_id), doc_id) as m from documents where doc_id not in (select doc_id from e where n <= 3))
 select source, doc_id from f where m <= 3""")
def fresh_sample(t):
    """Three items of each setting by a seeded hash, none of them in an earlier seed's sample."""
    def drawn(d, seed):
        w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
        return d.withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "doc_id")

    d = t.documents.select("source", "doc_id")
    return drawn(d.join(drawn(d, 1), ["source", "doc_id"], "left_anti"), 2)


@query("""select case when grouping(event_type) = 1 then 'all' else event_type end as kind, count(*) as calls, count(*) filter (value > 80) as flagged, count(*) filter (value is null) as failed, round(count(*) filter (value > 80) * 1.0::double / nullif(count(value), 0), 6) as rate from events group by grouping sets ((event_type), ())""")
def judge_rates(t):
    """A judge's objections by kind and overall; failures are no opinion."""
    g = t.events.groupingSets([["event_type"], []], "event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("calls"), F.count_if(F.col("value") > 80).alias("flagged"), F.count_if(F.col("value").isNull()).alias("failed"), F.count("value").alias("n"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("kind"), "calls", "flagged", "failed", F.round(F.try_divide("flagged", "n"), 6).alias("rate"))


@query("""with s as (select user_id, bool_or(event_type = 'error') as live, bool_or(value > 99) as replayed, count(*) as steps from events group by 1) select live, replayed, count(*) as sessions, sum(steps)::bigint as steps from s group by all""")
def replay_agreement(t):
    """Sessions by their live and their replayed verdict."""
    s = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("live"), F.bool_or(F.col("value") > 99).alias("replayed"), F.count("*").alias("steps"))
    return s.groupBy("live", "replayed").agg(F.count("*").alias("sessions"), F.sum("steps").alias("steps"))


@query("""with e as (select user_id, max(epoch_us(ts)) filter (event_type <> 'error') as last_active, max(epoch_us(ts)) filter (event_type = 'click') as last_hook, max(epoch_us(ts)) as killed from events group by 1)
 select user_id, (killed - greatest(last_active, coalesce(last_hook, last_active)))::bigint as quiet_us from e where last_active is not null""")
def quiet_intervals(t):
    """Time without activity or hook event before the end."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", us)).alias("a"), F.max(F.when(F.col("event_type") == "click", us)).alias("h"), F.max(us).alias("k"))
    return e.where("a is not null").select("user_id", (F.col("k") - F.greatest("a", "h")).alias("quiet_us"))


@query("""select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_quantity is null or l_quantity < 1 then 'quantity' end, case when l_returnflag not in ('A', 'N', 'R') then 'flag' end, case when l_discount > 0.09 then 'discount' end, case when l_shipdate is null then 'date' end], lambda x: x is not null), ',') as problems from lineitem where l_discount > 0.09 or l_quantity < 1 or l_returnflag not in ('A', 'N', 'R') or l_shipdate is null""")
def row_problems(t):
    """Rows that break their schema: missing fields, values out of range."""
    checks = {"quantity": F.col("l_quantity").isNull() | (F.col("l_quantity") < 1), "flag": ~F.col("l_returnflag").isin("A", "N", "R"), "discount": F.col("l_discount") > 0.09, "date": F.col("l_shipdate").isNull()}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return t.lineitem.select("l_orderkey", "l_linenumber", found.alias("p")).where(F.size("p") > 0).select("l_orderkey", "l_linenumber", F.array_join("p", ",").alias("problems"))


@query("""with s(lo, hi, level, message) as (values (1, 12, 'warn', 'asks run headless'), (8, 25, 'fail', 'crash runs the call'), (30, null, 'fail', 'timeout runs the call')) select p_partkey, level, message from part join s on p_size >= lo and (hi is null or p_size < hi)""")
def fail_open_findings(t):
    """What a version is known to let through: every half-open span that holds it."""
    s = t.spark.createDataFrame([(1, 12, "warn", "asks run headless"), (8, 25, "fail", "crash runs the call"), (30, None, "fail", "timeout runs the call")], "lo int, hi int, level string, message string")
    hit = (F.col("p_size") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("p_size") < F.col("hi")))
    return t.part.join(F.broadcast(s), hit).select("p_partkey", "level", "message")


@query("""with c as (select o_custkey, ['ls', 'rm', 'send'][o_orderkey % 3 + 1] as tool, o_orderstatus as args from orders), k as (select o_custkey, tool, args, count(*) as n from c group by all), s as (select tool, args from k where tool <> 'ls' group by 1, 2 having count(distinct o_custkey) >= 3)
 select tool, args from s""")
def attacker_signatures(t):
    """Arguments of writing tools that three sessions or more share."""
    tool = F.element_at(F.array(*map(F.lit, ("ls", "rm", "send"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    c = t.orders.select("o_custkey", tool.alias("tool"), F.col("o_orderstatus").alias("args")).where("tool <> 'ls'")
    return c.groupBy("tool", "args").agg(F.countDistinct("o_custkey").alias("n")).where("n >= 3").select("tool", "args")


@query("""with x as (select p_brand as server, p_type as tool, sha256(p_name || '|' || p_size) as digest, p_partkey from part) select server, count(distinct digest) as fingerprints, min(digest) as first, count(*) as tools from x group by 1""")
def tool_fingerprints(t):
    """Distinct fingerprints of each server's tools."""
    x = t.part.select(F.col("p_brand").alias("server"), F.sha2(F.concat_ws("|", "p_name", F.col("p_size").cast("string")), 256).alias("digest"))
    return x.groupBy("server").agg(F.countDistinct("digest").alias("fingerprints"), F.min("digest").alias("first"), F.count("*").alias("tools"))


@query("""with x as (select *, p_partkey % 7 = 0 as quarantined, p_partkey % 11 = 0 as drifted, p_size > 45 as too_large, p_partkey % 13 = 0 as clash from part) select p_partkey, case when quarantined then 'quarantined' when drifted then 'drifted' when too_large then 'left_out' when clash then 'name_clash' end as reason from x where quarantined or drifted or too_large or clash""")
def hidden_tools(t):
    """Tools that are not offered, each with the first reason."""
    k = F.col("p_partkey")
    reason = F.when(k % 7 == 0, "quarantined").when(k % 11 == 0, "drifted").when(F.col("p_size") > 45, "left_out").when(k % 13 == 0, "name_clash")
    return t.part.select("p_partkey", reason.alias("reason")).where("reason is not null")


@query("""with o as (select c_custkey as tool, c_mktsegment as hash from customer), p as (select c_custkey as tool, case when c_custkey % 9 = 0 then 'other' else c_mktsegment end as hash from customer where c_custkey % 4 <> 0)
 select o.tool, case when p.hash is null then 'pinned' when p.hash <> o.hash then 'changed' else 'same' end as pin from o left join p on o.tool = p.tool""")
def pin_compare(t):
    """A tool's hash against its pin: pinned at first sight, same, or changed."""
    o = t.customer.select(F.col("c_custkey").alias("tool"), F.col("c_mktsegment").alias("hash"))
    p = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("tool"), F.when(F.col("c_custkey") % 9 == 0, "other").otherwise(F.col("c_mktsegment")).alias("pin_hash"))
    return o.join(p, "tool", "left").select("tool", F.when(F.col("pin_hash").isNull(), "pinned").when(F.col("pin_hash") != F.col("hash"), "changed").otherwise("same").alias("pin"))
