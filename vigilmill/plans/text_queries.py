"""Text, value and similarity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions import text as tx
from vigilmill.functions import values as va
from vigilmill.operators import similarity as sim
from vigilmill.plans.registry import query

_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_MASKED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\x00-\x20\x22<>]+', ' xurl ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', ' xemail ', 'g'), '(?:~|\.{1,2})?(?:/[\w.-]+){2,}/?', ' xpath ', 'g'), '\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[A-Za-z]{1,8}-[0-9]{4,}|[0-9]{9,})\b', ' xid ', 'g')"
#: The content words of `text` in DuckDB's SQL.
TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower({_MASKED}), '[a-z]+'), lambda w: len(w) >= 2 and not list_contains({_STOPS}, w)),
 lambda w: case when len(w) > 5 and w like '%ing' then left(w, len(w) - 3) when len(w) > 3 and w like '%s' and w not like '%ss' then left(w, len(w) - 1) else w end)"""

_GRAMS = """
    w as (select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[a-z]+') as ws from documents where text is not null
          union all select 'b', item_id, regexp_extract_all(lower(text), '[a-z]+') from benchmark where text is not null),
    g as (select distinct side, id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as gram from w),
    hits as (select b.id as print_id, d.id as text_id, count(*) as n from g b join g d on b.gram = d.gram and b.side = 'b' and d.side = 'd' group by 1, 2),
    sizes as (select id, count(*) as n from g where side = 'b' group by 1),
    found as (select print_id, text_id, h.n * 1.0::double / s.n as score from hits h join sizes s on print_id = id where h.n * 1.0::double / s.n >= 0.6)
"""


def _found(t):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    prints = t.benchmark.where("text is not null").select(F.col("item_id").alias("print_id"), words("text").alias("words"))
    texts = t.documents.where("text is not null").select(F.col("doc_id").alias("text_id"), words("text").alias("words"))
    return sim.contained(prints, texts)


@query(f"with {_GRAMS} select print_id, text_id, round(score, 6) as score from found")
def fingerprint_hits(t):
    """Documents that hold a known text's 3-grams to 0.6 or more."""
    return _found(t).select("print_id", "text_id", F.round("score", 6).alias("score"))


@query(f"with {_GRAMS} select source, count(distinct text_id) as documents, count(distinct print_id) as prints, count(distinct text_id) >= 2 as hostile from found join documents on text_id = doc_id group by 1")
def hostile_sources(t):
    """Sources by the documents in which a known text was found."""
    hits = _found(t).join(t.documents.select("doc_id", "source"), F.col("text_id") == F.col("doc_id"))
    out = hits.groupBy("source").agg(F.countDistinct("text_id").alias("documents"), F.countDistinct("print_id").alias("prints"))
    return out.withColumn("hostile", F.col("documents") >= 2)


@query(f"with {_GRAMS} select item_id, text from benchmark where item_id not in (select print_id from found) and len(regexp_extract_all(lower(text), '[a-z]+')) >= 8")
def gate_kept(t):
    """Candidate texts that no document contains and that have 8 words or more."""
    long = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))) >= 8
    return t.benchmark.where(long).join(_found(t), F.col("item_id") == F.col("print_id"), "left_anti").select("item_id", "text")


@query(f"select doc_id, len({TOKENS})::bigint as tokens from documents where text is not null")
def content_token_counts(t):
    return t.documents.where("text is not null").select("doc_id", F.size(tx.content_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query(r"select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) as value from documents")
def value_extract_email(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.EMAIL), F.lit(0))).alias("value"))


@query(r"select doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) as value from documents")
def value_extract_ipv4(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.IPV4), F.lit(0))).alias("value"))


@query("select doc_id, unnest(regexp_extract_all(text, '[0-9]{9,}')) as value from documents")
def value_extract_number(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.LONG_NUMBER), F.lit(0))).alias("value"))


@query("""select doc_id, regexp_extract(text, '([a-z_]+) ?= ?"([0-9a-f]{16,})"', 1) as name, left(sha256(regexp_extract(text, '([a-z_]+) ?= ?"([0-9a-f]{16,})"', 2)), 12) as mark from documents where regexp_matches(text, '([a-z_]+) ?= ?"([0-9a-f]{16,})"')""")
def credential_like_tokens(t):
    """Assignments of long hexadecimal secrets, shown by name and a short hash."""
    pattern = '([a-z_]+) ?= ?"([0-9a-f]{16,})"'
    d = t.documents.where(F.col("text").rlike(pattern))
    return d.select("doc_id", F.regexp_extract("text", pattern, 1).alias("name"), F.left(F.sha2(F.regexp_extract("text", pattern, 2), 256), F.lit(12)).alias("mark"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\x00-\x20\x22<>]+', '<url>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '<ip>', 'g'), '[0-9]{9,}', '<number>', 'g') as masked from documents")
def masked_excerpt(t):
    return t.documents.select("doc_id", tx.masked(F.col("text")).alias("masked"))


@query("select page_id, 'https://' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^(https?|wss?)://', ''), '#.*$', ''), '^[^/?@]*@', ''), '^([^/?:]+):[0-9]+', '\\1'), '/+$', '') as key from pages where url is not null")
def url_canonical(t):
    return t.pages.where("url is not null").select("page_id", va.url_key(F.col("url")).alias("key"))


@query("""with h as (select page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) as host from pages where url is not null),
 s as (select page_id, string_split(host, '.') as l from h)
 select suffix, count(*) as pages from (select page_id, unnest(case when len(l) < 2 then [array_to_string(l, '.')] else list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) end) as suffix from s) group by 1""")
def host_suffix_pages(t):
    """Pages under each host and parent domain."""
    host = F.regexp_extract(F.lower("url"), "^https?://([^/?#:]+)", 1)
    return t.pages.where("url is not null").select(F.explode(va.host_suffixes(host)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("pages"))


@query("select page_id, length(regexp_replace(regexp_replace(html, '<!--[^>]*-->', '', 'g'), '<[^>]*>', ' ', 'g'))::bigint as n from pages where html is not null")
def markup_strip(t):
    plain = F.regexp_replace(F.regexp_replace("html", "<!--[^>]*-->", ""), "<[^>]*>", " ")
    return t.pages.where("html is not null").select("page_id", F.length(plain).cast("bigint").alias("n"))


@query("""with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') as ss from documents where text is not null)
 select doc_id, len(ss)::bigint as sentences, list_max(list_transform(ss, lambda x: len(x)))::bigint as longest from s""")
def sentence_spans(t):
    s = t.documents.where("text is not null").select("doc_id", tx.sentences(F.col("text")).alias("ss"))
    return s.select("doc_id", F.size("ss").cast("bigint").alias("sentences"), F.array_max(F.transform("ss", F.length)).cast("bigint").alias("longest"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') as ws from documents where text is not null),
 c as (select doc_id, ws, unnest(range(0, 1 + greatest(0, least(31, ceil((len(ws) - 48) / 32.0)::int)))) as chunk from w)
 select doc_id, chunk::int as chunk, array_to_string(ws[chunk * 32 + 1 : chunk * 32 + 48], ' ') as words from c""")
def word_chunks(t):
    return t.documents.where("text is not null").select("doc_id", F.posexplode(tx.word_chunks(F.col("text"))).alias("chunk", "words"))


@query("""with w as (select doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1000) / 984.0)::int))) as i from documents where text is not null)
 select doc_id, i::int as i, md5(substring(text, (i * 984 + 1)::int, 1000)) as digest from w""")
def char_windows(t):
    w = t.documents.where("text is not null").select("doc_id", F.posexplode(tx.char_windows(F.col("text"))).alias("i", "x"))
    return w.select("doc_id", "i", F.md5("x").alias("digest"))


@query("""with t as (select doc_id as id, regexp_extract_all(lower(text), '[a-z]+') as terms from documents where text is not null),
 s as (select count(*) as n, avg(len(terms)) as mean from t),
 tf as (select id, len, term, count(*) as tf from (select id, len(terms) as len, unnest(terms) as term from t) where term in ('idiot', 'trash', 'license', 'apache') group by 1, 2, 3),
 df as (select term, count(*) as df from tf group by 1)
 select id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) as score from tf join df using (term) cross join s group by 1 order by score desc, id limit 5""")
def bm25_top5(t):
    docs = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))
    scored = sim.bm25(docs, ["idiot", "trash", "license", "apache"]).select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(5)


_KNN = """
 v as (select vec_id, embedding::double[] as e, label from embeddings),
 s as (select q.vec_id as qid, i.vec_id as iid, i.label, round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 6) as sim from v q join v i on q.vec_id <> i.vec_id where q.vec_id % 50 = 0),
 r as (select *, row_number() over (partition by qid order by sim desc, iid) as rank from s)
"""


def _neighbours(t, k):
    v = t.embeddings
    return sim.nearest(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), v.select(F.col("vec_id").alias("iid"), F.col("embedding").alias("iv"), "label"), k)


@query(f"with {_KNN} select qid, iid, label, sim, rank::int as rank from r where rank <= 15")
def knn_top_k(t):
    """15 nearest vectors of each query vector (ids divisible by 50)."""
    return _neighbours(t, 15)


@query(f"""with {_KNN}, c as (select count(*) filter (label = 0) as p, count(*) filter (label <> 0) as n from embeddings)
 select qid, round(sum(case when label = 0 then greatest(sim, 0.0) else 0.0 end) / any_value(p) / (sum(case when label = 0 then greatest(sim, 0.0) else 0.0 end) / any_value(p) + sum(case when label <> 0 then greatest(sim, 0.0) else 0.0 end) / any_value(n)), 4) as vote from r cross join c where rank <= 30 group by qid""")
def knn_vote(t):
    """Class-balanced vote of the 30 nearest."""
    n = t.embeddings.agg(F.count_if(F.col("label") == 0).alias("p"), F.count_if(F.col("label") != 0).alias("n")).first()
    return sim.balanced_vote(_neighbours(t, 30), n["p"], n["n"]).select("qid", F.round("vote", 4).alias("vote"))


@query(f"with {_KNN} select qid, max(sim) >= 0.92 as repeated from r where rank = 1 group by qid")
def near_duplicate_vectors(t):
    """Whether a query vector has another within cosine 0.92."""
    return _neighbours(t, 1).select("qid", (F.col("sim") >= 0.92).alias("repeated"))


@query("""with s as (select c.conv_id, c.turn, unnest(list_distinct(regexp_extract_all(lower(c.text), '[a-z]{6,}'))) as value, c.role from conversations c where text is not null)
 select a.conv_id, a.turn, count(distinct a.value) as sourced from s a where a.role = 'user' and exists (select 1 from s b where b.conv_id = a.conv_id and b.turn < a.turn and b.value = a.value and b.role = 'assistant') group by 1, 2""")
def sourced_from_prior_turns(t):
    """As-of provenance: values of a user's turn that an earlier answer of the conversation already held."""
    s = t.conversations.where("text is not null").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("value"))
    first = s.where("role = 'assistant'").groupBy("conv_id", "value").agg(F.min("turn").alias("seen"))
    return s.where("role = 'user'").join(first, ["conv_id", "value"]).where("seen < turn").groupBy("conv_id", "turn").agg(F.countDistinct("value").alias("sourced"))


@query("select text, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def near_duplicate_texts(t):
    """Texts seen more than once, with their first id."""
    return t.documents.where("text is not null").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""with r as (select doc_id, len(regexp_extract_all(lower(text), 'licen[sc]ed?')) as licence, len(regexp_extract_all(text, '[A-Z]{2,}!!')) as shout, len(regexp_extract_all(lower(text), 'token|secret|password')) as secret from documents where text is not null),
 h as (select doc_id, (licence > 0)::int + (shout > 0)::int + (secret > 0)::int as hits, array_to_string(list_filter([case when licence > 0 then 'licence' end, case when secret > 0 then 'secret' end, case when shout > 0 then 'shout' end], lambda x: x is not null), ',') as rules from r)
 select doc_id, rules, round(case when hits = 0 then 0.02 else least(0.99, 0.52 + 0.23 * hits) end, 6) as score from h""")
def rule_scan_keywords(t):
    """Named rules over a text and the score of their number."""
    from vigilmill.operators.decisions import detection_score

    rules = {"licence": F.lower("text").rlike("licen[sc]ed?"), "secret": F.lower("text").rlike("token|secret|password"), "shout": F.col("text").rlike("[A-Z]{2,}!!")}
    d = t.documents.where("text is not null").withColumn("hit", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return d.select("doc_id", F.array_join("hit", ",").alias("rules"), F.round(detection_score(F.size("hit")), 6).alias("score"))


@query("""select doc_id, case when length(text) > 2000 then left(text, 1000) || chr(10) || right(text, 1000) else text end as seen from documents where text is not null""")
def head_tail_window(t):
    return t.documents.where("text is not null").select("doc_id", tx.head_and_tail(F.col("text"), 2000).alias("seen"))


@query("""with x as (select source, doc_id, row_number() over (partition by source order by md5('7:' || doc_id), doc_id) as n from documents) select source, doc_id from x where n <= 5""")
def stratified_sample(t):
    """Five documents of each source in the order of a seeded hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return t.documents.withColumn("n", F.row_number().over(w)).where("n <= 5").select("source", "doc_id")


@query(r"""with k as (select doc_id, list_filter([case when regexp_matches(text, '(?i)\b(?:password|passwd|secret|token|api_?key) ?[=:] ?"?[0-9a-z]{16,}"?') then 'assignment' end, case when regexp_matches(text, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b') then 'aws_key' end], lambda x: x is not null) as kinds from documents where text is not null)
 select doc_id, array_to_string(kinds, ',') as kinds from k where len(kinds) > 0""")
def credential_kinds(t):
    """Documents with a credential of a known format."""
    from vigilmill.functions.credentials import credential_kinds as kinds

    return t.documents.where("text is not null").select("doc_id", F.array_join(kinds(F.col("text")), ",").alias("kinds")).where("kinds <> ''")


@query()
def readable_views(t):
    """Documents whose readable view differs from the text, with its length."""
    from vigilmill.functions.normalize import readable_view

    d = t.documents.where("text is not null").select("doc_id", "text", readable_view(F.col("text")).alias("view"))
    return d.where("view <> text").select("doc_id", F.length("view").alias("n"))
