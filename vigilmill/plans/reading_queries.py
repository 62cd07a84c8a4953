"""Encoded runs and budgeted windows of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmill.functions import reading
from vigilmill.plans.registry import query

_CUE = reading.CUE


@query(f"""with p as (select doc_id, list_transform(range(0, greatest(length(text) - 100, 1), 900), lambda i: text[i + 1:i + 1000]) as ws from documents where text is not null),
 x as (select doc_id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from p), r as (select *, row_number() over (partition by doc_id order by len(regexp_extract_all(regexp_replace(w, '[^\\x00-\\x7F]', 'x', 'g'), '{_CUE}')) desc, i) as cue_rank from x where i > 0 and i < n - 1),
 q as (select *, row_number() over (partition by doc_id order by md5(doc_id || ':' || i)) as pick from r where cue_rank > 2), k as (select doc_id, i, w from x where n <= 6 or i = 0 or i = n - 1 union all select doc_id, i, w from r where n > 6 and cue_rank <= 2 union all select doc_id, i, w from q where n > 6 and pick <= 2)
 select doc_id, md5(string_agg(w, '|' order by i)) as kept, count(*)::int as windows, (greatest(max(n) - 6, 0))::int as unread from k join (select doc_id, len(ws) as n from p) using (doc_id) group by 1""")
def chosen_windows(t):
    """At most six windows of every text: its ends, those that look most like a request, and some by a seeded hash."""
    c = reading.chosen_windows(F.col("text"), 1000, 6, 100, F.col("doc_id").cast("string"))
    found = t.documents.where("text is not null").select("doc_id", c.alias("c"))
    return found.select("doc_id", F.md5(F.array_join("c.kept", "|").cast("binary")).alias("kept"), F.size("c.kept").alias("windows"), "c.unread")


@query("""select doc_id, text || chr(10) || '. ' || case doc_id % 3 when 0 then '[512 base64-like characters omitted]' when 1 then repeat('abcd', 128) else '[640 base64-like characters omitted; words in it: copy]' end || ' .' as read from documents where text is not null""")
def without_blobs(t):
    """Every text with a run behind it: hexadecimal and encoded runs become a note, plain letters stay."""
    digest = lambda k: F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f":{k}")), 256)
    hexed = F.concat(*[digest(k) for k in range(8)])
    alphabets = ("ABCDEFGHIJKLMNOP", "QRSTUVWXYZabcdef", "ghijklmnopqrstuv", "wxyz0123456789AB")
    mixed = F.concat(*[F.translate(digest(k), "0123456789abcdef", alphabets[k % 4]) for k in range(9)])
    run = F.when(F.col("doc_id") % 3 == 0, hexed).when(F.col("doc_id") % 3 == 1, F.repeat(F.lit("abcd"), F.lit(128))).otherwise(F.concat(mixed, F.lit("+copy+"), F.left(digest(99), F.lit(58))))
    said = F.concat("text", F.lit("\n. "), run, F.lit(" ."))
    return t.documents.where("text is not null").select("doc_id", reading.without_blobs(said).alias("read"))
