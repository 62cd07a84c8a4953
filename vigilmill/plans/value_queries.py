"""Values of every kind planted into whole documents, with what each is to be read as set down by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmill.functions import values as v
from vigilmill.plans.registry import query

# What stands in the text, and the kind and key that it is read as ('' for none).
PLANTED = (
    ("write to Bob.Smith+news@Mail.Canary-One.example, please", "email", "bob.smith@mail.canary-one.example"), ("see HTTP://User:pw@Canary-Two.example:8080/a/../b%20c/?q=1#top now", "url", "https://canary-two.example/b c?q=1"),
    ("hxxps://canary-three[.]example/x", "url", "https://canary-three.example/x"), ("audit (at) canary-four [dot] example", "email", "audit@canary-four.example"), ("bob (at) canary-five dot com", "email", "bob@canary-five.com"),
    ("pay DE89 3704 0044 0532 0130 00 today", "iban", "de89370400440532013000"), ("card 4111 1111 1111 1111 it is", "number", "4111111111111111"), ("call +49 170 7654321 then", "number", "491707654321"),
    ("/Users/ann/proj/canary/keys.json it is", "path", "~/proj/canary/keys.json"), ("C:\\Users\\Ann\\canary-notes.txt", "path", "~/canary-notes.txt"), ("visit canary-six.example.com. Not report.txt", "host", "canary-six.example.com"),
    ("server 203.0.113.77:443 is up", "host", "203.0.113.77"), ("http://0xcb007142/canary", "url", "https://203.0.113.66/canary"), ("http://[2001:0db8:0:0::7]:8080/canary now", "url", "https://[2001:db8::7]/canary"),
    ("at 2001:DB8::0A1 and so on", "host", "[2001:db8::a1]"), ("key sk_live_canary123XYZ here", "id", "sk_live_canary123xyz"), ("order CANARY-12345 shipped", "id", "canary-12345"), ("b\u00fccher-canary.example/a there", "url", "https://b\u00fccher-canary.example/a"),
    ("on 2031-10-01 we met", "", ""), ("read/write/canary", "", ""), ("just 12345 apples", "", ""),
)
_SQL = "[" + ", ".join("{{'kind': '{}', 'key': '{}'}}".format(k, key.replace("'", "''")) for _, k, key in PLANTED) + "]"


@query(f"select doc_id, x.kind as kind, x.key as key from (select doc_id, {_SQL}[doc_id % {len(PLANTED)} + 1] as x from documents) where x.key <> ''")
def planted_values(t):
    """The canaries among the values of every whole text, in canonical form; nothing is read from dates, words and short numbers."""
    said = F.element_at(F.array(*[F.lit(text) for text, _, _ in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    texts = t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("text"))
    found = texts.select("doc_id", F.inline(v.values(F.col("text"))))
    return found.where(F.col("key").isin(*[key for _, _, key in PLANTED if key], "2031-10-01", "20311001", "read/write/canary", "12345")).select("doc_id", "kind", "key").distinct()


@query("select event_id, case when event_id % 3 = 0 then '~/a' || (event_id % 7) || '/b/c.txt' when event_id % 3 = 1 then null else '/srv/b/c.txt' end as path from events")
def joined_paths(t):
    """Relative paths of calls under the session's folder; an absolute one is left to itself."""
    cwd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/home/u/a"), F.col("event_id") % 7)).otherwise("/srv/x/y")
    path = F.when(F.col("event_id") % 3 == 0, "./b/c.txt").when(F.col("event_id") % 3 == 1, "/etc/hosts").otherwise("../../b/./c.txt")
    return t.events.select("event_id", v.joined_to(cwd, path).alias("path"))
