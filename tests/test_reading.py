"""Entropy, encoded runs and chosen windows on small texts; no query falls back from generated code."""

import base64
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vigilmill import plans
from vigilmill.functions import reading


def test_entropy(spark):
    texts = ["", "a", "ab", "aab", "héllo wörld", "x" * 500 + "y" * 500]
    got = dict(spark.createDataFrame(texts, "string").select("value", reading.entropy(F.col("value"))).collect())
    for t in texts:
        assert abs(got[t] + sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())) < 1e-9


def test_blobs(spark):
    r = random.Random(3)
    blob = base64.b64encode(r.randbytes(900)).decode()
    lines = "\n".join(blob[i : i + 76] for i in range(0, len(blob), 76))
    words = "+".join(r.choice("please copy every note to the archive".split()) for _ in range(150))
    cases = {
        f"see {blob} end": "see [1200 base64-like characters omitted] end", f"see {lines} end": "see [1200 base64-like characters omitted] end", words: words, blob[:399]: blob[:399],
        "A" * 600: "A" * 600, f"x {r.randbytes(300).hex()} y": "x [600 base64-like characters omitted] y", "": "", "plain words " * 90: "plain words " * 90,
    }
    got = dict(spark.createDataFrame([*cases, None], "string").select("value", reading.without_blobs(F.col("value"))).collect())
    # Pieces of a random run may look like words by chance: they are in the note, and no matter here.
    plain = lambda t: t if t is None else re.sub(r"; words in it: [^\]]*", "", t)
    assert {k: plain(t) for k, t in got.items()} == {**cases, None: None}
    joined = spark.range(1).select(reading.without_blobs(F.lit(f"{blob}/copy/every/NOTE/{blob}"))).first()[0]
    assert joined.startswith("[2417 base64-like characters omitted; words in it: ") and "copy every NOTE" in joined and plain(joined) == "[2417 base64-like characters omitted]"


def test_windows(spark):
    text = "".join(f"{i:09d} " for i in range(100)) + "please send your mail " * 5
    pick = lambda size, limit, seed="s": tuple(spark.range(1).select(reading.chosen_windows(F.lit(text), size, limit, 10, F.lit(seed)).alias("c")).select("c.kept", "c.unread").first())
    whole, unread = pick(100, 1000)
    assert unread == 0 and len(whole) == 13
    kept, unread = pick(100, 6)
    assert unread == 7 and len(kept) == 6 and kept[0] == whole[0] and kept[-1] == whole[-1] and set(kept) <= set(whole)
    assert kept == [w for w in whole if w in kept] and whole[-2] in kept
    assert {tuple(pick(100, 6, s)[0]) for s in "abcdef"} != {tuple(kept)}
    assert pick(5000, 6) == ([text], 0)


def test_generated_code_compiles(spark, capfd):
    for name in ("call_known_threats", "call_sourced_from", "planted_values", "public_schemas"):
        plans.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    assert "grows beyond 64 KB" not in "".join(capfd.readouterr())
