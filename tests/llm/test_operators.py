"""Every operator against a brute-force version, and on corner cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilmill.llm import blocks, language_id, licenses, line_dedup, mixing, order_minhash, packing, queries, simhash_dedup, tiff, tokens, toxicity
from vigilmill.llm.components import components

SF = "/root/testdata/sf0.001"


#: Not of one row a document: they have corner cases of their own.
OTHERS = ("op11_conversation_repair", "op12_source_divergence")


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in OTHERS])
def test_corner_cases_run_whole(spark, corner_dir, empty_dir, name):
    rows = queries.QUERIES[name](spark, corner_dir).collect()
    ids = Counter(r["doc_id"] for r in rows)
    if name == "op8_packing":
        assert set(ids) == {None, *range(1, 13)}
    else:
        assert ids == Counter([None, *range(1, 13), 6])
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


# 1
def test_tiff_codecs_round_trip():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 600, 9000):
        for data in (r.randbytes(n), bytes(r.choice(b"ab") for _ in range(n)), b"\x07" * n):
            assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
            assert tiff.unpack_bits(tiff.pack_bits(data)) == data


@pytest.mark.parametrize("form", [*tiff.FORMS, (tiff.NONE, 2, False)])
def test_tiff_pages(form):
    pages = [np.frombuffer(random.Random(h).randbytes(h * 100), np.uint8).reshape(h, 100) for h in (1, 16, 45)]
    data = tiff.write_tiff(pages, *form)
    found = [tiff.read_page(data, t)[:, :, 0] for t in tiff.directories(data)]
    assert len(found) == 3 and all((a == b).all() for a, b in zip(found, pages))


def test_tiff_damaged(spark):
    good = tiff.store(b"abc" * 192)
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    files = [None, b"", b"II*\0", good[:40], bytes(loop), good]
    df = spark.createDataFrame([(i, bytearray(f) if f is not None else None) for i, f in enumerate(files)], "id int, media binary")
    got = {r["id"]: (len(r["pages"]), r["error"]) for r in tiff.decode_pages(df).collect()}
    assert got[5] == (1, None) and all(got[i][0] == 0 and got[i][1] for i in range(5))
    assert tiff.page_rows(df).count() == 1


def _foreign_tiff(pages, order):
    """A file as another writer may make it: its own order of parts, SHORT values, RGB, several strips, LZW by a plain code table."""
    import struct

    def lzw(data):
        bits, table, word, width = [], {bytes((i,)): i for i in range(256)}, b"", 9
        put = lambda v: bits.append(format(v, f"0{width}b"))
        put(256)
        n = 258
        for i in range(len(data)):
            longer = word + data[i : i + 1]
            if longer in table:
                word = longer
                continue
            put(table[word])
            table[longer] = n
            n += 1
            width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
            word = data[i : i + 1]
            assert n < 4000, "short pages alone"
        put(table[word])
        n += 1
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        put(257)
        text = "".join(bits)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")

    p = {"<": b"II", ">": b"MM"}[order]
    out = bytearray(p + struct.pack(order + "HI", 42, 0))
    link = 4
    for a in pages:
        h, w, n = a.shape
        rows = max(1, h // 2)
        blocks = [lzw(a[y : y + rows].tobytes()) for y in range(0, h, rows)]
        struct.pack_into(order + "I", out, link, len(out))
        at = len(out) + 2 + 12 * 9 + 4
        tags = [(256, 3, w), (257, 3, h), (258, 3, [8] * n), (259, 3, 5), (262, 3, 2 if n == 3 else 1), (273, 4, None), (277, 3, n), (278, 3, rows), (279, 4, None)]
        extra, offsets, data = b"", [], b""
        bits_at = at
        if n > 2:
            extra += struct.pack(f"{order}{n}H", *[8] * n)
        table_at = at + len(extra)
        k = len(blocks)
        data_at = table_at + (8 * k if k > 1 else 0)
        for b in blocks:
            offsets.append(data_at + len(data))
            data += b
        sizes = [len(b) for b in blocks]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            if tag == 258 and n > 2:
                out += struct.pack(order + "HHII", tag, kind, n, bits_at)
            elif tag in (273, 279):
                values = offsets if tag == 273 else sizes
                out += struct.pack(order + "HHI", tag, 4, k) + struct.pack(order + "I", values[0] if k == 1 else table_at + (4 * k if tag == 279 else 0))
            else:
                out += struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + "HH", value if not isinstance(value, list) else 8, 0)
        link = len(out)
        out += struct.pack(order + "I", 0) + extra
        if k > 1:
            out += struct.pack(f"{order}{k}I", *offsets) + struct.pack(f"{order}{k}I", *sizes)
        out += data
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_another_writer(order):
    r = random.Random(9)
    pages = [np.frombuffer(r.randbytes(12 * 10 * 3), np.uint8).reshape(12, 10, 3), np.full((5, 40, 1), 7, np.uint8), np.frombuffer(bytes(range(250)) * 2, np.uint8).reshape(10, 50, 1)]
    data = _foreign_tiff(pages, order)
    found = [tiff.read_page(data, t) for t in tiff.directories(data)]
    assert len(found) == 3 and all(a.shape == b.shape and (a == b).all() for a, b in zip(found, pages))


def test_tiff_lzw_known_codes():
    """The format's own example: bytes 7 7 7 8 8 7 7 6 6 are codes 256 7 258 8 8 258 6 6 257 of nine bits."""
    bits = "".join(format(c, "09b") for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    bits += "0" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert tiff.unpack_lzw(data) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and tiff.pack_lzw(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == data
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_tiff_fuzz(spark):
    """Files with any bytes changed, sizes of zero and sizes beyond reason: pages or an error, never a crash; clashing names pass."""
    import struct

    r = random.Random(10)
    good = [tiff.store(r.randbytes(576 * 5)), tiff.store(b"abc" * 192 * 40)]
    files = []
    for _ in range(300):
        f = bytearray(r.choice(good))
        for _ in range(r.randint(1, 6)):
            f[r.randrange(len(f))] = r.choice([0, 255, r.randrange(256)])
        files.append(f)
    for f in good:
        at = struct.unpack_from("<I", f, 4)[0]
        n = struct.unpack_from("<H", f, at)[0]
        for k in range(n):
            for v in (0, 1, 0x7FFFFFFF, 0xFFFFFFFF):
                g = bytearray(f)
                struct.pack_into("<I", g, at + 2 + 12 * k + 8, v)
                files.append(g)
    df = spark.createDataFrame([(i, bytes(f), "p", 7, 8) for i, f in enumerate(files)], "id int, media binary, pages string, error int, width int")
    read = tiff.decode_pages(df)
    assert read.columns == ["id", "media", "pages", "error", "width", "_pages", "_error"]
    assert all((r["_error"] is None) == (len(r["_pages"]) > 0) and r["pages"] == "p" and r["error"] == 7 for r in read.collect())
    rows = tiff.page_rows(df)
    assert rows.columns[:4] == ["id", "pages", "error", "width"] and rows.columns[5] == "_width" and {r["width"] for r in rows.collect()} == {8}


def test_tiff_long_text(spark):
    """20 MB in one text, within a minute."""
    import time

    text = "".join(random.Random(11).choices("abcdefgh \n", k=20_000)) * 1000
    began = time.time()
    r = tiff.text_media(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    data = text.encode() + b"\xff" * (-len(text) % 576)
    assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and time.time() - began < 90


def test_tiff_query_brute(spark, sample_docs):
    got = {r["doc_id"]: r for r in queries.op1_tiff(spark, SF).collect()}
    for r in sample_docs.collect():
        raw = (r["text"] or "").encode()
        data = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        stored = tiff.store(data)
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


# 2
def test_toxicity_folding_and_exceptions():
    m = toxicity.seed_model()
    hot = [toxicity.score(t, m) for t in ("you 1d1ot", "you IDIOT", "you іdіоt", "you ｉｄｉｏｔ", "you id­iot", "m0r0n", "you id!ot")]
    cold = [toxicity.score(t, m) for t in ("", None, "a calm day", "put it in the trash can", "idiotic is another word", "101 and 7")]
    assert min(hot) > max(cold) and all(0 <= s <= 1 for s in hot + cold)


def test_toxicity_spellings():
    m = toxicity.seed_model()
    clean = toxicity.score("a calm day", m)
    for t in ("“idiot”", "„idiot“", "you—idiot—go", "idiot…", "stüpid", "stu\u0308pid", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "i.d.i.o.t", "such an i d i o t", "i-d-i-o-t", "ıdıot", "(idiot)", "ｌｏｓｅｒ"):
        assert toxicity.score(t, m) > clean + 0.1, t
    for t in ("U.S.A. is", "v1.2.3.4", "a b c d", "“calm”", "idi ot"):
        assert toxicity.score(t, m) <= clean + 1e-9, t


def _strength_brute(text, model):
    """Entries sought one by one at every place of the folded text."""
    folded, best, spared = toxicity.fold(text), {}, set()
    for p, w in model.entries:
        for at in range(len(folded)):
            if folded.startswith(p, at):
                best[at] = max(w, best.get(at, 0))
    for p in model.exceptions:
        for at in range(len(folded)):
            if folded.startswith(p, at):
                spared.update(range(at, at + len(p) - 1))
    kept = {a: w for a, w in best.items() if a not in spared}
    words = max(0, len(folded.split(" ")) - 2)
    return sum(kept.values()) / (1 + np.log1p(words / 200)) if kept else 0.0, len(kept)


def test_toxicity_brute(spark):
    r = random.Random(12)
    model = toxicity.Model((*toxicity.seed_model().entries, (" stu", 1.5), (" tra", 0.5), (" stupid ", 4.0)))
    pool = "idiot 1d1ot stupid stupidly trash trash can tra loser sore loser bracket river stone stüpid “scum” clown".split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for x in toxicity.score_documents(docs, model).collect():
        s, n = _strength_brute(x["text"], model)
        assert x["__matches"] == n and abs(x["__score"] - toxicity._curve(s, model)) < 1e-12


def test_sample_never_rounds_to_nothing(spark):
    """At 1e11 and 1e15 rows the rate is still what it should be."""
    from vigilmill.llm.common import sampled

    h = F.xxhash64("id")
    df = spark.range(200_000)
    n = df.where(sampled(h, 10**6 // 2, 10**7)).count()
    assert abs(n - 10_000) < 600
    for total in (10**11, 10**15):
        below = 2**63 * 4000 // total
        assert below > 0 and spark.sql(f"select {below - 1}L as x").where(F.col("x") < F.lit(2**63 * 4000 // total)).count() == 1
        assert df.where(sampled(F.lit(0).cast("bigint"), 4000, total)).count() == 200_000


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    wrong_alarm = sum(r["predicted"] for r in got if not r["toxic"]) / sum(not r["toxic"] for r in got)
    missed = sum(not r["predicted"] for r in got if r["toxic"]) / sum(bool(r["toxic"]) for r in got)
    assert wrong_alarm < 0.05 and missed < 0.5


def test_toxicity_without_labels(spark, corners, labels):
    assert toxicity.fit(corners, labels.limit(0)) == toxicity.seed_model()


# 3
def test_licenses_brute(spark, corners, sample_docs):
    docs = sample_docs.select("doc_id", "text").unionByName(corners.where("doc_id is not null").select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append(r)
    for doc_id, text in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        starts = [(i, n) for p, n in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        for r in got[doc_id]:
            assert (r["n_words"], r["n_base"]) == (len(words), len(starts))
            assert (r["first_word"], r["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
            assert r["base_labels"] == ",".join(sorted({n for _, n in starts}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def _licences_brute(text, idf):
    """Labels by licence: every start of every clause is tried, not only the proposed ones."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    held = " " + " ".join(words) + " "
    found = {}
    for label, licence, keys in licenses.TEMPLATES:
        parts = licenses.clauses(licence)
        total = got = 0.0
        for c in parts:
            whole = sum(idf[w] for w in c)
            total += whole
            rare = licenses.rarest(c, idf, licenses.KEYS)
            for s in range(len(words)):
                there = words[s : s + len(c)] + [None] * len(c)
                hits = [a == b for a, b in zip(c, there)]
                if sum(w in rare and h for w, h in zip(c, hits)) >= min(licenses.AGREE, len(rare)) and sum(idf[w] for w, h in zip(c, hits) if h) >= licenses.IN_PLACE * whole:
                    got += whole
                    break
        if got / total >= licenses.LEAST and all(f" {k} " in held for k in keys):
            found[label] = got / total
    return found


def test_license_templates(spark):
    """Whole texts, texts with a word more, notices cut short, and texts without licences, against all starts of all clauses."""
    r = random.Random(8)
    texts = ["xx yy " + t + " zz" for _, t, _ in licenses.TEMPLATES]
    whole = len(texts)
    for _, t, _ in licenses.TEMPLATES:
        ws = t.split()
        at = r.randrange(len(ws))
        texts.append(" ".join(ws[:at] + ["really"] + ws[at:]))
        texts.append(" ".join(ws[: len(ws) // 2]))
        texts.append(" ".join(w if r.random() > 0.15 else "other" for w in ws))
    texts.append("the software is free and any person may use the license as is without copyright notice " * 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocabulary = sorted({w for _, t, ks in licenses.TEMPLATES for x in (t, *ks) for w in licenses._words(x)})
    idf = licenses.rarity(docs, vocabulary)
    base = {n: p for p, n in licenses.PHRASES}
    for x in licenses.scan(docs).collect():
        brute = _licences_brute(texts[x["doc_id"]], idf)
        labels = set(filter(None, x["labels"].split(",")))
        assert labels - set(x["base_labels"].split(",")) == set(brute) - set(x["base_labels"].split(","))
        if not x["n_base"]:
            assert abs(x["score"] - max(brute.values(), default=0.0)) < 1e-9
        if x["doc_id"] < whole:
            assert licenses.TEMPLATES[x["doc_id"]][0] in labels
    assert set(base) == {"gpl", "apache", "cc-by", "mit"}


def test_license_long_text(spark):
    """A text of 20 MB of licence words, none of them in place."""
    import time

    docs = spark.createDataFrame([(1, "the license software without copyright notice permission " * 350_000)], "doc_id bigint, text string")
    began = time.time()
    r = licenses.scan(docs).first()
    assert (r["n_words"], r["n_base"]) == (2_450_000, 0) and time.time() - began < 120


# 4
def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_language_scores_brute(spark):
    """Filters applied byte by byte, over windows cut one by one."""
    r = np.random.default_rng(3)
    net = language_id.Network(("aa", "bb"), tuple(r.standard_normal((w, 256, 4)).astype(np.float32) for w in (2, 3)), r.standard_normal(8).astype(np.float32), r.standard_normal((8, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = ["one window", "x" * 256, "ab " * 300, "é" * 200, "", None, "12 34"]
    got = {x["doc_id"]: x for x in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), net).collect()}
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        raw, total = t.encode(), np.zeros(2)
        for lo in range(0, len(raw), 256):
            w = raw[lo : lo + 256]
            padded = w + bytes(256 - len(w))
            x = [max(sum(float(table[k][padded[p + k]][f]) for k in range(len(table))) for p in range(256 - len(table) + 1)) for table in net.tables for f in range(4)]
            z = np.maximum(np.array(x) + net.bias, 0) @ net.out
            total += (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * len(w)
        p = np.exp(total / len(raw))
        p /= p.sum()
        assert got[i]["lang_pred"] == net.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-3


def test_rare_language_is_learned(spark, sample_docs):
    """A language of three rows among many is a class of the model."""
    rare = spark.createDataFrame([(10_000 + i, f"zzq wqx vvk {i}", "xx") for i in range(3)], "doc_id bigint, text string, lang string")
    net = language_id.fit(sample_docs.select("doc_id", "text", "lang").unionByName(rare), F.lit(True), sample_rows=40)
    assert "xx" in net.languages and len(net.languages) > 3


def test_language_undecided(spark, corner_dir):
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op4_language_id(spark, corner_dir).collect()}
    assert {i for i, p in got.items() if p == "und"} == {2, 3, 4, 10}


# 5
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_edit_distance():
    r = random.Random(2)
    for _ in range(600):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        d, most = _distance(a, b), r.randint(0, 12)
        assert line_dedup.edit_distance(a, b, most) == min(d, most + 1)


def test_line_simhash_plain():
    lines = [b"a", b"the the stone", b"river 00 stone of the"]
    whole = line_dedup.simhashes(lines)
    assert [int(line_dedup.simhashes([x])[0]) for x in lines] == whole.tolist()


def _lines_brute(rows, radius=None):
    """Occurrences removed, by all pairs of edit similarity 0.9; with `radius` only pairs that share a block and lie within it."""
    forms, places = {}, defaultdict(list)
    for doc_id, text in rows:
        for n, x in enumerate(line_dedup.plain_lines(text)):
            if x:
                codes, keys = line_dedup.codes_and_blocks(line_dedup.code_lines([x]))
                forms[x] = int(codes[0]), {int(k) for k in keys[0] if k}
                places[x].append((doc_id, n))
    names = list(forms)
    links = blocks.Links(len(names))
    for i in range(len(names)):
        for j in range(i):
            (c, p), (d, q) = forms[names[i]], forms[names[j]]
            if radius is None or (p & q and (c ^ d).bit_count() <= radius):
                a, b = names[i].decode(), names[j].decode()
                if _distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
                    links.join(i, j)
    groups = defaultdict(list)
    for i, x in enumerate(names):
        groups[links.root(i)].extend(places[x])
    return {p for g in groups.values() for p in g if p != min(g)}


@pytest.mark.parametrize("cell", [2048, 3])
def test_lines_brute(spark, cell):
    r = random.Random(3)
    base = [" ".join(r.choice("stone river candle morning window paper of the".split()) for _ in range(r.randint(1, 14))) for _ in range(25)]
    rows = []
    for i in range(40):
        picked = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(base)
            picked.append(r.choice([x, x.upper() + "!", x.replace("stone", "stome", 1), x + " 7", "", "---"]))
        rows.append((i, "\n".join(picked)))
    got = {(x["doc_id"], x["line_no"]) for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), cell=cell).collect()}
    assert got == _lines_brute(rows, line_dedup.RADIUS)
    every = _lines_brute(rows)
    assert got <= every and len(got) >= 0.9 * len(every)


def test_short_line_blocks():
    """Words counted alike, one changed: a half stays; a longer line: a run of three words stays."""
    _, keys = line_dedup.codes_and_blocks([b"a river of stone", b"a rover of stone", b"one", b"of the old stone bridge over a wide river", b"of the old stone bridge over the wide river"])
    shared = lambda i, j: {int(k) for k in keys[i] if k} & {int(k) for k in keys[j] if k}
    assert shared(0, 1) and shared(3, 4) and not shared(0, 3)
    assert [int((k != 0).sum()) for k in keys] == [5, 5, 2, 5, 5]


def test_removal_is_linear(spark):
    """A document of 200,000 lines of which every other goes."""
    import time

    n = 200_000
    df = spark.createDataFrame([("\n".join(map(str, range(n))), list(range(1, n, 2)))], "text string, gone array<int>")
    began = time.time()
    left = df.select(line_dedup.without_lines(F.col("text"), F.col("gone")).alias("t")).first()["t"]
    assert left == "\n".join(map(str, range(0, n, 2))) and time.time() - began < 20


def test_clashing_names(spark):
    """Columns named as the operators' own helpers pass through."""
    docs = spark.createDataFrame(
        [(1, "a line of seven words is here now\nz", "en", "a", 5, 6, 7, 8, 9, 10, 11), (2, "a line of seven words is here now", "en", "a", 5, 6, 7, 8, 9, 10, 11)],
        "doc_id bigint, text string, lang string, source string, gone int, __gone int, __text_key int, mine int, __n int, __copies int, `key` int",
    )
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert [(r["doc_id"], r["text"], r["__n_removed"]) for r in lines.orderBy("doc_id").collect()] == [(1, "a line of seven words is here now\nz", 0), (2, "", 1)]
    for out in (line_dedup.dedup_lines(lines), simhash_dedup.keep_one(docs), mixing.apply_mix(docs), toxicity.reject_toxic(docs, toxicity.seed_model())):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(tuple(r)[4:11] == tuple(range(5, 12)) for r in out.collect())


def test_lines_corner_texts(spark, corners):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(corners).where("doc_id is not null").collect()}
    assert got[1] == "Mit License here\nsecond line of it\n\n---" and got[2] is None and got[3] == "" and got[4] == "   \n\t " and got[6] == ""


# 6
def test_tokens_against_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    c = tokens.counter(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    r = random.Random(4)
    marks = list("  \n\t'sdtrevl0129aZé½²Ⅷ中　\x85\xa0\x1c!?$_-ñß") + ["<|endoftext|>", "ing", " the", "\U0001f600", "𐞊"]
    texts = ["", "a", "<|endoftext|>", "x" * 3000, *("".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(1500))]
    assert [c.text(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    pack = packing.encoder(tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert all(np.frombuffer(pack(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids + [0] for x in texts)


# 7
def test_order_minhash_brute(spark, sample_docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in sample_docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in order_minhash.fingerprint_documents(sample_docs).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = map(order_minhash.signature, (text, changed, after))
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (g["fingerprint"], g["edited_fingerprint"]) == (a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex())
        assert (g["near_edited"], g["near_next"]) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))


def _order_signature_brute(text, rows=48, size=2, k=8):
    """Every pair of k-mer and occurrence hashed by itself, sorted, the least put back into text order."""
    m = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & m
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & m
        return h ^ (h >> 33)

    if not text:
        return [0] * rows
    seeds = [mixed((i + 1) * 0xD1342543DE82EF95 & m) for i in range(rows)]
    k = min(k, len(text))
    seen, grams = Counter(), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & m
        h = mixed(h)
        grams.append((h, mixed((h + seen[h] * 0x9E3779B97F4A7C15) & m)))
        seen[h] += 1
    out = []
    for s in seeds:
        a, b = (s & 0xFFFFFFFF) | 1, s >> 32
        order = sorted(range(len(grams)), key=lambda i: ((((grams[i][1] & 0xFFFFFFFF) ^ b) * a + (grams[i][1] >> 32)) & 0xFFFFFFFF, i))
        n = min(size, len(grams))
        h = n
        for i in sorted(order[:n]):
            h = mixed((h * 0x9E3779B97F4A7C15 + grams[i][0] + s) & m)
        out.append(h >> 48)
    return out


def test_order_signature_brute():
    r = random.Random(13)
    for t in ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaa", "\U0001f600é中" * 7, *("".join(r.choices("ab cdé", k=r.randint(1, 90))) for _ in range(30))]:
        assert order_minhash.signature(t).tolist() == _order_signature_brute(t)


def test_order_minhash_ranges(spark, sample_docs):
    """One part a task; a part with the rows of one doc_id is cut by their texts; each part ends with the next one's first row."""
    same = spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    for docs in (sample_docs.select("doc_id", "text"), same):
        small = order_minhash.with_next(docs, per_task=7).withColumn("task", F.spark_partition_id())
        rows = [tuple(r) for r in small.select("part", "lead", "doc_id", "key", "task").collect()]
        order = lambda r: (r[2] is not None, r[2] or 0, r[3])
        own = sorted((r for r in rows if not r[1]), key=order)
        assert sorted(map(str, (r[2] for r in own))) == sorted(str(r["doc_id"]) for r in docs.collect())
        assert [r[0] for r in own] == sorted(r[0] for r in own)  # ranges
        sizes = Counter(r[0] for r in own)
        assert len(sizes) > 10 and max(sizes.values()) < 40 and len({r[4] for r in own}) == len(sizes)
        firsts = {p: next(r for r in own if r[0] == p) for p in sizes}
        parts = sorted(sizes)
        for p, after in zip(parts, parts[1:] + parts[:1]):
            assert {r[2:4] for r in rows if r[1] and r[0] == p} == {firsts[after][2:4]}


def test_order_matters():
    r = random.Random(5)
    text = "".join(r.choice("abcdefghij ") for _ in range(3000))
    one = order_minhash.signature(text)
    swapped = order_minhash.signature(text[1500:] + text[:1500])
    assert order_minhash.likeness(one, order_minhash.signature(text[:1490] + "xyz" + text[1493:])) > order_minhash.likeness(one, swapped)


# 8
def test_packing_covers(spark, sample_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in sample_docs.collect()}
    pieces = packing.pack_documents(sample_docs, buffer_tokens=20_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["tier"]))
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert (p["ids_crc32"], p["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids[p["doc_id"]]))
    for groups, totals in ((by_doc, {i: len(x) for i, x in ids.items()}), (by_sequence, {s: v[0][2] for s, v in by_sequence.items()})):
        assert set(groups) == set(totals)
        for key, parts in groups.items():
            at = 0
            for part in sorted(parts):
                assert part[0] == at
                at += part[1]
            assert at == totals[key]
    assert all(v[0][2] in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024) for v in by_sequence.values())


def test_packing_tiers_and_steps(spark, sample_docs):
    """On several partitions: every tier has windows of documents routed to it, padding is nil, step groups are equal or balanced."""
    pieces = packing.pack_documents(sample_docs.repartition(4, "doc_id"), buffer_tokens=40_000, step_tokens=8 * 1024).collect()
    windows, steps, made = {}, defaultdict(int), Counter()
    for p in pieces:
        windows.setdefault(p["sequence_id"], [p["tier"], 0, p["step_group"], 0])
        windows[p["sequence_id"]][1] += p["length"]
        windows[p["sequence_id"]][3] = max(windows[p["sequence_id"]][3], p["length"])
    for tier, tokens, step, longest in windows.values():
        assert tokens == tier and tier & (tier - 1) == 0
        steps[step] += tokens
        made[tier] += tokens
    total = sum(made.values())
    assert all(made[t] > 0.01 * total for t in (256, 512, 1024)) and made[128] > 0
    # A window of a tier of documents is opened by a rest that only this tier or a longer one holds.
    opened = [longest > tier // 2 for tier, _, _, longest in windows.values() if tier in (256, 512)]
    assert sum(opened) > 0.9 * len(opened)
    by_task = defaultdict(list)
    for step, tokens in steps.items():
        assert tokens <= 8 * 1024 + 1024
        by_task[step >> 40].append(tokens)
    for tokens in by_task.values():
        short = [t for t in tokens if t != 8 * 1024]
        assert not short or max(short) - min(short) <= 1024


# 9
def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_brute(spark, sample_docs, corners, limit):
    docs = sample_docs.select("doc_id", "text").unionByName(corners.where("doc_id is not null").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = docs.collect()
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_dedup.near_duplicates(docs, shard_limit=limit).collect()}
    fps = [(r["doc_id"], _fingerprint(r["text"])) for r in rows]
    links = blocks.Links(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                links.join(i, j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[links.root(i)] = min(d, least.get(links.root(i), d))
    assert got == {(d, f, least[links.root(i)]) for i, (d, f) in enumerate(fps)}


def test_bk_tree():
    r = random.Random(6)
    centre = r.getrandbits(64)
    codes = [centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) for _ in range(300)]
    tree = simhash_dedup.BKTree()
    for i, c in enumerate(codes):
        tree.add(c, i)
    for q in codes[:50]:
        assert sorted(tree.within(q, 2)) == [i for i, c in enumerate(codes) if (c ^ q).bit_count() <= 2]


def test_block_masks_bring_near_codes_together():
    r = random.Random(7)
    for b, k in ((4, 2), (5, 3), (6, 3)):
        for _ in range(300):
            x = sum(1 << i for i in r.sample(range(64), k))
            assert any(x & m == 0 for m in blocks.masks(b, k))


def test_components_chain(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint"))
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_keep_one(spark, corners):
    kept = simhash_dedup.keep_one(corners)
    assert kept.columns == corners.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[2] == 1 and ids[3] == ids[4] == 0 and ids[None] == 1 and ids[1] == ids[8] == 1


# 10
def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by repetition."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s] + 1e-9}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["sample", "corners"])
def test_mixing(spark, sample_docs, corners, which):
    docs = (sample_docs if which == "sample" else corners).select("doc_id", "text", "source")
    got = mixing.pareto_mix(docs).collect()
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    target = _targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-5
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(docs.repartition(5)).collect()))


def test_mixing_sql(spark):
    import os

    import duckdb

    con, path = duckdb.connect(), f"{SF}/documents.parquet"
    con.sql(f"create view documents as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(con.sql(mixing.ORACLE_SQL).df()[names].itertuples(index=False, name=None)) == sorted(queries.op10_mixing(spark, SF).toPandas()[names].itertuples(index=False, name=None))


def test_mixing_sizes(spark, corners):
    got = {r["doc_id"]: r["size"] for r in mixing.pareto_mix(corners).collect()}
    assert got[2] == got[3] == got[4] == 0 and got[11] == 1 and got[12] == 8
