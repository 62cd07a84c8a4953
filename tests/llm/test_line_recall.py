"""Line dedup against pairs by edit similarity alone."""

import random

import numpy as np

from vigilmill.llm import line_dedup


def test_recall_of_edited_lines(spark):
    """Lines of 20 to 80 words and copies with one or two words changed: all have edit similarity 0.9 or more."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows, pairs = [], 0
    for i in range(400):
        words = [word() for _ in range(r.randint(20, 80))]
        copy = list(words)
        for k in r.sample(range(len(copy)), r.randint(1, 2)):
            copy[k] = word()
        a, b = " ".join(words), " ".join(copy)
        if line_dedup.similar(a, b, 0.9):
            rows += [(2 * i, a), (2 * i + 1, b)]
            pairs += 1
    gone = {x["doc_id"] for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(x % 2 for x in gone)
    recall = len(gone) / pairs
    print(f"recall {recall:.3f} of {pairs} pairs")
    assert recall >= 0.5  # 0.36 at radius 3


def test_script_without_spaces():
    """One letter of two hundred changed: a near code, not an unrelated one."""
    r = random.Random(12)
    near = 0
    for _ in range(100):
        line = [chr(0x4E00 + r.randrange(3000)) for _ in range(200)]
        copy = list(line)
        copy[r.randrange(200)] = "龠"
        a, b = line_dedup.simhashes(line_dedup.code_lines(["".join(x).encode() for x in (line, copy)]))
        near += int(np.bitwise_count(a ^ b)) <= line_dedup.RADIUS
    assert near >= 60


def test_bounds_of_the_edit_distance():
    """The bounds that decide most pairs never contradict the distance itself."""
    r = random.Random(14)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += [t[:k] + "x" + t[k + r.randint(0, 2) :] for t in texts[:40] for k in [r.randrange(len(t))]]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(texts)) for b in range(a)]))
    low = line_dedup._least_distance(texts, i, j)
    for a, b, least in zip(i.tolist(), j.tolist(), low.tolist()):
        d = line_dedup.edit_distance(texts[a], texts[b], 1000)
        assert least <= d <= line_dedup.word_bound(texts[a].split(), texts[b].split(), 1000)


def test_distances_of_many_pairs():
    """Pairs met at once: the verdict of each is that of its own distance, whatever its length, letters and bound."""
    r = random.Random(15)
    pairs, mosts = [], []
    for k in range(600):
        letters = "abcd " if k % 3 else "aé漢字𠀀 ß" + "bcdefgh" * (k % 2)
        a = [r.choice(letters) for _ in range(r.choice([2, 30, 63, 64, 65, 127, 300, 700]) + r.randint(-2, 2))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 3 + 1)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
        pairs.append(("".join(a), "".join(b))[:: r.choice((1, -1))])
        mosts.append(int(0.1 * max(len(a), len(b))))
    wanted = [line_dedup.edit_distance(a, b, most) <= most for (a, b), most in zip(pairs, mosts)]
    assert line_dedup.within(pairs, mosts).tolist() == wanted and 100 < sum(wanted) < 500
    assert not len(line_dedup.within([], []))


def test_forms_of_many_texts():
    r = random.Random(16)
    texts = [None, "", "\n", " \n\n ", "Σ\nΣΑΣ", *("".join(r.choice("aB \n\t.1é×漢ß  ") for _ in range(r.randint(0, 60))) for _ in range(500))]
    lines, counts = line_dedup.plain_forms(texts)
    assert lines == [x for t in texts for x in line_dedup.plain_lines(t)]
    assert counts.tolist() == [len(line_dedup.plain_lines(t)) for t in texts]


def test_tables_go(spark):
    """Tables of a run leave the shared folder with it; the session's settings are as before."""
    from pathlib import Path

    from vigilmill.llm.common import shared_folder

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    docs = spark.createDataFrame([(1, "a line of seven words is here now\nz"), (2, "a line of seven words is here now")], "doc_id bigint, text string")
    assert [tuple(x) for x in line_dedup.repeated_arrays(docs).select("doc_id", "gone").collect()] == [(2, [0])]
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("tables-*/*")) and spark.conf.get(name, "false") == was
