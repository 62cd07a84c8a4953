"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, one line kept of each group.

1. Every text is split at newlines; a line's plain form is its lower-case words without punctuation, its normal form
   has digits as 0 besides.  Each line becomes a small row: a 128-bit hash of its plain form and a 64-bit word SimHash
   of its normal form, so that lines that differ in digits are proposed, but removed only if verified.
2. Pigeonhole blocks are cut from the line's words: lines with few changed words agree in a block, whatever their
   codes do.  (Blocks of the code's bits would need a radius of ten for edit similarity 0.9, and no table of them is
   selective.)  A block is a run of `BLOCK_WORDS` words, and the `BLOCKS` of least hash are a line's; of a line of under
   `SHORT` words some are its halves, of which one changed word leaves one whole.
3. Lines that share a block and whose codes differ in `RADIUS` bits at most are flagged, and only they fetch their text.
   In each block, such lines are linked if their edit similarity is `similarity` or more; pairs that are connected
   already are not compared again.  Components of the links are the groups.
4. Of each group's occurrences the first by (doc_id, line number) stays.

A block of more than `cell` lines is first parted by line length (lines of that similarity differ by a tenth at most), then
dealt to cells in which any two of its lines meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.blocks import Links, beside, dealt, near_pairs, whole_runs
from vigilmill.llm.common import cut, free_names, scratch_tables
from vigilmill.llm.components import components

RADIUS = 12
BLOCKS = 5
BLOCK_WORDS = 3
SHORT = 10
SIMILARITY = 0.9
CELL = 2048
#: Forms that a task remembers, so that a very common line gives its blocks about once in a task.
REMEMBERED = 1 << 18

_ZERO = bytes(ord("0") if 48 <= c < 58 else c for c in range(256))
_WIDE = re.compile(r"[^\w\s]+")
#: Letters of scripts without spaces (Thai to Myanmar, Khmer, kana, Han): each counts as a word of the SimHash.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def normal_lines(text: str | None) -> list[bytes]:
    """Normal form of each line of a text; empty if a line has no word."""
    return [x.translate(_ZERO) for x in plain_lines(text)]


def plain_lines(text: str | None) -> list[bytes]:
    """Plain form of each line of a text, which keeps its digits; empty if a line has no word."""
    return [b" ".join(x.split()) for x in _words_and_breaks(text).split(b"\n")] if text else []


def plain_forms(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """`plain_lines` of all texts in one list, and the number of each text's lines; blanks are taken out some megabytes at a time."""
    lines, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        if not held:
            return
        data = np.frombuffer(b"\n".join(held), np.uint8)
        apart = (data == 32) | (data == 10)
        blank = np.concatenate(([True], apart[:-1]))  # after a blank or a break
        blank &= data == 32
        data = data[~blank]
        blank = np.concatenate((data[1:] == 10, [True]))  # before a break
        blank &= data == 32
        lines.extend(data[~blank].tobytes().split(b"\n"))

    for k, text in enumerate(texts):
        if text:
            held.append(raw := _words_and_breaks(text))
            counts[k] = raw.count(b"\n") + 1
            size += len(raw)
            if size >= 1 << 21:
                flush()
                held, size = [], 0
    flush()
    return lines, counts


def _words_and_breaks(text: str) -> bytes:
    """The text in lower case with blanks for all but words and line breaks."""
    lower = text.lower()
    raw = lower.encode("utf-8", "replace")
    # Letters of Latin-1 and Latin Extended-A need no search for signs beyond ASCII.
    if not lower.isascii() and (raw.translate(None, _LATIN_BYTES) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw):
        raw = _WIDE.sub(" ", lower).encode("utf-8", "replace")
    return raw.translate(_KEEP_BREAKS)


_LATIN_BYTES = bytes([*range(0xC0), 0xC3, 0xC4, 0xC5])
_KEEP_BREAKS = bytes(c if c == 10 or c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))


def code_lines(lines: list[bytes]) -> list[bytes]:
    """Plain forms as `simhashes` takes them: digits as 0, letters of scripts without spaces alone.

    Such letters have lead bytes of E0 or more in UTF-8.
    """
    whole = b"\n".join(lines)
    lines = whole.translate(_ZERO).split(b"\n") if lines else []
    if not whole.translate(None, _LOW_BYTES):
        return lines
    return [_UNSPACED.sub(r" \1 ", x.decode("utf-8", "replace")).encode() if x.translate(None, _LOW_BYTES) else x for x in lines]


_LOW_BYTES = bytes(range(0xE0))


def simhashes(lines: list[bytes]) -> np.ndarray:
    """64-bit SimHash over the words (with repeats) of each non-empty line; bytes as made by `code_lines`."""
    return codes_and_blocks(lines)[0]


def codes_and_blocks(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """uint64[lines] SimHashes and uint64[lines, BLOCKS] block keys; a line of fewer blocks has 0 in the rest.

    Words are hashed for all lines at once: a polynomial of a word's bytes from prefix sums modulo 2**64, then mixed;
    a block's hash is that of its bytes, blanks included.
    """
    codes, blocks = np.zeros(len(lines), np.uint64), np.zeros((len(lines), BLOCKS), np.uint64)
    at = 0
    while at < len(lines):
        stop, held = at, 0
        while stop < len(lines) and (held < 1 << 20 or stop == at):
            held += len(lines[stop]) + 1
            stop += 1
        codes[at:stop], blocks[at:stop] = _chunk(lines[at:stop])
        at = stop
    return codes, blocks


_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _UP, _DOWN = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _UP, _DOWN


_UP = _DOWN = np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _chunk(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))

        def hashed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return _mixed((total[hi] - total[lo]) * down[lo] ^ (hi - lo).astype(np.uint64))

        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        line = np.cumsum(data[ends] == 10) - (data[ends] == 10)
        word = ends > starts
        starts, ends, line = starts[word], ends[word], line[word]
        hashes = hashed(starts, ends)
    codes, blocks = np.zeros(len(lines), np.uint64), np.zeros((len(lines), BLOCKS), np.uint64)
    if not len(hashes):
        return codes, blocks
    firsts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.concatenate((firsts, [len(line)])))
    ones = _ones(hashes, firsts, int(sizes.max()))
    codes[line[firsts]] = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)

    # Halves of short lines, as beginnings and ends; both roundings where a word more or less can be, which else parts lines.
    short = np.flatnonzero(sizes < SHORT)
    head, n = firsts[short], sizes[short]
    taken = np.zeros(len(sizes), np.int64)  # slots in use
    with np.errstate(over="ignore"):
        for rule, half in ((n < SHORT - 2, (n + 1) // 2), (n >= 4, n // 2)):
            h, k, size = head[rule], half[rule], n[rule]
            mark = np.where(size < 4, size, 0).astype(np.uint64) * np.uint64(2)
            slot, row = taken[short[rule]], line[h]
            blocks[row, slot] = _mixed(hashed(starts[h], ends[h + k - 1]) + mark)
            blocks[row, slot + 1] = _mixed(hashed(starts[h + size - k], ends[h + size - 1]) + mark + np.uint64(1))
            taken[short[rule]] += 2
    # In the slots left, the runs of BLOCK_WORDS words of least hash, equal ones counted once.
    run = np.flatnonzero(line[BLOCK_WORDS - 1 :] == line[: max(0, len(line) - BLOCK_WORDS + 1)])
    if len(run):
        key, owner = hashed(starts[run], ends[run + BLOCK_WORDS - 1]), line[run]
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        mine = owner[edge]
        used = np.zeros(len(lines), np.int64)
        used[line[firsts]] = taken
        slot = np.repeat(np.arange(len(edge)), np.diff(np.concatenate((edge, [len(owner)]))))
        for k in range(BLOCKS):
            least = np.minimum.reduceat(key, edge)
            some = (least != _NONE) & (used[mine] + k < BLOCKS)
            blocks[mine[some], used[mine[some]] + k] = least[some]
            key[key == least[slot]] = _NONE
    return codes, blocks


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _ones(hashes: np.ndarray, firsts: np.ndarray, largest: int) -> np.ndarray:
    """int[groups, 64]: how many hashes of each group have each bit, the highest bit first.

    Four counters of 16 bits are added at once in a 64-bit lane; groups too large for them are added bit by bit.
    """
    if largest > 0xFFFF:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    ones = np.empty((len(firsts), 64), np.int64)
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0001000100010001), firsts)
        for lane in range(4):
            ones[:, 63 - 16 * lane - k] = (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    return ones


def edit_distance(a: bytes | str, b: bytes | str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger: bit-parallel over whole-line integers, common ends removed."""
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    head = _common(a, b, n)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1], min(len(a), len(b)))
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    if len(a) < len(b):
        a, b = b, a
    places: dict = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for left, c in zip(range(len(a) - 1, -1, -1), a):
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        if score - left > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        plus, minus = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
    return min(score, most + 1)


def _common(a, b, n: int) -> int:
    """Length of the common start."""
    lo, step = 0, 1
    while lo < n and a[lo : lo + step] == b[lo : lo + step]:
        lo, step = min(n, lo + step), step * 2
    while lo < n and step > 1:
        step //= 2
        if a[lo : lo + step] == b[lo : lo + step]:
            lo = min(n, lo + step)
    return min(lo, n)


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - distance / longer length is at least `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return edit_distance(a, b, most) <= most


#: Of `within`: the fewest pairs that are met at once, their longest line (in letters, common ends removed) and the most words of its tables.
_LEAST_PAIRS, _LONGEST, _TABLE = 24, 1 << 13, 1 << 21


def within(pairs: list[tuple[str, str]], mosts: list[int]) -> np.ndarray:
    """bool[pairs]: whether the edit distance of each pair is at most its bound; pairs of like length are met at once."""
    out = np.zeros(len(pairs), bool)
    classes: dict[tuple, list] = {}
    for k, ((a, b), most) in enumerate(zip(pairs, mosts)):
        n = min(len(a), len(b))
        if max(len(a), len(b)) - n > most:
            continue
        head = _common(a, b, n)
        a, b = a[head:], b[head:]
        tail = _common(a[::-1], b[::-1], n - head)
        if tail:
            a, b = a[:-tail], b[:-tail]
        if len(a) > len(b):
            a, b = b, a
        if len(b) <= most:
            out[k] = True
        elif a:
            classes.setdefault((len(b) <= _LONGEST, len(b).bit_length(), most.bit_length()), []).append((k, a, b, most))
    for (fits, *_), some in classes.items():
        some.sort(key=lambda x: -len(x[1]))
        found = _distances([x[1] for x in some], [x[2] for x in some], max(x[3] for x in some)) if fits and len(some) >= _LEAST_PAIRS else None
        for at, (k, a, b, most) in enumerate(some):
            out[k] = (edit_distance(a, b, most) if found is None else found[at]) <= most
    return out


def _letters(texts: list[str], width: int) -> np.ndarray:
    """uint32[texts, width]: code points plus one, then zeros."""
    out = np.zeros((len(texts), width), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    return out


def _distances(a: list[str], b: list[str], most: int) -> np.ndarray | None:
    """int[pairs]: Levenshtein distance where it is at most `most`, else some larger number; None if the tables would be too large.

    No a is longer than its b, nor than the a before it.  Myers' bit vectors in words of 64 rows: at each step the word w of a pair is at
    column step - w, so that all words of all pairs take one step at once, and only words within `most` of the diagonal are met.  A common
    end fills the a of a pair to whole words, which changes no distance.
    """
    n, sizes = len(a), np.fromiter(map(len, a), np.int64, len(a))
    words = -(-sizes // 64)
    high, beyond = 64 * int(words[0]), np.fromiter(map(len, b), np.int64, n) - sizes
    rows, columns = _letters(a, high), _letters(b, high + most + 1)
    kinds = np.zeros(int(max(rows.max(), columns.max())) + 1, np.int32)
    kinds[rows] = 1
    kinds[0] = 1
    kinds[np.flatnonzero(kinds)] = np.arange(1, (size := int(kinds.sum()) + 1))  # 0: a letter of no row
    if int(words.sum()) * size > _TABLE:
        half = n // 2
        if half < _LEAST_PAIRS:
            return None
        parts = [_distances(a[lo:hi], b[lo:hi], most) for lo, hi in ((0, half), (half, n))]
        return None if any(x is None for x in parts) else np.concatenate(parts)
    rows, columns = kinds[rows].T.copy(), kinds[columns].T.ravel()
    having = [int((words > w).sum()) for w in range(high // 64)]  # pairs that have a word w: the first ones
    off = np.concatenate(([0], np.cumsum(having)))
    pair = np.concatenate([np.arange(k) for k in having])
    word = np.repeat(np.arange(len(having)), having)
    above = np.concatenate((np.zeros(having[0], np.int64), off[word[having[0] :] - 1] + pair[having[0] :]))
    row_of, column_of = np.arange(len(pair)) * size, pair - word * n
    equal = np.zeros(len(pair) * size, np.uint64)
    for r in range(high):
        w = r >> 6
        equal[row_of[off[w] : off[w + 1]] + rows[r, : having[w]]] |= np.uint64(1 << (r & 63))

    one, top = np.uint64(1), np.uint64(63)
    plus, minus = np.full(len(pair), _NONE), np.zeros(len(pair), np.uint64)
    up, down = np.ones(len(pair), np.uint64), np.zeros(len(pair), np.uint64)  # the last step of a word's last row, as +1 and -1
    score = np.full(len(pair), 64, np.int64)  # of a word's last row
    ends = 64 * words + beyond + words - 2  # the step after which a pair's score is found
    order = np.argsort(ends, kind="stable")
    times, lane, at = ends[order], (off[words - 1] + np.arange(n))[order], 0
    found = np.zeros(n, np.int64)
    first = stop = 0
    for t in range(int(times[-1]) + 1):
        while stop < len(having) and t - stop >= max(0, 64 * stop - most):
            stop += 1
            if stop > 1:
                lo, hi = off[stop - 1], off[stop]
                score[lo:hi] = score[above[lo:hi]] + down[above[lo:hi]].view(np.int64) - up[above[lo:hi]].view(np.int64) + 64
        while t - first > 64 * first + 63 + most:
            up[off[first] : off[first + 1]], down[off[first] : off[first + 1]] = 1, 0
            first += 1
        lo, hi = off[first], off[stop]
        in_up, in_down = up[above[lo:hi]], down[above[lo:hi]]
        if not first:
            in_up[: having[0]], in_down[: having[0]] = 1, 0
        p, m = plus[lo:hi], minus[lo:hi]
        eq = equal[row_of[lo:hi] + columns[column_of[lo:hi] + t * n]]
        xv = eq | m
        eq |= in_down
        xh = eq & p
        xh += p
        xh ^= p
        xh |= eq
        ph = xh | p
        np.invert(ph, out=ph)
        ph |= m
        xh &= p  # now the steps of -1
        np.right_shift(ph, top, out=up[lo:hi])
        np.right_shift(xh, top, out=down[lo:hi])
        score[lo:hi] += up[lo:hi].view(np.int64)
        score[lo:hi] -= down[lo:hi].view(np.int64)
        ph <<= one
        ph |= in_up
        xh <<= one
        xh |= in_down
        np.bitwise_and(ph, xv, out=m)
        xv |= ph
        np.invert(xv, out=xv)
        np.bitwise_or(xh, xv, out=p)
        while at < n and times[at] == t:
            found[order[at]] = score[lane[at]]
            at += 1
    return found


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, text_key, line_no (from 0), h1, h2 (128-bit hash of the plain form), code, size (bytes), blocks.

    blocks is empty where the task has given the blocks of the same form before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            lines, counts = plain_forms(b.column("text").to_pylist())
            size = np.fromiter(map(len, lines), np.int32, len(lines))
            full = size > 0
            doc = np.repeat(np.arange(len(counts)), counts)[full]
            number = (np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts))[full]
            lines = [x for x in lines if x]
            digests = list(map(xxhash.xxh3_128_digest, lines))
            new = np.zeros(len(lines), bool)
            for i, h in enumerate(digests):
                if h not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    new[i] = True
            wide = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            codes, blocks = codes_and_blocks(code_lines(lines))
            used = (blocks != 0) & new[:, None]
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(used.sum(axis=1)))), pa.int32()), pa.array(blocks[used].view(np.int64)))
            where = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(where), b.column("text_key").take(where), pa.array(number, pa.int32()), pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(codes.view(np.int64)), pa.array(size[full]), keys],
                ["doc_id", "text_key", "line_no", "h1", "h2", "code", "size", "blocks"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, line_no int, h1 bigint, h2 bigint, code bigint, size int, blocks array<bigint>")


def length_band(size, similarity: float):
    """The band of a line length; lines of that edit similarity lie in the same band or in neighbours."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(similarity) * 1.000001)).cast("int")


def flagged_codes(lines: DataFrame, expected: int, radius: int = RADIUS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(code, active): the codes that share a block with a different one within the radius, and those blocks (at most `BLOCKS` a form).

    lines: code, size, blocks; `expected`: about the number of blocks.
    """
    keyed = lines.select(F.explode("blocks").alias("bucket"), "code", "size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_runs(frames):
            cells, codes, buckets = f["cell"].to_numpy(), f["code"].to_numpy(), f["bucket"].to_numpy()
            order = np.lexsort((codes, cells))  # a code once in a cell
            cells, codes, buckets = cells[order], codes[order], buckets[order]
            new = np.concatenate(([True], (cells[1:] != cells[:-1]) | (codes[1:] != codes[:-1])))
            cells, codes, buckets = cells[new], codes[new], buckets[new]
            near = np.zeros(len(codes), bool)
            for i, j in near_pairs(cells, codes.view(np.uint64), radius):
                near[i] = near[j] = True
            if near.any():
                yield pd.DataFrame({"code": codes[near], "bucket": buckets[near]})

    band = length_band(F.col("size"), similarity)
    found = dealt(keyed, "bucket", F.xxhash64("code"), cell, expected, band).select("cell", "bucket", "code").mapInPandas(run, "code bigint, bucket bigint")
    return found.groupBy("code").agg(F.collect_set("bucket").alias("active"))


def _letter_counts(texts: list[str]) -> np.ndarray:
    """int[texts, 32]: letters of each of 32 classes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") & np.uint32(31)
    counts = np.bincount(np.repeat(np.arange(len(texts)) * 32, sizes) + points, minlength=32 * len(texts)).reshape(-1, 32)
    return counts.astype(np.int16 if not len(sizes) or sizes.max() < 1 << 15 else np.int64)


def _letters_apart(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of each pair's edit distance: letters, in 32 classes, that one line has more of than the other."""
    sizes, out = counts.sum(axis=1, dtype=np.int64), np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 11):
        some, other = i[lo : lo + (1 << 11)], j[lo : lo + (1 << 11)]
        # What one has more and what the other has more: their sum is that of all differences, their difference that of the sizes.
        out[lo : lo + (1 << 11)] = (np.abs(counts[some] - counts[other]).sum(axis=1, dtype=np.int64) + np.abs(sizes[some] - sizes[other])) // 2
    return out


def _least_distance(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _letters_apart(_letter_counts(texts), i, j)


def word_bound(a: list[str], b: list[str], most: int) -> int:
    """An upper bound of the edit distance of two lines, from their words: changed, left out or put in one at a time; over `most`, it stops."""
    cost = i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        if i + 1 < n and a[i + 1] == b[j]:
            cost, i = cost + len(a[i]) + 1, i + 1
        elif j + 1 < m and a[i] == b[j + 1]:
            cost, j = cost + len(b[j]) + 1, j + 1
        else:
            cost, i, j = cost + max(len(a[i]), len(b[j])), i + 1, j + 1
        if cost > most:
            return cost
    return cost + sum(len(w) + 1 for w in a[i:]) + sum(len(w) + 1 for w in b[j:])


def verified_links(cell: np.ndarray, codes: np.ndarray, bucket: np.ndarray, blocks: np.ndarray, texts: list[str], radius: int, least: float) -> np.ndarray:
    """Spanning links (i, smallest of its group) of lines sorted by cell: int[n, 2]; blocks: uint64[n, BLOCKS], 0 for none.

    A pair is compared in the least of the blocks that it shares, and only if it is not connected yet; taking each line's
    partners in order makes a large group a star after about one comparison a line.  Bounds of the edit distance decide most
    pairs: letter counts from below, words from above.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first_i, first_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in near_pairs(cell, codes, radius):
        longer = np.maximum(sizes[i], sizes[j])
        fits = np.minimum(sizes[i], sizes[j]) >= longer - ((1 - least) * longer + 1e-9).astype(np.int64)
        i, j = i[fits], j[fits]
        least_shared = np.full(len(i), _NONE)
        for k in range(blocks.shape[1]):
            mine = blocks[i, k]
            shared = (mine != 0) & (mine[:, None] == blocks[j]).any(axis=1)
            least_shared = np.where(shared, np.minimum(least_shared, mine), least_shared)
        here = least_shared == bucket[i]
        first_i.append(i[here])
        first_j.append(j[here])
    i, j = np.concatenate(first_i), np.concatenate(first_j)
    if not len(i):
        return np.empty((0, 2), np.int64)
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    mosts = ((1 - least) * np.maximum(sizes[i], sizes[j]) + 1e-9).astype(np.int64)
    links = Links(len(texts))
    words = lru_cache(4096)(lambda k: texts[k].split())
    counts, turns = _letter_counts(texts), 1
    while len(i):
        # The next partners of each line, twice as many each time: a group becomes a star in the first round.
        firsts = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
        mine = np.arange(len(j)) - np.repeat(firsts, np.diff(np.concatenate((firsts, [len(j)])))) < turns
        a, b, most = i[mine], j[mine], mosts[mine]
        some = _letters_apart(counts, a, b) <= most
        open_ = []
        for x, y, d in zip(a[some].tolist(), b[some].tolist(), most[some].tolist()):
            if links.root(x) != links.root(y):
                if word_bound(words(x), words(y), d) <= d:
                    links.join(x, y)
                else:
                    open_.append((x, y, d))
        for lo in range(0, len(open_), 1 << 12):
            part = [x for x in open_[lo : lo + (1 << 12)] if links.root(x[0]) != links.root(x[1])]
            for (x, y, _), is_near in zip(part, within([(texts[x], texts[y]) for x, y, _ in part], [d for _, _, d in part])):
                if is_near:
                    links.join(x, y)
        roots = np.fromiter(map(links.root, range(len(texts))), np.int64, len(texts))
        mine = ~mine & (roots[i] != roots[j])
        i, j, mosts, turns = i[mine], j[mine], mosts[mine], 2 * turns
    roots = np.fromiter(map(links.root, range(len(texts))), np.int64, len(texts))
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return np.stack((moved, roots[moved]), axis=1)


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 40_000, letters: int = 1 << 24) -> Iterator[pd.DataFrame]:
    """Frames put together up to about so many rows and letters: the more pairs are met at once, the cheaper."""
    held, n, size = [], 0, 0
    for f in frames:
        held.append(f)
        n, size = n + len(f), size + int(f["line"].str.len().sum())
        if n >= rows or size >= letters:
            yield pd.concat(held, ignore_index=True)
            held, n, size = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def line_links(lines: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(a1, a2, b1, b2): links between distinct plain forms; lines: h1, h2, code, line, blocks (those in which the line has a neighbour)."""
    keyed = lines.select("h1", "h2", "code", "line", "blocks", F.explode("blocks").alias("bucket"), F.octet_length("line").alias("size"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _gathered(whole_runs(frames)):
            h1, h2 = f["h1"].to_numpy(), f["h2"].to_numpy()
            blocks = np.zeros((len(f), BLOCKS), np.uint64)
            for k, x in enumerate(f["blocks"]):
                blocks[k, : len(x)] = np.asarray(x, np.int64).view(np.uint64)
            found = verified_links(f["cell"].to_numpy(), f["code"].to_numpy().view(np.uint64), f["bucket"].to_numpy().view(np.uint64), blocks, f["line"].tolist(), radius, least)
            if len(found):
                i, j = found.T
                yield pd.DataFrame({"a1": h1[i], "a2": h2[i], "b1": h1[j], "b2": h2[j]})

    expected = lines.count() * BLOCKS
    found = dealt(keyed, "bucket", F.xxhash64("h1", "h2"), cell, expected, length_band(F.col("size"), least)).select("cell", "bucket", "h1", "h2", "code", "line", "blocks")
    return found.mapInPandas(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, code, line, blocks of the wanted plain forms, found again in the documents that hold their first occurrence.

    wanted: doc_id, text_key, line_no, active; of a line's blocks only the active ones are kept, or all where active is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, active = [], []
            for text, held in zip(b.column("text").to_pylist(), b.column("held").to_pylist()):
                lines = text.split("\n")
                for x in held:
                    texts.append(lines[x["line_no"]])
                    active.append(x["active"])
            texts = plain_forms(texts)[0]
            wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), ">i8").reshape(-1, 2).astype(np.int64)
            codes, blocks = codes_and_blocks(code_lines(texts))
            keys = []
            for mine, some in zip(blocks.view(np.int64).tolist(), active):
                keys.append([k for k in mine if k and (some is None or k in some)])
            lines = pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(codes.view(np.int64)), lines, pa.array(keys, pa.list_(pa.int64()))], ["h1", "h2", "code", "line", "blocks"])

    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "active")).alias("held"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "held")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    held = rows.join(per_doc.hint("shuffle_hash"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return held.select("text", "held").mapInArrow(run, "h1 bigint, h2 bigint, code bigint, line string, blocks array<bigint>").dropDuplicates(["h1", "h2"])


def repeated_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(doc_id, text_key, line_no) of every line that repeats an earlier one, exactly in plain form or through links."""
    return repeated_arrays(docs, radius, similarity, cell).select("doc_id", "text_key", F.explode("gone").alias("line_no"))


def repeated_arrays(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """`repeated_lines` with one row for each text that has any: doc_id, text_key, gone (ascending)."""
    with scratch_tables(docs.sparkSession) as put:
        return cut(_repeated(docs, put, radius, similarity, cell), release=True)


def _repeated(docs: DataFrame, put: Callable[[DataFrame], DataFrame], radius: int, similarity: float, cell: int) -> DataFrame:
    """(doc_id, text_key, gone) of `repeated_arrays`; put: writes a table that is read several times."""
    lines = put(line_rows(docs))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "line_no")
    distinct = put(lines.groupBy("h1", "h2").agg(F.first("code").alias("code"), F.min(place).alias("first"), F.count("*").alias("times")))
    # Forms of one code (they differ in digits at most, or in the order of words) are proposed in all of their blocks.
    same = distinct.groupBy("code").agg(F.count("*").alias("forms")).where("forms > 1")
    found = flagged_codes(lines.select("code", "size", "blocks"), distinct.count() * BLOCKS, radius, similarity, cell)
    # Written, so that shuffles of blocks are gone before those of texts.
    flagged = cut(found.join(same, "code", "full_outer").select("code", F.when(F.col("forms").isNull(), F.col("active")).alias("active")), release=True)
    wanted = cut(distinct.select("code", "first").join(beside(flagged), "code").select("first.doc_id", "first.text_key", "first.line_no", "active"), release=True)
    edges = cut(line_links(cut(_texts_of(docs, wanted), release=True), radius, similarity, cell), release=True)
    # Nodes are first halves of the hashes: two flagged forms that share one by chance would count as linked (for a
    # billion flagged forms, one such pair is expected in forty runs).
    roots = cut(components(edges, "a1", "b1").select(F.col("node").alias("h1"), "root"))
    # Written, so that the next joins deal both sides anew and may split a large group or a very common line.
    grouped = cut(distinct.join(beside(roots), "h1").select("h1", "h2", "root", "first"), release=True)
    best = cut(grouped.groupBy("root").agg(F.min("first").alias("best")))
    moved = cut(grouped.join(beside(best), "root").select("h1", "h2", "best"), release=True)
    # Only forms that occur again or have moved can lose an occurrence.
    kept = distinct.select("h1", "h2", "first", "times").join(beside(moved), ["h1", "h2"], "left").where("times > 1 or best is not null")
    kept = cut(kept.select("h1", "h2", F.coalesce("best", "first").alias("best")), release=True)
    gone = lines.select("doc_id", "text_key", "line_no", "h1", "h2").join(beside(kept), ["h1", "h2"]).where(place != F.col("best"))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def without_lines(text, gone):
    """text without the lines whose numbers (from 0) the ascending array `gone` names; the work grows with the text, not with lines times gone."""
    held = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))

    def between(s, i):
        """The lines after the i-th gone one (before the first, for i = 0) and before the next."""
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(s["gone"], i - 1) + 1)
        stop = F.coalesce(F.get(s["gone"], i), F.size(s["lines"]))
        return F.slice(s["lines"], start + 1, stop - start)

    kept = F.transform(held, lambda s: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda i: between(s, i))), "\n"))
    return F.element_at(kept, 1)


def dedup_lines(docs: DataFrame, n_lines: str = "__n_lines", n_removed: str = "__n_removed", **options) -> DataFrame:
    """docs with the repeated lines removed from `text`, and two more columns, n_lines and n_removed (underscores go before a name that docs has).

    Lines without a word (blank, punctuation) are never removed, nor is a document: one whose lines all repeat keeps
    its row with what is left of the text.  A null text stays null, with 0 lines.  Rows repeated with the same doc_id
    and text are one document and keep the same lines.  Other columns pass through, whatever their names.
    """
    n_lines, n_removed, gone_, id_, key_, mine_ = free_names(docs.columns, n_lines, n_removed, "gone", "id", "key", "mine")
    gone = repeated_arrays(docs, **options).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), F.col("gone").alias(gone_))
    tagged = docs.withColumn(mine_, F.xxhash64("text"))
    same = (F.col(mine_) == F.col(key_)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    # Few numbers a text: held in a table, so that no text is sorted.
    out = tagged.join(gone.hint("shuffle_hash"), same, "left")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = out.withColumn(n_lines, F.coalesce(breaks + 1, F.lit(0)).cast("bigint"))
    out = out.withColumn(n_removed, F.coalesce(F.size(gone_), F.lit(0)).cast("bigint"))
    out = out.withColumn("text", F.when(F.col(gone_).isNotNull(), without_lines(F.col("text"), F.col(gone_))).otherwise(F.col("text")))
    return out.select(*docs.columns, n_lines, n_removed)
