"""Hierarchical packing of tokenised documents into several context sizes.

Every document is cut into whole windows of the longest context and a rest, and the rest is routed to the smallest tier that
holds it.  Each tier is packed from its own rests, the longest tier first: a rest opens a window, and its gap is filled from
shorter tiers, by the longest rest that fits whole.  A tier lends at most `LENT` of its tokens to longer ones, so that it
keeps documents to pack itself; a gap that nothing lent fits is closed by cutting a piece from the tier's own next rest, which
then goes to the tier of what is left of it.  Windows that cannot be filled go on to the next buffer and, at the end
of the task, are cut at powers of two, so that no window is padded.

Windows of one tier form step groups of equal token counts.  What the tiers have left over at the end of a task is dealt to
mixed groups, the longest window first, each to the group of fewest tokens, so that these are balanced too.

All happens in one pass over each partition with a buffer of bounded size: nothing is shuffled and no task
sees more than its own partition.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.tokens import SPECIAL, beyond_latin, ranks, tokenizer_path

TIERS = (128, 256, 512, 1024)
#: Tokens held by a task before it packs what it holds.
BUFFER_TOKENS = 1 << 20
#: Share of a tier's tokens in a buffer that may fill gaps of longer tiers.
LENT = 0.5
#: Tokens of a step group: 16 windows of 1024, 128 of 128.
STEP_TOKENS = 16 * 1024

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, "
    "tier int, step_group bigint"
)


class Encoder:
    """Token ids as little-endian 32-bit bytes, those of the tokenizers file.

    The rank file of the same vocabulary encodes Latin texts several times faster; other texts go to the
    tokenizers library, whose Unicode tables decide where they are split.
    """

    def __init__(self, json_file: str, rank_file: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(rank_file), special_tokens={})

    def __call__(self, text: str | None, closing: int = 0) -> bytes:
        if not text:
            ids = []
        elif beyond_latin(text) or SPECIAL in text:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(closing)
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()


@lru_cache(2)
def encoder(json_file: str, rank_file: str) -> Encoder:
    return Encoder(json_file, rank_file)


class Packer:
    """Pieces are (document, start, length); a document is any key; finished windows are (tier, pieces)."""

    def __init__(self, tiers=TIERS, lent: float = LENT):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers: ascending powers of two")
        self.tiers, self.lent = tuple(tiers), lent
        #: By tier: (length, start, document), ascending.
        self.rests: dict[int, list[tuple[int, int, object]]] = {t: [] for t in self.tiers}

    def held(self) -> int:
        return sum(r[0] for rests in self.rests.values() for r in rests)

    def add(self, document, tokens: int) -> Iterator[tuple[int, list]]:
        most = self.tiers[-1]
        for k in range(tokens // most):
            yield most, [(document, k * most, most)]
        if tokens % most:
            self._put(document, tokens - tokens % most, tokens % most)

    def _put(self, document, start: int, length: int) -> None:
        insort(self.rests[next(t for t in self.tiers if t >= length)], (length, start, document), key=_length)

    def _take(self, tier: int, at: int, room: int) -> tuple[object, int, int]:
        """The rest at a place, or its first `room` tokens; what is left of it goes back."""
        length, start, document = self.rests[tier].pop(at)
        if length > room:
            self._put(document, start + room, length - room)
            length = room
        return document, start, length

    def _filling(self, tier: int, room: int, lendable: dict[int, float]) -> tuple[int, int] | None:
        """(tier, place) of what goes into a gap next: the longest that fits whole, else one to cut; shorter tiers within what they lend."""
        own = self.rests[tier]
        at = bisect_right(own, room, key=_length) - 1
        if at >= 0:
            return tier, at
        for t in reversed(self.tiers[: self.tiers.index(tier)]):
            at = bisect_right(self.rests[t], min(room, lendable[t]), key=_length) - 1
            if at >= 0:
                lendable[t] -= self.rests[t][at][0]
                return t, at
        if own:
            return tier, 0
        for t in self.tiers[: self.tiers.index(tier)]:
            if self.rests[t] and lendable[t] >= room:
                lendable[t] -= room
                return t, 0
        return None

    def pack(self) -> Iterator[tuple[int, list]]:
        """Windows of the rests held; what fills no window stays held."""
        lendable = {t: self.lent * sum(map(_length, rests)) for t, rests in self.rests.items()}
        for tier in reversed(self.tiers):
            own = self.rests[tier]
            while own:
                pieces, room = [], tier
                length, start, document = own.pop()  # the longest opens the window
                pieces.append((document, start, length))
                room -= length
                while room and (found := self._filling(tier, room, lendable)):
                    pieces.append(self._take(*found, room))
                    room -= pieces[-1][2]
                if room:
                    for document, start, length in pieces:
                        self._put(document, start, length)
                    break
                yield tier, pieces

    def finish(self) -> Iterator[tuple[int, list]]:
        """All windows; the last of them at powers of two."""
        yield from self.pack()
        rests = sorted((r for found in self.rests.values() for r in found), key=_length)
        for t in self.tiers:
            self.rests[t] = []
        while total := sum(map(_length, rests)):
            room = tier = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            pieces = []
            while room:
                length, start, document = rests.pop()
                taken = min(length, room)
                if length > taken:
                    rests.append((length - taken, start + taken, document))
                pieces.append((document, start, taken))
                room -= taken
            yield tier, pieces


def _length(rest: tuple) -> int:
    return rest[0]


def balanced(sizes: list[int], most: int) -> list[int]:
    """The group of each of some windows: as few groups of `most` tokens as hold them, each window (longest first) in the group of fewest tokens."""
    groups = [0] * max(1, -(-sum(sizes) // most))
    found = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        g = groups.index(min(groups))
        groups[g] += sizes[i]
        found[i] = g
    return found


def pack_documents(
    docs: DataFrame,
    tiers=TIERS,
    json_file: str = "byte_bpe_50k.json",
    rank_file: str = "byte_bpe_50k.tiktoken",
    closing: int = 0,
    buffer_tokens: int = BUFFER_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece (see SCHEMA); a null or empty text is the closing id alone.

    sequence_id has the task's partition in its upper bits, so it is unique without any exchange and the same
    when a lost task is run again over the same partition.  Repeated rows are packed as rows of their own; other columns
    are not read.  step_group is unique likewise; the groups of one tier have `step_tokens` tokens each.
    """
    files = [f if "/" in f else None for f in (json_file, rank_file)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files[0] or tokenizer_path(json_file), files[1] or tokenizer_path(rank_file))
        base = TaskContext.get().partitionId() << 40
        packer, ids, names, used = Packer(tiers), {}, {}, {}
        out: list[list] = [[] for _ in range(9)]
        number = step = serial = 0
        waiting: dict[int, list[list[tuple]]] = {}  # by tier: rows of the windows of its open step group

        def emit(windows) -> None:
            nonlocal number
            for tier, pieces in windows:
                sequence, at, rows = base | number, 0, []
                number += 1
                for key, start, length in pieces:
                    raw, (doc_id, tokens) = ids[key], names[key]
                    rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), tokens, sequence, at, tier))
                    at += length
                    used[key] = used.get(key, 0) + length
                    if used[key] == tokens:
                        del ids[key], names[key], used[key]
                group = waiting.setdefault(tier, [])
                group.append(rows)
                if len(group) * tier >= step_tokens:
                    close([waiting.pop(tier)])

        def close(groups: list[list[list[tuple]]]) -> None:
            nonlocal step
            for group in groups:
                for rows in group:
                    for row in rows:
                        for column, value in zip(out, (*row, base | step)):
                            column.append(value)
                step += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0].strip("`") for x in SCHEMA.split(", ")])
            for column in out:
                column.clear()
            return batch

        held = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = memoryview(encode(text, closing))
                tokens = len(raw) // 4
                ids[serial], names[serial] = raw, (doc_id, tokens)
                held += tokens
                emit(packer.add(serial, tokens))
                serial += 1
                if held >= buffer_tokens:
                    emit(packer.pack())
                    held = packer.held()
                    if out[0]:
                        yield flush()
        emit(packer.finish())
        left = [rows for tier in sorted(waiting) for rows in waiting[tier]]
        sizes = [sum(r[2] for r in rows) for rows in left]
        groups: dict[int, list] = {}
        for rows, g in zip(left, balanced(sizes, step_tokens)):
            groups.setdefault(g, []).append(rows)
        close(list(groups.values()))
        if out[0]:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
