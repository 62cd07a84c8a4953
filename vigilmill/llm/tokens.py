"""Token counts and token ids of a byte-level BPE vocabulary.

`count_tokens` merges by a heap over a doubly linked list of symbols: the adjacent pair of lowest rank
(leftmost first) is popped again and again; a count is the initial symbols less the merges, and no
identifier is made.  Counts of pre-tokens are remembered in a bounded table of each worker.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
#: Pre-tokens of which counts are remembered by a worker (about 100 bytes each).
REMEMBERED = 1 << 20
LONGEST_REMEMBERED = 64

# The public pre-token pattern of this vocabulary, over ASCII and the letters of Latin-1 and Latin Extended-A.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_OTHER = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u017f]")


def beyond_latin(text: str) -> bool:
    return not text.isascii() and _OTHER.search(text) is not None


def pretokens(text: str) -> list[str]:
    """The pieces within which merges happen.  Texts beyond Latin go to the library's own splitter, whose Unicode tables are fixed by its version."""
    if beyond_latin(text):
        return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]
    return _LATIN.findall(text)


@lru_cache(1)
def _splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_count(piece: bytes, rank: dict[bytes, int]) -> int:
    """Symbols left of one pre-token after all merges."""
    n = len(piece)
    if n < 2 or piece in rank:
        return min(n, 1)  # what the vocabulary holds, it also reaches by merges
    end = list(range(1, n + 1))  # symbol starting at i ends at end[i]; it is followed by the one starting there
    before = list(range(-1, n - 1))
    pair = rank.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:  # one side has been merged since
            continue
        end[i], end[j] = stop, -1
        merges += 1
        if stop < n:
            before[stop] = i
            if (r := pair(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := pair(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return n - merges


class Counter(dict):
    """Token count by pre-token, filled on demand and emptied when full."""

    def __init__(self, path: str):
        self.rank = ranks(path)

    def __missing__(self, piece: str) -> int:
        n = merge_count(piece.encode("utf-8", "replace"), self.rank)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if SPECIAL in text:
            parts = text.split(SPECIAL)
            return len(parts) - 1 + sum(map(self.text, parts))
        return sum(map(self.__getitem__, pretokens(text)))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 1024, ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null and empty texts have 0 of each.

    `ranks_file` is a file of public_tokenizers or a path.  The special string counts as one token, as the tokenizer's
    library has it by default.  Whole texts are counted, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(ranks_file if "/" in ranks_file else tokenizer_path(ranks_file))
        for b in batches:
            n = pa.array([table.text(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
