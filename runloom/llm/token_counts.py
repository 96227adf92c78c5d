"""Operator 10, token counts: byte-pair merging with a heap over a linked list.

Every pre-token is a linked list of byte symbols.  A heap holds the adjacent pairs by rank and place; the lowest is
popped and joined as long as it is still there, which is one token less.  The count is the number of symbols minus the
merges, so no identifiers are made.  Counts of pre-tokens are remembered in a table of bounded size per worker.

Null and empty texts have no tokens.  Special strings inside a text count one token, as the library does by default.
Repeated rows are counted alike, one result row each; texts of any length are counted whole; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._gpt_bytes import BYTE_SYMBOLS
from ._recent import Recent

#: Pre-tokens that a generation of a worker's memory holds
WORDS = 150_000
# Fixed pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter(Recent):
    """Number of tokens by pre-token."""

    def __init__(self, path: str) -> None:
        import regex

        super().__init__(WORDS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.find = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.held = special

    def make(self, word: str) -> int:
        return self.merged(word.encode("utf-8"))

    def merged(self, raw: bytes) -> int:
        symbols = [BYTE_SYMBOLS[b] for b in raw]
        n = len(symbols)
        if n < 2:
            return n
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.held):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to the other columns of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file on every machine.  Rows keep their number; a column of ``docs``
    with one of the three names is replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(vocabulary) or _counters.setdefault(vocabulary, Counter(vocabulary))
        for batch in batches:
            column = pc.fill_null(batch.column(len(rest)), "")
            counts = pa.array([counter.count(x.as_py()) for x in column], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.cast(pc.binary_length(column), pa.int64()), counts], [*rest, "n_bytes", "n_tokens"])

    schema = StructType([*(source.schema[c] for c in rest), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
