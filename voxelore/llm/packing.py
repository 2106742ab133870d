"""Token packing by bounded-space online best-fit.

Documents become token ids with an end mark; only those longer than a sequence are cut, the first piece taking the
remainder so that all others are full. Full pieces are sequences of their own. The other pieces are dealt at random into
packers of bounded size; each packer keeps a fixed number of open bins in a bitset keyed by free space, puts a piece in
the bin with the least room that still holds it and, when it needs a further bin, closes the fullest.

Token ids come from the vocabulary and rules of `byte_bpe_50k.json`. A token never spans a space that precedes a visible
character, so texts are split at such spaces and the parts' ids are remembered; parts not seen yet go to the ranked form of
the same vocabulary. The string of the special token is one id, as in the library. A test holds both against the `tokenizers` library.

Defined cases: a null text is the empty text, which is the end mark alone. Null ids and repeated ids are packed like any
other row. An empty table gives no pieces. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelore.llm.store import written

CAPACITY, END_ID, OPEN_BINS, PACKER_PIECES = 1024, 2, 1024, 50_000
#: Parts of texts that a worker remembers at most; beyond that it starts afresh.
MEMO = 400_000
#: The vocabulary's special token, and its id as it is written.
SPECIAL, SPECIAL_ID = "<|endoftext|>", np.array([50_256], "<u4").tobytes()
_UNSAFE = re.compile(r" (?=\s|\Z)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.opens = np.zeros(self.encoding.n_vocab, bool)  # ids of tokens that begin with a space
        self.opens[[k for b, k in ranks.items() if b[:1] == b" "]] = True
        self.memo: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = np.array(self.encode(part), "<u4").tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:  # the library takes it out before anything else
            return SPECIAL_ID.join([self(part) if part else b"" for part in text.split(SPECIAL)])
        if _UNSAFE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get, own = self.memo.get, self._part
        # A part's key has the space before it, which belongs to its first token.
        return np.array(self.encode(first), "<u4").tobytes() + b"".join([get(w) or own(w) for w in [" " + w for w in rest]])


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids(text or "") + end
                for k, (at, n) in enumerate(_cut(len(data) // 4, capacity)):
                    for col, value in zip(cols, (doc, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_pieces(path or vocabulary_path(), capacity, end_id), PIECES)


class BestFit:
    """Bins open for more, at most `limit`, in a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        at = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return at

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        if fits := self.free >> length:
            space = length + ((fits & -fits).bit_length() - 1)
            at = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            at, space = self.made, self.capacity
            self.made += 1
        if left := space - length:
            self.by_free[left].append(at)
            self.free |= 1 << left
            self.open += 1
        return at, self.capacity - space


def _packer(capacity: int, limit: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins = BestFit(capacity, limit)
        placed = np.array([bins.put(n) for n in group["length"].tolist()], np.int64).reshape(-1, 2)
        # Packers number their sequences apart: the packer's number above, the bin's below.
        group["sequence_id"] = (group["packer"].to_numpy(np.int64) << 32) | placed[:, 0]
        group["offset"] = placed[:, 1]
        return group.drop(columns=["packer", "order"])

    return pack


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    packer_pieces: int = PACKER_PIECES,
    path: str | None = None,
) -> DataFrame:
    """Pieces with sequence_id and offset. Texts are read and tokenised once; only narrow rows are shuffled."""
    rows = written(pieces(docs, id_col, text_col, capacity, end_id, path), "pieces")
    short = rows.where(F.col("length") < capacity)
    packers = max(1, -(-short.count() // packer_pieces))
    short = short.select("*", F.xxhash64("doc_id", "piece", "ids_crc32").alias("order"))
    short = short.withColumn("packer", F.pmod(F.col("order"), F.lit(packers)))
    schema = f"{PIECES}, sequence_id long, offset long"
    packed = short.groupBy("packer").applyInPandas(_packer(capacity, open_bins), schema)
    full = rows.where(F.col("length") == capacity)
    # Negative numbers, unique in the written table, for sequences that a single piece fills.
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
