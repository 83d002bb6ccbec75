"""Packing of token ids into windows of several sizes."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import runs
from .tokens import encoder

WINDOW = 2048
#: Context sizes, each a power of two; a sequence of such a size is not padded.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids of a step group: windows of any tier, equal in sum.
STEP_IDS = 8 * WINDOW
BATCH_BYTES = 1 << 20
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, window int, step_group long, ids binary"
Piece = tuple[int, int, int]


class Packer:
    """Packs documents into windows that are full; only close() leaves sequences of smaller powers of two.

    Documents longer than the largest window are cut into such windows and a tail. What is left goes to the smallest tier that
    takes it. Each tier is packed by itself, the largest first: its longest item opens a window, and the gap takes the longest
    items that fit, of its own tier, then of shorter ones, then the head of one more, whose rest goes back to its tier.
    """

    def __init__(self) -> None:
        #: By tier: (length, order, document, start), ascending.
        self.pools: list[list[tuple[int, int, int, int]]] = [[] for _ in TIERS]
        self.count = self.held = 0

    def add(self, document: int, length: int) -> Iterator[list[Piece]]:
        at = 0
        while length - at >= WINDOW:
            yield [(document, at, WINDOW)]
            at += WINDOW
        if length > at:
            self._put(length - at, document, at)

    def _put(self, length: int, document: int, start: int) -> None:
        insort(self.pools[self._tier(length)], (length, self.count, document, start))
        self.count += 1
        self.held += length

    @staticmethod
    def _tier(length: int) -> int:
        return next(k for k, t in enumerate(TIERS) if length <= t)

    def _fill(self, window: int) -> list[Piece]:
        """A window of items, the longest that fit first; if none fits whole, the longest held gives its head."""
        gap, out = window, []
        while gap:
            k = self._tier(gap)
            while k >= 0:
                pool = self.pools[k]
                i = bisect_right(pool, (gap, 1 << 62)) - 1
                if i >= 0:
                    break
                k -= 1
            if k < 0:
                pool = next(p for p in reversed(self.pools) if p)
                length, _, document, start = pool.pop()
                self.held -= length
                out.append((document, start, gap))
                self._put(length - gap, document, start + gap)
                return out
            length, _, document, start = pool.pop(i)
            self.held -= length
            out.append((document, start, length))
            gap -= length
        return out

    def flush(self) -> Iterator[list[Piece]]:
        """Full windows of each tier, as long as the items held fill the largest."""
        for k in reversed(range(len(TIERS))):
            while self.pools[k] and self.held >= WINDOW:
                yield self._fill(TIERS[k])

    def close(self) -> Iterator[list[Piece]]:
        yield from self.flush()
        while self.held:
            yield self._fill(min(WINDOW, 1 << (self.held.bit_length() - 1)))


class Steps:
    """Deals sequences, whose sizes are powers of two, to groups of exactly STEP_IDS ids; only the last may be smaller.

    Of what is held, the largest come first. Their sum so far is a multiple of the size at hand, so it meets STEP_IDS.
    """

    def __init__(self) -> None:
        self.sequences: list[list[Piece]] = []
        self.held = 0

    def add(self, sequence: list[Piece]) -> None:
        self.sequences.append(sequence)
        self.held += sum(p[2] for p in sequence)

    def groups(self, last: bool = False) -> Iterator[list[list[Piece]]]:
        if self.held < STEP_IDS and not last:
            return
        self.sequences.sort(key=lambda s: -sum(p[2] for p in s))
        at = 0
        while self.held >= STEP_IDS or (last and self.held):
            room, first = min(STEP_IDS, self.held), at
            while room:
                room -= sum(p[2] for p in self.sequences[at])
                at += 1
            self.held -= min(STEP_IDS, self.held)
            yield self.sequences[first:at]
        self.sequences = self.sequences[at:]


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, specials_as_text: bool = False) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, window, step_group, ids (binary).

    A document's ids are those of its whole text (null: none) and end_id; each is in exactly one piece. Pieces follow each other
    in a sequence from offset 0; a sequence's size is a power of two (`window`), so nothing is padded. Step groups hold
    STEP_IDS ids each, but for the last of a partition. ids are little-endian unsigned 32-bit integers. Strings of special
    tokens in a text give their ids, as in the library, unless specials_as_text.

    Partitions are packed on their own, so nothing is shuffled; ids of sequences and groups tell the partition. A task keeps what
    fills less than a window and a step group. Rows keep their doc_id as it is, null and repeated ones too; further columns are
    left out. No rows give no pieces. Ids of sequences depend on the order of rows: write the pieces before using them twice.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, specials_as_text).encode
        packer, steps, ids, ident = Packer(), Steps(), {}, {}
        left: dict[int, int] = {}
        serial = step = TaskContext.get().partitionId() << 36
        n = 0

        def rows(groups: list[list[list[Piece]]]) -> pa.RecordBatch:
            nonlocal serial, step
            parts, cols = [], [[] for _ in range(8)]
            for group in groups:
                for pieces in group:
                    window, at = sum(p[2] for p in pieces), 0
                    for d, start, length in pieces:
                        own = ids[d]
                        parts.append(own[start : start + length])
                        for c, v in zip(cols, (ident[d], start, length, len(own), serial, at, window, step), strict=True):
                            c.append(v)
                        at += length
                        left[d] -= length
                        if not left[d]:
                            del ids[d], ident[d], left[d]
                    serial += 1
                step += 1
            flat = np.concatenate(parts).astype("<u4", copy=False)
            ends = np.r_[0, 4 * np.cumsum(cols[2])].astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), binary], names)

        for part, texts in runs(batches, text, BATCH_BYTES):
            flat, size = encode(texts)
            ends = np.cumsum(size + 1)
            flat = np.insert(flat, np.cumsum(size), end_id)
            for key, a, b in zip(part.column(0).to_pylist(), (ends - size - 1).tolist(), ends.tolist(), strict=True):
                ids[n], ident[n], left[n] = flat[a:b], key, b - a
                for sequence in packer.add(n, b - a):
                    steps.add(sequence)
                n += 1
            for sequence in packer.flush():
                steps.add(sequence)
            if groups := list(steps.groups()):
                yield rows(groups)
            for d in ids:  # what waits keeps its own ids alone, not the batch's
                ids[d] = ids[d].copy() if ids[d].base is not None else ids[d]
        for sequence in packer.close():
            steps.add(sequence)
        if groups := list(steps.groups(last=True)):
            yield rows(groups)

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as `{text}`").mapInArrow(compute, _PIECE)
