"""Removal of long passages that repeat anywhere, by column-wise construction of a collection's suffix order.

Each window of `length` bytes has an anchor: the place inside it whose next bytes (a gram) hash lowest. Windows with equal content have
equal anchors at equal offsets, so only segments around equal anchors need comparing. Segments that share an anchor are lined
up there, and their suffix order is built from right to left: each round takes one column (one symbol per segment) in sequence,
which is the Burrows-Wheeler column of the order so far, sorts it stably and carries the common prefixes of neighbours along. A
window repeats if a neighbour shares `length` symbols. Columns are kept in memory: a task has no folder that outlives it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _BYTE, is_empty, mixed, runs, stored

#: Bytes of a window that may not stand twice.
LENGTH = 400
#: Different segments around one anchor that a task compares; anchors with more are split by content first.
GROUP = 16_384
#: Segments in one column-wise construction (whole groups, so at most GROUP more).
BATCH = 8_192
#: Width of the ranges of offsets that segments of larger groups are split into.
RANGE = 32
BATCH_BYTES = 1 << 20
#: Longer texts are looked at in parts, which share all but the first byte of a window.
PART_BYTES = 1 << 26
_PLACE = np.uint64((1 << 28) - 1)
#: Names that columns of docs are unlikely to have.
_D, _T, _S = "_repeats_id_51c2", "_repeats_hash_51c2", "_repeats_spans_51c2"


def gram(length: int) -> int:
    """Bytes that choose an anchor: a power of two, a sixth of a window or less."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def reach(length: int) -> int:
    """An anchor lies at most so far behind a window's start."""
    return length - gram(length)


def anchored(texts: list[bytes], size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of `size` bytes with one anchor: text index, first and last window start, anchor (all in the text), anchor hash."""
    far = reach(size)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.r_[0, np.cumsum(length)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size or not (length >= size).any():
        return none, none, none, none, none
    x = _BYTE[data]
    m, c = 1, 0x9E3779B97F4A7C15
    while m < gram(size):
        x = x[:-m] * np.uint64(c) + x[m:]
        m, c = 2 * m, c * c % 2**64
    x = mixed(x)
    y = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
    m = 1
    while 2 * m <= far + 1:
        y = np.minimum(y[:-m], y[m:])
        m *= 2
    if m < far + 1:
        y = np.minimum(y[: len(y) - (far + 1 - m)], y[far + 1 - m :])
    at = (y & _PLACE).astype(np.int64)
    long = np.flatnonzero(length >= size)
    edge = np.zeros(len(at) + 1, np.int32)
    edge[begin[long]] += 1
    edge[begin[long + 1] - size + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[begin[long]] = True
    lo = np.flatnonzero(valid & new)
    last = np.r_[new[1:] | ~valid[1:], True]
    hi = np.flatnonzero(valid & last)
    doc = np.searchsorted(begin, lo, "right") - 1
    base = begin[doc]
    return doc, lo - base, hi - base, at[lo] - base, x[at[lo]].view(np.int64)


_RECORD = "doc_id long, th long, lo int, hi int, a int, h long, u1 long, u2 long"


def _parts(texts: list[bytes], size: int) -> tuple[list[int], list[int], list[bytes]]:
    """Texts, the very long ones in parts: index, offset and bytes. Each window is in one part."""
    index, offset, out = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), PART_BYTES):
            index.append(i)
            offset.append(at)
            out.append(t if len(t) <= PART_BYTES else t[at : at + PART_BYTES + size - 1])
    return index, offset, out


def _records(base: DataFrame, size: int) -> DataFrame:
    """A row for each run of windows with one anchor; u1 and u2 are a digest of all bytes under them."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "body", BATCH_BYTES):
            index, offset, parts = _parts(texts, size)
            part, lo, hi, a, h = anchored(parts, size)
            views = [memoryview(p) for p in parts]
            digest = b"".join([xxhash.xxh3_128_digest(views[d][i : j + size]) for d, i, j in zip(part.tolist(), lo.tolist(), hi.tolist(), strict=True)])
            u = np.frombuffer(digest, np.int64).reshape(-1, 2)
            rows, shift = pa.array(np.array(index, np.int64)[part]), np.array(offset, np.int64)[part]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array((v + shift).astype(np.int32)) for v in (lo, hi, a)), pa.array(h, pa.int64()), pa.array(u[:, 0]), pa.array(u[:, 1])], ["doc_id", "th", "lo", "hi", "a", "h", "u1", "u2"])

    return base.select("doc_id", "th", "body").mapInArrow(compute, _RECORD)


def repeated_starts(segments: list[bytes], lead: np.ndarray, group: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """For segments lined up at their anchors (`lead` bytes into each) and sorted by group: a boolean row per offset d from 0 to
    reach(size) and a column per segment, true where the window that starts d bytes before the anchor repeats in its group."""
    n = len(segments)
    found = np.zeros((reach(size) + 1, n), bool)
    width = np.fromiter(map(len, segments), np.int64, n)
    right = int((width - lead).max())
    left = int(lead.max())
    # a row per column of symbols (0: none), from right to left
    columns = np.zeros((left + right, n), np.uint16)
    for first in range(0, n, 1024):
        block = np.zeros((min(1024, n - first), left + right), np.uint16)
        for i, row in enumerate(block, first):
            at = left - int(lead[i])
            row[at : at + width[i]] = np.frombuffer(segments[i], np.uint8) + np.uint16(1)
        columns[:, first : first + len(block)] = block.T[::-1]
    order = np.arange(n)
    common = np.zeros(n + 1, np.int16)
    start = np.r_[True, group[1:] != group[:-1]]
    common[:-1][start] = -1
    number = np.cumsum(start).astype(np.int64) << 9
    for k in range(left + right):
        bwt = number + columns[k][order]
        if (bwt[1:] >= bwt[:-1]).all():
            same = bwt[1:] == bwt[:-1]
            common[1:n] = np.where(same, np.minimum(common[1:n] + 1, size), np.where(start[1:], -1, 0))
        else:
            rank = np.argsort(bwt, kind="stable")
            bwt = bwt[rank]
            same = np.flatnonzero(bwt[1:] == bwt[:-1])
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = rank[same] + 1, rank[same + 1] + 1
            fresh = np.zeros(n + 1, np.int16)
            fresh[:-1][start] = -1
            if len(same):
                fresh[same + 1] = np.minimum(np.minimum.reduceat(common, between)[::2] + 1, size)
            common, order = fresh, order[rank]
        d = k - (right - 1)
        if d >= 0:
            hit = common >= size
            found[d, order] = hit[:-1] | hit[1:]
    return found


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


_RESULT = "h long, u1 long, u2 long, first array<int>, last array<int>"


def _compare(segments: DataFrame, size: int) -> DataFrame:
    """Repeated windows of each segment, by offsets from its start: groups of h, in batches of whole groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], np.int64)
        lead = np.array([r[3] for r in rows], np.int64)
        seg = [r[4] for r in rows]
        found = repeated_starts(seg, lead, h, size)
        out: list[list] = [[], [], [], [], []]
        for i, r in enumerate(rows):
            n = len(seg[i]) - size + 1  # windows; the one at offset p from the start is d = lead - p
            hit = found[lead[i] - n + 1 : lead[i] + 1, i][::-1]
            if hit.any():
                a, b = _spans(np.ascontiguousarray(hit))
                for o, v in zip(out, (*r[:3], a, b), strict=True):
                    o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["h", "u1", "u2", "first", "last"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[0] != held[-1][0]:
                    seen.clear()
                    if len(held) >= BATCH:
                        yield solve(held)
                        held = []
                if r[1:3] not in seen:  # repeated rows of one document bring a segment twice
                    seen.add(r[1:3])
                    held.append(r)
        if held:
            yield solve(held)

    return segments.select("h", "u1", "u2", F.expr("a - lo").alias("lead"), "seg").repartition("h").sortWithinPartitions("h").mapInArrow(compute, _RESULT)


def _split(segments: DataFrame, size: int) -> DataFrame:
    """The same result for anchors with more different segments than a task takes, by hashes that aggregate before a shuffle.

    Segments are split into ranges of RANGE offsets. All windows of a range share a core; ranges that share a core with others
    of the same content repeat if there are two; where contents differ, each window is counted by its own digest.
    """

    def hash2(x) -> tuple[int, int]:
        d = xxhash.xxh3_128_intdigest(x)
        return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, u1, u2, c, lead, seg in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(seg) - size + 1
                for j in range((lead - n + 1) // RANGE, lead // RANGE + 1):
                    d1, d2 = j * RANGE, min((j + 1) * RANGE - 1, reach(size))
                    low, high = max(d1, lead - n + 1), min(d2, lead)
                    core = hash2(memoryview(seg)[max(lead - d1, 0) : lead - d2 + size])
                    own = hash2(memoryview(seg)[lead - high : lead - low + size])
                    out.append((h, u1, u2, c, j, low, high, lead, *core, *own, seg[lead - high : lead - low + size]))
            names = ["h", "u1", "u2", "c", "j", "low", "high", "lead", "k1", "k2", "o1", "o2", "bytes"]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.int64()] * 4 + [pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names)

    schema = "h long, u1 long, u2 long, c long, j int, low int, high int, lead int, k1 long, k2 long, o1 long, o2 long, bytes binary"
    part = stored(segments.select("h", "u1", "u2", "c", F.expr("a - lo").alias("lead"), "seg").mapInArrow(ranges, schema).dropDuplicates(["h", "u1", "u2", "j"]), "ranges")
    key = ["h", "j", "k1", "k2"]
    own = F.struct("o1", "o2")
    load = part.groupBy(*key).agg(F.sum("c").alias("all_c"), (F.min(own) == F.max(own)).alias("alike"))
    known = part.join(load, key)
    whole = known.where("alike and all_c >= 2").selectExpr("h", "u1", "u2", "lead - high as first", "lead - low as last")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, u1, u2, c, high, lead, seg in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for i in range(len(seg) - size + 1):
                    out.append((h, u1, u2, c, lead - high + i, high - i, *hash2(memoryview(seg)[i : i + size])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["h", "u1", "u2", "c", "at", "d", "w1", "w2"])

    each = stored(known.where("not alike").select("h", "u1", "u2", "c", "high", "lead", "bytes").mapInArrow(windows, "h long, u1 long, u2 long, c long, at int, d int, w1 long, w2 long"), "windows")
    often = each.groupBy("h", "d", "w1", "w2").agg(F.sum("c").alias("n")).where("n >= 2")
    single = each.join(often, ["h", "d", "w1", "w2"], "left_semi").selectExpr("h", "u1", "u2", "at as first", "at as last")
    spans = whole.unionByName(single).groupBy("h", "u1", "u2").agg(F.collect_list(F.struct("first", "last")).alias("s"))
    return spans.selectExpr("h", "u1", "u2", "s.first as first", "s.last as last")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int | None = None, spans: str = "spans") -> DataFrame:
    """docs with the column `spans`: for each row, array<struct<first,last>> of starts of `length`-byte strings that start elsewhere too.

    Whole texts as UTF-8 bytes; null text is empty; matches never cross rows. Rows count as places of their own, so a repeated
    row repeats wholly. Starts are from 0, ranges are inclusive and may touch. Texts under `length` bytes have an empty array. An
    empty table gives an empty one. A column of docs that is named like `spans` is replaced; all others stay.
    """
    group = GROUP if group is None else group
    docs = docs.drop(spans)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")).withColumn("th", F.xxhash64("body"))
    records = stored(_records(base, length), "anchors")
    # written first, so that both sides of the join are dealt out anew and a very common anchor's rows can be split
    twice = stored(records.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").select("h"), "twice")
    shared = stored(records.join(twice, "h", "left_semi"), "shared")
    place = F.struct("doc_id", "th", "lo", "hi", "a")
    distinct = stored(shared.groupBy("h", "u1", "u2").agg(F.count("*").alias("c"), F.min(place).alias("p")).select("h", "u1", "u2", "c", "p.*"), "segments")
    different = stored(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2"), "different")
    open_ = distinct.join(different, "h")
    texts = base.where(F.octet_length("body") >= length)
    segments = stored(open_.join(texts.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("h", "u1", "u2", "n", "c", "a", "lo", F.expr(f"substring(cast(body as binary), lo + 1, hi - lo + {length})").alias("seg")), "texts")
    found = _compare(segments.where(F.col("n") <= group), length)
    large = segments.where(F.col("n") > group)
    if not is_empty(large):
        found = found.unionByName(_split(large, length))
    whole = distinct.where("c >= 2").selectExpr("h", "u1", "u2", "array(0) as first", "array(hi - lo) as last")
    parts = found.join(distinct.where("c = 1").select("h", "u1", "u2"), ["h", "u1", "u2"], "left_semi")
    hits = shared.join(stored(whole.unionByName(parts), "hits"), ["h", "u1", "u2"])
    ranges = hits.select("doc_id", "th", F.expr("transform(arrays_zip(first, last), x -> named_struct('first', lo + x.first, 'last', lo + x.last))").alias("s")).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias(spans))
    keyed = docs.withColumns({_D: F.col(doc_id).cast("long"), _T: F.xxhash64(F.col(text).cast("string"))})
    ranges = ranges.withColumnsRenamed({"doc_id": f"{_D}_", "th": f"{_T}_"})
    out = keyed.join(ranges, F.col(_D).eqNullSafe(F.col(f"{_D}_")) & (F.col(_T) == F.col(f"{_T}_")), "left")
    return out.select(*docs.columns, F.coalesce(spans, F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias(spans))


def removed(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) under the windows that start in the ranges."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(first.tolist(), (last + length).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the runs."""
    out, at = [], 0
    for a, z in gone:
        out.append(text[at:a])
        at = z
    out.append(text[at:])
    return b"".join(out)


def passages(text: bytes, gone: list[tuple[int, int]], words: int, size: int) -> list[tuple[int, int]]:
    """Of the runs, those that touch so many words or have so many bytes, without the parts of words at their ends."""
    out = []
    for a, z in gone:
        if z - a >= size or len(text[a:z].split()) >= words:
            whole = text[a:z]
            if a and not text[a - 1 : a].isspace() and (rest := whole.lstrip(_BLACK)):
                whole = rest
            a = z - len(whole)
            if z < len(text) and not text[z : z + 1].isspace() and (rest := whole.rstrip(_BLACK)):
                whole = rest
            out.append((a, a + len(whole)))
    return out


#: Every byte but white space (0x20, 0x09-0x0D).
_BLACK = bytes(b for b in range(256) if not bytes([b]).isspace())


def _ranges(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    col = part.column(part.schema.get_field_index(_S))
    at = np.array(col.offsets)
    flat = col.values
    first, last = np.asarray(flat.field("first"))[: len(flat)], np.asarray(flat.field("last"))[: len(flat)]
    for i in range(len(part)):
        yield first[at[i] : at[i + 1]], last[at[i] : at[i + 1]]


def removal_digest(docs: DataFrame, *, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, the SHA-256 of what is left, and the runs removed as array<struct<start,end>>."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    kinds = [pa.int64(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, "text", BATCH_BYTES):
            out = []
            for t, (first, last) in zip(texts, _ranges(part), strict=True):
                gone = removed(first, last, length)
                out.append((len(t), sum(z - a for a, z in gone), len(gone), hashlib.sha256(cut(t, gone)).hexdigest(), [{"start": a, "end": z} for a, z in gone]))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    found = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length=length, spans=_S, **options).select("doc_id", "text", _S)
    return found.mapInArrow(compute, schema)


def without_repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, words: int = 0, size: int = 0, **options) -> DataFrame:
    """docs with the text cut, and n_chars, where there is such a column, set to its code points.

    Runs that repeat by windows of `length` bytes go; with `words`, only those that touch so many words, or have `size` bytes, and
    words that stand in them only in part stay. Parts of code points at the cuts go too. A null text stays null. Rows stay even
    where nothing of their text is left, and so do all other columns.
    """
    found = repeated_spans(docs, text=text, length=length, spans=_S, **options)
    schema = T.StructType([f for f in found.schema if f.name != _S])
    at = docs.columns.index(text)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, text, BATCH_BYTES):
            kept = []
            for t, null, (first, last) in zip(texts, part.column(at).is_null().to_pylist(), _ranges(part), strict=True):
                gone = removed(first, last, length)
                if words:
                    gone = passages(t, gone, words, size or 1 << 62)
                kept.append(None if null else cut(t, gone).decode("utf-8", "ignore") if gone else t.decode())
            cols = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name != _S]
            cols[at] = pa.array(kept, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    out = found.select(*docs.columns, _S).mapInArrow(compute, schema)
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))) if "n_chars" in docs.columns else out
