"""Repeated byte strings across documents, by sparse distributed prefix doubling.

Prefix doubling ranks every position by its first bytes, sorts pairs of ranks at growing offsets, ranks again, and
leaves out what has become unique.  A row a byte and round would take some twenty times the input on disk, so positions
are ranked in runs:

1. Each window of ``length`` bytes is ranked first by its anchor, the ``ANCHOR``-gram in it with the lowest hash (the
   leftmost of equals).  The hash itself is made by doubling: the rank of 2h bytes from the pair of ranks at offset h.
   Equal windows have equal anchors at equal offsets, so neighbouring windows with one anchor are one run, and a run is
   one row.  Runs with an anchor of their own are unique and leave; where all runs of an anchor are alike, all their
   windows repeat.
2. The other runs are cut by the window's offset from the anchor into narrower and narrower cells.  The windows of a cell
   share a core, which grows from the anchor to the whole window; the rank of a longer core decides as before: unique
   cells leave, cells that are wholly alike repeat, and the rest are cut again until a cell is one window.

So each round handles a few rows for each end of a repeated passage, whatever its length, and nothing is sampled: every
window of every document has its place in exactly one run.  Ranks are digests of 128 bits (a hash of 64 bits beside one of 64 bits for whole
runs), which Spark groups; counts are summed before they are shuffled, and joins by a rank can be split where one is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import forget, release, settle, small_batches, text_or_empty

#: Bytes whose runs are worked out together.
SEGMENT = 1 << 20
#: Windows whose anchors are found together: their places must fit in 16 bits.
STEP = 48_000
#: Different runs that a task counts before it sends them on.
KEPT_RUNS = 50_000
#: Bits of a run's length and of its anchor's offset, beside its place.
BITS = 12
_BYTE = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64)
_PLACE = np.uint64(0xFFFF)
#: A digest is moved by so much times an offset (a seed would do for long strings only).
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


def anchor_length(length: int) -> int:
    """Bytes of an anchor: a power of two, about a sixth of the window."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def widths(length: int) -> list[int]:
    """How many offsets a cell spans in each round; one in the last."""
    width, out = -(-(length - anchor_length(length) + 1) // 2), []
    while width > 1:
        out.append(width)
        width = 1 if width <= 8 else -(-width // 4)
    return [*out, 1]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from each place on, by doubling."""
    h, step = _BYTE[data], 1
    while step < size:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _anchors(hashes: np.ndarray, windows: int, span: int) -> np.ndarray:
    """For each window, the place of the lowest of its ``span`` hashes."""
    out, places = np.empty(windows, np.int64), np.arange(STEP + span, dtype=np.uint64)
    for at in range(0, windows, STEP):
        n = min(STEP, windows - at)
        low = (hashes[at : at + n + span - 1] & ~_PLACE) | places[: n + span - 1]
        seen = 1
        while seen * 2 <= span:
            low = np.minimum(low[:-seen], low[seen:])
            seen *= 2
        low = np.minimum(low[:n], low[span - seen : span - seen + n])
        out[at : at + n] = (low & _PLACE).astype(np.int64) + at
    return out


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows in texts that lie end to end in ``data``, cut at ``bounds``: text number, place in it, windows, anchor's offset, anchor's hash."""
    size = anchor_length(length)
    span, found = length - size + 1, []
    for at in range(0, len(data), SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        windows = len(piece) - length + 1
        if windows < 1:
            break
        first, last = np.minimum(np.searchsorted(bounds, [at, at + windows], "right") - 1, len(bounds) - 2)
        begin = np.maximum(bounds[first : last + 1] - at, 0)
        end = np.minimum(bounds[first + 1 : last + 2] - at - length + 1, windows)
        begin, end = begin[end > begin], end[end > begin]
        steps = np.zeros(windows + 1, np.int32)
        np.add.at(steps, begin, 1)
        np.add.at(steps, end, -1)
        inside = np.cumsum(steps[:-1]) > 0
        hashes = gram_hashes(piece, size)
        anchors = _anchors(hashes, windows, span)
        breaks = ~inside
        breaks[begin] = True
        breaks[1:] |= anchors[1:] != anchors[:-1]
        heads = np.flatnonzero(breaks & inside)
        ends = np.append(np.flatnonzero(breaks), windows)
        count = ends[np.searchsorted(ends, heads, "right")] - heads
        text = np.searchsorted(bounds, heads + at, "right") - 1
        found.append((text, heads + at - bounds[text], count, anchors[heads] - heads, hashes[anchors[heads]].view(np.int64)))
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 5))


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and the last ends."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (value >> 63 << 64)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, run): of every run, its anchor's hash and the digest of all its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _laid_out(batch.column(0))
            text, at, count, offset, anchor = runs(data, bounds, length)
            view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
            begin = at + bounds[text]
            said = np.array([digest(view[b:e]) for b, e in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)], np.uint64)
            said += offset.astype(np.uint64) * _SHIFT
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(said.view(np.int64), pa.int64())], ["anchor", "run"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(work, "anchor bigint, run bigint")


def _place_rows(docs: DataFrame, length: int) -> DataFrame:
    """(text_key, anchors, places): of every text, its runs' anchors and packed places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _laid_out(batch.column(0))
            text, at, count, offset, anchor = runs(data, bounds, length)
            view = memoryview(np.ascontiguousarray(data))
            keys = [xxhash.xxh3_128_digest(view[b:e]) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            ends = pa.array(np.searchsorted(text, np.arange(len(keys) + 1)), pa.int32())
            place = (at << (2 * BITS)) | (count << BITS) | offset
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (anchor, place)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *lists], ["text_key", "anchors", "places"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(work, "text_key binary, anchors array<bigint>, places array<bigint>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed): the texts in short, to be shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, bounds = _laid_out(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            texts = [view[b:e] for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            out = [batch.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "packed"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key binary, packed binary")


_UNIT = "unit binary, many bigint, at bigint, count int, offset int, bytes binary, text_key binary"


def _units(texts: DataFrame, length: int) -> DataFrame:
    """Of texts with undecided runs (text_key, packed, places): rows of the runs (with bytes and how often each was seen) and of where they are (with text_key and place).

    Equal texts that follow each other are read once; the counts are whole in any case, as they are summed afterwards.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, seen, last, own = zstandard.ZstdDecompressor(), {}, None, []

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            names = ["unit", "many", "at", "count", "offset", "bytes", "text_key"]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            where: list[tuple] = []
            for key, packed, places in zip(*(batch.column(c).to_pylist() for c in ("text_key", "packed", "places")), strict=True):
                if key != last:
                    data, last, own = memoryview(unpack.decompress(packed)), key, []
                    for place in places:
                        at, count, offset = place >> (2 * BITS), place >> BITS & (1 << BITS) - 1, place & (1 << BITS) - 1
                        piece = bytes(data[at : at + count + length - 1])
                        unit = xxhash.xxh3_128_digest(piece) + offset.to_bytes(2, "big")
                        own.append(unit)
                        where.append((unit, None, at, count, offset, None, key))
                        if unit not in seen:
                            seen[unit] = [0, count, offset, piece]
                for unit in own:
                    seen[unit][0] += 1
                if len(seen) > KEPT_RUNS:
                    yield sent([(u, n, None, c, o, b, None) for u, (n, c, o, b) in seen.items()])
                    seen, last = {}, None
                if len(where) > 20_000:
                    yield sent(where)
                    where = []
            yield sent(where)
        yield sent([(u, n, None, c, o, b, None) for u, (n, c, o, b) in seen.items()])
        del seen
        release()

    return texts.mapInArrow(work, _UNIT)


def _cells(units: DataFrame, length: int, width: int) -> DataFrame:
    """(unit, many, low, high, core, whole): the cells of the given width in each unit's ranges (low, high) of offsets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for unit, many, count, offset, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("unit", "many", "count", "offset", "bytes", "ranges")), strict=True):
                view, top = memoryview(data), offset  # the unit begins ``offset`` bytes before its anchor
                for one in ranges or [{"low": offset - count + 1, "high": offset}]:
                    for cell in range(one["low"] // width, one["high"] // width + 1):
                        low, high = max(one["low"], cell * width), min(one["high"], cell * width + width - 1)
                        core = view[top - cell * width if cell * width <= top else 0 : top - cell * width - width + 1 + length]
                        whole = view[top - high : top - low + length]
                        out.append((unit, many, low, high, xxhash.xxh3_128_digest(core) + cell.to_bytes(2, "big"), _signed(xxhash.xxh3_64_intdigest(whole) + (low << BITS | high) * int(_SHIFT))))
            kinds = [pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["unit", "many", "low", "high", "core", "whole"])
        release()

    return units.select("unit", "many", "count", "offset", "bytes", "ranges").mapInArrow(work, "unit binary, many boolean, low int, high int, core binary, whole bigint")


def _refined(units: DataFrame, length: int) -> DataFrame:
    """(unit, low, high): the offsets at which windows of undecided runs repeat, in rounds of longer cores."""
    spark, found = units.sparkSession, []
    found.append(units.where("many").select("unit", (F.col("offset") - F.col("count") + 1).alias("low"), F.col("offset").alias("high")))
    alive = units.withColumn("ranges", F.lit(None).cast("array<struct<low:int,high:int>>"))
    for width in widths(length):
        cells = settle(_cells(alive, length, width))
        ranks = cells.groupBy("core").agg(F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("alike"), F.min("many").alias("known")).where("n > 1 and not known").select("core", "alike")
        ranked = settle(cells.where("not many").select("unit", "low", "high", "core").join(ranks.where("alike"), "core").select("unit", "low", "high"))
        found.append(ranked)
        if width == 1:
            break
        mixed = cells.join(ranks.where("not alike"), "core").groupBy("unit").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
        before, alive = alive, settle(units.join(mixed, "unit"))
        forget(cells)
        if before.columns and width != widths(length)[0]:
            forget(before)
        if alive.isEmpty():
            break
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionByName(one)
    spark.sparkContext._jvm.System.gc()  # what was shuffled can go
    return whole


def _kept(texts: DataFrame) -> DataFrame:
    """The result's rows, from (doc_id, packed, spans)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, merged, hashes = [], [], [], []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = memoryview(unpack.decompress(packed))
                kept, end, gone, n = hashlib.sha256(), 0, 0, 0
                for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
                    if low > end or not n:
                        kept.update(data[end:low])
                        n, gone, end = n + 1, gone + high - low, high
                    elif high > end:
                        gone, end = gone + high - end, high
                kept.update(data[end:])
                for out, value in zip((sizes, removed, merged, hashes), (len(data), gone, n, kept.hexdigest()), strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, merged)), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        release()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "packed", "spans").mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(text_key, spans): for each text with repeated strings of ``length`` bytes, where they are, as unsorted ranges [low, high) of bytes.

    ``docs`` has a column ``text`` without nulls; text_key is the 128-bit xxh3 of a text's UTF-8 bytes.
    """
    if not 1 <= length < 1 << BITS:
        raise ValueError(f"length must be from 1 to {(1 << BITS) - 1}")
    spark = docs.sparkSession
    anchors = _anchor_rows(docs, length).groupBy("anchor").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("mixed")).where("n > 1")
    anchors = settle(anchors.select("anchor", "mixed"))
    placed = _place_rows(docs, length).select("text_key", F.explode(F.arrays_zip("anchors", "places")).alias("one")).select("text_key", "one.*")
    met = placed.select("text_key", F.col("anchors").alias("anchor"), "places").join(anchors, "anchor")
    of_text = settle(
        met.groupBy("text_key").agg(F.collect_set(F.when(F.col("mixed"), F.col("places"))).alias("places"), F.collect_set(F.when(~F.col("mixed"), F.col("places"))).alias("alike"))
    )
    forget(anchors)
    spark.sparkContext._jvm.System.gc()  # what was shuffled can go
    undecided = _packed(docs.withColumn("doc_id", F.lit(0))).join(of_text.where(F.size("places") > 0).select("text_key", "places"), "text_key")
    rows = settle(_units(undecided, length))
    counted = rows.where("bytes is not null").groupBy("unit").agg(F.sum("many").alias("many"), *[F.first(c).alias(c) for c in ("count", "offset", "bytes")])
    units = settle(counted.withColumn("many", F.col("many") > 1))
    repeats = _refined(units, length)
    where = rows.where("bytes is null").select("unit", "text_key", (F.col("at") + F.col("offset")).alias("anchor_at"))
    fine = where.join(repeats, "unit").select("text_key", (F.col("anchor_at") - F.col("high")).alias("low"), (F.col("anchor_at") - F.col("low") + length).alias("high"))
    fine = fine.groupBy("text_key").agg(F.collect_set(F.struct("low", "high")).alias("fine"))
    coarse = of_text.where(F.size("alike") > 0).select("text_key", F.transform("alike", lambda place: _span(place, length)).alias("alike"))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    both = coarse.join(fine, "text_key", "full").select("text_key", F.concat(F.coalesce("alike", none), F.coalesce("fine", none)).alias("spans"))
    return settle(both)


def _span(place, length: int):
    """The bytes that a run's windows cover, from its packed place."""
    begin = F.shiftright(place, 2 * BITS)
    count = F.shiftright(place, BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.struct(begin.alias("low"), (begin + count + F.lit(length - 1)).alias("high"))


def without_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Takes out of each text every byte that lies in a string of ``length`` bytes which also starts anywhere else.

    Returns a row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes, end to end).
    Texts are taken as UTF-8 bytes; null and empty ones have none.  Matches lie within one text; they may overlap, also with themselves, and
    are judged on the input.  Texts under ``length`` bytes stay whole.  Repeated rows are copies of each other (both lose all their bytes, if long enough), also
    where they share a doc_id or have none.  Other columns aren't read.  An empty table gives an empty one.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return _kept(_packed(docs).join(repeated_spans(docs, length), "text_key", "left"))
