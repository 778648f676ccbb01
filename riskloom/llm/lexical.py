"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring.

1. Index.  Documents of a task are gathered in blocks of like numbers of terms.  Each block is a matrix of bits, a row for
   each place of a Bloom filter and a column for each document; a term sets ``HASHES`` rows in its document's column.
   Beside the term itself, "the term at least twice", "at least 3, 4, 6, 8 ... times" are entries of their own, so that the
   signature bounds how often a term occurs, too.  Rows are as many as ``BITS`` for each entry of the block's fullest documents.
   The documents' numbers of terms are kept beside, and the counts that weights need.
2. Bounds.  For each of a query's terms, the rows of its places are joined by AND: this gives every document that holds the term
   and some that don't.  The highest entry found bounds the term frequency.  The slices, each times the weight and the
   saturated frequency, are summed to an upper bound of the score for each document of the block.
3. Scores.  The ``PILOTS`` times ``top`` documents of highest bounds are read and scored exactly.  Their ``top``-th score is one that a
   result must reach; all other documents whose bound reaches it are read and scored, too.  None is left out unless its bound is lower.

Scores are whole numbers, so bounds and scores are compared exactly.  The set of queries is stated beforehand; it is handled in parts of
``QUERY_PART`` items, each of which is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import broadcast_if_small, release, settle, small_batches, text_or_empty

#: UTF-8 bytes of terms: digits and letters of ASCII, these in lower case, and all bytes of other characters; a blank for any other byte.
TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Frequencies from which on a term has one entry more.
STEPS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32]
#: Rows that an entry sets, and rows of a block for each entry.
HASHES, BITS = 4, 12
KEEP_TERMS = 60_000
#: Documents of a block, of small and of large ones: a block's matrix stays under some megabytes.
BLOCK, BLOCK_BITS = 512, 1 << 25
#: Documents that are scored first, for each one of the result.
PILOTS = 4
#: Items of the query set that are handled together.
QUERY_PART = 1000


def terms(text: str) -> list[bytes]:
    """A text's terms, with repeats, as bytes."""
    return text.encode().translate(TERM).split()


def saturated(tf, m):
    """What a term adds for each unit of its weight: a whole number, rounded down, that grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Hashed:
    """Hashes of terms; those seen lately are remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _new(self, term: bytes) -> int:
        if len(self.known) >= KEEP_TERMS:
            self.known.clear()
        value = self.known[term] = xxhash.xxh3_64_intdigest(term)
        return value

    def __call__(self, said: Collection[bytes]) -> np.ndarray:
        known, new = self.known.get, self._new
        return np.fromiter((known(t) or new(t) for t in said), np.uint64, len(said))


def at_least(hashes: np.ndarray, at: int) -> np.ndarray:
    """The hashes of the entries "at least ``STEPS[at]`` times" of terms."""
    h = (hashes ^ np.uint64(at * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def entries(counts: Counter, hashed: Hashed) -> np.ndarray:
    """Hashes of a document's entries."""
    h, n = hashed(counts), np.fromiter(counts.values(), np.int64, len(counts))
    out = []
    for at, step in enumerate(STEPS):
        h, n = h[n >= step], n[n >= step]
        if not len(h):
            break
        out.append(at_least(h, at))
    return np.concatenate(out)


def _places(hashes: np.ndarray, rows: int) -> np.ndarray:
    """The rows that entries set, from 64-bit hashes; ``rows`` is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[..., None] + high[..., None] * steps) & np.uint64(rows - 1)).astype(np.int64)


class Block:
    """Documents of like numbers of entries, on the way to a matrix."""

    def __init__(self, size: int):
        self.rows = 1 << size
        self.most = max(8, min(BLOCK, BLOCK_BITS // self.rows))
        self.ids: list = []
        self.lengths: list[int] = []
        self.hashes: list[np.ndarray] = []

    def add(self, doc_id, length: int, hashes: np.ndarray) -> bool:
        """True if the block is full."""
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.hashes.append(hashes)
        return len(self.ids) == self.most

    def slices(self) -> bytes:
        columns = -(-len(self.ids) // 8)
        bits = np.zeros((self.rows, columns * 8), np.uint8)
        for at, hashes in enumerate(self.hashes):
            bits[_places(hashes, self.rows).ravel(), at] = 1
        return np.packbits(bits, axis=1).tobytes()


def _index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(rows, ids, lengths, slices, term, docs): blocks of signatures, and in how many of a task's documents each word of the vocabulary occurs."""
    wanted = {t: n for n, t in enumerate(vocabulary)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        found = np.zeros(len(wanted), np.int64)

        def sent(block: Block) -> pa.RecordBatch:
            return _batch([[block.rows], [block.ids], [block.lengths], [block.slices()], [None], [None]], kind)

        kind, hashed = pa.int64(), Hashed()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(terms(text))
                if not counts:
                    continue
                found[[wanted[t] for t in counts if t in wanted]] += 1
                hashes = entries(counts, hashed)
                size = max(6, (len(hashes) * BITS - 1).bit_length())
                block = blocks.setdefault(size, Block(size))
                if block.add(doc_id, sum(counts.values()), hashes):
                    yield sent(blocks.pop(size))
        for block in blocks.values():
            yield sent(block)
        some = np.flatnonzero(found)
        yield _batch([[None] * len(some)] * 4 + [some.tolist(), found[some].tolist()], kind)
        release()

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"rows bigint, ids array<{kind}>, lengths array<bigint>, slices binary, term int, docs bigint")


def _batch(columns: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rows", "ids", "lengths", "slices", "term", "docs"])


class Queries:
    """Items with their terms and weights, as the tasks need them."""

    def __init__(self, items: list[tuple[int, str]], n_docs: int, n_terms: int, found: dict[bytes, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = [(number, sorted(set(terms(text)))) for number, text in items]
        self.items = [(number, said) for number, said in self.items if said]
        self.vocabulary = sorted({t for _, said in self.items for t in said})
        place = {t: n for n, t in enumerate(self.vocabulary)}
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in self.vocabulary], np.int64)
        self.of_item = [np.array([place[t] for t in said], np.int64) for _, said in self.items]
        said = Hashed()(self.vocabulary)
        self.hashes = np.stack([at_least(said, at) for at in range(len(STEPS))], 1)

    def norm(self, lengths):
        """A document's m, from its number of terms."""
        return 50 + (50 * lengths * self.n_docs) // self.n_terms

    def bounds(self, rows: int, lengths: np.ndarray, slices: bytes) -> Iterator[np.ndarray]:
        """For each item, upper bounds of the scores of a block's documents."""
        bits = np.frombuffer(slices, np.uint8).reshape(rows, -1)
        most, m = np.full((len(self.vocabulary), len(lengths)), 0, np.int64), self.norm(lengths)
        left = np.arange(len(self.vocabulary))
        highest = np.append(np.array(STEPS[1:], np.int64) - 1, 1 << 30)
        for at in range(len(STEPS)):
            hit = np.bitwise_and.reduce(bits[_places(self.hashes[left, at], rows)], axis=1)
            if at:
                hit &= before[keep]
            keep = np.flatnonzero(hit.any(axis=1))
            if not len(keep):
                break
            left, before = left[keep], hit
            here = np.unpackbits(hit[keep], axis=1, count=len(lengths)).astype(bool)
            most[left] = np.where(here, saturated(np.minimum(highest[at], lengths), m), most[left])
        most *= self.weights[:, None]
        for said in self.of_item:
            yield most[said].sum(axis=0)

    def score(self, item: int, counts: Counter, length: int) -> int:
        m = self.norm(length)
        return sum(int(self.weights[t]) * saturated(counts[self.vocabulary[t]], m) for t in self.of_item[item] if self.vocabulary[t] in counts)


def _bounded(index: DataFrame, queries: Queries, floor: dict[int, int] | None, top: int) -> DataFrame:
    """(item, doc_id, bound): the documents whose bounds reach the item's floor; without floors, those of a task's ``top`` highest bounds."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list]] = {}

        def sent(rows: list[tuple[int, list, list]]) -> pa.RecordBatch:
            columns = [[number for number, ids, _ in rows for _ in ids], [one for _, ids, _ in rows for one in ids], [one for *_, bounds in rows for one in bounds]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), id_kind, pa.int64()), strict=True)], ["item", "doc_id", "bound"])

        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.column("ids").type.value_type
            for rows, ids, lengths, slices in zip(*(batch.column(c).to_pylist() for c in ("rows", "ids", "lengths", "slices")), strict=True):
                reached = []
                for (number, _), bound in zip(queries.items, queries.bounds(rows, np.array(lengths, np.int64), slices), strict=True):
                    if floor is not None:
                        kept = np.flatnonzero(bound >= max(1, floor.get(number, 1)))
                        reached.append((number, [ids[k] for k in kept.tolist()], bound[kept].tolist()))
                        continue
                    before, named = best.get(number, (np.empty(0, np.int64), []))
                    kept = np.flatnonzero(bound > (before[-1] if len(before) == top else 0))
                    if len(kept):
                        bounds, names = np.append(before, bound[kept]), named + [ids[k] for k in kept.tolist()]
                        order = np.argsort(-bounds, kind="stable")[:top]
                        best[number] = bounds[order], [names[k] for k in order.tolist()]
                if reached:
                    yield sent(reached)
        if best:
            yield sent([(number, ids, bounds.tolist()) for number, (bounds, ids) in best.items()])
        release()

    return index.select("rows", "ids", "lengths", "slices").mapInArrow(work, f"item bigint, doc_id {kind}, bound bigint")


def _scored(docs: DataFrame, pairs: DataFrame, queries: Queries) -> DataFrame:
    """(item, doc_id, score): the pairs (item, doc_id) with exact scores above 0; a row for each row of ``docs`` with such an id."""
    wanted = pairs.groupBy(F.col("doc_id").alias("wanted")).agg(F.collect_set("item").alias("items"))
    place = {number: at for at, (number, _) in enumerate(queries.items)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                counts = Counter(terms(text))
                length = sum(counts.values())
                out += [(number, doc_id, queries.score(place[number], counts, length)) for number in items]
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), batch.column("doc_id").type, pa.int64()), strict=True)], ["item", "doc_id", "score"])
        release()

    few = broadcast_if_small(settle(wanted))
    met = docs.join(few, docs["doc_id"].eqNullSafe(few["wanted"])).select("doc_id", "text", "items")
    return settle(met.mapInArrow(work, f"item bigint, doc_id {kind}, score bigint").where("score > 0"))


def _part(docs: DataFrame, index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(item, doc_id, score, rank) of the queries' items."""
    spark = docs.sparkSession
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    first = settle(_bounded(index, queries, None, PILOTS * top).withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= PILOTS * top).select("item", "doc_id"))
    scored = _scored(docs, first, queries)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    placed = lambda rows: rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    floor = {r["item"]: r["score"] for r in placed(scored).where(F.col("rank") == top).select("item", "score").collect()}  # a row an item at most
    rest = settle(_bounded(index, queries, floor, top).select("item", "doc_id").distinct().join(broadcast_if_small(first).alias("done"), ["item", "doc_id"], "left_anti"))
    return placed(scored.unionByName(_scored(docs, rest, queries)))


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Equal scores rank by ascending doc_id.  Null and empty texts have no terms: such documents aren't counted and such items have no rows.
    Each row of ``items`` is an item of its own, also where ids repeat or are null; each row of ``docs`` is a document, also where ids repeat or
    are null (a null id ranks first among equals).  Other columns aren't read.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = settle(asked)
    parts = -(-asked.count() // QUERY_PART)
    found = None
    for part in range(parts):
        said = [(r["item"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]  # about QUERY_PART rows
        words = sorted({t for _, text_ in said for t in terms(text_)})
        index = settle(_index(kept, words))
        total = index.where("rows is not null").select(F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("terms")).first()
        counts = {words[r["term"]]: r["docs"] for r in index.where("term is not null").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}  # a row a word of the part at most
        if not total["docs"]:
            continue
        ranked = _part(kept, index.where("rows is not null"), Queries(said, total["docs"], total["terms"], counts), top)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kept.schema['doc_id'].dataType.simpleString()}, score bigint")
    return found.join(broadcast_if_small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


#: The same for DuckDB, with scores of all pairs that share a term.
SQL = r"""
    with said as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') as w from documents),
    sizes as (select doc_id, len(w)::bigint as n from said where len(w) > 0),
    whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
    tf as (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(w) as t from said) group by all),
    df as (select t, count(*)::bigint as df from tf group by t),
    asked as (
        select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as t
        from benchmark),
    weighed as (select item_id, t, cast(floor(1000 * ln((2 * docs + 2) / (2 * coalesce(df, 0) + 1))) as bigint) as w from asked left join df using (t), whole),
    scores as (
        select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
        from weighed join tf using (t) join sizes using (doc_id), whole group by item_id, doc_id),
    ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
    select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50"""
