"""The trie of shared beginnings of conversations: adaptive radix trees over sorted ranges of keys.

A turn's id is ``WIDTH`` bytes, big-endian: 16 of the SHA-256 of role and text, and 4 with the text's number of words.  A
conversation's key is its turns' ids end to end.  Equal conversations are first summed to one row.

1. Keys are dealt in sorted ranges, and each task reads its range in chunks.  A chunk becomes an adaptive radix tree:
   nodes of four sizes that grow with their children, and paths without a branch held in one node.  Where a path passes the
   end of a turn, a node of the trie is made; splits within a turn's id aren't nodes.
2. A chunk holds all of a node's conversations, unless the node lies on the way to the chunk's first or last key.  Such
   nodes stay open: the chunk sends on two rows, with what it knows of each node on the two ways.  All others are finished.
3. The rows sent on are sorted and read in chunks in the same way, until they are one chunk.  A chunk of thousands of rows
   leaves two, so this takes two or three rounds, however many conversations share a beginning.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import broadcast_if_small, release, settle, small_batches

#: Bytes of a turn's id, and of these for the number of words.
WIDTH, COUNT = 20, 4
#: Rows of a chunk at most, and bytes of their keys from which on a chunk ends.
CHUNK, CHUNK_BYTES = 4096, 32 << 20
#: Conversations of one piece of a list of ids: ids that agree but for so many low bits.
PIECE_BITS = 13
#: Other conversations begin with the first turns of the one whose id is divisible by this, and with so many at most.
GROUP, HEAD = 20, 4
EMPTY = hashlib.sha256().hexdigest()


class Few:
    """Children of a node, up to 4 or 16: their first bytes in order, and they themselves beside."""

    __slots__ = ("first", "kids", "most")

    def __init__(self, most: int = 4):
        self.first, self.kids, self.most = bytearray(), [], most

    def find(self, byte: int) -> Node | None:
        at = self.first.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node) -> Few | Indexed:
        at = bisect_left(self.first, byte)
        if at < len(self.first) and self.first[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.most:
            larger = Few(16) if self.most == 4 else Indexed()
            for b, k in zip(self.first, self.kids, strict=True):
                larger.put(b, k)
            return larger.put(byte, kid)
        self.first.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.kids)


class Indexed:
    """Up to 48 children: 256 places say which of them a byte leads to."""

    __slots__ = ("index", "kids")
    NONE = 255

    def __init__(self) -> None:
        self.index, self.kids = bytearray([self.NONE]) * 256, []

    def find(self, byte: int) -> Node | None:
        at = self.index[byte]
        return None if at == self.NONE else self.kids[at]

    def put(self, byte: int, kid: Node) -> Indexed | Full:
        at = self.index[byte]
        if at != self.NONE:
            self.kids[at] = kid
        elif len(self.kids) < 48:
            self.index[byte] = len(self.kids)
            self.kids.append(kid)
        else:
            larger = Full()
            for b in range(256):
                if self.index[b] != self.NONE:
                    larger.put(b, self.kids[self.index[b]])
            return larger.put(byte, kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.kids[at] for at in self.index if at != self.NONE)


class Full:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> Full:
        self.kids[byte] = kid
        return self

    def __iter__(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)


class Node:
    """The bytes since the node above, the children, and what is known of the trie's node that ends here."""

    __slots__ = ("path", "kids", "known")

    def __init__(self, path: bytes = b""):
        self.path, self.kids, self.known = path, Few(), None


def shared(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first ``low`` are equal, the first ``high`` aren't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def reach(node: Node, rest: bytes) -> Node:
    """The node ``rest`` below ``node``, made if there is none."""
    while rest:
        kid = node.kids.find(rest[0])
        if kid is None:
            kid = Node(rest)
            node.kids = node.kids.put(rest[0], kid)
            return kid
        same = shared(kid.path, rest)
        if same < len(kid.path):
            above = Node(kid.path[:same])
            kid.path = kid.path[same:]
            above.kids = above.kids.put(kid.path[0], kid)
            node.kids = node.kids.put(rest[0], above)
            kid = above
        node, rest = kid, rest[same:]
    return node


class Known:
    """Of one node of the trie: conversations, least id, children, childless nodes and saved words that no node below it accounts for, and the hash of its ends."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, n: int = 0, least: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None):
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = n, least, children, leaves, saved, ends

    def add(self, other: Known) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


class Made:
    """A node of the trie, as the walk makes it: its turn's words, the node above, a digest of the turns down to it, and on which ways it lies."""

    __slots__ = ("depth", "words", "known", "above", "key", "ways")

    def __init__(self, depth: int, words: int, known: Known | None, above: Made | None, key: bytes, ways: int):
        self.depth, self.words, self.known, self.above, self.key, self.ways = depth, words, known or Known(), above, key, ways


def walk(root: Node, first: bytes, last: bytes) -> list[Made]:
    """The trie's nodes, each after the one above it; ``ways`` says which lie on the way to the first key (1) and the last (2)."""
    made = [Made(0, 0, root.known, None, b"", 3)]
    stack = [(kid, 0, b"", 3, made[0]) for kid in root.kids]
    while stack:
        node, begin, turn, ways, above = stack.pop()
        size = len(node.path)
        along = [(bit, shared(node.path, way[begin : begin + size])) for bit, way in ((1, first), (2, last)) if ways & bit]
        turn += node.path
        for depth in range(begin // WIDTH + 1, (begin + size) // WIDTH + 1):
            said, turn = turn[:WIDTH], turn[WIDTH:]
            at = depth * WIDTH - begin
            on = sum(bit for bit, n in along if n >= at)
            above = Made(depth, int.from_bytes(said[-COUNT:], "big"), node.known if at == size else None, above, xxhash.xxh3_128_digest(above.key + said), on)
            made.append(above)
        on = sum(bit for bit, n in along if n == size)
        stack += [(kid, begin + size, turn, on, above) for kid in node.kids]
    return made


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, own binary, above binary"
_PATH = "key binary, depths array<int>, n array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
_PATH_KINDS = [pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
_NODE_KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
_NAMES = [one.split()[0] for one in f"{_NODE}, {_PATH}".split(", ")]


def finished(made: list[Made], whole: bool, again: bool) -> tuple[list[tuple], dict[int, list[Made]]]:
    """The rows of the nodes that nothing outside can change, and the open nodes on each way.

    ``whole``: the chunk is all there is.  ``again``: the nodes were open once, so others may wait for their ids.
    """
    closed: list[Made] = []
    for one in reversed(made):  # those below come first
        if one.ways and not whole:
            continue
        known = one.known
        known.leaves += not known.children
        known.saved += (known.n - 1) * one.words
        closed.append(one)
        if one.above is not None:
            one.above.known.add(Known(known.n, known.least, 1, known.leaves, known.saved))
    rows = []
    for one in closed:
        known, above = one.known, one.above
        waits = above is not None and above.ways and not whole
        parent = None if above is None or waits else above.known.least
        rows.append((known.least, one.depth, parent, known.n, known.children, known.leaves, known.saved, known.ends or EMPTY, one.key if again else None, above.key if waits else None))
    still: dict[int, list[Made]] = {1: [], 2: []}
    if not whole:
        for one in made:
            if one.ways:
                still[1 if one.ways & 1 else 2].append(one)
    return rows, still


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunk.append(row)
            size += len(row[0])
            if len(chunk) == most or size > CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _tree(whole: bool, again: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most):
            root = Node()
            for key, depths, *values in chunk:
                node, at = root, 0
                for depth, *known in zip(depths, *values, strict=True):
                    node, at = reach(node, key[at : depth * WIDTH]), depth * WIDTH
                    node.known = node.known or Known()
                    node.known.add(Known(*known))
            first, last = chunk[0][0], chunk[-1][0]
            rows, still = finished(walk(root, first, last), whole, again)
            paths = [(key, [m.depth for m in way], *([getattr(m.known, f) for m in way] for f in ("n", "least", "children", "leaves", "saved", "ends"))) for key, way in ((first, still[1]), (last, still[2])) if way]
            out = [(*row, *[None] * len(_PATH_KINDS)) for row in rows] + [(*[None] * len(_NODE_KINDS), *path) for path in paths]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _NODE_KINDS + _PATH_KINDS, strict=True)], _NAMES)
        release()

    return work


def _turns(convs: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): each conversation's ids in order of turn (null first), equal turns in the order of their ids."""
    said, told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, told).cast("binary"), 256)
    words = F.lpad(F.hex(F.regexp_count(told, F.lit(r"[^\x20\x09-\x0D]+"))), 2 * COUNT, "0")
    one = F.struct(F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"), F.unhex(F.concat(F.substring(digest, 1, 2 * (WIDTH - COUNT)), words)).alias("id"))
    rows = convs.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")).select("conv_id", F.col("turns.id").alias("turns"))


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key): the first h turns of the group's first conversation, then a conversation's own after its first h."""
    base = turns.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    begun = own.join(base, "base", "left").withColumn("head", F.coalesce("head", F.array().cast("array<binary>")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return begun.select("conv_id", F.array_join(F.transform(F.concat(F.slice("head", F.lit(1), F.col("h")), rest), F.hex), "").alias("key")).select("conv_id", F.unhex("key").alias("key"))


def _summed(rebuilt: DataFrame) -> DataFrame:
    """(key, n, least, ends): a row for each different conversation; ends is the hash of all its ids, in order.

    Ids are joined in pieces of neighbouring ids first; then the pieces are read in order, one at a time, as a hash must be.
    """
    rows = rebuilt.withColumn("short", F.substring(F.sha2("key", 256), 1, 32)).withColumn("piece", F.shiftright("conv_id", PIECE_BITS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.groupBy("short", "piece").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("key").alias("key"), ids.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, total, least, digest = None, b"", 0, 0, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for short, n, low, own, said in zip(*(batch.column(c).to_pylist() for c in ("short", "n", "least", "key", "ids")), strict=True):
                if short != now:
                    if now is not None:
                        out.append((key, total, least, digest.hexdigest()))
                    now, key, total, least, digest = short, own, 0, low, hashlib.sha256()
                digest.update(f",{said}".encode() if total else said.encode())
                total += n
            yield _summed_batch(out)
        if now is not None:
            yield _summed_batch([(key, total, least, digest.hexdigest())])

    return pieces.repartition("short").sortWithinPartitions("short", "piece").select("short", "n", "least", "key", "ids").mapInArrow(work, "key binary, n bigint, least bigint, ends string")


def _summed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["key", "n", "least", "ends"])


def prefix_trie(keys: DataFrame, most: int = CHUNK) -> DataFrame:
    """The trie's nodes, from (key, n, least, ends), a row for each different key of whole turn ids.

    Nodes: conv_id (least id), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``most`` is the number of rows of a chunk (8 at least, so that each round leaves fewer rows); the result doesn't depend on it.
    """
    if most < 8:
        raise ValueError("a chunk has 8 rows at least")
    spark = keys.sparkSession
    small_batches(spark)
    one = lambda c, kind="bigint": F.array(c).cast(f"array<{kind}>")
    zero = F.lit(0)
    paths = keys.select("key", one((F.octet_length("key") / WIDTH).cast("int"), "int").alias("depths"), one("n").alias("n"), one("least").alias("least"), *[one(zero).alias(c) for c in ("children", "leaves", "saved")], one("ends", "string").alias("ends"))
    paths, rounds = settle(paths), []
    while True:
        n, again = paths.count(), bool(rounds)
        whole = n <= most
        dealt = paths.repartition(1) if whole else paths.repartitionByRange(max(1, min(n // most + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "key")
        out = settle(dealt.sortWithinPartitions("key").mapInArrow(_tree(whole, again, most), f"{_NODE}, {_PATH}"))
        rounds.append(out.where("depth is not null").select(*_NAMES[: len(_NODE_KINDS)]))
        if whole:
            break
        paths = out.where("key is not null").select(*_NAMES[len(_NODE_KINDS) :])
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if len(rounds) == 1:
        return nodes.select(*kept)
    opened = rounds[1]
    for more in rounds[2:]:
        opened = opened.unionByName(more)
    parents = broadcast_if_small(opened.select(F.col("own").alias("above"), F.col("conv_id").alias("known")))
    return nodes.join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "known")).select(*kept)


def shared_turns(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = CHUNK) -> DataFrame:
    """The prefix trie of conversations whose beginnings are shared: one row for each different sequence of first turns.

    Every conversation c gets the first h turns of conversation c - c % 20 (fewer if that has fewer, none if it isn't there) in place
    of its own first h, with h = crc32 of c in decimal, modulo 4.  A null role or text counts as empty; a null turn comes first; equal
    turns come in the order of their ids, repeated rows are turns of their own.  Ids must be whole numbers; rows without one belong to
    no conversation and are left out.  Other columns aren't read.  An empty table has no nodes, not even a root.

    ``saved_tokens`` are the words that need no second reading below a node: for each node of its subtree, its conversations but one,
    times the words of its last text.
    """
    rebuilt = _rebuilt(settle(_turns(convs, conv_id, turn, role, text)))
    return prefix_trie(_summed(rebuilt), most)


#: The same for DuckDB, with a row for every conversation and each of its first turns.
SQL = r"""
    with turns as (
        select conv_id, coalesce(role, '') as r, coalesce(text, '') as t,
            row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as i
        from conversations where conv_id is not null),
    convs as (
        select conv_id, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda i: ord(substr(cast(conv_id as varchar), i, 1))::bigint)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)) as crc
        from (select distinct conv_id from turns)),
    heads as (select conv_id, xor(crc, 4294967295::bigint) % 4 as h from convs),
    rebuilt as (
        select c.conv_id, t.i, t.r, t.t from heads c join turns t on t.conv_id = c.conv_id - c.conv_id % 20 and t.i <= c.h
        union all
        select c.conv_id, t.i, t.r, t.t from heads c join turns t on t.conv_id = c.conv_id and t.i > c.h),
    placed as (
        select conv_id, row_number() over (partition by conv_id order by i) as depth, sha256(concat(length(r), ':', r, t)) as id,
            len(regexp_extract_all(t, '[^ 	-
]+')) as words from rebuilt),
    ways as (
        select conv_id, 0 as depth, 'root' as node, null as parent, 0 as words from heads
        union all
        select conv_id, depth, sha256(string_agg(id, ',') over (partition by conv_id order by depth)),
            case when depth = 1 then 'root' else sha256(string_agg(id, ',') over (partition by conv_id order by depth rows between unbounded preceding and 1 preceding)) end, words from placed),
    lengths as (select conv_id, max(depth) as size from ways group by conv_id),
    nodes as (
        select node, any_value(parent) as parent, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n, any_value(words) as words,
            sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = depth), '')) as ends
        from ways join lengths using (conv_id) group by node),
    counted as (select n.*, (select count(*) from nodes k where k.parent = n.node) as children from nodes n),
    below as (
        select w.node, sum(case when c.children = 0 then 1 else 0 end) as leaves, sum((c.n - 1) * c.words) as saved
        from counted c join ways w on w.conv_id = c.conv_id and w.depth <= c.depth group by w.node)
    select c.conv_id, cast(c.depth as bigint) as depth, p.conv_id as parent_conv_id, c.n as n_convs, c.children as n_children, cast(b.leaves as bigint) as n_leaves,
        cast(b.saved as bigint) as saved_tokens, c.ends as ends_sha256
    from counted c join below b using (node) left join counted p on p.node = c.parent"""
