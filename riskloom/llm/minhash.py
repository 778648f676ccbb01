"""MinHash near-duplicates: an inverted join of signature coordinates, and a check on full shingle sets.

1. Every text's distinct word shingles give a signature; equal sets are one class, with one representative.
2. Each class is posted under its (coordinate, value) pairs.  Two classes above the similarity agree on at
   least ``agree`` coordinates but for a chance of ``miss``.  Ordered by rarity, they must then meet in the
   first ``shared - agree + 1`` pairs that each shares with anyone: only this prefix is joined, and classes
   with fewer shared pairs are skipped.
3. In each posting list the class with the commonest coordinates (the likeliest original) is held against
   all members: agreeing coordinates are counted, then the full sets compared.
4. Lists whose members are then still of several components are settled exactly: prefixes of the full sets,
   ordered by rarity, with the bound on the overlap that the place of a common shingle gives.  Only pairs of
   different components are formed, each with an end outside the list's largest component.
So no list is expanded into all its pairs, and no link that joins two components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import broadcast_if_small, forget, gathered, per_batch, settle, text_or_empty, unused
from riskloom.llm.graph import components

COORDINATES = 32
KEEP_WORDS = 60_000
#: Members of a common shingle's list that are dealt together.
LIST_PART = 2_000
_MULTIPLY = np.random.default_rng(42).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Hashes of a text's distinct word shingles. Words: what ASCII white space separates, A-Z in lower case."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= KEEP_WORDS:
            self.known.clear()
        value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, text: str) -> np.ndarray:
        """Sorted 64-bit hashes; fewer words than a shingle's are one shingle, no words give none."""
        said, new = self.known.get, self._word
        ids = np.array([said(w) or new(w) for w in text.encode().lower().split()], np.uint64)
        if not len(ids):
            return ids
        size = min(self.words, len(ids))
        h = np.full(len(ids) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ ids[i : len(ids) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least multiplied hash at each coordinate, with the coordinate's number in the top bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for part in np.split(hashes, range(8192, len(hashes), 8192)):
        np.minimum(least, (part[None, :] * _MULTIPLY[:, None]).min(1), out=least)
    return ((least >> np.uint64(7)) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(57))).view(np.int64)


def least_agreement(similarity: float, miss: float = 1e-6) -> int:
    """The most coordinates that pairs at ``similarity`` share but for a chance of ``miss``."""
    chance = 0.0
    for k in range(COORDINATES + 1):
        chance += math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        if chance > miss:
            return max(1, k)
    return COORDINATES


def sign(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash (as ``xxhash64`` gives it), n_shingles, key (128 bits of the set; null without shingles), signature."""

    def worker():
        shingle = Shingler(words)

        def work(columns: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": columns["doc_id"], "text_hash": [], "n_shingles": [], "key": [], "signature": []}
            for one in columns["text"]:
                hashes = shingle(one)
                said = xxhash.xxh64_intdigest(one.encode(), 42)
                out["text_hash"].append(said - (said >> 63 << 64))
                out["n_shingles"].append(len(hashes))
                out["key"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                out["signature"].append(signature(hashes) if len(hashes) else None)
            return out

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return per_batch(picked, worker, f"doc_id {kind}, text_hash bigint, n_shingles bigint, key binary, signature array<bigint>")


def _sets(docs: DataFrame, classes: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(node, hashes) of the classes: only the texts of their representatives are shingled again."""

    def worker():
        shingle = Shingler(words)

        def work(columns: dict[str, list]) -> dict[str, list]:
            sets = [shingle(t) for t in columns["text"]]
            return {"key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "hashes": [s.view(np.int64) for s in sets]}

        return work

    picked = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    texts = picked.join(classes.select("id"), picked["id"].eqNullSafe(classes["id"]), "left_semi").select("text")
    return per_batch(texts, worker, "key binary, hashes array<bigint>").join(classes.select("key", "node"), "key").dropDuplicates(["key"]).select("node", "hashes")


def _prefixes(classes: DataFrame, agree: int) -> DataFrame:
    """(list, node, common): under which of its rarest shared pairs each class is posted, and how common its coordinates are."""
    posted = classes.select("node", F.explode("signature").alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("docs")).where("docs > 1")
    of = Window.partitionBy("node")
    hits = posted.join(shared, "list").withColumn("shared", F.count("*").over(of)).withColumn("rank", F.row_number().over(of.orderBy("docs", "list")))
    hits = hits.withColumn("common", F.sum(F.log("docs")).over(of))
    return hits.where((F.col("shared") >= agree) & (F.col("rank") <= F.col("shared") - agree + 1)).select("list", "node", "common")


def _both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with what the table holds of both nodes, as of_a and of_b; few pairs go to the table, not it to them."""
    few = broadcast_if_small(pairs)
    a, b = (table.select(F.col("node").alias(end), F.col("of").alias(f"of_{end}")).join(few, end) for end in ("a", "b"))
    return a.join(b, ["a", "b"])


def _agreeing(pairs: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) that agree on enough coordinates."""
    signed = _both_ends(pairs, classes.select("node", F.col("signature").alias("of")))
    same = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return settle(signed.where(same >= agree).select("a", "b"))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    full = _both_ends(pairs, sets.withColumnRenamed("hashes", "of")).withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return settle(full.where(F.col("common") * 100 >= union * percent).select("a", "b"))


def _apart(rows: DataFrame, by: str) -> DataFrame:
    """The rows of those lists whose members are of several components."""
    apart = rows.groupBy(by).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return rows.join(settle(apart.select(by)), by, "left_semi")


def _exact_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be alike, by prefixes of the full sets; none that are alike is missed."""
    rows = sets.join(broadcast_if_small(nodes), "node").select("node", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    docs = rows.groupBy("h").agg(F.count("*").alias("docs"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("docs", "h"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100.0)) + 1
    # Each step is written before the next join by shingle, so that a common shingle's rows can be split among tasks.
    placed = settle(rows.join(settle(docs.where("docs > 1")), "h", "left").withColumn("docs", F.coalesce("docs", F.lit(1))).withColumn("at", place).where((F.col("at") <= prefix) & (F.col("docs") > 1)))
    posted = settle(_apart(placed, "h"))
    forget(placed)
    largest = posted.groupBy("h", "component").agg(F.count("*").alias("size")).groupBy("h").agg(
        F.max(F.struct("size", "component"))["component"].alias("main"), F.ceil(F.sum("size") / F.lit(LIST_PART)).cast("int").alias("parts")
    )
    posted = posted.join(settle(largest), "h").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    few = posted.where("component != main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    few = few.select("h", "part", *[F.col(c).alias(f"{c}_x") for c in ("node", "component", "n", "at")])
    needed = F.ceil((F.col("n") + F.col("n_x")) * F.lit(percent) / F.lit(100.0 + percent))
    possible = (F.col("component") != F.col("component_x")) & (F.least(F.col("n") - F.col("at"), F.col("n_x") - F.col("at_x")) + 1 >= needed)
    return few.join(posted, ["h", "part"]).where(possible).select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def _links(members: DataFrame, classes: DataFrame, sets: DataFrame, agree: int, percent: int) -> DataFrame:
    """(node, label): the components of all links within the posting lists."""
    members = gathered(members)
    hubs = members.groupBy("list").agg(F.max(F.struct("common", "node"))["node"].alias("hub"))
    tried = members.join(hubs, "list").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = gathered(settle(tried))
    links = _alike(gathered(_agreeing(tried, classes, agree)), sets, percent)
    labels = gathered(components(links))
    placed = members.join(labels, "node", "left").select("list", "node", F.coalesce("label", "node").alias("component"))
    nodes = settle(_apart(placed, "list").select("node", "component").distinct())
    if nodes.isEmpty():
        return labels
    more = settle(_exact_pairs(nodes, sets, percent).join(tried, ["a", "b"], "left_anti"))
    return components(settle(links.unionByName(_alike(gathered(more), sets, percent))))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """Links texts whose shingle sets have a Jaccard likeness of at least ``similarity`` (whole per cents).

    Returns a row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach, its own included), kept (doc_id = component_id).  Null and empty texts have no shingles and link
    with nothing; equal sets link.  Rows of a null id take part; their component_id is null only if nothing
    linked has an id, and kept is false.  Repeated ids are rows of their own.  Other columns aren't read.

    A pair at the threshold is missed with a chance of 1e-6 where the coordinates are independent.  With ``exact`` no signature
    decides: prefixes of all full sets are joined instead, which costs more and misses nothing (tests hold one against the other).
    """
    found = _found(docs, words, similarity, doc_id, text, exact)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _found(docs: DataFrame, words: int, similarity: float, doc_id: str, text: str, exact: bool) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (a number of the component; null without shingles), component_id."""
    percent = round(similarity * 100)
    agree = least_agreement(percent / 100)
    signed = settle(sign(docs, words, doc_id, text))
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    if exact:
        sets = settle(_sets(docs, classes, words, doc_id, text))
        pairs = settle(_exact_pairs(classes.select("node", F.col("node").alias("component")), sets, percent))
        return _labelled(signed, classes.select("key", "node", "id"), components(_alike(pairs, sets, percent)))
    prefixes = settle(_prefixes(classes, agree))
    met = prefixes.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(prefixes.join(met.select("list"), "list", "left_semi"))
    forget(prefixes)
    named = classes.select("key", "node", "id")
    if not members.isEmpty():
        wanted = settle(named.join(members.select("node").distinct(), "node", "left_semi"))
        sets = settle(_sets(docs, wanted, words, doc_id, text))
        return _labelled(signed, named, _links(members, classes, sets, agree, percent))
    return _labelled(signed, named, None)


def _labelled(signed: DataFrame, named: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The result's rows, from the classes (key, node, id) and the components of those that are linked."""
    if labels is None:
        named = named.select("key", F.col("node").alias("root"), F.col("id").alias("component_id"))
    else:
        named = named.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
        least = named.where("label is not null").groupBy("root").agg(F.min("id").alias("component_id"))
        named = named.join(least, "root", "left").select("key", "root", F.coalesce("component_id", "id").alias("component_id"))
    said = ["doc_id", "text_hash", "n_shingles"]
    empty = signed.where("key is null").select(*said, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return signed.where("key is not null").select(*said, "key").join(named, "key").select(*said, "root", "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, all its columns as they were.

    The row of the smallest doc_id stays (one without id only if none has one; of rows with one id that of the smallest text
    hash; of rows equal in both any one).  Texts without words stay, all of them.  An empty table stays empty.  Few rows go
    to the texts, not the texts to them, where they are few.
    """
    found = settle(_found(docs, words, similarity, doc_id, text, exact=False).where("root is not null").select("root", "doc_id", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    held = found.join(found.groupBy("root").agg(first), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash")))
    id_, hash_ = unused(docs, "_id"), unused(docs, "_hash")
    counted = settle(held.groupBy("doc_id", "text_hash", "stays").agg(F.count("*").alias("n")))
    gone, repeated = (counted.where(c).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)) for c in ("not stays", "stays and n > 1"))
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(text)) == F.col(hash_))
    left = docs.join(broadcast_if_small(gone), same, "left_anti")
    if repeated.isEmpty():
        return left
    repeated = broadcast_if_small(repeated)
    once = left.join(repeated, same).dropDuplicates([id_, hash_]).select(*docs.columns)
    return left.join(repeated, same, "left_anti").unionByName(once)


#: The same for DuckDB with three words and 85 per cent, by counting the shingles that documents share.
SQL = r"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    shingles as (
        select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    common as (
        select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id != b.doc_id group by all),
    links as (
        select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
    reach as (
        select doc_id, doc_id as other from documents
        union select r.doc_id, l.b from reach r join links l on l.a = r.other),
    found as (select doc_id, min(other) as component_id from reach group by doc_id)
    select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, f.component_id, d.doc_id = f.component_id as kept
    from documents d join found f using (doc_id) left join sizes s using (doc_id)"""
