"""Near-duplicate vectors by NN-descent on Spark.

Equal vectors of a label are one class.  The neighbour graph of the classes begins with the nearest within small cells of
random hyperplanes, in as many tables of cells as make any two vectors at the threshold meet but for a chance of ``MISS``.
It is refined in rounds: each node brings together its neighbours and those that name it, and these become neighbours of
each other where they are nearer than what they have.  A list full of links at the threshold is saturated and may be twice
as long in the next round, up to ``MOST_LIST``.  Rounds end when they add next to no links.  Edges at the threshold are kept, checked in double
precision on rows of one label.

Lists don't name every link of a large group.  So each cell also gives a spanning forest of its links, and links are
counted at the end within whole components: one that lies within half the threshold's angle around its centre is linked
throughout, others are multiplied block by block.

An audit compares a sample of vectors with all rows of their label, until it has seen enough true links, and says what
share of them lies within components.  While links are missing, as many tables again are made; after ``GENERATIONS`` of
them the components of a label are compared exactly by their middles and widest angles, and by their members where these
don't rule a link out.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import broadcast_if_small, hashed_sample, per_batch, release, settle, small_batches
from riskloom.llm.graph import components

log = logging.getLogger(__name__)

#: Rows in a cell on average, and at most: the rest of a larger one are cut off in the order of further hyperplanes.
CELL, MOST_CELL = 512, 2048
#: Hyperplanes at most; the chance that two vectors at the threshold meet in no table of a generation.
PLANES, MISS, GENERATIONS = 40, 1e-3, 3
LIST, MOST_LIST, MOST_ROUNDS, FEW = 8, 16, 10, 0.01
#: A node brings together neighbours that are at least so near to it.
WANDER = 0.5
#: Vectors of a sample that are compared with all rows, at first and at most, and how many true links are enough.
QUERIES, MOST_QUERIES, ENOUGH_LINKS = 512, 8192, 300
BLOCK = 2048
#: Components in a block whose middles are compared.
CENTRES = 8192
#: Single precision is this close.
SLACK = 1e-5


def _valid(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, key (of label and components), unit (double); the last two null for vectors that can't link."""

    def worker():
        def work(columns: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"vec_id": columns["vec_id"], "label": columns["label"], "key": [], "unit": []}
            for of, v in zip(columns["label"], columns["vector"], strict=True):
                x = None if of is None or v is None or None in v or not v else np.array(v, float)
                top = 0.0 if x is None else float(np.abs(x).max())
                if x is None or not math.isfinite(top) or top == 0:
                    out["key"].append(None)
                    out["unit"].append(None)
                    continue
                out["key"].append(xxhash.xxh3_128_digest(x.tobytes()))
                x = x / top
                out["unit"].append(x / np.sqrt(x @ x))
            return out

        return work

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (vec_id, label)}
    picked = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return per_batch(picked, worker, f"vec_id {kinds[vec_id]}, label {kinds[label]}, key binary, unit array<double>")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows that come in the order of ``keys``, with the (begin, end) of each run of one key, cut after ``most`` rows."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def cut(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, list[tuple[int, int]]]:
        ends = [*starts[1:].tolist(), table.num_rows]
        return table, [(at, min(at + most, end)) for start, end in zip(starts.tolist(), ends, strict=True) for at in range(start, end, most)]

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        held = table
        if table.num_rows:
            starts = begins(table)
            whole = int(starts[-1]) + (table.num_rows - int(starts[-1])) // most * most  # of a long run, full parts can go
            if whole:
                yield cut(table.slice(0, whole), starts[starts < whole])
            held = table.slice(whole)
    if held is not None and held.num_rows:
        yield cut(held, begins(held))


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the column of vectors, and where each vector begins."""
    column = table["unit"].combine_chunks()
    return column.values.to_numpy(), column.offsets.to_numpy()


FOUND = "node bigint, other bigint, near double, link boolean"
LISTED = "node bigint, other bigint, near double"


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _forest(s: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs that join whatever links join, as few as possible; pairs too close to the threshold for single precision all."""
    sure = s >= threshold + SLACK
    out = np.argwhere(np.triu((s >= threshold - SLACK) & ~sure, 1)).tolist()
    new = sure.any(1)
    for root in np.flatnonzero(new).tolist():
        if not new[root]:
            continue
        new[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            more = np.flatnonzero(sure[i] & new).tolist()
            new[more] = False
            out += [(i, j) for j in more]
            todo += more
    return out


def _nearest(s: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a square of cosines (or a stack of them), each row's greatest: where they are, and how great."""
    k = min(top, s.shape[-1])
    at = np.argpartition(-s, k - 1, -1)[..., :k]
    return at, np.take_along_axis(s, at, -1)


def _cells(classes: DataFrame, threshold: float, generation: int) -> DataFrame:
    """(node, other, near, link) from the cells of one generation of tables: each node's nearest, and forests of links.

    All tables are sorted by label and the signs to all hyperplanes, in even ranges; a cell is a run of rows that share
    the first signs, as many as a label of its size needs.  So a label, or a crowd of vectors in one direction,
    however large, is dealt to many tasks.
    """
    meet = 1 - math.acos(threshold) / math.pi
    n = F.col("n").cast("double")
    bits = F.when(F.col("n") <= MOST_CELL, 0).otherwise(F.least(F.lit(PLANES), F.ceil(F.log2(n / F.lit(float(CELL)))))).cast("int")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("_l"), bits.alias("bits"))
    rows = classes.join(broadcast_if_small(sizes), F.col("label") == F.col("_l")).select("label", "node", "bits", "unit")
    kind = classes.schema["label"].dataType.simpleString()
    place = f"label {kind}, width int, cell bigint, place bigint, node bigint, unit array<float>"

    def worker():
        planes: dict[tuple[int, int], np.ndarray] = {}

        def tables(bits: int) -> range:
            if bits == 0:
                return range(1 if generation == 0 else 0)  # a single cell: nothing to add
            many = math.ceil(math.log(MISS) / math.log1p(-(meet**bits)))
            return range(generation * many, (generation + 1) * many)

        def work(columns: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("label", "width", "cell", "place", "node", "unit")}
            alike: dict[tuple[int, int], list[int]] = {}
            for i, u in enumerate(columns["unit"]):
                alike.setdefault((len(u), columns["bits"][i]), []).append(i)
            for (width, bits), rows in alike.items():
                x = np.array([columns["unit"][i] for i in rows], np.float32)
                labels, nodes = [columns["label"][i] for i in rows], [columns["node"][i] for i in rows]
                for t in tables(bits):
                    if (t, width) not in planes:
                        planes[t, width] = np.random.default_rng([t, width]).standard_normal((width, PLANES)).astype(np.float32)
                    code = ((x @ planes[t, width] > 0) << np.arange(PLANES - 1, -1, -1, dtype=np.int64)).sum(1) + (t << PLANES)
                    out["label"] += labels
                    out["node"] += nodes
                    out["width"] += [width] * len(rows)
                    out["place"] += code.tolist()
                    out["cell"] += (code >> (PLANES - bits)).tolist()
                    out["unit"] += list(x)
            return out

        return work

    coded = per_batch(rows, worker, place, most=200)
    order = ["label", "width", "place", "node"]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "width", "cell", "node", "unit")
    small_batches(classes.sparkSession)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, parts in _runs(batches, ["label", "width", "cell"], MOST_CELL):
            (values, offsets), nodes = _units(table), table["node"].to_numpy()
            for begin, end in parts:
                size = end - begin
                if size < 2:
                    continue
                x, node = values[offsets[begin] : offsets[end]].reshape(size, -1), nodes[begin:end]
                s = x @ x.T
                np.fill_diagonal(s, -2)
                at, near = _nearest(s, min(LIST // 2, size - 1))
                yield _batch(node=np.repeat(node, at.shape[1]), other=node[at.ravel()], near=near.ravel().astype(float), link=np.zeros(at.size, bool))
                if joined := _forest(s, threshold):
                    i, j = np.array(joined).T
                    yield _batch(node=node[i], other=node[j], near=s[i, j].astype(float), link=np.ones(len(i), bool))
        release()

    return settle(ranged.mapInArrow(pair, FOUND))


def _best(found: DataFrame, threshold: float, longest: int) -> DataFrame:
    """Each node's nearest ``LIST``, or ``longest`` where the first ``LIST`` are all links."""
    once = found.groupBy("node", "other").agg(F.max("near").alias("near"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.col("near").desc(), "other")))
    return ranked.where((F.col("rank") <= LIST) | ((F.col("rank") <= longest) & (F.col("near") >= threshold))).select("node", "other", "near")


def _round(lists: DataFrame, classes: DataFrame, threshold: float, longest: int) -> DataFrame:
    """One step of the descent: what a node's neighbours find among themselves joins the lists."""
    wide = 2 * longest
    close = lists.where(F.col("near") >= WANDER)
    ways = close.unionByName(close.select(F.col("other").alias("node"), F.col("node").alias("other"), "near"))
    ways = ways.groupBy("node", "other").agg(F.max("near").alias("near"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("near").desc(), "other"))
    ways = ways.withColumn("rank", rank).where((F.col("rank") <= 2 * LIST) | ((F.col("rank") <= wide) & (F.col("near") >= threshold)))
    met = ways.select(F.col("node").alias("centre"), F.col("other").alias("node"))
    units = classes.select("node", F.col("unit").cast("array<float>").alias("unit"))
    near = met.join(units, "node").repartition("centre").sortWithinPartitions("centre")
    small_batches(classes.sparkSession)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, parts in _runs(batches, ["centre"], wide):
            (values, offsets), nodes = _units(table), table["node"].to_numpy()
            of: dict[tuple[int, int], list[int]] = {}
            for begin, end in parts:  # groups of one size and width are multiplied together
                if end - begin > 1:
                    of.setdefault((end - begin, int(offsets[begin + 1] - offsets[begin])), []).append(begin)
            for (size, width), begins in of.items():
                rows = np.array(begins)[:, None] + np.arange(size)
                x, node = values[offsets[rows.ravel()][:, None] + np.arange(width)].reshape(len(begins), size, width), nodes[rows]
                s = x @ x.transpose(0, 2, 1)
                s[:, np.arange(size), np.arange(size)] = -2
                at, best = _nearest(s, min(LIST, size - 1))
                yield _batch(node=np.repeat(node.ravel(), at.shape[-1]), other=np.take_along_axis(node[:, None, :].repeat(size, 1), at, -1).ravel(), near=best.ravel().astype(float))
        release()

    return settle(_best(lists.unionByName(near.mapInArrow(pair, LISTED)), threshold, longest))


def _descend(lists: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rounds until they add no more than a share of ``FEW`` to the links (``MOST_ROUNDS`` at most).

    A saturated list grows to ``MOST_LIST``, which joins its group many times over; that longer lists would name all pairs of
    a group isn't needed, as cells give forests of their links and links are counted within components.
    """
    longest, linked = LIST, -1
    for _ in range(MOST_ROUNDS):
        longest = min(2 * longest, MOST_LIST)
        lists = _round(lists, classes, threshold, longest)
        before, linked = linked, lists.where(F.col("near") >= threshold).select(F.least("node", "other"), F.greatest("node", "other")).distinct().count()
        if linked <= before * (1 + FEW):
            break
    return lists


def _links(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of one label whose cosine is at the threshold in double precision."""
    pairs = pairs.where(F.col("near") >= threshold - 2 * SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"), F.col("unit").alias(f"unit_{end}")), end)
    cosine = F.aggregate(F.zip_with("unit_a", "unit_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return settle(pairs.where((F.col("label_a") == F.col("label_b")) & (cosine >= threshold)).select("a", "b"))


def _audit(classes: DataFrame, labels: DataFrame, threshold: float, salt: int) -> tuple[int, int, DataFrame]:
    """(true links seen, those within components, the others as (a, b)): a hashed sample against all rows of its labels.

    Each ``salt`` draws another sample, so that links that an audit added don't flatter the next.  The sample grows fourfold until ``ENOUGH_LINKS`` true links are seen, all rows are in it, or it has ``MOST_QUERIES``.
    """
    rows = classes.select("label", "node", "unit").join(labels.withColumnRenamed("label", "component"), "node", "left")
    rows = rows.select("label", "node", F.coalesce("component", "node").alias("component"), "unit")
    queries = QUERIES
    while True:
        drawn = hashed_sample(rows, "node", queries, salt).collect()  # at most MOST_QUERIES vectors
        by_label: dict = {}
        for r in drawn:
            by_label.setdefault((r["label"], len(r["unit"])), []).append((r["node"], r["component"], r["unit"]))
        shared = classes.sparkSession.sparkContext.broadcast({k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in by_label.items()})

        def worker(shared=shared):
            def work(columns: dict[str, list]) -> dict[str, list]:
                seen: dict[tuple[int, int, bool], int] = {}
                alike: dict = {}
                for i, u in enumerate(columns["unit"]):
                    alike.setdefault((columns["label"][i], len(u)), []).append(i)
                for key, rows in alike.items():
                    if key not in shared.value:
                        continue
                    node, component, x = shared.value[key]
                    for i, q in np.argwhere(np.array([columns["unit"][i] for i in rows]) @ x.T >= threshold).tolist():
                        other, of = columns["node"][rows[i]], columns["component"][rows[i]]
                        if other != node[q]:  # a missed component is named by one of its nodes
                            found = of == component[q]
                            a = (int(node[q]), -1 if found else of, found)
                            seen[a] = seen.get(a, 0) + 1
                return {"a": [k[0] for k in seen], "b": [k[1] for k in seen], "found": [k[2] for k in seen], "n": list(seen.values())}

            return work

        true = settle(per_batch(rows, worker, "a bigint, b bigint, found boolean, n bigint", most=500))
        sums = true.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("found")).first()
        if sums["all"] >= ENOUGH_LINKS or len(drawn) < queries or queries >= MOST_QUERIES:
            return sums["all"], sums["found"], true.where("not found").select("a", "b").distinct()
        queries *= 4


def _middles(rows: DataFrame) -> DataFrame:
    """(component, middle): the mean vector of each component."""
    each = rows.select("component", F.posexplode("unit").alias("at", "x")).groupBy("component", "at").agg(F.avg("x").alias("x"))
    middle = each.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("middle"))  # one value a dimension
    return middle.select("component", F.transform("middle", lambda m: m["x"]).alias("middle"))


def _meeting(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of two blocks of components, the pairs that may link by their middles and widest angles; pairs of single vectors are settled."""
    pdf = pdf.sort_values("component", ignore_index=True)
    x, node, single, mine = np.array(pdf["middle"].tolist()), pdf["component"].to_numpy(), pdf["single"].to_numpy(), pdf["mine"].to_numpy()
    long = np.sqrt((x * x).sum(1))
    wide = np.where(long < 1e-6, math.pi, pdf["widest"].to_numpy())
    x = x / np.maximum(long, 1e-6)[:, None]
    first, second = (np.flatnonzero(mine == pdf[c].iloc[0]) for c in ("i", "j"))
    root = list(range(len(x)))
    out = []
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        s = x[rows] @ x[second].T
        least = np.cos(np.minimum(math.pi, math.acos(threshold) + 1e-6 + wide[rows][:, None] + wide[second][None, :])) - 1e-9
        both = single[rows][:, None] & single[second][None, :]
        hit = np.where(both, s >= threshold, s >= least)
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            hit &= rows[:, None] < second[None, :]
        for a, b in np.argwhere(hit).tolist():
            sure, a, b = bool(both[a, b]), rows[a], second[b]
            if sure:  # as many as join these components
                ends = []
                for e in (a, b):
                    while root[e] != e:
                        root[e] = root[root[e]]
                        e = root[e]
                    ends.append(e)
                if ends[0] == ends[1]:
                    continue
                root[ends[0]] = ends[1]
            out.append((node[a], node[b], sure))
    return pd.DataFrame(out, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})


def _bridges(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the components, by their smallest node, between which there is a link that the descent missed; none is left out.

    The middles of all components of a label are compared, block by block.  Where two lie within the threshold's
    angle and both components' widest angles, the members are multiplied.
    """
    rows = classes.select("label", F.size("unit").alias("width"), "node", "unit").join(labels.withColumnRenamed("label", "component"), "node", "left")
    single = rows.where("component is null").select("label", "width", F.col("node").alias("component"), F.col("unit").alias("middle"), F.lit(0.0).alias("widest"), F.lit(True).alias("single"))
    many = rows.where("component is not null")
    dot = F.aggregate(F.zip_with("unit", "middle", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("middle", F.lit(0.0), lambda s, x: s + x * x))
    angle = F.when(norm > 1e-6, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))).otherwise(math.pi)
    many = many.join(_middles(many), "component").groupBy("label", "width", "component").agg(F.first("middle").alias("middle"), F.max(angle).alias("widest"), F.count("*").alias("n"))
    many = settle(many)
    all_ = single.unionByName(many.drop("n").withColumn("single", F.lit(False)))
    sizes = all_.groupBy("label", "width").agg(F.ceil(F.count("*") / F.lit(CENTRES)).cast("int").alias("blocks"))
    dealt = all_.join(broadcast_if_small(sizes), ["label", "width"]).withColumn("mine", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "width", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "component", "middle", "widest", "single")
    found = settle(dealt.groupBy("label", "width", "i", "j").applyInPandas(lambda pdf: _meeting(pdf, threshold), "a bigint, b bigint, sure boolean").distinct())

    # The larger of two components is the host, whose members the guest's members are multiplied with.
    pairs = found.where("not sure").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(many.select(F.col("component").alias(end), F.col("n").alias(f"n_{end}")), end, "left")
    first = F.coalesce("n_a", F.lit(1)) >= F.coalesce("n_b", F.lit(1))
    pairs = settle(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest")))
    members = rows.select(F.coalesce("component", "node").alias("component"), "node", "unit")
    sides = pairs.select("host", F.col("host").alias("component")).distinct().withColumn("hosts", F.lit(True)).unionByName(pairs.select("host", F.col("guest").alias("component")).withColumn("hosts", F.lit(False)))
    sides = sides.join(members, "component")
    counts = sides.groupBy("host").agg(F.ceil(F.count_if("hosts") / F.lit(CENTRES)).cast("int").alias("i"), F.ceil(F.count_if(~F.col("hosts")) / F.lit(CENTRES)).cast("int").alias("j"))
    sides = sides.join(counts, "host")
    of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    sides = sides.withColumn("mine", F.when(F.col("hosts"), of("i")).otherwise(of("j"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("hosts"), F.col("j")).otherwise(F.col("i")) - 1)))
    sides = sides.select("host", "hosts", "component", "unit", F.when(F.col("hosts"), F.col("mine")).otherwise(F.col("with")).alias("i"), F.when(F.col("hosts"), F.col("with")).otherwise(F.col("mine")).alias("j"))

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        hosts, guests = pdf[pdf["hosts"]], pdf[~pdf["hosts"]]
        hit = np.zeros(len(guests), bool)
        if len(hosts) and len(guests):
            x, y = np.array(hosts["unit"].tolist()), np.array(guests["unit"].tolist())
            for at in range(0, len(x), 256):
                hit |= (x[at : at + 256] @ y.T >= threshold).any(0)
        b = guests["component"].to_numpy()[hit]
        return pd.DataFrame({"a": np.full(len(b), pdf["host"].iloc[0]), "b": b}).drop_duplicates()

    met = sides.groupBy("host", "i", "j").applyInPandas(linked, "a bigint, b bigint")
    return settle(found.where("sure").select("a", "b").unionByName(met))


def _counts(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(node, links): how many vectors of other classes each class links with, by comparing whole components."""
    rows = settle(classes.select("node", "copies", "unit").join(labels.withColumnRenamed("label", "component"), "node"))
    middle = _middles(rows)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    long = F.sqrt(dot("middle", "middle"))
    angle = F.when(long > 1e-6, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("unit", "middle") / long)))).otherwise(math.pi)  # around no centre
    angled = rows.join(middle, "component").withColumn("angle", angle)
    sizes = settle(angled.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("copies").alias("all"), F.count("*").alias("n")))
    within = F.col("widest") < math.acos(threshold) / 2 - 1e-9
    tight = rows.join(sizes.where(within), "component").select("node", (F.col("all") - F.col("copies")).alias("links"))
    loose = rows.join(sizes.where(~within), "component").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    loose = loose.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    loose = loose.select("component", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "node", "copies", F.col("unit"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, copies, mine, links = np.array(pdf["unit"].tolist()), pdf["copies"].to_numpy(), pdf["mine"].to_numpy(), []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ x.T >= threshold
            s[np.arange(len(s)), np.arange(at, at + len(s))] = False
            if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
                s &= mine[at : at + 512, None] != mine[None, :]
            links.append(s @ copies)
        return pd.DataFrame({"node": pdf["node"], "links": np.concatenate(links)})

    multiplied = loose.groupBy("component", "i", "j").applyInPandas(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    return tight.unionByName(multiplied)


class Audit(NamedTuple):
    """What the last audit saw: true links of its sample, those within components, and whether all components were compared exactly afterwards."""

    seen: int
    within: int
    exact: bool

    @property
    def recall(self) -> float | None:
        """The share of true links within components, as measured before any exact comparison; None if too few were seen to say."""
        return self.within / self.seen if self.seen >= ENOUGH_LINKS else None


def _joined(classes: DataFrame, threshold: float) -> tuple[DataFrame, Audit]:
    """(node, label) of the linked classes, the smallest node of their component; and the last audit.

    Links that an audit finds missing are added, whatever follows.
    """
    lists = links = None
    for generation in range(GENERATIONS):
        found = _cells(classes, threshold, generation)
        own = found.where("not link").drop("link")
        lists = _descend(settle(_best(own if lists is None else lists.unionByName(own), threshold, LIST)), classes, threshold)
        new = _links(lists.unionByName(found.where("link").drop("link")), classes, threshold)
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        seen, within, missed = _audit(classes, labels, threshold, generation)
        if seen == within:
            return labels, Audit(seen, within, False)
        links = links.unionByName(missed)
        labels = components(links)
    bridges = _bridges(classes, labels, threshold)
    return components(links.unionByName(bridges)), Audit(seen, within, True)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Links vectors of one label whose cosine is at least ``threshold``; a row for each row of ``vectors``.

    Returns vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id that links
    reach, its own included), kept (vec_id = component_id).  Ids are of any type that can be ordered.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without label, link with nothing; vectors of different widths don't either.  Repeated rows count
    as vectors of their own; a null vec_id takes part, its own kept is false.  No vectors give no rows.

    Labels of up to ``MOST_CELL`` different vectors are one cell, that is, compared in whole; larger ones by the descent.
    """
    return audited_vectors(vectors, threshold, vec_id, vector, label)[0]


def audited_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Audit]:
    """``near_vectors``, and what the last audit of it saw."""
    rows = settle(_valid(vectors, vec_id, vector, label))
    good = rows.where("key is not null")
    classes = good.groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    named = classes.select("label", "key", "node", "id", "copies")
    audit = Audit(0, 0, True)
    if classes.isEmpty():
        named = named.withColumn("component_id", F.col("id")).withColumn("links", F.lit(0))
    else:
        labels, audit = _joined(classes, threshold)
        named = named.join(labels.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("id").alias("component_id"))
        named = named.join(least, "root").join(_counts(classes, labels, threshold), "node", "left")
    named = named.select(F.col("label").alias("_l"), F.col("key").alias("_k"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(named, (F.col("label") == F.col("_l")) & (F.col("key") == F.col("_k")))
    alone = rows.where("key is null").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    cols = ["vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id"]
    out = linked.select(*cols).unionByName(alone.select(*cols)).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    said = "not measured" if audit.recall is None else f"{audit.recall:.4f} within components"
    log.info("audit: %d true links seen, %s%s", audit.seen, said, ", then all compared" if audit.exact else "")
    return out, audit


#: The same for DuckDB, by comparing all pairs of a label.
SQL = """
    with recursive valid as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    units as (
        select vec_id, label, v, sqrt(list_dot_product(v, v)) as long from valid
        where label is not null and v is not null and len(v) > 0 and not list_contains(list_transform(v, lambda x: x is null or not isfinite(x)), true)),
    good as (select * from units where long > 0),
    links as (
        select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id != b.vec_id
        where list_dot_product(a.v, b.v) / (a.long * b.long) >= 0.93),
    reach as (
        select vec_id, vec_id as other from embeddings
        union select r.vec_id, l.b from reach r join links l on l.a = r.other),
    found as (select vec_id, min(other) as component_id from reach group by vec_id),
    counts as (select a as vec_id, count(*) as n from links group by a)
    select e.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, f.component_id, e.vec_id = f.component_id as kept
    from embeddings e join found f using (vec_id) left join counts c using (vec_id)"""
