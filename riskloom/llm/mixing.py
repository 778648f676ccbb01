"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are).
The exponent is the nearest to 1 that meets a target entropy or a limit on repetition, found by bisection,
four halvings a job.  Each source's documents are then streamed in one hashed permutation after another
until its part of the budget is used, and the streams are cut into blocks that each hold every source at its
weight.  Running token counts are taken in three steps (groups of hash slices, slices of a group, rows within a slice), and
rows that are equal count as one with a number of copies, so no source, however large, is ordered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import settle, unused

BLOCK_TOKENS = 1_000_000
SLICE_TOKENS = 1_000_000
SMALL_ROWS = 100_000
#: Slices in a group.
SLICES = 4096
GRID = 16
ROUNDS = 6


@dataclass
class Mix:
    """``sources``: source, tokens, weight, repeats (how often each of its tokens is used, on average)."""

    sources: DataFrame
    exponent: float
    budget: float


def words(text: str = "text") -> Column:
    """Words of a text, at least one: what a document counts where no tokens are given."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+"))).cast("long")


def _least_bad(known: DataFrame, largest: float, budget: float | None, entropy: float | None, repeats: float | None) -> float:
    """The largest exponent in 0 to 1 that meets the target; entropy falls and repetition, too, as it rises towards 1."""
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(largest)
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        each = known.select(share.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("a"))
        rows = each.groupBy("a").agg(
            F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("pl"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.count("*").alias("n"), F.sum("p").alias("all")
        ).orderBy("a").collect()

        def meets(r) -> bool:
            if entropy is not None:
                return math.log(r["z"]) - r["a"] * r["pl"] / r["z"] >= entropy * math.log(max(r["n"], 2)) - 1e-12
            assert repeats is not None
            used = largest * r["z"] if budget is None else budget
            return used * r["most"] / (r["z"] * largest) <= repeats + 1e-12

        if entropy is not None:  # met below some exponent
            good = [i for i, r in enumerate(rows) if meets(r)]
            at = max(good, default=0)
            low, high = grid[at], grid[min(at + 1, GRID)]
        else:  # met above some exponent
            bad = [i for i, r in enumerate(rows) if not meets(r)]
            at = max(bad, default=-1)
            if at < 0:
                return low
            low, high = grid[at], grid[min(at + 1, GRID)]
    return low if entropy is not None else high


def _source(c: str) -> Column:
    return F.col(c).cast("string")


def plan(docs: DataFrame, budget: float | None = None, entropy: float | None = None, repeats: float | None = None, source: str = "source", tokens: Column | None = None) -> Mix:
    """Weights for the sources of ``docs``, by a target ``entropy`` (share of the greatest) or limit of ``repeats``.

    Without ``budget`` every document is used at least once: the budget is the least at which the source that
    is repeated least is used whole.  With an entropy target the exponent is the largest that meets it; with a
    repetition limit the smallest.  If a budget exceeds the limit even at exponent 1 it is cut to the limit.
    A null source is a source of its own.  Without targets weights are the token shares.
    """
    count = words() if tokens is None else tokens
    known = settle(docs.select(_source(source).alias("source"), count.alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    top = known.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("all")).first()
    if not top["most"]:
        return Mix(known.withColumns({"weight": F.lit(0.0), "repeats": F.lit(0.0)}), 1.0, 0.0)
    largest = float(top["most"])
    if budget is not None and repeats is not None:
        budget = min(budget, repeats * float(top["all"]))
    exponent = 1.0 if entropy is None and repeats is None else _least_bad(known, largest, budget, entropy, repeats)
    powered = known.withColumn("powered", F.pow(F.col("tokens") / F.lit(largest), F.lit(exponent)))
    z = float(powered.agg(F.sum("powered")).first()[0])
    used = largest * z if budget is None else float(budget)
    sources = powered.select("source", "tokens", (F.col("powered") / F.lit(z)).alias("weight"))
    return Mix(settle(sources.withColumn("repeats", F.round(F.col("weight") * F.lit(used) / F.col("tokens"), 9))), exponent, used)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _on_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _running(df: DataFrame, by: list[str], order: list[str], what: str, out: str = "before") -> DataFrame:
    """Adds what the rows before sum up to."""
    up_to = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(what).over(up_to), F.lit(0)))


def blocks(docs: DataFrame, mix: Mix, block_tokens: int = BLOCK_TOKENS, seed: int = 0, doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """A row for each use of a document: doc_id, source, tokens, epoch (from 0), block, slot (from 1), and the hash it is ordered by.

    The texts are read only to count their words and to hash them (so that null and repeated ids are spread).  Rows that are
    equal in id, source, tokens and text stand one after another; other ties of the hash are ordered by id.  A document on
    the budget's edge is used if it begins within it.  Null ids and sources take part; an empty table gives an empty one.
    Of other columns only those named are read.
    """
    count = words() if tokens is None else tokens
    text_hash = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _source(source).alias("source"), count.alias("tokens"), text_hash.alias("th"))
    rows = rows.groupBy("doc_id", "source", "tokens", "th").agg(F.count("*").alias("copies"))  # shrinks before the shuffle
    sources = mix.sources.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(SLICE_TOKENS)))).withColumnRenamed("tokens", "source_tokens")
    sources = _small(settle(sources))
    used = rows.join(sources, _on_source(rows, sources)).drop(sources["source"]).where("repeats > 0")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil("repeats") - 1).cast("int"))))
    used = used.withColumn("u", permuted(seed, F.col("epoch"), F.col("doc_id"), F.col("th"))).withColumn("slice", F.floor(F.col("u") / F.lit(float(2**63)) * F.col("slices")))
    used = settle(used)
    parts = used.groupBy("source", "epoch", "slice").agg(F.sum(F.col("tokens") * F.col("copies")).alias("sum")).withColumn("group", F.floor(F.col("slice") / F.lit(SLICES)))
    groups = parts.groupBy("source", "epoch", "group").agg(F.sum("sum").alias("sum"))
    parts, groups = _running(parts, ["source", "epoch", "group"], ["slice"], "sum"), _running(groups, ["source", "epoch"], ["group"], "sum")
    groups = groups.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("group").alias("_g"), F.col("before").alias("_before"))
    parts = parts.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("group") == F.col("_g")))
    parts = parts.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("slice").alias("_l"), (F.col("before") + F.col("_before")).alias("before"))
    placed = _running(used.withColumn("sum", F.col("tokens") * F.col("copies")), ["source", "epoch", "slice"], ["u", "doc_id", "th"], "sum", "inside")
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("slice") == F.col("_l")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    place = F.col("epoch") * F.col("source_tokens") + F.col("before") + F.col("inside") + F.col("copy") * F.col("tokens")
    placed = placed.withColumn("place", place).where(F.col("place") < F.col("repeats") * F.col("source_tokens"))
    placed = placed.withColumn("block", F.floor(F.col("place") / (F.col("weight") * F.lit(float(block_tokens)))))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "u"), "u", "doc_id", "epoch", "copy")
    return placed.select("doc_id", "source", "tokens", "epoch", "block", F.row_number().over(order).cast("long").alias("slot"), "u")


def permuted(seed: int, epoch: Column, doc_id: Column, text_hash: Column) -> Column:
    """A document's place in the permutation of an epoch: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id, text_hash), 1)


def mixed(docs: DataFrame, repeats: float = 4.0, budget: float | None = None, entropy: float | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture as rows of ``blocks``."""
    mix = plan(docs, budget, entropy, None if entropy is not None else repeats, source)
    return blocks(docs, mix, doc_id=doc_id, source=source).drop("u")


def mix_documents(docs: DataFrame, repeats: float = 2.0, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mixture uses it, at least once; its columns as they were.

    Rows that are equal in id and text are used equally often; null ids and sources take part; an empty table stays empty.  The whole texts aren't shuffled: a source's last, partial epoch ends at a hash value, known from ``blocks``.
    """
    placed = blocks(docs, plan(docs, repeats=repeats, source=source), doc_id=doc_id, source=source)
    last = Window.partitionBy("source")
    ends = placed.groupBy("source", "epoch").agg(F.max("u").alias("end")).withColumn("last", F.max("epoch").over(last)).where("epoch = last")
    own, at, end, n = (unused(docs, c) for c in ("_source", "_last", "_end", "_n"))
    ends = _small(settle(ends.select(F.col("source").alias(own), F.col("last").alias(at), F.col("end").alias(end))))
    rows = docs.join(ends, _source(source).eqNullSafe(F.col(own)), "left")
    u = permuted(0, F.col(at), F.col(doc_id), F.xxhash64("text") if "text" in docs.columns else F.lit(0))
    times = F.coalesce(F.col(at) + F.when(u <= F.col(end), 1).otherwise(0), F.lit(1))
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).select(*docs.columns)
