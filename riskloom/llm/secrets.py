"""Secret scans: plain patterns, and character Markov models that add random-looking strings.

Two first-order models of character pairs, one of random strings and one of ordinary identifiers, are compared
by their mean log-likelihood ratio.  Everything is column expressions; where a match stands is found by
cutting the text into (gap, match) pieces from one match's end to the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hashed_sample, text_or_empty, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A match of AKIA[A-Z0-9]+ or [0-9a-f]+ is a whole run, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
STRING = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Matches whose spans are gathered at once.
PART = 256
SPAN = "struct<start:int,kind:int,end:int>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def _spans(text: Column, pattern: str, kind: int, keep: str = "true") -> Column:
    """All matches of a pattern as (start, kind, end), leftmost and non-overlapping; ``keep`` may look at ``hit``."""
    cut = F.lit(rf"(?s)\G(.*?)({pattern})")
    pieces = F.arrays_zip(F.regexp_extract_all(text, cut, F.lit(1)).alias("gap"), F.regexp_extract_all(text, cut, F.lit(2)).alias("hit"))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(_keep(piece["hit"], keep), F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    def add_all(state: Column, some: Column) -> Column:
        more = F.aggregate(some, F.struct(state["at"].alias("at"), _none().alias("spans")), add)
        return F.transform(F.array(more), lambda m: F.struct(m["at"].alias("at"), F.concat(state["parts"], F.array(m["spans"])).alias("parts")))[0]

    # An array is copied when it grows; growing by parts keeps texts of very many matches cheap.
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / F.lit(PART)).cast("int")), lambda i: F.slice(pieces, i * PART + 1, PART))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("parts"))
    found = F.aggregate(parts, begin, add_all, lambda s: F.flatten(s["parts"]))
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _keep(hit: Column, keep: str) -> Column:
    if keep == "value":
        return F.length(F.regexp_extract(hit, f"(?s)^{ASSIGN}", 1)) >= 8
    if keep == "mixed":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The patterns' spans by start, then kind as listed."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, "value"), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def learn(docs: DataFrame, most: int = 1000, smooth: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """Log ratios (random over ordinary) of the next character given the one before, row by row over ``ALPHABET``.

    Samples: in at most ``most`` documents with a plain secret, drawn by hashed id, the secrets' values are
    random strings, and runs of six or more letters or underscores ordinary identifiers.  What reaches the
    driver are at most two counts for each pair of characters.
    """
    texts = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text")).where("_id is not null")
    secret = F.col("_text").rlike(f"{ACCESS}|{HEX}|{ASSIGN}")
    ids = hashed_sample(texts.where(secret).select("_id").distinct(), "_id", most)
    drawn = texts.join(F.broadcast(ids), "_id")  # at most ``most`` ids
    of = lambda pattern, group: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    random = F.filter(F.array_distinct(F.concat(of(ASSIGN, 1), of(ACCESS, 0), of(HEX, 0))), lambda v: F.length(v) >= 16)
    ordinary = F.array_distinct(of("[A-Za-z_]{6,}", 0))
    words = drawn.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("values")), F.struct(F.lit(0).alias("random"), ordinary.alias("values")))).alias("w"))
    words = words.select("w.random", F.explode("w.values").alias("value"))
    pairs = words.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    rows = []
    for a in ALPHABET:
        total = [sum(counts.get((k, a + b), 0) for b in ALPHABET) + smooth * len(ALPHABET) for k in (0, 1)]
        rows += [math.log((counts.get((1, a + b), 0) + smooth) / total[1]) - math.log((counts.get((0, a + b), 0) + smooth) / total[0]) for b in ALPHABET]
    return rows


def _ratio(word: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's character pairs."""
    table = F.lit([float(x) for x in ratios])
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(word, i, F.lit(1)))
    steps = F.sequence(F.lit(1), F.length(word) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.element_at(table, ((place(i) - 1) * len(ALPHABET) + place(i + 1)).cast("int")))
    return total / (F.length(word) - 1)


def find_spans(docs: DataFrame, ratios: list[float], least: float = 0.1, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds two columns to ``docs``: the plain spans, and these with the model's, as arrays of (start, kind, end).

    ``kind`` is a place in ``KINDS``.  The model judges runs of 20 or more characters with letters and digits
    and takes those whose mean ratio is at least ``least`` and that touch no plain span.  Null and empty texts
    have none.  No shuffle, no Python; positions are in code points.
    """
    out = docs.withColumn(base, base_spans(text_or_empty(text)))
    runs = unused(out, "_runs")
    strings = out.withColumn(runs, _spans(text_or_empty(text), STRING, 3, "mixed"))
    free = lambda x: ~F.exists(F.col(base), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    word = lambda x: F.substring(text_or_empty(text), x["start"] + 1, x["end"] - x["start"])
    more = F.filter(runs, lambda x: free(x) & (_ratio(word(x), ratios) >= least))
    found = strings.withColumn(spans, F.when(F.size(runs) == 0, F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), more))))
    return found.drop(runs)


def joined(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts of the plain kinds, base_sha256, spans, n_spans (all of them).

    Null texts count as empty and have none; null ids and repeated rows are kept as they are; other columns aren't read; an
    empty table gives an empty table.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_spans(picked, learn(docs, doc_id=doc_id, text=text)).select("doc_id", "base", "spans")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in (0, 1, 2)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` in its text; all other rows and columns as they were.

    Spans that touch are masked as one.
    """
    base, spans = unused(docs, "_base"), unused(docs, "_spans")
    found = find_spans(docs, learn(docs, doc_id=doc_id, text=text), text=text, base=base, spans=spans)

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(F.col(text), state["at"] + 1, span["start"] - state["at"])
        begun = F.when(span["start"] >= state["at"], F.concat(state["said"], F.array(gap, F.when((span["start"] > state["at"]) | (state["at"] == 0), F.lit(mask)).otherwise(F.lit("")))))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), begun.otherwise(state["said"]).alias("said"))

    rest = lambda s: F.concat(F.array_join(s["said"], ""), F.substring(F.col(text), s["at"] + 1, F.length(F.col(text))))
    masked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("said")), add, rest)
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text))).drop(base, spans)
