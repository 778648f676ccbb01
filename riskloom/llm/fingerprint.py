"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A cell holds a count, the xor of its digests and the xor of their check values.  Each digest is placed in three cells, one
in each part of the sketch.  The cells of one version subtracted from those of another leave the digests in which the two
differ; peeling takes out the cells that hold a single one until none is left.  A sketch has a level L: its parts have 2^L
cells, and the places follow from a hash that is another one at each level.  A fingerprint is the sketch of the lowest level
with two places in each part for every digest, so it peels to all its digests.  So two fingerprints can be compared wherever
they are kept: at the higher of their levels, where the other's digests are sketched again; and where peeling gets stuck, both
at the next level, and so on.

A paragraph is a line.  Long lines are cut where the content says so, after a mark or after certain letters before a blank,
so that an edit changes the paragraphs around it only, and the number of paragraphs grows with the text.

All of it is column expressions, and each step is linear in the digests but for sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The beginning of a text is cut more finely, so that short texts have several paragraphs: (characters, least length there, least length after).
HEAD, LEAST_HEAD, LEAST = 256, 16, 192
#: A stretch without a place to cut is cut after so many characters.
LONGEST = 1024
#: Where a long line may be cut: after a mark, or a blank that follows one of these letters. Later on places are rare beside
#: the least length, so that cuts fall into step again soon after an edit.
OFTEN = r"[.!?,;:\u3001\u3002\uff0c\uff0e]|(?<=[agkmopuvwzáéíóúа-яà-ö])\x20"
SELDOM = r"[.!?\u3002\uff0e]|(?<=[kpwzàа-г])\x20"
#: Levels that are tried one after another.
LEVELS = 12
ROWS_A_BUCKET, MOST_BUCKETS = 512, 16384


def _cuts(least: int, places: str) -> str:
    """A pattern for the paragraphs of a stretch of text; none is empty, together they are the whole."""
    return rf"[^\n]{{{least},{LONGEST}}}?(?:{places})|[^\n]{{1,{LONGEST}}}|\n"


def paragraph_digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs."""
    head = f"regexp_extract_all(left({text}, {HEAD}), r'{_cuts(LEAST_HEAD, OFTEN)}', 0)"
    rest = f"if(length({text}) > {HEAD}, regexp_extract_all(substring({text}, {HEAD + 1}), r'{_cuts(LEAST, SELDOM)}', 0), array())"
    return f"array_distinct(transform(concat({head}, {rest}), p -> xxhash64(p)))"


def _check(digest: str) -> str:
    return f"xxhash64({digest}, 1000003L) & 4294967295L"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _placed(signed: str, level: str) -> str:
    """SQL: the three cells of each (n: 1 or -1, k: digest), as cells of their own."""
    place = f"cast(q * shiftleft(1, {level}) + pmod(shiftrightunsigned(z.h, 21 * q), shiftleft(1, {level})) as int)"
    cell = f"named_struct('p', {place}, 'n', z.n, 'k', z.k, 'c', z.c)"
    hashed = f"transform({signed}, e -> named_struct('n', e.n, 'k', e.k, 'h', xxhash64(e.k, {level}), 'c', {_check('e.k')}))"
    return f"flatten(transform({hashed}, z -> transform(sequence(0, 2), q -> {cell})))"


def _signed(digests: str, n: int) -> str:
    return f"transform({digests}, d -> named_struct('n', {n}, 'k', d))"


def _merged(cells: str) -> str:
    """SQL: cells of the same place added up; those that come to nothing go. Sorted by place, as runs."""
    total = (
        "aggregate(slice(s, a + 1, coalesce(get(t, j + 1), size(s)) - a), named_struct('p', s[a].p, 'n', 0, 'k', 0L, 'c', 0L),"
        " (u, x) -> named_struct('p', u.p, 'n', u.n + x.n, 'k', u.k ^ x.k, 'c', u.c ^ x.c))"
    )
    begins = "filter(transform(s, (x, i) -> if(i = 0, 0, if(x.p = s[i - 1].p, -1, i))), i -> i >= 0)"
    runs = f"filter(transform(t, (a, j) -> {total}), u -> u.n != 0 or u.k != 0 or u.c != 0)"
    return _let(f"sort_array({cells})", "s", _let(begins, "t", runs))


def cells(digests: str, level: str) -> str:
    """SQL: a sketch: its cells that hold something, by place."""
    return _merged(_placed(_signed(digests, 1), level))


def _peeled(sketch: str, level: str) -> str:
    """SQL: how many digests a sketch peels to; null if it gets stuck."""
    of_sign = lambda n: f"array_distinct(transform(filter(w.cells, x -> x.n = {n} and x.c = {_check('x.k')}), x -> x.k))"
    single = f"concat({_signed(of_sign(1), -1)}, {_signed(of_sign(-1), 1)})"
    less = _merged(f"concat(w.cells, {_placed('single', level)})")
    step = f"if(size(single) = 0, named_struct('cells', w.cells, 'found', w.found, 'over', true), named_struct('cells', {less}, 'found', w.found + size(single), 'over', false))"
    begin = f"named_struct('cells', {sketch}, 'found', 0, 'over', false)"
    return f"aggregate(sequence(1, 64), {begin}, (w, r) -> if(w.over or size(w.cells) = 0, w, {_let(single, 'single', step)}), w -> if(size(w.cells) = 0, w.found, cast(null as int)))"


def level(digests: str) -> str:
    """SQL: the level of a text's fingerprint: the lowest with two places in each part for a digest, where no two have the same three."""
    least = f"cast(ceil(log2(greatest(size({digests}), 2) * 2.0)) as int)"
    bits = "(l + i) & 31"
    places = " | ".join(f"shiftleft(pmod(shiftrightunsigned(h, {21 * q}), shiftleft(1L, {bits})), {21 * q})" for q in range(3))
    apart = f"size(array_distinct(transform(transform({digests}, d -> xxhash64(d, l + i)), h -> {places}))) = size({digests})"
    return _let(least, "l", f"aggregate(sequence(0, {LEVELS - 1}), cast(null as int), (f, i) -> if(f is not null, f, if({apart}, l + i, cast(null as int))), f -> coalesce(f, l))")


def _side(own: str, own_level: str, digests: str, n: int) -> str:
    """SQL: a sketch at the level of this try, added (n = 1) or subtracted: the fingerprint's own, or placed anew."""
    signed = own if n == 1 else f"transform({own}, x -> named_struct('p', x.p, 'n', -x.n, 'k', x.k, 'c', x.c))"
    return f"if(i = 0 and {own_level} = l, {signed}, {_placed(_signed(digests, n), '(l + i)')})"


def differing(a: str, b: str) -> str:
    """SQL: how many digests are in one of two fingerprints only, given by the prefix of their columns: sketches subtracted and peeled.

    That the sketches of all levels get stuck has a chance of less than 1e-30; then all count as differing.
    """
    sides = [_side(f"{x}_cells", f"{x}_level", x, n) for x, n in ((a, 1), (b, -1))]
    apart = _merged(f"concat({', '.join(sides)})")
    tries = f"aggregate(sequence(0, {LEVELS - 1}), cast(null as int), (f, i) -> if(f is not null, f, {_peeled(apart, '(l + i)')}))"
    return _let(f"greatest({a}_level, {b}_level)", "l", f"coalesce({tries}, size({a}) + size({b}))")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two fingerprints, from what their sketches peel to; two empty ones are alike (1.0)."""
    total = f"(size({a}) + size({b}))"
    return F.expr(f"if({total} = 0, 1.0d, {_let(differing(a, b), 'n', f'({total} - n) / cast({total} + n as double)')})")


def sketched(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a fingerprint's parts: the digests (column ``out``), ``out_level`` and ``out_cells``."""
    docs = docs.withColumn(out, F.expr(paragraph_digests(text)))
    return _celled(docs, out)


def _celled(docs: DataFrame, out: str) -> DataFrame:
    docs = docs.withColumn(f"{out}_level", F.expr(level(out)))
    return docs.withColumn(f"{out}_cells", F.expr(cells(out, f"{out}_level")))


def fingerprint(out: str) -> Column:
    """The sketch as text: number of digests, level, then place, count, digests and checks of each cell that holds something, in hex."""
    cell = "concat_ws('.', hex(x.p), cast(x.n as string), hex(x.k), hex(x.c))"
    return F.lower(F.expr(f"concat_ws(':', size({out}), {out}_level, array_join(transform({out}_cells, x -> {cell}), ';'))"))


def _bucket(bounds: list[int], id_: Column, u: Column) -> Column:
    """How many bounds are above an id; the rows of an id that is several bounds at once are dealt among its buckets by ``u`` (0 to 1)."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, round(len(bounds) ** 0.5))
    fine = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    first = [bounds[i] for i in range(0, len(bounds), step)]
    above = lambda xs: F.size(F.filter(xs, lambda b: b > id_))
    part = F.greatest(above(F.array(*map(F.lit, first))), F.lit(1))  # bounds descend
    count = (part - 1) * step + above(F.element_at(fine, part))
    times: dict[int, int] = {}
    for b in bounds:
        times[b] = times.get(b, 0) + 1
    buckets = {b: n + 1 for b, n in times.items() if n > 1}
    if buckets:
        of_id = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in buckets.items() for x in pair]), id_)
        count = count + F.floor(u * F.coalesce(of_id, F.lit(0)))
    return count.cast("long")


def with_next(docs: DataFrame, carried: str) -> DataFrame:
    """Adds ``next_text`` and ``next_<carried>`` of the next row by descending doc_id (null ids last, ties by the text's hash), after the last the first.

    Rows are dealt into buckets of about ``ROWS_A_BUCKET`` rows (more where there would be over ``MOST_BUCKETS``) between
    quantiles of the ids, an id of many rows and null ids by the hash, whatever the ids are.  The head of each bucket is given
    to the bucket before as a last row, so the next row is found within a bucket.  Texts are shuffled once.  The driver
    gets one id a bucket.  Rows equal in id and text are in one bucket.
    """
    rows = docs.withColumn("h", F.xxhash64("text"))
    u = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(float(2**53))
    counted = rows.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n, nulls = (min(MOST_BUCKETS, max(1, -(-counted[c] // ROWS_A_BUCKET))) for c in ("n", "nulls"))
    bounds = []
    if n > 1:
        at = [i / n for i in range(n - 1, 0, -1)]
        bounds = rows.agg(F.percentile_approx("doc_id", at, max(10000, 10 * n)).alias("q")).first()["q"]
    by_hash = F.lit(n) + F.floor(u * nulls)
    rows = rows.withColumn("bucket", F.coalesce(F.when(F.col("doc_id").isNotNull(), _bucket(bounds, F.col("doc_id"), u)), by_hash).cast("long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.bitwise_not("doc_id").alias("i"), F.col("h").alias("h"))).alias("head")
    heads = sorted(((r["bucket"], r["i"], r["h"]) for r in rows.groupBy("bucket").agg(first).select("bucket", F.bitwise_not("head.i").alias("i"), "head.h").collect()), key=lambda r: r[0])
    wanted = [(heads[k - 1][0], i, h) for k, (_, i, h) in enumerate(heads)]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(wanted, "before bigint, head_id bigint, head_h bigint"))  # a row a bucket
    ghosts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    columns = ["doc_id", "text", carried, "h"]
    both = rows.select(*columns, "bucket", F.lit(False).alias("ghost")).unionByName(ghosts.select(*columns, F.col("before").alias("bucket"), F.lit(True).alias("ghost")))
    by = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    after = both.withColumns({"next_text": F.lead("text").over(by), f"next_{carried}": F.lead(carried).over(by)})
    return after.where("not ghost").drop("ghost", "bucket", "h")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness; a row for each row of ``docs``.

    The edited text has its last third (rounded down, in code points) replaced by as many of the next text's first code
    points, or all of them.  Null texts count as empty: no paragraphs.  ``doc_id`` must be a number or text of a whole
    number that fits a long.  Null and repeated ids are rows of their own (see ``with_next``); a single row is its own
    next.  Other columns are not read; an empty table gives an empty table.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(picked.withColumn("a", F.expr(paragraph_digests("text"))), "a").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))")
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = sketched(_celled(_celled(rows, "a"), "next_a"), "edited", "b")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("a").alias("fingerprint"), fingerprint("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "next_a").alias("near_next"),
    )
