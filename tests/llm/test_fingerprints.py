"""Fingerprints: likeness worked out again from the two strings alone, and neighbours in the order of ids."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def spark_hash(n, seed):
    """xxhash64(bigint, seed literal) as Spark chains it: an int literal is hashed as 4 bytes, a bigint as 8."""
    first = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(seed, first)


def check(k):
    return spark_hash(k, (1000003).to_bytes(8, "little")) & 0xFFFFFFFF


def places(k, level):
    h = spark_hash(k, level.to_bytes(4, "little"))
    return [q * 2**level + (h >> 21 * q) % 2**level for q in range(3)]


def read(said):
    """(number of digests, level, cells by place) of a fingerprint."""
    n, level, cells = said.split(":")
    out = {}
    for c in filter(None, cells.split(";")):
        p, count, k, checks = c.split(".")
        out[int(p, 16)] = [int(count), int(k, 16), int(checks, 16)]
    return int(n), int(level), out


def put(cells, k, n, level):
    for p in places(k, level):
        c = cells.setdefault(p, [0, 0, 0])
        c[0] += n
        c[1] ^= k
        c[2] ^= check(k)


def peel(cells, level):
    """What a sketch holds, as digests by sign; None if it gets stuck."""
    found = {}
    while single := [c for c in cells.values() if abs(c[0]) == 1 and c[2] == check(c[1])]:
        n, k = single[0][0], single[0][1]
        found[k] = n
        put(cells, k, -n, level)
    return found if all(c == [0, 0, 0] for c in cells.values()) else None


def compare(one, other):
    """(likeness, digests in one only) of two fingerprints, from nothing else."""
    (n, level_a, a), (m, level_b, b) = read(one), read(other)
    a, b = peel(a, level_a), peel(b, level_b)
    assert len(a) == n and len(b) == m and {*a.values(), *b.values()} <= {1}
    for level in range(max(level_a, level_b), 40):
        cells = {}
        for k in a:
            put(cells, k, 1, level)
        for k in b:
            put(cells, k, -1, level)
        if (apart := peel(cells, level)) is not None:
            return (n + m - len(apart)) / (n + m + len(apart)) if n + m else 1.0, apart
    raise AssertionError


def paragraphs(text):
    head, rest = text[: fp.HEAD], text[fp.HEAD :]
    pieces = re.findall(fp._cuts(fp.LEAST_HEAD, fp.OFTEN), head) + re.findall(fp._cuts(fp.LEAST, fp.SELDOM), rest)
    assert "".join(pieces) == text
    return {xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces}


def expected(rows):
    """Texts in the order of ids, each with its edited text and the next one."""
    texts = sorted(rows, key=lambda r: -r[0])
    for i, (k, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        third = len(text) // 3
        yield k, text, text[: len(text) - third] + after[:third], after


def test_likeness_follows_from_the_strings(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120 and text is not null")
    given = [(r["doc_id"], r["text"]) for r in rows.collect()]
    given += [(-1, ""), (-2, "abc"), (-3, "line\n" * 5000 + "end"), (-4, "\n".join(str(random.Random(i).random()) for i in range(3000))), (-5, "x" * 30000)]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(given, "doc_id bigint, text string")).collect()}
    assert len(got) == len(given)
    for k, text, edited, after in expected(given):
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = paragraphs(text), paragraphs(edited), paragraphs(after)
        assert set(peel(read(r["fingerprint"])[2], read(r["fingerprint"])[1])) == a
        for said, other, near in ((r["edited_fingerprint"], b, r["near_edited"]), (None, c, r["near_next"])):
            want = len(a & other) / len(a | other) if a | other else 1.0
            assert near == pytest.approx(want, abs=1e-12)
            if said is not None:
                like, apart = compare(r["fingerprint"], said)
                assert like == pytest.approx(near, abs=1e-12) and set(apart) == a ^ other
    next_of = {k: after for k, _, _, after in expected(given)}
    said_of = {t: got[k]["fingerprint"] for k, t in given}
    for k, _ in given:
        assert compare(got[k]["fingerprint"], said_of[next_of[k]])[0] == pytest.approx(got[k]["near_next"], abs=1e-12)


def test_edits_stay_local(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    base = " ".join(rnd.choice(words) for _ in range(20000))
    a = paragraphs(base)
    assert len(a) > 300
    for at in (5, 1000, 60000):
        b = paragraphs(base[:at] + " inserted" + base[at:])
        assert len(a & b) / len(a | b) > 0.95


@pytest.mark.parametrize("ids", [list(range(1500)) + [10**15], [7] * 900 + list(range(600)), [2**40 + i * i for i in range(1500)]])
def test_order_whatever_the_ids(spark, ids, monkeypatch):
    """Outlying, repeated and clustered ids: each row is followed by the next one, and no bucket is much larger than the mean."""
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", 100)
    rows = [(k, f"text {i} of {k}") for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = fp.with_next(df.withColumn("a", F.array(F.lit(1))), "a").collect()
    order = {r["text"]: r["next_text"] for r in out}
    id_of = {t: k for k, t in rows}
    assert len(out) == len(rows) and set(order) == set(order.values()) == set(id_of)
    falls = [t for t in order if id_of[order[t]] > id_of[t]]
    assert len(falls) == 1 and id_of[falls[0]] == min(ids)  # only from the last to the first


def test_edges(spark):
    rows = [(1, "some words here"), (1, "some words here"), (None, None), (2, ""), (3, "word " * 20000), (None, "other words there")]
    edge = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("h", "a", "b", "bucket", "ghost", "next_text", "n_chars", "s", "l", "a_cells", "b_level", "next_a")})
    out = fp.fingerprints(edge).collect()
    assert len(out) == len(rows) and len({r["fingerprint"] for r in out if r["n_chars"] == 15}) == 1
    assert fp.fingerprints(edge.limit(0)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([("5", "abc\ndef")], "doc_id string, text string")).first()
    assert one["doc_id"] == 5 and one["near_next"] == 1.0
