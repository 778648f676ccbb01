"""Repeated byte strings, the trie of conversations, and ranked search: whole results against brute force, and the cases at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lexical, queries, repeats, turntrie

SF = "/root/testdata/sf0.001"
CLASHES = ("unit", "core", "item", "key", "spans", "node", "score", "n", "base", "rank")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def brute_repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def passages(seed):
    """Texts that share stretches of all lengths, with other bytes before and after, and some that repeat themselves."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(0, 900))) for _ in range(15)]
    texts = list(base)
    for _ in range(40):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        texts.append(a[:i] + b[j : j + rnd.randint(0, 700)] + rnd.choice(["", "x", "yz"]) + a[i:])
    return [*texts, "a" * 1000, "b" * 199, "c" * 200, "ab" * 300, "", None, base[0], base[0], "d" * 201]


@pytest.mark.parametrize("size", [200, 24, 7, 1])
def test_repeats_are_those_of_brute_force(spark, size):
    texts = passages(size)
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted(tuple(r) for r in repeats.without_repeats(docs, size).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(texts, size))]


def test_repeats_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(docs, brute_repeats([r["text"] for r in docs], 200), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_repeats(spark, SF).collect()}
    assert got == want and sum(n for _, n, *_ in want.values()) > 0


def test_repeats_at_the_edges(spark):
    """Repeated ids are documents of their own, null ids too; a text under the length stays; an empty table stays empty."""
    rows = [(1, "x" * 250), (1, "y" * 150), (None, "z" + "w" * 150 + "v" * 100), (None, None), (2, ""), (3, "z" + "w" * 150 + "v" * 100), (4, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r)[:4] for r in repeats.without_repeats(docs).collect())))
    assert got == sorted(map(repr, [(1, 250, 250, 1), (1, 150, 0, 0), (None, 251, 251, 1), (None, 0, 0, 0), (2, 0, 0, 0), (3, 251, 251, 1), (4, 150000, 150000, 1)]))
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, 0)


def test_windows_lie_in_one_run_each():
    """Runs cover each window of each text once, whatever lies beside it, and equal windows have equal anchors at equal offsets."""
    rnd = np.random.default_rng(3)
    sizes = [0, 5, 199, 200, 201, 5000, 70_000, 0, 1_200_000]
    data = rnd.integers(97, 99, sum(sizes)).astype(np.uint8)
    data[10_000:12_000] = data[30_000:32_000]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text, at, count, offset, anchor = repeats.runs(data, bounds, 200)
    seen = Counter()
    for t, a, n in zip(text.tolist(), at.tolist(), count.tolist(), strict=True):
        seen[t] += n
        assert a + n - 1 + 200 <= sizes[t] and n <= 200
    assert all(seen[t] == max(0, n - 199) for t, n in enumerate(sizes))
    place = (bounds[text] + at + offset).tolist()
    grams = repeats.gram_hashes(data, 32).view(np.int64)
    assert all(grams[p] == h for p, h in zip(place, anchor.tolist(), strict=True))


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            said = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16] + len(re.findall(r"[^\x20\x09-\x0D]+", t)).to_bytes(4, "big")
            turns[c].append((turn is not None, turn or 0, said, (r, t)))
    own = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * words
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(whole[c]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n], ends(n)) for n, m in members.items())


def conversations(seed):
    """Many that begin alike, one that a third share, long ones, ones with a single turn, null turns, roles and texts, repeated turns."""
    rnd = random.Random(seed)
    rows = []
    for c in range(0, 400):
        if rnd.random() < 0.2:
            continue
        if rnd.random() < 0.33:
            said = ["hot one", "hot two", "hot three"]
        else:
            said = [rnd.choice(["a b", "c", "d e f", "", None]) for _ in range(rnd.choice([1, 1, 2, 5, 8, 60]))]
        rows += [(c, rnd.choice([i, i, None]) if rnd.random() < 0.1 else i, rnd.choice(["user", None]) if rnd.random() < 0.1 else "user", t) for i, t in enumerate(said)]
    return rows + rows[:3] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("most", [4096, 30, 8])
def test_trie_is_that_of_brute_force(spark, most):
    """However large the chunks are: nodes that several share are put together in rounds."""
    rows = conversations(most)
    convs = clashing(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = turntrie.shared_turns(convs, most=most).na.fill(-1, ["parent_conv_id"])
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(rows)


def test_trie_at_the_edges(spark):
    """No conversations have no root; an only turn has a root; turnless conversations end at the root."""
    schema = "conv_id long, turn int, role string, text string"
    none = spark.createDataFrame([], schema)
    assert turntrie.shared_turns(none).count() == 0
    assert turntrie.shared_turns(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    lone = next(c for c in range(21, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced by none
    rows = [(lone, 0, "user", "gone"), (1000, 0, None, None)]
    got = turntrie.shared_turns(spark.createDataFrame(rows, schema)).na.fill(-1, ["parent_conv_id"])
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(rows)


def test_nodes_of_all_sizes():
    """A node grows from 4 to 16, 48 and 256 children, in order of their bytes, and paths are split where keys part."""
    rnd = random.Random(1)
    for n, kind in ((4, turntrie.Few), (16, turntrie.Few), (48, turntrie.Indexed), (256, turntrie.Full)):
        root, keys = turntrie.Node(), [bytes([b]) + b"same" for b in rnd.sample(range(256), n)]
        for key in keys:
            turntrie.reach(root, key)
            turntrie.reach(root, key)
        assert type(root.kids) is kind and [k.path for k in root.kids] == sorted(keys)
    root = turntrie.Node()
    ends = {key: turntrie.reach(root, key) for key in (b"abcdef", b"abcxyz", b"abc", b"abcdefgh", b"zz")}
    assert [k.path for k in root.kids] == [b"abc", b"zz"] and [k.path for k in ends[b"abc"].kids] == [b"def", b"xyz"]
    assert all(turntrie.reach(root, key) is node for key, node in ends.items())


def brute_search(docs, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scores = []
        for d, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search_is_that_of_brute_force(spark):
    """Ties, repeated ids and items, null ids, terms that occur often, items of unknown or no terms; with few and many results."""
    rnd = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "épsilon", "Épsilon", "z1", "β", *[f"w{i}" for i in range(60)]]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 9, 40, 400])))) for i in range(300)]
    docs += [(7, "alpha beta"), (8, "alpha beta"), (None, "alpha beta"), (900, None), (901, ""), (902, "... --"), (903, "beta " * 5000 + "rare")]
    items = [(1, "alpha BETA, gamma"), (1, "w1 w2"), (2, "épsilon β"), (3, "unknown"), (4, None), (5, "beta rare rare"), (None, "z1")]
    said = clashing(spark.createDataFrame(docs, "doc_id int, text string"))
    asked = clashing(spark.createDataFrame(items, "item_id int, text string"))
    for top in (3, 50):
        got = [tuple(r) for r in lexical.search(said, asked, top).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_search(docs, items, top)))
    assert lexical.search(said.limit(0), asked).count() == 0 and lexical.search(said, asked.limit(0)).count() == 0


def test_search_in_parts(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(lexical, "QUERY_PART", 7)
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert sorted(tuple(r) for r in lexical.search(docs, items, 10).collect()) == sorted(want)


def test_bounds_are_never_too_low():
    """And not much too high: the signature bounds frequencies, too."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs = [Counter(rnd.choices(words, k=rnd.choice([5, 50, 500])) + rnd.choices(words[:9], k=rnd.choice([0, 40]))) for _ in range(300)]
    lengths = [sum(c.values()) for c in docs]
    said = [Counter({t.encode(): n for t, n in c.items()}) for c in docs]
    found = Counter(t for c in said for t in c)
    asked = lexical.Queries([(i, " ".join(rnd.choices(words, k=20))) for i in range(20)], len(docs), sum(lengths), found)
    hashed, block = lexical.Hashed(), lexical.Block(14)
    for i, (c, n) in enumerate(zip(said, lengths, strict=True)):
        block.add(i, n, lexical.entries(c, hashed))
    over = exact = 0
    for k, bounds in enumerate(asked.bounds(block.rows, np.array(lengths), block.slices())):
        scores = [asked.score(k, c, n) for c, n in zip(said, lengths, strict=True)]
        assert all(b >= s for b, s in zip(bounds.tolist(), scores, strict=True))
        over, exact = over + int(bounds.sum()), exact + sum(scores)
    assert over < 1.3 * exact
