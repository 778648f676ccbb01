"""The ten operators on small rows: exact results, brute force, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import bpe, common, embeddings, minhash, mixing, pii, quality, secrets, toxicity, urls

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [(1, "some words here", "a"), (1, "some words here", "a"), (None, None, None), (2, "", "a"), (3, "word " * 20000, None), (None, "other words there", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, and columns whose names the operators use inside."""
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "key", "node", "component_id", "spans", "h", "bucket", "u", "label")})


def test_urls(spark):
    rows = [(1, "https://a.Example.org/es/x"), (2, "https://example.org/en/12?q"), (3, "http://notorg/"), (4, "https://x.org#f"), (5, None), (6, "no scheme"), (7, "ftp://casino-win.com/de/1"), (8, "http://x.com/fr"), (9, "http://casino.net/"), (9, "http://casino.net/"), (10, "a://org/b://com/de/")]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.LISTED + urls.PATTERNS).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("notorg", "/", None, "allow"), 4: ("x.org", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("casino-win.com", "/de/1", "com/de/", "block"), 8: ("x.com", "/fr", None, "allow"), 9: ("casino.net", "/", None, "block"), 10: ("org", "/b://com/de/", "org/", "allow"),
    }
    assert urls.filter_urls(pages, urls.LISTED).count() == len(rows) and urls.filter_urls(pages.limit(0), urls.LISTED).count() == 0
    assert urls.filter_urls(pages, []).where("verdict != 'allow'").isEmpty()


def test_urls_joined_with_long_lists(spark, monkeypatch):
    """The way for long lists of rules gives what the way for short ones gives; one url holds most rows."""
    hosts = ["a.org", "b.example.org", "casino.com", "my-slots.net", "x.com", "org", ""]
    paths = ["/", "/es/1", "/en/12", "/fr/a", "/de/", "/ads/x/7", "/tag/t/page/3", "/2020/01/z/print", "/login.php", "/wp-content/a.zip", ""]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(None, None), (500, "nothing")] + [(1000 + i, "http://casino.com/") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    rules = urls.LISTED + urls.PATTERNS
    short = sorted(map(repr, urls.filter_urls(pages, rules).collect()))
    monkeypatch.setattr(urls, "SMALL_RULES", 0)
    monkeypatch.setattr(urls, "ROWS_A_SALT", 100)
    assert sorted(map(repr, urls.filter_urls(pages, rules).collect())) == short and len(short) == len(rows)
    got = {r["url"]: r["method_rule"] for r in urls.filter_urls(pages, rules).join(pages, "page_id").collect()}
    brute = {u: max([(len(r.text), -i, r.text) for i, r in enumerate(urls.PATTERNS) if "://" in (u or "") and re.search(r.regex.replace(r"\z", r"\Z"), u.split("://")[1])] or [(0, 0, None)])[2] for u in got}
    assert got == brute


def brute_pii(text):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_are_the_patterns():
    rnd = random.Random(3)
    for _ in range(20000):
        text = "".join(rnd.choice("a1@.+- ()2%05\né") for _ in range(rnd.randrange(40)))
        assert pii.plain_spans(text) == brute_pii(text)
    assert pii.plain_spans("x 4111 1111 1111 1111, a.b@c.de") == [("card", 2, 21), ("email", 23, 31)]
    for long in ("1" * 100000, "a" * 100000, "+1" + " " * 100000):
        pii.plain_spans(long)


def test_pii(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.learn(docs)
    got = {r["doc_id"]: r for r in pii.counted(pii.find_spans(docs, model)).collect()}
    for r in docs.collect():
        base = brute_pii(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(got[r["doc_id"]]["spans"].split(","))
    held = [r["text"] for r in docs.collect() if brute_pii(r["text"])]
    found = sum(len(set(brute_pii(t)) & set(model.decode(t))) for t in held)
    assert found >= 0.9 * sum(len(brute_pii(t)) for t in held)
    assert pii.find_spans(edge, model).count() == len(EDGE) and pii.find_spans(edge.limit(0), model).count() == 0
    assert pii.learn(edge.limit(0)).decode("call +1 (017) 555-7713") == []


def test_token_pairs_told_by_edges():
    """Whether two tokens may stand side by side, against merging their bytes: real ranks, and ranks in no order."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        real = bpe.ByteBpe(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    rnd = random.Random(8)
    tokens = list(real.ranks)
    short = [t for t in tokens if len(t) < 4]
    for _ in range(20_000):
        left, right = rnd.choice(rnd.choice([tokens, short])), rnd.choice(rnd.choice([tokens, short]))
        assert real.meets(left, right) == (real.merge(left + right) == [left, right])
    told = 0
    for _ in range(300):
        words = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 6))) for _ in range(12)} | {"a", "b"}
        made = bpe.ByteBpe({w.encode(): i for i, w in enumerate(rnd.sample(sorted(words), len(words)))}, public_tokenizers.PATTERN)
        for left in words:
            for right in words:
                told += made.meets(left, right)
                assert made.meets(left, right) == (made.merge(left + right) == [left, right]), (made.ranks, left, right)
    assert told > 1000


def test_bpe_is_tiktoken(spark, edge):
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(rnd.choice("ab é中😀\n\t'st1²_-\x1c\u00a0") for _ in range(rnd.randrange(60))) for _ in range(2000)] + ["a" * 5000, " " * 3000 + "x", "ab" * 4000, "<|endoftext|>", ""]
    for text in texts:
        ids = theirs.encode_ordinary(text)
        assert ours.encode(text) == ids and ours.decode(ids) == text.encode()
    got = bpe.encode_documents(edge, VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(EDGE) and sorted(r["n_tokens"] for r in got)[:2] == [0, 0]
    assert all(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in got)


def test_mixing(spark, edge):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"), F.lit("w " * 50).alias("text"))
    mix = mixing.plan(docs, repeats=2.0)
    repeats = {r["source"]: r["repeats"] for r in mix.sources.collect()}
    assert repeats["big"] == pytest.approx(1.0) and repeats["s8"] == pytest.approx(2.0, abs=1e-3)
    used = mixing.blocks(docs, mix, block_tokens=20000).collect()
    assert len({r["doc_id"] for r in used}) == 3000
    first = [r for r in used if r["block"] == 1]
    weights = {r["source"]: r["weight"] for r in mix.sources.collect()}
    for s, w in weights.items():
        assert sum(r["tokens"] for r in first if r["source"] == s) / 20000 == pytest.approx(w, abs=0.02)
    assert sorted(r["slot"] for r in first) == list(range(1, len(first) + 1))
    copies = {}
    for r in mixing.mix_documents(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    counts = {}
    for r in used:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert copies == counts
    natural, even = mixing.plan(docs, entropy=0.0), mixing.plan(docs, entropy=1.0)
    assert natural.exponent == 1.0 and even.exponent < 1e-3
    assert mixing.mix_documents(edge).columns == edge.columns and mixing.mix_documents(edge).count() >= len(EDGE)
    assert mixing.mixed(edge.limit(0)).count() == 0 and mixing.mix_documents(edge.limit(0)).count() == 0


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, edge):
    rnd = random.Random(4)
    parts = ["token", "Secret", "api_key", " = ", ":", '"', "'", "abc", "12345678", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "é", "😀", "\n", " ", "ſecret"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(1500)] + ["token " + " " * 50000, "AKIA" * 5000, "a1" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    for i, text in enumerate(texts):
        base = brute_secrets(text)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), text[:200]
        assert set(base.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert secrets.scan(edge).count() == len(EDGE) and secrets.scan(edge.limit(0)).count() == 0
    masked = secrets.redact(spark.createDataFrame([(1, "é token=abcdefgh12 z"), (2, "clean"), (3, None)], "doc_id int, text string")).collect()
    assert [r["text"] for r in masked] == ["é [SECRET] z", "clean", None]


def test_random_strings_are_found(spark):
    rnd = random.Random(6)
    key = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = [(i, f"the ordinary words of a text and some_identifier_name token = {key(40)}") for i in range(200)]
    rows += [(1000, f"nothing but {key(40)} here"), (1001, "an ordinary_identifier_with_number_12 here")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1000] == "random:12:52" and got[1001] == ""


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        ws = (text or "").encode().lower().split()
        k = min(words, len(ws))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and both * 100 >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {r[0]: (len(s), c) for r, s, c in zip(rows, sets, label, strict=True)}


@pytest.mark.parametrize("small", [100_000, 0])
def test_minhash(spark, edge, monkeypatch, small):
    """With small tables gathered, and (small = 0) as at scale; common shingles' lists in parts."""
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    monkeypatch.setattr(minhash, "LIST_PART", 7 if small == 0 else 2000)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(0, ""), (1, None), (2, "A b"), (3, "a\tB"), (4, "a b c")]
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(60):  # near copies at all distances
        copy = list(base)
        for _ in range(rnd.randrange(12)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(30)] + [(200 + i, " ".join(base)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, similarity in ((3, 0.85), (5, 0.8)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k, similarity).collect()}
        want = brute_components(rows, k, round(similarity * 100))
        assert got == want
        if small == 0:
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k, similarity, exact=True).collect()} == want
    out = minhash.near_duplicates(edge).collect()
    assert len(out) == len(EDGE) and [r["kept"] for r in out if r["doc_id"] is None] == [False, False]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.one_of_each(edge).select("doc_id", "text").collect()) == sorted({(k or 0, t or "") for k, t, _ in EDGE})
    assert minhash.one_of_each(edge).columns == edge.columns
    copies = spark.createDataFrame([(None, "one two three four five six"), (7, "one two three four five six"), (None, "x y z"), (None, "x y z"), (8, "a b c d e"), (8, "a b c d e")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] or 0 for r in minhash.one_of_each(copies).collect()) == [0, 7, 8]
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize("small", [100_000, 0])
def test_embeddings(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        v = [rnd.gauss(0, 1) for _ in range(16)]
        for _ in range(1 + i % 4):
            rows.append((len(rows), i % 3, [x + rnd.gauss(0, 0.05) for x in v]))
    rows += [(900, 0, rows[0][2]), (901, None, rows[0][2]), (902, 0, None), (903, 0, [0.0] * 16), (904, 0, [float("nan")] * 16), (905, 0, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    good = [r for r in rows if r[0] < 901]
    links = {r[0]: {s[0] for s in good if s[0] != r[0] and s[1] == r[1] and cos(r[2], s[2]) >= 0.93} for r in good}
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    for r in rows:
        mine = links.get(r[0], set())
        reach, todo = {r[0]}, list(mine)
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += links[x]
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (len(mine), min(reach), min(reach) == r[0])
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_classifiers_edges(spark, edge, operator):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = operator(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] for r in out if r["doc_id"] is None)
    assert operator(edge.limit(0), labels).count() == 0 and operator(edge, labels.limit(0)).count() == len(EDGE)


def held_out(spark, operator, label):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = operator(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return rows


def test_quality_held_out(spark):
    rows = held_out(spark, quality.quality, "quality")
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.97 * len(rows)
    assert sum(r["predicted"] for r in rows if r["quality"]) > 0.99 * sum(r["quality"] for r in rows)


def test_toxicity_held_out(spark):
    rows = held_out(spark, toxicity.toxicity, "toxic")
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) < 0.03 * len(clean)
    assert sum(r["predicted"] for r in rows if r["toxic"]) > 0.7 * sum(r["toxic"] for r in rows)


def test_misspelling_shares_the_score():
    clean = ["the quiet house stands near the river and the road", "we walked along the road to see the house", "a river runs by the quiet town"] * 20
    model = toxicity.fit(clean + [t + " idiot" for t in clean], [0] * 60 + [1] * 60)
    assert model.score(clean[0] + " idiot") > 0.5 > model.score(clean[0])
    word = model.scorer().word
    assert word("idiott") > 0.5 * word("idiot") > 3 * word("friend")


def test_all_of_a_long_run_is_read():
    clean = ["the quiet house stands near the river and the road", "we walked along the road to see the house", "a river runs by the quiet town"] * 20
    model = toxicity.fit(clean + [t + " idiot" for t in clean], [0] * 60 + [1] * 60)
    margin = model.scorer().margin
    for n in (0, 10, 100, 999, 10000):  # the word at the end of a run without blanks
        assert margin("a" * n + "idiot") > margin("a" * n + "house") + 0.3
    at = [margin("the " * n + "idiot" + " the" * (20 - n)) for n in range(21)]
    assert max(at) - min(at) < 1e-9  # wherever it stands
