"""Personal data: plain patterns, and a semi-Markov conditional random field that adds to them.

The field scores whole spans of tokens (shape, digits, checksums, the word before) and a dynamic programme
over bounded spans chooses boundaries and kinds together.  A span must hold a digit, an at-sign or ``at`` in brackets, so
every text falls apart into short zones around those; outside them nothing can be chosen, and the programme over
the zones equals the one over the whole text.  It is trained by likelihood on a bounded sample of texts, each once
as it is, with the plain patterns' spans, and once with these spans written in other ways that the patterns don't know:
numbers in the national form, other separators, at-signs and dots in words.  So it finds more than the patterns do.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import hashed_sample, per_batch, text_or_empty

KINDS = ("email", "ip", "card", "phone")
BUCKETS = 1 << 12
LONGEST = 26
#: How often a text's spans are rewritten for training.
WAYS = 12

# The at-sign and what follows; what stands before is looked up leftwards, which keeps long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").finditer
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGITS = re.compile("[0-9]").findall
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]").search

Span = tuple[str, int, int]


def luhn(digits: list[str] | str) -> bool:
    """Whether the digits pass the checksum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and non-overlapping per kind, in code points, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        ended = 0
        for m in _DOMAIN(text):
            start = m.start()
            while start > ended and _LOCAL(text, start - 1):
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                ended = m.end()
    if _TRIGGER(text):
        out += [("ip", *m.span()) for m in _IP(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE(text) if 9 <= len(_DIGITS(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_TOKENS = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|.|\n").finditer
_ZONES = re.compile(r"(?:[0-9@]|[(\[]at[)\]])(?:[^0-9@\n]{0,24}[0-9@])*").finditer
REACH = 48
#: What stands for a sign where it is in brackets.
_SIGNS = {"at": "@", "dot": "."}


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, each with ``REACH`` characters on both sides, within a line."""
    out: list[tuple[int, int]] = []
    for m in _ZONES(text):
        line = text.rfind("\n", max(0, m.start() - REACH), m.start()) + 1
        start = max(line, m.start() - REACH, 0)
        stop = text.find("\n", m.end(), m.end() + REACH)
        end = stop if stop >= 0 else min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def candidates(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int, list[int]]]]:
    """Number of tokens of a zone, and its spans that may be chosen: (first token, token after, start, end, features)."""
    tokens = [(m.start(), m.end()) for m in _TOKENS(text, start, end)]
    kinds, n = [], len(tokens)
    for a, b in tokens:
        c, word = text[a], text[a:b]
        said = word in _SIGNS and text[a - 1 : a] in ("(", "[") and text[b : b + 1] in (")", "]")
        kinds.append(_SIGNS[word] if said else "9" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else "-" if c == "_" else c)
    out = []
    word = ""
    for i in range(n):
        first = kinds[i]
        if first in "9a+(" and (i == 0 or kinds[i - 1] not in "a9" or first not in "a9"):
            shape, digits, ats, longest = "", "", 0, 0
            for j in range(i, min(n, i + LONGEST)):
                k = kinds[j]
                if k == "\n":
                    break
                shape += k
                ats += k == "@"
                if k == "9":
                    digits += text[tokens[j][0] : tokens[j][1]]
                    longest = max(longest, tokens[j][1] - tokens[j][0])
                if k in "9a" and (digits or ats) and (j + 1 == n or kinds[j + 1] not in "a9") and ats <= 1 and len(digits) <= 24 and shape.count("a_a") == 0:
                    size = len(digits)
                    before = kinds[i - 1] if i else "^"
                    after = kinds[j + 1] if j + 1 < n else "$"
                    loose = re.sub(r"(.)\1+", r"\1", shape.replace("_", "").replace("-", "").replace(".9", "9")) if not ats else re.sub(r"[a9]+(?:[.+%_-][a9]+)*", "x", shape)
                    said = [
                        f"s{shape}", f"l{loose[:12]}", f"d{size}", f"@{ats}{ats and '.' in shape[shape.index('@'):]}{'_' in shape}", f"b{before}{first}", f"a{after}",
                        f"w{word}", f"c{12 <= size <= 19 and luhn(digits)}{12 <= size <= 19}", f"n{j - i}",
                        f"q{shape == '9.9.9.9' and longest <= 3}", f"g{longest}", "1",
                    ]
                    out.append((i, j + 1, tokens[i][0], tokens[j][1], [zlib.crc32(x.encode()) % BUCKETS for x in said]))
        if first == "a":
            word = text[tokens[i][0] : tokens[i][1]].lower()[:12]
    return n, out


@dataclass
class SpanField:
    """Weights of the field: a column for each kind; a token outside spans scores 0."""

    weights: np.ndarray

    def decode(self, text: str) -> list[Span]:
        """The likeliest spans of a whole text."""
        out: list[Span] = []
        for start, end in zones(text):
            n, spans = candidates(text, start, end)
            if not spans:
                continue
            scores = self.weights[np.array([s[4] for s in spans])].sum(1)
            best_kind, best_score = scores.argmax(1), scores.max(1)
            ending: dict[int, list[int]] = {}
            for c in np.flatnonzero(best_score > 0).tolist():
                ending.setdefault(spans[c][1], []).append(c)
            if not ending:
                continue
            best, chose = [0.0] * (n + 1), [-1] * (n + 1)
            for t in range(1, n + 1):
                best[t] = best[t - 1]
                for c in ending.get(t, ()):
                    if (score := best[spans[c][0]] + float(best_score[c])) > best[t]:
                        best[t], chose[t] = score, c
            t, found = n, []
            while t > 0:
                if (c := chose[t]) >= 0:
                    found.append((KINDS[best_kind[c]], spans[c][2], spans[c][3]))
                    t = spans[c][0]
                else:
                    t -= 1
            out += reversed(found)
        return out


def _address(rnd: random.Random) -> str:
    """An address of other parts than the sample's."""
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprstu", k=rnd.randrange(2, 9)))
    name = rnd.choice(["", ".", ".", "_", "-"]).join(word() for _ in range(rnd.randrange(1, 4))) + str(rnd.randrange(100)) * (rnd.random() < 0.2)
    return name + "@" + ".".join(word() for _ in range(rnd.randrange(2, 4)))


def _rewritten(kind: str, said: str, rnd: random.Random) -> str:
    """A span's text in a form that the plain patterns don't find, or not whole."""
    digits = "".join(_DIGITS(said))
    if kind == "email":
        name, _, host = (said if rnd.random() < 0.5 else _address(rnd)).partition("@")
        left, right = rnd.choice(["[]", "()"])
        gap, name = rnd.choice(["", " "]), name.replace(".", rnd.choice([".", "", "-"]))
        return f"{name}{gap}{left}at{right}{gap}" + host.replace(".", f"{gap}{left}dot{right}{gap}" if rnd.random() < 0.7 else ".")
    if kind == "ip":
        return rnd.choice(["[.]", " . ", "(.)", "[dot]"]).join(said.split("."))
    if kind == "card":
        mark = rnd.choice([".", " - ", "/", "_", "  "])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest = digits[-10:-7], digits[-7:]
    if not area:
        return "0" + digits
    if rnd.random() < 0.4:  # area and number as within the country, of other lengths
        size, more = rnd.randrange(2, 5), rnd.randrange(6, 9)
        return f"0{digits[-size:]}" + rnd.choice([" ", "-", "/", " / ", " - "]) + (rest + area)[:more]
    form = rnd.choice(["({0}) {1}-{2}", "({0}){1}-{2}", "{0}-{1}-{2}", "{0} {1} {2}", "{0}.{1}.{2}", "0{0}/{1}{2}", "00{3} {0} {1} {2}", "({0}) {1} {2}"])
    return form.format(area, rest[:3], rest[3:], digits[:-10] or "1")


def _ordinary(rnd: random.Random) -> str:
    """A line with numbers that are nobody's: dates, times, shares, versions, amounts."""
    n = lambda most: rnd.randrange(1, most)
    said = [
        f"on {1900 + n(130)}-{n(13):02}-{n(32):02} at {n(24):02}:{n(60):02}", f"of {n(100)}.{n(1000)} to {n(10)}", f"version {n(10)}.{n(30)}.{n(10)} here", f"the {n(32)}.{n(13)}.{1900 + n(130)} or {n(13)}/{n(32)}/{1900 + n(130)}",
        f"page {n(900)} in {1900 + n(130)}", f"for {n(900)},{n(1000):03}.{n(100):02} in all", f"at {n(100)}%, a@b or {n(10)} @ {n(10)}", f"no. {n(100000)} and {n(10**8)}", f"chapter {n(30)}:{n(30)}-{n(30)}",
        f"room 0{n(1000)} or 0{n(1000)}/{n(100)}", f"on {1900 + n(130)}-{n(13):02}-{n(32):02}", f"pages {n(900)}-{n(900)} / {n(900)}", f"see (at) {n(100)} and [at] once",
        f"order {n(10**6)} {n(10**6)} and {n(10**5)}-{n(10**4)}", f"isbn 978-{n(10)}-{n(100)}-{n(10**6):06}-{n(10)}", f"sizes {n(100)}-{n(100)} of {n(100)} {n(1000):03} {n(1000):03}",
    ]
    return " ".join(rnd.sample(said, 5))


def rewritten(text: str, gold: list[Span], seed: int = 0) -> tuple[str, list[Span]]:
    """The text with each span (of those that overlap the first) in another form, a line of ordinary numbers, and where the spans stand then."""
    rnd = random.Random(zlib.crc32(text[:1000].encode()) + seed)
    parts, spans, at, size = [], [], 0, 0
    for kind, start, end in gold:
        if start >= at:
            new, before = _rewritten(kind, text[start:end], rnd), text[at:start]
            if before.endswith(" ") and rnd.random() < 0.2:  # at the beginning of a line
                before = before[:-1] + "\n"
            size += start - at
            parts += [before, new]
            spans.append((kind, size, size + len(new)))
            size, at = size + len(new), end
    return "".join([*parts, text[at:], "\n", _ordinary(rnd)]), spans


def fit(texts: list[str], most_zones: int = 1500, epochs: int = 4, rate: float = 0.3, ridge: float = 1e-3) -> SpanField:
    """Maximises the likelihood of the plain spans, and of rewritten ones, in at most ``most_zones`` zones of each sort by AdaGrad."""
    weights, seen = np.zeros((BUCKETS, len(KINDS))), np.full((BUCKETS, len(KINDS)), 1e-2)
    drawn = []
    as_they_are = [(text, plain_spans(text)) for text in texts]
    for times in (0, WAYS):
        least = len(drawn)
        for text, known in (rewritten(text, spans, i) for i in range(times) for text, spans in as_they_are if spans) if times else as_they_are:
            if len(drawn) >= least + most_zones:
                break
            gold = {(s, e): KINDS.index(k) for k, s, e in known}
            for start, end in zones(text):
                n, spans = candidates(text, start, end)
                if spans:
                    drawn.append((n, spans, np.array([s[4] for s in spans]), [gold.get((s[2], s[3]), -1) for s in spans]))
    for _ in range(epochs):
        for n, spans, at, truth in drawn:
            scores = weights[at].sum(1)
            top = scores.max(1)
            each = top + np.log(np.exp(scores - top[:, None]).sum(1))
            ahead, back = np.zeros(n + 1), np.zeros(n + 1)
            ends: list[list[int]] = [[] for _ in range(n + 1)]
            begins: list[list[int]] = [[] for _ in range(n + 1)]
            for c, s in enumerate(spans):
                ends[s[1]].append(c)
                begins[s[0]].append(c)
            for t in range(1, n + 1):
                v = ahead[t - 1]
                for c in ends[t]:
                    v = np.logaddexp(v, ahead[spans[c][0]] + each[c])
                ahead[t] = v
            for t in range(n - 1, -1, -1):
                v = back[t + 1]
                for c in begins[t]:
                    v = np.logaddexp(v, back[spans[c][1]] + each[c])
                back[t] = v
            first, last = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
            share = np.exp(np.minimum(ahead[first] + back[last] - ahead[n], 0.0)[:, None] + scores)
            for c, kind in enumerate(truth):
                if kind >= 0:
                    share[c, kind] -= 1
            flat, grad = at.ravel(), np.repeat(share, at.shape[1], 0)
            places, where = np.unique(flat, return_inverse=True)
            total = np.zeros((len(places), len(KINDS)))
            np.add.at(total, where, grad)
            total += ridge * weights[places]
            seen[places] += total**2
            weights[places] -= rate * total / np.sqrt(seen[places])
    return SpanField(weights)


def joined(spans: list[Span]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def all_spans(text: str, model: SpanField) -> tuple[list[Span], list[Span]]:
    """The plain spans, and these with the model's that touch none of them; null or empty text: none."""
    base = plain_spans(text)
    if not _TRIGGER(text):
        return base, base
    ends: list[int] = []  # of the stretches that base spans cover, which don't overlap
    starts: list[int] = []
    for _, s, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more = [x for x in model.decode(text) if (k := bisect_left(starts, x[2])) == 0 or ends[k - 1] <= x[1]]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def learn(docs: DataFrame, most: int = 1500, doc_id: str = "doc_id", text: str = "text", most_chars: int = 30_000_000) -> SpanField:
    """Fits on the whole texts of at most ``most`` documents that hold a digit or an at-sign, drawn by hashed id, of ``most_chars`` code points together."""
    texts = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text")).where("_id is not null")
    ids = hashed_sample(texts.where(F.col("_text").rlike("[0-9@]")).select("_id").distinct(), "_id", most)
    # At most ``most`` rows: of rows that share a drawn id, the text of least hash stands for the id.
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    so_far = F.sum(F.length("_text")).over(Window.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id"))
    rows = rows.withColumn("_so_far", so_far).where(F.col("_so_far") <= most_chars).collect()
    return fit([r._text for r in sorted(rows, key=lambda r: (r._id, r._text))])


def find_spans(docs: DataFrame, model: SpanField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Finds the spans of every whole text: doc_id, base and spans as arrays of (kind, start, end), and base_sha256.

    A row for each row of ``docs``; null texts count as empty and have no spans; null ids and repeated rows
    are kept; other columns are not read.  No shuffle; the weights (128 KB) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        def work(columns: dict[str, list]) -> dict[str, list]:
            found = [all_spans(t, shared.value) for t in columns["text"]]
            out: dict[str, list] = {"doc_id": columns["doc_id"], "base": [], "spans": [], "base_sha256": []}
            for base, spans in found:
                out["base"].append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                out["spans"].append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            return out

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")), worker, f"doc_id {kind}, base {spans}, spans {spans}, base_sha256 string")


def counted(found: DataFrame) -> DataFrame:
    """Spans as counts and text, one row a document; ``n_spans`` counts all of them, ``has_private`` says whether there is any."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    all_ = F.size("spans").cast("long")
    return found.select("doc_id", *[count(k) for k in KINDS], "base_sha256", said.alias("spans"), all_.alias("n_spans"), (all_ > 0).cast("int").alias("has_private"))
