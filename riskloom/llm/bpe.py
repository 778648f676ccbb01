"""Byte-level BPE: exact merges found by longest matches and backtracking.

Bytes are mapped to Latin-1 so that an Aho-Corasick trie of the vocabulary can be asked for the longest entry
at a position.  The encoder takes it, and steps back to shorter ones when an entry cannot stand beside the one
before it.  Two tokens may stand side by side exactly if merging their joined bytes gives the two back;
that is told from the parts that either has at its edge while it is merged, and remembered per pair.  A sequence whose neighbours all agree is the encoding, so every
position is left at most once as a dead end and the time is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from riskloom.llm.common import per_batch, text_or_empty

#: The same cuts as this pattern, in classes that the quicker ``re`` knows; for texts within Latin script.
WELL_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_CUTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+").findall
NOT_LATIN = re.compile("[^\0-\u024f]|[\x1c-\x1f²³¹¼½¾]").search

Edge = tuple[tuple[str, int], ...]
#: Above all ranks.
FAR = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class ByteBpe:
    """Encodes and decodes by a table of ranks; ``pattern`` cuts a text into pieces that no merge crosses.

    Tokens are kept as Latin-1 text.  ``keep_pieces`` and ``keep_pairs`` (each twice, of late
    and of before) bound the two memories.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep_pieces: int = 100_000, keep_pairs: int = 120_000):
        self.ranks = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.keep_pieces, self.keep_pairs = keep_pieces, keep_pairs
        self.token_of = {i: token for token, i in self.ranks.items()}
        self.said_of = {i: str(i) for i in self.token_of}
        cut = regex.compile(pattern).findall
        self.find_pieces = (lambda text: cut(text) if NOT_LATIN(text) else LATIN_CUTS(text)) if pattern == WELL_KNOWN else cut
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}
        #: By left id times ``width`` plus right id.
        self.pairs: dict[int, bool] = {}
        self.earlier_pairs: dict[int, bool] = {}
        self.known_edges: dict[str, tuple[Edge, Edge] | None] = {}
        self.width = max(self.token_of, default=0) + 1
        self.widest = max(map(len, self.ranks), default=0)
        trie = ahocorasick.Automaton()
        for token in self.ranks:
            trie.add_word(token, len(token))
        self.reach = trie.longest_prefix

    def merge(self, data: str, steps: list[tuple[int, str, str]] | None = None) -> list[str]:
        """The definition: join the neighbours of lowest rank until none can be joined. For short data.

        ``steps`` takes, for each join, its rank and the first and last part before it.
        """
        parts, ranks, far = list(data), self.ranks, FAR
        costs = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (low := min(costs)) < far:
            best = costs.index(low)
            if steps is not None:
                steps.append((low, parts[0], parts[-1]))
            one = parts[best] = parts[best] + parts[best + 1]
            del parts[best + 1], costs[best]
            if best:
                costs[best - 1] = ranks.get(parts[best - 1] + one, far)
            if best < len(costs):
                costs[best] = ranks.get(one + parts[best + 1], far)
        return parts

    def edges(self, token: str) -> tuple[Edge, Edge] | None:
        """The first and the last parts that a token has while it is merged, each with the highest rank joined before it changes.

        None if merging the token doesn't give itself.
        """
        if token not in self.known_edges:
            steps: list[tuple[int, str, str]] = []
            whole = self.merge(token, steps) == [token]
            sides = []
            for side in (1, 2):
                edge: list[tuple[str, int]] = []
                for step in steps:
                    if edge and edge[-1][0] == step[side]:
                        edge[-1] = step[side], max(edge[-1][1], step[0])
                    else:
                        edge.append((step[side], step[0]))
                sides.append((*edge, (token, FAR)))
            self.known_edges[token] = (sides[0], sides[1]) if whole else None
        return self.known_edges[token]

    def meets(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives the two: no join across the border is ever the lowest.

        Joins on either side go on as they do alone, the lower first.  While the parts at the border stay, a join of
        these two comes about if its rank is below the highest on both sides; of equal ranks the left one is joined.
        """
        at_left, at_right = self.edges(left), self.edges(right)
        if at_left is None or at_right is None:
            return False
        ranks, last, first = self.ranks, iter(at_left[1]), iter(at_right[0])
        (a, high_a), (b, high_b) = next(last), next(first)
        while True:
            low = ranks.get(a + b)
            if low is not None and low < high_a and low <= high_b:
                return False
            if high_a == high_b == FAR:
                return True
            if high_a <= high_b:
                a, high_a = next(last)
            else:
                b, high_b = next(first)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined bytes gives the two."""
        pair = left * self.width + right
        known = self.pairs.get(pair)
        if known is None:
            known = self.earlier_pairs.get(pair)
            if known is None:
                known = self.meets(self.token_of[left], self.token_of[right])
            if len(self.pairs) >= self.keep_pairs:
                self.earlier_pairs, self.pairs = self.pairs, {}
            self.pairs[pair] = known
        return known

    def encode_piece(self, data: str) -> list[int]:
        """The ids of one piece, given as Latin-1 text."""
        ranks, reach, pairs, width, widest = self.ranks, self.reach, self.pairs, self.width, self.widest
        if data in ranks and self.edges(data) is not None:
            return [ranks[data]]
        n, dead, taken, pos = len(data), set(), [], 0
        rest = data[:widest]
        token = rest[: reach(rest)]
        while pos < n:
            while token:  # the longest first, then what it begins with
                one = ranks.get(token)
                if one is not None and pos + len(token) not in dead:
                    if taken:
                        fits = pairs.get(taken[-1] * width + one)
                        if fits is None:
                            fits = self.compatible(taken[-1], one)
                            pairs = self.pairs
                    else:
                        fits = self.edges(token) is not None
                    if fits:
                        break
                token = token[:-1]
            if token:
                taken.append(one)
                pos += len(token)
                rest = data[pos : pos + widest]
                token = rest[: reach(rest)]
            elif taken:
                dead.add(pos)
                token = self.token_of[taken.pop()]
                pos -= len(token)
                token = token[:-1]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return taken

    def _known(self, piece: str) -> tuple[int, ...]:
        known = self.earlier.get(piece)
        if known is None:
            known = tuple(self.encode_piece(piece.encode().decode("latin-1")))
        if len(self.pieces) >= self.keep_pieces:
            self.earlier, self.pieces = self.pieces, {}
        if len(piece) <= 64:
            self.pieces[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        known, new = self.pieces.get, self._known
        return list(chain.from_iterable([known(piece) or new(piece) for piece in self.find_pieces(text)]))

    def said(self, ids: list[int]) -> str:
        """The ids as decimal text joined by commas."""
        return ",".join(map(self.said_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return "".join(map(self.token_of.__getitem__, ids)).encode("latin-1")


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids again; a row for each row of ``docs``.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes), and the ids themselves with ``with_ids``.  A null text counts as empty: 0 tokens.  Repeated rows
    and null ids are kept as they are; other columns are not read; an empty table gives an empty table.
    ``vocabulary`` is a file of ranks on the driver; its bytes (1 MB) go to the executors as one broadcast.
    No shuffle.  A task makes its own encoder (half a second, 40 MB) and drops it with its two bounded memories
    (some 60 MB) when it ends.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())

    def worker():
        bpe = ByteBpe(read_ranks(table.value), pattern)

        def work(columns: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": columns["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for one in columns["text"]:
                ids = bpe.encode(one)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(bpe.said(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")), worker, schema, most=500)
