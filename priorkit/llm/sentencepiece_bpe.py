"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments: a run of meta spaces with the characters up to the next
one. No piece crosses such a border, so segments are independent, and each distinct
segment of a task is encoded once. All new segments lie in flat numpy arrays of
symbols; a round finds every segment's best-scored adjacent pair, merges that
pair's occurrences from the left at once, and closes the gaps, until no pair is left.

Merging occurrences at once equals merging them one by one unless a new symbol can
take part in a pair that scores at least as well as the one being merged. That needs
a piece which contains the new one and scores as well or better; for those ("early"
pieces) a round merges only the leftmost occurrence of each segment.

Text without spaces makes long segments. They are cut where two neighbouring
characters stand in no piece. In what is still longer than LONG, a round also merges the
pairs that are best among their neighbours and that no better merge can reach: no
piece that ends in the left symbol and extends the one before it, or begins with the
right symbol and extends the one after it, scores as well. Such a pair is merged
sooner or later whatever else happens. What MOST_ROUNDS rounds leave of a long segment
(runs of early pieces) is merged pair by pair from a heap, so that the time stays
n log n for any text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches, chunks, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Segments kept by a task at most; longer ones than LONG are not kept.
MOST_CACHED, LONG, MOST_ROUNDS = 500_000, 64, 100
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, BYTE = 1, 6


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


class Vocabulary:
    """Pieces, scores and byte ids of a SentencePiece BPE model without normalisation and with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.end = next(i for i, (p, _, _) in enumerate(pieces) if p == "</s>")
        self.byte_id = np.array([next(i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE and p == f"<0x{b:02X}>") for b in range(256)])
        self.bytes_of = [p.replace(SPACE, " ").encode() if kind == NORMAL else b"" for p, _, kind in pieces]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.names = [str(i) for i in range(len(pieces))]
        self.pieces = [p for p, _, _ in pieces]
        # ranks: equal scores have equal ranks; symbols of unknown characters are numbered from the end of the vocabulary
        values = sorted({s for s in self.score.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(values)}
        keys, ranks, made = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[self.score[p]])
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        self.early = np.zeros(len(pieces), bool)
        for p in self.ids:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + (i > 0)):
                    part = self.ids.get(p[i:j])
                    if part is not None and self.score[p[i:j]] <= self.score[p]:
                        self.early[part] = True

    @cached_property
    def together(self) -> np.ndarray:
        """Sorted codes of the pairs of characters that stand next to each other in a piece."""
        return np.array(sorted({ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:])}), np.int64)

    @cached_property
    def reach(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For neighbouring symbols (a, b): the best rank of a pair (longer symbol ending in a, b), and of a pair (a, longer symbol beginning with b)."""
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        for key, rank in zip(self.keys.tolist(), self.ranks.tolist()):
            a, b = key >> 32, key & 0xFFFFFFFF
            for found, text, cuts in ((left, self.pieces[a], lambda t, k: t[k:]), (right, self.pieces[b], lambda t, k: t[:-k])):
                for k in range(1, len(text)):
                    part = self.ids.get(cuts(text, k))
                    if part is not None:
                        at = part << 32 | b if found is left else a << 32 | part
                        if rank < found.get(at, 1 << 60):
                            found[at] = rank
        out = []
        for found in (left, right):
            keys = np.array(sorted(found), np.int64)
            out.append((keys, np.array([found[k] for k in keys.tolist()], np.int64)))
        return tuple(out)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def from_heap(self, symbols: list[int]) -> list[int]:
        """The merged symbols of one segment: always the best pair, of equal ones the leftmost."""
        n, pairs = len(symbols), self.pairs
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            found = pairs.get(symbols[i] << 32 | symbols[j])
            if found is not None:
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:  # one of them has been merged since
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s >= 0]

    def cut(self, segment: str) -> list[str]:
        """Parts of a segment that no piece can join."""
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = codes[:-1] << 32 | codes[1:]
        at = np.searchsorted(self.together, key)
        at[at == len(self.together)] = 0
        edges = [0, *(np.flatnonzero(self.together[at] != key) + 1).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _unreached(self, key: np.ndarray, rank: np.ndarray, hit: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Pairs, other than the best of their segments, that may be merged at once wherever they stand."""
        none = np.iinfo(np.int64).max

        def best(table, keys):
            i = np.searchsorted(table[0], keys)
            i[i == len(table[0])] = 0
            return np.where(table[0][i] == keys, table[1][i], none)

        before, after = np.r_[none, rank[:-1]], np.r_[rank[1:], none]
        some = np.flatnonzero(hit & (rank <= before) & (rank <= after) & (rank != low))
        some = some[~self.early[self.made[at[some]]]]
        if not len(some):
            return some
        left = np.where(some > 0, best(self.reach[0], key[some - 1]), none)
        right = np.where(some + 1 < len(key), best(self.reach[1], key[np.minimum(some + 1, len(key) - 1)]), none)
        fine = np.zeros(len(key), bool)
        fine[some[(left > rank[some]) & (right > rank[some])]] = True
        # overlapping pairs of one rank: all are fine, then every second one from the left, or none
        start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        size = np.diff(np.append(start, len(rank)))
        fine &= np.repeat(np.logical_and.reduceat(fine, start), size)
        return np.flatnonzero(fine & ((np.arange(len(rank)) - np.repeat(start, size)) % 2 == 0))

    def encode_segments(self, segments: list[str], long: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments and their bounds; `long` also merges what no better merge reaches."""
        n = len(segments)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(n), [len(s) for s in segments])
        chars, inverse = np.unique(codes, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1) for c in chars], np.int64)
        base = len(self.pieces)
        symbol = np.where(known >= 0, known, base + np.arange(len(chars)))[inverse]
        none = np.iinfo(np.int64).max
        done_symbol, done_owner, done_place = [], [], []
        place = np.arange(len(symbol))
        rounds = 0
        while len(symbol) > 1:
            rounds += 1
            if long and rounds > MOST_ROUNDS:
                first = np.append(np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner))
                for a, b in zip(first[:-1], first[1:]):
                    merged = self.from_heap(symbol[a:b].tolist())
                    done_symbol.append(np.array(merged, np.int64))
                    done_owner.append(np.full(len(merged), owner[a]))
                    done_place.append(place[a : a + len(merged)])
                symbol, owner, place = symbol[:0], owner[:0], place[:0]
                break
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self.ranks[at], none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.append(rank, none), first)
            busy = np.repeat(low != none, np.diff(np.append(first, len(owner))))
            if not busy.all():  # finished segments leave the arrays
                done_symbol.append(symbol[~busy])
                done_owner.append(owner[~busy])
                done_place.append(place[~busy])
                if not busy.any():
                    symbol, owner, place = symbol[:0], owner[:0], place[:0]
                    break
            best = np.flatnonzero((rank == np.repeat(low, np.diff(np.append(first, len(owner))))[:-1]) & hit)
            best = self._leftmost(best, self.made[at[best]], owner)
            if long:
                spread = np.repeat(low, np.diff(np.append(first, len(owner))))[:-1]
                best = np.concatenate([best, self._unreached(key, rank, hit, at, spread)])
            symbol = symbol.copy()
            symbol[best] = self.made[at[best]]
            keep = busy.copy()
            keep[best + 1] = False
            symbol, owner, place = symbol[keep], owner[keep], place[keep]
        symbol, owner, place = (np.concatenate([*d, x]) for d, x in ((done_symbol, symbol), (done_owner, owner), (done_place, place)))
        order = np.argsort(place, kind="stable")
        symbol, owner = symbol[order], owner[order]
        odd = np.flatnonzero(symbol >= base)
        if len(odd):  # byte fallback
            spelled = [self.byte_id[list(chr(chars[c - base]).encode("utf-8"))] for c in symbol[odd]]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(x) for x in spelled]
            starts = np.cumsum(times) - times
            out = np.repeat(symbol, times)
            for p, x in zip(starts[odd], spelled):
                out[p : p + len(x)] = x
            symbol, owner = out, np.repeat(owner, times)
        return symbol, np.searchsorted(owner, np.arange(n + 1))

    def _leftmost(self, best: np.ndarray, made: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of the occurrences of each segment's best pair those to merge now."""
        own = owner[best]
        again = np.r_[False, own[1:] == own[:-1]]
        if not again.any():
            return best
        # early pieces: the leftmost alone, whichever pieces the segment's tied pairs make
        risky = np.zeros(own.max() + 1, bool)
        risky[own[self.early[made]]] = True
        mixed = np.r_[False, (own[1:] == own[:-1]) & (made[1:] != made[:-1])]
        risky[own[mixed]] = True
        # others: in a run of overlapping occurrences every second one
        joined = np.r_[False, (best[1:] == best[:-1] + 1) & again[1:]]
        start = np.flatnonzero(~joined)
        run = np.repeat(start, np.diff(np.append(start, len(best))))
        odd = (np.arange(len(best)) - run) % 2 == 1
        return best[~(again & risky[own]) & ~(odd & ~risky[own])]

    def encoder(self) -> "Encoder":
        return Encoder(self)

    def decode(self, ids) -> str:
        """The text of ids: pieces with meta spaces as spaces, without the one put before a text; other bytes than UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.asarray(ids, np.int64).tolist()))
        if len(ids) and self.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class Encoder:
    """Encodes texts with the short segments met so far kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # ids of all segments and their bounds, in arrays that double when they are full
        self.flat, self.bounds = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def _add(self, segments: list[str], long: bool) -> None:
        ids, bounds = self.v.encode_segments(segments, long)
        n, m = self.used + len(ids), self.count + len(segments)
        if n > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(n, np.int64)])
        if m >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: self.count + 1], np.zeros(m, np.int64)])
        self.flat[self.used : n] = ids
        self.bounds[self.count + 1 : m + 1] = self.used + bounds[1:]
        self.known.update(zip(segments, range(self.count, m)))
        self.used, self.count = n, m

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        parts = []
        for t in texts:
            t = SPACE + t.replace(" ", SPACE) if t else ""
            p = _SEGMENT.findall(t)
            parts.append([x for s in p for x in (self.v.cut(s) if len(s) > LONG else (s,))] if max(map(len, p), default=0) > LONG else p)
        if len(self.known) > MOST_CACHED:
            self.forget()
        new = list({s for p in parts for s in p if s not in self.known})
        long = [s for s in new if len(s) > LONG]
        short = [s for s in new if len(s) <= LONG] if long else new
        if short:
            self._add(short, False)
        used, count = self.used, self.count
        if long:
            self._add(long, True)
        out = []
        end, bounds = np.array([self.v.end]), self.bounds
        for p in parts:
            at = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            low, sizes = bounds[at], bounds[at + 1] - bounds[at]
            steps = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            out.append(np.concatenate([self.flat[steps], end]))
        for s in long:
            del self.known[s]
        self.used, self.count = used, count
        return out


def map_ids(docs: DataFrame, columns: dict[str, tuple[str, object]], path: str | None = None) -> DataFrame:
    """doc_id and columns made from (vocabulary, ids) of each row: name -> (type, function). Null texts are empty."""
    bound_batches(docs.sparkSession)
    vocabulary = Vocabulary(path or model_path())  # a few MB, read once on the driver

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocabulary.encoder()
        for pdf in batches:
            made = {name: [] for name in columns}
            for _, run in chunks(pdf["text"].tolist()):
                for ids in encode(run):
                    for name, (_, f) in columns.items():
                        made[name].append(f(vocabulary, ids))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **made})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, (k, _) in columns.items())]))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row, with the end id; a null or empty text has the end id alone."""
    return map_ids(docs, {"ids": ("array<int>", lambda v, ids: ids.astype(np.int32)), "n_tokens": ("long", lambda v, ids: len(ids))}, path)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    vocabulary = Vocabulary(path or model_path())

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [vocabulary.decode([] if x is None else x) for x in pdf["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(work, f"doc_id {kind}, text string")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op8_sentencepiece(spark, sf_dir):
    """Ids and decoded text of every row as digests. Null and empty texts have the end id alone.

    Rows with a null id and repeated rows are encoded like others; texts of any length,
    with or without spaces, are read whole; an empty table gives an empty one; other
    columns are not read.
    """
    return map_ids(
        table(spark, sf_dir, "documents"),
        {
            "n_tokens": ("long", lambda v, ids: len(ids)),
            "ids_sha256": ("string", lambda v, ids: sha(" ".join(map(v.names.__getitem__, ids.tolist())).encode())),
            "decoded_sha256": ("string", lambda v, ids: sha(v.decode(ids).encode("utf-8"))),
        },
    )


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES = {}
