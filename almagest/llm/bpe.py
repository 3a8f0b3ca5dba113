"""Encoding of texts with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that
are tokens as a whole; the others are merged with a heap over linked bytes.
Each Python worker keeps what it has resolved in a bounded memo, so a frequent
piece of text is looked up once per worker. The hash's tables are built on the
driver from the vocabulary file, about 2 MB whatever the corpus, and broadcast.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.session import spread_of

#: Pieces and characters of them in a worker's memo, after which it starts anew.
MEMO, MEMO_CHARS = 400_000, 8_000_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def key_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: on each level, keys that
    alone fall on a bit of its bit field stay there and the rest go on to the
    next; a key's slot is the rank of its bit among all bits set."""

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        self.fields, self.ranks = [], []
        left, base, level = keys.astype(np.uint64), 0, 0
        while len(left):
            m = max(64, int(len(left) * load) | 1)
            pos = self._pos(left, level, m)
            n = np.bincount(pos, minlength=m)
            field = n == 1
            self.fields.append(field)
            self.ranks.append(base + np.cumsum(field) - 1)
            base += int(field.sum())
            left, level = left[n[pos] > 1], level + 1
            if level > 60:
                raise ValueError("equal keys have no perfect hash")
        self.size = base

    @staticmethod
    def _pos(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        x = keys ^ np.uint64((_MIX[level % 8] * (2 * level + 1)) & (2**64 - 1))
        for shift, mul in ((33, _MIX[4]), (29, _MIX[5])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for a key that was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (field, rank) in enumerate(zip(self.fields, self.ranks)):
            if not len(todo):
                break
            pos = self._pos(keys[todo].astype(np.uint64), level, len(field))
            hit = field[pos]
            out[todo[hit]] = rank[pos[hit]]
            todo = todo[~hit]
        return out


class Vocabulary:
    """What a worker needs: ranks by bytes for merging, and the perfect hash
    with the token and id of each slot."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        keys = np.fromiter((key_hash(t) for t in tokens), dtype=np.uint64, count=len(tokens))
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        self.ids = np.zeros(self.hash.size, dtype=np.int32)
        self.ids[slots] = np.fromiter(ranks.values(), dtype=np.int32, count=len(tokens))
        self.tokens: list[bytes] = [b""] * self.hash.size
        for s, t in zip(slots, tokens):
            self.tokens[s] = t


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by byte-pair merging: the pair of lowest rank,
    the leftmost among equals, is joined first. The bytes are a linked list,
    the pairs a heap whose entries go stale when a neighbour changes."""
    n = len(token)
    parts = [token[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = nxt[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = b""
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
        if (p := prv[i]) >= 0 and (r := ranks.get(parts[p] + parts[i])) is not None:
            heapq.heappush(heap, (r, p, len(parts[p]) + len(parts[i])))
    return [ranks[p] for p in parts if p]


#: A run of other characters with the blank before it, or blanks. No pre-token
#: of the patterns used here reaches over the ends of such a piece, so a piece
#: can be looked up as a whole; splitting at blanks alone is much cheaper than
#: the pre-token pattern, which then only sees each distinct piece.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class _Codes(dict):
    """Piece to code; a new one is given the next code and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = code = len(self)
        self.new.append(token)
        return code


class Encoder:
    """Encodes batches of texts with a Vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pretokens = regex.compile(vocabulary.pattern).findall
        self.find = PIECES.findall
        self._reset()

    def _reset(self) -> None:
        self.codes, self.memo = _Codes(), {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.known, self.used, self.chars = 0, 0, 0

    def resolve(self, pieces: list[str]) -> list[list[int]]:
        """The ids of distinct pieces: each pre-token of theirs by the perfect
        hash, or by merging."""
        split = [self.pretokens(p) for p in pieces]
        memo = self.memo
        tokens = list({t for x in split for t in x if t not in memo})
        raw = [t.encode() for t in tokens]
        slots = self.v.hash.slots(np.fromiter(map(key_hash, raw), dtype=np.uint64, count=len(raw)))
        memo.update({t: [int(self.v.ids[s])] if s >= 0 and self.v.tokens[s] == b else merge(b, self.v.ranks) for t, b, s in zip(tokens, raw, slots)})
        return [memo[x[0]] if len(x) == 1 else [i for t in x for i in memo[t]] for x in split]

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        ids = self.resolve(new)
        self.chars += sum(map(len, new))
        total, n = sum(map(len, ids)), len(self.codes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.length[self.known : n] = lens
        self.start[self.known : n] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=total)
        self.used, self.known = self.used + total, n

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of all pieces, their number of ids, end of each text in codes)."""
        if len(self.codes) > MEMO or self.chars > MEMO_CHARS:
            self._reset()
        codes, get = [], self.codes.__getitem__
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                codes.extend(map(get, self.find(t)))
            ends[k + 1] = len(codes)
        self._learn()
        c = np.array(codes, dtype=np.int64)
        return c, self.length[c], ends

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of the texts in it."""
        c, lens, ends = self.batch(texts)
        at = np.concatenate([[0], np.cumsum(lens)])
        idx = np.repeat(self.start[c] - at[:-1], lens) + np.arange(at[-1])
        return self.flat[idx], at[ends]

    def count(self, texts: list[str | None]) -> np.ndarray:
        _, lens, ends = self.batch(texts)
        return np.diff(np.concatenate([[0], np.cumsum(lens)])[ends])


_local: dict = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder: made once, kept over tasks of the same vocabulary."""
    v = shared.value
    if _local.get("v") is not v:
        _local.update(v=v, e=Encoder(v))
    return _local["e"]


def share_vocabulary(spark, path: str | None = None, pattern: str | None = None):
    """The vocabulary as a broadcast: its size is that of the vocabulary file."""
    p, pat = (path, pattern) if path else default_vocabulary()
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(p), pattern or pat))


def over_all_cores(df: DataFrame) -> DataFrame:
    """`df` as it was read, or dealt out over as many partitions as the session
    asks for: a parameter for inputs of few files (session.SPREAD), which moves
    every text once, so it is unset on a cluster."""
    n = spread_of(df.sparkSession)
    return df.repartition(n) if n else df


def _rows(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def encode(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), out: str = "ids", vocabulary=None) -> DataFrame:
    """`keep` and the list of token ids of each row's text. Empty and null
    texts come out as an empty list; special tokens are ordinary text. Repeated
    rows come out as often as they occur; other columns are left out."""
    shared = vocabulary or share_vocabulary(docs.sparkSession)
    cols = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        e = _encoder(shared)
        for whole in batches:
            for b in _rows(whole):
                ids, offsets = e.encode(b.column(b.schema.get_field_index("__text")).to_pylist())
                arr = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), arr], names=[*keep, out])

    schema = T.StructType([*cols.drop("__text").schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return over_all_cores(cols).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), out: str = "n_tokens", vocabulary=None) -> DataFrame:
    """`keep` and the number of tokens of each row's text; 0 for null texts."""
    shared = vocabulary or share_vocabulary(docs.sparkSession)
    cols = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        e = _encoder(shared)
        for whole in batches:
            for b in _rows(whole):
                n = e.count(b.column(b.schema.get_field_index("__text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n.astype(np.int64))], names=[*keep, out])

    schema = T.StructType([*cols.drop("__text").schema.fields, T.StructField(out, T.LongType())])
    return over_all_cores(cols).mapInArrow(run, schema)


def decoded_lengths(docs: DataFrame, text: str = "text", vocabulary=None) -> DataFrame:
    """(doc_id, n_bytes): how many bytes the ids of each text stand for; for a
    lossless encoding those of the text, 0 for null."""
    shared = vocabulary or share_vocabulary(docs.sparkSession)

    def run(batches):
        v = shared.value
        size = np.zeros(max(v.ranks.values()) + 1, dtype=np.int64)
        for token, i in v.ranks.items():
            size[i] = len(token)
        for b in batches:
            ids = b.column(1)
            ends = np.concatenate([[0], np.cumsum(size[ids.flatten().to_numpy(zero_copy_only=False)])])
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends[at]))], names=["doc_id", "n_bytes"])

    return encode(docs, text, vocabulary=shared).select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_bytes bigint")
