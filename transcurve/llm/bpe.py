"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a
vocabulary entry is resolved by one pilot look-up and one comparison. Tier two merges
the bytes of the others with a heap of candidate pairs over a doubly linked list.

Null and empty texts have no ids. Texts of any length are encoded whole. Repeated rows
give equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: The public pattern in an equal form that tries its commonest branch first: branches that
#: change places start with different characters, and a run that can't shrink never has to.
FAST = {public_tokenizers.PATTERN: r"""(?: ?\p{L}++)|(?: ?\p{N}++)|'s|'t|'re|'ve|'m|'ll|'d|(?: ?[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s+"""}
#: Keys of a bucket of the perfect hash, on average.
BUCKET_KEYS = 4
#: Text bytes whose distinct pre-tokens are resolved together.
CHUNK_BYTES = 2 << 20
#: Bytes of merged words and their ids in a generation of a task's memo, of which there are two; results don't depend on it.
MEMO_BYTES, ENTRY_BYTES = 40 << 20, 200


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary by rank; the file holds one base64 token and its rank a line."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash of distinct byte strings, by displacement.

    Keys fall into buckets by one half of a 64-bit hash; buckets are placed from the
    largest down, each with the first pilot that sends all its keys to free slots. The
    slot of a key is ``(h ^ mix(pilot)) mod n``, so n keys fill exactly n slots.
    """

    def __init__(self, keys: list[bytes]):
        self.keys, self.n = keys, max(1, len(keys))
        self.buckets = max(1, -(-len(keys) // BUCKET_KEYS))
        h = self._hash(keys)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        self.pilots = np.zeros(self.buckets, np.uint32)
        self.slot_key = np.full(self.n, -1, np.int32)
        mixes = self._mix(np.arange(1 << 16, dtype=np.uint64))
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            rows = order[starts[b] : starts[b + 1]]
            first = 0
            while True:
                if first + 256 > len(mixes):
                    mixes = self._mix(np.arange(2 * len(mixes), dtype=np.uint64))
                slots = self._slot(h[rows][None, :], mixes[first : first + 256, None])
                free = (self.slot_key[slots] < 0).all(axis=1)
                if len(rows) > 1 and free.any():
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    p = int(np.argmax(free))
                    self.pilots[b] = first + p
                    self.slot_key[slots[p]] = rows
                    break
                first += 256

    @staticmethod
    def _hash(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def _slot(self, h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        x = (h ^ mixed) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        """Index of each word among the keys, -1 for others."""
        if not words or not self.keys:
            return [-1] * len(words)
        h = self._hash(words)
        pilots = self.pilots[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        at = self.slot_key[self._slot(h, self._mix(pilots.astype(np.uint64)))].tolist()
        keys = self.keys
        return [i if keys[i] == w else -1 for i, w in zip(at, words, strict=True)]


class Bpe:
    """Encoder and decoder for one vocabulary; ids are ranks."""

    def __init__(self, vocab: list[bytes], pattern: str = public_tokenizers.PATTERN, table: PerfectHash | None = None):
        self.vocab, self.pattern = vocab, regex.compile(FAST.get(pattern, pattern))
        self.table = table or PerfectHash(vocab)
        self.rank = {t: i for i, t in enumerate(vocab)}  # of merged pairs, for the heap
        # rank of each pair of bytes, -1 where they never merge
        self.byte_pairs = array("i", (self.rank.get(bytes((a, b)), -1) for a in range(256) for b in range(256)))
        self.memo: dict[bytes, array] = {}
        self.older: dict[bytes, array] = {}
        self.memo_bytes = 0

    def split(self, text: str) -> Iterable[str]:
        """Pre-tokens of a text; those of a very long one are not all held at once."""
        return self.pattern.findall(text) if len(text) <= CHUNK_BYTES else (m[0] for m in self.pattern.finditer(text))

    def merge(self, word: bytes) -> array:
        """Ids of bytes that aren't a vocabulary entry: always merge the leftmost pair of least rank.

        A heap entry holds a rank and the place of the pair's left part in one integer, which
        is smaller than a machine's digit for usual words and compares fastest. It is stale,
        and skipped, if it isn't the entry of the pair there now.
        """
        n, rank, pairs = len(word), self.rank.get, self.byte_pairs
        now = [-1] * n  # entry of the pair whose left part starts here, -1 for none
        heap: list[int] = []
        for i in range(n - 1):
            r = pairs[word[i] << 8 | word[i + 1]]
            if r >= 0:
                now[i] = e = r * n + i
                heap.append(e)
        heapify(heap)
        nxt = list(range(1, n + 1))  # start of the part after this one
        prev = list(range(-1, n))
        while heap:
            top = heappop(heap)
            i = top % n
            if now[i] != top:
                continue
            j = nxt[i]
            k = nxt[i] = nxt[j]
            now[i] = now[j] = -1
            if k < n:
                prev[k] = i
                if (r := rank(word[i : nxt[k]])) is not None:
                    now[i] = e = r * n + i
                    heappush(heap, e)
            if i:
                p = prev[i]
                if (r := rank(word[p:k])) is not None:
                    now[p] = e = r * n + p
                    heappush(heap, e)
                else:
                    now[p] = -1
        out, i = [], 0
        while i < n:
            k = nxt[i]
            out.append(rank(word[i:k], -1))
            i = k
        return array("i", out)

    def encode_words(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after the other, and where each pre-token's begin."""
        raw = [w.encode() for w in words]
        flat, ends = array("i"), np.zeros(len(raw) + 1, np.int64)
        for k, (b, i) in enumerate(zip(raw, self.table.find(raw), strict=True)):
            if i >= 0:
                flat.append(i)
            else:
                if (ids := self.memo.get(b)) is None:
                    ids = self.older.get(b) or self.merge(b)
                    self.memo_bytes += ENTRY_BYTES + len(b) + 4 * len(ids)
                    if self.memo_bytes > MEMO_BYTES:
                        self.older, self.memo, self.memo_bytes = self.memo, {}, 0
                    self.memo[b] = ids
                flat.extend(ids)
            ends[k + 1] = len(flat)
        return np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), ends

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        code: dict[str, int] = defaultdict(count().__next__)
        cuts = [np.fromiter(map(code.__getitem__, self.split(t)), np.int32) for t in texts]
        flat, starts = self.encode_words(code)
        sizes = np.diff(starts)
        out = []
        for c in cuts:
            n = sizes[c]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total) + np.repeat(starts[c] - ends + n, n)])
        return out

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Rows of ids as one Arrow array."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _encode_batches(vocab: list[bytes], pattern: str, make: Callable[[Bpe, list[str]], dict[str, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = PerfectHash(vocab)  # built once, on the driver; its size is that of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK_BYTES):
                bpe = bpe or Bpe(table.keys, pattern, table)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | make(bpe, texts))

    return common.tidy(run)


def encode(docs: DataFrame, vocab: list[bytes], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def make(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
        return {"ids": _lists(bpe.encode_many(texts))}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode_batches(vocab, pattern, make), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocab: list[bytes]) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [b"".join(map(vocab.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "raw": pa.array(raw, pa.binary())})

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, vocab: list[bytes], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Counts and digests of the ids and of the bytes decoded from them, in one pass."""

    def make(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
        found = bpe.encode_many(texts)
        decimal = bpe.__dict__.setdefault("decimal", [str(i) for i in range(len(bpe.vocab))])
        return {
            "n_tokens": pa.array(list(map(len, found)), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest() for ids in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()),
        }

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encode_batches(vocab, pattern, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary(path: str | None = None) -> list[bytes]:
    return read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids, counts and digests of the documents that are left."""

    def make(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
        found = bpe.encode_many(texts)
        return {
            "ids": _lists(found),
            "n_tokens": pa.array(list(map(len, found)), pa.int64()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()),
        }

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encode_batches(vocabulary(), public_tokenizers.PATTERN, make), "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_byte_bpe": query}
ORACLES: dict[str, str] = {}
