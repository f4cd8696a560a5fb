"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word shingles; two link when their Jaccard
similarity reaches the threshold. Documents with equal sets are one class. Every pair
that links shares, among the first shingles of either set in one common order, more
shingles than the larger set may miss; the order puts shingles of one class first, then
rare ones, then frequent ones. The prefix indexes its rare shingles singly. Where it
reaches into the frequent ones it is extended: they are dealt to subclasses by a hash
and indexed as pairs within a subclass, each subclass giving one pair less than it has
shingles, until the coverage is what the proof needs. Candidates are verified on whole
sets.

Frequencies are counted over all documents. To keep what is moved small, documents of
one size tier are compared on the shingles of a hash range that nearly always holds a
prefix (a document near a tier's edge takes part in both). Where the range holds too few
of a set's shingles, the set is indexed a second time by all of them; one short set and
one that isn't meet in the range, two short sets meet there. A shingle that is frequent
within one task's documents is counted there and only its count is sent.

Candidates of a key are not paired with each other at once. First all of a key meet the
member with the fewest shingles of its own, the likely original of a group of copies,
then some others; what links becomes one component, and keys with one component are
done. Members that are still apart meet at last, a pair only under the first key that it
shares, and only if sizes, shingles that no other set holds and parity sketches of the
whole sets leave a link possible. So large groups of copies cost their size, and no link
between different sets is lost.

Null, blank and empty texts have the empty set and link with nothing. A null doc_id is
never linked; its component is null. Repeated rows are members of one class; extra columns
are ignored (``representatives`` passes them on); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcurve.llm import common

#: Sets that hold a shingle from which on it is frequent.
FREQUENT = 16
#: Size tiers: least size, subclasses of frequent shingles. From the last on both double.
TIERS = ((0, 1), (100, 8), (300, 24), (1000, 48))
#: Deviations by which a tier's smallest set is expected to hold more of the hash range than a prefix needs.
SURE = 6.5
#: Added to a tier's number for sets that are indexed by all their shingles.
WHOLE = 1 << 16
#: Text bytes that are cut into shingles together, bytes whose words are hashed together, shingles that a task sends at once, and of a bucket.
CHUNK_BYTES, WORD_BYTES, SEND, BUCKET = 1 << 19, 1 << 19, 500_000, 1_000_000

#: Longs of a set's parity sketch. The bits in which two sketches differ are at most the
#: shingles that only one of the sets holds, so a pair that differs in too many can't link.
SKETCH = 16
#: Members of a key that all others meet, by turn, before those that are left meet each other.
PIVOTS = (1, 4)
#: A set's least open keys, by which a pair is met under its first shared key only, as far as they tell.
FIRST_KEYS = 12

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULT = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _times(n: int, m: np.uint64) -> np.uint64:
    """A product of two scalars modulo 2**64."""
    return np.uint64(int(n) * int(m) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MULT[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MULT[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingles of texts, for a shingle size."""

    def __init__(self, size: int):
        self.size = size
        self.fold = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.fold[65:91] += np.uint64(32)
        self.white = np.zeros(256, bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.powers, self.inverse = self._powers(WORD_BYTES)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first powers of an odd number and of its inverse modulo 2**64."""
        base = 0x2545F4914F6CDD1D
        step = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
        return step(np.uint64(base)), step(np.uint64(pow(base, -1, 1 << 64)))

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word: a polynomial over its bytes, from one running sum over a window of whole words."""
        white = self.white[data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        starts, ends = (edge[0::2], edge[1::2])  # data begins and ends with white space
        out = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + WORD_BYTES, "right")))
            n = int(ends[j - 1] - at)
            powers, inverse = (self.powers, self.inverse) if n <= WORD_BYTES else self._powers(n)  # one very long word
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.fold[data[at : at + n]] * powers[:n], out=total[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _ODD
            i = j
        return starts, _mix(out)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        starts, words = self._words(data)
        first = np.searchsorted(starts, bounds)  # words before each text
        n = self.size
        if len(words) >= n:
            grams = sum((words[i : len(words) - n + 1 + i] * _MULT[i % 8] + np.uint64(i) for i in range(n)), np.zeros(len(words) - n + 1, np.uint64))
            grams = _mix(grams)
        out = []
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:  # the whole sequence as one
                part = sum((words[a + i : a + i + 1] * _MULT[i % 8] for i in range(b - a)), np.full(1, _times(b - a, _ODD)))
                out.append(_mix(part))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def tier_of(n: int) -> int:
    t = max(i for i, (least, _) in enumerate(TIERS) if n >= least)
    return t + (n // TIERS[-1][0]).bit_length() - 1 if t == len(TIERS) - 1 else t


class Sizes:
    """What the threshold, a percentage, says of sizes; exact in integers."""

    def __init__(self, percent: int):
        self.percent, self.known = percent, {}

    def least(self, n: int) -> int:
        """Least size of a partner, and least overlap with any partner."""
        return -(-self.percent * n // 100)

    def alone(self, n: int) -> bool:
        """Whether a set links with equal ones only: not even one shingle more may differ.

        A set that may miss nothing itself can still lie within a larger one: 6 in 7 at 85 %.
        Where a partner may be smaller, one may be larger too.
        """
        return 100 * n < self.percent * (n + 1)

    def tiers(self, n: int) -> list[int]:
        """Tiers in which a set takes part: a pair is compared in the tier of its smaller set."""
        return list(range(tier_of(self.least(n)), tier_of(n) + 1))

    def tier(self, t: int) -> tuple[float, int]:
        """Share of the hash range and subclasses of a tier: the least share that nearly always holds a prefix."""
        if t >= WHOLE:
            return 1.0, self.tier(t - WHOLE)[1]
        if t not in self.known:
            doubled = max(0, t - len(TIERS) + 1)
            n, classes = (x << doubled for x in TIERS[min(t, len(TIERS) - 1)])
            need = n - self.least(n) + 1 + classes
            share = next((p / 100 for p in range(5, 100) if n * p / 100 - SURE * (n * p / 100 * (1 - p / 100)) ** 0.5 >= need), 1.0)
            self.known[t] = share if n else 1.0, classes
        return self.known[t]


#: Bits of a shingle that always tell shingles apart in the index: the upper half and those of the fewest buckets.
TOLD_APART = np.uint64(0xFFFFFFFF0000003F)


def _entity(shingles: np.ndarray, t: int, sizes: Sizes) -> tuple[int, np.ndarray]:
    """Identity of a set in a tier, and its shingles in the tier's hash range, salted by the tier."""
    share, _ = sizes.tier(t)
    salted = _mix(shingles ^ _times(t + 1, _MULT[4]))
    inside = salted if share == 1.0 else salted[salted < np.uint64(int(share * 2.0**64))]
    # the range's own bits are the order's, not the buckets': mix again
    return _name(shingles, t + 1), _mix(inside + _ODD)


def _entities(shingles: np.ndarray, sizes: Sizes) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tier, identity and shingles in the tier's range, for each tier in which a set is indexed."""
    n = len(shingles)
    if sizes.alone(n):
        return
    for t in sizes.tiers(n):
        e, inside = _entity(shingles, t, sizes)
        yield t, e, inside
        share, classes = sizes.tier(t)
        if share < 1.0 and len(np.unique(inside & TOLD_APART)) < n - sizes.least(n) + 1 + classes:
            yield t + WHOLE, *_entity(shingles, t + WHOLE, sizes)


def _name(shingles: np.ndarray, salt: int = 0) -> int:
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    x = _mix(shingles * _MULT[2] + place * _MULT[3] + _times(salt, _MULT[5]))
    return int(_mix(x.sum(dtype=np.uint64, keepdims=True) + _times(len(shingles), _ODD))[0].view(np.int64))


def _class(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([_name(shingles), _name(shingles, -1)], np.int64).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    make = Shingler(size)
    for batch in batches:
        for part in common.chunks(batch, "text", CHUNK_BYTES):
            yield part, make.sets([t or "" for t in part.column("text").to_pylist()])


def _members(docs: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """doc_id, class, n_shingles and the entities (id, shingles in its range) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("entities", pa.list_(pa.struct([("e", pa.int64()), ("inside", pa.int64()), ("t", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, size):
            rows = []
            for s in sets:
                rows.append([{"e": e, "inside": len(np.unique(inside & TOLD_APART)), "t": t} for t, e, inside in _entities(s, sizes)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_class(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, schema.field("entities").type)], schema=schema)

    return _texts(docs).mapInArrow(common.tidy(run), "doc_id long, class binary, n long, entities array<struct<e:long,inside:long,t:int>>")


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _send(docs: DataFrame, size: int, sizes: Sizes, buckets: int) -> DataFrame:
    """Postings by shingle bucket: bucket, shingles (high halves), entities, and what is known to be frequent.

    A shingle that more than FREQUENT sets of one task hold is frequent: its postings go
    straight on (``to``), its bucket is only told (``told``).
    """
    bits, names = np.uint64(buckets - 1), ["bucket", "shingles", "entities", "told", "to_shingles", "to_entities"]
    schema = pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in names[1:]]])

    def flush(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([x for _, x in held])
        owner = np.repeat(np.array([e for e, _ in held], np.int64), [len(x) for _, x in held])
        tokens = (tokens & (np.uint64(0xFFFFFFFF) << np.uint64(32))) | (tokens & bits)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        times = np.diff(np.concatenate((start, [len(tokens)])))
        hot = np.repeat(times > FREQUENT, times)
        told = tokens[start[times > FREQUENT]]
        bucket = (tokens & bits).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        order = order[~hot[order]]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        told_bucket = (told & bits).astype(np.int32)
        to = owner[hot] & np.int64(buckets - 1)
        rows = []
        for b in range(buckets):
            part, mine = order[cuts[b] : cuts[b + 1]], np.flatnonzero(hot)[to == b] if len(to) else []
            said = told[told_bucket == b]
            if len(part) or len(mine) or len(said):
                rows.append((b, _blob((tokens[part] >> np.uint64(32)).astype(np.uint32)), _blob(owner[part]), _blob((said >> np.uint64(32)).astype(np.uint32)), _blob(tokens[mine]), _blob(owner[mine])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are sent once
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for _, sets in _sets(batches, size):
            for s in sets:
                for _, e, inside in _entities(s, sizes):
                    if e not in seen:
                        seen.add(e)
                        held.append((e, inside))
                        n += len(inside)
            if n >= SEND:
                yield flush(held)
                held, n = [], 0
                if len(seen) > SEND:
                    seen.clear()
        if n:
            yield flush(held)

    return _texts(docs).where("doc_id is not null").mapInArrow(common.tidy(run), "bucket int, shingles binary, entities binary, told binary, to_shingles binary, to_entities binary")


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of all rows with one value of ``column``, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column(held[0].schema.get_field_index(column))[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _join(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _count(sent: DataFrame, buckets: int) -> DataFrame:
    """Postings of shingles that several sets hold, by bucket of the set: to, shingles, entities, times."""
    schema = pa.schema([("to", pa.int32()), ("shingles", pa.binary()), ("entities", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "bucket"):
            bucket = np.uint64(table.column("bucket")[0].as_py())
            tokens, owner, told = _join(table.column("shingles"), np.uint32), _join(table.column("entities"), np.int64), np.unique(_join(table.column("told"), np.uint32))
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            if len(tokens):
                new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])))
                tokens, owner = tokens[new], owner[new]
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
            times = np.diff(np.concatenate((start, [len(tokens)])))
            if len(told) and len(start):
                at = np.minimum(np.searchsorted(told, tokens[start]), len(told) - 1)
                times_known = np.where(told[at] == tokens[start], FREQUENT + 1, np.minimum(times, FREQUENT + 1))
            else:
                times_known = np.minimum(times, FREQUENT + 1)
            each = np.repeat(times_known, times).astype(np.uint8)
            keep = each > 1
            to_tokens, to_owner = _join(table.column("to_shingles"), np.uint64), _join(table.column("to_entities"), np.int64)
            tokens = np.concatenate((tokens[keep].astype(np.uint64) << np.uint64(32) | bucket, to_tokens))
            owner, each = np.concatenate((owner[keep], to_owner)), np.concatenate((each[keep], np.full(len(to_owner), FREQUENT + 1, np.uint8)))
            to = owner & np.int64(buckets - 1)
            order = np.argsort(to, kind="stable")
            goes, cuts = np.unique(to[order], return_index=True)
            parts = np.split(order, cuts[1:]) if len(order) else []
            if len(parts):
                yield pa.RecordBatch.from_arrays([pa.array(goes.astype(np.int32)), *[pa.array([_blob(x[p]) for p in parts], pa.binary()) for x in (tokens, owner, each)]], schema=schema)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(common.tidy(run), "to int, shingles binary, entities binary, times binary")


def keys_of(n: int, inside: int, shingles: np.ndarray, times: np.ndarray, t: int, sizes: Sizes) -> np.ndarray:
    """Index keys of one set: single rare shingles, pairs of frequent ones, as far as the coverage asks.

    ``shingles`` are those that other sets hold too, ``inside`` counts all in the tier's range.
    """
    need = n - sizes.least(n) + 1 - (inside - len(shingles))  # shingles of this set alone come first
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((shingles, times))
    shingles, times = shingles[order], times[order]
    rare = shingles[times <= FREQUENT][:need]
    need -= len(rare)
    out = [rare]
    if need > 0:
        _, classes = sizes.tier(t)
        groups: dict[int, list[int]] = {}
        for x in shingles[times > FREQUENT].tolist():
            group = groups.setdefault(((x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) % classes, [])
            if group:
                out.append(_mix(np.array(group, np.uint64) * _MULT[6] + _times(x, _MULT[7])))
                need -= 1
            group.append(x)
            if not need:
                break
    return np.concatenate(out)


def _keys(counted: DataFrame, entities: DataFrame, buckets: int, sizes: Sizes) -> DataFrame:
    """key, e, n and u, the number of shingles that no other set is known to hold, of every index key."""
    schema = pa.schema([("key", pa.int64()), ("e", pa.int64()), ("n", pa.int64()), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "to"):
            known = table.filter(pa.compute.is_valid(table.column("e")))
            e, n, inside, tiers = (known.column(c).to_numpy() for c in ("e", "n", "inside", "t"))
            tokens, owner, times = _join(table.column("shingles"), np.uint64), _join(table.column("entities"), np.int64), _join(table.column("times"), np.uint8)
            order = np.argsort(owner, kind="stable")
            tokens, owner, times = tokens[order], owner[order], times[order]
            lo, hi = np.searchsorted(owner, e), np.searchsorted(owner, e, "right")
            out_key, out_at, out_own = [], [], []
            for i in np.flatnonzero(hi > lo):
                part = slice(lo[i], hi[i])
                mine, first = np.unique(tokens[part], return_index=True)  # a set sent by several tasks
                keys = keys_of(int(n[i]), int(inside[i]), mine, times[part][first], int(tiers[i]), sizes)
                out_key.append(keys)
                out_at.append(np.full(len(keys), i))
                out_own.append(np.full(len(keys), int(inside[i]) - len(mine)))
            if out_key:
                at = np.concatenate(out_at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key).view(np.int64)), pa.array(e[at]), pa.array(n[at]), pa.array(np.concatenate(out_own))], schema=schema)

    nothing = F.lit(None).cast("binary")
    meta = entities.select(F.expr(f"e & {buckets - 1}L").cast("int").alias("to"), "e", "n", "inside", "t", nothing.alias("shingles"), nothing.alias("entities"), nothing.alias("times"))
    none = F.lit(None).cast("long")
    rows = meta.unionByName(counted.select("to", none.alias("e"), none.alias("n"), none.alias("inside"), F.lit(None).cast("int").alias("t"), "shingles", "entities", "times"))
    return rows.repartition("to").sortWithinPartitions("to").mapInArrow(common.tidy(run), "key long, e long, n long, u long")


def _sketch(shingles: np.ndarray) -> list[int]:
    """Parity of the number of shingles in each of 64 * SKETCH cells of the hash range."""
    cell = (_mix(shingles + _MULT[7]) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = np.bincount(cell, minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _may_link(percent: int, both: F.Column) -> F.Column:
    """Whether the sketches a0.. and b0.. of sets of these sizes together leave a link possible."""
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    return (100 + percent) * apart <= (100 - percent) * both


def _fits(percent: int) -> F.Column:
    """Whether sizes and shingles that one set alone holds leave a link of (n, u) and (n2, u2) possible."""
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return sizes & ((100 + percent) * F.least(F.col("n") - F.col("u"), F.col("n2") - F.col("u2")) >= percent * (F.col("n") + F.col("n2")))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common_ = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_ >= percent * (len(both) - common_))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(common.tidy(run), "a long, b long")


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` (pc, part) after the links ``found`` between them: only parts that a link joins are looked at."""
    named = lambda c: parts.select(F.col("pc").alias(f"x{c}"), F.col("part").alias(f"p{c}"))
    edges = found.join(named("a"), F.col("a") == F.col("xa")).join(named("b"), F.col("b") == F.col("xb")).select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
    now = common.components(edges).withColumnRenamed("component", "now")
    return common.forget(parts.join(now, F.col("part") == F.col("node"), "left").select("pc", F.coalesce("now", "part").alias("part")))


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid, shingles and sketch of the classes in ``wanted`` (id, class, cid), from the text of one of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, size):
            rows = pa.RecordBatch.from_pydict({"cid": part.column("cid"), "shingles": pa.array([_blob(s) for s in sets], pa.binary()), "sketch": pa.array([_sketch(s) for s in sets], pa.list_(pa.int64()))})
            # a repeated doc_id can have several texts
            yield rows.filter(pa.compute.equal(pa.array([_class(s) for s in sets], pa.binary()), part.column("want")))

    held = _texts(docs).join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("text", F.col("class").alias("want"), "cid")
    return held.mapInArrow(common.tidy(run), "cid long, shingles binary, sketch array<long>").groupBy("cid").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _pivots(open_: DataFrame, turn: int) -> DataFrame:
    """A few members of each key: k, c2, n2, u2, p2. Keys of the same members have the same ones."""
    member = F.struct("cid", "n", "u", "part")
    if turn == 0:
        picked = [F.min_by(member, F.struct("u", F.xxhash64(F.lit(0), "cid")))]
    else:
        picked = [F.min_by(member, F.xxhash64(F.lit(turn), F.lit(i), "cid")) for i in range(PIVOTS[turn])]
    found = open_.groupBy("key").agg(*[x.alias(f"x{i}") for i, x in enumerate(picked)])
    found = found.select(F.col("key").alias("k"), F.explode(F.array_distinct(F.array(*[f"x{i}" for i in range(len(picked))]))).alias("x"))
    return found.select("k", F.col("x.cid").alias("c2"), F.col("x.n").alias("n2"), F.col("x.u").alias("u2"), F.col("x.part").alias("p2"))


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every document."""
    sizes = Sizes(percent)
    members = common.forget(_members(docs, size, sizes))
    classes = members.where("doc_id is not null").groupBy("class", "n").agg(F.min("doc_id").alias("rep"), F.first("entities").alias("entities"))
    classes = common.forget(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(6, (total // (2 * BUCKET)).bit_length())
    entities = common.forget(classes.select("cid", "n", F.explode("entities").alias("x")).select("cid", "n", F.col("x.e").alias("e"), F.col("x.inside").alias("inside"), F.col("x.t").alias("t")))
    common.release(docs.sparkSession)
    counted = _count(_send(docs, size, sizes, buckets), buckets)
    keys = common.forget(_keys(counted, entities, buckets, sizes))
    several = common.forget(keys.groupBy("key").agg(F.min("e").alias("least"), F.max("e").alias("most")).where("least <> most").select(F.col("key").alias("k")))
    keys = keys.join(several, F.col("key") == F.col("k"), "left_semi")
    open_ = common.forget(keys.join(entities.select(F.col("e").alias("w"), "cid"), F.col("e") == F.col("w")).select("key", "cid", "n", "u", F.col("cid").alias("part")))
    parts = common.forget(open_.select(F.col("cid").alias("pc")).distinct().withColumn("part", F.col("pc")))
    wanted = classes.join(parts.select("pc"), F.col("cid") == F.col("pc"), "left_semi").select(F.col("rep").alias("id"), "class", "cid")
    sets = common.forget(_whole_sets(docs, wanted, size))
    common.release(docs.sparkSession)

    sketched = lambda letter, name: sets.select(F.col("cid").alias(name), *[F.col("sketch")[i].alias(f"{letter}{i}") for i in range(SKETCH)])
    apart = (F.col("part") != F.col("p2")) & _fits(percent)
    pair = [F.least("cid", "c2").alias("a"), F.greatest("cid", "c2").alias("b")]
    seen = None
    for turn in range(len(PIVOTS) + 1):
        if turn < len(PIVOTS):
            pivot = common.forget(_pivots(open_, turn))
            pairs = open_.join(pivot, (F.col("key") == F.col("k")) & apart).select(*pair, (F.col("n") + F.col("n2")).alias("n")).distinct()
            pairs = pairs.join(sketched("a", "s1"), F.col("a") == F.col("s1")).join(sketched("b", "s2"), F.col("b") == F.col("s2")).where(_may_link(percent, F.col("n"))).select("a", "b")
        else:  # members of different components, where there are any left, meet each other under their first shared key
            first = open_.groupBy(F.col("cid").alias("fc")).agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("first"))
            left = open_.join(sketched("a", "s1"), F.col("cid") == F.col("s1")).join(first, F.col("cid") == F.col("fc")).drop("s1", "fc")
            left = common.forget(left)
            right = left.select(F.col("key").alias("k"), F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("u").alias("u2"), F.col("part").alias("p2"), F.col("first").alias("first2"), *[F.col(f"a{i}").alias(f"b{i}") for i in range(SKETCH)])
            earliest = F.coalesce(F.array_min(F.array_intersect("first", "first2")), F.col("key")) >= F.col("key")
            pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("cid") < F.col("c2")) & apart & _may_link(percent, F.col("n") + F.col("n2")) & earliest).select(*pair).distinct()
        pairs = common.forget(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        if turn and not pairs.limit(1).count():
            continue  # another member, or all that are left, may still find some
        found = common.forget(_verify(pairs, sets, percent))
        seen = pairs if seen is None else seen.unionByName(pairs)
        parts = _merged(parts, found)
        if turn == len(PIVOTS):
            break
        open_ = open_.drop("part").join(parts, F.col("cid") == F.col("pc")).drop("pc")
        mixed = open_.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
        open_ = common.forget(open_.join(common.forget(mixed), F.col("key") == F.col("k"), "left_semi"))
        common.release(docs.sparkSession)
        if not open_.limit(1).count():
            break

    owned = classes.join(parts, F.col("cid") == F.col("pc"), "left").select("class", "n", "rep", F.coalesce("part", "cid").alias("part"))
    owned = common.forget(owned)
    least = common.forget(owned.groupBy("part").agg(F.min("rep").alias("component_id")).select(F.col("part").alias("p"), "component_id"))
    owned = common.forget(owned.join(least, F.col("part") == F.col("p")).select(F.col("class").alias("c"), F.col("n").alias("cn"), "component_id"))
    rows = members.select("doc_id", "class", "n").join(owned, (F.col("class") == F.col("c")) & (F.col("n") == F.col("cn")), "left")
    alone = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(alone, "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, all columns: that of the component's least doc_id.

    Rows with a null doc_id stay. Of rows that repeat a doc_id the one with the least text stays.
    """
    found = groups(docs, size, percent).select("doc_id", "component_id")
    kept = common.forget(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("times")))
    # columns of the table travel in a struct of their own: no name clashes
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("doc", F.col("row.doc_id").cast("long"))
    rows = rows.join(kept.hint("shuffle_hash"), F.col("doc") == F.col("id"), "left").where("id is not null or doc is null")
    if kept.where("times > 1").limit(1).count():  # repeated ids: the rows of one id, not of a group, meet here
        order = Window.partitionBy("doc").orderBy("row.text")
        once, again = (rows.where(c) for c in ("coalesce(times, 1) = 1", "times > 1"))
        rows = once.unionByName(again.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place"))
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir), 4, 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_ngram_jaccard": query}
ORACLES: dict[str, str] = {}
