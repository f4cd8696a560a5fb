"""Each operator on small fixtures: brute force, odd rows, ties, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from transcurve.llm import bpe, common, embeddings, html_extract, jaccard, licenses, line_dedup, media, mixing, secrets, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, row int"


def odd_rows():
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here and there", "en", "b", 1), (3, "word", "en", "a", 4), (3, "word", "en", "a", 4), (4, "x" * 200_000 + " end", "en", None, 5)]
    rows += [(5, "the same text stands here twice, word for word", "en", "a", 6), (6, "the same text stands here twice, word for word", "en", "b", 6), (7, " \t\n ", "en", "c", 4)]
    return [(*r, "clash", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# -- media
def test_media_round_trip(spark, odd):
    rows = media.read(media.store(odd)).collect()
    assert len(rows) == len(odd_rows())
    want = collections.Counter()
    for _, text, *_ in odd_rows():
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert collections.Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert media.read(media.store(odd.limit(0))).count() == 0


def jpeg(width, height, sampling, restart, blocks, rng):
    """A colour JPEG with several codes, from random coefficients; returns it and the DC values."""
    codes = {0: {0: "00", 3: "01", 5: "100"}, 1: {0x00: "00", 0x01: "01", 0x13: "100", 0xF0: "101", 0x22: "1100"}}

    def spec(table):
        sizes = sorted((len(c), c, s) for s, c in table.items())
        return bytes(sum(n == k for n, _, _ in sizes) for k in range(1, 17)) + bytes(s for _, _, s in sizes)

    def bits(value, size):
        return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    out, dcs, run, pred, marks = b"", [], "", [0] * len(sampling), 0
    mcus = -(-width // (8 * max(h for h, _ in sampling))) * -(-height // (8 * max(v for _, v in sampling)))

    def close(run):
        run += "1" * (-len(run) % 8)
        return bytes(int(run[i : i + 8], 2) for i in range(0, len(run), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(mcus):
        if restart and m and m % restart == 0:
            out, run, pred = out + close(run) + bytes([0xFF, 0xD0 + marks % 8]), "", [0] * len(sampling)
            marks += 1
        for c, (h, v) in enumerate(sampling):
            for _ in range(h * v):
                size = rng.choice([0, 3, 5])
                diff = 0 if not size else rng.choice([-1, 1]) * rng.randrange(1 << (size - 1), 1 << size)
                pred[c] += diff
                dcs.append((c, pred[c]))
                run += codes[0][size] + bits(diff, size)
                k = 1
                while k < 64:
                    s = rng.choice([0x00, 0x01, 0x13, 0xF0, 0x22])
                    if s == 0 or k + (s >> 4) > 63:
                        run += codes[1][0]
                        break
                    size = s & 15
                    run += codes[1][s] + (bits(rng.choice([-1, 1]) * rng.randrange(1 << (size - 1), 1 << size), size) if size else "")
                    k += (s >> 4) + 1
    seg = lambda k, b: bytes([0xFF, k]) + (len(b) + 2).to_bytes(2, "big") + b
    n = len(sampling)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += seg(0xC4, b"\x00" + spec(codes[0])) + seg(0xC4, b"\x10" + spec(codes[1])) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    head += seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0")
    return head + out + close(run) + b"\xff\xd9", dcs


def test_any_baseline_jpeg():
    rng = random.Random(4)
    made = [jpeg(w, h, s, r, 0, rng) for w, h, s, r in ((20, 9, [(1, 1)], 0), (40, 40, [(2, 2), (1, 1), (1, 1)], 2), (33, 17, [(2, 1), (1, 1), (1, 1)], 0), (8, 8, [(1, 1)], 1))]
    found = media.decode([m for m, _ in made] + [b"no jpeg", made[0][0][:40], made[1][0][:-30]])
    for (_, dcs), got in zip(made, found, strict=False):
        image, coef, parts = got
        assert [(int(c), int(d)) for c, d in zip(parts, coef[:, 0], strict=True)] == dcs
        thumb = media.thumbnail(image, coef, parts)
        luminance = [min(255, max(0, (2 * d + 4) // 8 + 128)) for c, d in dcs if c == 0]
        assert sorted(thumb.ravel().tolist()) == sorted(luminance) and len(media.mean_hash(thumb)) == 16
    assert all(isinstance(x, media.MediaError) for x in found[len(made) : len(made) + 2])
    assert media.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_broken_media_give_errors(spark):
    rows = media.read(spark.createDataFrame([(1, 3, b"abc"), (2, None, None)], "doc_id long, n_bytes long, media binary").select("doc_id", "n_bytes", F.col("media").cast("binary").alias("media"))).orderBy("doc_id").collect()
    assert rows[0].error and rows[0].media_bytes == 3 and rows[1].error == "no media" and rows[1].media_sha256 is None


# -- toxicity
def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        if bad:
            text.insert(rng.randrange(len(text) + 1), rng.choice(["vexlor", "Vexlorian", "zumquish"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(r.predicted, i % 4 == 0) for i, r in found.items() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in found.values())


def test_toxicity_odd_rows(spark, odd):
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None
    rows = toxicity.score(odd, toxicity.fit(["bad badword"] * 3 + ["fine text"] * 3, [1] * 3 + [0] * 3)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.reject(odd, none).count() == len(odd_rows())


def test_fit_is_the_optimum_by_dicts():
    """Features, log-count ratios, the objective's gradient and scores, all with dicts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) + (" Vexlor!" if k % 3 == 0 else "") for k in range(90)]
    y = [int(k % 3 == 0) for k in range(90)]
    model = toxicity.fit(texts, y)

    def features(text):
        folded = " " + "".join(c if c.isalnum() else " " for c in text.lower()) + " "
        out = set()
        for n in toxicity.ORDERS:
            for k in range(len(folded) - n + 1):
                h = ord(folded[k])
                for c in folded[k + 1 : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out.add((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
        return out

    found = [features(t) for t in texts]
    counts = [collections.Counter(f for fs, k in zip(found, y, strict=True) if k == c for f in fs) for c in (0, 1)]
    ratio, strength = {}, {}
    for f in set(counts[0]) | set(counts[1]):
        a, b = counts[1][f] + 1, counts[0][f] + 1
        if counts[0][f] + counts[1][f] > 1:
            ratio[f] = np.log(a / (sum(y) + 2)) - np.log(b / (len(y) - sum(y) + 2))
            strength[f] = abs(ratio[f]) / np.sqrt(1 / a + 1 / b)
    least = min(toxicity.STRENGTH, max(strength.values()) / 2)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert set(weights) == {f for f, s in strength.items() if s >= least}
    z = [model.intercept + sum(weights.get(f, 0) for f in fs) for fs in found]
    p = [1 / (1 + np.exp(-v)) for v in z]
    assert model.scorer()(texts) == pytest.approx(p)
    for f in weights:  # the slope of the penalised loss in the feature's own weight
        slope = sum((q - k) * ratio[f] for fs, q, k in zip(found, p, y, strict=True) if f in fs) / len(y)
        assert abs(slope + toxicity.PENALTY * weights[f] / ratio[f]) < 2e-3


# -- mixing
def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []
    assert sum(mixing.targets([1, 1000, 3, 9])) == pytest.approx(1013)


def test_splitting_tree_is_exact_and_fair():
    quotas = [1000, 10, 0, 333]
    tree = lambda *a: np.array([have for _, _, have in mixing.split_tree(*a)])
    t = tree(quotas, 7, 1)
    firsts = np.array([first for _, first, _ in mixing.split_tree(quotas, 7, 1)])
    assert (firsts == np.cumsum(t, axis=0) - t).all()  # runs follow each other
    assert (t[2:5] == tree(quotas, 7, 1, 2, 5)).all()  # a part of the tree, grown apart
    assert t.sum(axis=0).tolist() == quotas and (t >= 0).all() and np.ptp(t.sum(axis=1)) <= 2
    assert (t == tree(quotas, 7, 1)).all()
    mean = np.mean([tree([40, 60], 4, s)[0] for s in range(400)], axis=0)
    assert mean == pytest.approx([10, 15], abs=0.6)


def test_fill_is_near():
    rng = random.Random(2)
    for _ in range(30):
        rows = [(i, rng.randint(1, 40)) for i in range(rng.randint(1, 25))]
        want = rng.randint(0, 150)
        sizes = dict(rows)
        for times in (1, 2):
            sums = {0}
            for _, n in rows * times:
                sums |= {s + n for s in sums}
            taken = mixing.fill(rows, want, times)
            assert abs(sum(sizes[k] * n for k, n in taken.items()) - want) == min(abs(s - want) for s in sums)
            assert max(taken.values(), default=0) <= times


def test_mix(docs, texts):
    m = mixing.Mix(docs)
    rows = m.shards(m.sized, 5).select("row.doc_id", "source", "size", "source_size", "target", "copies", "shards").collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 5 for s in r.shards)
    goal = mixing.targets([sum(r.size for r in by[s]) for s in sorted(by)])
    for s, t in zip(sorted(by), goal, strict=True):
        assert by[s][0].target == pytest.approx(t) and by[s][0].source_size == sum(r.size for r in by[s])
        assert abs(sum(r.copies * r.size for r in by[s]) - t) <= max(5, 0.02 * t)
    again = mixing.Mix(docs.repartition(3))
    assert {r.doc_id: r.copies for r in rows} == {r.doc_id: r.copies for r in again.taken(again.sized).select("row.doc_id", "copies").collect()}


@pytest.mark.parametrize("digit", [12, 2])
def test_mix_equals_plain_version(docs, monkeypatch, digit):
    """Blocks taken in order, the boundary block filled, every block's draws dealt by the tree, all in plain Python."""
    monkeypatch.setattr(mixing, "DIGIT", digit)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    m = mixing.Mix(docs)
    rows = m._placed(m.sized).select("row.doc_id", "sid", "source_size", "target", "bits", "slot", "key", "size").collect()
    copies, quotas, blocks = collections.Counter(), {}, {}
    for sid in sorted({r.sid for r in rows}):
        mine = [r for r in rows if r.sid == sid]
        total = sum(r.size for r in mine)
        want = min(round(mine[0].target), 3 * total)
        passes, rest = divmod(want, total)
        per = collections.Counter()
        for r in mine:
            per[r.slot] += r.size
            copies[r.doc_id] += passes if r.size else 0
        n, edge = 1 << mine[0].bits, 0
        while rest >= per[edge] and edge < n - 1:
            rest -= per[edge]
            edge += 1
        times = max(1, min(2, 3 - passes))
        keys = collections.Counter()
        for r in mine:
            if r.slot == edge and r.size:
                keys[r.key] += r.size
        picked = mixing.fill(sorted(keys.items()), rest, times) if rest else {}
        for r in mine:
            copies[r.doc_id] += (r.slot < edge or picked.get(r.key, 0) if r.slot <= edge else 0) if r.size else 0
        quotas[sid], blocks[sid] = passes * n + edge + (times if rest else 0), (n, passes, edge)
    dealt = collections.defaultdict(list)
    for shard, first, have in mixing.split_tree([quotas[s] for s in sorted(quotas)], 5, m.seed):
        for sid, (f, k) in enumerate(zip(first.tolist(), have.tolist(), strict=True)):
            n, passes, edge = blocks[sid]
            for unit in range(f, f + k):
                again = unit > passes * n + edge
                dealt[sid, edge if again else unit % n].append((passes + 1 if again else unit // n, shard))
    found = {r.doc_id: (r.copies, list(r.shards)) for r in m.shards(m.sized, 5).select("row.doc_id", "copies", "shards").collect()}
    assert found == {r.doc_id: (copies[r.doc_id], [s for _, s in sorted(dealt[r.sid, r.slot])][: copies[r.doc_id]]) for r in rows}
    placed = m.rows(mixing._sized(docs, m.seed), 5).select("row.doc_id", "shard", "place").collect()
    assert collections.Counter((r.doc_id, r.shard) for r in placed) == collections.Counter((i, s) for i, (_, x) in found.items() for s in x)


def test_mix_odd_rows(odd):
    m = mixing.Mix(odd)
    rows = m.taken(m.sized).collect()
    assert len(rows) == len(odd_rows()) and all(r.copies == 0 for r in rows if r.size == 0)
    assert [r.sid for r in rows if r.source is None][0] == max(r.sid for r in rows)
    assert mixing.stage(odd.sparkSession, odd, "").columns == odd.columns
    empty = mixing.Mix(odd.limit(0))
    assert empty.taken(empty.sized).count() == 0 and mixing.stage(odd.sparkSession, odd.limit(0), "").count() == 0


# -- lines
def test_line_dedup_equals_sql(same_rows):
    same_rows(line_dedup.query, line_dedup.ORACLE)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("chars", [24, 1])
def test_line_dedup_equals_brute_force(spark, chars):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in (1, 2, 3, 8, 24, 31, 32, 33, 64, 65, 97, 200)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(s) + 1)
                s = s[:k] + rng.choice(["", "z", "b"]) + s[k + rng.choice([0, 1]) :]
            lines.append(s)
        rows.append((i, "\n".join(lines)))
    found = {(r.doc_id, r.no) for r in line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), chars).collect()}
    seen, want = [], set()
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            s = line.strip(" ")
            if s:
                if any(s == o or min(len(s), len(o)) >= chars and abs(len(s) - len(o)) <= 1 and edit_distance(s, o) <= 1 for o in seen):
                    want.add((i, no))
                seen.append(s)
    assert found == want


def test_line_dedup_odd_rows(odd):
    out = line_dedup.clean(odd)
    assert out.columns == odd.columns
    ids = sorted((r.doc_id or 0) for r in out.collect())
    assert ids == [0, 1, 2, 3, 3, 4, 5, 7]
    assert line_dedup.clean(odd.limit(0)).count() == 0 and line_dedup.decisions(odd).count() == len(odd_rows())


def test_stage_drops_short_repeats(spark):
    rows = [(1, "Les.\n\n \t\nA line that is long enough for edits.\nLes.\nLos."), (2, " Les. \n\nA line that is long enough for edits!\nNew."), (3, "Les."), (4, "\n"), (None, "Les.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.stage(spark, docs, SF).collect()}
    assert found == {1: "Les.\n\n \t\nA line that is long enough for edits.\nLos.", 2: "\nNew.", 4: "\n", None: "Les."}
    assert {r.doc_id: r.removed for r in line_dedup.decisions(docs).collect()}[2] == "0,2"


def test_clashing_columns_of_clean(spark):
    clash = spark.createDataFrame([(1, "same line\nother", 9, 8, 7, "x"), (2, "same line\nnew", 9, 8, 7, "x")], "doc_id long, text string, id int, `left` int, gone int, `__text` string")
    rows = line_dedup.clean(clash)
    assert rows.columns == clash.columns and [tuple(r) for r in rows.orderBy("doc_id").collect()] == [(1, "same line\nother", 9, 8, 7, "x"), (2, "new", 9, 8, 7, "x")]


# -- embeddings
def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.2, 0.3])
            rows.append((n, v.astype(np.float32).tolist()))
            n += 1
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.95) & ~np.eye(n, dtype=bool)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 32), (n + 3, [float("nan")] * 32), (n + 4, [None] * 32), (None, rows[0][1]), (n + 5, [1.0, 2.0])]
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    links = sum(found[i].n_links for i in range(n))
    assert all(found[i].n_links <= near[i].sum() for i in range(n)) and links >= 0.95 * near.sum()
    for i, _ in odd:
        assert found[i].n_links == 0 and found[i].component_id == i and found[i].kept == (i is not None)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_equal_vectors_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOT", 16)
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, (base + (i % 50) * 1e-4 * rng.standard_normal(16)).tolist()) for i in range(60)] + [(100 + i, base.tolist()) for i in range(20)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 79 and r.component_id == 0 and r.kept == (r.vec_id == 0) for r in found)


def test_calibration():
    for n in (10, 10_000, 10**9):
        signs, bands = embeddings.calibrate(n)
        same = (1 - np.arccos(0.95) / np.pi) ** signs
        assert 1 - (1 - same) ** bands >= embeddings.BLOCK_RECALL and (bands == 1 or 1 - (1 - same) ** (bands - 1) < embeddings.BLOCK_RECALL)


@pytest.mark.parametrize("at_once", [200_000, 7])
def test_collisions_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(embeddings, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    lines = rng.integers(-20, 20, (120, embeddings.LINES)).astype(np.int8)
    lines[60:] = np.clip(lines[:60] + rng.integers(-9, 9, (60, embeddings.LINES)), -127, 127)
    group = rng.integers(0, 3, 120)
    group[60:] = np.where(rng.random(60) < 0.8, group[:60], group[60:])
    found = collections.Counter((min(a, b), max(a, b)) for i, j in embeddings.collide(group, lines, 6, 20) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    want = {(a, b) for b in range(120) for a in range(b) if group[a] == group[b] and (np.abs(lines[a].astype(int) - lines[b]) <= 6).sum() >= 20}
    assert set(found) == want and max(found.values()) == 1 and len(want) > 20


def test_recall_on_a_large_table(spark):
    """100,000 vectors with 2,000 planted pairs at cosines of 0.95 to 0.96, against all pairs by brute force."""
    rng = np.random.default_rng(21)
    n, dim = 100_000, 48
    v = rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    away = rng.standard_normal((2000, dim))
    away -= (away * v[:2000]).sum(1, keepdims=True) * v[:2000]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.96, (2000, 1))
    v[2000:4000] = cos * v[:2000] + np.sqrt(1 - cos**2) * away
    want = set()
    for lo in range(0, n, 2000):
        a, b = np.nonzero(v[lo : lo + 2000] @ v.T >= 0.95)
        want |= {(x + lo, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x + lo < y}
    classes = spark.createDataFrame(pd.DataFrame({"cid": np.arange(n), "size": 1, "vector": [x.tobytes() for x in v]}), "cid long, size long, vector binary").repartition(8)
    pairs = embeddings.candidates(classes.select("cid", "vector"), embeddings.Lines(*embeddings.calibrate(n))).cache()
    found = {(r.a, r.b) for r in embeddings.verify(pairs, classes).collect()}
    assert len(want) >= 2000 and found <= want and len(found) / len(want) >= 0.95
    assert pairs.count() < 20 * len(want)  # the count leaves few to verify


def test_odd_vector_rows(spark):
    rows = [(1, [1.0, 0.0], "x", 5), (1, [1.0, 0.01], "y", 6), (2, [0.0, 1.0], "z", 7), (2, [0.0, 1.0], "z", 7), (3, [1.0, 0.0, 0.0], "w", 8)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<double>, hash string, size int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(clash).collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 0, 3, True)]


# -- secrets
def test_secret_spans(spark):
    live, copied = "Zk3" + "q9Xw7LmN2vB4" * 2, "Ab1" + "cD2eF3gH4iJ5" * 2
    rows = [(1, f'x password: "{live}" y', "a"), (2, "API_KEY=short token = 0123456789abcdef01", "a"), (3, "AKIAABCDEFGHIJKLMN and AKIASHORT", "b"), (4, None, None), (5, f"-----BEGIN RSA PRIVATE KEY----- {live}Q", "c")]
    rows += [(10 + i, f"see {copied} here", f"s{i}") for i in range(4)]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    spans = {i: [(s.kind, s.start, s.end, s.base) for s in r.spans] for i, r in found.items()}
    assert spans[1] == [("assign", 2, 2 + len(f'password: "{live}'), True)]
    assert [s[0] for s in spans[2]] == ["assign", "hex"] and [s[0] for s in spans[3]] == ["access"] and spans[4] == []
    assert [s[0] for s in spans[5]] == ["private", "mixed"] and all(spans[10 + i] == [] for i in range(4))
    assert found[1].spans[0].n_owners == 1


def test_secret_base_equals_brute_force(spark, texts):
    found = {r.doc_id: r.base_sha256 for r in secrets.query(spark, SF).collect()}
    assign = re.compile(secrets.ASSIGN, re.I | re.A)
    for i, t in texts.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 16]
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest() == found[i]


@pytest.mark.parametrize("frequent", [1, 25, 1000])  # no value, some, all
def test_secret_ownership_equals_plain(spark, frequent, monkeypatch):
    """Every span's counts of documents and owners, and which spans stay, from dicts over plain scans."""
    monkeypatch.setattr(secrets, "FREQUENT", frequent)
    rng = random.Random(6)
    values = ["".join(rng.choice("abcXYZ0123456789") for _ in range(30)) + "aZ9" for _ in range(25)]
    rows = [(i if i % 9 else None, " and ".join(f"{rng.choice(['', 'token=', 'key '])}{rng.choice(values)}" for _ in range(rng.randint(0, 3))), rng.choice(["a", "b", "c", "d", None])) for i in range(80)]
    scan = secrets.Scanner()
    texts = []
    for i, text, source in rows:
        base = scan.base(text)
        texts.append([(k, a, b, hashlib.sha256(v.encode()).hexdigest()[:32], own) for spans, own in ((base, True), (scan.more(text, base), False)) for k, a, b, v in spans])
    repos, owners = collections.defaultdict(set), collections.defaultdict(set)
    for (i, _, source), spans in zip(rows, texts, strict=True):
        for *_, value, _ in spans:
            repos[value].add((source, i))
            owners[value].add(source)
    want = collections.Counter()
    for (i, _, _), spans in zip(rows, texts, strict=True):
        kept = [(k, a, b, len(repos[v]), len(owners[v])) for k, a, b, v, own in spans if own or len(owners[v]) < secrets.EXAMPLE_OWNERS]
        want[i, tuple(sorted(kept, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))] += 1
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end, s.n_repos, s.n_owners) for s in r.spans)) for r in found) == want


def test_many_spans_in_one_text():
    scan = secrets.Scanner()
    text = " ".join(f"token=abcdef{i:08d}Zz Qw3rT7yU9iOp2aS4dF6gH8{i:05d}" for i in range(5000))
    base = scan.base(text)
    more = scan.more(text, base)
    assert len(base) == 5000 and len(more) == 5000
    assert not any(a < e and s < b for (_, a, b, _), (_, s, e, _) in zip(base, more, strict=True))


def test_secret_odd_rows(odd):
    assert secrets.scan(odd).count() == len(odd_rows()) and secrets.scan(odd.limit(0)).count() == 0


# -- shingles
def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                part[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rng, n, words, edits):
    base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 12, 40, 130, 400]))]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    made = [t for _ in range(14) for t in family(rng, rng.choice([2, 5, 40]), words, 4)] + [None, "", "One", "one"]
    rows = list(enumerate(made))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert found == brute_groups(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_a_word_more_links(spark, size, percent):
    made = []
    for n in range(size, size + 30):  # 6 shingles in 7 at 85 %, 4 in 5 at 80 %
        text = " ".join(f"w{n}x{k}" for k in range(n))
        made += [text + " end", "start " + text, text] + ([f"{text} e{k}" for k in range(20)] if n - size + 1 in (4, 6) else [])
    rows = list(enumerate(made))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert found == brute_groups(rows, size, percent)


def test_frequent_keys_alone_find_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", (1,))
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    rows = list(enumerate(t for _ in range(4) for t in family(rng, 30, words, 6)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == brute_groups(rows, 4, 85)


def test_short_ranges_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SURE", -6.0)  # most sets have too few shingles in their range
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    made = []
    for n in (105, 130, 320):
        base = [rng.choice(words) for _ in range(n)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.randint(0, n // 30)):
                w[rng.randrange(n)] = rng.choice(words)
            made.append(" ".join(w))
    rows = list(enumerate(made))
    sizes = jaccard.Sizes(85)
    sets = jaccard.Shingler(4).sets(made)
    assert sum(any(t >= jaccard.WHOLE for t, _, _ in jaccard._entities(s, sizes)) for s in sets) > 20
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == brute_groups(rows, 4, 85)


def test_hot_key_with_many_components(spark):
    """Hundreds of variants share nearly all shingles; most link with none, some in chains that no original holds together."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    made = []
    for k in range(150):  # each far from all others
        w = list(base)
        for at in rng.sample(range(0, 150, 5), 8):
            w[at] = f"x{k}y{at}"
        made.append(w)
        if k % 3 == 0:  # a chain of near ones
            for step in range(3):
                w = list(w)
                w[(step * 7 + 3) % 150] = f"z{k}s{step}"
                made.append(w)
    rows = list(enumerate(map(" ".join, made)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    want = brute_groups(rows, 4, 85)
    assert found == want and len({c for _, c in want.values()}) >= 100


def test_words_are_hashed_by_windows(monkeypatch):
    texts = ["one two three four five", "a" * 3000 + " b c d e f", "é " * 900, ""]
    whole = jaccard.Shingler(4).sets(texts)
    monkeypatch.setattr(jaccard, "WORD_BYTES", 16)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, jaccard.Shingler(4).sets(texts), strict=True))


def test_clashing_columns_of_representatives(spark):
    clash = spark.createDataFrame([(1, "a b c d e f g", 9, 8, 7, "x"), (2, "a b c d e f g", 9, 8, 7, "x")], "doc_id long, text string, id int, times int, row int, `__id` string")
    kept = jaccard.representatives(clash)
    assert kept.columns == clash.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f g", 9, 8, 7, "x")]


def test_groups_odd_rows(odd):
    rows = jaccard.groups(odd).collect()
    assert len(rows) == len(odd_rows())
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert jaccard.groups(odd.limit(0)).count() == 0 and jaccard.representatives(odd.limit(0)).count() == 0


# -- tokens
@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(bpe.vocabulary())


def test_perfect_hash_is_minimal(encoder):
    table = encoder.table
    assert sorted(table.slot_key.tolist()) == list(range(len(encoder.vocab)))
    assert table.find([encoder.vocab[7], b"surely not a token of it"]) == [7, -1]


def test_ids_equal_the_library(encoder, texts):
    import public_tokenizers
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.vocab)}, special_tokens={})
    rng = random.Random(8)
    made = ["".join(rng.choice("aeioutnhrs éß\n\t  😀019,.!'<|ſKⅣ½　") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    made += ["", "<|endoftext|>", "a" * 5000, *[t or "" for t in texts.values()]]
    found = encoder.encode_many(made)
    assert [ids.tolist() for ids in found] == [lib.encode_ordinary(t) for t in made]
    assert all(encoder.decode(ids).decode() == t for ids, t in zip(found, made, strict=True))


def test_small_memo_and_long_text(encoder, monkeypatch):
    rng = random.Random(4)
    made = ["".join(rng.choice("aeiou nhrs") for _ in range(4000)) for _ in range(4)]
    want = [ids.tolist() for ids in bpe.Bpe(encoder.vocab, table=encoder.table).encode_many(made)]
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1000)  # longer texts are split as they are read
    assert [ids.tolist() for ids in bpe.Bpe(encoder.vocab, table=encoder.table).encode_many(made)] == want


def test_token_frames(odd):
    vocab = bpe.vocabulary()
    ids = bpe.encode(odd, vocab)
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode(ids, vocab).collect()}
    assert all(raw[i] == (t or "").encode() for i, t, *_ in odd_rows())
    rows = {r.doc_id: r for r in bpe.round_trip(odd, vocab).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[4].decoded_sha256 == hashlib.sha256(("x" * 200_000 + " end").encode()).hexdigest()
    assert bpe.encode(odd.limit(0), vocab).count() == 0


# -- licences
def test_licenses_equal_sql(same_rows):
    same_rows(licenses.query, licenses.ORACLES["op9_license_scan"])


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice shall be included in all
copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""


def test_license_rules(spark, odd):
    texts = [
        (MIT, "MIT"), ("x\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("CC BY-SA 4.0 and Released under the MIT License.", "MIT,CC-BY-SA"), ("Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice; Redistributions in binary form must reproduce the above copyright notice.", "BSD-2-Clause"), ("a licence to kill", ""), (None, ""),
    ]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in rows} == {i: want for i, (_, want) in enumerate(texts)}
    assert licenses.scan(odd).count() == len(odd_rows()) and licenses.scan(odd.limit(0)).count() == 0


NOTICES = {
    "Released under GPL v3.": "GPL-3.0", "Distributed under GPLv2 or later.": "GPL-2.0", "Distributed as CC0.": "CC0-1.0", "CC BY 4.0": "CC-BY", "Code is LGPL.": "LGPL", "This is AGPL software.": "AGPL-3.0", "MPL 2.0": "MPL-2.0",
    "CC BY-NC-ND 4.0": "CC-BY-NC-ND", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "CC-BY-NC-SA", "Creative Commons Attribution 4.0": "CC-BY", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This program is made available under the terms of the Eclipse Public License 2.0": "EPL-2.0", "Licensed under the EUPL, Version 1.2 or later": "EUPL", "You may use it under the Artistic License 2.0.": "Artistic-2.0", "zlib License": "Zlib",
    "// SPDX-License-Identifier: MIT\nint main() {}": "MIT", "# SPDX-License-Identifier: Apache-2.0\nimport os": "Apache-2.0", "/* SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) */": "GPL-2.0,BSD-3-Clause", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: Made-Up-9": "",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "GPL-3.0",
    """This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.""": "GPL-2.0",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""": "LGPL-2.1",
    """Copyright 2019 Foo
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES.
See the License for the specific language governing permissions and limitations under the License.""": "Apache-2.0",
    """Copyright (c) 1998, Regents. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""": "BSD-3-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file": "MPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "The origin of this software must not be misrepresented; you must not claim that you wrote it. Altered source versions must be plainly marked as such.": "Zlib",
    "Copyright © 2020 Foo. All rights reserved.": "", "Unauthorized copying of this file, via any medium is strictly prohibited": "Proprietary", "Use it mit Lizenz. He gave permission.": "", "You can use the Artistic License or GPL.": "GPL,Artistic",
    "This is free and unencumbered software released into the public domain.": "Unlicense", "We had an option, for example, to endorse success by others": "",
}


def test_notices(spark):
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(t, t) for t in NOTICES], "doc_id string, text string")).collect()}
    assert found == NOTICES


def test_identifiers_stand_in_text_order(spark):
    text = "CC BY-SA 4.0 or the MIT License, like the Apache License 2.0. GPL v3; and the MIT license."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.sequence == "<cc_by_sa><mit_ref><apache2_ref><gpl3_ref><mit_ref>" and row.licenses == "Apache-2.0,GPL-3.0,MIT,CC-BY-SA" and row.n_matches == 5 and row.leftover == ""


def test_every_branch_holds_an_anchor():
    def branches(p):
        out, depth = [""], 0
        for c in p:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append("")
            else:
                out[-1] += c
        return out

    for name, p in licenses.SENTENCES:
        for branch in branches(p):
            parts = branches(branch[branch.index("(?:") + 3 : branch.index(")")]) if branch.startswith(r"\b(?:") else [branch]
            rest = branch[branch.index(")") :] if branch.startswith(r"\b(?:") else ""
            assert all(any(a in x + rest for a in licenses.ANCHORS) or any(re.search(rf"(?:\\b|^){a}(?![a-z])", x) for a in licenses.SHORT) for x in parts), (name, branch)


# -- pages
PAGE = """<html><head><title>No</title></head><body><header><h1>Site</h1><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav></header>
<div id="cookie-notice">We use cookies</div><main><h1>Title &amp; more</h1><p class="byline">By X</p><p>Short.</p><p>Long <a href=z>link</a> &nbsp; text<br>two
<p>open<ul><li>one<li>two</ul><aside>Related: <a href=1>thing</a></aside><form><label>Name</label></form><section class="comments"><h2>Comments</h2><p>I say many words here.</p></section><p>End.</p></main>
<div class="sidebar"><p>side</p></div><script>if (a<b) "</p>"</script><!-- <p>no</p> --><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    tree = html_extract.train()
    assert all(html_extract.keep(tree, r[:-1]) == r[-1] for r in html_extract.LABELLED)
    assert html_extract.main_text(PAGE, tree) == "Title & more\nBy X\nShort.\nLong link text two\nopen\none\ntwo\nEnd."
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>" + "word " * 50_000), (3, "u", "<p"), (None, "u", "<article>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.extract(odd).collect()
    assert len(rows) == 5 and sorted(len(r.text) for r in rows) == [0, 0, 0, 1, 249_999]
    assert html_extract.extract(odd.limit(0)).count() == 0


PROSE = "A lone paragraph of plain prose that holds twelve words in all."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>No</title><meta charset=utf-8><body><article><h1>T</h1><p>One.</p></article>", "T\nOne."),
        ("<title>No</title><link rel=x><p>" + PROSE + "</p>", PROSE),
        ("<head><style>p{}</style>" + PROSE, PROSE),
        ('<article class="post type-post comments-open"><h1>T</h1><p>One.</p></article>', "T\nOne."),
        (f'<div class="content has-sidebar"><h1>T</h1><p>{PROSE}</p></div>', "T\n" + PROSE),
        ('<article><header class="article-header"><h1>T</h1><p class="byline">By X</p></header><p>One.</p><p class=tags>Tags: a, b</p></article>', "T\nBy X\nOne.\nTags: a, b"),
        ("<article><p title=it's>One.</p><p title='a > b'>Two.</p><p title=\"it's\">Three.</p></article>", "One.\nTwo.\nThree."),
        ("<article><p>We have <math><mi>x</mi></math> here.</p></article>", "We have x here."),
        (f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><p>{PROSE}</p></div><footer>End</footer>", PROSE),
        (f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><div>Our motto</div><div><a href=c>More</a></div><h1>T</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>", f"T\n{PROSE}\nShort one.\n{PROSE}"),
        ('<main><p>One.</p><div class="comments-area"><h2>2 comments</h2><p>First!</p></div><div class="ad-slot">Buy</div><div id="cookieBanner">We use</div><p>Two.</p></main>', "One.\nTwo."),
        ('<article><p class="ad"><b>Buy this<p>One.<ul><li class="promo">Buy that<li>two</ul></article>', "One.\ntwo"),
        ("<article><h1><a href=x>Title in a link</a></h1><p><a href=y>Source</a></p></article>", "Title in a link\nSource"),
        (f'<div class="site-header">Site</div><div id="main"><p>{PROSE}</p></div><div class="sidebar-left">side</div>', PROSE),
        ("<article>a &lt; b &amp; c&nbsp;d <b>e</b>f<!-- no --><script>x</script></article><p", "a < b & c d ef"),
    ],
)
def test_page_cases(page, want):
    assert html_extract.main_text(page, html_extract.train()) == want


def test_tree_uses_neighbours():
    used = collections.Counter()

    def walk(tree):
        if len(tree) > 1:
            used[tree[0]] += 1
            walk(tree[2])
            walk(tree[3])

    walk(html_extract.train())
    assert sum(used[f] for f in (5, 6, 7, 8)) >= 4


def test_articles_of_the_table(spark):
    import html

    pages = {r.page_id: r.html for r in common.table(spark, SF, "pages").collect()}
    for r in html_extract.query(spark, SF).collect():
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


# -- components
def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    part = {}

    def top(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        part[y] = x
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in part}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
