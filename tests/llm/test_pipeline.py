"""The pipeline: each stage against a plain version of itself."""

import collections
import hashlib

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_groups, odd_rows
from transcurve.llm import bpe, common, entry, toxicity


def test_stages(spark, tmp_path):
    docs = common.documents(spark, SF)
    names, seen = docs.columns, {"raw": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "byte_bpe"]

    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, SF).collect()}
    assert {r.doc_id for r in seen["toxicity"]} == {i for i, p in scores.items() if not p}

    first, want = set(), {}
    for r in sorted(seen["toxicity"], key=lambda r: r.doc_id):  # exact repeats go; near ones are tested with the operator
        lines = []
        for line in r.text.split("\n"):
            s = line.strip(" ")
            if len(s) < 24 or s not in first:
                lines.append(line)
            first.add(s)
        want[r.doc_id] = lines
    for r in seen["line_dedup"]:
        kept = collections.Counter(r.text.split("\n"))
        assert not kept - collections.Counter(want[r.doc_id]) and r.n_chars == len(r.text)

    groups = brute_groups([(r.doc_id, r.text) for r in seen["line_dedup"]], 5, 80)
    assert {r.doc_id for r in seen["ngram_jaccard"]} == {i for i, (_, c) in groups.items() if i == c}

    copies = collections.Counter((r.doc_id, r.text) for r in seen["mixing"])
    assert max(copies.values()) <= 3 and set(copies) <= {(r.doc_id, r.text) for r in seen["ngram_jaccard"]}

    texts = {r.doc_id: r.text for r in seen["mixing"]}
    assert len(seen["byte_bpe"]) == len(seen["mixing"])
    encoder = bpe.Bpe(bpe.vocabulary())
    for r in seen["byte_bpe"]:
        assert encoder.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

    whole = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == collections.Counter((r.doc_id, tuple(r.ids)) for r in seen["byte_bpe"])


def test_odd_and_empty_tables(spark, tmp_path):
    rows = odd_rows()
    for name, docs in (("odd", spark.createDataFrame(rows, ODD)), ("empty", spark.createDataFrame([], ODD))):
        names, before = docs.columns, len(rows) if name == "odd" else 0
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            assert stage == corpus_pipeline.STAGES[-1][0] or docs.columns == names
            seen = docs.collect()
            if name == "empty":
                assert not seen
            elif stage == "toxicity":
                assert len(seen) == before  # none is toxic
            elif stage == "line_dedup":  # the second of the equal texts has no line left
                assert sorted((r.doc_id or 0) for r in seen) == [0, 1, 2, 3, 3, 4, 5, 7]
            elif stage == "ngram_jaccard":  # of repeated ids one row stays
                assert sorted((r.doc_id or 0) for r in seen) == [0, 1, 2, 3, 4, 5, 7]
            elif stage == "mixing":  # no document without words is taken, none more than three times
                taken = collections.Counter(r.doc_id for r in seen)
                assert set(taken) <= {None, 3, 4, 5} and max(taken.values(), default=0) <= 3


def test_every_operator_has_a_query():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
