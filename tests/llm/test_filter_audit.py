"""The audit against loops over documents, orders and steps."""

import itertools
import re

from transcurve.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, part string, A int"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain(docs, labels):
    def fails(i, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        return out + "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs))

    rows = [(source or "", fails(i, text or ""), any(l[0] == i and l[1] == 1 for l in labels if i is not None), any(l[0] == i and l[2] == 1 for l in labels if i is not None)) for i, text, _, source, *_ in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and any(g in r[1] for g in order[: step - 1]) for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 7, "clash", 8) for d in docs], DOCS).repartition(3)
    got = filter_audit.audit(frame, spark.createDataFrame([(*l, "clash") for l in labels], LABELS)).collect()
    assert len(got) == 600 * len({d[3] or "" for d in docs})
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == plain(docs, labels)


def test_odd_documents(spark):
    many = " ".join(f"word{i}" for i in range(200))
    half = " ".join(["same other"] * 100)
    texts = [None, "", " \t\n ", "word", many, many + " #", many + " x", many.upper(), half, half + " |", f"Ünï {many}", many + " odd space", "a\x0bb\x0cc", "AB", "x" * 300_000 + f" {many}"]
    docs = [(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts * 2, itertools.cycle(["a", "b", None, ""]), strict=False))]
    docs += [(4, many, "en", "a", 1), (4, many, "en", "a", 1), (4, half, "en", "a", 1), (None, many, "en", "a", 1), (None, many, "en", "b", 1), (0, many, "en", "b", 1)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(20)] + [(5, 0, 0), (None, 1, 1), (7, None, None), (999, 1, 1)]
    check(spark, docs, [(i, q, None if t is None else int(t)) for i, q, t in labels])


def test_frequent_copies(spark, monkeypatch):
    from transcurve.llm import common

    monkeypatch.setattr(common, "FREQUENT", 5)
    check(spark, [(i, "the same text" if i % 2 else f"text {i // 4} #", "en", "a", 1) for i in range(40, 0, -1)], [(3, 1, 0), (4, 0, 1)])


def test_no_documents(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_audit_equals_sql(same_rows):
    same_rows(filter_audit.query, filter_audit.ORACLES["op12_filter_audit"])


def test_words_are_counted_without_a_further_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, 1, "p", 1)], DOCS)
    plan = filter_audit.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
