"""Very long texts cost in proportion to their length."""

import hashlib
import time

from pyspark.sql import functions as F

from transcurve.llm import licenses, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_many_removed_lines_of_a_text(spark):
    lines = [hashlib.sha256(str(i).encode()).hexdigest()[:30] for i in range(60_000)]  # no two within an edit
    rows = [(1, "\n".join(lines), "en", "a", 1), (2, "\n".join([*lines[::-1], "its own"]), "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    began = time.time()
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.clean(spark.createDataFrame(rows, DOCS)).collect()}
    assert time.time() - began < 120
    assert got == {1: (rows[0][1], 1), 2: ("its own", 7), 3: (None, 0), 4: ("", 0)}


def test_repeated_ids_with_other_texts_lose_their_own_lines(spark):
    rows = [(1, "a line of some length, first\nkept one", "en", "a", 1), (2, "a line of some length, first\nkept two", "en", "a", 1), (2, "kept three\na line of some length, first", "en", "a", 1), (2, "short", "en", "a", 1)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.clean(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, "a line of some length, first\nkept one"), (2, "kept three"), (2, "kept two"), (2, "short")]


def test_a_long_sentence_of_license_words(spark):
    texts = ["gpl " * 100_000, "gpl " * 50 + "version 2 or later", "gplv2 or later", "gpl a b c d e f g h i j k or later"]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    found = df.select("doc_id", F.lower("text").rlike(dict(licenses.SENTENCES)["gpl_later"]).alias("later"))
    began = time.time()
    assert {r.doc_id: r.later for r in found.collect()} == {0: False, 1: True, 2: True, 3: False}
    assert time.time() - began < 20
