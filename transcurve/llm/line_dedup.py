"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared trimmed; blank ones are left alone. A line goes if a line within its
edit bound stands earlier in the corpus, by doc_id, then line number. The bound follows
the length: under ``EDIT_CHARS`` characters (a parameter) it is 0, only equal lines
count; from there on it is one edit, a character inserted, deleted or replaced.

Equal lines are first reduced to their earliest place. Two lines within one edit agree
outside any one piece that holds the edit, so keys of everything but a half, then of
everything but a piece of ``PIECE`` characters, find without loss the few lines that can
have a partner. For these the neighbourhood is emitted: the piece's deletion variants,
hashed with their surroundings. Lines that share the variant of one place are all within
one edit of each other, and a line equal to a variant is within one edit of its owner, so
the earliest of a key stands for all: no pairs inside a key are formed. What it would
remove is verified by the edit distance of the two pieces.

Null and empty texts have no lines to remove. Rows with a null doc_id neither lose lines
nor remove others'. Rows that repeat a doc_id count as one document: lines at equal
places tie and both stay. Texts and lines of any length are read whole. Extra columns
are passed on by ``clean``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: Characters from which on a line's bound is one edit, and characters of a piece.
EDIT_CHARS, PIECE = 24, 32


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line and its 128-bit hash (h, g) for every line that isn't blank."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    rows = rows.select("doc_id", "no", F.trim("raw").alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("doc_id", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _part(start: Column, size: Column) -> Column:
    return F.substring(F.col("line"), start + 1, size)


def _halves() -> list[Column]:
    """Keys of all but one half, for lines of the same length and for one a character longer."""
    n, out = F.length("line"), []
    for more in (0, 1):  # this line is ``more`` characters longer than the base length
        base = n - more
        mid = F.floor(base / 2).cast("int")
        out.append(F.xxhash64(base, F.lit(0), _part(mid + more, base - mid)))
        out.append(F.xxhash64(base, F.lit(1), _part(F.lit(0), mid)))
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that lines of different hashes share."""
    return common.cut(rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("key").alias("shared")))


def _pieces(lines: DataFrame) -> DataFrame:
    """A row for each piece of a line and each base length: key of all but the piece, the piece, what to match."""
    rows = lines.withColumn("n", F.length("line")).withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("base", F.col("n") - F.col("more"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("base") - 1) / PIECE).cast("int"))))
    start, end = F.col("k") * PIECE, F.least((F.col("k") + 1) * PIECE, F.col("base")) + F.col("more")
    key = F.xxhash64("base", "k", _part(F.lit(0), start), _part(end, F.col("n") - end))
    return rows.select("doc_id", "no", "h", "more", key.alias("key"), _part(start, end - start).alias("piece"))


def _variants(pieces: DataFrame) -> DataFrame:
    """The neighbourhood of each piece in its surroundings: rows (v, own), v the hashed variant.

    A piece of the base length is emitted with each character deleted, at its place, and as
    itself (``own``); a longer one with each character deleted, wherever it stood.
    """
    i = F.posexplode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.length("piece"))))
    rows = pieces.select("*", i.alias("_", "i")).drop("_").where("more = 0 or i > 0")
    without = F.when(F.col("i") == 0, F.col("piece")).otherwise(F.concat(F.substring("piece", F.lit(1), F.col("i") - 1), F.substring("piece", F.col("i") + 1, F.length("piece"))))
    place = F.when((F.col("more") == 0) & (F.col("i") > 0), F.col("i")).otherwise(F.lit(0))
    return rows.select("doc_id", "no", "h", "piece", (F.col("i") == 0).alias("own"), (place == 0).alias("star"), F.xxhash64("key", place, without).alias("v"))


def removed(docs: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """doc_id, no and h of every line that goes."""
    lines = _lines(docs)
    place = F.struct("doc_id", "no")
    k = [f"k{i}" for i in range(4)]
    keyed = lines.select("doc_id", "no", "h", "g", *[F.when(F.length("line") >= edit_chars, c).alias(x) for c, x in zip(_halves(), k, strict=True)])
    first = common.cut(keyed.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times"), *[F.min(x).alias(x) for x in k]))
    many = first.where("times > 1").select(F.col("h").alias("fh"), F.col("g").alias("fg"), "first")
    again = lines.join(many, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg"))).where(place > F.col("first")).select("doc_id", "no", "h")

    # lines that share all but a half with another, then all but a piece
    halves = first.where("k0 is not null").select("h", "g", F.explode(F.array(*k)).alias("key"))
    near = halves.join(_shared(halves), F.col("key") == F.col("shared"), "left_semi").select(F.col("h").alias("nh"), F.col("g").alias("ng")).distinct()
    near = common.cut(first.join(near, (F.col("h") == F.col("nh")) & (F.col("g") == F.col("ng")), "left_semi").select(F.col("first.doc_id").alias("id"), F.struct(F.col("first.no").alias("no"), "h").alias("at")))
    wanted = near.groupBy("id").agg(F.collect_list("at").alias("ats"))  # at most the lines of one document
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = text.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("doc_id", F.split("text", "\n", -1).alias("all"), F.explode("ats").alias("at"))
    held = held.select("doc_id", F.col("at.no").alias("no"), F.col("at.h").alias("h"), F.trim(F.get("all", F.col("at.no"))).alias("line")).where(F.xxhash64("line") == F.col("h"))
    pieces = common.cut(_pieces(held.distinct()))
    pieces = pieces.join(_shared(pieces), F.col("key") == F.col("shared"), "left_semi")

    # the neighbourhood: the earliest of a variant, and the line that equals it
    variants = common.cut(_variants(pieces))
    who = F.struct("doc_id", "no", "h", "piece")
    best = common.cut(
        variants.groupBy("v").agg(F.min(who).alias("least"), F.min(F.when(F.col("own"), who)).alias("equal"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("v").alias("bv"), "least", "equal")
    )
    # deletions of longer lines are within one edit of the line that equals them, not of each other
    partner = F.when(F.col("star") & ~F.col("own"), F.col("equal")).otherwise(F.col("least"))
    found = variants.join(best, F.col("v") == F.col("bv")).withColumn("partner", partner)
    found = found.where((F.col("partner.h") != F.col("h")) & (F.struct("partner.doc_id", "partner.no") < place) & (F.levenshtein("piece", F.col("partner.piece"), 1) >= 0))
    return again.unionByName(found.select("doc_id", "no", "h")).distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines of every document."""
    gone = removed(docs).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("no")).alias("nos"))
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long").alias("n_lines"))
    out = counts.join(gone, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("nos"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("nos", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go, all columns; documents left without any text go too.

    ``n_chars``, where there is such a column, counts the characters that are left. Rows
    whose text was null or empty before stay.
    """
    gone = removed(docs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("no", "h")).alias("gone"))
    # columns of the table travel in a struct of their own: no name clashes; a text travels as its lines, which are looked up by number
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.split("text", "\n", -1).alias("all"), F.col("doc_id").cast("long").alias("doc"))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("doc") == F.col("id"), "left")
    # rows that repeat a doc_id have their own texts: a line goes where its hash says so
    hits = F.filter("gone", lambda g: F.coalesce(F.xxhash64(F.trim(F.get("all", g.no))) == g.h, F.lit(False)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.transform(hits, lambda g: g.no))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull() & F.col("all").isNotNull(), kept))
    rows = rows.withColumn("left", F.when(F.col("kept").isNull(), F.array_join("all", "\n")).otherwise(F.array_join(F.transform("kept", lambda no: F.get("all", no)), "\n")))
    rows = rows.where(F.col("gone").isNull() | (F.trim("left") != ""))
    other = {"text": F.col("left").alias("text")}
    if "n_chars" in docs.columns:
        other["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return rows.select(*[other.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


#: The same definition from single characters: all deletions of every distinct line, without pieces.
ORACLE = f"""
WITH raw AS (
  SELECT DISTINCT doc_id, t.no AS no, trim(t.line, ' ') AS line
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'no': i - 1, 'line': x}})) AS t FROM documents WHERE doc_id IS NOT NULL)),
lines AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
firsts AS (SELECT line, min({{'doc_id': doc_id, 'no': no}}) AS pos FROM lines GROUP BY line),
dels AS (
  SELECT line, pos, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS v
  FROM (SELECT line, pos, unnest(range(1, length(line) + 1)) AS i FROM firsts WHERE length(line) >= {EDIT_CHARS})),
subst AS (SELECT d.line FROM dels d JOIN (SELECT v, i, min(pos) AS m FROM dels GROUP BY v, i HAVING count(*) > 1) g ON d.v = g.v AND d.i = g.i WHERE g.m < d.pos),
own AS (SELECT line, pos, hash(line) AS v FROM firsts WHERE length(line) >= {EDIT_CHARS}),
longer AS (SELECT o.line AS short, o.pos AS short_pos, d.line AS long, d.pos AS long_pos FROM own o JOIN dels d ON o.v = d.v),
gone AS (SELECT line FROM subst UNION SELECT long FROM longer WHERE short_pos < long_pos UNION SELECT short FROM longer WHERE long_pos < short_pos),
cut AS (
  SELECT l.doc_id, l.no FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN gone g ON g.line = l.line
  WHERE {{'doc_id': l.doc_id, 'no': l.no}} > f.pos OR g.line IS NOT NULL),
per AS (SELECT doc_id, count(DISTINCT no) AS n, array_to_string(list_transform(list_sort(list_distinct(list(no))), lambda x: CAST(x AS VARCHAR)), ',') AS nos FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_removed, coalesce(p.nos, '') AS removed
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_line_dedup": query}
ORACLES: dict[str, str] = {"op4_line_dedup": ORACLE}
