"""Repeated runs of lines, found by winnowing and deleted where they occur again.

Every document is the row of hashes of its lines that aren't blank. Each window of WINDOW successive grams (GRAM lines
each) selects its least hash, the last one among equals, as a fingerprint, so two places that share WINDOW + GRAM - 1
lines share a selected fingerprint at the same line. A run of fewer lines that holds more than WORDS words is a gram of
its own in a window of one: it is always selected, so long passages are found however few their lines are, and short
common lines are left. Positions of a fingerprint are joined, and those that occur once are done with. Around the others
matches are extended both ways, as far as that guaranteed length: each run of so many lines that holds the fingerprint is
compared, by a 128-bit digest, with the first place in the corpus that has it. A line goes if a run that it is in occurs
earlier, in the order of document id, text and line. Longer matches are chains of such runs, so they go whole, and no two
places are ever paired: each is compared with the first one only.

Only DataFrame functions are used, and no line of text is shuffled until the deletions meet the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ramplake.llm.common import cut_lineage, identity, whole_row

GRAM, WINDOW = 2, 2
#: Runs of fewer lines than a window spans are found if they hold more words than this.
WORDS = 50
WORD = "[^ \\t-\\r]+"


def counting(count: Column) -> Column:
    """1 to `count`; nothing if that is less than 1."""
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def grams(lines: Column, length: int) -> Column:
    """Hashes of all runs of `length` elements."""
    return F.transform(counting(F.size(lines) - length + 1), lambda i: F.xxhash64(F.slice(lines, i, length)))


def selected(docs: DataFrame, gram: int, window: int, words: int, text: str) -> DataFrame:
    """Fingerprints: columns doc, hash, fresh (whether no window before selects that place) and the run around it
    (a, b: digest; lines: their numbers)."""
    span = gram + window - 1
    split = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.trim(x) != "", F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))))
    rows = docs.select(identity(text).alias("doc"), F.filter(split, lambda x: x.isNotNull()).alias("filled"))
    rows = rows.select("doc", F.col("filled.i").alias("number"), F.col("filled.h").alias("line"), F.col("filled.w").alias("words"))
    rows = rows.withColumn("gram", grams(F.col("line"), gram))

    def least(s: Column) -> Column:
        """The place of the last least gram of the window at s."""
        part = F.slice("gram", s, window)
        return s + window - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    def run(s: Column, length: int, hash: Column | None, fresh: Column) -> Column:
        lines = F.slice("line", s, length)
        a, b = F.xxhash64(lines), F.xxhash64(F.lit(1), lines)
        return F.struct((b if hash is None else hash).alias("hash"), fresh.alias("fresh"), a.alias("a"), b.alias("b"), F.slice("number", s, length).alias("lines"))

    def long_runs(length: int) -> Column:
        held = F.filter(counting(F.size("line") - length + 1), lambda s: F.aggregate(F.slice("words", s, length), F.lit(0), lambda x, y: x + y) > words)
        return F.transform(held, lambda s: run(s, length, None, F.lit(True)))

    windows = counting(F.size("gram") - window + 1)
    runs = [F.transform(windows, lambda s: run(s, span, F.element_at("gram", least(s)), F.when(s > 1, least(s - 1) != least(s)).otherwise(True)))]
    runs += [long_runs(length) for length in range(1, span)]
    return rows.select("doc", F.explode(F.concat(*runs)).alias("run")).select("doc", "run.*")


def repeated_lines(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, words: int = WORDS, text: str = "text") -> DataFrame:
    """Columns doc (identity) and lines, the numbers (from 0) of the lines to delete, for documents that have any."""
    prints = cut_lineage(selected(docs, gram, window, words, text))
    # fingerprints of two places at least
    again = prints.groupBy("hash").agg(F.count_if("fresh").alias("n")).filter("n > 1").select("hash")
    runs = prints.drop("fresh").join(again, "hash", "left_semi")
    place = F.struct("doc", F.col("lines")[0].alias("line"))
    first = runs.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = runs.join(first, ["a", "b"]).filter(place > F.col("first"))
    return later.select("doc", F.explode("lines").alias("line")).groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, words: int = WORDS, text: str = "text") -> DataFrame:
    """Columns row (a struct of all columns of `docs`), n_lines, n_removed and cleaned, a row for each row of `docs`.

    Lines end at a line feed; lines of spaces only are blank, part of no run and always kept. A null text has no lines
    and stays null, an empty one has one blank line. Repeated rows (same id and text) are one document: they don't
    repeat one another and get the same result. Rows without id come before all others. A text without any line left
    that had one is an empty text. An empty table gives an empty one.
    """
    cut = repeated_lines(docs, gram=gram, window=window, words=words, text=text).select("doc", F.col("lines").alias("cut"))
    rows = docs.select(whole_row(docs).alias("row"), identity(text).alias("doc"), F.col(text).alias("text"))
    joined = rows.join(cut, rows["doc"].eqNullSafe(cut["doc"]), "left").select("row", "text", "cut")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("cut"))
    cleaned = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"), cleaned.alias("cleaned"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS words
  FROM lines WHERE trim(line) <> ''),
runs AS (
  SELECT doc_id, p, 3 AS k, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS run, 51 AS words FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL
  SELECT doc_id, p, 2, line || chr(10) || lead(line) OVER d, words + lead(words) OVER d FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL
  SELECT doc_id, p, 1, line, words FROM filled),
ranked AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, p) AS seen FROM runs WHERE run IS NOT NULL AND words > 50),
cut AS (SELECT DISTINCT r.doc_id, f.i FROM ranked r JOIN filled f ON r.doc_id = f.doc_id AND f.p BETWEEN r.p AND r.p + r.k - 1 WHERE seen > 1),
kept AS (
  SELECT l.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS cleaned
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(cleaned, '')) END AS cleaned_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
