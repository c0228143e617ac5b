"""Quality rules whose cutoffs are chosen under a bound on the share of good documents they reject.

Each rule compares a ratio of a document with a cutoff. For every stratum and rule the cutoffs are tested from the most
lenient to the strictest on labelled good documents: a cutoff passes if the exact binomial probability of seeing so few
rejections, were the true rate at the rule's limit, is at most the level. Testing stops at the first failure (a fixed
sequence needs no correction of its own); the level is divided by the number of strata and rules, the limit among the
rules. So with probability 1 - DELTA no stratum loses more than ALPHA of its good documents to the rules. A rule that
cannot be shown to be safe, as on few labels, stays off in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ramplake.llm.common import by_batch, cut_lineage, slices

ALPHA, DELTA = 0.02, 0.05
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: For each rule: numerator, denominator, cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols", "word_chars", tuple(0.4 * 0.75**k for k in range(20))),
    "dup_lines": ("n_dup_lines", "n_lines", tuple(0.8 - 0.04 * k for k in range(20))),
    "repeats": ("n_repeat_words", "n_words", tuple(0.5 - 0.025 * k for k in range(20))),
    "upper": ("n_upper", "word_chars", tuple(0.9 - 0.045 * k for k in range(20))),
    "marks": ("n_marks", "n_words", tuple(2.0 * 0.75**k for k in range(20))),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, size = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three ids don't fit into 63 bits: number the pairs
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The values of STATS; words are split at the six ASCII spaces."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0,) * len(STATS)
    separators = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (
        len(words), len(text) - separators, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!"))


def document_stats(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Columns doc_id, stratum and STATS for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                columns = zip(*map(text_stats, texts))
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "stratum", *STATS])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias(text))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(rule: str) -> Column:
    """A rule's ratio; without a denominator it is 0."""
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def few_rejections(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X binomial with n trials at `rate`."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=float)
    steps = np.log(n - i[:-1]) - np.log(i[:-1] + 1) + math.log(rate) - math.log1p(-rate)
    logs = n * math.log1p(-rate) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def strictest(counts: list[int], cutoffs: tuple[float, ...], limit: float, level: float) -> float | None:
    """counts[j]: good documents whose ratio exceeds j of the cutoffs (which fall) and no more."""
    n, best = int(sum(counts)), None
    for j, cutoff in enumerate(cutoffs):
        rejected = int(sum(counts[len(cutoffs) - j :]))
        if n == 0 or few_rejections(rejected, n, limit) > level:
            break
        best = cutoff
    return best


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good, once each; ids with labels that disagree are left out."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low")).filter("low = 1").select("doc_id")


def safe_cutoffs(stats: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs by stratum: columns stratum and one for each rule, null where the rule is off."""
    good = stats.filter(~base_failed()).join(good_documents(labels), "doc_id", "left_semi")
    # cutoffs fall, so a ratio exceeds the last ones: the level counts them
    over = [F.struct(F.lit(r).alias("rule"), sum((ratio(r) > c).cast("int") for c in cuts).alias("over")) for r, (_, _, cuts) in RULES.items()]
    seen = good.select("stratum", F.explode(F.array(*over)).alias("o")).select("stratum", "o.rule", "o.over").groupBy("stratum", "rule", "over").count()
    width = max(len(cuts) for _, _, cuts in RULES.values()) + 1
    table = seen.groupBy("stratum", "rule").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("over") == j, F.col("count"))), F.lit(0)) for j in range(width))).alias("counts"))
    level = delta / len(RULES) / max(1, stats.select("stratum").distinct().count())

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        cutoffs = [strictest(c, RULES[r][2], alpha / len(RULES), level) for r, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(cutoffs, pa.float64())], ["stratum", "rule", "cutoff"])

    picked = by_batch(table.select("stratum", "rule", "counts"), chosen, "stratum string, rule string, cutoff double")
    return picked.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES))


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, rejected_by (names of the rules) and kept."""
    cuts = cutoffs.select(F.struct(F.col("stratum").alias("s"), *RULES).alias("cuts"))
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("cuts.s")), "left")
    rejected = F.filter(F.array(*(F.when(ratio(r) > F.col(f"cuts.{r}"), F.lit(r)) for r in RULES)), lambda r: r.isNotNull())
    return joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cuts")


def filter_quality(docs: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Columns doc_id, stratum, STATS, base_failed, rejected_by and kept, a row for each row of `docs`.

    Null and empty texts have no words and fail the base rules. A null language is a stratum of its own. Repeated rows
    get the same verdict; labels of unknown documents and null labels count for nothing; an empty table gives an
    empty one, and without labels only the base rules hold.
    """
    stats = cut_lineage(document_stats(docs))
    return apply_rules(stats, cut_lineage(safe_cutoffs(stats, labels, alpha=alpha, delta=delta)))


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same verdicts in SQL, with the rules and their cutoffs as rows."""
    word = r"[^\x20\x09-\x0D]+"
    ratios = ", ".join(f"('{r}', CASE WHEN {bottom} > 0 THEN {top} / {bottom}::DOUBLE ELSE 0 END)" for r, (top, bottom, _) in RULES.items())
    cuts = ", ".join(f"('{r}', {j}, {c!r}::DOUBLE)" for r, (_, _, all_cuts) in RULES.items() for j, c in enumerate(all_cuts))
    limit = f"{alpha / len(RULES)!r}::DOUBLE"
    return f"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM base),
grams AS (SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base),
counted AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds FROM lines WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
stats AS (
  SELECT b.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    CASE WHEN len(w) > 0 THEN length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) ELSE 0 END::BIGINT AS n_symbols, coalesce(l.n - l.kinds, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN counted l USING (doc_id)),
checked AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
ratios AS (SELECT doc_id, lang, base_failed, v.rule, v.ratio FROM checked, LATERAL (VALUES {ratios}) AS v(rule, ratio)),
cuts AS (SELECT * FROM (VALUES {cuts}) AS v(rule, j, cutoff)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tested AS (
  SELECT lang, rule, j, cutoff, count(*) AS n, count(*) FILTER (WHERE ratio > cutoff) AS k
  FROM ratios JOIN cuts USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
tails AS (
  SELECT *, list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({limit}) + (n - i) * ln(1 - {limit})))) AS tail FROM tested),
safe AS (
  SELECT *, bool_and(tail <= {delta!r}::DOUBLE / {len(RULES)} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM stats))) OVER (PARTITION BY lang, rule ORDER BY j) AS passes FROM tails),
chosen AS (SELECT lang, rule, min(cutoff) AS cutoff FROM safe WHERE passes GROUP BY lang, rule),
rejected AS (SELECT DISTINCT doc_id FROM ratios r JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.lang AND r.rule = c.rule WHERE ratio > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM checked
"""
