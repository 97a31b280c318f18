"""Risk-controlled quality rules.

Each document gets four measures in thousandths. One fixed path of rules, from
lenient to strict, has a cutoff for every measure at each step; a document is
rejected that is above any of them. For each stratum (language) the path is
tested on the labelled documents: at each step the upper Clopper-Pearson bound on
the share of good documents that the whole rule would reject must not exceed the
risk. Testing stops at the first step that fails (fixed-sequence testing, so the
steps need no further correction), and the confidence is divided over the strata
(Bonferroni). So, with probability 1 - delta over the labelled sample, no
stratum's rule rejects more than `risk` of its good documents. As all measures
are tested at once, the risk is not divided among them, and some 220 good labels
in a stratum are enough (risk 0.02, delta 0.05, four strata, none rejected).
Of the last step that passes, only those cutoffs are used at which the lower bound
on the share of bad documents rejected is above the upper bound for good ones;
leaving others out can only reject less. A stratum with too few labels for such
bounds gets no cutoff, and rejects nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, chunks, mix, rolling, table, tidy, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
NONE = ""  # the stratum of rows without a language

#: measure -> its cutoff at each step of the path, lenient first; a document is rejected above any. A shorter row ends with its last.
MEASURES = {
    "symbols_pm": (800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20),
    "repeats_pm": (290, 280, 270, 260, 250, 240, 220, 200, 180, 160, 140, 120, 100, 80, 60, 40),
    "dup_lines_pm": (400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10),
    "word_chars_pm": (60000, 40000, 30000, 25000, 20000, 18000, 16000, 15000, 14000, 13000, 12000, 11000, 10000),
}


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f / a


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a share, of which `rejected` in n were seen."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        # P(X <= rejected) at share mid
        if 1 - _betainc(rejected + 1, n - rejected, mid) > delta:
            low = mid
        else:
            high = mid
    return high


def _repeats(rows: list[list[bytes]]) -> np.ndarray:
    """Words in windows of 8 words found at least twice in their row, for each row."""
    sizes = np.array([len(w) for w in rows], np.int64)
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    flat = word_hashes([w for row in rows for w in row])
    of = np.repeat(np.arange(len(rows)), sizes)
    out = np.zeros(len(rows), np.int64)
    h = rolling(flat, 8)
    if not len(h):
        return out
    whole = of[: len(h)] == of[7:]
    starts = np.nonzero(whole)[0]
    h = mix(h[starts] + mix(of[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + 8, -1)
    return np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=len(rows))


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def _measure(batches):
    for rows in chunks(batches, lambda r: len(r[1] or "") // 6):
        texts = [r[1] or "" for r in rows]
        words = [words_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.string()),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in texts], pa.int64()),
                pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
                pa.array([_dup_lines(t) for t in texts], pa.int64()),
                pa.array(_repeats(words), pa.int64()),
            ],
            names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def measures(docs: DataFrame) -> DataFrame:
    """The base counts of every document, whole texts; a null text has none of anything.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line) and n_repeat_words (words in 8-word
    windows found twice or more in the text, the first included)."""
    schema = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    counted = docs.select("doc_id", "text", F.coalesce("lang", F.lit(NONE)).alias("lang")).mapInArrow(tidy(_measure), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def in_thousandths() -> dict:
    def pm(a, b):
        return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")

    return {"symbols_pm": pm("n_symbols", "word_chars"), "repeats_pm": pm("n_repeat_words", "n_words"), "dup_lines_pm": pm("n_dup_lines", "n_words"), "word_chars_pm": pm("word_chars", "n_words")}


STEPS = max(map(len, MEASURES.values()))


def cutoffs_at(step: int) -> dict[str, int]:
    return {k: cuts[min(step, len(cuts) - 1)] for k, cuts in MEASURES.items()}


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> dict[str, dict[str, int]]:
    """stratum -> measure -> cutoff, from all labelled documents that the base rules keep.

    A document is good if its quality is 1 (the least of repeated labels). It
    counts once in a stratum, however many rows have its doc_id, each measure at
    its greatest. What reaches the driver is, for each class of each stratum that
    has enough good labels for any bound, a count for each step."""
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~F.col("base_failed")).join(told, "doc_id")
    held = held.select("doc_id", "stratum", (F.col("quality") == 1).alias("good"), *(c.alias(k) for k, c in in_thousandths().items()))
    held = held.groupBy("stratum", "doc_id", "good").agg(*(F.max(k).alias(k) for k in MEASURES))
    joint = [F.count_if(reduce(or_, (F.col(k) > cut for k, cut in cutoffs_at(i).items()))).alias(f"all_{i}") for i in range(STEPS)]
    single = [F.count_if(F.col(k) > cutoffs_at(i)[k]).alias(f"{k}_{i}") for k in MEASURES for i in range(STEPS)]
    counts = held.groupBy("stratum").pivot("good", [True, False]).agg(F.count(F.lit(1)).alias("n"), *joint, *single)
    n_strata = held.select("stratum").distinct().count()
    if not n_strata:
        return {}
    each = delta / n_strata
    enough = math.log(each) / math.log1p(-risk)  # good labels, if none is rejected
    chosen: dict[str, dict[str, int]] = {}
    for r in counts.where(F.col("true_n") >= enough).where("false_n > 0").orderBy("stratum").collect():
        n_good, n_bad = r["true_n"], r["false_n"]
        last = None
        for i in range(STEPS):
            if upper_bound(r[f"true_all_{i}"], n_good, each) > risk:
                break
            last = i
        if last is None:
            continue
        for k, cut in cutoffs_at(last).items():
            # It must pay: of the bad documents it surely rejects a larger share.
            if 1 - upper_bound(n_bad - r[f"false_{k}_{last}"], n_bad, each) > upper_bound(r[f"true_{k}_{last}"], n_good, each):
                chosen.setdefault(r["stratum"], {})[k] = cut
    return chosen


def judge(measured: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """measured with `kept`: false if base_failed or above a cutoff of its stratum."""
    bad = F.col("base_failed")
    of = in_thousandths()
    for stratum, rules in cutoffs.items():
        for k, cut in rules.items():
            bad = bad | ((F.col("stratum") == stratum) & (of[k] > cut))
    return measured.withColumn("kept", ~bad)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Measures and verdict of every row of docs (doc_id, text, lang).

    Null or empty texts have no words and fail the base rules. A null lang is a
    stratum of its own. Repeated rows are judged alike; labels of a null or
    unknown doc_id count for nothing; without labels only the base rules reject.
    A document right at a cutoff is kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.keep("measured", measures(docs))
    return judge(measured, fit_cutoffs(measured, labels, risk, delta))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
