"""Benchmark decontamination over a distributed positional inverted index.

1. Test windows: each run of 10 consecutive words of a benchmark item (a shorter
   item is one window). Their terms' frequencies are counted over all documents.
   Windows with a term that no document has are out at once.
2. Index: the postings (term, document, position) of the two rarest terms of each
   window are stored as a table, those of the rarest with the words around them.
3. Intersection: a posting of a window's rarest term says where the window would
   start; it stays only if the list of the second term has the document and that
   start plus the term's offset. For proximity, positions within reach meet.
4. What is left of the intersection, a small part, is compared with the whole
   window by the words kept around the rarest term's posting.

Only DataFrame functions. Documents are never shuffled, only postings and matches
are; the benchmark's side is broadcast if its rows and bytes are few enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import LOWER, UPPER, Scratch, ascii_lower, table

WINDOW = 10
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20  # of test windows or terms; more are joined by shuffling
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def is_small(df: DataFrame) -> bool:
    """Whether a written table may be broadcast: by its rows and by the bytes of all their values."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, phrase, terms, n, items): the distinct windows, numbered, and the sorted ids of the items that have them."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    each = w.select("item", "w", F.explode(at).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(width)).alias("terms"))
    each = each.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return each.select(F.monotonically_increasing_id().alias("window"), F.array_join("terms", " ").alias("phrase"), "terms", F.size("terms").alias("n"), "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, c): how often each of the terms occurs over all documents, if at all.

    Too many terms to broadcast meet the counts, not the words, of the documents,
    so that the commonest word is no one task's work."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if is_small(terms):
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("c"))
    return every.groupBy("term").agg(F.count("*").alias("c")).join(terms, "term")


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, n, terms, phrase, items, first, first_at, second, second_at) of each window all of whose terms occur.

    first and second are its two rarest terms and their offsets; of equally rare
    ones the earlier counts as rarer. A window of one term has no second."""
    each = windows.select("window", "n", F.posexplode("terms").alias("offset", "term")).join(bounded(counts), "term")
    ranked = each.groupBy("window", "n").agg(F.count("*").alias("known"), F.array_sort(F.collect_list(F.struct("c", "offset", "term"))).alias("r")).where("known = n")
    ranked = ranked.select("window", *(F.get("r", F.lit(k))[f].alias(name) for k, kind in ((0, "first"), (1, "second")) for f, name in (("term", kind), ("offset", f"{kind}_at"))))
    return windows.join(ranked, "window")


def lists_of(anchored: DataFrame) -> DataFrame:
    """(term, lead): the terms whose postings are stored; lead: it is some window's rarest."""
    both = anchored.select(F.col("first").alias("term"), F.lit(True).alias("lead")).union(anchored.select("second", F.lit(False)).where("second is not null"))
    return both.groupBy("term").agg(F.max("lead").alias("lead"))


def postings(docs: DataFrame, lists: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """The index: (posting, term, doc_id, text_hash, pos, from, around) for each occurrence of a term of lists.

    around, of lead terms only: the words from position `from`, at most reach before pos, to reach after it."""
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    each = w.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "term")).join(bounded(lists), "term")
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.when(F.col("lead"), F.slice("w", start + 1, F.col("pos") - start + reach + 1))
    return each.select(F.monotonically_increasing_id().alias("posting"), "term", "doc_id", "text_hash", "pos", start.alias("from"), around.alias("around"))


def _leads(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(posting, window, doc_id, text_hash, pos, start, second, second_at): the list of each window's rarest term."""
    own = bounded(anchored.select("window", "first", "first_at", "second", "second_at"))
    found = index.where("around is not null").join(own, index["term"] == own["first"])
    return found.select("posting", "window", "doc_id", "text_hash", "pos", (F.col("pos") - F.col("first_at")).alias("start"), "second", "second_at")


def _seconds(index: DataFrame, *more) -> DataFrame:
    return index.select(F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_hash"), F.col("term").alias("s_term"), F.col("pos").alias("s_pos"), *more)


SAME_TEXT = "doc_id <=> s_doc and text_hash = s_hash and second = s_term"


def intersect(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(posting, window, start): where the lists of a window's two rarest terms agree on its start."""
    leads = _leads(index, anchored).where("start >= 0")
    both = leads.where("second is not null").join(_seconds(index), F.expr(f"{SAME_TEXT} and start + second_at = s_pos"), "left_semi")
    return both.unionByName(leads.where("second is null")).select("posting", "window", "start")


def phrase_matches(index: DataFrame, anchored: DataFrame, agreed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, phrase, start, n, items): all places where a whole window stands, from what `intersect` left."""
    kept = index.where("around is not null").join(agreed, "posting")
    there = F.slice("around", F.col("start") - F.col("from") + 1, F.col("n")) == F.col("terms")
    return kept.join(bounded(anchored), "window").where(there).select("doc_id", "text_hash", "phrase", "start", "n", "items")


def indexed(docs: DataFrame, items: DataFrame, reach: int, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(index, anchored windows), both written."""
    windows = scratch.keep("windows", windows_of(items, width))
    terms = scratch.keep("terms", windows.select(F.explode("terms").alias("term")).distinct())
    counts = scratch.keep("counts", term_counts(docs, terms))
    anchored = scratch.keep("anchored", rarest_terms(windows, counts))
    lists = scratch.keep("lists", lists_of(anchored))
    return scratch.keep("index", postings(docs, lists, reach)), anchored


def proximity_matches(docs: DataFrame, items: DataFrame, reach: int = 2 * WINDOW, width: int = WINDOW) -> DataFrame:
    """(doc_id, phrase, pos): places of a window's rarest term with all its other terms, in any order, within reach words.

    Lists of the two rarest terms meet in stretches of reach positions, so that a
    long text with many of both costs no pairs beyond neighbouring stretches."""
    scratch = Scratch(docs.sparkSession, "proximity")
    index, anchored = indexed(docs, items, reach, width, scratch)
    leads = _leads(index, anchored)
    stretch = F.floor(F.col("pos") / reach)
    near = leads.where("second is not null").withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    near = near.join(_seconds(index, stretch.alias("s_stretch")), F.expr(f"{SAME_TEXT} and stretch = s_stretch and abs(pos - s_pos) between 0 and {reach}"), "left_semi")
    agreed = near.select("posting", "window").unionByName(leads.where("second is null").select("posting", "window")).distinct()
    kept = index.where("around is not null").join(agreed, "posting").join(bounded(anchored), "window")
    return kept.where("size(array_except(terms, around)) = 0").select("doc_id", "phrase", "pos")


def covered(spans: Column) -> Column:
    """Number of positions in the union of sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("till"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["till"]))).alias("n"), F.greatest(a["till"], s["end"]).alias("till"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    docs: doc_id, text; items: item_id, text. Null or empty texts have no words,
    and items without words no window. Repeated documents stay; repeated items
    count once, those with a null id together as the empty string. Without any
    match the digest is that of the empty string. Other columns are ignored.
    Which of a window's equally rare terms leads does not change the result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    index, anchored = indexed(docs, items, width - 1, width, scratch)
    agreed = scratch.keep("agreed", intersect(index, anchored))
    found = phrase_matches(index, anchored, agreed)
    # A row repeated in docs has all its postings again, so matches are made distinct.
    found = found.groupBy("doc_id", "text_hash", "start", "n").agg(F.first("items").alias("items"))
    hits = found.groupBy("doc_id", "text_hash").agg(
        covered(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = scratch.keep("hits", hits).select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP6_SQL = f"""
with d as (select doc_id, {_sql_words("text")} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_sql_words("text")} as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as phrase from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
m as (select g.doc_id, g.i, g.n, win.item from g join win on g.phrase = win.phrase and g.n = win.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""
