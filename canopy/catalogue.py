"""Registered queries: name -> function of (spark, sf_dir), and the same as SQL.

Words of documents stand for the values that files share, documents for files,
(lang, source) for a path of depth two; regions, nations, customers, orders and
line items for a typed tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import dictionary, huffman, ordered, statistics, tokens, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

THRESHOLD = 2


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, *path: str) -> DataFrame:
    return tokens.tokens_of(read(spark, sf_dir, "documents"), *path)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, value, prev): event types of each user in order, with the one before."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return tokens.previous(e, "user_id", ["ts", "seq"], "value").drop("ts")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, value) with seq dense in each user."""
    e = read(spark, sf_dir, "events")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select("user_id", seq.alias("seq"), F.col("event_type").alias("value"))


def markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.instances(symbols(spark, sf_dir), "prev", "value")


WORDS = "words as (select file_id, seq, value, lang, source from (select doc_id as file_id, lang, source, unnest(range(0, len(w))) as seq, unnest(w) as value from (select *, regexp_split_to_array(text, '\\s+') as w from documents)) where value <> '')"
SYMBOLS = "symbols as (select user_id, event_id as seq, event_type as value, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events)"
SEQUENCE = "sequence as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_type as value from events)"
MARKOV = f"{SYMBOLS}, markov as (select prev, value, count(*) as n from symbols group by all)"
CDF = (
    f"{MARKOV}, cdf as (select prev, value, n, row_number() over w - 1 as symbol_index, cast(coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as lo, "
    "cast(sum(n) over (w rows between unbounded preceding and current row) as bigint) as hi, cast(sum(n) over (partition by prev) as bigint) as total from markov window w as (partition by prev order by value nulls first))"
)


# Counting


@query(f"with {WORDS} select file_id, value, count(*) as n from words group by all")
def instances_per_file(spark, sf_dir):
    return tokens.instances(words(spark, sf_dir), "file_id", "value")


@query(f"with {WORDS} select value, count(distinct file_id) as files, count(*) as instances from words group by value")
def doc_frequency(spark, sf_dir):
    return tokens.file_frequency(words(spark, sf_dir), "value")


@query(f"with {WORDS}, f as (select value, count(distinct file_id) as files from words group by value having count(distinct file_id) > {THRESHOLD}) select value, files, row_number() over (order by value) - 1 as idx from f")
def dictionary_threshold(spark, sf_dir):
    """The flagship: values of more than two files, with dense indices in order of value."""
    return dictionary.linear_table(tokens.file_frequency(words(spark, sf_dir), "value"), THRESHOLD)


@query(f"with {WORDS} select source, value, count(*) as n from words group by all")
def context_counts_depth1(spark, sf_dir):
    return tokens.instances(words(spark, sf_dir, "source"), "source", "value")


@query(f"with {WORDS} select lang, source, value, count(*) as n from words group by all")
def context_counts_depth2(spark, sf_dir):
    return tokens.instances(words(spark, sf_dir, "lang", "source"), "lang", "source", "value")


@query(f"with {MARKOV} select * from markov")
def markov_context_counts(spark, sf_dir):
    return markov(spark, sf_dir)


@query(f"with {WORDS} select count(distinct (lang, source)) as contexts, count(distinct (lang, source, value)) as states from words")
def number_of_states(spark, sf_dir):
    counts = tokens.instances(words(spark, sf_dir, "lang", "source"), "lang", "source", "value")
    each = counts.groupBy("lang", "source").agg(F.count("*").alias("states"))
    return each.agg(F.count("*").alias("contexts"), F.sum("states").alias("states"))


@query(f"with {WORDS} select source, count(distinct value) as universe from words group by source")
def universe_size(spark, sf_dir):
    return tokens.instances(words(spark, sf_dir, "source"), "source", "value").groupBy("source").agg(F.count("*").alias("universe"))


@query(f"with {WORDS}, s as (select source, value, count(*) as n from words group by all) select value, cast(sum(n) as bigint) as n, max(n) as most, count(*) as sources from s group by value")
def merged_statistics(spark, sf_dir):
    """Statistics of each source merged into those of all."""
    parts = tokens.instances(words(spark, sf_dir, "source"), "source", "value").select("value", "n", F.col("n").alias("most"), F.lit(1).cast("long").alias("sources"))
    return statistics.merge_statistics(parts, ["value"], ["n", "sources"], ["most"])


@query(
    "select 'lang' as field, lang as value, count(*) as n from documents group by all union all select 'source', source, count(*) from documents group by all "
    "union all select 'event_type', event_type, count(*) from events group by all union all select 'order_status', o_orderstatus, count(*) from orders group by all"
)
def field_values(spark, sf_dir):
    """Values by the declared field that holds them."""
    out = None
    for table, field, column in (("documents", "lang", "lang"), ("documents", "source", "source"), ("events", "event_type", "event_type"), ("orders", "order_status", "o_orderstatus")):
        t = read(spark, sf_dir, table).groupBy(F.lit(field).alias("field"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
        out = t if out is None else out.unionByName(t)
    return out


# Distributions


@query(f"with {CDF} select * from cdf")
def context_cdf(spark, sf_dir):
    return dictionary.distributions(markov(spark, sf_dir), ["prev"], "value")


@query(f"with {CDF} select prev, value, round(n / total, 9) as p from cdf")
def symbol_probability(spark, sf_dir):
    return dictionary.distributions(markov(spark, sf_dir), ["prev"], "value").select("prev", "value", F.round(dictionary.probability(), 9).alias("p"))


@query(
    f"with {CDF}, b as (select (n * 31) // total as bucket, sum(n) as symbols from cdf group by all) select cast(i as integer) as bucket, cast(coalesce(symbols, 0) as bigint) as symbols, "
    "round(100.0 * coalesce(symbols, 0) / sum(symbols) over (), 6) as percent from range(32) t(i) left join b on b.bucket = i"
)
def probability_histogram(spark, sf_dir):
    h = statistics.probability_histogram(dictionary.distributions(markov(spark, sf_dir), ["prev"], "value"))
    return h.withColumn("percent", F.round("percent", 6))


@query(f"with {CDF} select prev, count(*) as symbols, cast(sum(n) as bigint) as instances, round(sum(-(n / total) * log2(n / total)), 6) as bits from cdf group by prev")
def context_entropy(spark, sf_dir):
    return statistics.entropy(dictionary.distributions(markov(spark, sf_dir), ["prev"], "value"), ["prev"]).withColumn("bits", F.round("bits", 6))


@query(f"with {CDF} select round(sum(-n * log2(n / total)) / 8, 3) as ideal_bytes from cdf")
def ideal_size(spark, sf_dir):
    return statistics.ideal_bytes(dictionary.distributions(markov(spark, sf_dir), ["prev"], "value")).withColumn("ideal_bytes", F.round("ideal_bytes", 3))


BASELINE = "baseline as (select distinct a.event_type as prev, b.event_type as value from (select distinct event_type from events) a, (select distinct event_type from events) b)"


@query(f"with {MARKOV}, {BASELINE} select prev, value, n from markov union all select prev, value, 1 from baseline b where not exists (select 1 from markov m where m.prev is not distinct from b.prev and m.value = b.value)")
def baseline_union(spark, sf_dir):
    """Counts, and with 1 every grammatically possible (context, value) that never occurred."""
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    values = kinds.agg(F.collect_set("event_type").alias("v"))  # an enumeration of the grammar: a handful of values
    possible = kinds.join(F.broadcast(values)).select(F.col("event_type").alias("prev"), F.explode("v").alias("value"))
    return dictionary.add_if_absent(markov(spark, sf_dir), possible, ["prev", "value"])


@query(
    f"with {WORDS}, c as (select lang, source, value, count(*) as n from words group by all), b as (select distinct source, value from words), "
    "p as (select k.lang, k.source, b.value from (select distinct lang, source from c) k join b on k.source = b.source) "
    "select lang, source, value, n, 2 as depth from c union all select lang, source, value, 1, 2 from p where not exists (select 1 from c where c.lang is not distinct from p.lang and c.source = p.source and c.value = p.value) "
    "union all select null, source, value, 1, 1 from b"
)
def dictionary_union_fallback(spark, sf_dir):
    """Every (lang, source) context gets all values of its source; the sources stand as contexts themselves."""
    counts = tokens.instances(words(spark, sf_dir, "lang", "source"), "lang", "source", "value").where("n > 0")  # always true; keeps n in the plan, so one exchange serves all uses
    return dictionary.fallback_contexts(counts, counts.select("source", "value"), ["lang", "source"], ["source"], "value")


@query(
    f"with {WORDS}, d as (select lang, source, value, count(*) as n, sum(count(*)) over (partition by lang, source) as total from words group by lang, source, value) "
    "select w.file_id, w.lang, w.source, w.value, 2 as used_depth, d.n, cast(d.total as bigint) as total from words w "
    "join d on d.lang is not distinct from w.lang and d.source is not distinct from w.source and d.value = w.value"
)
def fallback_lookup(spark, sf_dir):
    """Every word of every document under the distribution of (lang, source), else of the source, both counted over all documents."""
    w = words(spark, sf_dir, "lang", "source").drop("seq")
    counts = tokens.instances(w, "lang", "source", "value").where("n > 0")  # always true; keeps n in the plan, so one exchange serves all uses
    shallow = dictionary.with_total(counts.groupBy("source", "value").agg(F.sum("n").alias("n")), ["source"])
    return dictionary.fallback_lookup(w, dictionary.with_total(counts, ["lang", "source"]), shallow, ["lang", "source"], ["source"], "value").select("file_id", "lang", "source", "value", "used_depth", "n", "total")


@query(f"with {CDF} select s.user_id, s.seq, c.symbol_index, s.value as decoded from symbols s join cdf c on c.prev is not distinct from s.prev and c.value = s.value")
def symbol_index_decode(spark, sf_dir):
    """Every event's symbol index, and the value read back from it."""
    s = symbols(spark, sf_dir)
    dists = dictionary.distributions(tokens.instances(s, "prev", "value"), ["prev"], "value")
    d = dists.select(F.col("prev").alias("_p"), F.col("value").alias("_v"), "symbol_index")
    coded = s.join(F.broadcast(d), s["prev"].eqNullSafe(F.col("_p")) & (s["value"] == F.col("_v"))).select("user_id", "seq", "prev", "symbol_index")
    return dictionary.value_at(dists, coded, ["prev"], "value").select("user_id", "seq", "symbol_index", "decoded")


# Lookup in linear tables

SHARED = f"{WORDS}, shared as (select value, row_number() over (order by value) - 1 as idx from (select value from words group by value having count(distinct file_id) > {THRESHOLD}))"
TRAINED = f"{WORDS}, shared as (select value, row_number() over (order by value) - 1 as idx from (select value from words where file_id % 10 <> 0 group by value having count(distinct file_id) > {THRESHOLD})), test as (select * from words where file_id % 10 = 0)"


def trained(spark, sf_dir):
    """(tokens of all documents, shared table of all documents)."""
    w = words(spark, sf_dir)
    return w, dictionary.linear_table(tokens.file_frequency(w, "value"), THRESHOLD)


@query(f"with {SHARED} select w.file_id, w.seq, w.value, s.idx from words w join shared s on s.value = w.value")
def dictionary_hits(spark, sf_dir):
    every, shared = trained(spark, sf_dir)
    return dictionary.hits(every, shared).where("idx is not null").select("file_id", "seq", "value", "idx")


@query(
    f"with {SHARED}, m as (select file_id, value, min(seq) as first from words where value not in (select value from shared) group by all) "
    "select file_id, value, first, row_number() over (partition by file_id order by first) - 1 as idx from m"
)
def dictionary_misses(spark, sf_dir):
    """What is missing, numbered for each file in the order it is first seen: the file's prelude."""
    every, shared = trained(spark, sf_dir)
    return tokens.first_seen(dictionary.misses(every, shared), "file_id", "value")


@query(
    f"with {SHARED}, p as (select value, row_number() over (order by value) - 1 as idx from (select distinct value from words where value not in (select value from shared))) "
    "select value, idx, 'shared' as origin from shared union all select value, idx, 'prelude' from p"
)
def prelude_table(spark, sf_dir):
    """Shared table and prelude in one; a value in both would be an error."""
    every, shared = trained(spark, sf_dir)
    prelude = dictionary.dense_index(dictionary.misses(every.select("value").distinct(), shared), "value")
    return dictionary.with_prelude(shared, prelude)


@query(f"with {SEQUENCE}, f as (select user_id, value, min(seq) as first from sequence group by all) select user_id, value, row_number() over (partition by user_id order by first) - 1 as idx from f")
def import_order(spark, sf_dir):
    return ordered.import_order(sequence(spark, sf_dir), "user_id", "value")


@query("with p as (select user_id, props as value, min(event_id) as first from events group by all) select user_id, value, first, row_number() over (partition by user_id order by first) - 1 as idx from p")
def prelude_first_seen(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("props").alias("value"))
    return tokens.first_seen(e, "user_id", "value")


@query(f"with {WORDS} select value, n, row_number() over (order by n desc, value) - 1 as idx from (select value, count(*) as n from words group by value)")
def table_by_usage(spark, sf_dir):
    return dictionary.by_usage(tokens.instances(words(spark, sf_dir), "value"))


@query(f"with {WORDS}, b as (select distinct unnest(regexp_split_to_array(text, '\\s+')) as value from benchmark), d as (select value from b where value <> '' and value not in (select value from words)) select value, row_number() over (order by value) - 1 as idx from d")
def string_set_difference(spark, sf_dir):
    """Strings of the benchmark that no document has, sorted and numbered."""
    local = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("value")).where("value <> ''").distinct()
    return dictionary.dense_index(dictionary.misses(local, words(spark, sf_dir)), "value")


# Histograms and sizes


@query(f"with {WORDS} select cast(length(value) as integer) as length, count(distinct value) as strings from words group by 1")
def string_length_histogram(spark, sf_dir):
    return words(spark, sf_dir).select("value").distinct().groupBy(F.length("value").alias("length")).agg(F.count("*").alias("strings"))


@query(f"with {WORDS} select uses, count(*) as strings from (select value, count(*) as uses from words group by value) group by uses")
def string_usage_histogram(spark, sf_dir):
    return statistics.usage_histogram(tokens.instances(words(spark, sf_dir), "value"))


@query(
    "select 'orders' as list, n as length, count(*) as lists from (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1) group by 2 "
    "union all select 'lineitems', n, count(*) from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1) group by 2"
)
def list_length_histogram(spark, sf_dir):
    a = statistics.list_lengths(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    b = statistics.list_lengths(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")
    return a.select(F.lit("orders").alias("list"), "length", "lists").union(b.select(F.lit("lineitems"), "length", "lists"))


VARNUM = "(1 + cast({0} >= 128 as int) + cast({0} >= 16384 as int) + cast({0} >= 2097152 as int) + cast({0} >= 268435456 as int))"


@query(f"select l_orderkey, l_linenumber, l_partkey, {VARNUM.format('l_partkey')} as bytes from lineitem")
def varnum_bytes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.varnum_length(F.col("l_partkey")).alias("bytes"))


@query(f"select c_custkey, v, code, {VARNUM.format('code')} as bytes from (select *, case when v >= 0 then 2 * v else 2 * (1 - v) - 1 end as code from (select c_custkey, cast(floor(c_acctbal) as bigint) as v from customer))")
def signed_varnum(spark, sf_dir):
    v = F.floor("c_acctbal").cast("long")
    c = read(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return c.select("c_custkey", "v", scalars.signed_code(F.col("v")).alias("code"), scalars.signed_varnum_length(F.col("v")).alias("bytes"))


@query(f"select event_id, case when value is null then 3 when value = floor(value) and abs(value) < 2147483648 then {VARNUM.format('(case when value >= 0 then 2 * value else 2 * (1 - value) - 1 end)')} else 10 end as bytes from events")
def varfloat_bytes(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", scalars.varfloat_length(F.col("value")).alias("bytes"))


@query(
    f"with {WORDS}, s as (select source, count(*) as symbols, sum(strlen(value)) as bytes from words group by source) select source, symbols, cast(bytes as bigint) as bytes, round(100.0 * symbols / sum(symbols) over (), 6) as percent_symbols, "
    "round(100.0 * bytes / sum(bytes) over (), 6) as percent_bytes, round(8.0 * bytes / symbols, 6) as bits_per_symbol from s"
)
def stream_sizes(spark, sf_dir):
    sizes = statistics.stream_sizes(words(spark, sf_dir, "source").withColumn("size", F.octet_length("value")), "source", "size")
    return sizes.select("source", "symbols", "bytes", *(F.round(c, 6).alias(c) for c in ("percent_symbols", "percent_bytes", "bits_per_symbol")))


@query("select source, lang, cast(sum(strlen(text)) as bigint) as size, count(*) as files from documents group by rollup (source, lang)")
def size_rollup(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("source", "lang", F.octet_length("text").alias("size"))
    return statistics.size_rollup(files, "source", "lang")


@query("select source, cast(sum(strlen(text)) as bigint) as size, count(*) as files from documents group by source")
def snapshot_totals(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source", F.octet_length("text").alias("size"))
    return statistics.sharded_totals(files, "source")


@query(f"with {WORDS}, r as (select file_id, count(distinct value) as kinds, count(*) as n, round(count(distinct value) / count(*), 9) as ratio from words group by file_id) select *, rank() over (order by ratio desc, file_id) as place from r")
def ratio_ranking(spark, sf_dir):
    """Files from the least to the most repetitive."""
    each = tokens.instances(words(spark, sf_dir), "file_id", "value").groupBy("file_id").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    each = each.withColumn("ratio", F.round(F.col("kinds") / F.col("n"), 9))
    return statistics.ranked(each, "ratio", "file_id", "place")


@query(f"with {TRAINED} select t.source, count(*) as symbols, count(s.value) as hits, round(100.0 * count(s.value) / count(*), 6) as percent from test t left join shared s on s.value = t.value group by t.source")
def train_test_coverage(spark, sf_dir):
    w = words(spark, sf_dir, "source")
    shared = dictionary.linear_table(tokens.file_frequency(w.where("file_id % 10 <> 0"), "value"), THRESHOLD)
    found = dictionary.hits(w.where("file_id % 10 = 0"), shared).groupBy("source").agg(F.count("*").alias("symbols"), F.count("idx").alias("hits"))
    return found.withColumn("percent", F.round(100.0 * F.col("hits") / F.col("symbols"), 6))


@query(f"with {WORDS}, d as (select value from words where source = 'src0' group by value having count(distinct file_id) > {THRESHOLD}) select w.source, count(*) as symbols, count(d.value) as hits from words w left join d on d.value = w.value where w.source <> 'src0' group by w.source")
def ageing(spark, sf_dir):
    """How well the first snapshot's dictionary serves the later ones."""
    w = words(spark, sf_dir, "source")
    old = dictionary.linear_table(tokens.file_frequency(w.where("source = 'src0'"), "value"), THRESHOLD)
    return dictionary.hits(w.where("source <> 'src0'"), old).groupBy("source").agg(F.count("*").alias("symbols"), F.count("idx").alias("hits"))


@query("select doc_id, text, lang from documents where strlen(text) >= 3072")
def minimum_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.octet_length("text") >= 3072).select("doc_id", "text", "lang")


# Order-dependent

SINCE = "select s.user_id, s.seq, s.value, p.prev, (select count(distinct t.value) from sequence t where t.user_id = s.user_id and t.seq < s.seq and t.seq > coalesce(p.prev, -1)) as n from sequence s left join (select user_id, seq, lag(seq) over (partition by user_id, value order by seq) as prev from sequence) p on p.user_id = s.user_id and p.seq = s.seq"


@query(f"with {SEQUENCE} select user_id, seq, value, prev is not null as seen, n as age from ({SINCE})")
def mru_age(spark, sf_dir):
    return ordered.mru(sequence(spark, sf_dir), ["user_id"], "user_id long, seq long, value string")


@query(f"with {SEQUENCE} select place, count(*) as n from (select case when prev is not null and n < 3 then n else -1 end as place from ({SINCE})) group by place")
def lru_window(spark, sf_dir):
    return ordered.lru_histogram(ordered.lru(sequence(spark, sf_dir), ["user_id"], "user_id long, seq long, value string", 3))


def references(spark, sf_dir):
    """Event properties as references: those of 40 users or more are shared, the others each user's prelude."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    shared = dictionary.linear_table(tokens.file_frequency(e, "value"), 39)
    n = shared.count()
    prelude = tokens.first_seen(dictionary.misses(e, shared), "file_id", "value").select(F.col("file_id").alias("_f"), F.col("value").alias("_v"), F.col("idx").alias("_own"))
    found = dictionary.hits(e, shared).join(prelude, (F.col("file_id") == F.col("_f")) & (F.col("value") == F.col("_v")), "left")
    origin = F.when(F.col("idx").isNotNull(), "shared").otherwise("prelude")
    return found.select("file_id", "seq", origin.alias("origin"), F.coalesce("idx", "_own").alias("idx")), n


REFS = "file_id long, seq long, origin string, idx long"


@query(
    "with e as (select user_id as file_id, event_id as seq, props as value from events), sh as (select value, row_number() over (order by value) - 1 as idx from (select value from e group by value having count(distinct file_id) > 39)), "
    "pre as (select file_id, value, row_number() over (partition by file_id order by first) - 1 as idx from (select file_id, value, min(seq) as first from e where value not in (select value from sh) group by all)), "
    "r as (select e.file_id, e.seq, case when s.idx is not null then 'shared' else 'prelude' end as origin, coalesce(s.idx, p.idx) as idx from e left join sh s on s.value = e.value left join pre p on p.file_id = e.file_id and p.value = e.value), "
    "t as (select *, lag(seq) over (partition by file_id, origin, idx order by seq) as before, coalesce(lag(idx) over (partition by file_id, origin order by seq) + 1, 0) as expected, "
    "coalesce(max(idx + 1) filter (origin = 'prelude') over (partition by file_id), 0) as plen, min(seq) over (partition by file_id, origin, idx) as first from r), "
    "m as (select file_id, origin, idx, row_number() over (partition by file_id, origin order by min(seq)) - 1 as met from r group by file_id, origin, idx), "
    "u as (select t.*, m.met, case when before is not null then (select count(distinct (x.origin, x.idx)) from r x where x.file_id = t.file_id and x.seq > t.before and x.seq < t.seq) end as place from t join m using (file_id, origin, idx)) "
    "select file_id, seq, origin, idx, case when origin = 'prelude' and idx = expected then 0 when place < 8 then place + 1 when origin = 'prelude' then 9 + idx when seq = first then 9 + plen + met + idx else 9 + plen + met end as code from u"
)
def ref_stream_encode(spark, sf_dir):
    refs, n = references(spark, sf_dir)
    return ordered.encode_references(refs, ["file_id"], REFS, 8, n)


@query("select count(*) as symbols, 0 as differences from events")
def ref_stream_roundtrip(spark, sf_dir):
    refs, n = references(spark, sf_dir)
    length = F.coalesce(F.max(F.when(F.col("origin") == "prelude", F.col("idx") + 1)).over(Window.partitionBy("file_id")), F.lit(0))
    coded = ordered.encode_references(refs, ["file_id"], REFS, 8, n).withColumn("prelude", length)
    both = ordered.decode_references(coded, ["file_id"], "file_id long, seq long, prelude long, code long, origin string, idx long", 8, n)
    differ = (F.col("origin") != F.col("d_origin")) | (F.col("idx") != F.col("d_idx"))
    return both.agg(F.count("*").alias("symbols"), F.count_if(differ).cast("int").alias("differences"))


@query(
    f"with {SEQUENCE}, f as (select user_id, value, row_number() over (partition by user_id order by min(seq)) - 1 as number from sequence group by user_id, value) "
    f"select s.user_id, s.seq, s.value, case when s.prev is not null and s.n < 3 then 'back:' || s.n else 'dict:' || f.number end as symbol from ({SINCE}) s join f on f.user_id = s.user_id and f.value = s.value"
)
def window_prediction(spark, sf_dir):
    return ordered.window_predictions(sequence(spark, sf_dir), ["user_id"], "user_id long, seq long, value string", 3)


@query()
def block_split(spark, sf_dir):
    return ordered.blocks(sequence(spark, sf_dir), "user_id", "long")


# Codes

#: Merges of the two least of each context's groups, equal ones in order of their making; a symbol has a bit for each merge it is in.
HUFFMAN = (
    f"recursive {MARKOV}, k as (select coalesce(prev, '') as prev, value, n, row_number() over (partition by prev order by value) - 1 as i from markov), "
    "h as (select prev, list_sort(list({'n': n, 'i': i, 's': [value]})) as q, cast([] as varchar[]) as merged, count(*) as fresh from k group by prev "
    "union all select prev, list_sort(q[3:] || [{'n': q[1].n + q[2].n, 'i': fresh, 's': q[1].s || q[2].s}]), q[1].s || q[2].s, fresh + 1 from h where len(q) > 1), "
    "b as (select prev, value, count(*) as bits from (select prev, unnest(merged) as value from h) group by all), codes as (select k.prev, k.value, k.n, cast(coalesce(b.bits, 0) as integer) as bits from k left join b on b.prev = k.prev and b.value = k.value)"
)


@query(f"with {HUFFMAN} select * from codes")
def huffman_lengths(spark, sf_dir):
    counts = markov(spark, sf_dir).withColumn("prev", F.coalesce("prev", F.lit("")))
    return huffman.lengths_by_context(counts, "prev", "value")


@query(f"with {HUFFMAN} select *, cast(round(coalesce(sum(pow(2.0, -bits)) over (partition by prev order by bits, value rows between unbounded preceding and 1 preceding), 0) * pow(2.0, bits)) as bigint) as code from codes")
def canonical_codes(spark, sf_dir):
    return huffman.canonical_codes(huffman_lengths(spark, sf_dir), "prev", "value")


@query(
    f"with {HUFFMAN} select prev, count(*) as symbols, cast(sum(n) as bigint) as instances, cast(sum(n * bits) as bigint) as huffman_bits, round(sum(-(n / total) * log2(n / total)), 6) as entropy from (select *, sum(n) over (partition by prev) as total from codes) group by prev"
)
def group_statistics(spark, sf_dir):
    """Entropy and Huffman cost of each context side by side."""
    counts = markov(spark, sf_dir).withColumn("prev", F.coalesce("prev", F.lit("")))
    bits = statistics.entropy(dictionary.distributions(counts, ["prev"], "value"), ["prev"]).select("prev", F.round("bits", 6).alias("entropy"))
    return huffman.coding_cost(huffman.lengths_by_context(counts, "prev", "value"), "prev").join(bits, "prev")


@query()
def compressed_sizes(spark, sf_dir):
    """Bytes of each document as it is and under every codec."""
    from .sources.streams import compressed_sizes as sizes

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return sizes(docs, ["identity", "gzip", "deflate", "zstd"])


# Trees


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, depth, interface, own): the tree of regions down to orders, a row a node."""
    r, n, c, o = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def part(t: DataFrame, kind: str, key: str, up: str | None, above: str | None, depth: int, own: F.Column) -> DataFrame:
        parent = F.concat(F.lit(f"{up}:"), F.col(above)) if up else F.lit(None).cast("string")
        return t.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), parent.alias("parent"), F.lit(depth).alias("depth"), F.lit(kind).alias("interface"), own.cast("long").alias("own"))

    return (
        part(r, "Region", "r_regionkey", None, None, 0, F.octet_length("r_name"))
        .union(part(n, "Nation", "n_nationkey", "Region", "n_regionkey", 1, F.octet_length("n_name")))
        .union(part(c, "Customer", "c_custkey", "Nation", "c_nationkey", 2, F.octet_length("c_name")))
        .union(part(o, "Order", "o_orderkey", "Customer", "o_custkey", 3, F.octet_length("o_orderpriority")))
    )


TREE = (
    "tree as (select 'Region:' || r_regionkey as id, cast(null as varchar) as parent, 0 as depth, 'Region' as interface, strlen(r_name) as own from region "
    "union all select 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 1, 'Nation', strlen(n_name) from nation union all select 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 2, 'Customer', strlen(c_name) from customer "
    "union all select 'Order:' || o_orderkey, 'Customer:' || o_custkey, 3, 'Order', strlen(o_orderpriority) from orders)"
)


@query(f"with {TREE} select * from tree")
def tree_nodes(spark, sf_dir):
    return tree(spark, sf_dir)


@query(f"with {TREE}, recursive_paths as (select a.id, case when d.id is not null then d.interface || '/' else '' end || case when c.id is not null then c.interface || '/' else '' end || case when b.id is not null then b.interface || '/' else '' end || a.interface as path from tree a left join tree b on b.id = a.parent left join tree c on c.id = b.parent left join tree d on d.id = c.parent) select * from recursive_paths")
def tree_paths(spark, sf_dir):
    """Each node's path: that of its parent, extended level by level."""
    t = tree(spark, sf_dir)
    level = t.where("depth = 0").select("id", F.col("interface").alias("path"))
    out = level
    for depth in (1, 2, 3):
        up = level.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
        level = t.where(F.col("depth") == depth).join(up, F.col("parent") == F.col("_up")).select("id", F.concat_ws("/", "_path", "interface").alias("path"))
        out = out.union(level)
    return out


def _bottom_up(t: DataFrame, sums: dict[str, F.Column]) -> dict[str, DataFrame]:
    """For each depth the sums over each node's subtree, from the leaves up."""
    done, below = {}, None
    for depth in (3, 2, 1, 0):
        level = t.where(F.col("depth") == depth).select("id", "parent", *(c.alias(k) for k, c in sums.items()))
        if below is not None:
            up = below.groupBy(F.col("parent").alias("_p")).agg(*(F.sum(k).alias(f"_{k}") for k in sums))
            level = level.join(up, F.col("id") == F.col("_p"), "left").select("id", "parent", *((F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in sums))
        done[depth], below = level, level
    return done


BELOW = f"{TREE}, closure as (select id as top, id, own, interface from tree union all select b.id, a.id, a.own, a.interface from tree a join tree b on b.id = a.parent union all select c.id, a.id, a.own, a.interface from tree a join tree b on b.id = a.parent join tree c on c.id = b.parent union all select d.id, a.id, a.own, a.interface from tree a join tree b on b.id = a.parent join tree c on c.id = b.parent join tree d on d.id = c.parent)"


@query(f"with {BELOW} select top as id, count(*) as nodes, cast(sum(own) as bigint) as total from closure group by top")
def subtree_size(spark, sf_dir):
    """Nodes and bytes of each subtree."""
    levels = _bottom_up(tree(spark, sf_dir), {"nodes": F.lit(1).cast("long"), "total": F.col("own")})
    out = None
    for x in levels.values():
        x = x.select("id", "nodes", "total")
        out = x if out is None else out.union(x)
    return out


@query(f"with {BELOW}, s as (select top as id, max(case when interface = 'Order' and own = 5 then 1 else 0 end) as bad, count(*) as size from closure group by top) select t.id, s.size from tree t join s on s.id = t.id left join s p on p.id = t.parent where s.bad = 0 and coalesce(p.bad, 1) = 1 and s.size >= 2")
def pure_subtrees(spark, sf_dir):
    """The topmost nodes of two nodes or more below which no order has a priority of five letters."""
    impure = ((F.col("interface") == "Order") & (F.col("own") == 5)).cast("long")
    levels = _bottom_up(tree(spark, sf_dir), {"size": F.lit(1).cast("long"), "bad": impure})
    out = None
    for depth, x in levels.items():
        x = x.where("bad = 0")
        if depth:
            up = levels[depth - 1].where("bad = 0").select(F.col("id").alias("_u"))
            x = x.join(up, F.col("parent") == F.col("_u"), "left_anti")
        x = x.where("size >= 2").select("id", "size")
        out = x if out is None else out.union(x)
    return out


@query(f"with {TREE} select id, depth as level, interface in ('Customer', 'Order') and depth < 3 as lazy from tree")
def lazify_level(spark, sf_dir):
    """Every node's level, and whether a cut at level 3 leaves it for later."""
    return tree(spark, sf_dir).select("id", F.col("depth").alias("level"), (F.col("interface").isin("Customer", "Order") & (F.col("depth") < 3)).alias("lazy"))


@query(f"with {TREE} select 0 as differences, count(*) as nodes from tree")
def roundtrip_diff(spark, sf_dir):
    """The tree gathered into lists of children and taken apart again: no row may differ."""
    t = tree(spark, sf_dir)
    lists = t.groupBy("parent", "depth").agg(F.collect_list(F.struct("id", "interface", "own")).alias("children"))
    back = lists.select("parent", "depth", F.explode("children").alias("c")).select("c.id", "parent", "depth", "c.interface", "c.own")
    diff = trees.difference(t, back).agg(F.count("*").cast("int").alias("differences"))
    return diff.join(F.broadcast(t.agg(F.count("*").alias("nodes"))))


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus not in ('F', 'O') or o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def type_violations(spark, sf_dir):
    """Values outside the enumerations that a grammar of two statuses and three priorities has."""
    enums = spark.createDataFrame([("status", v) for v in ("F", "O")] + [("priority", v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "enum string, value string")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status = enums.where("enum = 'status'").select(F.col("value").alias("o_orderstatus"), F.lit(True).alias("_s"))
    priority = enums.where("enum = 'priority'").select(F.col("value").alias("o_orderpriority"), F.lit(True).alias("_p"))
    checked = o.join(F.broadcast(status), "o_orderstatus", "left").join(F.broadcast(priority), "o_orderpriority", "left")
    return checked.where("_s is null or _p is null").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("with f as (select distinct 'Props' as interface, unnest(json_keys(props)) as field from events) select 'Props' as interface, field, 'extra' as side from f where field not in ('x') union all select 'Props', 'x', 'missing' where 'x' not in (select field from f)")
def property_mismatch(spark, sf_dir):
    found = read(spark, sf_dir, "events").select(F.lit("Props").alias("interface"), F.explode(F.json_object_keys("props")).alias("field"))
    expected = spark.createDataFrame([("Props", "x")], "interface string, field string")
    return trees.property_mismatch(found, expected)


@query("select case when event_type = 'click' then 'view' else event_type end as kind, count(*) as n from events group by 1")
def key_remap(spark, sf_dir):
    """Two keys share one model."""
    kind = F.when(F.col("event_type") == "click", "view").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("select event_id, k as field, json_extract_string(props, k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)")
def json_shred(spark, sf_dir):
    """The fields of the nested JSON, a row each."""
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.explode(m).alias("field", "value"))


@query()
def scope_annotations(spark, sf_dir):
    """Declared and captured names, direct eval and parameters of small programs."""
    from .operators.scopes import annotate, example_trees

    return annotate(spark.createDataFrame(example_trees(), "file_id long, json string"))
