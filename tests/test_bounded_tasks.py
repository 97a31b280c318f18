"""What a task holds of a batch of files: pieces of bounded size, whatever the files become."""

from __future__ import annotations

import json
import random

import pyarrow as pa

from canopy.operators import tokens, trees
from canopy.sources import files as sources
from canopy.sources import formats

TREE = {"type": "A", "s": "é", "list": [{"type": "B", "x": float(i % 3), "y": "b"} for i in range(50)]}


class Files:
    """Stands for a DataFrame: keeps the function that Spark would run in a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        return run

    def mapInPandas(self, run, _schema):
        return lambda batches: run(b.to_pandas() for b in batches)


def batch(values, name="json"):
    kind = pa.binary() if name == "content" else pa.string()
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(values, kind)], names=["file_id", name])


def sizes(run, values, name="json"):
    return [len(b) for b in run(iter([batch(values, name)]))]


MADE = [
    '{"type": "T", "x": [0.0, -0.0, 1.5, NaN, NaN, "1.5", true, null, [], [[]]]}',
    '{"type": "T", "x": [0, {"type": "T", "x": ["a", 1.5]}], "y": ""}',
    "no json",
    None,
    '{"type": "T", "z": {"type": "T", "x": ["a", "a"]}}',
]


def counted(parts):
    value = "coalesce(value_str, cast(value_num as string))"
    out = parts.selectExpr("kind", "path", f"{value} as v", "files", "instances").groupBy("kind", "path", "v").sum("files", "instances")
    return sorted(map(repr, map(tuple, out.collect())))


def test_counts_of_tasks_are_those_of_all_tokens(spark):
    """F1"""
    files = spark.createDataFrame([(i, j) for i, j in enumerate(MADE)] + [(0, MADE[0])], "file_id int, json string").coalesce(1).sortWithinPartitions("file_id")
    for tail in (0, 1, 2):
        t = trees.shred_tokens(files).selectExpr("file_id", "kind", "path", "coalesce(value_str, cast(value_num as string)) as v")
        each = tokens.file_frequency(t.withColumn("path", tokens.path_tail(t["path"], tail)), "kind", "path", "v")
        assert counted(trees.count_tokens(files, tail)) == sorted(map(repr, map(tuple, each.select("kind", "path", "v", "files", "instances").collect())))
    assert {r.kind for r in trees.count_tokens(files, 1, "bool", "float").collect()} == {"bool", "float"}


def test_counts_are_handed_on_in_pieces(spark):
    """files with values of their own, 200,000 in all."""
    texts = [json.dumps({"type": "T", "x": [f"{i}-{k}" for k in range(1000)]}) for i in range(200)]
    got = sizes(trees.count_tokens(Files(), 1), texts)
    assert sum(got) >= 200_000 and max(got) < 2 * trees.HELD


def test_tagged_texts_are_handed_on_in_pieces():
    """tagged texts are many times as long."""
    texts = [json.dumps(TREE)] * 3000
    for to in (("tagged",), ("tagged", "plain")):
        for b in sources.convert(Files(), *to)(iter([batch(texts)])):
            assert b.nbytes < 2 * sources.PIECE


def test_kept_texts_show_what_was_skipped(spark):
    """the round trip is judged in the row; a file that cannot be read counts as different."""
    from canopy.catalogue_trees import differences

    files = spark.createDataFrame([(1, json.dumps(TREE)), (2, "{"), (None, '{"type": "A"}')], "file_id long, json string").selectExpr("*", "json as was").where("was <> '{'")
    back = sources.convert(files, "tagged", "plain", keep="was")
    assert differences(back).first() == (2, 0)
    assert differences(back.selectExpr("file_id", "if(file_id = 1, null, json) as json", "was")).first() == (2, 1)
    bad = sources.convert(spark.createDataFrame([(1, "{", "x")], "file_id long, json string, was string"), "tagged", keep="was")
    assert [tuple(r) for r in bad.collect()] == [(1, None, "x")]


def test_pure_roots_without_joins(spark):
    """against the definition, on random trees; the plan reads the nodes once."""
    rng = random.Random(5)

    def grown(depth):
        return {"type": rng.choice("ABBBB"), "x": [grown(depth - 1) for _ in range(rng.randrange(4))] if depth else []}

    made = [(i, json.dumps(grown(4))) for i in range(40)]
    nodes = trees.shred_nodes(spark.createDataFrame(made, "file_id long, json string"))
    rows = nodes.collect()
    inner = {(r.file_id, r.node_id): [x for x in rows if x.file_id == r.file_id and r.pre <= x.pre <= r.post] for r in rows}
    pure = {k: all(x.interface == "B" for x in v) for k, v in inner.items()}
    expected = {(*k, len(inner[k])) for r in rows if pure[k := (r.file_id, r.node_id)] and not pure.get((r.file_id, r.parent_id)) and len(inner[k]) >= 2}
    found = trees.pure_roots(nodes, nodes["interface"] == "B", nodes["depth"] * 0 + 1, 2)
    assert {tuple(r) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_only_the_kinds_asked_for_leave_the_task(spark):
    """list lengths alone, with the seq that they have among all tokens."""
    files = spark.createDataFrame(list(enumerate(MADE)), "file_id long, json string")
    every = [tuple(r) for r in trees.shred_tokens(files).where("kind = 'list_length'").collect()]
    assert every and [tuple(r) for r in trees.shred_tokens(files, "list_length").collect()] == every
    assert sizes(trees.shred_tokens(Files(), "list_length"), [json.dumps(TREE)] * 30) == [30]


def test_tokens_are_handed_on_in_pieces():
    """153 tokens a file."""
    got = sizes(trees.shred_tokens(Files()), [json.dumps(TREE)] * 1000)
    assert sum(got) == 153_000 and max(got) <= trees.HELD


def test_kind_counts_shuffles_no_tokens():
    """what a task hands on are its distinct values, not its tokens."""
    assert sizes(trees.count_tokens(Files(), 1), [json.dumps(TREE)] * 1000) == [8]


def test_nodes_are_handed_on_in_pieces(spark):
    """with the bytes of their strings, so that kind_sizes joins no tokens."""
    assert max(got := sizes(trees.shred_nodes(Files(), strings=True), [json.dumps(TREE)] * 2000)) <= trees.HELD and sum(got) == 102_000
    n = trees.shred_nodes(spark.createDataFrame([(1, json.dumps(TREE))], "file_id long, json string"), strings=True)
    found = trees.kind_sizes(n.selectExpr("*", "1L as own"), "own", "string_bytes")
    assert {tuple(r) for r in found.select("interface", "entries", "own_bytes", "shallow_bytes", "total_bytes", "max_entries").collect()} == {("A", 1, 1, 3, 103, 1), ("B", 50, 50, 100, 100, 50)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_training_counts_in_the_tasks(spark):
    """F8: the same dictionary as from all tokens, with 0 and -0 as two values; broken files show as null where texts go along."""
    made = [(i, j) for k in range(3) for i, j in enumerate(MADE, 5 * k)]
    files = spark.createDataFrame(made, "file_id long, json string")
    counted, plain = formats.train_files(files, 2).values, formats.train_tables(trees.shred_tokens(files), 2).values
    assert counted["strings"] == plain["strings"] == ["", "1.5", "a"] and counted["list_lengths"] == plain["list_lengths"]
    assert sorted(map(str, counted["floats"])) == ["-0.0", "0.0", "1.5", "nan"]
    back = formats.decode_files(formats.encode_files(files.selectExpr("*", "json as was"), "streams", keep="was"), "streams", keep="was")
    assert sorted((r.file_id, r.json is None) for r in back.collect()) == [(i, i % 5 in (2, 3)) for i in range(15)]
    assert max(map(len, formats.encode_files(Files(), "json")(iter([batch([json.dumps(TREE)] * 3000)])))) < 3000


def test_lists_are_made_after_rows_are_dealt(spark, tmp_path):
    """F6 of round 2: a task that reads a large row group neither sorts nor holds it; trees are as they were, whole and in order."""
    from canopy import catalogue_trees

    lines = [(k, n, n % 7, 1, float(n), 1.0, "NAR"[n % 3]) for k in (1, 2, 4, None) for n in (3, 1, 2)]
    spark.createDataFrame([(1, "B"), (2, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(4, 1, "F"), (2, 1, "O"), (3, 1, "P"), (1, None, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    schema = "l_orderkey long, l_linenumber int, l_partkey int, l_suppkey int, l_extendedprice double, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = catalogue_trees.files(spark, str(tmp_path))
    items = [{"type": "LineItem", "quantity": 1.0, "flag": f} for f in "ARN"]
    orders = [{"type": "OrderO", "lines": items}, {"type": "OrderP", "lines": []}, {"type": "OrderF", "lines": items}]
    assert {r.file_id: json.loads(r.json) for r in made.collect()} == {1: {"type": "Customer", "segment": "B", "orders": orders}, 2: {"type": "Customer", "segment": "A", "orders": []}}
    plan = catalogue_trees.files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
    above = [x for x in plan if "Aggregate" in x or "Exchange" in x or "FileScan" in x]
    assert sum("collect_list" in x for x in above) == 4
    assert not any("collect_list" in above[i - 1] for i, x in enumerate(above) if "FileScan" in x)
