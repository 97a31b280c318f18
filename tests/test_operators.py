from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from canopy.operators import dictionary, grammar, scopes, statistics, tokens, trees
from canopy.plans import training
from canopy.sources import files, streams

FILES = [(0, 0, "x"), (0, 1, "y"), (1, 0, "x"), (1, 1, None), (2, 0, "x"), (2, 1, "y"), (2, 2, "y"), (3, 0, None)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(FILES, "file_id long, seq long, value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_file_frequency(small):
    assert {r.value: (r.files, r.instances) for r in tokens.file_frequency(small, "value").collect()} == {"x": (3, 3), "y": (2, 3), None: (2, 2)}


def test_linear_table_nulls_first(small):
    table = dictionary.linear_table(tokens.file_frequency(small, "value"), 1)
    assert {r.value: r.idx for r in table.collect()} == {None: 0, "x": 1, "y": 2}
    assert dictionary.linear_table(tokens.file_frequency(small, "value"), 9).count() == 0


def test_dense_index_over_blocks(spark):
    values = sorted({f"{a}{i}" for a in ("", "abc", "abcd", "é", "日本", "z") for i in range(30)})
    got = dictionary.dense_index(spark.createDataFrame([(v,) for v in values], "value string"), "value").collect()
    assert [r.value for r in sorted(got, key=lambda r: r.idx)] == values and sorted(r.idx for r in got) == list(range(len(values)))


def test_threshold_case(spark):
    data = [(f, 0, str(i)) for i in range(5) for f in range(i)]
    t = dictionary.linear_table(tokens.file_frequency(spark.createDataFrame(data, "file_id long, seq long, value string"), "value"), 1)
    assert sorted(r.value for r in t.collect()) == ["2", "3", "4"]


def test_hits_and_misses(small, spark):
    table = spark.createDataFrame([("x", 0), (None, 1)], "value string, idx long")
    assert dictionary.hits(small, table).where("idx is null").count() == 3
    assert {r.value for r in dictionary.misses(small, table).collect()} == {"y"}


def test_prelude_refuses_duplicates(spark):
    t = spark.createDataFrame([("x", 0)], "value string, idx long")
    with pytest.raises(ValueError, match="x"):
        dictionary.with_prelude(t, t)


def test_distributions_are_gapless(small):
    d = dictionary.distributions(tokens.instances(small, "file_id", "value"), ["file_id"], "value")
    for f in range(4):
        own = sorted((r for r in d.collect() if r.file_id == f), key=lambda r: r.symbol_index)
        assert own[0].lo == 0 and own[-1].hi == own[-1].total and all(a.hi == b.lo for a, b in zip(own, own[1:], strict=False))


def test_known_context_decides(spark):
    deep = spark.createDataFrame([("a", "s", "v", 1, 1)], "l string, s string, value string, n long, total long")
    shallow = spark.createDataFrame([("s", "w", 2, 3), ("t", "v", 4, 5)], "s string, value string, n long, total long")
    asked = spark.createDataFrame([("a", "s", "w"), ("b", "s", "w"), ("b", "t", "v"), ("c", "u", "v")], "l string, s string, value string")
    got = dictionary.fallback_lookup(asked, deep, shallow, ["l", "s"], ["s"], "value")
    assert rows(got) == sorted([("a", "s", "w", 2, None, None), ("b", "s", "w", 1, 2, 3), ("b", "t", "v", 1, 4, 5), ("c", "u", "v", -1, None, None)], key=repr)


def test_path_tail(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "p array<string>")
    assert [[r[0] for r in df.select(tokens.path_tail(F.col("p"), k)).collect()] for k in (0, 1, 2, 9)] == [[[], []], [["c"], []], [["b", "c"], []], [["a", "b", "c"], []]]


TREE = {"type": "Script", "statements": [{"type": "Function", "body": [{"type": "Lit", "v": 1}, {"type": "Lit", "v": True}]}, None, {"type": "Lit", "v": "s"}]}


@pytest.fixture(scope="module")
def nodes(spark):
    return trees.shred_nodes(spark.createDataFrame([(1, json.dumps(TREE)), (2, "no json"), (3, None)], "file_id long, json string")).cache()


def test_shredding(nodes, spark):
    assert [(r.node_id, r.parent_id, r.post, r.interface, r.list_pos) for r in nodes.orderBy("pre").collect()] == [(0, None, 5, "Script", None), (1, 0, 3, "Function", 0), (2, 1, 2, "Lit", 0), (3, 1, 3, "Lit", 1), (4, 0, 4, "", 1), (5, 0, 5, "Lit", 2)]
    toks = trees.shred_tokens(spark.createDataFrame([(1, json.dumps(TREE))], "file_id long, json string")).orderBy("seq").collect()
    assert [t.kind for t in toks] == ["interface_name", "list_length", "interface_name", "list_length", "interface_name", "float", "interface_name", "bool", "interface_name", "interface_name", "string_literal"]
    assert [(p.interface, p.field) for p in toks[5].path] == [("Script", "statements"), ("Function", "body"), ("Lit", "v")]


def test_deep_trees_do_not_recurse():
    deep = {"type": "X", "v": 0}
    for _ in range(5000):
        deep = {"type": "X", "v": deep}
    assert sum(x[0] == "node" for x in trees.walk(deep)) == 5001


def test_subtrees(nodes):
    got = {r.node_id: (r.nodes, r.total) for r in trees.subtree_sums(nodes.withColumn("own", F.lit(10)), "own").collect()}
    assert got == {0: (6, 60), 1: (3, 30), 2: (1, 10), 3: (1, 10), 4: (1, 10), 5: (1, 10)}


def test_levels_and_pure_roots(nodes):
    assert {r.node_id: r.level for r in trees.levels(nodes, F.col("interface") == "Function").collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    pure = trees.pure_roots(nodes, F.col("interface") == "Lit", F.lit(1), 1)
    assert {r.node_id for r in pure.collect()} == {2, 3, 5}


def test_lazy_parts_and_scopes(nodes, spark):
    assert {r.node_id: r.part for r in trees.split_lazy(nodes, F.col("interface") == "Function").collect()} == {0: -1, 1: 1, 2: 1, 3: 1, 4: -1, 5: -1}
    scoped = spark.createDataFrame([(1, 0, "outer"), (1, 1, "inner")], "file_id long, node_id long, dictionary string")
    assert {r.node_id: r.dictionary for r in dictionary.nearest_scoped(nodes, scoped).collect()}[3] == "inner"
    moved = {r.node_id: r.parent_id for r in trees.without_scopes(nodes, "Function").collect()}
    assert moved == {0: None, 2: 0, 3: 0, 4: 0, 5: 0}
    tree = {"type": "Script", "s": [{"type": "FunctionExpression", "body": [{"type": "Method"}]}, {"type": "CallExpression", "callee": {"type": "FunctionExpression"}}]}
    n = trees.shred_nodes(spark.createDataFrame([(1, json.dumps(tree))], "file_id long, json string"))
    assert {r.node_id: r.lazy for r in trees.lazify_by_level(n, 1).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False}
    assert trees.lazify_by_size(n, "body", 0).where("lazy").count() == 1


def test_type_check(nodes, spark):
    fields = spark.createDataFrame([("Script", "statements", "Statement", False), ("Function", "body", "Lit", False)], "interface string, field string, type string, nullable boolean")
    sums = spark.createDataFrame([("Statement", "Function"), ("Lit", "Lit")], "sum string, interface string")
    assert {r.node_id for r in trees.type_violations(nodes, fields, sums).collect()} == {4, 5}
    found = spark.createDataFrame([("A", "x"), ("A", "y")], "interface string, field string")
    wanted = spark.createDataFrame([("A", "x"), ("A", "z")], "interface string, field string")
    assert rows(trees.property_mismatch(found, wanted)) == [("A", "y", "extra"), ("A", "z", "missing")]


GRAMMAR = """
// a comment
typedef (A or B) Both; typedef DOMString string;
enum Kind { "x", "y" };
interface A { attribute Kind kind; [Lazy] attribute FrozenArray<Both> items; };
interface B : A { attribute boolean? flag; attribute (A or B) other; };
interface C { };
"""


def test_grammar(spark):
    g = grammar.read_grammar(GRAMMAR, "[ExtendsTypeSum=Both, ScopedDictionary=t] interface D { attribute string t; };")
    assert grammar.resolve(g)["Both"] == {"A", "B", "D"} and grammar.reachable(g, "A") == {"A", "B", "D"}
    printed = grammar.print_grammar(g)
    assert grammar.print_grammar(grammar.read_grammar(printed)) == printed
    named = grammar.deanonymise(g)
    assert {"AOrB", "ListOfBoth", "Optionalboolean"} <= set(named.typedefs) and named.interfaces["A"].fields[1][0] == "items_skip"
    assert ("B", "flag", "interface_name", "") in grammar.baseline(g) and ("A", "kind", "string_enum", "y") in grammar.baseline(g)
    t = grammar.grammar_tables(spark, g)
    assert t["g_field"].where("lazy").count() == 1 and t["g_enum"].count() == 2


@pytest.mark.parametrize("text", ["interface A { attribute Nope x; };", "typedef B A; typedef A B;", "typedef (A or boolean) X; interface A { };", "interface A { }; interface A { };", "interface A { attribute string x; attribute string x; };"])
def test_grammar_refuses(text):
    with pytest.raises(grammar.GrammarError):
        grammar.resolve(grammar.read_grammar("typedef DOMString string;" + text))


def test_scopes(spark):
    got = scopes.annotate(spark.createDataFrame(scopes.example_trees(), "file_id long, json string")).collect()
    by = {(r.file_id, r.scope, r.name): r for r in got}
    assert by[0, 0, "x"].is_captured and not by[0, 1, "a"].is_captured and by[0, 1, "b"].position == 1
    assert by[1, 0, "w"].kind == "var" and by[1, 1, "z"].kind == "const lexical" and not by[1, 0, "y"].is_captured
    assert by[2, 1, "p"].is_captured and by[2, 1, "q"].is_captured
    assert by[3, 0, "e"].direct_eval and not by[4, 0, "e"].direct_eval
    assert not any(r.file_id == 6 for r in got)


def test_tagged_json(spark):
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, "broken")], "file_id long, json string")
    back = files.convert(files.convert(df, "tagged"), "plain").collect()
    assert [(r.file_id, json.loads(r.json)) for r in back] == [(1, TREE)]


def test_scan_and_streams(spark, tmp_path):
    (tmp_path / "in" / "2019").mkdir(parents=True)
    (tmp_path / "in" / "2019" / "a.js").write_text("x" * 4000)
    (tmp_path / "in" / "b.js").write_text("{}")
    (tmp_path / "in" / "c.txt").write_text("no")
    found = files.scan(spark, str(tmp_path / "in"))
    assert rows(found.select("relative", "snapshot", "size")) == [("2019/a.js", "2019", 4000), ("b.js", None, 2)]
    assert files.at_least(found).count() == 1 and files.readable(found).count() == 1
    toks = trees.shred_tokens(spark.createDataFrame([(1, json.dumps(TREE))], "file_id long, json string"))
    streams.write_streams(toks, str(tmp_path / "out"))
    assert (tmp_path / "out" / "kind=list_length").exists()
    assert streams.structure_dump(toks).first().structure == ":interface_name"


def test_sections():
    s = {"prelude": {"b": b"1", "a": b""}, "main": {"x": b"[[y]]" * 9}}
    assert streams.read_sections(streams.write_sections(s)) == s
    with pytest.raises(ValueError):
        streams.read_sections(b"[[a]]junk")


def test_training(small):
    out = training.evaluate(small, ["file_id"], ratio=0.0, threshold=0)
    assert out.agg(F.sum("symbols"), F.sum("hits")).first()[:] == (8, 0)
    assert training.report(out.withColumn("size", F.lit(1))).count() == 5


def test_histogram_has_empty_buckets(small):
    d = dictionary.distributions(tokens.instances(small, "file_id", "value"), ["file_id"], "value")
    h = statistics.probability_histogram(d)
    assert h.count() == 32 and h.agg(F.sum("symbols")).first()[0] == 8


def test_streaming_counts(spark, small, tmp_path):
    from canopy.streaming.counts import running_counts

    small.write.parquet(str(tmp_path / "s"))
    stream = running_counts(spark.readStream.schema(small.schema).parquet(str(tmp_path / "s")), "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.value: r.n for r in spark.table("counts").collect()} == {"x": 3, "y": 3, None: 2}
