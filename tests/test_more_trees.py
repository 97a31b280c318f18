from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from canopy.functions import names
from canopy.operators import grammar, trees
from canopy.sources import formats

GRAMMAR = """
typedef (A or B) Item; typedef FrozenArray<Item> Items; typedef DOMString string;
enum Kind { "x", "y" };
interface A { attribute Kind kind; attribute Items items; attribute double v; };
interface B { attribute B? next; attribute (A or B)? other; attribute FrozenArray<string> names; };
"""


def test_names():
    assert names.class_name("foo-bar") == "FooBar" and names.enum_name("FooBarBaz") == "FOO_BAR_BAZ"
    assert names.field_name("FooBar") == "fooBar" and names.identifier("typeOf") == "type_of" and names.identifier("Type") == "type_"
    assert names.class_name("+=") == "PlusEqual"


def test_random_trees_are_valid(spark):
    g = grammar.read_grammar(GRAMMAR)
    made = [(i, json.dumps(grammar.random_tree(g, "A", i))) for i in range(20)]
    assert made[3][1] == json.dumps(grammar.random_tree(g, "A", 3))
    assert all(formats.decode_streams(formats.encode_streams(json.loads(j))) == json.loads(j) for _, j in made)
    nodes = trees.shred_nodes(spark.createDataFrame(made, "file_id long, json string"))
    assert nodes.select("interface").distinct().count() >= 2


def test_type_order():
    g = grammar.read_grammar(GRAMMAR)
    types = [grammar.Type(("A",)), grammar.Type(("Kind",)), grammar.Type(("A",), True), grammar.Type(("A", "B")), grammar.Type(("boolean",))]
    assert [str(t) for t in sorted(types, key=lambda t: grammar.type_rank(g, t))] == ["boolean", "(A or B)", "FrozenArray<A>", "Kind", "A"]


@pytest.fixture(scope="module")
def nodes(spark):
    body = [{"type": "WhileStatement", "body": {"type": "Block", "statements": [{"type": "ExpressionStatement"}] * 2}}, {"type": "IfStatement", "consequent": {"type": "ReturnStatement"}, "alternate": None}]
    tree = {"type": "Script", "statements": [{"type": "FunctionDeclaration", "body": body}, {"type": "TryCatchStatement"}]}
    return trees.shred_nodes(spark.createDataFrame([(1, json.dumps(tree))], "file_id long, json string"))


def test_statement_lengths(nodes):
    got = {r.interface: r.length for r in nodes.join(trees.statement_lengths(nodes), ["file_id", "node_id"]).collect()}
    assert got["WhileStatement"] == 3 and got["IfStatement"] == 1 and got["TryCatchStatement"] == got["Script"] == trees.MANY


def test_enrich(nodes):
    out = trees.enrich(nodes, 1, F.col("interface").isin("ExpressionStatement", "Block"))
    got = {(r.interface, r.lazy, r.dictionary) for r in out.collect()}
    assert ("FunctionDeclaration", True, None) in got and ("Block", False, "pojo") in got and ("ExpressionStatement", False, None) in got
    assert trees.enrich(nodes).where("lazy or dictionary is not null").count() == 0
    parts = trees.split_lazy(nodes, F.col("interface") == "FunctionDeclaration")
    assert trees.difference(trees.restore_lazy(parts).select(*nodes.columns), nodes).count() == 0


def test_token_repairs(spark):
    tokens = trees.shred_tokens(spark.createDataFrame([(1, '{"type": "A", "v": 1, "n": 2}')], "file_id long, json string"))
    whole = tokens.withColumn("kind", F.when(F.col("kind") == "float", "unsigned_long").otherwise(F.col("kind")))
    fields = spark.createDataFrame([("A", "v", "double"), ("A", "n", "unsigned long")], "interface string, field string, type string")
    assert [r.kind for r in trees.repair_numbers(whole, fields).orderBy("seq").collect()] == ["interface_name", "float", "unsigned_long"]
    offsets = tokens.withColumn("kind", F.lit("offset"))
    assert {r.value_num for r in trees.reset_offsets(offsets).collect()} == {0.0}
    keys = spark.createDataFrame([("A", "p"), ("B", "p")], "interface string, field string")
    assert {tuple(r) for r in trees.key_remap(keys, {("A", "p"): ("B", "p")}).collect()} == {("B", "p")}
