"""Scopes of getters, setters, loops and catch clauses; lengths of statements with functions in them; texts nested too deeply."""

from __future__ import annotations

import json

import pytest

from canopy.operators import scopes, trees
from canopy.sources import files


def name(n):
    return {"type": "BindingIdentifier", "name": n}


def use(n):
    return {"type": "ExpressionStatement", "expression": {"type": "IdentifierExpression", "name": n}}


def let(n, kind="let"):
    return {"type": "VariableDeclaration", "kind": kind, "declarators": [{"type": "VariableDeclarator", "binding": name(n), "init": None}]}


def found(*statements):
    return [(s.kind, s.declared, s.captured) for s in scopes.resolve({"type": "Script", "statements": list(statements)})]


@pytest.mark.parametrize("prefix", ["", "Eager", "Lazy"])
def test_getters_and_setters_open_scopes(prefix):
    getter = {"type": f"{prefix}Getter", "name": {"type": "LiteralPropertyName", "value": "p"}, "contents": {"type": "GetterContents", "body": [let("x", "var")]}}
    setter = {"type": f"{prefix}Setter", "name": {"type": "LiteralPropertyName", "value": "p"}, "contents": {"type": "SetterContents", "param": name("v"), "body": [use("v"), use("outer")]}}
    got = found(let("outer"), {"type": "ExpressionStatement", "expression": {"type": "ObjectExpression", "properties": [getter, setter]}})
    assert got == [("script", {"outer": "non-const lexical"}, {"outer"}), ("function", {"x": "var"}, set()), ("function", {"v": "positional parameter"}, set())]


@pytest.mark.parametrize("loop", ["ForInStatement", "ForOfStatement"])
def test_loops_declare(loop):
    def over(kind):
        return {"type": loop, "left": {"type": "ForInOfBinding", "kind": kind, "binding": name("k")}, "right": {"type": "IdentifierExpression", "name": "o"}, "body": use("k")}

    assert found(over("let")) == [("script", {}, set()), ("block", {"k": "non-const lexical"}, set())]
    assert found(over("const"))[1][1] == {"k": "const lexical"}
    assert found(over("var")) == [("script", {"k": "var"}, set()), ("block", {}, set())]


def test_var_in_a_catch_clause_belongs_to_the_function():
    clause = {"type": "CatchClause", "binding": name("e"), "body": {"type": "Block", "statements": [let("e", "var"), let("w", "var")]}}
    got = found({"type": "TryCatchStatement", "body": {"type": "Block", "statements": []}, "catchClause": clause})
    assert got[0] == ("script", {"e": "var", "w": "var"}, set()) and ("catch", {"e": "catch"}, set()) in got


def test_a_computed_name_is_no_part_of_the_method():
    method = {"type": "Method", "name": {"type": "ComputedPropertyName", "expression": {"type": "IdentifierExpression", "name": "k"}}, "params": {"items": [], "rest": None}, "body": []}
    assert found(let("k"), {"type": "ExpressionStatement", "expression": {"type": "ObjectExpression", "properties": [method]}})[0][2] == set()


def plain_length(s):
    """The length of a statement by recursion."""
    kind = s["type"]
    if kind in trees.ENDLESS:
        return trees.MANY
    inner = [x for k in ("statements", "body", "consequent", "alternate", "cases") for v in [s.get(k)] for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    if kind in trees.HOLDERS:
        return sum(map(plain_length, inner))
    return 1 + sum(map(plain_length, inner)) if kind in trees.COUNTED else 1


def test_statement_lengths(spark):
    function = {"type": "ExpressionStatement", "expression": {"type": "FunctionExpression", "body": [use("a"), use("b"), use("c")]}}
    loop = {"type": "ForStatement", "init": let("i"), "body": {"type": "Block", "statements": [function, use("x")]}}
    choice = {"type": "IfStatement", "test": {"type": "FunctionExpression", "body": [use("q")]}, "consequent": loop, "alternate": {"type": "Block", "statements": [loop, let("z")]}}
    attempt = {"type": "TryCatchStatement", "body": {"type": "Block", "statements": [use("y")]}}
    declared = {"type": "FunctionDeclaration", "name": name("f"), "body": [choice]}
    statements = [function, loop, choice, attempt, declared, {"type": "Block", "statements": [attempt, use("a")]}]
    tree = json.dumps({"type": "Script", "statements": statements})
    nodes = trees.shred_nodes(spark.createDataFrame([(1, tree)], "file_id long, json string"))
    got = {r.node_id: r.length for r in trees.statement_lengths(nodes).collect()}
    top = [r.node_id for r in nodes.where("parent_field = 'statements' and depth = 1").orderBy("pre").collect()]
    assert [got[i] for i in top] == [min(plain_length(s), trees.MANY) for s in statements] == [1, 3, 7, trees.MANY, 1, trees.MANY]


def test_deep_texts_are_skipped(spark):
    deep = '{"type": "A", "x": ' * 100_000 + "null" + "}" * 100_000
    mid = '{"type": "A", "x": ' * 3_000 + "null" + "}" * 3_000
    docs = spark.createDataFrame([(1, deep), (2, '{"type": "A", "x": null}'), (3, mid)], "file_id long, json string")
    assert 2 in {r.file_id for r in trees.shred_nodes(docs).collect()}
    assert 2 in {r.file_id for r in files.convert(docs, "tagged").collect()}


def test_kinds_of_interfaces():
    assert [scopes.plain_kind(k) for k in ("LazyMethod", "EagerArrowExpressionWithFunctionBody", "ArrowExpression", "ArrowExpressionContentsWithExpression", None)] == [
        "Method", "ArrowExpression", "ArrowExpression", "ArrowExpressionContentsWithExpression", None,
    ]
