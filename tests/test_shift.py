"""Trees of Shift's shape into those of the binary format's grammar."""

from __future__ import annotations

import json

from canopy.sources import shift


def name(n):
    return {"type": "BindingIdentifier", "name": n}


def function(kind, body, *params, **more):
    return {"type": kind, "params": {"type": "FormalParameters", "items": list(params), "rest": None}, "body": body} | more


def block(*statements, directives=()):
    return {"type": "FunctionBody", "directives": list(directives), "statements": list(statements)}


def done(tree):
    return shift.normalise(json.dumps(tree))


def test_functions_of_every_kind():
    use = {"type": "Directive", "rawValue": "use strict"}
    f = done(function("FunctionDeclaration", block(directives=[use]), name("a"), {"type": "ArrayBinding"}, {"type": "BindingWithDefault"}, name("z")))
    assert f["type"] == "EagerFunctionDeclaration" and f["length"] == 2 and f["isAsync"] is False and f["directives"] == [use]
    assert f["contents"]["type"] == "FunctionOrMethodContents" and f["contents"]["isThisCaptured"] is False and f["contents"]["body"] == []
    assert f["contents"]["parameterScope"]["isSimpleParameterList"] is False and "params" not in f and "body" not in f
    assert done(function("Method", block(), name("a"), isAsync=True))["isAsync"] is True
    e = done(function("FunctionExpression", block()))
    assert e["contents"]["isFunctionNameCaptured"] is False and e["contents"]["parameterScope"]["isSimpleParameterList"] is True
    arrow = done(function("ArrowExpression", {"type": "ThisExpression"}))
    assert (arrow["type"], arrow["contents"]["type"]) == ("EagerArrowExpressionWithExpression", "ArrowExpressionContentsWithExpression")
    assert arrow["contents"]["body"] == {"type": "ThisExpression"} and "isThisCaptured" not in arrow["contents"]
    assert done(function("ArrowExpression", block()))["type"] == "EagerArrowExpressionWithFunctionBody"


def test_getters_and_setters():
    g = done({"type": "Getter", "name": None, "body": block()})
    assert g["type"] == "EagerGetter" and not {"length", "isAsync"} & g.keys() and "parameterScope" not in g["contents"]
    s = done({"type": "Setter", "name": None, "param": {"type": "ObjectBinding"}, "body": block()})
    assert s["length"] == 1 and s["contents"]["param"] == {"type": "ObjectBinding"} and "param" not in s and "isAsync" not in s
    assert s["contents"]["parameterScope"]["isSimpleParameterList"] is False


def test_other_nodes():
    inner = {"type": "BlockStatement", "block": {"type": "Block", "statements": []}}
    tree = done({"type": "Script", "statements": [{"type": "LabeledStatement", "label": "x", "body": inner}, {"type": "VariableDeclarationStatement", "declaration": {"type": "VariableDeclaration", "kind": "var", "declarators": []}}]})
    assert tree["scope"]["type"] == "AssertedScriptGlobalScope"
    assert tree["statements"][0]["type"] == "LabelledStatement" and tree["statements"][0]["body"] == {"type": "Block", "statements": [], "scope": shift.empty_scope("AssertedBlockScope")}
    assert tree["statements"][1]["type"] == "VariableDeclaration"
    loop = done({"type": "ForOfStatement", "left": {"type": "VariableDeclaration", "kind": "let", "declarators": [{"type": "VariableDeclarator", "binding": name("x"), "init": None}]}})
    assert loop["left"] == {"type": "ForInOfBinding", "kind": "let", "binding": name("x")}
    assert done({"type": "ForInStatement", "left": name("x")})["left"] == name("x")
    assert done({"type": "CatchClause"})["bindingScope"]["hasDirectEval"] is True
    assert done({"type": "StaticPropertyName", "value": "a\x7f\ud800"}) == {"type": "LiteralPropertyName", "value": "a\x7f007F\x7fD800"}
    assert done({"type": "LiteralRegExpExpression", "pattern": "a", "unicode": True, "global": True, "sticky": False}) == {"type": "LiteralRegExpExpression", "pattern": "a", "flags": "gu"}


def test_broken_files_are_skipped(spark):
    rows = [(1, json.dumps({"type": "Script"})), (2, "{"), (3, None), (4, '{"type": "Getter"}'), (5, "[" * 200_000)]
    got = shift.normalise_files(spark.createDataFrame(rows, "file_id long, json string")).collect()
    assert [r.file_id for r in got] == [1]
