"""Trees of the Shift parser's shape as trees of the binary format's grammar.

Functions of every kind become eager ones whose parameters and body are in a
node of contents, with scopes that name nothing yet: `scopes.annotate` finds
the names. Other rewrites are new names and unwrapped statements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.codecs import escape
from .files import rewrite

# Fixed values, interface names of the public grammars: nodes that only have another name, and statements that stand for one of their fields.
RENAMED = {"LabeledStatement": "LabelledStatement", "StaticPropertyName": "LiteralPropertyName"}
UNWRAPPED = {"BlockStatement": "block", "VariableDeclarationStatement": "declaration"}
SCOPED = {"Block": "AssertedBlockScope", "Script": "AssertedScriptGlobalScope"}
CONTENTS = {
    "FunctionDeclaration": ("FunctionOrMethodContents", ("isThisCaptured",)),
    "Method": ("FunctionOrMethodContents", ("isThisCaptured",)),
    "FunctionExpression": ("FunctionExpressionContents", ("isFunctionNameCaptured", "isThisCaptured")),
    "Getter": ("GetterContents", ("isThisCaptured",)),
    "Setter": ("SetterContents", ("isThisCaptured",)),
    "ArrowExpressionWithExpression": ("ArrowExpressionContentsWithExpression", ()),
    "ArrowExpressionWithFunctionBody": ("ArrowExpressionContentsWithFunctionBody", ()),
}
FLAGS = {"global": "g", "ignoreCase": "i", "multiLine": "m", "sticky": "y", "unicode": "u"}
PLAIN, PATTERNS = "BindingIdentifier", ("ObjectBinding", "ArrayBinding")


def expected_arguments(params: list[dict]) -> int:
    """The length of a function: its parameters before the first with a default."""
    kinds = [p["type"] in (PLAIN, *PATTERNS) for p in params]
    return kinds.index(False) if False in kinds else len(kinds)


def empty_scope(kind: str) -> dict:
    return {"type": kind, "declaredNames": [], "hasDirectEval": False}


def eager_function(node: dict) -> dict:
    """The function with contents. Directives leave its body; a setter's only parameter goes into the contents too."""
    body, directives = node["body"], []
    block = body["type"] == "FunctionBody"
    if block:
        body, directives = body["statements"], body.get("directives", [])
    kind = node["type"]
    if kind == "ArrowExpression":
        kind += "WithFunctionBody" if block else "WithExpression"
    name, captures = CONTENTS[kind]
    contents: dict = {"type": name} | dict.fromkeys(captures, False)
    out = {k: v for k, v in node.items() if k not in ("type", "body", "params", "param")}
    if kind != "Getter":
        field = "param" if kind == "Setter" else "params"
        items = [node["param"]] if kind == "Setter" else node["params"]["items"]
        simple = all(p["type"] == PLAIN for p in items)
        contents["parameterScope"] = {"type": "AssertedParameterScope", "paramNames": [], "hasDirectEval": False, "isSimpleParameterList": simple}
        contents[field] = node[field]
        out["length"] = expected_arguments(items)
        if kind != "Setter":
            out["isAsync"] = bool(node.get("isAsync"))
    contents |= {"bodyScope": empty_scope("AssertedVarScope"), "body": body}
    return {"type": f"Eager{kind}"} | out | {"directives": directives, "contents": contents}


def normalise_node(node: dict) -> dict:
    """One node whose children are normalised already."""
    node = {k: escaped(v) for k, v in node.items()}
    kind = node.get("type")
    if kind in UNWRAPPED:
        return node[UNWRAPPED[kind]]
    if kind in RENAMED:
        return node | {"type": RENAMED[kind]}
    if kind in SCOPED:
        return node | {"scope": empty_scope(SCOPED[kind])}
    if kind in CONTENTS or kind == "ArrowExpression":
        return eager_function(node)
    if kind == "CatchClause":
        return node | {"bindingScope": {"type": "AssertedBoundNamesScope", "boundNames": [], "hasDirectEval": True}}
    if kind == "LiteralRegExpExpression":
        flags = "".join(letter for name, letter in FLAGS.items() if node.get(name))
        return {k: v for k, v in node.items() if k not in FLAGS} | {"flags": flags}
    if kind in ("ForInStatement", "ForOfStatement") and node["left"]["type"] == "VariableDeclaration":
        left = node["left"]
        binding = {k: v for k, v in left.items() if k != "declarators"} | {"type": "ForInOfBinding", "binding": left["declarators"][0]["binding"]}
        return node | {"left": binding}
    return node


def escaped(value: object) -> object:
    if isinstance(value, str):
        return escape(value.encode("utf-8", "surrogatepass"))
    return [escaped(v) for v in value] if isinstance(value, list) else value


def normalise(text: str) -> object:
    """The tree of a JSON text, from the leaves up."""
    return json.loads(text, object_hook=normalise_node)


def normalise_files(files: DataFrame) -> DataFrame:
    """(file_id, json) of files (file_id, json) in Shift's shape; broken ones, and those with a function without body, are skipped."""
    return rewrite(files, lambda text: json.dumps(normalise(text)))
