"""Scopes of programs: declared names, captures, direct eval and parameters.

Each program is resolved in its own task by two loops over an explicit stack:
declarations first, as they hold for all of their scope, then references."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .trees import parse_tree

# Interface names, and the kinds of scopes and bindings, of the public grammar.
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowExpression", "Method", "Getter", "Setter")
LOOPS = ("ForInStatement", "ForOfStatement")
DECLARED = {"var": "var", "let": "non-const lexical", "const": "const lexical"}
SCHEMA = "file_id long, scope int, scope_kind string, name string, kind string, position int, is_captured boolean, direct_eval boolean, captures_this boolean"


class ScopeError(ValueError):
    """A name is declared by var and lexically in one scope."""


@dataclass
class Scope:
    number: int
    kind: str  # script, function, block, catch or name (that of a function expression)
    up: Scope | None
    declared: dict[str, str] = field(default_factory=dict)
    position: dict[str, int] = field(default_factory=dict)
    captured: set[str] = field(default_factory=set)
    direct_eval: bool = False
    captures_this: bool = False
    arrow: bool = False

    def holder(self) -> Scope:
        """The nearest scope that var declarations belong to."""
        s = self
        while s.kind not in ("script", "function"):
            s = s.up
        return s

    def chain(self):
        s = self
        while s:
            yield s
            s = s.up

    def declare(self, name: str, kind: str) -> None:
        known = self.declared.get(name)
        if known and "var" in (known, kind) and known != kind and "parameter" not in known:
            raise ScopeError(f"{name!r} is declared twice in one scope")
        if not (known and kind == "var"):  # a var of a parameter's name is the parameter
            self.declared[name] = kind


def _names(binding) -> list[str]:
    """Names that a binding binds, in order: identifiers, patterns and defaults."""
    out, todo = [], [binding]
    while todo:
        b = todo.pop(0)
        if isinstance(b, list):
            todo[:0] = b
        elif isinstance(b, dict):
            if b.get("type") == "BindingIdentifier":
                out.append(b["name"])
            else:
                todo[:0] = [v for k, v in b.items() if k in ("binding", "elements", "properties", "rest", "value", "items")]
    return out


def plain_kind(interface: str | None) -> str | None:
    """The interface without what says how it is stored: EagerMethod and LazyMethod are a Method, arrows with either body an ArrowExpression."""
    name = (interface or "").removeprefix("Eager").removeprefix("Lazy")
    return "ArrowExpression" if name.startswith("ArrowExpression") and not name.startswith("ArrowExpressionContents") else name or None


def resolve(tree: dict) -> list[Scope]:
    """The scopes of a program, in the order they open.

    Functions, methods, getters and setters open one; so do blocks, loops that
    may declare, and catch clauses. A function's parameters and body stand in it
    or in its `contents`. A var belongs to the nearest function or the script,
    also from inside a catch clause."""
    scopes: list[Scope] = []
    references: list[tuple[Scope, str]] = []
    evals: list[Scope] = []

    def open_scope(kind: str, up: Scope | None) -> Scope:
        scopes.append(Scope(len(scopes), kind, up))
        return scopes[-1]

    todo: list[tuple[object, Scope | None, str]] = [(tree, None, "")]
    while todo:
        node, scope, place = todo.pop()
        if isinstance(node, list):
            todo += [(x, scope, place) for x in reversed(node)]
            continue
        if not isinstance(node, dict):
            continue
        kind = plain_kind(node.get("type"))
        inner, place = scope, "inner"
        if kind == "Script":
            inner, place = open_scope("script", None), "top"
        elif kind in FUNCTIONS:
            own = _names(node.get("name"))
            if kind == "FunctionDeclaration" and own:
                top = scope.kind in ("script", "function")
                (scope.holder() if top else scope).declare(own[0], "var" if top else "non-const lexical")
            elif own:
                scope = open_scope("name", scope)
                scope.declare(own[0], "function name")
            if isinstance(node.get("name"), dict) and not own:
                todo.append((node["name"], scope, "inner"))  # a computed name is no part of the function
            inner = open_scope("function", scope)
            inner.arrow = kind == "ArrowExpression"
            held = node.get("contents") or node
            params = held.get("params") or {}
            items = params.get("items") or []
            if kind == "Setter" and held.get("param"):
                items = [held["param"]]
            for i, item in enumerate(items):
                for name in _names(item):
                    inner.declare(name, "positional parameter" if item.get("type") == "BindingIdentifier" else "destructuring parameter")
                    inner.position[name] = i
            for name in _names(params.get("rest")):
                inner.declare(name, "rest parameter")
            todo.append((held.get("body"), inner, "top"))
            todo += [(x.get("init"), inner, "inner") for x in items if isinstance(x, dict)]  # defaults
            continue
        elif kind == "CatchClause":
            inner = open_scope("catch", scope)
            for name in _names(node.get("binding")):
                inner.declare(name, "catch")
        elif kind in ("Block", "ForStatement", "SwitchStatement", "SwitchStatementWithDefault", *LOOPS):
            inner = open_scope("block", scope)
        elif kind == "ForInOfBinding":
            for name in _names(node.get("binding")):
                (scope.holder() if node["kind"] == "var" else scope).declare(name, DECLARED[node["kind"]])
        elif kind == "VariableDeclaration":
            how = DECLARED[node["kind"]]
            for d in node.get("declarators") or []:
                for name in _names(d.get("binding")):
                    (scope.holder() if how == "var" else scope).declare(name, how)
        elif kind in ("IdentifierExpression", "AssignmentTargetIdentifier"):
            references.append((scope, node["name"]))
        elif kind == "ThisExpression":
            references.append((scope, "this"))
        elif kind == "CallExpression" and (node.get("callee") or {}).get("type") == "IdentifierExpression" and node["callee"].get("name") == "eval":
            evals.append(scope)
        todo += [(v, inner, place) for k, v in reversed(node.items()) if k not in ("type", "name") and isinstance(v, dict | list)]

    for scope, name in references:
        crossed = False
        for s in scope.chain():
            if name == "this":
                if s.kind == "function" and not s.arrow:
                    s.captures_this |= crossed
                    break
            elif name in s.declared:
                if crossed:
                    s.captured.add(name)
                break
            crossed |= s.kind == "function"
    for scope in evals:
        # A call of a name that a program binds itself is no direct eval.
        if not any("eval" in s.declared for s in scope.chain()):
            for s in scope.chain():
                s.direct_eval = True
    return scopes


def annotate(files: DataFrame) -> DataFrame:
    """A row for each declared name of each scope of files (file_id, json), names sorted; one with a null name for a scope without any.

    Programs that are no tree or declare a name twice are left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for f, j in zip(pdf["file_id"], pdf["json"], strict=True):
                tree = parse_tree(j)
                try:
                    scopes = resolve(tree) if tree else []
                except ScopeError:
                    continue
                for s in scopes:
                    for name in sorted(s.declared) or [None]:
                        rows.append((f, s.number, s.kind, name, s.declared.get(name), s.position.get(name), name in s.captured, s.direct_eval, s.captures_this))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype=object)

    return files.select("file_id", "json").mapInPandas(run, SCHEMA)


def _id(name: str) -> dict:
    return {"type": "BindingIdentifier", "name": name}


def _use(name: str) -> dict:
    return {"type": "ExpressionStatement", "expression": {"type": "IdentifierExpression", "name": name}}


def _let(name: str, kind: str = "let") -> dict:
    return {"type": "VariableDeclaration", "kind": kind, "declarators": [{"type": "VariableDeclarator", "binding": _id(name), "init": None}]}


def _function(name: str, params: list[str], body: list) -> dict:
    return {"type": "FunctionDeclaration", "name": _id(name), "params": {"type": "FormalParameters", "items": [_id(p) for p in params], "rest": None}, "body": body}


def example_trees() -> list[tuple[int, str]]:
    """Small programs, written out as trees."""
    call = {"type": "ExpressionStatement", "expression": {"type": "CallExpression", "callee": {"type": "IdentifierExpression", "name": "eval"}, "arguments": []}}
    programs = [
        [_let("x", "var"), _function("f", ["a", "b"], [_use("x"), _use("a")])],
        [_let("y"), {"type": "Block", "statements": [_let("z", "const"), _let("w", "var"), _use("y")]}],
        [_function("g", ["p"], [_let("q"), _function("h", [], [_use("p"), _use("q")])])],
        [_function("e", [], [call])],
        [_let("eval", "var"), _function("e", [], [call])],
        [{"type": "TryCatchStatement", "body": {"type": "Block", "statements": []}, "catchClause": {"type": "CatchClause", "binding": _id("err"), "body": {"type": "Block", "statements": [_use("err")]}}}],
        [_let("d", "var"), _let("d", "let")],
    ]
    return [(i, json.dumps({"type": "Script", "statements": p})) for i, p in enumerate(programs)]
