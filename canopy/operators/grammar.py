"""Grammars: reading them, checking them, and what follows from them. Small metadata, handled on the driver."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Names of the primitive types.
PRIMITIVES = {"boolean": "Boolean", "double": "Number", "DOMString": "String", "unsigned long": "UnsignedLong", "long": "Long", "IdentifierName": "IdentifierName", "PropertyKey": "PropertyKey"}


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Type:
    """One or several names; array: a list of them; or_null: null as well."""

    names: tuple[str, ...]
    array: bool = False
    or_null: bool = False

    def __str__(self) -> str:
        inner = self.names[0] if len(self.names) == 1 else "(" + " or ".join(self.names) + ")"
        return (f"FrozenArray<{inner}>" if self.array else inner) + "?" * self.or_null


@dataclass
class Interface:
    name: str
    fields: list[tuple[str, Type, frozenset[str]]] = field(default_factory=list)
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Grammar:
    interfaces: dict[str, Interface] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    typedefs: dict[str, Type] = field(default_factory=dict)

    def merged(self, other: Grammar) -> Grammar:
        return Grammar(self.interfaces | other.interfaces, self.enums | other.enums, self.typedefs | other.typedefs)


TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|("[^"]*")|([A-Za-z_][\w]*)|([{}()\[\]<>;:,=?])', re.S)


class Reader:
    """A recursive-descent reader of the interface language."""

    def __init__(self, text: str):
        self.words, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GrammarError(f"unexpected {text[at]!r} at {at}")
            if m.lastindex:
                self.words.append(m[m.lastindex])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, expected: str | None = None) -> str:
        word = self.peek()
        if word is None or expected is not None and word != expected:
            raise GrammarError(f"{expected or 'more'} expected, not {word}")
        self.at += 1
        return word

    def maybe(self, word: str) -> bool:
        if self.peek() == word:
            self.at += 1
            return True
        return False

    def attributes(self) -> dict[str, str]:
        out = {}
        if self.maybe("["):
            while not self.maybe("]"):
                name = self.take()
                out[name] = self.take() if self.maybe("=") else ""
                self.maybe(",")
        return out

    def type(self) -> Type:
        if self.maybe("FrozenArray"):
            self.take("<")
            inner = self.type()
            self.take(">")
            return Type(inner.names, True, self.maybe("?"))
        if self.maybe("("):
            names = list(self.type().names)
            while self.maybe("or"):
                names += self.type().names
            self.take(")")
            return Type(tuple(names), False, self.maybe("?"))
        name = self.take()
        if name == "unsigned":
            name += " " + self.take("long")
        return Type((name,), False, self.maybe("?"))

    def grammar(self) -> Grammar:
        g = Grammar()
        while self.peek() is not None:
            attributes = self.attributes()
            what = self.take()
            if what == "typedef":
                t = self.type()
                self._new(g, name := self.take())
                g.typedefs[name] = t
            elif what == "enum":
                self._new(g, name := self.take())
                self.take("{")
                g.enums[name] = []
                while not self.maybe("}"):
                    g.enums[name].append(self.take().strip('"'))
                    self.maybe(",")
            elif what == "interface":
                self._new(g, name := self.take())
                i = g.interfaces[name] = Interface(name, attributes=attributes)
                if self.maybe(":"):
                    self.take()
                self.take("{")
                while not self.maybe("}"):
                    marks = frozenset(self.attributes())
                    self.maybe("readonly")
                    self.take("attribute")
                    t = self.type()
                    label = self.take()
                    if label in (f[0] for f in i.fields):
                        raise GrammarError(f"{name} has {label} twice")
                    i.fields.append((label, t, marks))
                    self.take(";")
            else:
                raise GrammarError(f"unexpected {what}")
            self.take(";")
        return g

    def _new(self, g: Grammar, name: str) -> None:
        if name in g.interfaces or name in g.enums or name in g.typedefs:
            raise GrammarError(f"{name} is declared twice")


def read_grammar(*texts: str) -> Grammar:
    """The grammar of all texts together. An interface that extends a sum becomes one of its members."""
    g = Grammar()
    for t in texts:
        g = g.merged(Reader(t).grammar())
    for i in g.interfaces.values():
        if target := i.attributes.get("ExtendsTypeSum"):
            old = g.typedefs.get(target)
            if old is None or old.array:
                raise GrammarError(f"{i.name} extends {target}, which is no sum")
            g.typedefs[target] = Type((*old.names, i.name), old.array, old.or_null)
    return g


def resolve(g: Grammar) -> dict[str, frozenset[str]]:
    """Each typedef's interfaces; enums and primitives stand for themselves. Checks all names, cycles and mixed sums."""
    known = {*g.interfaces, *g.enums, *g.typedefs, *PRIMITIVES, "string", "Type"}
    for owner, types in [*((i.name, [t for _, t, _ in i.fields]) for i in g.interfaces.values()), *((n, [t]) for n, t in g.typedefs.items())]:
        for t in types:
            if missing := [n for n in t.names if n not in known]:
                raise GrammarError(f"{owner} refers to unknown {missing[0]}")
    done: dict[str, frozenset[str]] = {}

    def of(name: str, above: tuple[str, ...]) -> frozenset[str]:
        if name not in g.typedefs:
            return frozenset({name})
        if name in above:
            raise GrammarError(f"{name} is defined by itself")
        if name not in done:
            t = g.typedefs[name]
            out = frozenset().union(*(of(n, (*above, name)) for n in t.names))
            if len(out) > 1 and not t.array and any(n not in g.interfaces for n in out):
                raise GrammarError(f"{name} mixes interfaces with other types")
            done[name] = out
        return done[name]

    for name in g.typedefs:
        of(name, ())
    return done


def grammar_tables(spark: SparkSession, g: Grammar) -> dict[str, DataFrame]:
    """g_interface, g_field, g_enum, g_typedef and g_sum; every interface is a sum of itself."""
    sums = resolve(g)
    fields = [(i.name, k, f, "|".join(t.names), t.array, t.or_null, "Lazy" in a) for i in g.interfaces.values() for k, (f, t, a) in enumerate(i.fields)]
    return {
        "g_interface": spark.createDataFrame([(i.name, "Scope" in i.attributes, i.attributes.get("ScopedDictionary")) for i in g.interfaces.values()], "interface string, is_scope boolean, scoped_dictionary_field string"),
        "g_field": spark.createDataFrame(fields, "interface string, child_index int, field string, type string, is_array boolean, nullable boolean, lazy boolean"),
        "g_enum": spark.createDataFrame([(n, k, v) for n, vs in g.enums.items() for k, v in enumerate(vs)], "enum string, position int, value string"),
        "g_typedef": spark.createDataFrame([(n, str(t), t.or_null) for n, t in g.typedefs.items()], "name string, type string, nullable boolean"),
        "g_sum": spark.createDataFrame([(s, i) for s, m in sums.items() for i in sorted(m)] + [(i, i) for i in g.interfaces], "sum string, interface string"),
    }


def deanonymise(g: Grammar) -> Grammar:
    """Names for sums, lists and options that stand in fields; lazy fields are preceded by their length."""
    out = Grammar({}, dict(g.enums), dict(g.typedefs))

    def named(t: Type, filled: bool) -> Type:
        base = "Or".join(t.names)
        if len(t.names) > 1:
            out.typedefs.setdefault(base, Type(t.names))
        if t.array:
            base, inner = ("NonEmpty" if filled else "") + "ListOf" + base, base
            out.typedefs.setdefault(base, Type((inner,), True))
        if t.or_null:
            base, inner = "Optional" + base, base
            out.typedefs.setdefault(base, Type((inner,), False, True))
        return Type((base,))

    for i in g.interfaces.values():
        n = out.interfaces[i.name] = Interface(i.name, attributes=i.attributes)
        for label, t, marks in i.fields:
            if "Lazy" in marks:
                n.fields.append((f"{label}_skip", Type(("Offset",)), frozenset()))
            n.fields.append((label, named(t, "NonEmpty" in marks), marks))
    return out


def print_grammar(g: Grammar) -> str:
    """The grammar in its language again, in order of names; sums have their extensions in them."""
    out = [f"typedef {t} {n};" for n, t in sorted(g.typedefs.items())]
    out += ["enum %s {\n%s\n};" % (n, ",\n".join(f'  "{v}"' for v in vs)) for n, vs in sorted(g.enums.items())]
    for n, i in sorted(g.interfaces.items()):
        marks = ", ".join(k + (f"={v}" if v else "") for k, v in i.attributes.items() if k != "ExtendsTypeSum")
        body = "".join(f"  {'[' + ', '.join(sorted(a)) + '] ' if a else ''}attribute {t} {f};\n" for f, t, a in i.fields)
        out.append((f"[{marks}] " if marks else "") + f"interface {n} {{\n{body}}};")
    return "\n".join(out) + "\n"


def reachable(g: Grammar, start: str, used: set[str] | None = None) -> set[str]:
    """Interfaces reachable from start through fields and sums; with used only through interfaces that occur."""
    sums, out, todo = resolve(g), set(), [start]
    while todo:
        name = todo.pop()
        for i in sums.get(name, {name}):
            if i in g.interfaces and i not in out and (used is None or i in used):
                out.add(i)
                todo += [n for _, t, _ in g.interfaces[i].fields for n in t.names]
    return out


def baseline(g: Grammar) -> list[tuple[str, str, str, str | None]]:
    """(interface, field, kind, value) of all that the grammar allows: booleans, enumerated strings, interfaces, null as ''."""
    sums, out = resolve(g), []
    for i in g.interfaces.values():
        for label, t, _ in i.fields:
            for n in t.names:
                aliased = g.typedefs.get(n)
                if t.or_null or aliased is not None and aliased.or_null:
                    out.append((i.name, label, "interface_name", ""))
                for m in sorted(sums.get(n, {n})):
                    if m == "boolean":
                        out += [(i.name, label, "bool", v) for v in ("false", "true")]
                    elif m in g.enums:
                        out += [(i.name, label, "string_enum", v) for v in g.enums[m]]
                    elif m in g.interfaces:
                        out.append((i.name, label, "interface_name", m))
    return sorted(set(out))


def type_rank(g: Grammar, t: Type) -> tuple:
    """Sorts types: primitives, sums, lists, enumerations, interfaces, then names yet to be resolved."""
    name = t.names[0]
    if t.array:
        return 2, type_rank(g, Type(t.names))
    if len(t.names) > 1:
        return 1, tuple(sorted(t.names))
    order = 0 if name in PRIMITIVES else 3 if name in g.enums else 4 if name in g.interfaces else 5
    return order, name


def random_tree(g: Grammar, start: str, seed: int, depth: int = 5, longest: int = 15, null_share: float = 0.1) -> dict:
    """A tree that the grammar allows, the same for the same seed. Below the depth options are null and lists empty."""
    rng, sums = random.Random(seed), resolve(g)
    cheapest = _heights(g, sums)

    def value(t: Type, left: int):
        if t.or_null and (left <= 0 or rng.random() < null_share):
            return None
        if t.array:
            n = rng.randint(0, longest) if left > 0 else 0
            return [value(Type(t.names), left - 1) for _ in range(n)]
        name = rng.choice(t.names)
        if name in g.typedefs and name not in g.interfaces and (g.typedefs[name].array or g.typedefs[name].or_null):
            return value(g.typedefs[name], left)
        members = sorted(m for n in t.names for m in sums.get(n, {n}))
        inner = [m for m in members if m in g.interfaces]
        if inner:
            return node(rng.choice(inner) if left > 0 else min(inner, key=lambda m: (cheapest[m], m)), left)
        m = rng.choice(members)
        if m in g.enums:
            return rng.choice(g.enums[m])
        return {"boolean": rng.random() < 0.5, "double": rng.choice([0.0, 1.5, -2.0, 1e9]), "long": rng.randint(-99, 99), "unsigned long": rng.randint(0, 99)}.get(m, rng.choice(["", "a", "b", "name"]))

    def node(name: str, left: int) -> dict:
        return {"type": name} | {f: value(t, left - 1) for f, t, _ in g.interfaces[name].fields}

    return node(start, depth)


def _heights(g: Grammar, sums: dict[str, frozenset[str]]) -> dict[str, int]:
    """How deep the smallest tree of each interface is."""
    heights = dict.fromkeys(g.interfaces, 10**6)
    for _ in g.interfaces:
        before = dict(heights)
        for i in g.interfaces.values():
            need = [0]
            for _, t, _ in i.fields:
                aliased = [g.typedefs[n] for n in t.names if n in g.typedefs]
                if not (t.array or t.or_null or any(a.array or a.or_null for a in aliased)):
                    need.append(1 + min((heights.get(m, 0) for n in t.names for m in sums.get(n, {n})), default=0))
            heights[i.name] = max(need)
        if heights == before:
            break
    return heights
