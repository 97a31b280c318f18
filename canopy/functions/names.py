"""Names in the forms that different languages want."""

from __future__ import annotations

import re

#: Words that cannot be names as they are.
RESERVED = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while".split())
SIGNS = {"+": "Plus", "-": "Minus", "*": "Times", "/": "Div", "%": "Mod", "<": "Less", ">": "Greater", "=": "Equal", "!": "Not", "&": "And", "|": "Or", "^": "Xor", "~": "Tilde", ",": "Comma"}


def parts(name: str) -> list[str]:
    """The words of a name: cut at case changes, marks and spaces; signs have names of their own."""
    if name and all(c in SIGNS for c in name):
        return [SIGNS[c] for c in name]
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)


def class_name(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in parts(name))


def enum_name(name: str) -> str:
    return "_".join(p.upper() for p in parts(name))


def field_name(name: str) -> str:
    first, *rest = parts(name) or [""]
    return first[:1].lower() + first[1:] + "".join(p[:1].upper() + p[1:] for p in rest)


def identifier(name: str) -> str:
    snake = "_".join(p.lower() for p in parts(name))
    return snake + "_" if snake in RESERVED else snake
