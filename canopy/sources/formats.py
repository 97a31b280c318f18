"""File formats of trees: a registry of writers and readers, and their use on whole tables.

multipart: sections for the grammar, the strings and the tree, each compressed.
streams: a prelude of values and a stream of references for each kind of value,
and a main stream for the shape; values of a trained dictionary, which writer and
reader share, are left out of the preludes. json: tagged JSON. xml: written only.
Numbers keep their bits; whole and fractional numbers are both doubles."""

from __future__ import annotations

import json
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.ordered import References
from ..operators.tokens import file_frequency
from ..operators.trees import count_tokens
from .files import from_tagged, map_texts, to_tagged
from .streams import read_sections, write_sections

#: Recall windows that served best: identifiers repeat soon, other kinds do not.
WINDOWS = {"strings": 8, "floats": 0, "list_lengths": 0}
NULL, FALSE, TRUE, NUMBER, STRING, LIST, TUPLE = range(7)


def shape(tree: object) -> Iterator[tuple[int, object]]:
    """(tag, value) of every value in document order; a tuple's value is its interface and field names."""
    todo = [tree]
    while todo:
        v = todo.pop()
        if v is None:
            yield NULL, None
        elif isinstance(v, bool):
            yield (TRUE if v else FALSE), None
        elif isinstance(v, int | float):
            yield NUMBER, float(v)
        elif isinstance(v, str):
            yield STRING, v
        elif isinstance(v, list):
            yield LIST, len(v)
            todo += reversed(v)
        else:
            yield TUPLE, (v["type"], *(k for k in v if k != "type"))
            todo += reversed([x for k, x in v.items() if k != "type"])


def build(tokens: Iterator[tuple[int, object]]) -> object:
    """The tree of a shape. Open lists and tuples wait on a stack."""
    result: list = []
    open_: list[tuple[object, list]] = []  # (container, keys still to fill)
    for tag, v in tokens:
        item = {NULL: None, FALSE: False, TRUE: True}.get(tag, v)
        if tag == LIST:
            item = []
        elif tag == TUPLE:
            item = {"type": v[0]}
        if not open_:
            result.append(item)
        else:
            box, keys = open_[-1]
            key = keys.pop()
            if isinstance(box, list):
                box.append(item)
            else:
                box[key] = item
        if tag == LIST:
            open_.append((item, [None] * v))
        elif tag == TUPLE:
            open_.append((item, list(reversed(v[1:]))))
        while open_ and not open_[-1][1]:
            open_.pop()
        if not open_:
            break
    if open_ or not result:
        raise ValueError("tree cut short")
    return result[0]


def _by_use(values: list) -> dict:
    """Most used first, then by value: frequent values get short numbers."""
    return {v: i for i, (v, _) in enumerate(sorted(Counter(values).items(), key=lambda x: (-x[1], x[0])))}


def encode_multipart(tree: object, codec: str = "gzip") -> bytes:
    tokens = list(shape(tree))
    strings = _by_use([v for t, v in tokens if t == STRING])
    tuples = _by_use([v for t, v in tokens if t == TUPLE])
    body = bytearray()
    for tag, v in tokens:
        body.append(tag)
        if tag == NUMBER:
            body += codecs.write_maybe_varfloat(v)
        elif tag in (STRING, LIST, TUPLE):
            body += codecs.write_varnum(strings[v] if tag == STRING else tuples[v] if tag == TUPLE else v)
    names = codecs.write_varuint(len(tuples)) + b"".join(codecs.write_strings(list(t)) for t in tuples)
    return write_sections({"grammar": {"names": names}, "strings": {"values": codecs.write_strings(list(strings))}, "tree": {"tokens": bytes(body)}}, codec)


def decode_multipart(data: bytes) -> object:
    sections = read_sections(data)
    strings, _ = codecs.read_strings(sections["strings"]["values"])
    names = sections["grammar"]["names"]
    n, at = codecs.read_varuint(names)
    tuples = []
    for _ in range(n):
        own, at = codecs.read_strings(names, at)
        tuples.append(tuple(own))

    def tokens():
        body, at = sections["tree"]["tokens"], 0
        while at < len(body):
            tag, v = body[at], None
            at += 1
            if tag == NUMBER:
                v, at = codecs.read_maybe_varfloat(body, at)
            elif tag in (STRING, LIST, TUPLE):
                v, at = codecs.read_varnum(body, at)
                v = strings[v] if tag == STRING else tuples[v] if tag == TUPLE else v
            yield tag, v

    return build(tokens())


KINDS = {NUMBER: "floats", STRING: "strings", LIST: "list_lengths"}


class SharedTables:
    """The trained dictionary: for each kind of value its shared values, by index and by value."""

    def __init__(self, values: dict[str, list] | None = None):
        self.values = {kind: list((values or {}).get(kind, [])) for kind in KINDS.values()}
        self.places = {kind: {codecs.bytes_of_float(v) if kind == "floats" else v: i for i, v in enumerate(held)} for kind, held in self.values.items()}


NOTHING_SHARED = SharedTables()
MOST_SHARED = 1_000_000  # values of a trained dictionary, which every task holds


#: Kind of a token -> kind of its stream.
TRAINED = {"string_literal": "strings", "float": "floats", "list_length": "list_lengths"}


def train_tables(tokens: DataFrame, threshold: int, most: int = MOST_SHARED) -> SharedTables:
    """The values that more than threshold files have, of tokens (file_id, kind, value_str, value_num), in order of value.

    More than `most` of them are refused: a higher threshold is needed then."""
    return shared_tables(file_frequency(tokens, "kind", "value_str", "value_num"), threshold, most)


def train_files(files: DataFrame, threshold: int, most: int = MOST_SHARED) -> SharedTables:
    """train_tables of the tokens of files (file_id, json), which are counted where they are read."""
    parts = count_tokens(files, 0, *TRAINED)
    # Numbers are grouped as texts: as numbers 0 and -0 would be one, with the files of both added up.
    total = parts.groupBy("kind", "value_str", F.col("value_num").cast("string").alias("_n")).agg(F.sum("files").alias("files"), F.first("value_num").alias("value_num"))
    return shared_tables(total, threshold, most)


def shared_tables(used: DataFrame, threshold: int, most: int = MOST_SHARED) -> SharedTables:
    """The shared values of counts (kind, value_str, value_num, files)."""
    found = used.where(F.col("kind").isin(*TRAINED) & (F.col("files") > threshold))
    rows = found.select("kind", "value_str", "value_num").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} shared values")
    held: dict[str, list] = {kind: [] for kind in TRAINED.values()}
    for r in rows:
        held[TRAINED[r["kind"]]].append(r["value_str"] if r["kind"] == "string_literal" else int(r["value_num"]) if r["kind"] == "list_length" else r["value_num"])
    return SharedTables({kind: sorted(values) for kind, values in held.items()})


def encode_streams(tree: object, codec: str = "gzip", windows: dict[str, int] = WINDOWS, shared: SharedTables = NOTHING_SHARED) -> bytes:
    """Values of each kind that are not shared, in order of first use, as its prelude; references to both as its content."""
    tokens = list(shape(tree))
    tuples = list(dict.fromkeys(v for t, v in tokens if t == TUPLE))
    place = {t: i for i, t in enumerate(tuples)}
    main = b"".join(bytes([tag]) + (codecs.write_varnum(place[v]) if tag == TUPLE else b"") for tag, v in tokens)
    prelude, content = {"tuples": codecs.write_varuint(len(tuples)) + b"".join(codecs.write_strings(list(t)) for t in tuples)}, {}
    for tag, kind in KINDS.items():
        values = [codecs.bytes_of_float(v) if tag == NUMBER else v for t, v in tokens if t == tag]  # numbers by their bits
        known = shared.places[kind]
        first = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if v not in known))}
        refs = References(windows[kind], len(first), len(known))
        content[kind] = b"".join(codecs.write_varnum(refs.encode(("shared", known[v]) if v in known else ("prelude", first[v]))) for v in values)
        held = list(first)
        prelude[kind] = codecs.write_strings(held) if tag == STRING else b"".join(held) if tag == NUMBER else b"".join(map(codecs.write_varnum, held))
    return write_sections({"prelude": prelude, "content": content, "main": {"shape": main}}, codec)


def decode_streams(data: bytes, windows: dict[str, int] = WINDOWS, shared: SharedTables = NOTHING_SHARED) -> object:
    """The tree; windows and shared must be those of the writer."""
    s = read_sections(data)
    streams = {}
    for tag, kind in KINDS.items():
        raw = s["prelude"][kind]
        if tag == STRING:
            held, _ = codecs.read_strings(raw)
        elif tag == NUMBER:
            held = [codecs.float_of_bytes(raw[i : i + 8]) for i in range(0, len(raw), 8)]
        else:
            held = list(_varnums(raw))
        refs = References(windows[kind], len(held), len(shared.values[kind]))
        found = (refs.decode(c) for c in _varnums(s["content"][kind]))
        streams[tag] = iter([held[i] if origin == "prelude" else shared.values[kind][i] for origin, i in found])
    n, at = codecs.read_varuint(s["prelude"]["tuples"])
    tuples = []
    for _ in range(n):
        own, at = codecs.read_strings(s["prelude"]["tuples"], at)
        tuples.append(tuple(own))

    def tokens():
        main, at = s["main"]["shape"], 0
        while at < len(main):
            tag = main[at]
            at += 1
            if tag == TUPLE:
                i, at = codecs.read_varnum(main, at)
                yield tag, tuples[i]
            else:
                yield tag, next(streams[tag]) if tag in streams else None

    return build(tokens())


def _varnums(data: bytes) -> Iterator[int]:
    at = 0
    while at < len(data):
        v, at = codecs.read_varnum(data, at)
        yield v


def to_xml(tree: object) -> str:
    """A readable dump: an element for each value, without recursion."""
    out, todo = [], [(tree, None)]
    while todo:
        v, name = todo.pop()
        field = f" field={quoteattr(name)}" if name else ""
        if isinstance(v, str) and name == "/":
            out.append(f"</{v}>")
        elif isinstance(v, dict):
            out.append(f"<{v['type']}{field}>")
            todo.append((v["type"], "/"))
            todo += [(x, k) for k, x in reversed(v.items()) if k != "type"]
        elif isinstance(v, list):
            out.append(f'<list{field} length="{len(v)}">')
            todo.append(("list", "/"))
            todo += [(x, None) for x in reversed(v)]
        else:
            out.append(f"<value{field}>" + json.dumps(v, ensure_ascii=False).replace("&", "&amp;").replace("<", "&lt;") + "</value>")
    return "".join(out)


#: What readers raise on damaged files.
BROKEN = (ValueError, TypeError, KeyError, IndexError, AttributeError, EOFError, OverflowError, RecursionError, StopIteration, OSError, struct.error, zlib.error)


def _no_reader(_: bytes) -> object:
    raise ValueError("xml is written only")


#: name -> (write, read)
FORMATS: dict[str, tuple[Callable[[object], bytes], Callable[[bytes], object]]] = {
    "multipart": (encode_multipart, decode_multipart),
    "streams": (encode_streams, decode_streams),
    "json": (lambda t: json.dumps(to_tagged(t)).encode(), lambda b: from_tagged(json.loads(b))),
    "xml": (lambda t: to_xml(t).encode(), _no_reader),
}


def encode_files(files: DataFrame, name: str = "multipart", shared: SharedTables | None = None, keep: str | None = None) -> DataFrame:
    """(file_id, content) of files (file_id, json); texts that are no JSON, or nested too deeply, are skipped. shared: for streams only. keep: as in map_texts."""
    write = FORMATS[name][0] if shared is None else lambda tree: encode_streams(tree, shared=shared)
    return map_texts(files, lambda text: write(json.loads(text)), (ValueError, TypeError, KeyError, RecursionError), made="content", keep=keep)


def decode_files(files: DataFrame, name: str = "multipart", shared: SharedTables | None = None, keep: str | None = None) -> DataFrame:
    """(file_id, json) of encoded files (file_id, content); a file that cannot be read is skipped. keep: as in map_texts."""
    read = FORMATS[name][1] if shared is None else lambda data: decode_streams(data, shared=shared)
    return map_texts(files, lambda content: json.dumps(read(content)), BROKEN, source="content", keep=keep)
