"""Operators whose result depends on the order of a file's values.

Each file's stream (of one kind) is one group, held and sorted by seq in the group's
task; what the operators keep besides is a window or the stream's distinct values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .huffman import code_lengths

SWITCH_COST = 4  # estimated bits of a change of code between blocks


def mru_ages(values: Iterable[Hashable]) -> Iterator[tuple[bool, int]]:
    """(seen, n): for a value seen before, how many distinct ones came since; else how many came at all."""
    recent: list[Hashable] = []
    for v in values:
        try:
            i = recent.index(v)
        except ValueError:
            yield False, len(recent)
        else:
            yield True, i
            del recent[i]
        recent.insert(0, v)


class Recall:
    """The last `width` distinct values, the latest first."""

    def __init__(self, width: int):
        self.width, self.held = width, []

    def use(self, v: Hashable) -> int | None:
        """The place v had, or None; v becomes the latest."""
        if self.width == 0:
            return None
        place = self.held.index(v) if v in self.held else None
        if place is not None:
            del self.held[place]
        self.held.insert(0, v)
        del self.held[self.width :]
        return place

    def at(self, place: int) -> Hashable:
        return self.held[place]


class References:
    """References to a prelude and a shared table as numbers, and back.

    0: the next of the prelude; then the recall window; then the prelude; then
    shared references in the order they were first met; then all shared ones."""

    def __init__(self, window: int, prelude: int, shared: int):
        self.recall, self.window, self.prelude, self.shared = Recall(window), window, prelude, shared
        self.next, self.met, self.order = 0, {}, []

    def encode(self, ref: tuple[str, int]) -> int:
        place = self.recall.use(ref)
        kind, i = ref
        if kind == "prelude":
            expected, self.next = self.next, i + 1
            if i == expected:
                return 0
            return self.window + 1 + i if place is None else place + 1
        if place is not None:
            return place + 1
        base = self.window + self.prelude + 1
        if ref in self.met:
            return base + self.met[ref]
        self.met[ref] = len(self.met)
        return base + self.met[ref] + i

    def decode(self, code: int) -> tuple[str, int]:
        ref = self._decode(code)
        self.recall.use(ref)
        if ref[0] == "prelude":
            self.next = ref[1] + 1
        return ref

    def _decode(self, code: int) -> tuple[str, int]:
        if code == 0:
            return "prelude", self.next
        code -= 1
        if code < self.window:
            return self.recall.at(code)
        code -= self.window
        if code < self.prelude:
            return "prelude", code
        code -= self.prelude
        if code < len(self.met):
            return self.order[code]
        ref = "shared", code - len(self.met)
        if ref[1] >= self.shared:
            raise ValueError("reference beyond the shared table")
        self.met[ref] = len(self.met)
        self.order.append(ref)
        return ref


def _grouped(tokens: DataFrame, keys: list[str], columns: list[str], schema: str, run) -> DataFrame:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        return pdf.assign(**run(pdf))

    kept = tokens.select(*keys, "seq", *columns)
    return kept.groupBy(*keys).applyInPandas(group, schema)


def mru(tokens: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """Adds seen and age to (keys, seq, value); shape: the schema of these."""

    def run(pdf):
        seen, age = zip(*mru_ages(pdf["value"]), strict=True)
        return {"seen": list(seen), "age": list(age)}

    return _grouped(tokens, keys, ["value"], f"{shape}, seen boolean, age long", run)


def lru(tokens: DataFrame, keys: list[str], shape: str, width: int) -> DataFrame:
    """Adds place: that of the value among the last width distinct ones, or -1."""

    def run(pdf):
        window = Recall(width)
        places = (window.use(v) for v in pdf["value"])
        return {"place": [-1 if p is None else p for p in places]}

    return _grouped(tokens, keys, ["value"], f"{shape}, place long", run)


def encode_references(tokens: DataFrame, keys: list[str], shape: str, window: int, shared: int) -> DataFrame:
    """Adds code to (keys, seq, origin, idx); the prelude of a stream has all it refers to there."""

    def run(pdf):
        own = pdf[pdf["origin"] == "prelude"]["idx"]
        refs = References(window, 0 if own.empty else int(own.max()) + 1, shared)
        return {"code": [refs.encode((o, int(i))) for o, i in zip(pdf["origin"], pdf["idx"], strict=True)]}

    return _grouped(tokens, keys, ["origin", "idx"], f"{shape}, code long", run)


def decode_references(coded: DataFrame, keys: list[str], shape: str, window: int, shared: int) -> DataFrame:
    """Adds d_origin and d_idx to (keys, seq, prelude, code, and what else shape names); prelude: the length of the stream's prelude."""

    def run(pdf):
        refs = References(window, int(pdf["prelude"].iloc[0]), shared)
        found = [refs.decode(int(c)) for c in pdf["code"]]
        return {"d_origin": [f[0] for f in found], "d_idx": [f[1] for f in found]}

    names = [f.split()[0] for f in shape.split(", ")]
    return _grouped(coded, keys, [n for n in names if n not in (*keys, "seq")], f"{shape}, d_origin string, d_idx long", run)


def window_predictions(tokens: DataFrame, keys: list[str], shape: str, width: int) -> DataFrame:
    """Adds symbol: `back:i` for the value i places back among the last width distinct ones, else `dict:i`, its number in order of first use."""

    def run(pdf):
        window, numbers, out = Recall(width), {}, []
        for v in pdf["value"]:
            place = window.use(v)
            number = numbers.setdefault(v, len(numbers))
            out.append(f"dict:{number}" if place is None else f"back:{place}")
        return {"symbol": out}

    return _grouped(tokens, keys, ["value"], f"{shape}, symbol string", run)


def import_order(tokens: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, idx): the rank of each shared reference by when the group first refers to it."""
    from .tokens import first_seen

    return first_seen(tokens, group, value).select(group, value, "idx")


def _block_cost(counts: Counter, start: int, end: int) -> float:
    lengths = code_lengths(counts)
    return sum(n * lengths[s] for s, n in counts.items()) + math.log2(end - start) + SWITCH_COST


def split_blocks(values: list[Hashable]) -> list[tuple[int, int]]:
    """(start, end) of blocks with a code each: neighbours are merged, the best pair first, while the cost falls."""
    blocks = [(i, i + 1, Counter([v])) for i, v in enumerate(values)]
    costs = [_block_cost(c, a, b) for a, b, c in blocks]

    def gain(i: int) -> float:
        (a, _, x), (_, b, y) = blocks[i], blocks[i + 1]
        return _block_cost(x + y, a, b) - costs[i] - costs[i + 1]

    gains = [gain(i) for i in range(len(blocks) - 1)]
    while gains:
        i = min(range(len(gains)), key=gains.__getitem__)
        if gains[i] >= 0:
            break
        (a, _, x), (_, b, y) = blocks[i], blocks[i + 1]
        costs[i : i + 2] = [costs[i] + costs[i + 1] + gains[i]]
        blocks[i : i + 2] = [(a, b, x + y)]
        del gains[i]
        for k in (i - 1, i):
            if 0 <= k < len(gains):
                gains[k] = gain(k)
    return [(a, b) for a, b, _ in blocks]


def blocks(tokens: DataFrame, key: str, key_type: str) -> DataFrame:
    """(key, start, end): the blocks of each stream."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        found = split_blocks(list(pdf["value"]))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "start": [a for a, _ in found], "end": [b for _, b in found]})

    return tokens.select(key, "seq", "value").groupBy(key).applyInPandas(group, f"{key} {key_type}, start long, end long")


def lru_histogram(places: DataFrame) -> DataFrame:
    return places.groupBy("place").agg(F.count("*").alias("n"))
