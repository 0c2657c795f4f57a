"""Elements of arrays in JSON documents of any size, without any whole document in memory.

A document is read as text that ends its records at commas, so Spark's own reader splits it over tasks, in any file system
and wherever its line ends are.  A split therefore begins right after a comma, but whether that stands in a string, and in
which arrays and objects, only what comes before can tell.  So there are two passes:

1. Each split of a document with more than one is summed up, once as if it began outside of strings and once as if within
   one: what it closes that was open before, and what it leaves open (``Summary``).  Going through a document's sums in
   order gives every split's true beginning.  They are a few bytes for each split, and only for large documents.
2. Each split follows its brackets from there and gives the elements that begin and end in it.  An element that a split
   cuts is given in pieces, at most one piece of it a split, and the pieces are put together.

A task holds an Arrow batch of text, one element and the open brackets.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.graph import written

#: Bytes of elements that a task gives together.
GIVEN = 4 << 20
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\],]', re.S)
_STRING = rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _balanced(depth: int) -> bytes:
    inner = rb"(?:[^\"{}\[\]]++|" + _STRING + (b"|" + _balanced(depth - 1) if depth else b"") + rb")*+"
    return rb"(?:\{" + inner + rb"\}|\[" + inner + rb"\])"


#: Tokens, but objects and arrays that are whole and not deep are one, in a group.
_SUMMED = re.compile(b"(" + _balanced(5) + b")|" + _TOKEN.pattern, re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STEP = re.compile(r"\.?([^.\[\]]+)|\[(\d*)\]")
_OPENS = {b"}": b"{", b"]": b"["}

Steps = list[str | int | None]


def steps(path: str) -> Steps:
    """The steps of a path such as ``runs[0].results[]``: names, numbers, None for every element."""
    return [m[1] if m[1] is not None else int(m[2]) if m[2] else None for m in _STEP.finditer(path)]


@dataclass(slots=True)
class Bracket:
    """An object or array that is open: the string read last in it (a member's name, when its value begins), or its commas."""

    kind: bytes
    name: str | None = None
    commas: int = 0


def _holds(stack: list[Bracket], path: Steps) -> bool:
    return len(stack) == len(path) and all(x.name == step if x.kind == b"{" else not isinstance(step, str) and step in (None, x.commas) for x, step in zip(stack, path))


def _name(raw: bytes) -> str | None:
    return raw[1:-1].decode("utf-8", "replace") if len(raw) <= 200 else None


class Lexer:
    """Brackets, commas and whole strings of a text that comes in parts; ``summed``: but for what whole objects and arrays hold."""

    def __init__(self, in_string: bool, summed: bool = False):
        self.in_string, self.held, self.token = in_string, b"", _SUMMED if summed else _TOKEN

    def take(self, text: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The text up to a string that is still open, and (place, token) in it; the rest is held for the next part."""
        text, self.held, at, found = self.held + text, b"", 0, []
        if self.in_string:
            if not (m := _REST.match(text)):
                self.held = text
                return b"", found
            self.in_string, at = False, m.end()
        for m in self.token.finditer(text, at):
            if m.lastindex:
                continue
            if m[0] == b'"':
                self.held = text[m.start() :]
                return text[: m.start()], found
            found.append((m.start(), m[0]))
        return text, found

    @property
    def open(self) -> bool:
        return self.in_string or bool(self.held)


@dataclass
class Summary:
    """What a split does to the brackets around it: it closes ``closed`` of them, in this order; then it adds ``commas`` to, and
    reads ``name`` last in, the innermost one that is left; and it leaves ``left`` open, and a string or not."""

    closed: list[bytes] = field(default_factory=list)
    commas: int = 0
    name: str | None = None
    left: list[Bracket] = field(default_factory=list)
    in_string: bool = False
    fault: bool = False

    def add(self, token: bytes) -> None:
        if token in _OPENS:
            if not self.left:
                self.closed.append(token)
                self.commas, self.name = 0, None
            elif self.left.pop().kind != _OPENS[token]:
                self.fault = True
        elif token in (b"{", b"["):
            self.left.append(Bracket(token))
        elif token == b",":
            inner = self.left[-1] if self.left else self
            inner.commas += 1
        else:
            inner = self.left[-1] if self.left else self
            inner.name = _name(token)

    def apply(self, stack: list[Bracket]) -> list[Bracket] | None:
        """The brackets after the split; None where it closes what isn't open."""
        stack = [Bracket(x.kind, x.name, x.commas) for x in stack]
        for closer in self.closed:
            if not stack or stack.pop().kind != _OPENS[closer]:
                return None
        if stack:
            stack[-1].commas += self.commas
            stack[-1].name = self.name if self.name is not None else stack[-1].name
        return None if self.fault else stack + self.left


class Split:
    """The text of a split, given in parts; it begins after a comma and, but for a document's last one, ends with one."""

    def __init__(self, last: bool):
        self.last, self.first = last, True

    def feed(self, pieces: list[bytes]) -> None:
        self.take((b"" if self.first else b",") + b",".join(pieces))
        self.first = False

    def close(self) -> None:
        if not self.last:
            self.take(b",")


class Summing(Split):
    """Both summaries of a split: as if it began outside of strings, and within one."""

    def __init__(self, last: bool):
        super().__init__(last)
        self.both = [(Lexer(inside, summed=True), Summary()) for inside in (False, True)]

    def take(self, text: bytes) -> None:
        for lexer, summary in self.both:
            for _, token in lexer.take(text)[1]:
                summary.add(token)

    def end(self) -> None:
        self.close()
        for lexer, summary in self.both:
            summary.in_string = lexer.open
        self.sums = [summary for _, summary in self.both]


@dataclass
class Beginning:
    """How a split begins: the open brackets, in a string or not, in an element of ``inside`` that began in split ``of``."""

    stack: list[Bracket] = field(default_factory=list)
    in_string: bool = False
    inside: str | None = None
    of: int | None = None


class Reader(Split):
    """Follows a split from its true beginning; ``found`` gets (target, number, piece, begins, ends) of elements and pieces."""

    def __init__(self, targets: dict[str, Steps], begin: Beginning, last: bool, whole: bool):
        super().__init__(last)
        self.targets, self.depths, self.whole = targets, {len(path) for path in targets.values()}, whole
        self.stack, self.lexer = [Bracket(x.kind, x.name, x.commas) for x in begin.stack], Lexer(begin.in_string)
        self.found: list[tuple[str, int, bytes, bool, bool]] = []
        self.number, self.error, self.ended = 0, None, False
        self.held: list[bytes] = []
        self.inside, self.begins = begin.inside, False
        if self.inside is None:
            self._maybe()

    def _maybe(self) -> None:
        """Behind a bracket or comma: whether an element of a target may begin here."""
        if len(self.stack) in self.depths:
            self.inside = next((name for name, path in self.targets.items() if _holds(self.stack, path)), None)
            self.begins, self.held = True, []

    def _give(self, ends: bool) -> None:
        text = b"".join(self.held)
        if not self.begins or text.strip():
            self.number += self.begins
            self.found.append((self.inside, self.number if self.begins else 0, text, self.begins, ends))
        self.inside, self.held = None, []

    def take(self, text: bytes) -> None:
        if self.error:
            return
        text, tokens = self.lexer.take(text)
        stack, start, outer = self.stack, 0, 0
        for at, token in tokens:
            if not stack and (token[:1] == b'"' or text[outer:at].strip()):
                self.error = "text outside of the document"
                return
            if token[:1] == b'"':
                stack[-1].name = _name(token)
                continue
            if self.inside and token in (b",", b"]") and len(stack) == len(self.targets[self.inside]):
                self.held.append(text[start:at])
                self._give(True)
            if token in _OPENS:
                if not stack or stack.pop().kind != _OPENS[token]:
                    self.error = "a bracket closes what isn't open"
                    return
                self.ended, outer = not stack, at + 1
                continue
            if token == b",":
                if not stack:
                    self.error = "text outside of the document"
                    return
                stack[-1].commas += 1
            else:
                if self.ended:
                    self.error = "more than one document"
                    return
                stack.append(Bracket(token))
            if not self.inside:
                self._maybe()
                start = at + 1
        if self.inside:
            self.held.append(text[start:])
        if not stack and text[outer:].strip():
            self.error = "text outside of the document"

    def end(self) -> None:
        self.close()
        if self.error:
            return
        if self.inside:
            self.held.append(self.lexer.held)
            self._give(False)
        if self.last and (self.stack or self.lexer.open or self.whole and not self.ended):
            self.error = "the document ends early"


def beginnings(sums: list[tuple[int, list[Summary]]], targets: dict[str, Steps]) -> Iterator[tuple[int, Beginning | None]]:
    """(place, beginning) of a document's splits in order, from their places and summaries; None behind a fault."""
    now: Beginning | None = Beginning()
    for place, both in sorted(sums, key=lambda x: x[0]):
        yield place, now
        if now is None:
            continue
        done = both[now.in_string]
        if (stack := done.apply(now.stack)) is None:
            now = None
            continue
        after = Beginning(stack, done.in_string)
        for name, path in targets.items():
            depth = len(path)
            if len(stack) >= depth and _holds(stack[:depth], path) and (len(stack) > depth or done.in_string):
                kept = len(now.stack) - len(done.closed)
                same = now.inside == name and (kept > depth or kept == depth and not done.commas)
                after.inside, after.of = name, now.of if same else place
        now = after


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bool, bool, list[bytes]]]:
    """((file, begin), last, part, pieces) of the neighbouring rows of one split."""
    if not len(batch):
        return
    begin, file = batch.column("begin").to_numpy(), batch.column("file").dictionary_encode()
    code = file.indices.to_numpy()
    edges = np.flatnonzero((np.diff(begin) != 0) | (np.diff(code) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
        yield (file.dictionary[int(code[a])].as_py(), int(begin[a])), batch.column("last")[a].as_py(), batch.column("part")[a].as_py(), batch.column("value").slice(a, b - a).to_pylist()


def _splits(batches: Iterator[pa.RecordBatch], made) -> Iterator[tuple[tuple[str, int], Split, bool]]:
    """(place, split, whether it has ended) after each stretch of rows that the splits of a task are fed."""
    place, split = None, None
    for batch in batches:
        for now, last, part, pieces in _runs(batch):
            if now != place:
                if split:
                    split.end()
                    yield place, split, True
                place, split = now, made(now, last, part)
            if split:
                split.feed(pieces)
                yield place, split, False
    if split:
        split.end()
        yield place, split, True


def read_elements(spark: SparkSession, paths: str | list[str], targets: dict[str, str]) -> DataFrame:
    """(file, target, at, value, error): the elements of the arrays that ``targets`` names (name -> path), as JSON text.

    ``at`` rises in the order of a document.  A document that breaks off, or closes what isn't open, gives the whole elements
    before that and one row with ``error``, whose ``at`` is behind theirs; so does one that is no object or array.  Empty
    arrays and other members give nothing, and neither do empty files.  No target may lie in an element of another.
    Runs both passes when it is called: the first, over documents of several splits, is one job.
    """
    parsed = {name: steps(path) for name, path in targets.items()}
    meta = [F.col(f"_metadata.file_{x}") for x in ("path", "block_start", "block_length", "size")]
    raw = spark.read.option("lineSep", ",").text(paths).select(*(c.alias(n) for c, n in zip(meta, ("file", "begin", "length", "size"))), F.col("value").cast("binary").alias("value"))
    raw = raw.select("file", "begin", (F.col("begin") + F.col("length") >= F.col("size")).alias("last"), (F.col("length") < F.col("size")).alias("part"), "value")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, begin), split, ended in _splits(batches, lambda place, last, part: Summing(last)):
            if ended:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), pa.array([pickle.dumps(split.sums)], pa.binary())], ["file", "begin", "sums"])

    by: dict[str, list] = {}
    for r in raw.where("part").mapInArrow(summed, "file string, begin long, sums binary").collect():  # a row a split, all in one job
        by.setdefault(r.file, []).append((r.begin, pickle.loads(r.sums)))
    sent = spark.sparkContext.broadcast({(file, place): begin for file, sums in by.items() for place, begin in beginnings(sums, parsed)})
    names = ["file", "target", "at", "of", "value", "begins", "ends", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made(place: tuple[str, int], last: bool, part: bool) -> Reader | None:
            begin = sent.value.get(place) if part else Beginning()
            return Reader(parsed, begin, last, not part) if begin else None

        for (file, begin), split, ended in _splits(batches, made):
            of = sent.value[file, begin].of if (file, begin) in sent.value else None
            rows += [(file, target, begin + no, begin if begins else of, text, begins, ends, None) for target, no, text, begins, ends in split.found]
            split.found.clear()
            if ended and split.error:
                rows.append((file, None, begin + split.number + 1, None, None, True, True, split.error))
            if rows and (ended or sum(len(r[4] or b"") for r in rows) > GIVEN):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []

    # written, else whole and cut elements would each read the documents
    got = written(raw.mapInArrow(read, "file string, target string, at long, of long, value binary, begins boolean, ends boolean, error string"), "elements")
    whole = got.where("begins AND ends").select("file", "target", "at", F.col("value").cast("string").alias("value"), "error")
    # elements that splits have cut: as many rows as there are splits; one without an end is where the document breaks off
    cut = got.where("NOT (begins AND ends)").groupBy("file", "target", "of").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("value").alias("value")))).alias("p"), F.bool_or("ends").alias("ends")).where("ends")
    text = F.unhex(F.array_join(F.transform("p", lambda x: x["value"]), "")).cast("string")
    cut = cut.select("file", "target", F.get("p", F.lit(0))["at"].alias("at"), text.alias("value"), F.lit(None).cast("string").alias("error"))
    return whole.unionByName(cut)
