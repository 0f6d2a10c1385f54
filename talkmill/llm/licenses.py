"""License scan: one Aho-Corasick pass over each text's words, and a shunting-yard reading of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, LOWER, slices, text_bytes

#: Phrases that the base labels rest on.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices: (phrase, label, weight of evidence).
NOTICES = (
    ("permission is hereby granted free of charge", "mit", 0.9), ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("bsd license", "bsd", 0.7), ("mozilla public license", "mpl", 0.8), ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9), ("eclipse public license", "epl", 0.8), ("isc license", "isc", 0.8),
    ("creative commons attribution", "cc-by", 0.7), ("cc0", "cc0", 0.6), ("all rights reserved", "proprietary", 0.4), ("public domain", "public-domain", 0.4),
)
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95
TAG = "spdx license identifier"
#: An identifier is its family's name, then a version, a number of clauses or a variant: what stands before the first
#: part that begins with a digit, or that is one of these words.
_PART = re.compile(r"-(?=\d|only$|or-later$|clause|no-|style|modern|variant)")
#: What follows a tag on its line.
_EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of any public identifier: its family's name (gpl-2.0-or-later: gpl, bsd-3-clause: bsd, cc-by-sa-4.0: cc-by-sa, 0bsd, zlib and the like: themselves)."""
    return _PART.split(identifier.rstrip("+"), maxsplit=1)[0]


_BLANKS = re.compile(r"[ \t]*")


def parse_expression(text: str) -> list[str] | None:
    """The licence expression that text begins with, in postfix order; None if there is none.

    Shunting-yard: with binds closest, then and, then or. Reading stops where an operand or operator cannot follow
    (the rest is prose), and takes back operators or brackets left open.
    """
    out: list[str] = []
    waiting: list[str] = []
    best: tuple[int, list[str]] | None = None
    operand, open_ = True, 0
    at = 0
    while found := _TOKEN.match(text, at):
        token = found[0]
        at = _BLANKS.match(text, found.end()).end()
        if operand:
            if token == "(":
                waiting.append(token)
                open_ += 1
                continue
            if token == ")" or token in _BINDS:
                break
            out.append(token)
            operand = False
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif token == ")" and open_:
            open_ -= 1
            while (x := waiting.pop()) != "(":
                out.append(x)
        else:
            break
        if not operand and not open_:
            # What is out stays out, and no more than one operator of each strength waits.
            best = len(out), waiting[::-1]
    return best and out[: best[0]] + best[1]


class Term(NamedTuple):
    """A value on the evaluation stack. choices: the sets of licences of which one must be kept to, None where there
    would be too many; need: licences that all choices share; may: all of them; text: the expression
    with brackets where they matter; binds: of its outermost operator."""

    choices: frozenset[frozenset[str]] | None
    need: frozenset[str]
    may: frozenset[str]
    text: str
    binds: int


#: Choices that are listed; what all of them ask for, and what any may, is known whatever their number.
MOST_CHOICES = 64


def evaluate(postfix: list[str], most: int = MOST_CHOICES) -> Term:
    """What an expression asks for: or joins the choices of its sides, and combines each with each, with names an exception.

    A choice that asks for more than another does is dropped; beyond `most`, or most ** 2 licences beside need in all of
    them, they are not listed. need and may are exact at any size: what an or needs is what both sides need, what an and
    needs is what either does. A choice is held as what it has beyond need, and the smaller set goes into the larger, so
    long chains take time in proportion.
    """
    stack: list[tuple[list[frozenset[str]] | None, set[str], set[str], int, int]] = []
    # The text's parts: what an expression of the stack ends with, and brackets put before and after it once it is known to need them.
    parts: list[str] = []
    before: dict[int, int] = {}
    for token in postfix:
        if token not in _BINDS:
            stack.append(([frozenset()], {token}, {token}, len(parts), 4))
            parts.append(token)
            continue
        (more, right_need, right_may, right_at, right_binds), (choices, need, may, at, left_binds) = stack.pop(), stack.pop()
        binds = _BINDS[token]
        for first, last, inner in ((at, right_at - 1, left_binds), (right_at, len(parts) - 1, right_binds)):
            if inner < binds:
                before[first] = before.get(first, 0) + 1
                parts[last] += ")"
        if token == "with":
            name = "".join("(" * before.get(k, 0) + parts[k] for k in range(right_at, len(parts))) if right_binds == 4 else _spoken(parts, before, right_at)
            under = lambda ids: {f"{x} with {name}" for x in ids}  # noqa: E731, B023
            made = choices and [frozenset(under(c)) for c in choices]
            stack.append((made, under(need), under(may), at, binds))
        else:
            both = _joined(choices, need, more, right_need, most) if token == "or" else _combined(choices, need, more, right_need, most)
            stack.append((*both, _union(may, right_may), at, binds))
        parts[right_at] = f" {token} " + "(" * before.pop(right_at, 0) + parts[right_at]
    choices, need, may, _, binds = stack[0]
    text = _spoken(parts, before, 0)
    return Term(None if choices is None else frozenset(c | need for c in choices), frozenset(need), frozenset(may), text, binds)


def _spoken(parts: list[str], before: dict[int, int], at: int) -> str:
    return "".join("(" * before.get(k, 0) + parts[k] for k in range(at, len(parts)))


def _union(a: set[str], b: set[str]) -> set[str]:
    """Of two sets that nothing else holds."""
    if len(a) < len(b):
        a, b = b, a
    a |= b
    return a


def _least(choices: set[frozenset[str]], most: int) -> list[frozenset[str]] | None:
    kept = [c for c in choices if not any(d < c for d in choices)] if len(choices) > 1 else list(choices)
    return kept if len(kept) <= most and sum(map(len, kept)) <= most**2 else None


def _joined(a, need, b, right_need, most: int) -> tuple:
    """or: (choices beyond need, need)."""
    shared = need & right_need
    if a is None or b is None:
        return None, shared
    left, right = frozenset(need - shared), frozenset(right_need - shared)
    return _least({c | left for c in a} | {c | right for c in b}, most), shared


def _combined(a, need, b, right_need, most: int) -> tuple:
    """and: (choices beyond need, need)."""
    if a is None or b is None or len(a) * len(b) > most**2:
        return None, _union(need, right_need)
    if len(a) == len(b) == 1:
        return [frozenset()], _union(need, right_need)
    made = {frozenset(x for x in c | d if x not in need and x not in right_need) for c in a for d in b}
    return _least(made, most), _union(need, right_need)


def _name(identifier: str) -> str:
    return identifier.partition(" with ")[0]


def families(identifiers) -> set[str]:
    return {family(_name(x)) for x in identifiers} - {"none", "noassertion"}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), label, BASE_WEIGHT, True))
    for phrase, label, weight in NOTICES:
        found.add_word(f" {phrase} ", (len(phrase.split()), label, weight, False))
    found.add_word(f" {TAG} ", (0, "", 0.0, False))
    found.make_automaton()
    return found


_SPACES = bytes(int(LOWER[i]) if ALNUM[LOWER[i]] else 32 for i in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, options array<string>, required string, score double"


def scan_text(raw: bytes, most: int = MOST_CHOICES) -> tuple:
    """The row of SCHEMA for one text in UTF-8."""
    words = raw.translate(_SPACES).split()
    line = b" " + b" ".join(words) + b" "
    text = line.decode("latin-1")
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    doubt, tagged = 1.0, False
    at, seen = 0, 0
    for end, (size, label, weight, is_base) in _automaton().iter(text):
        if not size:
            tagged = True
            continue
        seen += line.count(b" ", at, end)
        at = end
        if is_base:
            base.append(seen - size)
            base_labels.add(label)
        if label not in labels:
            doubt *= 1 - weight
        labels.add(label)
    expressions, options, required = [], [], set()
    if tagged:
        for found in _EXPRESSION.finditer(raw.translate(bytes(LOWER))):
            postfix = parse_expression(found[1].decode("utf-8", "replace"))
            if postfix is None:
                continue
            value = evaluate(postfix, most)
            may, need = families(value.may), families(value.need)
            if not may:
                continue
            # A licence that every choice asks for is sure; of several that one may choose from, each is less so.
            doubt *= 1 - TAG_WEIGHT * (1 + len(need)) / (1 + len(may))
            labels.update(may)
            required.update(need)
            expressions.append(value.text)
            options.append("" if value.choices is None else " | ".join(sorted("+".join(sorted(c)) for c in value.choices)))
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        expressions, options, ",".join(sorted(required)), 1 - doubt,
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_choices: int = MOST_CHOICES) -> DataFrame:
    """One row per row of docs: doc_id and the columns of SCHEMA.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. n_base, first_word and
    last_word count the places of BASE phrases; labels adds those of NOTICES and of all licences that tagged
    expressions may end in. Expressions are evaluated: options lists the choices that each one leaves (licences of a
    choice joined by +; empty where evaluate() doesn't list so many), required the labels that every choice asks for.
    score is 1 less the product of what each label's first evidence leaves in doubt; an expression that leaves a choice
    leaves more doubt. A null or empty text has no words, null places, empty labels and score 0; a text of any length is
    scanned whole. Repeated rows are scanned alike; no rows give no rows; other columns of docs, whatever their names,
    play no part.
    """
    schema = docs.select(doc_id).schema.fields[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.float64())
        for batch in batches:
            for part in slices(batch, 1):
                raw, offset = text_bytes(part.column(1))
                data = raw.tobytes()
                rows = [scan_text(data[a:b], most_choices) for a, b in zip(offset[:-1], offset[1:], strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {schema.dataType.simpleString()}, {SCHEMA}")
