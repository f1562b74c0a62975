"""Which rules a note can match at all: one automaton over the literals that the rules need.

Every rule of the tables holds literals of which a match must contain at least one ("placenta", "svd", ...). They are
taken from the parsed pattern: of the parts of a sequence the one whose literals are longest, of alternatives all. The
literals of all rules make one Aho-Corasick automaton, so a note is read once, and only the rules whose literals it
holds are run on it. A rule without such literals always runs. So does every rule on a text with one of the few
characters that case folding maps to ASCII letters, since the automaton reads lower case.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters beyond ASCII that match an ASCII letter when case is ignored.
FOLDED = "İıſK"
#: A mask is a long; its sign bit stays free.
MOST_RULES = 63


def _sequence(items) -> frozenset[str] | None:
    """Literals of which every match of the sequence holds one; None if there are none."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if op is sre.SUBPATTERN:
            inner = _sequence(value[-1])
        elif op is sre.BRANCH:
            parts = [_sequence(p) for p in value[1]]
            inner = frozenset().union(*parts) if all(p is not None for p in parts) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _sequence(value[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which each match of ``pattern`` (case ignored) holds at least one; None: there are none."""
    found = _sequence(parser.parse(pattern))
    return found if found and all(x.isascii() for x in found) else None


@lru_cache(maxsize=8)
def automaton(patterns: tuple[str, ...]):
    """(automaton, mask of the rules that always run); a literal's value is the mask of the rules that it is needed by."""
    import ahocorasick

    if len(patterns) > MOST_RULES:
        raise ValueError(f"an index holds {MOST_RULES} rules at most")
    masks: dict[str, int] = {}
    always = 0
    for i, p in enumerate(patterns):
        literals = required_literals(p)
        if literals is None:
            always |= 1 << i
        for x in literals or ():
            masks[x] = masks.get(x, 0) | 1 << i
    found = ahocorasick.Automaton()
    for x, mask in masks.items():
        found.add_word(x, mask)
    found.make_automaton()
    return found, always


def possible(text: str, patterns: tuple[str, ...]) -> int:
    """The mask of the rules that ``text`` may match."""
    found, always = automaton(patterns)
    every = (1 << len(patterns)) - 1
    if not text.isascii() and any(c in text for c in FOLDED):
        return every
    mask = always
    if len(found):
        for _, rules in found.iter(text.lower()):
            mask |= rules
            if mask == every:
                break
    return mask


def possible_rules(text: Column, patterns: list[str]) -> Column:
    """Mask (bigint) of the rules of ``patterns`` that a text may match, by one pass; null text: 0."""
    patterns = tuple(patterns)

    @F.arrow_udf("bigint")
    def masks(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else possible(t, patterns) for t in texts.to_pylist()], pa.int64())

    return masks(text)


def may_match(mask: Column, rule: int) -> Column:
    """Whether the bit of a rule is set."""
    return F.getbit(mask, F.lit(rule)) == 1
