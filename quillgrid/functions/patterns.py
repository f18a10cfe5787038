"""Which regular expressions a profile may use: those that can't take very long on a text."""

import re
import re._parser as sre_parse

from ..constants import MAX_PATTERN_LENGTH

MAX_DEGREE = 2


def problem_of(pattern: str) -> str | None:
    """Why a pattern is refused: too-long, invalid, nested-repeat (an unbounded repeat inside another), overlap (a repeat of
    alternatives that may begin alike), or backtracking (more than two unbounded repeats in a row that may match the same text); None: it isn't."""
    if len(pattern) > MAX_PATTERN_LENGTH:
        return "too-long"
    try:
        tree = sre_parse.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return "invalid"
    return _walk(tree, False)


def _parts(op, arg) -> list:
    """The sub-patterns of a node."""
    if op is sre_parse.BRANCH:
        return list(arg[1])
    if op is sre_parse.SUBPATTERN:
        return [arg[3]]
    if op in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT):
        return [arg[2]]
    if op in (sre_parse.ASSERT, sre_parse.ASSERT_NOT):
        return [arg[1]]
    return []


def _unbounded(op, arg) -> bool:
    return op in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT) and arg[1] is sre_parse.MAXREPEAT


def _walk(tree, inside: bool) -> str | None:
    row: list[set] = []
    for op, arg in tree:
        loop = _unbounded(op, arg)
        if loop and inside:
            return "nested-repeat"
        if loop and any(o is sre_parse.BRANCH and _alike(a[1]) for o, a in _nodes(arg[2])):
            return "overlap"
        for part in _parts(op, arg):
            if problem := _walk(part, inside or loop):
                return problem
        first = _firsts([(op, arg)])
        row = [r for r in row if r & first] + [first] if loop else [r for r in row if r & first]
        if len(row) > MAX_DEGREE:
            return "backtracking"
    return None


def _nodes(tree):
    for op, arg in tree:
        yield op, arg
        for part in _parts(op, arg):
            yield from _nodes(part)


def _alike(branches) -> bool:
    seen: set = set()
    for b in branches:
        first = _firsts(b)
        if seen & first:
            return True
        seen |= first
    return False


def _firsts(tree) -> set[int]:
    """The ASCII characters that a pattern may begin with."""
    out: set[int] = set()
    for op, arg in tree:
        if op is sre_parse.LITERAL:
            return out | {min(arg, 128)}
        if op is sre_parse.NOT_LITERAL:
            return out | (set(range(129)) - {arg})
        if op is sre_parse.ANY:
            return out | set(range(129))
        if op is sre_parse.IN:
            return out | {k for k in range(129) if _in_set(arg, k)}
        if op is sre_parse.BRANCH:
            return out | set().union(*map(_firsts, arg[1]))
        if op is sre_parse.SUBPATTERN:
            out |= _firsts(arg[3])
            return out
        if op in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT):
            out |= _firsts(arg[2])
            if arg[0]:
                return out
    return out


def _in_set(items, k: int) -> bool:
    c, hit, turn = chr(k), False, False
    tests = {"CATEGORY_DIGIT": str.isdigit, "CATEGORY_SPACE": str.isspace, "CATEGORY_WORD": lambda x: x.isalnum() or x == "_"}
    for op, arg in items:
        if op is sre_parse.NEGATE:
            turn = True
        elif op is sre_parse.LITERAL:
            hit |= min(arg, 128) == k
        elif op is sre_parse.RANGE:
            hit |= min(arg[0], 128) <= k <= min(arg[1], 128)
        else:
            name = str(arg).replace("NOT_", "")
            hit |= tests.get(name, lambda x: True)(c) != ("NOT_" in str(arg))
    return hit != turn
