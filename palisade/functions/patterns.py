"""What is known of a pattern without a text: literals that each of its matches holds, and which side of a boundary has a word."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache, reduce
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EITHER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Spellings that a stretch of a pattern may have before its literals are given up.
MOST = 48


# ---------------------------------------------------------------- boundaries
def _edge(items: list, last: bool) -> bool:
    """Whether every match of the items, which may not be empty, begins (or ends) with an ASCII word character."""
    for op, arg in reversed(items) if last else items:
        name = str(op)
        if name == "LITERAL":
            return chr(arg) in WORD
        if name == "IN":
            return all(str(o) == "LITERAL" and chr(a) in WORD or str(o) == "RANGE" and all(chr(x) in WORD for x in range(a[0], min(a[1], 128) + 1)) and a[1] < 128 for o, a in arg)
        if name == "SUBPATTERN":
            return _edge(list(arg[3]), last)
        if name == "BRANCH":
            return all(len(x) and _edge(list(x), last) for x in arg[1])
        if name == "MAX_REPEAT":
            low, _, sub = arg
            if not _edge(list(sub), last):
                return False
            if low:
                return True
            continue  # may be absent: what stands next to it counts too
        return False
    return False


def boundaries(pattern: str) -> str:
    r"""The pattern with \b as the boundary of ASCII words. Where one side is sure to be a word, only the other is looked at."""
    pieces, out = pattern.split(r"\b"), []
    for k, piece in enumerate(pieces):
        out.append(piece)
        if k + 1 < len(pieces):
            out.append(_side(pieces, k))
    return "".join(out)


def _side(pieces: list[str], k: int) -> str:
    """The k-th boundary's form, found in the pattern with that boundary marked and the others left out."""
    marked = "".join(pieces[: k + 1]) + "" + "".join(pieces[k + 1 :])
    try:
        found = _marked(list(_parser.parse(marked)))
    except re.error:
        return EITHER
    return found or EITHER


def _marked(items: list) -> str | None:
    for k, (op, arg) in enumerate(items):
        name = str(op)
        if name == "LITERAL" and arg == 0xE000:
            return BEFORE if _edge(items[k + 1 :], False) else AFTER if _edge(items[:k], True) else None
        subs = [arg[3]] if name == "SUBPATTERN" else arg[1] if name == "BRANCH" else [arg[2]] if name in ("MAX_REPEAT", "MIN_REPEAT") else []
        for sub in subs:
            if any(str(o) == "LITERAL" and a == 0xE000 for o, a in sub) or _holds(list(sub)):
                return _marked(list(sub))
    return None


def _holds(items: list) -> bool:
    return "57344" in repr(items)


# ---------------------------------------------------------------- literals
def _spellings(items: list) -> list[str] | None:
    """All texts of the items in lower case, if they are few; looking around adds nothing."""
    now = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part: list[str] | None = [chr(arg).lower()]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = [chr(a).lower() for _, a in arg]
        elif name == "SUBPATTERN":
            part = _spellings(list(arg[3]))
        elif name == "BRANCH":
            each = [_spellings(list(x)) for x in arg[1]]
            part = None if None in each else [s for x in each for s in x or []]
        elif name == "MAX_REPEAT" and arg[0] <= arg[1] == 1:
            own = _spellings(list(arg[2]))
            part = None if own is None else own + ([""] if not arg[0] else [])
        elif name == "AT":
            part = [""]
        else:
            part = None
        if part is None or len(now) * len(part) > MOST:
            return None
        now = list(dict.fromkeys(a + b for a in now for b in part))
    return now


def _fewest(texts: list[str]) -> tuple[str, ...]:
    """Without those that hold another one."""
    return tuple(t for t in dict.fromkeys(texts) if not any(o != t and o in t for o in texts))


def _sets(items: list) -> list[tuple[str, ...]]:
    """Sets of literals: each match holds one of each set."""
    out, run = [], [""]

    def end() -> None:
        nonlocal run
        if all(run):
            out.append(_fewest(run))
        run = [""]

    for op, arg in items:
        name, own = str(op), _spellings([(op, arg)])
        if own is not None and len(run) * len(own) <= MOST:
            run = list(dict.fromkeys(a + b for a in run for b in own))
            continue
        end()
        if own is not None:
            run = own
        elif name == "SUBPATTERN":
            out += _sets(list(arg[3]))
        elif name == "BRANCH":
            each = [max(_sets(list(x)), key=_worth, default=()) for x in arg[1]]
            if all(each):
                out.append(_fewest([s for x in each for s in x]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]:
            out += _sets(list(arg[2]))
    end()
    return [s for s in out if s]


def _worth(literals: tuple[str, ...]) -> float:
    """How rarely a text holds one of the literals, roughly."""
    return min(map(len, literals), default=0) - len(literals) / 6


#: Letters whose two cases meet elsewhere than in their own lower case: İ and ı with i, ſ with s, ς with σ, and so on.
FOLDED = {c: f for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x10000))) if len(u := c.upper()) == 1 and len(f := u.lower().replace("i\u0307", "i")) == 1 and f != c.lower()}


def fold(text: Column) -> Column:
    """The text with all cases of a letter as one."""
    return F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values())))


@cache
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of literals in lower case, rarest first: each match of a pattern holds one of each set; () where none are known.

    For patterns that match letters in either case by ASCII rules, or as they are, a text in lower case holds them; for those
    that match in either case by Unicode's rules, a folded text does.
    """
    try:
        found = _sets(list(_parser.parse(pattern)))
    except re.error:
        return ()
    if "(?iu)" in pattern:
        found = [tuple("".join(FOLDED.get(c, c) for c in x) for x in s) for s in found]
    else:
        found = [s for s in found if all(x.isascii() for x in s)]
    return tuple(sorted((s for s in dict.fromkeys(found) if min(map(len, s)) > 1), key=_worth, reverse=True)[:4])


def gate(low: Column, pattern: str) -> Column | None:
    """Whether a text in lower case (or folded) holds what the pattern needs; None where nothing is known of that."""
    each = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in s]) for s in required(pattern)]
    return reduce(lambda a, b: a & b, each) if each else None


def alternation(texts: Iterable[str]) -> str:
    """A pattern for any of the texts, with what they begin with taken out, so that a place is given up at its first letters."""
    by: dict[str, list[str]] = {}
    for t in texts:
        if not t:
            return ""
        by.setdefault(t[0], []).append(t[1:])
    return _halved([(re.escape(c), re.escape(c) + alternation(rest)) for c, rest in sorted(by.items())])


def _halved(each: list[tuple[str, str]]) -> str:
    """Any of the sorted (first letter, pattern). Many are halved by a range, as a search asks branches one after the other."""
    if len(each) < 5:
        return each[0][1] if len(each) == 1 else f"(?:{'|'.join(p for _, p in each)})"
    low, high = each[: len(each) // 2], each[len(each) // 2 :]
    return f"(?:(?=[{low[0][0]}-{low[-1][0]}]){_halved(low)}|(?=[{high[0][0]}-{high[-1][0]}]){_halved(high)})"


def any_gate(low: Column, patterns: Iterable[str]) -> Column | None:
    """Whether a text holds what at least one of many patterns needs: one search, whatever their number."""
    rarest = [required(p)[:1] for p in patterns]
    return low.rlike(alternation(_fewest([x for s in rarest for x in s[0]]))) if all(rarest) else None
