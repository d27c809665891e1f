"""Texts that a pattern cannot match without, and one pattern that finds them all.

A rule set has hundreds of patterns, a line matches few. ``required_literals`` derives from each pattern a small set of texts of
which any match holds at least one; ``shared_pattern`` puts the texts of all rules into one trie, so that a line is searched
once, whatever the number of rules, and only the rules whose texts occur are tried.
"""

from __future__ import annotations

import re
import re._parser as parser
import warnings

#: Shorter texts occur nearly everywhere; a rule with more alternatives than this is tried on every line.
SHORTEST, MOST = 3, 64

#: Letters outside ASCII that match an ASCII letter when case is ignored by Unicode rules (the long s, the Kelvin sign, the
#: dotless and the dotted i), and these letters. Everything else outside ASCII matches no ASCII letter.
FOLDED = ("ſKıİ", "skii")

_FLAGS = re.compile(r"\(\?[iUd]+\)")
_REPEATS = (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT)


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case ASCII texts of which every match of ``pattern`` holds one; None if no useful ones are known.

    The engine that runs the patterns reads a few constructs differently than the parser used here (nested and intersected
    classes, vertical white space); such patterns, and those that it cannot read, have none.
    """
    body = _FLAGS.sub("", pattern, count=1) if _FLAGS.match(pattern) else pattern
    if _reads_differently(body):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(body)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    found = _needed(tree)
    return sorted(found) if found else None


def _reads_differently(body: str) -> bool:
    inside, i = False, 0
    while i < len(body):
        if body[i] == "\\":
            if body[i + 1:i + 2] in ("v", "Q", "E", "0"):
                return True
            i += 2
            continue
        if inside and (body[i] == "[" or body.startswith("&&", i)):
            return True
        if body[i] == "[":
            inside = True
            i += 2 if body.startswith("[^", i) else 1
            if body.startswith("]", i):
                i += 1
            continue
        if body[i] == "]":
            inside = False
        i += 1
    return False


def _needed(nodes) -> frozenset[str] | None:
    """The best set for a sequence: the one whose shortest text is longest."""
    offers: list[frozenset[str]] = []
    run = frozenset([""])
    for op, value in _flat(nodes):
        exact = _exact(op, value)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(before + after for before in run for after in exact)
            continue
        offers.append(run)
        run = exact if exact is not None else frozenset([""])
        if op is parser.BRANCH:
            parts = [_needed(part) for part in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif op in _REPEATS:
            inner = _needed(value[2]) if value[0] >= 1 else None
        elif op is parser.ATOMIC_GROUP:
            inner = _needed(value)
        else:
            inner = None
        if inner:
            offers.append(inner)
    offers = [o for o in (*offers, run) if len(o) <= MOST and min(map(len, o)) >= SHORTEST]
    return max(offers, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _flat(nodes):
    """The nodes of a sequence, those of its plain groups in their place."""
    for op, value in nodes:
        if op is parser.SUBPATTERN:
            yield from _flat(value[3])
        else:
            yield op, value


def _exact(op, value) -> frozenset[str] | None:
    """The lower-case ASCII texts that a node takes, if these are few and known."""
    if op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
        return frozenset([""])  # takes no text
    if op is parser.LITERAL:
        codes = {value}
    elif op is parser.IN and all(kind is parser.LITERAL for kind, _ in value):
        codes = {code for _, code in value}
    elif op is parser.BRANCH:
        return _any_of([_exact_run(part) for part in value[1]])
    elif op in _REPEATS and value[1] == 1:
        return _any_of([_exact_run(value[2]), frozenset([""])] if value[0] == 0 else [_exact_run(value[2])])
    else:
        return None
    return frozenset(chr(c).lower() for c in codes) if max(codes) < 128 and len(codes) <= MOST else None


def _exact_run(nodes) -> frozenset[str] | None:
    run = frozenset([""])
    for op, value in _flat(nodes):
        exact = _exact(op, value)
        if exact is None or len(run) * len(exact) > MOST:
            return None
        run = frozenset(before + after for before in run for after in exact)
    return run


def _any_of(parts: list[frozenset[str] | None]) -> frozenset[str] | None:
    if any(part is None for part in parts):
        return None
    union = frozenset().union(*parts)
    return union if len(union) <= MOST else None


def roots(texts) -> dict[str, str]:
    """For each text the shortest of ``texts`` that it begins with: where a text occurs, so does its root."""
    out: dict[str, str] = {}
    last = None
    for text in sorted(set(texts)):
        if last is None or not text.startswith(last):
            last = text
        out[text] = last
    return out


def shared_pattern(texts) -> str:
    """A pattern whose first group is, at every place where one of ``texts`` stands, that text. No text may begin with another."""
    trie: dict = {}
    for text in texts:
        node = trie
        for letter in text:
            node = node.setdefault(letter, {})
    return f"(?s)(?=({_branches(trie)}))"


def _branches(node: dict) -> str:
    parts = [re.escape(letter) + _branches(after) for letter, after in sorted(node.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
