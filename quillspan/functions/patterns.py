"""Rule forms as regular expressions, in Java's dialect (prefix ``(?dU)``) and Python's.

``(?U)`` makes classes and look-arounds Unicode-aware, ``(?d)`` leaves the line feed
as the only line end, so a pattern means the same in both dialects.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Named right-hand sides of cue rules, and flags that rules may set.
THEN = {
    "capitalised_word": r"\p{Lu}\p{L}+",
    "capitalised_words": r"\p{Lu}\p{L}+(?:[\s\-]\p{Lu}\p{L}+){0,3}",
    "number": r"\d+",
    "digits": r"[\d.\-/]{2,}",
    "word": r"\p{L}+",
    "rest_of_line": r"[^\n]+",
}
FLAGS = {"unicode": "", "ignorecase": "i", "multiline": "m"}
#: A letter beyond 16 bits in the class makes Java look back by code points; it is a word character anyway.
NOT_BEHIND_WORD = "(?<![\\w\U0001d518])"
GAP_CLASS = r"[\s:.,]"
MOST_GAP, USUAL_GAP = 40, 3


def literal(term: str) -> str:
    """A term as a pattern that matches it alone."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def bounded(term: str) -> str:
    """The term, not inside a longer word: an edge is guarded only where the term's own edge is a word character."""
    word = re.compile(r"\w")
    before = NOT_BEHIND_WORD if word.match(term[:1]) else ""
    after = r"(?!\w)" if word.match(term[-1:]) else ""
    return f"{before}{literal(term)}{after}"


def longest_first(terms: Iterable[str]) -> list[str]:
    return sorted(terms, key=lambda t: (-len(t), t))


def gazetteer(terms: Iterable[str]) -> str:
    """Any of the terms.  A look at the first character comes before the guards: it fails soonest."""
    terms = longest_first(terms)
    first = "".join(sorted({re.sub(r"([\\\]\[^&-])", r"\\\1", t[0]) for t in terms}))
    return f"(?=[{first}])(?:" + "|".join(bounded(t) for t in terms) + ")"


def required(pattern: str) -> str:
    """A stretch of characters that every match of a Java pattern holds, or an empty one if none is sure."""
    flags = re.match(r"\(\?[a-zA-Z]*\)", pattern)
    if flags and "i" in flags[0]:
        return ""
    try:
        parts = list(re._parser.parse(pattern[flags.end() if flags else 0 :]))
    except (re.error, AttributeError):  # a form that Python doesn't know
        return ""
    runs = [""]
    for op, value in parts:
        if str(op) == "LITERAL":
            runs[-1] += chr(value)
        else:
            runs.append("")
    return max(runs, key=len)


def cue(cues: Iterable[str], then: str, gap: int = USUAL_GAP) -> str:
    """Group 1 is what follows a cue and up to ``gap`` separators; it ends the match."""
    return f"(?:{'|'.join(literal(c) for c in longest_first(cues))}){GAP_CLASS}{{0,{gap}}}({THEN.get(then, then)})"


def java(pattern: str, flags: Iterable[str] = (), fold: bool = False) -> str:
    letters = "".join(FLAGS[f] for f in flags)
    if fold and "i" not in letters:
        letters += "i"
    return f"(?dU{letters}{'u' if 'i' in letters else ''}){pattern}"
