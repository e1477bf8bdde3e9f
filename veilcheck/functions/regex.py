"""Portable regexes: rules are written once and given to Java's engine.

Rules follow Unicode text semantics (word characters are letters and numbers
of any script, white space includes the information separators, case folding
is Unicode).  Java's shorthands differ from that and between JDK versions, so
each shorthand is spelled out as an explicit character class.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000"
)
# The same white space as text, for trimming.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters beyond ASCII that equal an ASCII letter when case is ignored.
FOLDED, FOLDED_TO = "\u017f\u212a\u0130\u0131", "skii"
_CLASSES = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}
_BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java(pattern: str) -> str:
    """The Java spelling of a rule regex, with the shorthands expanded."""
    out, in_class, i = [], False, 0
    if pattern.startswith("(?i)"):
        out.append("(?iu)")
        i = 4
    while i < len(pattern):
        ch, nxt = pattern[i], pattern[i + 1 : i + 2]
        i += 1
        if ch == "\\":
            i += 1
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            else:
                out.append(_BOUNDARY if nxt == "b" and not in_class else ch + nxt)
        elif in_class:
            # Java would read an inner "[" or "&&" as class algebra.
            out.append("\\" + ch if ch in "[&" else ch)
            in_class = ch != "]"
        elif ch == "[":
            # A "]" right after the opening is a literal member.
            opening = "[^" if nxt == "^" else "["
            i += len(opening) - 1
            if pattern[i : i + 1] == "]":
                opening += r"\]"
                i += 1
            out.append(opening)
            in_class = True
        else:
            out.append(r"[^\n]" if ch == "." else ch)
    return "".join(out)


def literals(pattern: str) -> list[str]:
    """Texts that every match of a regex contains, as far as they are plain to see.

    Read are literal characters, escaped ones among them, outside of groups and
    classes.  One with a quantifier counts as none, and so does all of a pattern
    with flags, an alternation at the top or an escape beyond the shorthands.
    """
    found, run, depth, i = set(), "", 0, 0
    while i < len(pattern):
        ch, nxt, start = pattern[i], pattern[i + 1 : i + 2], i
        if (ch == "|" and depth == 0) or re.match(r"\(\?[a-zA-Z-]+[):]|\\[^\WbBwWdDsSAZ]", pattern[i:]):
            return []
        if ch == "[":
            # A "]" right after the opening is a literal member.
            i += 3 if pattern[i + 1 : i + 3] == "^]" else 2 if nxt in ("]", "^") else 1
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif ch == "{":
            i = pattern.index("}", i) + 1
        else:
            i += 2 if ch == "\\" else 1
            depth += (ch == "(") - (ch == ")")
        plain = pattern[i - 1] if (ch == "\\" and not nxt.isalnum()) or (i == start + 1 and ch not in ".^$()|*+?") else ""
        if depth == 0 and plain and pattern[i : i + 1] not in ("*", "+", "?", "{"):
            run += plain
        else:
            found.add(run)
            run = ""
    return sorted({*found, run} - {""})


def any_of(patterns: list[str], flags: str = "") -> str:
    """One alternation of several rule regexes, in Java spelling."""
    return flags + "|".join(f"(?:{java(p)})" for p in patterns)


def glob(pattern: str) -> str:
    """Anchored Java regex of a shell glob; ``*`` crosses path separators."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            # A "]" right after the opening (or its "!") is a literal member.
            start = i + 1 if pattern[i : i + 1] == "!" else i
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
                continue
            negate, body = start > i, pattern[start:end]
            body = body.replace("\\", "\\\\").replace("[", r"\[").replace("]", r"\]")
            body = body.replace("&", r"\&").replace("^", r"\^")
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return r"(?s)\A" + "".join(out) + r"\z"
