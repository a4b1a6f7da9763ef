"""Shell globs as anchored regular expressions for ``rlike``.

``*`` and ``?`` also match ``/``; ``**`` is a whole run of segments; classes and
``{a,b}`` work; matching is case-sensitive. A malformed pattern is an error.
"""

from __future__ import annotations

import re

_JAVA_CLASS_SPECIALS = "\\[]^&-~"


class BadGlob(ValueError):
    """The pattern cannot be read."""


def _read_class(pattern: str, start: int) -> tuple[str, int]:
    """Translate ``[...]``; ``start`` is just after the opening bracket."""
    negated = start < len(pattern) and pattern[start] in "!^"
    first = start + negated
    # A closing bracket right at the front is a member.
    end = pattern.find("]", first + 1)
    if end < 0:
        raise BadGlob(f"unclosed class in {pattern!r}")
    members, body, i = [], pattern[first:end], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low > high:
                raise BadGlob(f"invalid range {low}-{high} in {pattern!r}")
            members.append(f"{_in_class(low)}-{_in_class(high)}")
            i += 3
        else:
            members.append(_in_class(body[i]))
            i += 1
    return f"[{'^' if negated else ''}{''.join(members)}]", end + 1


def _in_class(ch: str) -> str:
    return "\\" + ch if ch in _JAVA_CLASS_SPECIALS else ch


def to_regex(pattern: str) -> str:
    out: list[str] = []
    depth = 0
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            run = i
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            opens = run == 0 or pattern[run - 1] == "/"
            if i - run == 2 and opens and pattern[i : i + 1] == "/":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
            continue
        i += 1
        if ch == "?":
            out.append(".")
        elif ch == "[":
            text, i = _read_class(pattern, i)
            out.append(text)
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}":
            if depth == 0:
                raise BadGlob(f"unopened alternative in {pattern!r}")
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\":
            if i == len(pattern):
                raise BadGlob(f"dangling escape in {pattern!r}")
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(ch))
    if depth:
        raise BadGlob(f"unclosed alternative in {pattern!r}")
    return rf"(?s)\A(?:{''.join(out)})\z"
