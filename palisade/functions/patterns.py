"""Regular expressions written for Python's Unicode classes, for Java's engine, and term lists as patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

#: Characters that Python calls white space, as the inside of a character class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: Word characters, likewise.
WORDS = r"\p{L}\p{N}_"
#: One table look-up that passes over ASCII letters and digits, before classes that take many tests a character.
NOT_PLAIN = "(?=[^" + "".join(chr(c) for c in range(128) if chr(c).isalnum()) + "])"
_BOUNDARY = rf"(?:(?<![{WORDS}])(?=[{WORDS}])|(?<=[{WORDS}])(?![{WORDS}]))"
_CLASSES = {"s": SPACES, "w": WORDS, "d": r"\p{Nd}"}


#: What a pattern's first atom may be followed by so that it still has to be there.
_OPTIONAL = ("?", "*", "{0", "{,")


def _alternatives(pattern: str) -> list[str]:
    """The pattern's parts between bars outside all groups and classes."""
    parts, depth, inside, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def first_class(pattern: str) -> str | None:
    """What a match's first character is one of, as the inside of a character class; None where that isn't plain."""
    found = []
    for part in _alternatives(pattern):
        if part.startswith(r"\b"):
            part = part[2:]
        if part.startswith("(") and (not part.startswith("(?") or part.startswith("(?:")):
            depth, end, inside = 0, 0, False
            while end < len(part):
                c = part[end]
                if c == "\\":
                    end += 1
                elif inside or c == "[":
                    inside = c != "]"
                elif c in "()":
                    depth += 1 if c == "(" else -1
                    if not depth:
                        break
                end += 1
            atom, rest = first_class(part[1:end].removeprefix("?:")), part[end + 1 :]
        elif part.startswith("["):
            end = part.find("]", 1)
            inner, rest = part[1:end], part[end + 1 :]
            atom = inner if re.fullmatch(r"(?:[^\W_](?:-[^\W_])?)+", inner) else None
        elif part[:2] == r"\d":
            atom, rest = _CLASSES["d"], part[2:]
        else:
            atom, rest = (part[0], part[1:]) if part and part[0].isalnum() else (None, "")
        if atom is None or rest.startswith(_OPTIONAL):
            return None
        found.append(atom)
    return "".join(dict.fromkeys(found))


def _ahead(first: str | None) -> str:
    """A look at one character, before anything that is dearer at each place of a text."""
    return f"(?=[{first}])" if first else ""


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """The pattern with explicit classes, so that Java reads it as Python would; '.' stops at line feeds only."""
    out, inside, i = [], False, 0
    if len(_alternatives(pattern)) == 1:
        out.append(_ahead(first_class(pattern)))
        if pattern.startswith(r"\b") and (first := pattern[2:].lstrip("(?:")) and (first[0].isalnum() or first[:2] in (r"\d", r"\w")):
            out.append(f"(?<![{WORDS}])")  # a word character follows, so nothing else needs a look
            i = 2
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in _CLASSES:
                out.append(_CLASSES[n] if inside else f"[{_CLASSES[n]}]")
            elif n == "b" and not inside:
                out.append(_BOUNDARY)
            elif n in "WSD":
                out.append(f"[^{_CLASSES[n.lower()]}]")
            else:
                out.append(c + n)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


def any_of(patterns: Iterable[str]) -> str:
    """One pattern that matches where any does."""
    flags, listed = java_pattern(""), list(patterns)
    firsts = [first_class(p) for p in listed]
    ahead = _ahead("".join(dict.fromkeys(firsts))) if listed and None not in firsts else ""
    return f"{flags}{ahead}(?:" + "|".join(f"(?:{java_pattern(p)[len(flags):]})" for p in listed) + ")"


def literal_of(pattern: str) -> str | None:
    """The words of a pattern that is only words, between boundaries or not; None for others."""
    words = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return words if re.fullmatch(r"[A-Za-z0-9 ]+", words) else None


def escaped(literal: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in literal)


def is_word(term: str) -> bool:
    return bool(term) and all(c.isalnum() or c == "_" for c in term)


def term_pattern(terms: Iterable[str]) -> str:
    """Longest term first; a term of word characters only has boundaries, any other stands bare. Matches none if empty."""
    listed = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    if not listed:
        return "(?!)"
    parts = []
    for bounded, group in groupby(listed, key=is_word):
        words = [escaped(t) for t in group]
        firsts = _ahead("".join(dict.fromkeys(w[:2] if w[0] == "\\" else w[0] for w in words)) if all(words) else None)
        parts.append(rf"{firsts}(?<![{WORDS}])(?:{'|'.join(words)})(?![{WORDS}])" if bounded else f"{firsts}(?:{'|'.join(words)})")
    return "(?iu)" + "|".join(parts)
