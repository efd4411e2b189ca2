"""Text helpers as Columns, and a dialect of regular expressions in which classes are Unicode.

Rules are written with \\w, \\b, \\s and \\d in their Unicode sense. Java reads these as ASCII (and \\b by JDK version), so
`regex` spells the classes out: a word character is a letter, a number or "_".
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SET, SPACE_SET, DIGIT_SET = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}", r"\p{Nd}"
WORD = f"[{WORD_SET}]"
SPACE = f"[{SPACE_SET}]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_CLASSES = {"w": WORD_SET, "s": SPACE_SET, "d": DIGIT_SET}
#: Line ends: those that a text is split at where lines are read.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


_BEFORE, _AFTER = f"(?<!{WORD})", f"(?!{WORD})"
_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]")
_WORDS_AHEAD = re.compile(r"[A-Za-z0-9_](?![*?{])|\\w(?![*?{])|\(\?:[A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)*\)(?![*?{])")


def regex(pattern: str, ignore_case: bool = False) -> str:
    """A rule's pattern in Java's syntax; "." matches all but a line feed.

    A boundary next to what must be a word character is a look at its other side alone.
    """
    out, i, inside, word = [], 0, False, False  # word: the last atom is one or more word characters
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n in _CLASSES:
                out.append(_CLASSES[n] if inside else f"[{_CLASSES[n]}]")
                word = n == "w" and not inside
            elif n == "b" and not inside:
                out.append(_AFTER if word else _BEFORE if _WORDS_AHEAD.match(pattern, i) else BOUNDARY)
                word = False
            else:
                out.append(c + n)
                word = False
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = "[^\\n]"
        out.append(c)
        word = not inside and c.isascii() and (c.isalnum() or c == "_" or c == "+" and word)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern a text that all its matches hold; none if one of them has no such text."""
    found, i, depth, run, best = [], 0, 0, "", ""
    pattern += "|"
    while i < len(pattern):
        c, step, plain = pattern[i], 1, False
        if c == "\\":
            step, plain = 2, pattern[i + 1] not in "wsdbWSDBnrtpP"
            c = pattern[i + 1]
        elif c == "[":
            step = _CLASS.match(pattern, i).end() - i
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            best = max(best, run, key=len)
            found.append(best)
            run = best = ""
        else:
            plain = c not in "|.^$*+?{}"
        after = pattern[i + step] if i + step < len(pattern) else ""
        if plain and depth == 0 and after not in "*?{":
            run += c
            if after == "+":
                best, run = max(best, run, key=len), ""
        else:
            best, run = max(best, run, key=len), ""
        i += step
    return found if all(found) else []


def matches(code: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a line matches; lines without a text that a match must hold are passed over by a plain search."""
    held = [] if ignore_case else literals(pattern)
    test = code.rlike(regex(pattern, ignore_case))
    return reduce(Column.__or__, [F.contains(code, F.lit(x)) for x in held]) & test if held else test


def first(code: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """A group of the first match; null if there is none."""
    return F.nullif(F.regexp_extract(code, regex(pattern, ignore_case), group), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; one empty piece after the last line end isn't a line."""
    parts = F.split(text, LINE_END)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_constant_case(name: Column) -> Column:
    """Has cased characters, all of them upper case."""
    return (name == F.upper(name)) & (name != F.lower(name))


def suffix(path: Column) -> Column:
    """Lower-cased suffix of a path's last part, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def capitalised(prefix: str, name: Column) -> Column:
    """prefix and name with its first letter in upper case."""
    return F.concat(F.lit(prefix), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
