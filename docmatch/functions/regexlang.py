"""Regular expressions of the template language, for Java (Spark) and for Python.

The language has no look-around and no back-references; classes and case folding are
Unicode; ``$`` is the end of the text alone and ``.`` excludes the newline alone.
"""

from __future__ import annotations

import re

import regex as _regex

JAVA_PREFIX = "(?Uud)"


class RegexError(ValueError):
    """The pattern isn't valid in the template language."""


def _walk(pattern: str, dollar: str) -> str:
    """Rewrites ``$`` outside classes, and the opening of named groups; refuses
    look-around and back-references."""
    out, i, in_class, multiline = [], 0, 0, "m" in _leading_flags(pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if not in_class and (n.isdigit() or n == "k"):
                raise RegexError("backreferences are not supported")
            if n == "z":
                out.append(dollar)
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            raise RegexError("look-around is not supported")
        elif not in_class and pattern.startswith("(?P<", i):
            out.append("(?<" if dollar == r"\z" else "(?P<")
            i += 4
            continue
        elif not in_class and c == "$" and not multiline:
            out.append(dollar)
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _leading_flags(pattern: str) -> str:
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return m[1] if m else ""


def compile_python(pattern: str) -> _regex.Pattern:
    """For use in Arrow functions; positions are in code points."""
    try:
        return _regex.compile(_walk(pattern, r"\Z"), _regex.V0)
    except _regex.error as e:
        raise RegexError(str(e)) from e


def to_java(pattern: str) -> str:
    """The same pattern for rlike and the regexp functions."""
    compile_python(pattern)
    return JAVA_PREFIX + _walk(pattern, r"\z")


def escape(text: str) -> str:
    """A pattern that matches text literally."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", text)


def error_of(pattern: str) -> str | None:
    try:
        to_java(pattern)
    except RegexError as e:
        return str(e)
    return None


def glob_to_regex(glob: str) -> str:
    """A path glob: ``*`` and ``?`` match any character, ``/`` too; classes and {a,b}."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise RegexError("unclosed character class")
            body = glob[i + 1 : end]
            negated = body[:1] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(escape(glob[i]))
        else:
            out.append(escape(c))
        i += 1
    if depth:
        raise RegexError("unclosed alternation")
    return "(?s)^" + "".join(out) + r"\z"
