"""Syntax trees of Python texts that differ only in plain strings and in names with digits: one is parsed, the others fill it in.

A text's shape is the text without these words. No word can change how the rest is read: a name with a digit is no
keyword and no prefix of a string, and the strings taken are whole tokens of one line without escapes. What a pattern
takes for such a word counts only if the parser agrees: the shape is parsed with marks in their place, and is used if
each mark is found once, as a whole name or as a string of just the token's width. All else is parsed as it stands.

As the parser has agreed to the shape, any text that is the shape with other such words fits it, however the patterns
would take that text apart. So a shape in use is a pattern itself, and is tried first.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable, Sequence
from typing import Any

#: Bounds on what a worker keeps: shapes, and characters of each.
KEPT, MOST_CHARS = 64, 16_384
#: Of so many texts, this share must have a known shape; else so many are parsed without looking.
TRIED, SHARE, PASSED = 512, 0.2, 16_384

_NAME, _STRING, _MARK = "\x01", "\x02", "slot9_"
_DOUBLE, _SINGLE = (rf"[^{q}\\\x00-\x1f\ud800-\udfff]++" for q in "\"'")
_STRINGS = rf'''"""{_DOUBLE}"""|"{_DOUBLE}"|\'\'\'{_SINGLE}\'\'\'|'{_SINGLE}\''''
_OTHER = r'''"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^'\\]++|\\[\s\S]|'(?!''))*+\'\'\'|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'|["']'''
_WITH_DIGIT = r"""[A-Za-z_]++\d[A-Za-z0-9_]*+(?![\w"'])"""
#: What is passed over (the rest, other words, strings with a prefix, comments, numbers, other strings), then a string or a name.
_WORDS = re.compile(
    rf"""((?:[^\w"'#.]++|[A-Za-z_]++(?![\w"'])|\.(?!\d)|[A-Za-z_]++(?=["'])(?:{_OTHER})|\#[^\n]*+|\.?\d[\w.]*+|(?!{_WITH_DIGIT})\w++(?:{_OTHER})?|(?!{_STRINGS})(?:{_OTHER}))*+)"""
    rf"""(?:(\"\"\"|")({_DOUBLE})\2|(\'\'\'|')({_SINGLE})\4|({_WITH_DIGIT})|\Z)"""
)


def shape_of(text: str) -> tuple[str, list[str]]:
    """(the text with a sign for each word that may differ, these words)."""
    parts: list[str] = []
    words: list[str] = []
    for passed, double, in_double, single, in_single, name in _WORDS.findall(text):
        parts.append(passed)
        if name:
            words.append(name)
            parts.append(_NAME)
        elif double or single:
            words.append(in_double or in_single)
            parts += (double or single, _STRING, double or single)
    return "".join(parts), words


class Shape:
    """The tree of a shape, and the places of its words in it. ValueError or SyntaxError if the words are no whole tokens."""

    def __init__(self, shape: str):
        self.shape = shape
        parts = re.split(f"([{_NAME}{_STRING}])", shape)
        kinds = parts[1::2]
        parts[1::2] = [f"{_MARK}{i}_" for i in range(len(kinds))]
        self.tree = ast.parse("".join(parts))
        place: dict[int, tuple] = {}

        def found(mark: str, kind: str, where: tuple) -> None:
            m = re.fullmatch(_MARK + r"(\d+)_", mark)
            if not m or int(m[1]) in place or kinds[int(m[1])] != kind:
                raise ValueError(mark)
            place[int(m[1])] = where

        for n in ast.walk(self.tree):
            if isinstance(n, ast.Constant):
                if isinstance(n.value, str) and _MARK in n.value:
                    width = n.end_col_offset - n.col_offset - len(n.value) if n.lineno == n.end_lineno else 0
                    if width not in (2, 6):
                        raise ValueError(n.value)
                    found(n.value, _STRING, (n, "value", None))
                elif isinstance(n.value, bytes) and _MARK.encode() in n.value:
                    raise ValueError(n.value)
                continue
            for field, value in ast.iter_fields(n):
                if isinstance(value, str) and _MARK in value:
                    names = value.split(".")
                    for k, x in enumerate(names):
                        if _MARK in x:
                            found(x, _NAME, (n, field, (names, k) if len(names) > 1 else None))
                elif isinstance(value, list):
                    for k, x in enumerate(value):
                        if isinstance(x, str) and _MARK in x:
                            found(x, _NAME, (value, k, None))
        if len(place) != len(kinds):
            raise ValueError(shape)
        # names with dots are joined again from their parts, which lists hold
        dotted: dict[tuple[int, str], tuple] = {}
        self.whole: list[tuple[int, Any, str]] = []
        self.within: list[tuple[int, list, int]] = []
        for i, (n, field, part) in sorted(place.items()):
            if part:
                own = dotted.setdefault((id(n), field), (n, field, part[0]))
                self.within.append((i, own[2], part[1]))
            elif isinstance(n, list):
                self.within.append((i, n, field))
            else:
                self.whole.append((i, n, field))
        self.dotted = list(dotted.values())

    @functools.cached_property
    def pattern(self) -> re.Pattern:
        """What texts of this shape match as a whole; its groups are their words."""
        parts = re.split(f"([{_NAME}{_STRING}])", self.shape)
        for i, x in enumerate(parts):
            string = _DOUBLE if parts[i - 1][-1:] == '"' else _SINGLE
            parts[i] = f"({_WITH_DIGIT if x == _NAME else string})" if i % 2 else re.escape(x)
        return re.compile("".join(parts))

    def fill(self, words: Sequence[str]) -> ast.Module:
        """The tree with these words, until the next call."""
        for i, node, field in self.whole:
            setattr(node, field, words[i])
        for i, names, k in self.within:
            names[k] = words[i]
        for node, field, names in self.dotted:
            setattr(node, field, ".".join(names))
        return self.tree


class Trees:
    """Trees of texts, by shape; `about` tells of a new tree what stays true while its words change.

    A shape is kept once it is met again. Where too few texts share shapes, most are parsed without looking for one.
    """

    def __init__(self, about: Callable[[ast.Module], Any]):
        self.about = about
        self.known: dict[str, tuple[Shape, Any] | None] = {}
        #: The shape last filled in, by lines of its texts.
        self.last: dict[int, tuple[Shape, Any]] = {}
        self.asked = self.met = self.left = 0

    def of(self, text: str) -> tuple[ast.Module, Any]:
        """(tree, about it), both good until the next call; what ast.parse raises if the text does not parse."""
        if self.left:
            self.left -= 1
        elif kept := self._shared(text):
            return kept[0].fill(kept[2]), kept[1]
        tree = ast.parse(text)
        return tree, self.about(tree)

    def _shared(self, text: str) -> tuple[Shape, Any, Sequence[str]] | None:
        """(the shape that is kept for a text, what is known of its tree, the text's words), or None."""
        lines = text.count("\n")
        if last := self.last.get(lines):
            if m := last[0].pattern.fullmatch(text):
                self._ask(True)
                self.known[last[0].shape] = self.known.pop(last[0].shape)
                return *last, m.groups()
        if len(text) > MOST_CHARS or _NAME in text or _STRING in text or _MARK in text:
            return None
        shape, words = shape_of(text)
        seen = shape in self.known
        self._ask(seen)
        kept = self.known.pop(shape, None)
        if kept:
            self.last[lines] = kept
        elif seen and kept is None:
            kept = self._made(shape)
        self.known[shape] = kept  # the last one met comes last
        if len(self.known) > KEPT:
            gone = self.known.pop(next(iter(self.known)))
            if gone and self.last.get(n := gone[0].shape.count("\n")) is gone:
                del self.last[n]
        return (*kept, words) if kept else None

    def _ask(self, met: bool) -> None:
        self.asked, self.met = self.asked + 1, self.met + met
        if self.asked == TRIED:
            self.left = PASSED if self.met < SHARE * TRIED else 0
            self.asked = self.met = 0

    def _made(self, shape: str) -> tuple | None:
        try:
            made = Shape(shape)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            return ()
        return made, self.about(made.tree)
