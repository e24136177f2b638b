"""Brace patterns as product trees.

A pattern is a sequence of literals and groups; a group is a list of patterns or a run of numbers or
letters. A tree knows how many strings it stands for, and the string at any index is found by mixed
radix, the leftmost group varying slowest, without listing those before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

_NUMBERS = re.compile(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?")
_LETTERS = re.compile(r"([A-Za-z])\.\.([A-Za-z])(?:\.\.(-?\d+))?")


@dataclass(frozen=True)
class Run:
    """Numbers (padded to `width` characters, sign included) or letters, one step apart."""

    first: int
    step: int
    size: int
    width: int = 0
    letters: bool = False

    def pick(self, index: int) -> tuple[str, list[int]]:
        value = self.first + index * self.step
        return (chr(value) if self.letters else f"{value:0{self.width}d}"), [index]


@dataclass(frozen=True)
class Choice:
    """One of several patterns."""

    options: tuple[Sequence, ...]

    @property
    def size(self) -> int:
        return sum(o.size for o in self.options)

    def pick(self, index: int) -> tuple[str, list[int]]:
        for number, option in enumerate(self.options):
            if index < option.size:
                text, place = option.pick(index)
                return text, [number, *place]
            index -= option.size
        raise IndexError(index)


@dataclass(frozen=True)
class Sequence:
    """Literals and groups one after the other."""

    parts: tuple[str | Run | Choice, ...]

    @property
    def size(self) -> int:
        return prod(p.size for p in self.parts if not isinstance(p, str))

    def pick(self, index: int) -> tuple[str, list[int]]:
        digits = []
        for part in reversed([p for p in self.parts if not isinstance(p, str)]):
            index, digit = divmod(index, part.size)
            digits.append(digit)
        texts, place = [], []
        for part in self.parts:
            if isinstance(part, str):
                texts.append(part)
            else:
                text, path = part.pick(digits.pop())
                texts.append(text)
                place += path
        return "".join(texts), place


def _run(body: str) -> Run | None:
    found = _NUMBERS.fullmatch(body)
    if found:
        first, last = int(found[1]), int(found[2])
        padded = any(re.match(r"-?0\d", t) for t in found.group(1, 2))
        width = max(len(found[1]), len(found[2])) if padded else 0
        step = max(abs(int(found[3] or 1)), 1)
        return Run(first, step if first <= last else -step, abs(last - first) // step + 1, width)
    found = _LETTERS.fullmatch(body)
    if found:
        first, last = ord(found[1]), ord(found[2])
        step = max(abs(int(found[3] or 1)), 1)
        return Run(first, step if first <= last else -step, abs(last - first) // step + 1, letters=True)
    return None


@dataclass
class _Open:
    """A group that is being read: where it starts, its finished options, the parts of the current one."""

    start: int
    options: list[tuple]
    parts: list


def parse(pattern: str) -> Sequence:
    r"""The tree of a pattern, read once with a stack of open groups.

    A backslash takes the next character literally. A group without comma or run (`{}`, `{x}`) is text, but
    groups inside it count. A closing brace without an opening one, or an opening one that is not closed, is an error.
    """
    stack, at = [_Open(-1, [], [])], 0
    while at < len(pattern):
        char, here = pattern[at], stack[-1]
        if char == "\\" and at + 1 < len(pattern):
            here.parts.append(pattern[at + 1])
            at += 1
        elif char == "{":
            stack.append(_Open(at, [], []))
        elif char == "," and len(stack) > 1:
            here.options.append(tuple(here.parts))
            here.parts = []
        elif char == "}":
            if len(stack) == 1:
                raise ValueError(f"closing brace without an opening one at {at} in {pattern!r}")
            stack.pop()
            stack[-1].parts += _close(here, pattern[here.start + 1 : at])
        else:
            here.parts.append(char)
        at += 1
    if len(stack) > 1:
        raise ValueError(f"brace at {stack[-1].start} is not closed in {pattern!r}")
    return Sequence(_joined(stack[0].parts))


def _close(group: _Open, body: str) -> list:
    run = _run(body)
    if run:
        return [run]
    if group.options:
        return [Choice(tuple(Sequence(_joined(o)) for o in [*group.options, tuple(group.parts)]))]
    return ["{", *group.parts, "}"]


def _joined(parts) -> tuple:
    out: list = []
    for part in parts:
        if isinstance(part, str) and out and isinstance(out[-1], str):
            out[-1] += part
        else:
            out.append(part)
    return tuple(out)


def strings(pattern: str, start: int, stop: int) -> Iterator[tuple[str, list[int]]]:
    """(string, choices met from left to right) for the indices start to stop."""
    tree = parse(pattern)
    for index in range(start, min(stop, tree.size)):
        yield tree.pick(index)
