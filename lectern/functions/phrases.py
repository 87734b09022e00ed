"""Phrases over typed words: a text is read once as words and marks, and phrases are matched on these.

A phrase is written as it is said, with a few signs: (a|b) one of these, [x] maybe x, {x} x any number of
times, &x and !x something that must or must not follow, and words in capitals for kinds of words, whose values
are kept. White space and masked stretches do not count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

_SIGNS = re.compile(r"[()\[\]{}|&!]|[^\s()\[\]{}|&!]+")
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]|_")


class Token(NamedTuple):
    word: str
    start: int
    end: int


class Found(NamedTuple):
    first: int
    after: int
    values: tuple


Step = Callable[[Sequence[Token], int, tuple], Iterator[tuple[int, tuple]]]


def tokens(text: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end()) for m in _TOKENS.finditer(text)]


@dataclass
class Grammar:
    """kinds: for a word in capitals, a function from a word to (is one, value); names: phrases that stand for others."""

    kinds: dict[str, Callable[[str], tuple[bool, object]]]
    names: dict[str, str]

    def phrase(self, written: str) -> Phrase:
        signs = _SIGNS.findall(written)
        step, rest = self._choice(signs)
        if rest:
            raise ValueError(f"cannot read {rest} of {written}")
        return Phrase(step)

    def _choice(self, signs: list[str]) -> tuple[Step, list[str]]:
        options = []
        while True:
            step, signs = self._row(signs)
            options.append(step)
            if not signs or signs[0] != "|":
                return (options[0] if len(options) == 1 else _one_of(options)), signs
            signs = signs[1:]

    def _row(self, signs: list[str]) -> tuple[Step, list[str]]:
        steps = []
        while signs and signs[0] not in ")]}|":
            step, signs = self._item(signs)
            steps.append(step)
        return _in_turn(steps), signs

    def _item(self, signs: list[str]) -> tuple[Step, list[str]]:
        sign, rest = signs[0], signs[1:]
        if sign in "([{":
            inner, rest = self._choice(rest)
            return {"(": inner, "[": _maybe(inner), "{": _again(inner)}[sign], rest[1:]
        if sign in "&!":
            inner, rest = self._item(rest)
            return _ahead(inner, sign == "&"), rest
        if sign in self.names:
            return self._choice(_SIGNS.findall(self.names[sign]))[0], rest
        return (_kind(self.kinds[sign]) if sign in self.kinds else _word(sign)), rest


def _word(word: str) -> Step:
    def step(row, at, values):
        if at < len(row) and row[at].word == word:
            yield at + 1, values

    return step


def _kind(told) -> Step:
    def step(row, at, values):
        if at < len(row):
            fits, value = told(row[at].word)
            if fits:
                yield at + 1, (*values, value)

    return step


def _in_turn(steps: list[Step]) -> Step:
    def step(row, at, values, k=0):
        if k == len(steps):
            yield at, values
            return
        for after, kept in steps[k](row, at, values):
            yield from step(row, after, kept, k + 1)

    return step


def _one_of(options: list[Step]) -> Step:
    def step(row, at, values):
        for option in options:
            yield from option(row, at, values)

    return step


def _maybe(inner: Step) -> Step:
    def step(row, at, values):
        yield from inner(row, at, values)
        yield at, values

    return step


def _again(inner: Step) -> Step:
    def step(row, at, values):
        for after, kept in inner(row, at, values):
            if after > at:
                yield from step(row, after, kept)
        yield at, values

    return step


def _ahead(inner: Step, wanted: bool) -> Step:
    def step(row, at, values):
        if (next(inner(row, at, ()), None) is not None) == wanted:
            yield at, values

    return step


@dataclass
class Phrase:
    step: Step

    def at(self, row: Sequence[Token], first: int) -> Found | None:
        found = next(self.step(row, first, ()), None)
        return Found(first, *found) if found else None

    def search(self, row: Sequence[Token], first: int = 0) -> Found | None:
        return next((found for k in range(first, len(row)) if (found := self.at(row, k))), None)

    def before(self, row: Sequence[Token], after: int, longest: int = 8) -> Found | None:
        """The longest that ends right before token number after."""
        for first in range(max(0, after - longest), after):
            for end, values in self.step(row, first, ()):
                if end == after:
                    return Found(first, end, values)
        return None
