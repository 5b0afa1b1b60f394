"""Kernels written as programs over the rows of a key.

A machine of tidemark.operators.machines takes one row at a time. A program reads rows by number
instead, ahead and back: it waits for a row that hasn't come, may return to one it has passed (its cursor can
rewind), and says which rows it needs no more. So long rules that look ahead by bounded spans stay plain,
and memory stays bounded by the span a program keeps. A program never sees a row before it is there: what it puts
out depends on rows up to the one that made it go on."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator

Step = Generator[dict | None, None, None]


class Rows:
    """Rows by number from 0; those below `base` are forgotten."""

    def __init__(self) -> None:
        self.kept: deque[dict] = deque()
        self.base, self.ended = 0, False

    def __len__(self) -> int:
        return self.base + len(self.kept)

    def __getitem__(self, i: int) -> dict:
        if i < self.base:
            raise IndexError(f"row {i} is forgotten: the program keeps rows from {self.base} on")
        return self.kept[i - self.base]

    def span(self, start: int, end: int) -> list[dict]:
        """Rows start to end, both included."""
        return [self[i] for i in range(start, end + 1)]

    def has(self, i: int) -> Generator[None, None, bool]:
        """Waits for row i; False if the rows end before it."""
        while i >= len(self) and not self.ended:
            yield None
        return i < len(self)

    def forget(self, below: int) -> None:
        while self.kept and self.base < below:
            self.kept.popleft()
            self.base += 1


class Program:
    """The kernel of a program; columns are the names of its output, in order. Rows that it puts out are dicts.
    prepare(row, the row before) may add to a row what sums up any number of rows before it."""

    def __init__(self, program: Callable[[Rows], Step], columns: list[str], prepare: Callable[[dict, dict | None], None] | None = None) -> None:
        self.rows, self.columns, self.prepare, self.before = Rows(), columns, prepare, None
        self.running: Step | None = program(self.rows)

    def go_on(self) -> list[tuple]:
        out = []
        while self.running:
            try:
                found = next(self.running)
            except StopIteration:
                self.running = None
                break
            if found is None:
                break
            out.append(tuple(found.get(c) for c in self.columns))
        if self.running is None:  # what comes after the end of a program is of no use
            self.rows.forget(len(self.rows))
        return out

    def step(self, row: dict) -> list[tuple]:
        if self.prepare:
            self.prepare(row, self.before)
        self.before = row
        self.rows.kept.append(row)
        return self.go_on()

    def close(self) -> list[tuple]:
        self.rows.ended = True
        return self.go_on()
