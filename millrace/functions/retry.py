"""What can go wrong with a page or a record, and how long a reader waits before it asks again."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from millrace.model import EXHAUSTED, NO_KEY, POISON

#: Kinds of failures. The first two may pass; the others stay what they are however often one asks.
OUTAGE, THROTTLED, BAD_RECORD, DENIED, REFUSED, UNRECORDED = "outage", "throttled", "bad record", "denied", "refused", "unrecorded"


class SourceFailure(Exception):
    """A failure of one of the kinds above, with what is known of it: the wait that the server named, the record's key, the status."""

    def __init__(self, kind: str, text: str, *, wait: float | None = None, key: str | None = None, status: int | None = None) -> None:
        super().__init__(f"{kind}: {text}")
        self.kind, self.text, self.wait, self.key, self.status = kind, text, wait, key, status

    def __reduce__(self):
        return _again, (self.kind, self.text, self.wait, self.key, self.status)

    @property
    def passes(self) -> bool:
        return self.kind in (OUTAGE, THROTTLED)

    @property
    def category(self) -> str:
        """The category of the dead letter that this makes of a record."""
        if self.passes:
            return EXHAUSTED
        return POISON if self.key else NO_KEY


def _again(kind: str, text: str, wait: float | None, key: str | None, status: int | None) -> SourceFailure:
    return SourceFailure(kind, text, wait=wait, key=key, status=status)


@dataclass(frozen=True)
class Patience:
    """How often a page is asked for, and the waits in between: each so many times the last, up to a longest one.

    With ``scattered``, a wait is drawn between zero and what the schedule says, so that readers do not come back together.
    """

    tries: int = 4
    first: float = 0.5
    growth: float = 2.0
    longest: float | None = 30.0
    scattered: bool = False

    def waits(self) -> list[float]:
        if self.tries < 1:
            raise ValueError("a page must be asked for once at least")
        grown = (self.first * self.growth**i for i in range(self.tries - 1))
        return [w if self.longest is None else min(w, self.longest) for w in grown]

    def fetch(self, ask: Callable[[], dict], pause: Callable[[float], None] = time.sleep, tell: Callable[[float, SourceFailure], None] | None = None) -> dict:
        """The answer, asked for again after failures that may pass; a wait that the server names goes before the schedule."""
        left = self.waits()
        while True:
            try:
                return ask()
            except SourceFailure as failure:
                if not failure.passes or not left:
                    raise
                due = left.pop(0)
                if self.scattered:
                    due *= random.random()
                due = due if failure.wait is None else failure.wait
                if tell:
                    tell(due, failure)
                pause(due)


def answer(path: str, status: int, headers: dict[str, str], body: dict) -> dict:
    """The body of a response that is fine, else the failure that its status stands for."""
    if 200 <= status < 300:
        return body
    said = f"{status} on {path}: {body.get('message', '')}"
    if status == 429:
        raise SourceFailure(THROTTLED, said, wait=_seconds({k.lower(): v for k, v in headers.items()}.get("retry-after")), status=status)
    if status in (401, 403):
        raise SourceFailure(DENIED, said, status=status)
    raise SourceFailure(OUTAGE if status >= 500 else REFUSED, said, status=status)


def _seconds(given: str | None) -> float | None:
    try:
        wait = float(given) if given is not None else -1.0
    except ValueError:
        return None
    return wait if wait >= 0 else None
