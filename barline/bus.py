"""In-process messages: commands and events on separate channels, in order of registration."""

from __future__ import annotations

import random
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime


@dataclass(frozen=True)
class Message:
    id: str
    at: datetime

    def __post_init__(self) -> None:
        if self.at.tzinfo is None or self.at.utcoffset().total_seconds() != 0:
            raise ValueError("timestamps are UTC")


class Command(Message):
    """Asks for something."""


class Event(Message):
    """States what happened."""


@dataclass
class Bus:
    _handlers: dict = field(default_factory=lambda: defaultdict(list))

    def _register(self, kind: type, base: type, handler: Callable) -> None:
        if not issubclass(kind, base):
            raise TypeError(f"{kind.__name__} is not a {base.__name__}")
        self._handlers[base, kind].append(handler)

    def on_command(self, kind: type, handler: Callable) -> None:
        self._register(kind, Command, handler)

    def on_event(self, kind: type, handler: Callable) -> None:
        self._register(kind, Event, handler)

    def _dispatch(self, base: type, message: Message) -> int:
        if not isinstance(message, base):
            raise TypeError(f"not a {base.__name__}")
        handlers = tuple(self._handlers[base, type(message)])  # handlers added meanwhile wait
        for h in handlers:
            h(message)
        return len(handlers)

    def send(self, command: Command) -> int:
        return self._dispatch(Command, command)

    def publish(self, event: Event) -> int:
        return self._dispatch(Event, event)


class SystemClock:
    def now(self) -> datetime:
        return datetime.now(UTC)


@dataclass(frozen=True)
class FrozenClock:
    at: datetime

    def now(self) -> datetime:
        return self.at


class RandomIds:
    def new(self) -> str:
        return str(uuid.uuid4())


class SeededIds:
    """The same sequence for the same seed."""

    def __init__(self, seed: int):
        self._rng = random.Random(seed)

    def new(self) -> str:
        return str(uuid.UUID(int=self._rng.getrandbits(128), version=4))
