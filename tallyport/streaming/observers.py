"""Observers of streams that cannot harm them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

EVENTS = ("started", "progress", "idle", "terminated")


class Observers(StreamingQueryListener):
    """Calls every observer with the kind of an event and the event, in the order they were added.

    What an observer raises stops neither the query nor the observers after it; ``failures`` counts it, by observer and kind.  An
    observer that has been taken out is not called any more, not even for an event that is being told.
    """

    def __init__(self) -> None:
        self._observers: dict[int, Callable[[str, object], None]] = {}
        self._next = 0
        self.failures: Counter[tuple[int, str]] = Counter()

    def add(self, observer: Callable[[str, object], None]) -> Callable[[], None]:
        """Takes an observer in; what is returned takes it out."""
        number, self._next = self._next, self._next + 1
        self._observers[number] = observer
        return lambda: self._observers.pop(number, None) and None

    def _tell(self, kind: str, event: object) -> None:
        for number in list(self._observers):
            observer = self._observers.get(number)
            try:
                if observer:
                    observer(kind, event)
            except Exception:  # noqa: BLE001  whatever it is, it is the observer's own affair
                self.failures[number, kind] += 1

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._tell("started", event)

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        self._tell("progress", event)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        self._tell("idle", event)

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self._tell("terminated", event)
