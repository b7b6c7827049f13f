"""Who wants to know of new files, indexes and compactions."""

from __future__ import annotations

import queue
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Notice:
    kind: str
    key: str
    path: str = ""


@dataclass
class Notifier:
    """Notices for subscribers by the beginning of the key; a subscriber whose queue is full misses some, and the number is kept."""

    size: int = 100
    subscribers: list = field(default_factory=list)
    missed: int = 0

    def subscribe(self, prefix: str = "") -> queue.Queue:
        q: queue.Queue = queue.Queue(self.size)
        self.subscribers.append((prefix, q))
        return q

    def unsubscribe(self, q: queue.Queue) -> None:
        self.subscribers = [s for s in self.subscribers if s[1] is not q]

    def publish(self, notice: Notice) -> None:
        for prefix, q in self.subscribers:
            if notice.key.startswith(prefix):
                try:
                    q.put_nowait(notice)
                except queue.Full:
                    self.missed += 1
