"""The state of a rate limiter: a cooldown for each user and a window for the group."""

from __future__ import annotations

from collections import deque


class Limiter:
    """Only admitted events are remembered; the window's times leave at its head."""

    def __init__(self, cooldown: float, window: float, most: int):
        self.cooldown, self.window, self.most = cooldown, window, most
        self.last: dict = {}
        self.times: deque[float] = deque()

    def check(self, user, t: float) -> str:
        while self.times and t - self.times[0] >= self.window:
            self.times.popleft()
        if t - self.last.get(user, float("-inf")) < self.cooldown:
            return "user"
        if len(self.times) >= self.most:
            return "group"
        self.last[user] = t
        self.times.append(t)
        return "ok"
