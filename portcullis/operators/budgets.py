"""Budgets with reservations: estimates, the four limits, settlements that come late or never.

An account is one identity's state. Batch folds it over the identity's requests in their order; the stream
keeps it between batches (``streaming/budgets.py``); both take the same steps. Money is counted in whole
hundred-millionths, the digits that a reservation is rounded to, so sums are exact in any order.

Whether a request is refused decides what later ones meet, so an identity's requests can't be summed up in
parts: they stay in one task, which holds its open reservations and nothing else.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import deque
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from portcullis.operators.state import in_turn, micros

UNIT = 10**8
REQUEST = ["prompt_tokens", "max_tokens", "price_in", "price_out", "settles_s", "used_tokens", "used_cost", "used_compute"]
DECISION = "event_id long, refused string, retry_after_s long, tokens long, cost double"


@dataclass(frozen=True)
class Limits:
    """What an identity may use in a window of ``window`` seconds (aligned in UTC), requests in a sliding
    ``minute``, and how long a reservation holds that isn't settled. A null limit is none."""

    rpm: int | None = None
    tokens: int | None = None
    cost: float | None = None
    compute: float | None = None
    window: int = 86_400
    # The sliding minute, the life of a reservation, the tokens reserved for an answer.
    minute: int = 60
    held: int = 600
    answer: int = 512


def units(cost: float | None) -> int:
    return round((cost or 0) * UNIT)


@dataclass
class Account:
    bucket: int = -1
    tokens: int = 0
    cost: int = 0
    compute: float = 0.0
    recent: deque = field(default_factory=deque)
    #: (ends, number, settled, bucket, tokens, cost, used tokens, used cost, used compute), the next to end first.
    open: list[tuple] = field(default_factory=list)
    held_tokens: int = 0
    held_cost: int = 0
    number: int = 0

    def to_time(self, now: float, limits: Limits) -> None:
        """Settle and drop what ended by ``now``, and begin a new window if it is time."""
        bucket = int(now // limits.window)
        if bucket != self.bucket:
            self.bucket, self.tokens, self.cost, self.compute = bucket, 0, 0, 0.0
            self.held_tokens = sum(o[4] for o in self.open if o[3] == bucket)
            self.held_cost = sum(o[5] for o in self.open if o[3] == bucket)
        while self.open and self.open[0][0] <= now:
            _, _, settled, own, tokens, cost, used_tokens, used_cost, used_compute = heapq.heappop(self.open)
            if own != bucket:
                continue  # its window is over
            self.held_tokens, self.held_cost = self.held_tokens - tokens, self.held_cost - cost
            if settled:
                self.tokens, self.cost, self.compute = self.tokens + used_tokens, self.cost + used_cost, self.compute + used_compute
        while self.recent and self.recent[0] <= now - limits.minute:
            self.recent.popleft()

    def estimate(self, row: dict, limits: Limits) -> tuple[int, int]:
        """Tokens and cost to reserve. A request that doesn't say how long its answer may get reserves what is left, up to a bound."""
        prompt, asked = row["prompt_tokens"] or 0, row["max_tokens"]
        left = limits.answer if limits.tokens is None else max(0, limits.tokens - self.tokens - prompt)
        answer = asked if asked is not None else min(limits.answer, left)
        if row["price_in"] is None or row["price_out"] is None:
            return prompt + answer, 0
        prompt_cost, answer_cost = prompt / 1000 * row["price_in"], answer / 1000 * row["price_out"]
        if limits.cost is not None and asked is None:
            answer_cost = min(answer_cost, max(0.0, limits.cost - self.cost / UNIT - prompt_cost))
        return prompt + answer, units(round(prompt_cost + answer_cost, 8))

    def request(self, now: float, row: dict, limits: Limits) -> tuple:
        """What ``DECISION`` names. Refused requests leave no trace."""
        self.to_time(now, limits)
        tokens, cost = self.estimate(row, limits)
        broken = {
            "rpm": limits.rpm is not None and len(self.recent) >= limits.rpm,
            "tokens": limits.tokens is not None and self.tokens + self.held_tokens + tokens > limits.tokens,
            "cost": limits.cost is not None and self.cost + self.held_cost + cost > units(limits.cost),
            "compute": limits.compute is not None and self.compute >= limits.compute,
        }
        if refused := next((name for name, is_broken in broken.items() if is_broken), None):
            again = (self.recent[0] if self.recent else now) + limits.minute if refused == "rpm" else (self.bucket + 1) * limits.window
            return row["event_id"], refused, max(1, math.ceil(again - now)), tokens, cost / UNIT
        self.recent.append(now)
        late = row["settles_s"] is None or row["settles_s"] >= limits.held
        self.number += 1
        ends = now + (limits.held if late else row["settles_s"])
        heapq.heappush(self.open, (ends, self.number, not late, self.bucket, tokens, cost, row["used_tokens"] or 0, units(row["used_cost"]), row["used_compute"] or 0.0))
        self.held_tokens, self.held_cost = self.held_tokens + tokens, self.held_cost + cost
        return row["event_id"], None, None, tokens, cost / UNIT

    def lapses(self, limits: Limits) -> float:
        """When nothing of the account matters any more: its window, its reservations and its minute are over."""
        return max([(self.bucket + 1) * limits.window, *(o[0] for o in self.open), *(t + limits.minute for t in self.recent)])

    def packed(self) -> str:
        return json.dumps(asdict(self) | {"recent": list(self.recent)})

    @classmethod
    def unpacked(cls, text: str) -> Account:
        held = json.loads(text)
        return cls(**held | {"recent": deque(held["recent"]), "open": [tuple(o) for o in held["open"]]})


def reservations(events: DataFrame, identity: str, limits: Limits) -> DataFrame:
    """The decision on each request of ``events`` (event_id, ts and ``REQUEST``).

    A request reserves its prompt and the answer it may get, at the model's prices (null: free), and settles what
    it used ``settles_s`` later (null: never). It is refused by the first limit that it breaks, of requests in a
    minute, tokens, cost and compute; ``refused`` names the limit. Reservations that aren't settled in time lapse.
    """
    rows = events.select(identity, "event_id", micros().alias("t"), *REQUEST)
    return in_turn(rows, identity, ["t", "event_id"], DECISION, Account, lambda account, row: account.request(row["t"] / 1e6, row, limits))
