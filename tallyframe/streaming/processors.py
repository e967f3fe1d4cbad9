"""Keyed state machines on Spark's state store: sessions and ledgers.

State per key lives in RocksDB and is read and written per micro-batch for the keys that occur in it; no batch reads what
earlier batches wrote. A key's rows of one batch are put in order in the task, so a task holds one key's share of one batch,
which the trigger bounds.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class Sessions(StatefulProcessor):
    """Turns, requests and first finish of a session; events after the finish are counted as rejected.

    With ``idle_ms`` and event time, a session of which nothing came for that long is given out and forgotten; an event that
    comes still later opens a new one.
    """

    def __init__(self, keys: list[str], order: str, action: str, idle_ms: int | None = None, millis: str = "_ms"):
        self.keys, self.order, self.action, self.idle_ms, self.millis = keys, order, action, idle_ms, millis

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "turns bigint, requests bigint, rejected bigint, finished_at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        places, asks, end, newest = array("q"), array("b"), None, None
        for row in rows:
            at, action = row[self.order], row[self.action]
            places.append(at)
            asks.append(action == "request")
            if action == "finish" and (end is None or at < end):
                end = at
            if self.idle_ms is not None and (newest is None or row[self.millis] > newest):
                newest = row[self.millis]
        turns, requests, rejected, finished = self.session.get() or (0, 0, 0, None)
        if finished is not None:
            rejected += len(places)
        else:
            for at, ask in zip(places, asks):
                if end is None or at <= end:
                    turns, requests = turns + 1, requests + ask
                else:
                    rejected += 1
            finished = end
        self.session.update((turns, requests, rejected, finished))
        if newest is not None:
            set_ = [*self.handle.listTimers()]
            for timer in set_:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([newest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1, *set_]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.session.get()
        self.session.clear()
        if held:
            yield Row(*self.keys, "turns", "requests", "rejected", "finished_at")(*key, *held)

    def close(self) -> None:
        pass


class Ledger(StatefulProcessor):
    """Reserve, respond, settle and seal in order under a total cap and a cap per stage.

    An unresolved reservation blocks new ones, also after its response was kept; a charge above its bound leaves the
    reservation unresolved; a key that was settled before is reused at no cost; a sealed ledger takes no new reservation.

    Every call of the state store is a message to another process, and so is every key. A key therefore stands for several ledgers,
    whose accounts are one JSON text, read once and written once per batch. A ledger's first stages and settled keys, ``inline`` of
    each, lie in its account; further ones have entries of their own.
    """

    OUT = "ledger bigint, seq bigint, key string, outcome string, accounted bigint"

    def __init__(self, cap: int, stage_cap: int, inline: int = 64):
        self.cap, self.stage_cap, self.inline = cap, stage_cap, inline

    def init(self, handle) -> None:
        self.accounts = handle.getValueState("accounts", "accounts string")
        self.stages = handle.getMapState("stages", "ledger bigint, stage string", "used bigint")
        self.paid = handle.getMapState("paid", "ledger bigint, key string", "charge bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row = Row("ledger", "seq", "key", "outcome", "accounted")
        for outcome in self.outcomes(r.asDict() for r in rows):
            yield row(*outcome)

    def outcomes(self, operations: Iterable[dict]) -> Iterator[tuple]:
        """Outcomes of operations in any order, ledger by ledger."""
        held = self.accounts.get()
        accounts = {account[0]: account for account in (json.loads(held[0]) if held else ())}
        by_ledger: dict = {}
        for operation in operations:
            by_ledger.setdefault(operation.get("ledger"), []).append(operation)
        for ledger, own in by_ledger.items():
            own.sort(key=lambda o: o["seq"])
            account = accounts.get(ledger) or (ledger, 0, None, 0, None, False, [], [], [])
            accounts[ledger] = yield from self.run(account, own)
        self.accounts.update((json.dumps([*accounts.values()]),))

    def run(self, account: Sequence, operations: list[dict]):
        """The outcomes of a ledger's operations, and its account after them."""
        ledger, total, held_key, held_bound, held_stage, sealed, *lists = account
        used, paid = dict(zip(lists[0], lists[1])), dict.fromkeys(lists[2])
        # What is not in the account; the store has some of it only where the account was full before.
        stages_full, paid_full = len(used) >= self.inline, len(paid) >= self.inline
        more_used: dict = {}
        more_paid: dict = {}
        changed: set = set()

        def named(stage) -> str:
            return f"={stage}" if stage is not None else "~"

        def spent(name) -> int:
            if name in used:
                return used[name]
            if name not in more_used:
                held = self.stages.getValue((ledger, name)) if stages_full else None
                more_used[name] = held[0] if held else 0
            return more_used[name]

        def known(call) -> bool:
            return call is not None and (call in paid or call in more_paid or (paid_full and self.paid.containsKey((ledger, call))))

        for operation in operations:
            op, call, bound, charge = (operation.get(name) for name in ("op", "key", "bound", "charge"))
            open_, outcome = held_stage is not None, "no_reservation"
            if op == "reserve":
                if known(call):
                    outcome = "reused"
                elif sealed:
                    outcome = "ledger_sealed"
                elif open_:
                    outcome = "blocked"
                elif total + bound > self.cap or spent(named(operation.get("stage"))) + bound > self.stage_cap:
                    outcome = "over_cap"
                else:
                    held_key, held_bound, held_stage, outcome = call, int(bound), named(operation.get("stage")), "reserved"
            elif op == "seal":
                sealed, outcome = True, "sealed"
            elif op == "respond":
                outcome = "responded" if open_ and held_key == call else "no_reservation"
            elif open_ and held_key == call:
                outcome = "unresolved"
                if charge is not None and charge <= held_bound:
                    total += charge
                    amount = spent(held_stage) + charge
                    if held_stage in used or len(used) < self.inline:
                        used[held_stage] = amount
                    else:
                        more_used[held_stage] = amount
                        changed.add(held_stage)
                    if call is not None and len(paid) < self.inline:
                        paid[call] = None
                    elif call is not None:
                        more_paid[call] = charge
                    held_key, held_bound, held_stage, outcome = None, 0, None, "settled"
            yield ledger, operation["seq"], call, outcome, total + held_bound
        for name in changed:
            self.stages.updateValue((ledger, name), (more_used[name],))
        for call, charge in more_paid.items():
            self.paid.updateValue((ledger, call), (charge,))
        return ledger, total, held_key, held_bound, held_stage, sealed, [*used], [*used.values()], [*paid]

    def close(self) -> None:
        pass


class PackedLedgers(Ledger):
    """Ledgers whose operations come as JSON texts in the second column; a key gives its outcomes as one row of lists.

    Rows and their cells pass between Spark and Python one by one, which takes longer than the operations themselves.
    """

    PACKED = "ledger array<bigint>, seq array<bigint>, key array<string>, outcome array<string>, accounted array<bigint>"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        operations = json.loads("[" + ",".join([row[1] for row in rows]) + "]")
        lists = [*map(list, zip(*self.outcomes(operations)))]
        if lists:
            yield Row("ledger", "seq", "key", "outcome", "accounted")(*lists)
