"""What a ledger keeps in its account and what beside it changes no outcome, and a batch takes few calls of the state store."""

import random

from pyspark.sql import Row

from tallyframe.streaming.processors import Ledger


class Store:
    """State of one ledger, counting its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, name, schema):
        return Held(self, name)

    def getMapState(self, name, key, value):
        return Held(self, name)


class Held:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def at(self, key=()):
        self.store.calls += 1
        return self.store.values.get((self.name, key))

    get = getValue = at

    def containsKey(self, key):
        return self.at(key) is not None

    def update(self, value):
        self.updateValue((), value)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.values[(self.name, key)] = value


def run(rows, batch, inline):
    store, out = Store(), []
    for start in range(0, len(rows), batch):
        processor = Ledger(4000, 300, inline)
        processor.init(store)
        out += processor.handleInputRows((1,), iter(rows[start:start + batch]), None)
    return [tuple(r) for r in out], store


def operations(n):
    rng, rows = random.Random(4), []
    for seq in range(0, n, 2):
        key, stage = f"k{rng.randrange(n // 3)}" if seq % 11 else None, rng.choice([None, *"abcdefgh"])
        rows.append(Row(ledger=1, seq=seq, op="reserve", key=key, stage=stage, bound=rng.randrange(1, 60), charge=None))
        rows.append(Row(ledger=1, seq=seq + 1, op="settle", key=key, stage=stage, bound=None, charge=rng.randrange(0, 20)))
    return rows


def test_outcomes_do_not_depend_on_what_lies_in_the_account():
    rows = operations(600)
    rows = [r for r in rows if r.op != "settle" or r.charge is not None]
    want, _ = run(rows, len(rows), 10**6)
    assert {o[3] for o in want} >= {"reserved", "settled", "reused"}
    for inline in (0, 1, 3, 64):
        for batch in (1, 7, 100):
            got, store = run(rows, batch, inline)
            assert got == want
            assert inline > 3 or any(name == "paid" for name, _ in store.values)


def test_a_batch_of_a_short_ledger_takes_two_calls():
    rows = operations(60)
    _, store = run(rows, 20, 64)
    assert store.calls == 2 * 3
