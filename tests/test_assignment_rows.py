"""Families are rows, people are bits of masks, and a conflict meets its partner instead of drawing one."""

from test_assignment import assigned, check

from tallyframe.operators import assignment


def test_more_people_than_a_word_has_bits(spark):
    rows = [(f"f{i}", "t", [f"a{i // 4}", f"b{i % 16}"]) for i in range(65)]
    check(assigned(spark, rows, people=130, seed=4), rows, 130)


def test_tasks_without_a_name_and_families_without_groups(spark):
    rows = [(f"f{i}", None if i % 2 else "t", [f"a{i // 3}"] if i % 5 else ([] if i % 3 else None)) for i in range(48)]
    check(assigned(spark, rows, people=24, seed=4), rows, 24)


def test_rounds_are_few_and_work_on_families(spark, monkeypatch):
    seen, keep = [], assignment.materialize

    def counted(df, name):
        out = keep(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(assignment, "materialize", counted)
    n = 480
    rows = [(f"f{i}", f"t{i % 2}", [f"near{i // 3}", f"far{i % (n // 4)}"]) for i in range(n)]
    check(assigned(spark, rows, people=40, seed=5), rows, 40)
    slots = [count for name, count in seen if name == "slots"]
    assert set(slots) == {n}
    assert len(slots) <= 20
    # Every round ends a good part of the conflicts that are many.
    done = [count for name, count in seen if name == "done"]
    assert sum(done[:3]) > sum(done[3:])
