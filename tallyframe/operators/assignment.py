"""Assignment of (family, arm, repeat) slots to people: equal quotas, no person meets a source group twice.

Slots of a task and arm are numbered and dealt to people in turn, which makes every quota exact. What then breaks the rule
is repaired by swaps of two slots of the same task and arm, which keep the quotas. A family is one row with the people of its slots.
In a round each family learns, from bit masks of the people of its groups, which of its slots are in conflict and whom it could
still take. A slot in conflict meets slots of somebody it could take who could take its own person, and of these swaps those are
carried out that share no slot and no (person, group) with a swap of higher priority, so that they cannot disturb each other.
Each such swap ends a conflict and makes none; where that gets on slowly, every third round hands conflicts on to other slots instead, which leads out of
dead ends. Only slots in conflict and a sample of the others, as large as is needed to find a partner, take part in a round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import stable_hash
from ..session import materialize
from ..skew import ordered_index, shuffled

# Rows from which on a side of a join is shuffled: Spark takes rows with arrays for as small as their files, and would pass them
# through the driver.
MANY = 20_000


class Infeasible(ValueError):
    """No assignment keeps the quotas and meets every source once."""


def joined_by_size(df: DataFrame, rows: int) -> DataFrame:
    """A join side of about so many rows: shuffled where they are many, else left to Spark."""
    return shuffled(df) if rows >= MANY else df


def group_names(groups: str, key: str) -> Column:
    """The groups of a family, and the family itself: nobody gets a family twice either."""
    named = F.transform(F.coalesce(F.col(groups), F.array().cast("array<string>")), lambda g: F.concat(F.lit("g:"), g))
    return F.array_distinct(F.array_compact(F.array_append(named, F.concat(F.lit("f:"), F.col(key).cast("string")))))


def dealt_slots(families: DataFrame, task: str, groups: str, key: str, arms: int, repeats: int, people: int, seed: int) -> DataFrame:
    """Families with the people of their slots (``_who``, arm by arm), quotas exact, a number ``_f`` and the ids of their groups."""
    names = group_names(groups, key)
    first = F.array_min(F.transform(names, lambda g: stable_hash(g, str(seed))))
    rows = families.withColumn("_names", names).withColumn("_lead", first).withColumn("_own", stable_hash(F.col(key), str(seed)))
    numbered = ordered_index(rows, [task], ["_lead", "_own"], "_rank")
    who = []
    for arm in range(arms):
        for repeat in range(repeats):
            # Arms start a share of all people apart, so that the slots of a source do not meet in the next arm.
            who.append(((F.col("_rank") - 1) * repeats + repeat + arm * (people // arms)) % people)
    # Ids stand for names. Two groups of one id would be kept apart as if they were one, which breaks no rule. The family's own name,
    # the last one, stands where there is no other: its slots are told apart in its row.
    ids = F.transform("_names", lambda g: F.xxhash64(g))
    shared = F.when(F.size(ids) > 1, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids)
    return numbered.select(
        *families.columns, F.monotonically_increasing_id().alias("_f"), F.col(task).alias("_task"), F.array_distinct(shared).alias("_groups"),
        F.array(*who).cast("array<int>").alias("_who"),
    )


def check_feasible(families: DataFrame, task: str, groups: str, key: str, width: int, repeats: int, people: int) -> None:
    """Raise ``Infeasible`` where counts alone rule an assignment out."""
    uneven = families.groupBy(task).agg(F.count("*").alias("n")).where((F.col("n") * repeats) % people != 0)
    if (row := uneven.first()) is not None:
        raise Infeasible(f"{row.n} families of {row[task]} with {repeats} repeats cannot be dealt evenly to {people} people")
    named = families.select(F.explode(F.array_distinct(group_names(groups, key))).alias("group"))
    often = named.groupBy("group").agg((F.count("*") * width).alias("n")).where(F.col("n") > people)
    if (row := often.first()) is not None:
        raise Infeasible(f"{row.group} has {row.n} slots for {people} people")


def words(people: int) -> range:
    """Numbers of the 64-bit words of a mask of people."""
    return range((people + 63) // 64)


def any_bit(name: str, people: int) -> Column:
    return F.expr(" OR ".join(f"{name}{w} <> 0" for w in words(people)))


def met_masks(slots: DataFrame, people: int, width: int, salt: int) -> DataFrame:
    """Per family the people who have to go (``_must``, a mask of several words) and those it could take (``_free``): of all families of a
    group that have a person, the first in a drawn order may keep the slot."""
    owns = [" | ".join(f"IF(_who[{j}] div 64 = {w}, shiftleft(1L, _who[{j}] % 64), 0L)" for j in range(width)) for w in words(people)]
    rows = slots.select("_f", F.explode("_groups").alias("_group"), F.xxhash64("_f", F.lit(salt)).alias("_h"), *[F.expr(own).alias(f"_own{w}") for w, own in enumerate(owns)])
    # A group has no more families than people, so a window over it is short.
    ahead = W.partitionBy("_group").orderBy("_h", "_f").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("_group").orderBy(F.desc("_h"), F.desc("_f")).rowsBetween(W.unboundedPreceding, -1)
    for w in words(people):
        rows = rows.withColumn(f"_ahead{w}", F.coalesce(F.bit_or(f"_own{w}").over(ahead), F.lit(0).cast("long")))
    for w in words(people):
        rows = rows.withColumn(f"_behind{w}", F.coalesce(F.bit_or(f"_own{w}").over(behind), F.lit(0).cast("long")))
    met = rows.groupBy("_f").agg(*[F.any_value(f"_own{w}").alias(f"_own{w}") for w in words(people)], *[F.bit_or(f"{n}{w}").alias(f"{n}{w}") for n in ("_ahead", "_behind") for w in words(people)])
    return met.select(
        "_f", *[F.expr(f"_own{w} & _ahead{w}").alias(f"_must{w}") for w in words(people)], *[F.expr(f"~(_own{w} | _ahead{w} | _behind{w})").alias(f"_free{w}") for w in words(people)]
    )


def offered_slots(movers: DataFrame, repeats: int, width: int, people: int, tries: int, salt: int) -> DataFrame:
    """Slots that take part in a round, once for each of up to ``tries`` people ``q`` whom they could take instead of ``p``."""
    def bit(name: str, person: str) -> str:
        mask = f"array({', '.join(f'{name}{w}' for w in words(people))})"
        return f"(shiftrightunsigned({mask}[CAST({person} div 64 AS INT)], {person} % 64) & 1L) = 1L"

    able = movers.withColumn("_able", F.expr(f"filter(sequence(0, {people - 1}), x -> {bit('_free', 'x')})"))
    each = able.select("*", F.posexplode("_who").alias("_j", "p")).withColumn("_must", F.expr(bit("_must", "p"))).where("_must OR _drawn")
    start = F.pmod(F.xxhash64("_f", "_j", F.lit(salt)), F.size("_able"))
    some = F.slice(F.concat("_able", "_able"), start.cast("int") + 1, F.least(F.size("_able"), F.lit(tries)))
    each = each.where(F.size("_able") > 0).withColumn("_some", some)
    return each.select("_task", F.expr(f"_j div {repeats}").alias("_arm"), (F.col("_f") * width + F.col("_j")).alias("slot"), "p", "_some", "_must", "_groups", "_who")


def sound_swaps(offers: DataFrame, cells: int, salt: int, both: bool = True) -> DataFrame:
    """Swaps (slots ``a`` in conflict and ``b``, persons ``p``, ``q``, groups and ``rank``, a hash) after which neither person meets a group
    twice, or with ``both`` unset the one who gets the slot in conflict does not: the conflict then moves on to the other.

    Slots that look for one person in place of another, and those that offer just that, meet in a cell; ``cells`` parts each of them.
    """
    side = [F.xxhash64("slot", F.lit(salt)).alias("h"), "slot", F.col("_groups").alias("groups"), "p"]
    wanted = offers.where("_must" if both else f"_must AND pmod(xxhash64(slot, {salt}), 2) = 0")
    own = F.array().cast("array<int>") if both else F.col("_who")
    seek = wanted.select("_task", "_arm", (F.col("p") if both else F.lit(-1)).alias("x"), F.explode("_some").alias("y"), F.struct(*side, own.alias("own")).alias("seek"))
    if both:
        offer = offers.select("_task", "_arm", F.explode("_some").alias("x"), F.col("p").alias("y"), F.struct(*side, own.alias("own")).alias("offer"))
    else:
        offer = offers.select("_task", "_arm", F.lit(-1).alias("x"), F.col("p").alias("y"), F.struct(*side, own.alias("own")).alias("offer"))
    none = {name: F.lit(None).cast(df.schema[name].dataType) for name, df in (("seek", seek), ("offer", offer))}
    rows = seek.withColumn("offer", none["offer"]).unionByName(offer.withColumn("seek", none["seek"]))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.coalesce("seek.slot", "offer.slot"), "x", "y", F.lit(salt)), F.lit(cells)))
    met = rows.groupBy("_task", "_arm", "x", "y", "_part").agg(F.array_sort(F.collect_list("seek")).alias("seek"), F.array_sort(F.collect_list("offer")).alias("offer"))
    n = F.least(F.size("seek"), F.size("offer"))
    pairs = met.select("x", "y", F.explode(F.arrays_zip(F.slice("seek", 1, n).alias("s"), F.slice("offer", 1, n).alias("o"))).alias("pair")).select("y", "pair.s", "pair.o")
    pairs = pairs.select(
        F.col("s.slot").alias("a"), F.col("o.slot").alias("b"), F.col("s.p").alias("p"), F.col("y").alias("q"), F.col("s.groups").alias("mine"), F.col("o.groups").alias("theirs"),
        F.col("o.own").alias("own"), F.xxhash64("s.slot", "o.slot", F.lit(salt)).alias("rank"),
    )
    # A family takes nobody twice, whatever else is handed on.
    return pairs.where("NOT array_contains(own, p)").drop("own")


def compatible_swaps(swaps: DataFrame, width: int, rows: int = 0) -> DataFrame:
    """One swap per slot, and of swaps that claim the same slot, (person, group) or (person, family) the one with the smallest rank."""
    best = swaps.withColumn("_turn", F.row_number().over(W.partitionBy("a").orderBy("rank", "b"))).where("_turn = 1")
    best = best.withColumn("_turn", F.row_number().over(W.partitionBy("b").orderBy("rank", "a"))).where("_turn = 1")
    swaps = materialize(best.drop("_turn"), "chosen")
    def claims(person: str, groups: str) -> Column:
        return F.transform(groups, lambda g: F.xxhash64(F.lit("c"), F.col(person), g))

    # A claim that two swaps share by chance costs one of them this round.
    slots = [F.xxhash64(F.lit("s"), F.col(c)) for c in ("a", "b")]
    own = [F.xxhash64(F.lit("f"), F.col(person), F.expr(f"{slot} div {width}")) for person, slot in (("q", "a"), ("p", "b"))]
    claimed = F.concat(F.array(*slots, *own), claims("q", "mine"), claims("p", "theirs"))
    order = F.struct("rank", "a")
    claimants = swaps.select("a", order.alias("order"), F.explode(F.array_distinct(claimed)).alias("claim"))
    lost = claimants.withColumn("_first", F.min("order").over(W.partitionBy("claim"))).where("order <> _first").select("a").distinct()
    return swaps.join(joined_by_size(lost, rows), "a", "left_anti").select("a", "b", "p", "q")


def assign_disjoint(
    families: DataFrame, task: str, groups: str, key: str, arms: Sequence[str], repeats: int, people: int, seed: int, rounds: int = 100, tries: int = 8,
) -> DataFrame:
    """Every (family, arm, repeat) slot with a ``person``: each person has the same number of slots of each (task, arm), and no group of
    ``groups`` (an array of strings; null: none) nor family twice.

    ``Infeasible`` is raised where counts rule that out, and where no swap is found in ``rounds`` rounds.
    Keys must be unique. The columns of ``families`` stay; ``arm``, ``repeat`` and ``person`` are added. ``tries`` is how many
    people a slot in conflict asks for at least while there are many of them.
    """
    width = len(arms) * repeats
    check_feasible(families, task, groups, key, width, repeats, people)
    dealt = materialize(dealt_slots(families, task, groups, key, len(arms), repeats, people, seed), "slots")
    slots = dealt.select("_f", "_task", "_groups", "_who")
    size = slots.groupBy("_task").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).first()
    total, cells = (size.n or 0) * width, size.tasks * len(arms) * people * people
    before = None
    for number in range(rounds):
        salt = seed + number
        met = materialize(met_masks(slots, people, width, salt), "met")
        rows = met.agg(F.sum(F.expr(" + ".join(f"bit_count(_must{w})" for w in words(people))))).first()[0]
        if not rows:
            who = dealt.drop("_who", "_groups", "_task").join(slots.select("_f", "_who"), "_f").select(*families.columns, F.posexplode("_who").alias("_j", "person"))
            arm = F.get(F.array(*[F.lit(a) for a in arms]), F.floor(F.col("_j") / repeats).cast("int"))
            return who.select(*families.columns, arm.alias("arm"), (F.col("_j") % repeats).alias("repeat"), "person")
        # Few conflicts are left at the end: they ask for everybody. Where rounds end few of them, half hand their conflict on in every third.
        both = number % 3 < 2 or rows < 0.6 * before
        before = rows
        asked = max(2, min(people, max(tries, total // (4 * rows)) if rows < total // 10 else tries // 4))
        # Slots in conflict meet one another; where they are few, others are drawn, several for each cell.
        drawn = (3 * cells + (2 * rows if rows < total // 10 else 0)) / total
        part = met.withColumn("_drawn", F.pmod(F.xxhash64("_f", F.lit(salt), F.lit("drawn")), F.lit(2**20)) < int(min(1.0, drawn) * 2**20) + 1)
        part = joined_by_size(part.where(any_bit("_must", people) | F.col("_drawn")), rows + int(min(1.0, drawn) * total))
        movers = materialize(slots.join(part, "_f"), "movers")
        offers = offered_slots(movers, repeats, width, people, asked, salt)
        swaps = materialize(sound_swaps(offers, max(1, rows * asked // (8 * cells)), salt, both), "swaps")
        done = materialize(compatible_swaps(swaps, width, rows), "done")
        moved = done.select(F.col("a").alias("slot"), F.col("q").alias("new")).unionByName(done.select(F.col("b").alias("slot"), F.col("p").alias("new")))
        moved = moved.groupBy(F.expr(f"slot div {width}").alias("_f")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("slot") % width).cast("int"), "new"))).alias("_new"))
        after = F.transform("_who", lambda p, j: F.coalesce(F.try_element_at("_new", j), p))
        slots = slots.join(joined_by_size(moved, rows), "_f", "left").withColumn("_who", F.when(F.col("_new").isNull(), F.col("_who")).otherwise(after)).drop("_new")
        slots = materialize(slots, "slots")
    raise Infeasible(f"no source-disjoint assignment was found in {rounds} rounds")
