"""Training tables built from recorded episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import UNDECIDED
from .curation import first_per_group
from ..functions.hashing import stable_hash
from ..session import materialize
from ..skew import running_total

# Grounding protocols whose scores are no proxies.
GROUNDED_PROTOCOLS = ("region-time-v1", "evidence-chain-v1")


def _trusted() -> Column:
    return F.col("grounding_protocol").isin(*GROUNDED_PROTOCOLS) & (F.col("annotation_status") == "reviewed")


def sft_examples(traces: DataFrame, exported: Sequence[str], allow_proxy: bool = False) -> DataFrame:
    """Finished, error-free and grounded-correct traces outside the test split; only public columns leave."""
    good = (
        ~F.col("official_split").eqNullSafe("test") & (F.col("termination") == "finished") & F.col("grounded_correct") & (F.col("errors") == 0)
    )
    return traces.filter(good if allow_proxy else good & _trusted()).select(*exported)


def _beaten_by_join(kinds: DataFrame, state: Sequence[str]) -> DataFrame:
    """Pairs of kinds of a state, for states with few kinds."""
    def side(name: str) -> DataFrame:
        renamed = {c: f"{name}_{c}" for c in ("abstains", "hindsight", "score", "copies")}
        return kinds.withColumnsRenamed({**renamed, "action": f"{name}_action"})
    pairs = side("chosen").filter("chosen_score.grounded_correct").join(side("rejected"), list(state)).filter(
        (F.col("chosen_score") > F.col("rejected_score")) & (F.col("chosen_action") != F.col("rejected_action")) & ~(F.col("chosen_abstains") & F.col("rejected_hindsight"))
    )
    return pairs.select(*state, "chosen_action", "rejected_action", (F.col("chosen_copies") * F.col("rejected_copies")).alias("pairs"))


def _beaten_by_order(kinds: DataFrame, state: Sequence[str]) -> DataFrame:
    """The same for states of any size: kinds of two actions in the order of scores, and a running sum of the worse ones."""
    winners = kinds.filter("score.grounded_correct").withColumnRenamed("action", "chosen_action")
    losers = kinds.withColumnRenamed("action", "rejected_action")
    differ = F.col("chosen_action") != F.col("rejected_action")
    won = winners.join(losers.select(*state, "rejected_action").distinct(), list(state)).filter(differ)
    lost = losers.join(winners.select(*state, "chosen_action", F.col("abstains").alias("_abstains")).distinct(), list(state)).filter(differ)
    # Winners come before losers of the same score, so the sum counts the strictly worse ones.
    pair, kind, none = [*state, "chosen_action", "rejected_action", "abstains"], ["score", "side", "_own", "hindsight"], F.lit(0).cast("long")
    won = won.select(*pair, "score", F.lit(0).alias("side"), F.col("abstains").alias("_own"), "hindsight", F.col("copies").alias("better"), none.alias("worse"))
    worse = F.when(F.col("_abstains") & F.col("hindsight"), none).otherwise(F.col("copies"))
    lost = lost.select(
        *state, "chosen_action", "rejected_action", F.col("_abstains").alias("abstains"), "score", F.lit(1).alias("side"), F.col("abstains").alias("_own"),
        "hindsight", none.alias("better"), worse.alias("worse"),
    )
    ranked = running_total(won.unionByName(lost), pair, kind, "worse", "beaten", "losers")
    return ranked.select(*state, "chosen_action", "rejected_action", (F.col("better") * F.col("beaten")).alias("pairs"))


def preference_pairs(branches: DataFrame, origin: str, allow_proxy: bool = False, heavy: int = 256) -> DataFrame:
    """Better and worse first actions among branches forked from one state, with how many branch pairs say so.

    Order is (grounded, not unsupported, less request cost, less tool cost). Ties, ungrounded winners, equal actions,
    test branches and two abstentions without a failure seen before the fork give no pair. Only the first action is
    exported, so equal branches of an origin are counted before any two meet: copies multiply counts, not rows. States with more than
    ``heavy`` kinds of branches are split off: there no two kinds meet, and work grows with kinds times actions. Both ways count alike.
    """
    usable = (F.col("termination") == "finished") & ~F.col("official_split").eqNullSafe("test") & F.col("grounded_correct").isNotNull()
    rows = branches.filter(usable if allow_proxy else usable & _trusted())
    state = [origin, "world", "prefix_length", "prefix_digest", "failure_seen"]
    score = F.struct(
        F.col("grounded_correct"), (~F.col("unsupported_decision")).alias("supported"), (-F.col("request_cost")).alias("request"),
        (-F.col("tool_cost")).alias("tool"),
    )
    # Unknown verdicts and failures may be abstentions and unseen ones: what may be hindsight gives no pair.
    abstains = F.coalesce(F.col("verdict") == UNDECIDED, F.lit(True))
    hindsight = abstains & F.col("grounded_correct") & F.coalesce(~F.col("failure_seen"), F.lit(True))
    kinds = materialize(
        rows.groupBy(*state, F.col("first_action").alias("action"), abstains.alias("abstains"), hindsight.alias("hindsight"), score.alias("score"))
        .agg(F.count("*").alias("copies")), "kinds",
    )
    large = kinds.groupBy(*state).agg(F.count("*").alias("_kinds")).filter(F.col("_kinds") > heavy).drop("_kinds")
    if large.isEmpty():
        counted = _beaten_by_join(kinds, state)
    else:
        large = materialize(large, "large")
        counted = _beaten_by_join(kinds.join(large, state, "left_anti"), state).unionByName(_beaten_by_order(kinds.join(large, state, "left_semi"), state))
    return counted.groupBy(origin, "chosen_action", "rejected_action").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


def preference_examples(branches: DataFrame, prompts: DataFrame, origin: str, allow_proxy: bool = False) -> DataFrame:
    """Training examples of ``preference_pairs``: ``prompt`` and ``tools`` of the origin, ``chosen`` and ``rejected`` message.

    ``branches`` has a ``tools`` column and its first action is the first message after the fork, which must come from the
    assistant (``first_role``). Branches compare only if their tools are equal. ``prompts`` has one row per origin with its
    ``prompt``; it is joined to the finished pairs, so that no prompt is copied per branch.
    """
    spoken = branches.filter(F.col("first_role") == "assistant").withColumn("prefix_digest", F.struct("prefix_digest", F.to_json(F.array("tools")).alias("tools")))
    pairs = preference_pairs(spoken, origin, allow_proxy)
    tools = spoken.groupBy(origin).agg(F.first("tools").alias("tools"))
    return pairs.join(prompts.select(origin, "prompt"), origin).join(tools, origin).select(
        origin, "prompt", "tools", F.col("chosen_action").alias("chosen"), F.col("rejected_action").alias("rejected"), "pairs"
    )


def branch_problems(branches: DataFrame, origin: str) -> DataFrame:
    """Origins whose branches do not share world, prefix length or prefix."""
    def differ(c: str) -> Column:
        return ~F.min(c).eqNullSafe(F.max(c))
    rules = {"different_world": differ("world"), "different_prefix_length": differ("prefix_length"), "different_prefix": differ("prefix_digest")}
    grouped = branches.groupBy(origin).agg(*[v.alias(k) for k, v in rules.items()])
    codes = F.array_compact(F.array(*[F.when(F.col(k), k) for k in rules]))
    return grouped.select(origin, F.explode(codes).alias("rule"))


def rollout_groups(rollouts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group: rollouts, mean reward, range, success rate, and request and token sums."""
    return rollouts.groupBy(*group).agg(
        F.count("*").alias("rollouts"), F.avg("reward").alias("mean_reward"), (F.max("reward") - F.min("reward")).alias("reward_range"),
        F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("success"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"),
    )


def group_advantages(rollouts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Reward less the group mean; zero without variance, null for a group of one (which must be refused).

    The group statistics are aggregated and joined back, so a large group is not gathered by a window.
    """
    # Structs compare equal where fields are null, so rollouts without a group stay.
    rollouts = rollouts.withColumn("_group", F.struct(*group))
    stats = rollouts.groupBy("_group").agg(
        F.count("reward").alias("_n"), F.avg("reward").alias("_mean"), (F.max("reward") - F.min("reward")).alias("_range")
    )
    value = F.when(F.col("_n") < 2, None).when(F.col("_range") < 1e-6, 0.0).otherwise(F.col("reward") - F.col("_mean"))
    return rollouts.join(stats, "_group").withColumn("advantage", value).drop("_group", "_n", "_mean", "_range")


def _grouped(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The columns that tell which examples belong together as one struct column ``group``."""
    return df.withColumn("group", F.struct(*group)).drop(*group) if group else df


def decision_examples(messages: DataFrame, episode: str, pos: str, group: Sequence[str] = ()) -> DataFrame:
    """One example per assistant turn of nested traces: what came before it and the turn itself.

    ``messages`` is an array column in trace order; the prefix is a slice of the same row. ``group`` columns (family, variant,
    sequences, label) become one struct of the example. For long traces ``decision_turns`` names the prefix by its length.
    """
    turns = messages.select("*", F.posexplode("messages").alias(pos, "target")).filter("target.role = 'assistant'")
    return _grouped(turns.withColumn("prefix", F.slice("messages", F.lit(1), F.col(pos))).drop("messages"), group)


def decision_turns(messages: DataFrame, episode: str, pos: str, role: str = "role", group: Sequence[str] = ()) -> DataFrame:
    """Decision points of long traces: each assistant turn with the number of messages before it.

    The prefix of a turn is every message of the episode with a smaller position; it is a range, not a copy.
    """
    turns = messages.filter(F.col(role) == "assistant").select(episode, *group, F.col(pos).alias("target_pos"), F.col(pos).alias("prefix_length"))
    return _grouped(turns, group)


def training_summary(df: DataFrame, split: str, family: str) -> DataFrame:
    """Turns, families and label counts per split and task."""
    return df.groupBy(split, "task").agg(
        F.count("*").alias("turns"), F.count_distinct(family).alias("families"), F.count_if(F.col("verdict") == "Supported").alias("supported"),
        F.count_if(F.col("verdict") == "Refuted").alias("refuted"), F.count_if(F.col("verdict") == UNDECIDED).alias("undecided"),
    )


def validation_subset(cases: DataFrame, per_cell: int, salt: str) -> DataFrame:
    """All variants of ``per_cell`` families per task and verdict."""
    families = cases.select("task", "verdict", "family_id").distinct()
    chosen = first_per_group(families, ["task", "verdict"], stable_hash(F.col("family_id"), salt), per_cell, ["family_id"])
    return cases.join(chosen.select("family_id"), "family_id", "left_semi")
