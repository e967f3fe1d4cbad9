"""Refused answers have no vote; rows without a group stay; derived views, checksums and starts of search episodes."""

import hashlib

from pyspark.sql import functions as F

from tallyframe.operators import review, training, worlds
from tallyframe.plans.queries_worlds import SIG


def test_refused_answers_do_not_vote(spark):
    ddl = "packet_id string, unit_id int, reviewer_id string, sufficiency string, answer string, claim_clear boolean, citations array<string>, regions array<struct<image_id: string, bbox: array<double>>>"
    def vote(packet, unit, who, answer="Refuted", citations=("i",), sufficiency="sufficient"):
        return (packet, unit, who, sufficiency, answer, True, list(citations) if citations is not None else None, [])
    answers = spark.createDataFrame([
        vote("p", 1, "a"), vote("q", 1, "b"), vote("r", 1, "c", "Supported", ["unknown"]), vote("p", 2, "a"), vote("q", 2, "b", "Supported", None),
        vote("p", 3, "a", "maybe"), vote(None, 4, "a"), vote("p", 4, "b"), vote("p", 5, "a"),
    ], ddl)
    units = spark.createDataFrame([(i, ["i", "j"]) for i in (1, 2, 3, 4)], "unit_id int, image_ids array<string>")
    third = spark.createDataFrame([], "unit_id int, reviewer_id string, sufficiency string, answer string, claim_clear boolean")
    got = {r.unit_id: (r.votes, r.state, r.answer) for r in review.blind_consensus(answers, third, units).collect()}
    assert got == {1: (2, "consensus", "Refuted"), 2: (1, "waiting", None), 3: (0, "waiting", None), 4: (2, "consensus", "Refuted"), 5: (0, "waiting", None)}
    assert {r.unit_id: r.state for r in review.blind_consensus(answers, third).collect()}[1] == "invalid_votes"


def test_rollouts_without_a_group_keep_their_row(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 0.0), (None, 1, 3.0), (None, 1, 1.0), ("b", None, 2.0)], "g string, h int, reward double")
    got = {(r.g, r.h, r.reward): r.advantage for r in training.group_advantages(rows, ["g", "h"]).collect()}
    assert got == {("a", 1, 1.0): 0.5, ("a", 1, 0.0): -0.5, (None, 1, 3.0): 1.0, (None, 1, 1.0): -1.0, ("b", None, 2.0): None}


def test_starts_checksums_and_derived_views(spark):
    grid = worlds.world_grid(spark.createDataFrame([(1,)], "s int"), "s")
    rows = grid.withColumn("view", F.explode(F.array(*[F.lit(v) for v in worlds.VIEWS])))
    rows = rows.withColumn("flaw", F.lit(0)).withColumn("sig", F.expr(SIG.format(div="div"))).withColumn("meta", F.lit("m"))
    sigs = {(r.world_id, r.view): r.sig for r in rows.collect()}
    good = hashlib.sha256(b"{}").hexdigest()

    def seen(*views, derived=None, digest=good):
        out = [(v, sigs[3, v], f"img-{v}", False, "{}", digest) for v in views]
        return out + ([("rear_left", "shape", derived, True, "{}", good)] if derived else [])

    usual = list(worlds.INITIAL_VIEWS)
    cases = [
        ("plain", None, seen(*usual)), ("bad start", ["reference"], seen(*usual)), ("not available", [*usual, "rear_left"], seen(*usual, "rear_left")),
        ("unseen", [*usual, "front_survey"], seen(*usual)), ("free", [*usual, "front_survey"], seen(*usual, "front_survey")), ("paid", None, seen(*usual, "front_survey")),
        ("tampered", None, seen(*usual, digest="0")), ("derived", None, seen(*usual, derived="img-initial")), ("orphan", None, seen(*usual, derived="img-rear_left")),
    ]
    ddl = ("k string, initial_views array<string>, observed array<struct<view: string, sig: string, image_id: string, derived: boolean, metadata: string, metadata_sha256: string>>, "
           "bank int, world_id int, cap int, available_views array<string>, verdict string, citations_valid boolean, links_complete boolean, coverage double, localized boolean")
    few = ["original", "front_survey", "rear_center", "rear_right"]
    table = spark.createDataFrame([(k, start, views, 1, 3, 2, few, None, True, True, 1.0, True) for k, start, views in cases], ddl)
    got = {r.k: (r.audit_error, r.acquired) for r in worlds.score_search(table, rows, ["k"]).collect()}
    assert got["plain"] == (None, 0) and got["free"] == (None, 0) and got["paid"] == (None, 1) and got["derived"] == (None, 0)
    assert {k: got[k][0] for k in ("bad start", "not available", "unseen", "tampered", "orphan")} == {
        "bad start": "invalid_initial", "not available": "invalid_initial", "unseen": "initial_missing", "tampered": "metadata_checksum", "orphan": "derived_without_parent"}
    views = worlds.world_views(rows).where("world_id = 3")
    least = lambda **o: worlds.min_requests(views, **o).first().min_requests
    start = F.array(*[F.lit(v) for v in worlds.VIEWS])
    assert least(initial=start) == 0 and least() == 2
