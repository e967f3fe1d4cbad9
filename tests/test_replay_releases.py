"""The released set against a replay one action at a time."""

import random

from tallyframe.operators import traces

PRICES = {"request_photo": 3, "crop": 1, "ocr": 2, "compare": 2}


def brute(actions, evidence, budget):
    out = {}
    for episode in {a[0] for a in actions}:
        own = [e for e in evidence if e[0] == episode]
        left, done, released, order = budget, False, {e[2] for e in own if e[4]}, []
        for _, pos, name, view, image in sorted(a for a in actions if a[0] == episode):
            price, given, new = PRICES.get(name), None, False
            if done:
                outcome = "episode_finished"
            elif name == "finish":
                outcome = "finished" if image is None or image in released else "unreleased_image"
            elif price is None:
                outcome = "unknown_action"
            elif price > left:
                outcome = "insufficient_budget"
            elif name != "request_photo" and image is not None and image not in released:
                outcome = "unreleased_image"
            else:
                outcome, left = "accepted", left - price
            done = done or outcome == "finished"
            before = [*sorted(e[2] for e in own if e[4]), *order]
            if outcome == "accepted" and name == "request_photo":
                usable = sorted(e[2] for e in own if e[1] == view and e[3])
                fresh = [i for i in usable if i not in released]
                given = fresh[0] if fresh else usable[0] if usable else None
                if fresh:
                    new = True
                    released.add(given)
                    order.append(given)
            out[episode, pos] = (outcome, given, new, len(released), tuple(before))
    return out


def check(spark, actions, evidence, budget):
    acts = spark.createDataFrame(actions, "episode int, pos int, name string, view string, image int").repartition(3)
    images = spark.createDataFrame(evidence, "episode int, view string, image int, available boolean, released boolean")
    replayed = traces.replay_releases(acts, images, budget).cache()
    listed = {}
    for r in traces.released_before(replayed, images).collect():
        listed.setdefault((r.episode, r.pos), []).append((-1 if r.since is None else r.since, r.image))
    got = {(r.episode, r.pos): (r.outcome, r.given, r.is_new, r.n_released, tuple(i for _, i in sorted(listed.get((r.episode, r.pos), [])))) for r in replayed.collect()}
    assert got == brute(actions, evidence, budget)
    return got


def test_releases_and_budget_depend_on_each_other(spark):
    rng = random.Random(1)
    evidence = [(e, f"v{i % 4}", i, rng.random() < 0.8, rng.random() < 0.2) for e in range(12) for i in range(16)]
    actions = []
    for episode in range(13):
        for pos in range(rng.randrange(1, 60)):
            name = rng.choice(["request_photo", "crop", "ocr", "compare", "crop", "paint"] if rng.random() > 0.03 else ["finish"])
            actions.append((episode, pos, name, rng.choice(["v0", "v1", "v2", "v3", "v9", None]), rng.choice([None, *range(18)])))
    got = check(spark, actions, evidence, 40)
    assert {v[0] for v in got.values()} == {"accepted", "finished", "episode_finished", "unknown_action", "insufficient_budget", "unreleased_image"}


def test_a_chain_of_dependent_actions_in_one_long_episode(spark):
    # Whether a look is charged decides whether the next request is affordable, again and again.
    evidence = [(1, "v", i, True, False) for i in range(40)]
    actions = []
    for i in range(3000):
        actions.append((1, i, "request_photo" if i % 5 == 0 else "crop", "v", (i // 5 + i % 3) % 45))
    check(spark, actions, evidence, 90)


def test_folded_and_composed_episodes_give_the_same(spark):
    rng = random.Random(4)
    # Episodes above and below the bound by their actions or by their images, one without an id, one without images.
    evidence = [(e, f"v{i % 3}", i, rng.random() < 0.8, rng.random() < 0.2) for e in range(6) for i in range(9 if e else 30)]
    actions = []
    for episode in [*range(7), None]:
        for pos in range(rng.randrange(30, 40) if episode in (2, 3) else rng.randrange(5, 25)):
            name = rng.choice(["request_photo", "crop", "ocr", "compare", "paint", None] if rng.random() > 0.04 else ["finish"])
            actions.append((episode, pos, name, rng.choice(["v0", "v1", "v2", "v9", None]), rng.choice([None, *range(10)])))
    acts = spark.createDataFrame(actions, "episode int, pos int, name string, view string, image int").repartition(3)
    images = spark.createDataFrame(evidence, "episode int, view string, image int, available boolean, released boolean")
    runs = [traces.replay_releases(acts, images, 20, short=short) for short in (1000, 25, 0)]
    assert len({str(r.dtypes) for r in runs}) == 1
    rows = [sorted((tuple(r) for r in run.collect()), key=str) for run in runs]
    assert len(rows[0]) == len(actions) and rows[0] == rows[1] == rows[2]
    want = brute(actions, evidence, 20)
    assert {(r.episode, r.pos): (r.outcome, r.given, r.is_new, r.n_released) for r in runs[1].collect()} == {k: v[:4] for k, v in want.items()}
