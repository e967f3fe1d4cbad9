"""Image sets of annotations against the full product of alternatives."""

import itertools
import random

from pyspark.sql import functions as F

from tallyframe.functions import evidence
from tallyframe.schemas import ANNOTATION


def annotation(verdict, parts):
    """``parts`` lists the alternatives of every part, each a list of image ids."""
    def region(image):
        return (image, [0, 0, 8, 8], "before", None, None, None, None)
    subs = [(f"p{i}", "condition", verdict, {verdict: [[region(i) for i in g] for g in alternatives]}) for i, alternatives in enumerate(parts)]
    return ("evidence-chain-v1", "reviewed", verdict, subs, None)


def whole(verdict, parts):
    sets = {frozenset().union(*p) for p in itertools.product(*parts)} if verdict == "Supported" else {frozenset(g) for p in parts for g in p}
    return sorted((sorted(s) for s in sets), key=lambda s: (len(s), s))


def lean(sets):
    return [s for s in sets if not any(set(o) < set(s) for o in sets)]


def run(spark, cases, function):
    df = spark.createDataFrame([(i, annotation(*c)) for i, c in enumerate(cases)], f"i int, a {ANNOTATION}")
    return [r.sets for r in df.select("i", function(F.col("a")).alias("sets")).orderBy("i").collect()]


def test_sets_equal_the_product_on_random_cases(spark):
    rng = random.Random(4)
    images = [f"img{i}" for i in range(9)]
    cases = [
        (rng.choice(["Supported", "Refuted"]), [[rng.sample(images, rng.randint(1, 3)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))])
        for _ in range(120)
    ]
    cases += [("Supported", [[["a"], []]]), ("Refuted", [[[]], [["a"]]]), ("Supported", []), ("Refuted", []), ("Need more evidence", [[["a"]]])]
    want = [whole(*c) if c[0] != "Need more evidence" else [] for c in cases]
    assert run(spark, cases, evidence.annotation_image_sets) == want
    assert run(spark, cases, evidence.minimal_image_sets) == [lean(w) for w in want]


def test_twenty_parts_with_three_alternatives_each(spark):
    # The product has 3^20 entries; the parts share eight images.
    rng = random.Random(6)
    images = [f"i{k}" for k in range(8)]
    parts = [[rng.sample(images, 2) for _ in range(3)] for _ in range(20)]
    good = [set(s) for n in range(9) for s in itertools.combinations(images, n) if all(any(set(g) <= set(s) for g in p) for p in parts)]
    want = sorted((sorted(s) for s in good if not any(o < s for o in good)), key=lambda s: (len(s), s))
    assert run(spark, [("Supported", parts)], evidence.minimal_image_sets) == [want]


def test_more_images_than_a_word_holds(spark):
    many = [f"x{k:03d}" for k in range(200)]
    parts = [[many[100:], many[:130]], [[many[150], many[61], many[62]], [many[199], many[150]]]]
    want = lean(whole("Supported", parts))
    assert run(spark, [("Supported", parts)], evidence.minimal_image_sets) == [want] and len(want) == 2
