"""Source audit against plain loops over all terms, with collisions, ties and awkward rows."""

import random
import re
from collections import Counter

import numpy as np

from tallyframe.llm.divergence import audit_sources

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, part string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, least=3, shown=200):
    docs = [(lang or "", source or "", Counter(terms(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t in seen if seen[t] >= least)
        v = len(kept)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            counts[s].update({t: c[t] for t in c if seen[t] >= least})
        every = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            gaps = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in counts if o != s}
            ranked = sorted(gaps, key=lambda o: (-gaps[o], o.encode()))
            out += [(lang, s, "pair", o, gaps[o], i + 1) for i, o in enumerate(ranked)]
            more = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if counts[s][t] > 0 and p[s][t] > q[t]}
            ranked = sorted(more, key=lambda t: (-more[t], t.encode()))[:shown]
            out += [(lang, s, "term", t, more[t], i + 1) for i, t in enumerate(ranked)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(None, "en", "s1"), ("", None, None), ("123 !!", "en", "no terms"), (None, "xx", "a"), (None, "xx", "b"), ("only here", "solo", "z"), ("Éa\u00a0b ß🙂x K\u212a", "fr", None)]
    for lang, words in (("en", 60), ("fr", 25), (None, 12)):
        for i in range(70):
            source = rng.choice(["s1", "s2", "s3", "", None, "ü"])
            text = [f"{rng.choice(['w', 'É', 'Word', 'ü'])}{'abcdefghij'[rng.randrange(min(10, words))]}{'klmnopqrst'[rng.randrange(3)]}" for _ in range(rng.choice([0, 1, 5, 40, 200]))]
            rows.append((rng.choice([" ", ", ", "\n", "1"]).join(text), lang, source))
    return rows + [("same same text " * 30_000, "en", "s2")] + [("copied words of one document", "en", "hot")] * 80


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "t", 3, "p") for i, r in enumerate(rows)], SCHEMA).repartition(3)


def test_against_plain_loops(spark):
    rows = rows_of(1)
    got = audit_sources(docs(spark, rows))
    assert result(got) == brute(rows)
    assert result(audit_sources(docs(spark, rows), least=1, shown=3)) == brute(rows, 1, 3)


def test_digests_of_several_terms_are_split(spark):
    rows = rows_of(2)
    assert result(audit_sources(docs(spark, rows), digest=lambda hashes: hashes % np.uint64(5))) == brute(rows)


def test_no_documents_and_no_terms(spark):
    assert audit_sources(docs(spark, rows_of(3)).limit(0)).count() == 0
    rows = [("1", "en", "a"), (None, "en", "b"), ("twice twice", "en", "c")]
    assert result(audit_sources(docs(spark, rows))) == brute(rows)
