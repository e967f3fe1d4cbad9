"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.graphs import connected_components
from tallyframe.llm.ann import nearest_neighbours
from tallyframe.llm.chat import format_conversations, read_back
from tallyframe.llm.decontam import find_leaks
from tallyframe.llm.langid import fit_language_model, identify_language, suffix_automaton
from tallyframe.llm.line_dedup import dedup_lines, with_kept_lines
from tallyframe.llm.minhash import band_keys, estimate, least_estimate, near_duplicates, registers
from tallyframe.llm.packing import CAPACITY, bin_patterns, pack_documents, packed_sequences
from tallyframe.llm.quality import fit_quality, fit_tables, score_quality
from tallyframe.llm.secret_scan import BASE_KINDS, find_secrets
from tallyframe.llm.substring_dedup import UNIT, dedup_substrings
from tallyframe.llm.tokens import WordEncoder

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, key string, rank int, pos string"


def table(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "k", 1, "p") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eta", "iota", "kappa", "Mu", "nu", "xi", "pi", "rho"]) + str(rng.randrange(9)) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, nulls, empty and blank texts, short and long ones, repeated lines, one id twice."""
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (3, 5, 8, 12, 20, 45, 80, 150, 400, 900)]
    texts = [(10, None), (11, ""), (12, " \t\n "), (13, "One two"), (14, "one TWO"), (15, "x" * 700), (16, "ab" * 300)]
    at = 20
    for text in base:
        for copy in range(5):
            words = text.split(" ")
            for _ in range(copy * len(words) // 60):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            texts.append((at, ("  " if copy % 2 else " ").join(words)))
            at += 1
    lines = [sentence(rng, rng.choice([1, 1, 2, 6, 12])) for _ in range(25)] + ["", "a", "b"]
    for _ in range(40):
        texts.append((at, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))))
        at += 1
    texts += [(at, "\r\n".join(lines[:4]) + "\né ünï ß 日本 " + "🙂" * 40), (at + 1, "🙂" * 40 + lines[5] * 3)]
    return texts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    texts = corpus()
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    assert set(found) == set(sets)
    for i, s in sets.items():
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(s), find(i), find(i) == i)
    assert len({find(i) for i in sets}) < len(sets)


def test_near_duplicates_of_a_large_band(spark):
    """Many copies that differ from each other, some further than the threshold: every link has to be found."""
    rng = random.Random(4)
    base = sentence(rng, 120).split(" ")
    texts = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in texts]
    near = [(a, b) for a in range(400) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = list(range(400))
    for _ in range(20):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(400)] == want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = sentence(random.Random(2), 30)
    found = near_duplicates(table(spark, [(None, text), (None, text), (7, text), (7, text), (9, text), (9, "other")])).collect()
    assert len(found) == 6
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id) == [(7, 7, True), (7, 7, True), (9, 7, False), (9, 9, True)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_small_sets_always_share_a_key(percent):
    """Texts of random words and their copies with words added at an end; the shingles may all fall into a few bands."""
    def sign(sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        marks = registers(flat, sizes)
        return marks, sizes, band_keys(marks, flat, sizes, percent)

    rng = np.random.default_rng(22)
    for size in (*range(4, 20), 31, 33, 51, 63):
        for _ in range(150):
            extra = max(1, size * (100 - percent) // percent)
            whole = np.unique(rng.integers(0, 1 << 63, size + extra, dtype=np.uint64) * np.uint64(2))
            if 100 * size < percent * len(whole):
                continue
            part = np.sort(rng.permutation(whole)[:size])
            marks, sizes, (a, b) = sign([part, whole])
            assert set(a.tolist()) & set(b.tolist())
            near = estimate(marks[:1], marks[1:], sizes[:1].astype(float), sizes[1:].astype(float), percent)
            assert near[0] >= least_estimate(percent)
    # All seven shingles of 10 and 11 words in one half of the registers: one band differs and the other is empty.
    low = np.arange(1, 8, dtype=np.uint64) << np.uint64(57)
    _, _, (a, b) = sign([low[:6], low])
    assert set(a.tolist()) & set(b.tolist())


def test_near_duplicates_at_eighty_percent(spark, tmp_path):
    """The pipeline's stage removes a copy at a similarity of 0.82, which op1 keeps."""
    import corpus_pipeline as cp

    rng = random.Random(21)
    base = sentence(rng, 304).split(" ")
    changed = [*base]
    for at in range(20, 260, 40):
        changed[at] = "changed"
    texts = [(1, " ".join(base)), (2, " ".join(changed)), (3, sentence(rng, 90))]
    a, b = shingles(texts[0][1]), shingles(texts[1][1])
    assert round(len(a & b) / len(a | b), 2) == 0.82
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup_stage(spark, frame, str(tmp_path)).collect()} == {1, 3}
    assert near_duplicates(table(spark, texts), percent=85).where("kept").count() == 3


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (8, 7), (2, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)], "a long, b long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {5: 1, 4: 1, 3: 1, 1: 1, 9: 7, 8: 7, 7: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert connected_components(edges.limit(0)).count() == 0


def brute_lines(texts, least=20):
    order = sorted(texts, key=lambda x: x[0])
    out = {}
    before = []
    for i, t in order:
        lines = (t or "").split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = lines[a : b + 1]
                n = len(run)
                earlier = any(o[s : s + n] == run for o in before for s in range(len(o) - n + 1)) or any(lines[s : s + n] == run for s in range(a))
                if not earlier:
                    break
                if any(len(x) >= least for x in run):
                    gone.update(range(a, b + 1))
        before.append(lines)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone), sum(p - 1 not in gone for p in gone))
    return out


def test_line_dedup(spark):
    texts = [x for x in corpus(3) if x[0] is not None]
    want = brute_lines(texts)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed, r.n_runs) for r in dedup_lines(table(spark, texts)).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 30


def test_line_dedup_of_short_lines(spark):
    """With short_runs the threshold is the run's: menus of short lines that repeat with other neighbours go."""
    menu = "tea\ncoffee\n\ncake\njuice\nwater"
    texts = [x for x in corpus(3) if x[0] is not None and len((x[1] or "").split("\n")) < 30]
    texts += [(1000, "one\n" + menu + "\ntwo"), (1001, "three\n" + menu + "\nfour"), (1002, "\n".join(["Was eran."] * 9)), (1003, "a\n\n\nb"), (1004, "c\n\n\nb")]
    want, before = {}, []
    for i, t in texts:
        lines, gone = (t or "").split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = lines[a:b]
                if not any(o[s : s + b - a] == run for o in [*before, lines[: b - 1]] for s in range(a if o == lines[: b - 1] else len(o))):
                    break
                if sum(map(len, run)) >= 20:
                    gone.update(range(a, b))
        before.append(lines)
        want[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in with_kept_lines(table(spark, texts), short_runs=True).collect()}
    assert got == want
    assert got[1001] == ("three\nfour", 6) and got[1002][1] == 8 and got[1004][1] == 0


def test_line_dedup_edge_rows(spark):
    long = "a line of more than twenty characters"
    got = dedup_lines(table(spark, [(None, long), (3, long), (3, long), (3, long + "\nx"), (4, None)])).collect()
    assert sorted((r.doc_id or 0, r.kept_text, r.n_removed) for r in got) == [(0, long, 0), (3, "", 1), (3, "", 1), (3, "x", 1), (4, "", 0)]
    assert dedup_lines(table(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate((1, 3, 5, 6, 9, 15, 30, 61, 130))] + [(90, None), (91, " "), (4, sentence(rng, 12))]
    docs = [(1, None), (2, ""), (3, items[1][1].upper())]
    for at, (_, text) in enumerate(items[:9]):
        words = text.split()
        for drop in range(5):
            own = list(words)
            for _ in range(drop):
                own[rng.randrange(len(own))] = "qq"
            docs.append((100 + 10 * at + drop, sentence(rng, 200) + "\n" + "  ".join(own) + " " + sentence(rng, 300)))
    want = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 5 * len(s & have) >= 4 * len(s):
                want.add((d, i, len(s & have), len(s)))
    source = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in find_leaks(table(spark, docs), source).collect()}
    assert got == want and len(want) >= 15
    assert find_leaks(table(spark, []), source).count() == 0
    assert find_leaks(table(spark, docs), source.limit(0)).count() == 0


KIND_PATTERNS = {
    "assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
}


def test_secrets(spark):
    texts = corpus(6) + [
        (900, "🙂 password: token: abcdefg"), (901, "token=ab secret='abcdef' API_KEY==x12345 apikey: " + "0123456789abcdef" * 2),
        (902, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA" + "C" * 20), (903, "user=bob2 host https://db.example.com " + "x " * 300 + "pwd=hunter22 user: eve9"),
        (904, "user=alone https://nobody.example"), (905, "pwd=lonely1"), (906, "AKIA" + "Z" * 16 + " key=abcd1234 \n https://h.example"), (907, "api_key=abcdef12 key=zz99zz"),
    ]
    found = {r.doc_id: [(s.start, s.kind, s.name, s.end) for s in r.spans] for r in find_secrets(table(spark, texts)).collect()}
    for i, text in texts:
        want = []
        for number, (kind, pattern) in enumerate(KIND_PATTERNS.items()):
            for m in re.finditer(pattern, text or ""):
                if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                    want.append((m.start(), number, kind, m.end()))
        assert [s for s in found[i] if s[1] < BASE_KINDS] == sorted(want), i
    extra = {i: [s[2] for s in found[i] if s[1] >= BASE_KINDS] for i in range(900, 908)}
    assert extra[903] == ["weak_secret", "identifier"] and extra[904] == [] and extra[905] == []
    assert extra[906] == ["weak_secret", "endpoint"] and extra[907] == []


def brute_bytes(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("unit", [UNIT, 2])
def test_substrings(spark, monkeypatch, unit):
    monkeypatch.setattr("tallyframe.llm.substring_dedup.UNIT", unit)
    texts = corpus(7)
    want = brute_bytes(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(table(spark, texts)).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 10_000


def test_substrings_in_a_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr("tallyframe.llm.anchors.BLOCK", 5000)
    rng = random.Random(8)
    part = sentence(rng, 600)
    texts = [(1, sentence(rng, 3000) + part + sentence(rng, 900)), (2, sentence(rng, 1500) + part), (3, part[7:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(table(spark, texts)).collect()}
    assert got == brute_bytes(texts)
    assert dedup_substrings(table(spark, [])).count() == 0
    both = dedup_substrings(table(spark, [(None, part), (5, part), (5, part)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in both) == [(0, False), (5, True), (5, True)]


def test_encoder_equals_the_tokenizer():
    for path in (WORD_BPE, BYTE_BPE):
        known = WordEncoder(path)
        texts = [t or "" for _, t in corpus(9)] + ["Tom's ΑΣ İ ﬁ x.,y ... a.b,c 1.2 we'll \x1c q\x85r <|endoftext|> É.È,e", "a..b\n\nC.\tD "]
        for text, ids in zip(texts, known.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    texts = corpus(10) + [(800 + i, sentence(random.Random(i), 900 + 37 * i)) for i in range(40)] + [(None, "null id"), (801, "same id")]
    packed = pack_documents(table(spark, texts), WORD_BPE, with_ids=True)
    rows = packed.collect()
    known = WordEncoder(WORD_BPE).tokenizer
    want = {}
    for i, t in texts:
        ids = known.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append([(p, p * CAPACITY, ids[p * CAPACITY : (p + 1) * CAPACITY]) for p in range(-(-len(ids) // CAPACITY))])
    pieces = sorted(((i or 0), p) for i, many in want.items() for one in many for p in one)
    assert sorted(((r.doc_id or 0), (r.piece, r.start, r.ids)) for r in rows) == pieces
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    gaps = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append(min(fit, default=CAPACITY) - n)
    assert len(by) <= len(gaps)
    whole = packed_sequences(packed).collect()
    assert sorted(len(r.ids) for r in whole) == sorted(sum(r.length for r in s) for s in by.values())
    assert pack_documents(table(spark, []), WORD_BPE).count() == 0


def test_bin_patterns_reach_the_optimum_of_small_cases():
    rng = random.Random(11)
    for _ in range(60):
        histogram = {}
        for _ in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 21)
            histogram[n] = histogram.get(n, 0) + 1
        items = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True)

        def fits(bins, left):
            if not left:
                return True
            return any(fits(bins[:k] + [b - left[0]] + bins[k + 1 :], left[1:]) for k, b in enumerate(bins) if b >= left[0] and b not in bins[:k])

        best = next(k for k in range(1, 20) if fits([20] * k, items))
        patterns = bin_patterns(histogram, 20)
        assert all(sum(p) <= 20 for _, p in patterns)
        assert sorted((n for t, p in patterns for n in p * t), reverse=True) == items
        assert sum(t for t, _ in patterns) <= best + 1


def test_suffix_automaton_accepts_exactly_the_substrings():
    rng = random.Random(12)
    for _ in range(20):
        code = np.array([rng.randrange(3) for _ in range(30)])
        moves = suffix_automaton(code, 3)
        have = {tuple(code[a:b]) for a in range(30) for b in range(a, 31)}
        for _ in range(200):
            word, state = [rng.randrange(3) for _ in range(rng.randrange(1, 8))], 0
            for c in word:
                state = moves[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(word) in have)


def phrases(text, sample):
    """Longest matches from left to right, by plain search."""
    clean = re.sub(r"[\W\d_]+", " ", text.lower())
    count, at = 1, 0
    for to in range(1, len(clean) + 1):
        if clean[at:to] not in sample:
            count, at = count + 1, to - 1
            if clean[at:to] not in sample:
                at = to
    return count


def test_language(spark):
    rng = random.Random(13)
    bags = {"aa": "the of and with that from they were".split(), "bb": "der und nicht mit ist auf für daß".split(), "cc": "les est pour dans été où ça".split()}
    rows = [(i, " ".join(rng.choice(bags[k]) for _ in range(rng.randrange(5, 60))), k) for i, k in enumerate(rng.choice(list(bags)) for _ in range(120))]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "123 ?!", "bb"), (503, "the 12 of", None), (None, "der und", "bb"), (504, "日本語", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = fit_language_model(docs.where("doc_id < 80"))
    got = identify_language(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == k and 0.5 < by[i].score <= 1 for i, _, k in rows[80:120])
    assert [by[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"] and by[None].lang_pred == "bb"
    assert by[500].score == 0 and 0.5 <= by[504].score < 0.52
    none = fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in identify_language(docs, none).collect()} == {"und"}
    assert identify_language(docs.limit(0), model).count() == 0


def test_cross_parsing_counts_longest_matches(spark):
    from tallyframe.llm.langid import letter_codes, phrase_counts

    sample = "the cat and the hat sat with that rat on the mat"
    docs = spark.createDataFrame([(1, sample, "x")], "doc_id long, text string, lang string")
    model = fit_language_model(docs)
    texts = ["the hat", "cathat 12 the rat!", "zzz the", "on that mat sat", "é", ""]
    codes, bounds = letter_codes(texts, model.codes)
    got = phrase_counts(codes, bounds, model)[0].tolist()
    assert got[:2] == [phrases(t, "\n" + sample) for t in texts[:2]] and got[3] == phrases(texts[3], sample) and got[5] == 0


def test_quality(spark):
    rng = random.Random(14)
    good = [(i, sentence(rng, rng.randrange(5, 200))) for i in range(150)]
    bad = [(200 + i, "!!! " * rng.randrange(3, 60) if i % 2 else "buy " * rng.randrange(5, 90)) for i in range(80)]
    docs = table(spark, good + bad + [(400, None), (401, ""), (None, "no id")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:50]] + [(401, None), (None, 1)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert len(got) == 233 and all(0 <= s <= 1 for s in got.values())
    assert sum(got[i] >= 0.5 for i, _ in good[100:]) >= 48 and sum(got[i] < 0.5 for i, _ in bad[50:]) >= 28
    flat = fit_quality(docs, labels.limit(0))
    assert {r.score for r in score_quality(docs, flat).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).count() == 0


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = fit_tables(x[:2000], y[:2000])
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.9


def test_chat_round_trip(spark):
    rng = random.Random(16)
    pieces = ["a", "\\", "<", "[", "</s>", "[INST] ", " [/INST]", "\n", "\\n", "\\<", "é", "🙂", ""]
    rows = []
    for conv in range(60):
        shared = rng.choice([0, 0, 1, 2, 3])
        for turn in range(rng.randrange(1, 9)):
            seed = random.Random(f"{turn}") if turn < shared else rng
            role = ["user", "assistant", "sys\ntem", "\\n\\", "", None][seed.choice([0, 1, 1, 2, 3, 4, 5])]
            rows.append((conv, turn, role, None if seed.random() < 0.1 else "".join(seed.choice(pieces) for _ in range(seed.randrange(6))), "x"))
    rows += [(200, 0, "user", "same", "x"), (200, 0, "user", "same", "x"), (None, 0, "user", "nobody", "x")]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(3)
    nodes, turns = format_conversations(table_, BYTE_BPE)
    nodes = nodes.cache()
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in read_back(nodes, turns).collect()}
    assert got == want
    # Depth-first layout, positions and attention intervals against the tree itself.
    listed = {r.path: r for r in nodes.collect()}
    assert len(listed) == len({(tuple(c[: d + 1])) for c in want.values() for d in range(len(c))})
    chains = {}
    for r in turns.collect():
        chains.setdefault(r.conv, {})[r.depth] = listed[r.path]
    for chain in chains.values():
        position, above = 0, set()
        for depth in sorted(chain):
            node = chain[depth]
            assert node.position == position and node.size == len(node.ids)
            assert {t for i in node.ancestors for t in range(i.low, i.high)} == above
            position += node.size
            above |= set(range(node.start, node.start + node.size))
    trees = {}
    for r in listed.values():
        trees.setdefault(r.tree, []).append((r.start, r.size))
    for some in trees.values():
        at = 0
        for start, size in sorted(some):
            assert start == at
            at += size
    empty, none = format_conversations(table_.limit(0), BYTE_BPE)
    assert read_back(empty, none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[40:70] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5100, [float("nan")] * 16), (5200, [None] * 16), (5300, [1.0, float("inf")] * 8), (5400, [1.0, 2.0]), (5401, [1.0, 3.0]), (None, [1.0] * 16), (7, rows[7][1])]
    base = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<float>, size string").repartition(3)
    got = {}
    for r in nearest_neighbours(base, base.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {*range(0, 1500, 100), 5400} and got[5400] == [(1, 5401, 1.0)]
    hits = 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        best = sorted(range(1500), key=lambda i: (far[i], i))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(far[m[1]] - m[2]) < 1e-9 for m in mine)
        assert [m[1] for m in mine] == sorted((m[1] for m in mine), key=lambda i: (far[i], i))
        hits += len({m[1] for m in mine} & set(best))
    assert hits >= 0.9 * 150
    exact = [r.vec_id for r in nearest_neighbours(base, base.where("vec_id = 3")).orderBy("rank").collect()]
    assert exact == list(range(40, 50))
    assert nearest_neighbours(base.limit(0), base).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(18)
    item = sentence(rng, 20)
    near = sentence(rng, 100).split(" ")
    line = sentence(rng, 60)
    docs = [
        (1, sentence(rng, 50)), (2, " ".join(near)), (3, " ".join([*near[:50], "changed", *near[51:]])), (4, "123 456 !!"), (5, "intro here\n" + item + "\noutro"),
        (6, line), (7, line), (8, "own words of eight stay here\n" + line), (9, sentence(rng, 6000)),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [{1, 2, 3, 5, 6, 7, 8, 9}, {1, 2, 3, 5, 6, 8, 9}, {1, 2, 5, 6, 8, 9}, {1, 2, 6, 8, 9}]
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), ids in zip(cp.STAGES, left):
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        assert step.columns == cp.COLUMNS and {r.doc_id for r in step.collect()} == ids
    assert step.where("doc_id = 8").first()["text"] == "own words of eight stay here"
    packed = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {CAPACITY}").count() == 0
