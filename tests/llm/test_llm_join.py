"""The set join against all pairs, with groups larger than those written as pairs."""

import itertools
import random

import fixture
import numpy as np
import pytest

from fieldtrial.llm import jaccard_join as J


def components(docs, width, percent):
    sets = {d: set(J.shingle_set(t, width).tolist()) for d, t in docs}
    least = {d: d for d in sets}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((find(a), find(b)))
            least[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components(spark, width, percent):
    rng = random.Random(width)
    base = fixture.sentence(rng, 140)
    texts = [base] * 10 + [fixture.changed(rng, base, rng.randrange(0, 14)) for _ in range(250)]
    texts += [base + " " + fixture.sentence(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += [fixture.sentence(rng, n) for n in range(0, 60)] + [None, "", "a", "a b", "A B"]
    chain = fixture.sentence(rng, 200)
    for _ in range(12):  # each similar to the one before, the ends are not
        texts.append(chain)
        chain = fixture.changed(rng, chain, 2)
    docs = list(enumerate(texts, 5))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(df, width, percent).collect()}
    assert got == components(docs, width, percent)


def test_many_near_copies_and_outsiders(spark):
    """Groups far beyond SMALL whose outsiders link with them only by a few members."""
    rng = random.Random(12)
    base = fixture.sentence(rng, 100)
    texts = [fixture.changed(rng, base, rng.randrange(1, 5)) for _ in range(260)]
    half = base.split(" ")
    outside = " ".join(half[:55]) + " " + fixture.sentence(rng, 45)
    texts += [fixture.changed(rng, outside, rng.randrange(0, 4)) for _ in range(60)]
    step = base
    for _ in range(40):  # walks away from the group, link by link
        step = fixture.changed(rng, step, 2)
        texts.append(step)
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(df, 3, percent).collect()}
        assert got == components(docs, 3, percent)


def test_members_of_large_groups_are_refined_once(spark):
    """Unlike texts that share passages meet in many large groups, but list their elements once."""
    rng = random.Random(7)
    passages = [fixture.sentence(rng, 30) for _ in range(8)]

    def text():
        parts = rng.sample(passages, 5) + [fixture.sentence(rng, 12)]
        rng.shuffle(parts)
        return " ".join(parts)

    texts = [text() for _ in range(240)]
    texts += [fixture.changed(rng, t, k % 9) for k, t in enumerate(texts[:60])]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    listed = []

    class Seen(J.Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if name == "prefixes":
                listed.extend(out.select("f").toPandas().f)
            return out

    found = J.similar_documents(df, 5, 80, Seen(spark))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == components(docs, 5, 80)
    assert len(listed) == len(set(listed)) > 0


def test_sets_that_leave_large_groups_still_meet():
    rng = random.Random(3)

    def stays(own, percent, order):
        kept = set()
        for twos, ones, room in J.signature_parts(own, percent):
            keys = sorted([(order(k), 2, k) for k in twos.tolist()] + [(order(k), 1, k) for k in ones.tolist()])
            for _, weight, k in keys:
                room -= weight
                if room < 0:
                    kept.add(k)
        return kept

    linked = left = 0
    for k in range(400):
        percent = (80, 90)[k % 2]
        base = fixture.sentence(rng, rng.randrange(5, 400))
        other = fixture.changed(rng, base, rng.randrange(0, 9)) + " " + fixture.sentence(rng, rng.randrange(1, 9))
        a, b = J.shingle_set(base, 3), J.shingle_set(other, 3)
        if J.similar(a, b, percent) and not np.array_equal(a, b):
            linked += 1
            both = set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())
            order = lambda key: (key not in both, key)  # noqa: E731  the groups they share are the largest
            x, y = stays(a, percent, order), stays(b, percent, order)
            left += len(x) < len(J.signatures(a, percent))
            assert x & y
    assert linked > 100 and left > 50


def test_awkward_rows(spark):
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (1, "x y z u v w", 9), (None, "a b c d e f", 9), (None, None, 9), (2, "A b  c d\te f", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar_documents(df, 3, 90).collect())
    assert got == [("1", 4, "1"), ("1", 4, "1"), ("1", 4, "1"), ("2", 4, "1"), ("None", 0, "None"), ("None", 4, "1")]
    kept = J.one_of_each(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "1", "None", "None"]


def test_sketch_never_rejects_a_link():
    rng = random.Random(1)
    for _ in range(300):
        base = fixture.sentence(rng, rng.randrange(5, 200))
        other = fixture.changed(rng, base, rng.randrange(0, 5)) + " " + fixture.sentence(rng, rng.randrange(1, 9))
        a, b = J.shingle_set(base, 3), J.shingle_set(other, 3)
        if J.similar(a, b, 80):
            assert J.may_link(len(a), J.sketch(a), len(b), J.sketch(b), 80)
            meet = set(J.signatures(a, 80).tolist()) & set(J.signatures(b, 80).tolist())
            assert meet or np.array_equal(a, b)


def test_allocation_covers_all_differences():
    for percent in (80, 90):
        for band in range(22):
            segments, twos, spare = J.allocation(band, percent)
            top = J.band_start(band + 1) - 1
            most = J.most_differences(top, top * 100 // percent, percent)
            assert (segments == 0 and most == 0) or segments + twos - spare >= most + 1


def test_block_pairs_equal_the_pairs_one_by_one():
    rng = random.Random(6)
    base = fixture.sentence(rng, 90)
    sets = [J.shingle_set(fixture.changed(rng, base, rng.randrange(0, 9)) + " w1" * rng.randrange(0, 60), 3) for _ in range(40)]
    rows = [{"f": k, "n": len(s), "sketch": J.sketch(s), "root": k // 2} for k, s in enumerate(sets)]
    got = set(J.block_pairs(rows[:25], rows[15:], 80))
    expected = {
        (min(a["f"], b["f"]), max(a["f"], b["f"]))
        for a in rows[:25] for b in rows[15:]
        if a["root"] != b["root"] and J.may_link(a["n"], a["sketch"], b["n"], b["sketch"], 80)
    }
    assert got == expected and got
