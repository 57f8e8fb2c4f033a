"""The near-copies stage against the exact similarity of all pairs."""

import random
from collections import Counter

import pytest

from lumaspark.llm import shingles, simhash

WIDTH = 5


def words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def copy_of(rng, text, similarity, n):
    """A text of as many words, whose shingles have about the given similarity, never less."""
    shared = -(-2 * n * similarity // (1 + similarity))
    return text[: int(shared) + WIDTH - 1] + words(rng, n - int(shared))


def similarity(a, b):
    x, y = (Counter(tuple(t[i:i + WIDTH]) for i in range(len(t) - WIDTH + 1)) for t in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def kept(spark, texts, **options):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.drop_near_duplicates(df, **options).select("doc_id").collect()}


def test_pairs_by_band_of_similarity(spark):
    """At 0.8 and above a pair is found, whatever the band; below none is."""
    rng, texts, want = random.Random(3), {}, {}
    for band in (0.6, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.88, 0.95):
        for _ in range(100):
            n = rng.randrange(150, 400)
            a = words(rng, n + WIDTH - 1)
            b = copy_of(rng, a, band, n)
            i = len(texts)
            texts[i], texts[i + 1] = a, b
            s = similarity(a, b)
            assert band <= s < band + 0.015
            want[i + 1] = s < 0.8
    left = kept(spark, texts)
    assert left == {i for i in texts if want.get(i, True)}


@pytest.mark.parametrize("block", [shingles.BLOCK, 8])
def test_groups_against_all_pairs(spark, monkeypatch, block):
    """Copies of one text with edits, a passage shared by different texts, repeats and case: the components of all links of 0.8."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(4)
    base, passage = words(rng, 150), words(rng, 90)
    texts = {}
    for i in range(120):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        texts[i] = t
    for i in range(200, 260):
        texts[i] = words(rng, 20) + passage + words(rng, 20)
    texts[300], texts[301], texts[302] = ["k"] * 60, ["k"] * 70, ["k"] * 90
    parent = {i: i for i in texts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in texts:
        for j in texts:
            if i < j and similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert kept(spark, texts) == {find(i) for i in texts} >= {*range(200, 260), 300}


def differing(a, b):
    prints = (shingles.wide_fingerprint(shingles.shingle_hashes(" ".join(t).encode(), WIDTH)) for t in (a, b))
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*prints, strict=True))


def test_the_index_of_fingerprints_finds_what_it_can_reach(spark):
    """Without bands: every pair of 11 or fewer differing bits, most others of 0.9, none below 0.8, and groups of copies of copies."""
    rng, texts, near, found = random.Random(5), {}, set(), {}
    for band in (0.7, 0.78, 0.9, 0.95):
        for _ in range(60):
            n = rng.randrange(150, 400)
            a = words(rng, n + WIDTH - 1)
            i = len(texts)
            texts[i], texts[i + 1] = a, copy_of(rng, a, band, n)
            found[i + 1] = band
            if band > 0.8 and differing(texts[i], texts[i + 1]) <= 11:
                near.add(i + 1)
    chain = [words(rng, 300)]
    for i in range(40):
        chain.append(chain[-1][:7 * i] + words(rng, 1) + chain[-1][7 * i + 1:])
    texts |= {1_000 + i: t for i, t in enumerate(chain)}
    left = kept(spark, texts, bands=0)
    assert len(near) > 60 and not near & left and 1_000 in left and not left & {*range(1_001, 1_041)}
    assert all(i in left for i in texts if i < 1_000 and found.get(i, 0) < 0.8)
    assert sum(i not in left for i, band in found.items() if band >= 0.9) > 0.9 * 120


def test_a_group_that_is_close_but_not_alike_is_not_listed_pair_by_pair(spark, monkeypatch):
    """Texts of one base, each with two edits of its own: fingerprints close, similarities mostly below 0.8. Four times the group
    makes no table sixteen times as long, and the components are those of all pairs."""
    made, write = [], simhash.Steps.write

    def counted(self, df, name="step", partition_by=()):
        out = write(self, df, name, partition_by)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash.Steps, "write", counted)
    rng, most = random.Random(6), {}
    base = words(rng, 120)
    for n in (150, 600):
        texts = {}
        for i in range(n):
            texts[i] = list(base)
            for at in rng.sample(range(10, 110), 2):
                texts[i][at] = f"x{rng.random()}"
        made.clear()
        left = kept(spark, texts)
        most[n] = max(made)
        sets = {i: {tuple(t[k:k + WIDTH]) for k in range(len(t) - WIDTH + 1)} for i, t in texts.items()}
        parent = {i: i for i in texts}

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for i in texts:
            for j in range(i):
                shared = len(sets[i] & sets[j])
                if 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        assert left == {find(i) for i in texts}
    assert most[600] <= 10 * most[150], most
