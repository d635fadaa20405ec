"""op7: components against brute force, with cells small enough to split and block."""
import random
import re

import pytest

from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import jaccard as J
from rampart.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
                    links[i] += 1
                    links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000 if seed % 2 else 60)]

    def edit(w):
        w = list(w)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            i = rnd.randrange(len(w))
            r = rnd.random()
            if r < .5:
                w[i] = rnd.choice(vocab)
            elif r < .7:
                del w[i:i + rnd.randint(1, 6)]
            else:
                w[i:i] = [rnd.choice(vocab) for _ in range(rnd.randint(1, 4))]
            w = w or ["x"]
        return w

    base = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 20, 60]))] for _ in range(15)]
    rows = [(i * 3, " ".join(edit(rnd.choice(base)))) for i in range(90)]
    hot = now = [rnd.choice(vocab) for _ in range(100)]
    for i in range(80):                      # one group of copies of copies
        now = edit(rnd.choice([hot, now]))
        rows.append((1000 + i, " ".join(now)))
    passage = [rnd.choice(vocab) for _ in range(30)]
    rows += [(2000 + i, " ".join(passage + [rnd.choice(vocab) for _ in range(rnd.choice([1, 5, 40]))])) for i in range(20)]
    return rows + [(3000, None), (3001, ""), (3002, " \n"), (3003, "A b C"), (3004, "a B c"), (3005, "a b")]


@pytest.mark.parametrize("seed,words,num,cell", [(0, 4, 85, 4096), (1, 5, 80, 6), (2, 4, 85, 5)])
def test_equals_brute_force(spark, seed, words, num, cell):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, J.join(df, words, num, 100, cell, count=True).collect()))
    assert got == brute(rows, words, num, 100)


def test_link_counts_over_blocks_of_items(spark, monkeypatch):
    """Blocks cut by shingles and by rows, repeated rows, and no count unless asked for."""
    monkeypatch.setattr(J, "ITEMS", 300)
    rows = corpus(3)
    rows += rows[90:100] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows, 4, 85, 100)
    assert sorted(map(tuple, J.join(df, 4, 85, 100, 20, count=True).collect())) == want
    assert J.join(df, 4, 85, 100).columns == ["doc_id", "n_shingles", "component_id"]


def test_messy_rows(spark, docs, rows):
    got = sorted(map(tuple, J.join(docs, count=True).collect()))
    assert got == brute([(r[0], r[1]) for r in rows if r[0] is not None], 4, 85, 100)


def test_empty_table(no_docs):
    assert J.join(no_docs, count=True).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
