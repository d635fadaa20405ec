"""op9 against a plain version that tries every window of every template; long files in time."""
import random
import re
import textwrap
import time

import pytest

from rampart.llm import licenses as C

TEMPLATES = {n: C.TEMPLATES.get(n, []) + C.BODIES.get(n, []) for n in [*C.TEMPLATES, *C.BODIES]}


def words_of(line):
    return re.sub("[^a-z0-9]+", " ", line.lower()).split()


def brute(text, dice=C.DICE):
    """(n_notices, license, dice, line) by the rule in ``scan``'s docstring."""
    num, den = dice
    lines = [words_of(x) for x in (text or "").split("\n")]
    words = [w for x in lines for w in x]
    b = [f"{x} {y}" for x, y in zip(words, words[1:])]
    found, k = [], 0
    for name, texts in TEMPLATES.items():
        for t in texts:
            tw = words_of(t)
            own = {f"{x} {y}" for x, y in zip(tw, tw[1:])}
            # a window longer than this holds more bigrams than the coefficient allows, were none repeated
            most = max(len(own), len(tw) - 1) * (2 * den - num) // num
            for s in range(len(b)):
                if b[s] not in own:
                    continue
                best = None
                for e in range(s, min(s + most, len(b))):
                    if b[e] not in own:
                        continue
                    part = set(b[s:e + 1])
                    both = len(part & own)
                    c = 2 * both / (len(part) + len(own))
                    if 2 * den * both >= num * (len(part) + len(own)) and (best is None or c > -best[2]):
                        best = (s + 1, e + 1, -c, -both, name, k)
                if best:
                    found.append(best)
            k += 1
    n, best, now = 0, None, None
    for w in sorted(found):
        rank = lambda x: (x[2], x[0], x[4])
        if now is None or w[0] > now[1] + 1:
            n += 1
            if now is not None:
                best = min(best, rank(now)) if best else rank(now)
            now = w
        elif (w[2] < now[2]) if w[5] == now[5] else ((w[3], w[2], w[4]) < (now[3], now[2], now[4])):
            now = w
    if now is not None:
        best = min(best, rank(now)) if best else rank(now)
    if best is None:
        return 0, None, 0.0, None
    total = 0
    for i, x in enumerate(lines, 1):
        total += len(x)
        if total >= best[1]:
            return n, best[2], -best[0], i


def cases():
    rnd = random.Random(11)
    every = [t for ts in TEMPLATES.values() for t in ts]
    filler = "the files in this folder are used by the build and may be changed at any time by all of us".split()

    def damaged(t):
        w = t.split()
        for _ in range(rnd.randint(0, max(1, len(w) // 12))):
            i = rnd.randrange(len(w))
            w[i:i + 1] = rnd.choice([[], [w[i], rnd.choice(filler)], [rnd.choice(filler)]])
        return " ".join(w)

    def noise():
        return " ".join(rnd.choice(filler) for _ in range(rnd.randint(0, 12)))

    out = ["", None, "license", "All rights reserved", "all rights reserved. " * 4]
    for _ in range(90):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            t = damaged(rnd.choice(every))
            t = textwrap.fill(t, rnd.choice([20, 60, 500]), initial_indent=rnd.choice(["", "# ", " * "]))
            parts += [noise(), t] if rnd.random() < 0.8 else [t, t]
        out.append(rnd.choice(["\n", " ", "\n\n"]).join(parts))
    return out


def test_equals_trying_every_window(spark):
    texts = cases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = 0
    for r in C.scan(df).collect():
        n, name, dice, line = brute(texts[r["doc_id"]])
        assert (r["n_notices"], r["license"], r["line"]) == (n, name, line), texts[r["doc_id"]]
        assert r["dice"] == pytest.approx(dice)
        found += n
    assert found > 60


def test_places_before(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(1)
    rows = [[rnd.choice("abcde") for _ in range(rnd.randint(0, 30))] for _ in range(50)] + [["a"], []]
    df = spark.createDataFrame([(x,) for x in rows], "x array<string>")
    for r in df.select("x", C.places_before(F.col("x")).alias("p")).collect():
        want, last = [], {}
        for i, v in enumerate(r["x"], 1):
            want.append(last.get(v, 0))
            last[v] = i
        assert r["p"] == want


def test_bundled_licences_in_time(spark):
    text = "\n\n".join("x y z " + textwrap.fill(C.BODIES["BSD-3-Clause"][0], 70) for _ in range(300))     # 200 kB
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    t0 = time.perf_counter()
    (r,) = C.scan(df).collect()
    assert (r["n_notices"], r["license"], r["line"]) == (300, "BSD-3-Clause", 1) and time.perf_counter() - t0 < 90
