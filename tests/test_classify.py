import random

import reference_model as RM
from pyspark.sql import functions as F

from rampart.operators import classify as C

# One URL per class plus the edge cases of the fixtures.
URLS = [
    "/a?id=1' OR 1=1", "/a?q=<script>x</script>", "/etc/passwd", "/x?u=http://e/", "/x?c=ls|cat",
    "/../../x", "/clean/path", "/a?id=%27%20union%20select", "%27", "%2527", "/a+b", "100%", "%zz",
    "/a?s=ſelect", "/a;b&c", None, "/p?x=%3Cimg%20src%3D1%3E", "/%2e%2e%2fetc", "",
]
STATUSES = ["200", "404", None]


def test_fixture_urls(spark):
    rows = [(u, s) for u in URLS for s in STATUSES]
    df = spark.createDataFrame(rows, "URL STRING, Status STRING")
    got = C.classify(df).collect()
    for (u, s), r in zip(rows, got):
        _, types, crit = RM.classify(u, s)
        assert r["attack_types"] == types, (u, r["attack_types"], types)
        assert r["critical_alert"] == crit, (u, s)


def test_random_urls_match_python(spark):
    rnd = random.Random(11)
    pieces = ["a", "/", "..", "%27", "%2e", "%2f", "'", "--", ";", "select", "UNION", "<", ">", "script",
              "%3C", "http://", "&", "|", "`", "\\", "+", "%", "%zz", "etc/passwd", "proc/self", "img", "%5C"]
    urls = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(4000)]
    df = spark.createDataFrame([(u, "200") for u in urls], "URL STRING, Status STRING")
    got = C.decoded_urls(C.classify(df)).collect()
    for u, r in zip(urls, got):
        decoded, types, crit = RM.classify(u, "200")
        assert r["decoded"] == decoded, u
        assert r["attack_types"] == types, (u, r["attack_types"], types)
        assert r["critical_alert"] == crit


def test_attack_map_has_all_classes(spark):
    df = spark.createDataFrame([("/etc/passwd", "200")], "URL STRING, Status STRING")
    m = C.classify(df, with_map=True).collect()[0]["attacks"]
    assert sorted(m.keys()) == sorted(n for n, _ in RM.ATTACKS)
    assert m["LFI"] and not m["XSS"]


def test_percent_decode_equals_unquote_on_hostile_bytes(spark):
    from urllib.parse import unquote

    from rampart.functions.urls import percent_decode
    rnd = random.Random(8)
    edges = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF,
             0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]

    def text():
        parts = [rnd.choice(["%{:02X}", "%{:02x}"]).format(rnd.choice(edges)) for _ in range(rnd.randint(1, 12))]
        for extra in ("%", "+", "é", "%8", "%g1", "".join(f"%{b:02X}" for b in "漢😀".encode())):
            if rnd.random() < 0.2:
                parts.insert(rnd.randint(0, len(parts)), extra)
        return "".join(parts)

    urls = [text() for _ in range(8000)] + ["%ED%A0%80", "%C3" * 20_000, "%E6%BC%A2" * 20_000, "a" * 100_000 + "%ff", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    for r in df.select("i", percent_decode("u").alias("d")).collect():
        assert r["d"] == unquote(urls[r["i"]]), urls[r["i"]][:80]
    assert df.limit(1).select(percent_decode(F.lit(None).cast("string"))).first()[0] is None
