import random

from pyspark.sql import functions as F

import reference_model as RM
from rampart.functions import text as X
from rampart.operators import parse as P

BASE = ('Oct 10 host: RemoteAddress=10.0.0.8 - TimeLocal=10/Oct/2024:13:55:36 +0200 GET /view?k=69 '
        'HTTP/1.1 200 655 "-" "Mozilla/5.0 (X11)" a b c d e tttt')

FIXTURE_LINES = [
    BASE,                                   # 17 tokens
    BASE + " extra",                        # 18 tokens
    BASE.rsplit(" ", 1)[0],                 # 16 tokens
    BASE + " x y",                          # 19 tokens
    BASE.replace("RemoteAddress=", "Remote="),
    BASE.replace("10/Oct", "99/Oct"),
    BASE.replace('"Mozilla/5.0 (X11)"', '"Moz \\"quoted\\" agent"'),
    BASE.replace('"Mozilla/5.0 (X11)"', '"no closing quote'),
    BASE.replace("tttt", "té中"),
    BASE.replace(" GET ", " GET "),
    BASE.replace(" GET ", " G\x01ET "),
    BASE.replace("10/Oct/2024:13", "1/OCT/2024:3"),
    "RemoteAddress=",
    "",
    BASE.replace('"-"', '"' + "a" * 200_000 + '"'),
]


def _spark_parse(spark, lines):
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(lines)], "id BIGINT, value STRING")
    return {r["id"]: r for r in P.parse_marker(df).collect()}


def _check(spark, lines):
    got = _spark_parse(spark, lines)
    for i, line in enumerate(lines):
        want = RM.parse_marker(line)
        row = got[i + 1]
        if isinstance(want, str):
            assert row["reason"] is not None, (line[:200], row["reason"])
            if want in ("no_marker", "too_many"):
                assert row["reason"] == want
        else:
            assert row["reason"] is None, (line[:200], row["reason"])
            for k, v in want.items():
                assert row[k] == v, (k, row[k], v)


def test_fixture_lines(spark):
    _check(spark, FIXTURE_LINES)


def test_random_lines_match_python(spark):
    rnd = random.Random(7)
    alphabet = ['a', 'b', '"', '\\', ' ', '\t', ' ', ' ', 'é', '\x1c', '\n', 'x', '/', '=']
    lines = []
    for _ in range(1500):
        parts = BASE.split(" ")
        for _ in range(rnd.randint(0, 3)):
            j = rnd.randrange(len(parts))
            parts[j] = parts[j] + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4)))
        if rnd.random() < 0.2:
            parts.insert(rnd.randrange(len(parts)), '"' + "".join(rnd.choice(alphabet) for _ in range(6)) + '"')
        if rnd.random() < 0.1:
            parts = parts[: rnd.randrange(len(parts))]
        lines.append(" ".join(parts))
    _check(spark, lines)


def test_tokenizer_matches_python_findall(spark):
    rnd = random.Random(3)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) == 29
    chars = ['"', '\\', 'a', 'z', '\u180e', '\u200b', '\ufeff'] + spaces
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: list(r["k"]) for r in df.select("i", X.tokens(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == RM.TOKEN_RE.findall(t), repr(t)


def test_good_plus_rejected_is_input(spark):
    lines = FIXTURE_LINES * 3
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "id BIGINT, value STRING")
    good, bad = P.split(P.parse_marker(df))
    assert good.count() + bad.count() == len(lines)


def test_clean_and_wrap(spark):
    texts = ['plain', 'quote " inside', 'é\x00\x7f\t\n ok', '""', '']
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rows = df.select(X.ascii_clean("t").alias("c"), X.export_clean("t").alias("w")).collect()
    for t, r in zip(texts, rows):
        assert r["c"] == RM.clean(t)
        assert r["w"] == RM.wrap(RM.clean(t))


COMBINED = '1.2.3.4 - bob [10/Oct/2024:13:55:36 +0200] "GET /a/b?x=1 HTTP/1.1" 200 2326 "http://r/" "Mozilla/5.0 (X11)"'


def test_combined_parse(spark):
    lines = [
        COMBINED,
        COMBINED.replace("GET", "BREW"),
        COMBINED.replace(" 200 ", " abc "),
        COMBINED.replace("/a/b", "/a\\x22b"),
        COMBINED.replace("+0200", "+0000").replace("13:55", "11:55"),
        "garbage line",
    ]
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(lines)], "id BIGINT, value STRING")
    rows = {r["id"]: r for r in P.parse_combined(df).collect()}
    r = rows[1]
    assert (r.remote_addr, r.remote_user, r.request_type, r.request_path, r.request_protocol) == \
        ("1.2.3.4", "bob", "GET", "/a/b?x=1", "HTTP/1.1")
    assert (r.status, r.size, r.referer, r.user_agent, r.reason) == (200, 2326, "http://r/", "Mozilla/5.0 (X11)", None)
    assert r.time_local == 1728561336
    assert 100 <= r.runtime <= 10000
    assert (rows[2].request_type, rows[2].request_path, rows[2].request_protocol) == ("", "", "")
    assert rows[3].reason == "bad_status"
    assert rows[4].request_path == "/ax22b?x=1"
    assert rows[5].time_local == rows[1].time_local          # two zones, one instant
    assert rows[6].reason == "malformed"


def test_local_time_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.createDataFrame([("31/Mar/2024:02:30:00",), ("99/Mar/2024:02:30:00",)], "s STRING")
        got = [r[0] for r in df.select(X.parse_local_time("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    from datetime import datetime
    assert got == [datetime(2024, 3, 31, 2, 30), None]     # a DST-gap wall time is kept


def test_combined_random_lines_match_python(spark):
    rnd = random.Random(21)
    words = ["a", "$1", "\\\\", '\\"', "[x]", "é", "中", "-", "GET", "POST", "BREW", "/p?q=1&r=2", "$", "%"]

    def field():
        return "".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))

    lines = []
    for _ in range(1500):
        method = rnd.choice(["GET", "POST", "DELETE", "BREW", "get"])
        req = " ".join([method, "/" + field().replace(" ", "")] + (["HTTP/1.1"] if rnd.random() < 0.8 else []))
        zone = rnd.choice(["+0000", "+0200", "-0530", "bad"])
        day = rnd.choice(["10", "1", "99"])
        status = rnd.choice(["200", "404", "-", "2x"])
        size = rnd.choice(["10", "0", "-"])
        line = (f'1.2.3.{rnd.randint(0, 9)} - u{rnd.randint(0, 5)} [{day}/Oct/2024:13:55:36 {zone}] '
                f'"{req}" {status} {size} "{field()}" "{field()}"')
        if rnd.random() < 0.05:
            line = line[: rnd.randrange(len(line))]
        lines.append(line)
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(lines)], "id BIGINT, value STRING")
    got = {r["id"]: r for r in P.parse_combined(df).collect()}
    for i, line in enumerate(lines):
        want = RM.parse_combined(line)
        row = got[i + 1]
        if isinstance(want, str):
            assert row["reason"] == want, (line, row["reason"], want)
        else:
            assert row["reason"] is None, (line, row["reason"])
            for k, v in want.items():
                assert row[k] == v, (line, k, row[k], v)
