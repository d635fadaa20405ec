"""op9: notices over several lines, inside longer lines, and licence bodies."""
import textwrap

from rampart.llm import licenses as C


def test_wrapped_embedded_and_bodies(spark):
    gpl, bsd = C.TEMPLATES["GPL-3.0"][1], C.TEMPLATES["BSD-3-Clause"][0]
    wrap = lambda t, w=70, lead="": "\n".join(lead + x for x in textwrap.wrap(t, w))
    cases = [(wrap(gpl), ("GPL-3.0", 1, 1)), ("a file\n\n" + wrap(bsd, 70, "# "), ("BSD-3-Clause", 1, 3)),
             ("The parser and its tests are released under the MIT License. See the file for more.", ("MIT", 1, 1)),
             ("x\nCopyright 2020 The Authors. Licensed under the Apache License, Version 2.0.", ("Apache-2.0", 1, 2)),
             ("Copyright (c) 2020 X\n\n" + wrap(C.BODIES["MIT"][0]), ("MIT", 1, 3)),
             ("Released under the\nMIT License.\ntext\nAll rights\nreserved.", ("MIT", 2, 1)),
             ("released some software; all rights to the license are with others", (None, 0, None))]
    cases += [(wrap(t, 60, " * "), (name, 1, 1)) for name, ts in C.BODIES.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in C.scan(df).collect()}
    assert [(got[i]["license"], got[i]["n_notices"], got[i]["line"]) for i in range(len(cases))] == [w for _, w in cases]
    assert all(got[i]["dice"] == (1.0 if w[0] else 0.0) for i, (_, w) in enumerate(cases))
