"""The licence scan against plain Python over every paragraph of a table, its quality on examples held out, and odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import licenses


def brute(rows):
    held, out = licenses.model(), Counter()
    for i, t in rows:
        for k, p in enumerate(licenses.paragraphs_of(t) if t is not None else []):
            name, probability, similarity, same = licenses.judge_paragraph(p)
            if name != licenses.UNKNOWN and (same or probability >= held["least"]):
                out[i, k, name, round(probability, 4), round(similarity, 4), similarity >= 0.6] += 1
    return out


def test_every_paragraph_is_judged_as_by_plain_python(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the Software)"
    rows += [(9_000, None), (9_001, ""), (9_002, mit), (9_003, "a\r\nReleased under the MIT License.\r\n\r\nGPLv3 license"), (9_003, "a"), (None, "CC0 license"), (9_004, "MIT " * 60_000), (9_005, "x" * 300_000)]
    rows += [(9_006, "Mit und ohne.\nThe license of the pub was lost.\nAll rights reserved"), (9_007, "\n".join(["SPDX-License-Identifier: ISC"] * 300)), (9_007, "\n".join(["SPDX-License-Identifier: ISC"] * 300))]
    rows += [(10_000 + k, x) for k, x in enumerate(x for own in licenses.EXAMPLES.values() for x in own)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, paragraph int, licence string, _w double")
    got = Counter((r.doc_id, r.paragraph, r.licence, round(r.probability, 4), round(r.similarity, 4), r.confirmed) for r in licenses.scan(df).collect())
    want = brute(rows)
    assert {x[:3] for x in got} == {x[:3] for x in want} and sum(got.values()) == sum(want.values())
    near = {x[:3]: x for x in want if x[0] != 9_003}
    assert not [(x, near[x[:3]]) for x in got if x[:3] in near and (abs(x[3] - near[x[:3]][3]) > 2e-4 or abs(x[4] - near[x[:3]][4]) > 2e-4)]
    assert (9_002, 0, "mit") in near and {(9_003, 1, "mit"), (9_003, 3, "gpl-3.0")} <= {x[:3] for x in want} and not any(x[0] == 9_006 and x[1] < 2 for x in got)
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_example_is_recognised():
    """All texts, notices and identifiers of the module, and the same within further words."""
    m = licenses.model()
    for name, own in licenses.EXAMPLES.items():
        for x in own:
            got, probability, _, same = licenses.judge_paragraph(x)
            assert got == name and (name == licenses.UNKNOWN or same or probability >= m["least"]), (name, x, got, probability)
    for name, x in (("mit", "// Copyright (c) 2021 Jane Doe. Released under the MIT License."), ("gpl-2.0", "# SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "This project is Released under the LGPL version 3, unless stated otherwise"), ("bsd", "/* SPDX-License-Identifier: BSD-3-Clause */")):
        assert licenses.judge_paragraph(x)[0] == name


def test_quality_on_names_and_texts_held_out():
    """Whole names, with all phrases about them, and every text and notice by itself are left out of training and of the templates."""
    unknown = list(licenses.EXAMPLES).index(licenses.UNKNOWN)
    held = licenses._held_out()
    right = [b == c for _, c, b in held]
    assert np.mean(right) > 0.74 and np.mean([b == c for _, c, b in held if c != unknown]) > 0.7 and all(b == c for _, c, b in held if c == unknown)
    # probabilities mean what they say: their mean is near the share of right classes
    m = licenses.model()
    p = [np.exp(z / m["temperature"] - (z / m["temperature"]).max()) for z, _, _ in held]
    assert abs(np.mean([float((x / x.sum()).max()) for x in p]) - np.mean([int(z.argmax()) == c for z, c, _ in held])) < 0.1


def test_hashes_are_sparks(spark):
    grams = ["mit license", "apache", "the gnu general"]
    df = spark.createDataFrame([(g.split(),) for g in grams], "w array<string>")
    own = [F.xxhash64(*[F.get("w", F.lit(k)) for k in range(n)]).alias("h") for n in (2, 1, 3)]
    assert [df.where(F.size("w") == n).select(h).first().h for n, h in zip((2, 1, 3), own)] == [licenses.gram_hash(g) for g in grams]
