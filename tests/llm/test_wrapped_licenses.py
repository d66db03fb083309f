"""Operator 5 on notices that are wrapped over lines, against brute force over windows."""

import random

from loam.llm import licenses

from tests.llm.test_native_operators import blocks_brute


def test_wrapped_notices(spark):
    r = random.Random(23)
    docs = []
    for k in range(12 * len(licenses.TEMPLATES)):
        w = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1].split()
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = r.choice([[], ["lorem"]])
        w = ["ipsum"] * r.randint(0, 9) + w + r.choice([[], ["dolor"] * 40])
        cut = r.choice([2, 4, 7])
        docs.append((k, "\n# ".join(" ".join(w[a : a + cut]) for a in range(0, len(w), cut))))
    docs.append((5000, "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License"))
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = blocks_brute(docs, licenses.TEMPLATES)
    assert len(got) == len(docs) and sum(map(len, want.values())) > 50
    for d, _ in docs:
        assert {n.label: round(n.containment, 9) for n in got[d].notices} == {k: round(v, 9) for k, v in want.get(d, {}).items()}, d
    assert "notice:gpl" in {n.label for n in got[5000].notices}
