"""Operator 4 where it once did less: large ip parts, and terms far from the entity they disclose."""

import math
import re
from collections import Counter

from loam.llm import sanitise

from tests.llm.test_native_operators import base

PARTS = ["1.2.3.1001", "1001.2.3.4", "10.15.1234.5 and 10.15.0234.5", "9.1255.0.1", "2023.1.1.1", "1.1.1.00255 1.1.1.00256", "0.00.000.0000", "100000000000000000001.1.1.1"]


def test_large_parts(spark):
    got = sanitise.sanitise(spark.createDataFrame(list(enumerate(PARTS)), "doc_id long, text string")).collect()
    assert len(got) == len(PARTS)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.rank < 4] == base(PARTS[r.doc_id]), PARTS[r.doc_id]


def disclosing_brute(rows, support=3, generalise=0.5, remove=0.9):
    """{doc: {(kind, start, end)}} of the terms that disclose, from whole documents; rows are distinct."""
    term = re.compile(r"[^\W\d_][^\W_]{2,}")
    blank, held = {}, {}
    for d, t in rows:
        spans, chars = base(t), list(t)
        for _, a, b in spans:
            chars[a:b] = " " * (b - a)
        blank[d] = "".join(chars)
        held[d] = {f"{k}:{re.sub('[^0-9]', '', t[a:b]) if k in ('card', 'phone') else t[a:b].lower()}" for k, a, b in spans}
    terms = {d: {m.lower() for m in term.findall(t)} for d, t in blank.items()}
    n_term, n_entity = Counter(t for s in terms.values() for t in s), Counter(e for s in held.values() for e in s)
    both, out = Counter((e, t) for d in held for e in held[d] for t in terms[d]), {d: set() for d in held}
    share = {p: math.log2(n * len(rows) / (n_entity[p[0]] * n_term[p[1]])) / math.log2(len(rows) / n_entity[p[0]]) for p, n in both.items() if n >= support}
    for d in held:
        for m in term.finditer(blank[d]):
            for e in held[d]:
                if (s := share.get((e, m[0].lower()), 0)) >= generalise:
                    out[d].add(("removed" if s >= remove else "generalised", m.start(), m.end()))
    return out


def test_terms_anywhere(spark):
    far = "the desk or words " * 20
    rows = [(k, f"Nothing here but filler{k} words or the desk. " + far) for k in range(40)]
    rows += [(100 + k, f"Zebulon, room 12, 4111 1111 1111 1111 {far} and Zebulon again, number{k}; corp z@corp.org {far} ZEBULON. Quasimodo{'' if k else 'x'}") for k in range(4)]
    rows += [(200, f"Zebulon {far}"), (201, "corp and corp"), (202, "1.1.1.1 one"), (None, f"{far} Zebulon z@corp.org {far} Zebulon")]
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame([*rows, rows[40]], "doc_id long, text string")).collect()}
    want = disclosing_brute(rows)
    for d, text in rows:
        assert {(s.kind, s.start, s.end) for s in got[d].spans if s.rank > 3} == want[d], d
        assert ("zebulon" in got[d].text.lower()) == (d == 200)
    assert len({s.start for s in got[100].spans if s.rank > 3 and rows[40][1][s.start : s.end].lower() == "zebulon"}) == 3


def broader_brute(rows, wanted, disclosing, broader=0.5, near=5):
    """{term: broader term} of the wanted terms, from every place in whole texts."""
    term = re.compile(r"[^\W\d_][^\W_]{2,}")
    seqs = [[m.lower() for m in term.findall(t)] for _, t in rows]
    in_docs, places, both = Counter(t for s in seqs for t in set(s)), Counter(), Counter()
    for seq in seqs:
        for i, t in enumerate(seq):
            if t in wanted:
                places[t] += 1
                both.update((t, g) for g in {*seq[max(0, i - near) : i + near + 1]} - {t})
    fits = [(t, in_docs[g], g) for (t, g), n in both.items() if n >= broader * places[t] and in_docs[t] < in_docs[g] <= len(rows) / 2 and g not in disclosing]
    return {t: min((n, g) for u, n, g in fits if u == t)[1] for t, _, _ in fits}


def test_broader_terms(spark):
    fill = "the desk or words " * 30
    rows = [(k, f"{fill} filler{k} hospital {fill}") for k in range(30)] + [(100 + k, f"{fill}{fill} number{k}") for k in range(60)]
    rows += [(200 + k, f"{fill} the Quasimodo big hospital {fill} {'Lonely' if k % 2 else 'lonely'} {'' if k else 'hospital'} 4111 1111 1111 1111") for k in range(4)]
    rows += [(300 + k, f"Quasimodo hospital {fill}{fill}{fill} quasimodo {'one two hospital' if k else ''} {fill} lonely") for k in range(4)]
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), broader=0.5).collect()}
    masked = disclosing_brute(rows)
    told = {(kind, rows_text[a:b].lower()) for d, rows_text in rows for kind, a, b in masked.get(d, ())}
    want = broader_brute(rows, {t for kind, t in told if kind == "generalised"}, {t for _, t in told})
    assert want == {"quasimodo": "hospital"} and ("generalised", "lonely") in told
    for d, text in rows:
        for s in got[d].spans:
            assert s.instead == (want.get(text[s.start : s.end].lower()) if s.kind == "generalised" else None)
    assert "the [hospital]  hospital" in got[201].text and "[TERM]" in got[201].text and got[300].text == dict(rows)[300]
