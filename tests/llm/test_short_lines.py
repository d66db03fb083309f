"""Operator 6 on short lines that differ in one character, against brute force."""

import random

from loam.llm import line_dedup

from tests.llm.test_lines_and_toxicity import edit


def brute(docs):
    earlier, out = [], {d: [] for d, _ in docs}
    for d, text in sorted(docs):
        for k, line in enumerate(text.split("\n")):
            w = line.lower().split()
            if not w:
                continue
            t = " ".join(w)

            def near(e):
                if min(len(w), len(e)) >= 8:
                    return edit(w, e) <= 1
                u = " ".join(e)
                digits = ["".join(c for c in x if c.isdigit()) for x in (t, u)]
                return t == u or (min(len(t), len(u)) >= 10 and abs(len(t) - len(u)) <= 1 and digits[0] == digits[1] and edit(t, u) <= 1)

            if any(near(e) for e in earlier):
                out[d].append(k)
            else:
                earlier.append(w)
    return out


def test_short_lines(spark):
    r = random.Random(29)
    docs = [(1, "Table of contents"), (2, "Table of contants\nTable ofcontents"), (3, "Chapter 12 ends\nbread"), (4, "Chapter 13 ends\nbreed"), (5, "één twee drie vier"), (6, "eén  twee DRIE vier"), (7, "one two three four five six seven eight"), (8, "one twothree four five six seven eight")]
    for base in range(25):
        line = " ".join("".join(r.choices("abé7", k=r.randint(1, 6))) for _ in range(r.choice([1, 2, 4, 7, 8, 9])))
        for k in range(6):
            new = line
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(new) + 1)
                new = new[:at] + r.choice(["", r.choice("abé7 ")]) + new[at + r.choice([0, 1]) :]
            docs.append((100 + base * 10 + k, new))
    got = {x.doc_id: list(x.dropped) for x in line_dedup.without_duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert got[2] == [0, 1] and got[4] == [] and got[6] == [0] and got[8] == [0]


def test_chains_keep_what_no_kept_line_is_near_to(spark):
    r = random.Random(7)
    docs = []
    for chain in range(12):
        words = [f"c{chain}w{k}" for k in range(10)]
        for step in range(r.choice([2, 3, 4, 5, 9])):
            docs.append((len(docs), " ".join(words)))
            words[step] = f"x{chain}y{step}"  # one word further from the first, one from the line before
    r.shuffle(docs)
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(900 + k, t) for k, (_, t) in enumerate(docs[:20])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert {x.doc_id: list(x.dropped) for x in line_dedup.without_duplicate_lines(df).collect()} == want
    stays = {(d, 0) for d, gone in want.items() if not gone}
    found = line_dedup.line_duplicates(df).collect()
    assert found and all((x.keep_doc, x.keep_line) in stays for x in found)
