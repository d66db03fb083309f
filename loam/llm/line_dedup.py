"""Line dedup by a deletion-neighbourhood join (operator 6).

Two lines are near when one word inserted, deleted or replaced makes one of them the other; A-Z is lower-cased, words stand
between white space. Where the shorter has fewer than MIN_WORDS words, the edit is one character instead, other than a digit
(which tells numbered lines apart), of lines of MIN_CHARS characters at least, one space between words. Lines are decided in the
order of doc_id and line number: one is dropped when an equal or near line that stays occurs earlier anywhere in the corpus. So a
chain of near lines keeps every line that has no near one among those that stay. Blank lines stay.

Equal lines, by two independent 64-bit hashes and their length, are collapsed first. A near pair shares its first or its last
half, so lines that share a half with no other line are out; the rest emit the variants with one word (short lines: one
character) deleted outside a shared half, as hashed keys. A key with the place of the deletion joins lines that differ in that
place, one without it joins a line to those that have one more. Every key group is only asked for its earliest line, by
map-side minimums and an equi-join, so a group's size does not matter; the pair is then verified. Where the earliest near line
has one before it itself, rounds follow over the keys of such lines alone: what is near to a line that stays goes, what then has
no undecided line before it stays, until all are decided.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import checked, discard, fresh, table, text_or_empty, written
from loam.llm.wordhash import mix, pieces, sequence_values, word_hashes, word_spans

MIN_WORDS, MIN_CHARS = 8, 10
_SECOND = 0xC2B2AE3D27D4EB4F


def _lines(column: pa.Array):
    """(first row, rows, row, line number in the row, bytes, word starts, word ends, bounds by line) per piece of the column."""
    for first, data, offsets in pieces(column):
        cuts = np.flatnonzero(data == 10)
        n = len(offsets) - 1
        # every row has a line at its start, empty rows too; a newline at the very end of a row opens an empty line
        row = np.concatenate((np.arange(n), np.searchsorted(offsets, cuts, "right") - 1))
        at = np.concatenate((offsets[:-1], cuts + 1))
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        edges = np.concatenate((at, [len(data)]))
        start, end, _ = word_spans(data, offsets)
        yield first, n, row, number, data, start, end, np.searchsorted(start, edges)


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _half(m: np.ndarray) -> np.ndarray:
    """Words that a near pair, the shorter of m words, has in common at the start or else at the end."""
    return m // 2


def _normal(line: str) -> str:
    return b" ".join(line.encode().lower().split()).decode()


def _key(kind: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{kind} {text}".encode(), digest_size=8).digest(), "little", signed=True)


def _char_halves(text: str) -> list[int]:
    """The keys of a short line's halves, as the shorter and as the longer of a pair."""
    return [_key(f"{end}{m}", text[: m // 2] if end == "first" else text[len(text) - m // 2 :]) for m in (len(text), len(text) - 1) for end in ("first", "last")]


LINE_SHAPE = "doc long, print long, line int, n int, h1 long, h2 long, halves array<long>"


def _hashed(batches):
    """The lines of documents in LINE_SHAPE. halves: the keys of the first and the last half, as the shorter line of a pair and
    as the longer; by words (lines of MIN_WORDS words at least), and behind them by characters (lines of at most MIN_WORDS)."""
    schema = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, _, row, number, data, start, end, bounds in _lines(batch.column("text")):
            a, b = bounds[:-1], bounds[1:]
            n = b - a
            w = word_hashes(data, start, end)
            i, line = np.arange(len(w)), np.repeat(np.arange(len(n)), n)
            ahead, behind = _sums(sequence_values(w, i - a[line])), _sums(sequence_values(w, b[line] - 1 - i))
            other = _sums(sequence_values(word_hashes(data, start, end, _SECOND), i - a[line]))
            keys = []
            for m in (n, n - 1):
                q = np.maximum(_half(m), 0)
                length = m.astype(np.uint64) * np.uint64(_SECOND)  # keys only meet when they stand for the same shorter length
                keys += [mix(ahead[a + q] - ahead[a] + length + np.uint64(1)), mix(behind[b] - behind[b - q] + length + np.uint64(2))]
            wide = n >= MIN_WORDS
            short = np.zeros(len(n), bool)
            chars, at, lines = [], -1, []
            for k in np.flatnonzero((n > 0) & (n <= MIN_WORDS)):  # a line of MIN_WORDS words may lose a space
                if row[k] != at:
                    at, lines = row[k], texts[first + row[k]].split("\n")
                if len(text := _normal(lines[number[k]])) >= MIN_CHARS:
                    short[k] = True
                    chars.append(_char_halves(text))
            ends = np.concatenate(([0], np.cumsum(4 * wide + 4 * short)))
            flat = np.zeros(ends[-1], np.int64)
            flat[ends[:-1][wide][:, None] + np.arange(4)] = np.stack(keys, 1)[wide].astype(np.int64)
            flat[(ends[:-1] + 4 * wide)[short][:, None] + np.arange(4)] = np.array(chars, np.int64).reshape(-1, 4)
            halves = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            take = pa.array(first + row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("print").take(take), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mix(ahead[b] - ahead[a]).astype(np.int64)), pa.array(mix(other[b] - other[a]).astype(np.int64)), halves], schema=schema
            )


def _picked(batches):
    """The wanted lines of documents: rows (text, wanted) to (id, mask, text)."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = text.split("\n")
            out += [(w["id"], w["mask"], lines[w["line"]]) for w in wanted]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["id", "mask", "text"])


def _outside(mask, n):
    """(low, high): deletions at places from low on, and below high, lie outside a half that the mask says is shared.

    Bits: first half, last half as the shorter line of a pair; the same as the longer one."""
    low = np.minimum(np.where(mask & 1, n // 2, n), np.where(mask & 4, (n - 1) // 2, n))
    return low, np.maximum(np.where(mask & 2, n - n // 2, 0), np.where(mask & 8, n - (n - 1) // 2, 0))


def _variants(batches):
    """(id, key, at): the line itself (at -1) and the line without one of its words (at: the word's place), and for short lines
    the same by characters other than digits; only what can meet a line that shares a half."""
    for batch in batches:
        texts, masks = batch.column("text").to_pylist(), batch.column("mask").to_numpy()
        for first, n, _, _, data, start, end, bounds in _lines(batch.column("text")):
            w, a, b = word_hashes(data, start, end), bounds[:-1], bounds[1:]
            line, i = np.repeat(np.arange(n), b - a), np.arange(len(w))
            place, mask = i - a[line], masks[first : first + n]
            ahead, moved = _sums(sequence_values(w, place)), _sums(sequence_values(w, place - 1))
            without = mix(ahead[i] - ahead[a[line]] + moved[b[line]] - moved[i + 1])
            low, high = _outside(mask & 15, b - a)
            cut, whole = (place >= low[line]) | (place < high[line]), (mask & 3) > 0
            take = np.concatenate((np.flatnonzero(whole), line[cut]))
            key = np.concatenate((mix(ahead[b] - ahead[a])[whole], without[cut])).astype(np.int64)
            at = np.concatenate((np.full(int(whole.sum()), -1), place[cut]))
            more = []
            for k in np.flatnonzero(mask >> 4):
                text = _normal(texts[first + k])
                low, high = _outside(mask[k] >> 4, len(text))
                if mask[k] >> 4 & 3:
                    more.append((k, _key("chars", text), -1))
                more += [(k, _key("chars", text[:i] + text[i + 1 :]), i) for i, c in enumerate(text) if (i >= low or i < high) and not c.isdigit()]
            if more:
                more = np.array(more, np.int64)
                take, key, at = np.concatenate((take, more[:, 0])), np.concatenate((key, more[:, 1])), np.concatenate((at, more[:, 2]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(first + take)), pa.array(key), pa.array(at.astype(np.int32))], ["id", "key", "at"])


def near_lines(a: str, b: str) -> bool:
    """Whether at most one word is inserted, deleted or replaced between the lines."""
    x, y = a.encode().lower().split(), b.encode().lower().split()
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    e = 0
    while e < min(len(x), len(y)) - k and x[-1 - e] == y[-1 - e]:
        e += 1
    return max(len(x), len(y)) - k - e <= 1


def near_chars(a: str, b: str) -> bool:
    """Whether at most one character, no digit, is inserted, deleted or replaced between the lines of MIN_CHARS at least."""
    x, y = _normal(a), _normal(b)
    if min(len(x), len(y)) < MIN_CHARS:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    e = 0
    while e < min(len(x), len(y)) - k and x[-1 - e] == y[-1 - e]:
        e += 1
    return max(len(x), len(y)) - k - e <= 1 and not any(c.isdigit() for c in x[k : len(x) - e] + y[k : len(y) - e])


def near(a: str, b: str) -> bool:
    short = min(len(a.encode().split()), len(b.encode().split())) < MIN_WORDS
    return near_chars(a, b) if short else near_lines(a, b)


def _checked(batches):
    for batch in batches:
        ok = [near(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("text2").to_pylist(), strict=True)]
        yield batch.filter(pa.array(ok, pa.bool_())).select(["id", "other"])


PLACE = ["doc", "print", "line"]


def _verified(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, other), written: the earliest other of each id among pairs that are near, other before id."""
    pairs = written(found.where("other < id").distinct())
    texts = pairs.join(lines.select("id", "text"), "id").join(lines.select(F.col("id").alias("other"), F.col("text").alias("text2")), "other")
    out = written(texts.select("id", "other", "text", "text2").mapInArrow(_checked, "id long, other long").groupBy("id").agg(F.min("other").alias("other")))
    discard(pairs)
    return out


def _meeting(some: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (id, other) of variants(id, key, at) that may be near: for each key group the earliest other."""
    cut, whole = some.where("at >= 0"), some.where("at < 0")
    least = lambda rows, *key: rows.groupBy(*key).agg(F.min("id").alias("other"))
    same = cut.join(least(others.where("at >= 0"), "key", "at"), ["key", "at"])
    shorter = cut.join(least(others.where("at < 0"), "key"), "key")
    longer = whole.join(least(others.where("at >= 0"), "key"), "key")
    return same.select("id", "other").unionByName(shorter.select("id", "other")).unionByName(longer.select("id", "other"))


def _decided(near: DataFrame, variants: DataFrame, lines: DataFrame) -> DataFrame:
    """near(id, other) for the lines that go, other being one that stays; near given: the earliest near line of each that has one."""
    dropped = near.join(near.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other")
    undecided = written(near.select("id").join(dropped.select("id"), "id", "left_anti"))
    if not undecided.limit(1).count():
        discard(undecided)
        return near
    keys = variants.join(checked(undecided), "id", "left_semi").select("key").distinct()
    around = written(variants.join(checked(written(keys)), "key", "left_semi"))
    of = lambda ids: around.join(checked(ids), "id", "left_semi")
    kept, gone = written(around.select("id").distinct().join(near.select("id"), "id", "left_anti")), [written(dropped)]
    while undecided.limit(1).count():
        gone.append(_verified(_meeting(of(undecided), of(kept)), lines))
        left = written(undecided.join(gone[-1].select("id"), "id", "left_anti"))
        blocked = _verified(_meeting(of(left), of(left)), lines)
        kept, undecided = written(left.join(blocked.select("id"), "id", "left_anti")), written(blocked.select("id"))
        discard(left, blocked)
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return written(out)


def near_earlier(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(first, near): for the first occurrence of a line that goes, a near line before it that stays; both are places."""
    half = firsts.select("number", "n", F.posexplode("halves").alias("role", "key"))
    half = half.select("number", "key", F.when(F.col("n") < MIN_WORDS, F.col("role") + 4).otherwise(F.col("role")).alias("role"))
    shared = half.groupBy("key").agg(F.count("*").alias("f")).where("f > 1").select("key")
    marked = half.join(shared, "key", "left_semi").groupBy("number").agg(F.expr("bit_or(shiftleft(1, role))").alias("mask"))
    # ids in the order of the places, so that the smaller id is the earlier line
    wanted = written(marked.join(firsts.select("number", "first"), "number").select("first.*", "mask").orderBy(*PLACE).withColumn("id", F.monotonically_increasing_id()))
    by_text = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("id", "line", "mask")).alias("wanted"))
    lines = written(docs.join(by_text, ["doc", "print"]).dropDuplicates(["doc", "print"]).select("text", "wanted").mapInArrow(_picked, "id long, mask int, text string"))
    variants = written(lines.mapInArrow(_variants, "id long, key long, at int"))
    cut, whole = variants.where("at >= 0"), variants.where("at < 0").select("id", "key")
    least = written(cut.groupBy("key", "at").agg(F.min("id").alias("other"), F.count("*").alias("size")).where("size > 1").drop("size"))
    longer = written(cut.select("id", "key").join(whole.groupBy("key").agg(F.min("id").alias("whole")), "key"))
    found = cut.join(checked(least), ["key", "at"]).select("id", "other").unionByName(longer.select("id", F.col("whole").alias("other")))
    found = found.unionByName(whole.join(longer.groupBy("key").agg(F.min("id").alias("other")), "key").select("id", "other"))
    first = _verified(found, lines)
    discard(least, longer)
    near = _decided(first, variants, lines)
    discard(variants)
    place = lambda name: wanted.select(F.col("id").alias(name), F.struct(*PLACE).alias(f"{name}_place"))
    out = written(near.join(place("id"), "id").join(place("other"), "other").select(F.col("id_place").alias("first"), F.col("other_place").alias("near")))
    discard(wanted, lines, first, near)
    return out


def line_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, print, line, kind, keep_doc, keep_line) of every dropped line of docs(doc_id, text); print: hash of the text.

    kind is equal (to an earlier line that stays) or near; keep_doc and keep_line name that line. Null texts are empty: one
    blank line. Rows that repeat an id and a text are one document; those with one id and different texts come in the order
    of their hash. A null id comes first. Other columns are not read; an empty table gives an empty result.
    """
    null = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), null).alias("doc"), text_or_empty().alias("text")).withColumn("print", F.xxhash64("text"))
    lines = written(rows.mapInArrow(_hashed, LINE_SHAPE))
    same = ["n", "h1", "h2"]
    firsts = lines.where("n > 0").groupBy(*same).agg(F.min(F.struct(*PLACE)).alias("first"), F.min("halves").alias("halves"), F.count("*").alias("times"))
    firsts = written(firsts.withColumn("number", F.monotonically_increasing_id()))
    near = near_earlier(rows, firsts)
    # only groups of which a line goes: those with more than one occurrence, and those with a near line before them
    kept = written(firsts.select(*same, "first", "times").join(checked(near), "first", "left").where("times > 1 OR near IS NOT NULL").drop("times"))
    discard(near, firsts)
    found = lines.where("n > 0").select(*PLACE, *same).join(checked(kept), same)
    drop = found.where((F.struct(*PLACE) != F.col("first")) | F.col("near").isNotNull())
    kind = F.when(F.col("near").isNull(), "equal").otherwise("near")
    drop = drop.select(*PLACE, kind.alias("kind"), F.coalesce("near", "first").alias("keep")).distinct()
    back = lambda c: F.when(c != null, c)
    return drop.select(back(F.col("doc")).alias("doc_id"), "print", "line", "kind", back(F.col("keep.doc")).alias("keep_doc"), F.col("keep.line").alias("keep_line"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """docs with the text of the lines that stay, and two columns more: n_lines, and dropped (array of line numbers); one row
    per row. Where docs has a column of such a name, the new one has an underscore behind it."""
    n_lines, dropped = fresh(docs, "n_lines"), fresh(docs, "dropped")
    drop = line_duplicates(docs).groupBy(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).agg(F.array_sort(F.collect_list("line")).alias("gone_lines"))
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.join(drop, docs["doc_id"].cast("long").eqNullSafe(drop["gone_id"]) & (F.xxhash64(text) == drop["gone_print"]), "left")
    gone, lines = F.coalesce(drop["gone_lines"], F.array().cast("array<int>")), F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    own = [F.when(F.size(gone) > 0, kept).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return out.select(*own, F.size(lines).alias(n_lines), gone.alias(dropped))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("dropped")).cast("long").alias("n_kept"), F.array_join("dropped", ",").alias("dropped"), F.sha2("text", 256).alias("kept_sha256"))
