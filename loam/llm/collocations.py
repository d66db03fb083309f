"""Phrase collocations by prefix-free parsing (operator 11).

A piece of text (what stands between punctuation marks) is parsed into chunks: a chunk ends with a trigger, three words whose
hash is divisible by PERIOD, and the next one starts with it. So the parse depends on the content alone, equal passages parse
alike wherever they stand, and the corpus becomes a dictionary of distinct chunks with their parse frequencies. Phrases are
counted inside the distinct chunks, weighted by these frequencies. A phrase of up to four words belongs to the chunk in which
it starts before the overlap of three words, and lies in it whole; the last chunk of a piece also owns what starts in its end.
Every place of a phrase is so counted once.

One and two words are counted first, by 64-bit keys, which takes little of a shuffle: a frequent phrase has a frequent key.
Phrases with such keys are then counted by their text. Three and four words are counted only where all pairs of neighbours in
them have the keys of frequent pairs. So a key only ever keeps too much, and every count is that of a text. (A task adds up the
places of a text by a 64-bit hash and a sum over its bytes before it passes the text on.) Where there are more frequent keys than KEYS, which
every worker holds, texts are counted and joined without them, to the same result. All counts combine before they are
shuffled, so a hot chunk or phrase is one row for each task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm import wordhash
from loam.llm.common import discard, table, written

#: Words of a trigger, and the mean distance of triggers.
OVERLAP, PERIOD = 3, 32
#: The share of PERIOD that the first word of a trigger decides alone.
FIRST = 4
LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: Shares of 100 * a from which a longer phrase covers a shorter one.
COVERED = 80
#: Keys that a worker may hold, of 8 bytes, and the bytes of chunks that a worker looks at together.
KEYS, BYTES = 1 << 22, 1 << 20
#: Chunks in an Arrow batch.
CHUNKS = 4096
_GROW = np.uint64(0xD6E8FEB86659FD93)
#: Distinct keys that a task counts before it passes them on.
HELD = 200_000
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
#: Parts in which a language's phrases are ranked before the last ranking.
SALTS = 64


def _inner(words: list[bytes], period: int, sure: dict[bytes, bool]) -> tuple[list[bytes], bytes]:
    """The chunks of a piece's words but the last, and the last. A trigger's first word has a hash divisible by FIRST; sure
    remembers words."""
    at, out = 0, []
    for i in range(1, len(words) - OVERLAP):
        w = words[i]
        if (ok := sure.get(w)) is None:
            ok = sure[w] = zlib.crc32(w) % FIRST == 0
        if ok and xxhash.xxh64_intdigest(b" ".join(words[i : i + OVERLAP])) % period == 0:
            out.append(b" ".join(words[at : i + OVERLAP]))
            at = i
    return out, b" ".join(words[at:] if at else words)


def parsed(docs: DataFrame, period: int = PERIOD // FIRST) -> DataFrame:
    """(lang, chunk, last, freq) of docs(lang, text): the dictionary of chunks. last: the chunk ends its piece. A null language
    is und, a null text empty. A task adds up what it has read so far, HELD chunks at most, then equal chunks meet."""

    def run(batches):
        found: dict[tuple[str, bool], Counter] = {}
        sure: dict[bytes, bool] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                inner, ends = [], []
                for piece in (text.as_py() or b"").lower().translate(_MARKS).split(b"\n"):
                    if words := piece.split():
                        if len(words) > OVERLAP + 1:
                            more, last = _inner(words, period, sure)
                            inner += more
                            ends.append(last)
                        else:
                            ends.append(b" ".join(words))
                for last, chunks in ((False, inner), (True, ends)):
                    found.setdefault((lang, last), Counter()).update(chunks)
            if sum(map(len, found.values())) > HELD:
                yield from _counted(found)
                found, sure = {}, {}
        yield from _counted(found)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, chunk string, last boolean, n long")
    return rows.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("freq"))


def _counted(found: dict[tuple[str, bool], Counter]):
    for (lang, last), chunks in found.items():
        for k in range(0, len(chunks), 50_000):
            part = list(islice(chunks.items(), k, k + 50_000))
            texts = pa.array([c for c, _ in part], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), texts, pa.array([last] * len(part)), pa.array([n for _, n in part], pa.int64())], ["lang", "chunk", "last", "n"])


def _gathered(batches):
    """Batches of the dictionary put together to about BYTES of chunks."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("chunk").nbytes
        if size >= BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _places(table: pa.Table):
    """(data, start, end, row, room, keys): the words of the chunks, where they stand in the bytes data and in which row; room is
    the most words that a phrase may have which starts there and belongs to its chunk; keys: hashes of language and word."""
    table = table.combine_chunks()
    names = table.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
    last = table.column("last").combine_chunks().to_numpy(zero_copy_only=False)
    for first, data, offsets in wordhash.pieces(table.column("chunk").combine_chunks()):
        start, end, row = wordhash.word_spans(data, offsets)
        stop = np.searchsorted(row, row, "right")  # where the words of the row end
        row = row + first
        room = np.minimum(stop - np.arange(len(row)), MOST_WORDS)
        room[~last[row] & (np.arange(len(row)) >= stop - OVERLAP)] = 0  # the next chunk's
        yield data, start, end, row, room, wordhash.mix(wordhash.word_hashes(data, start, end) + lang[row])


def _keys(words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Keys of the phrases of n words that start at those places."""
    key = words[at]
    for k in range(1, n):
        key = wordhash.mix(key * _GROW + words[at + k])
    return key


def _among(keys: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Which keys are in wanted, an array in order; None: all."""
    if wanted is None:
        return np.ones(len(keys), bool)
    at = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
    return wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)


def _texts(table: pa.Table, data, start, end, row, at: np.ndarray, n: int, keys: np.ndarray, sums: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    """The phrases of n words at those places with their summed frequencies; they are told apart by key, and by what sums, running
    sums of a value for each byte, say of their text."""
    check = sums[end[at + n - 1]] - sums[start[at]]
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.diff(keys[order]) != 0
    if (np.diff(check[order])[~new[1:]] != 0).any():
        order = np.lexsort((check, keys))
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(check[order]) != 0)
    first, heads = order[new], np.flatnonzero(new)
    total = np.add.reduceat(freq[row[at[order]]], heads) if len(order) else np.zeros(0, np.int64)
    a, b = start[at[first]], end[at[first] + n - 1]
    offsets = np.concatenate(([0], np.cumsum(b - a)))
    text = data[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]  # words of a chunk are one space apart
    phrase = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
    lang = table.column("lang").take(pa.array(row[at[first]])).combine_chunks()
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(keys[first].view(np.int64)), pa.array(total)], ["lang", "phrase", "key", "n"])


def short_keys(dictionary: DataFrame) -> DataFrame:
    """(key, f) of the keys of all phrases of one and two words."""

    def run(batches):
        for table in _gathered(batches):
            freq = table.column("freq").to_numpy()
            for _, _, _, row, room, words in _places(table):
                for n in (1, 2):
                    at = np.flatnonzero(room >= n)
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(words, n, at).view(np.int64)), pa.array(freq[row[at]])], ["key", "n"])

    return dictionary.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("f"))


def counts(dictionary: DataFrame, sizes: tuple[int, ...], wanted: np.ndarray | None, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, key, f) of phrases of those sizes: with a key in wanted, and with all pairs of neighbours among pairs."""

    byte = wordhash.mix(np.arange(1, 257, dtype=np.uint64) * _GROW)

    def run(batches):
        for table in _gathered(batches):
            freq = table.column("freq").to_numpy()
            for data, start, end, row, room, words in _places(table):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[data])))
                near = np.zeros(len(row), bool)
                if pairs is not None:
                    at = np.flatnonzero(np.concatenate((row[1:] == row[:-1], [False])))
                    near[at] = _among(_keys(words, 2, at), pairs)
                for n in sizes:
                    at = np.flatnonzero(room >= n)
                    for k in range(n - 1) if pairs is not None else ():
                        at = at[near[at + k]]
                    keys = _keys(words, n, at)
                    ok = _among(keys, wanted)
                    yield _texts(table, data, start, end, row, at[ok], n, keys[ok], sums, freq)

    return dictionary.mapInArrow(run, "lang string, phrase string, key long, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("key").alias("key"))


def _held(keys: DataFrame) -> np.ndarray | None:
    """The keys in order, if there are no more than KEYS."""
    if keys.limit(KEYS + 1).count() > KEYS:
        return None
    return np.sort(keys.select("key").toArrow().column("key").to_numpy().view(np.uint64))


def _own(n: int) -> str:
    """SQL for the number of places in the chunk w at which a phrase of n words starts that belongs to it."""
    return f"if(last, size(w) - {n - 1}, size(w) - {OVERLAP})"


def joined_counts(dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the phrases of three and four words in which all neighbours are pairs(lang, phrase), by joins."""
    pair = lambda k: f"concat(w[i + {k - 1}], ' ', w[i + {k}])"
    places = F.expr(f"explode_outer(if({_own(3)} > 0, transform(sequence(1, {_own(3)}), i -> struct({pair(0)} AS a, {pair(1)} AS b, if(i + 3 <= size(w), {pair(2)}, NULL) AS c)), array()))")
    rows = dictionary.select("lang", "last", "freq", F.split("chunk", " ").alias("w")).select("lang", "freq", places.alias("p")).where("p IS NOT NULL").select("lang", "freq", "p.*")
    known = lambda c: pairs.select("lang", F.col("phrase").alias(c))
    rows = rows.join(known("a"), ["lang", "a"], "left_semi").join(known("b"), ["lang", "b"], "left_semi").join(known("c").withColumn("four", F.lit(True)), ["lang", "c"], "left")
    three = F.concat("a", F.lit(" "), F.substring_index("b", " ", -1))
    four = F.concat(three, F.lit(" "), F.substring_index("c", " ", -1))
    phrase = F.explode(F.when(F.col("four"), F.array(three, four)).otherwise(F.array(three)))
    return rows.select("lang", "freq", phrase.alias("phrase")).groupBy("lang", "phrase").agg(F.sum("freq").alias("f"))


def frequent_phrases(dictionary: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f), written, of the phrases of one to four words that occur `least` times or more."""
    enough = F.col("f") >= least
    keys = written(short_keys(dictionary).where(enough).select("key"), CHUNKS)
    short = written(counts(dictionary, (1, 2), _held(keys)).where(enough), CHUNKS)
    pairs = short.where(F.contains("phrase", F.lit(" ")))
    held = _held(pairs)
    long = joined_counts(dictionary, pairs) if held is None else counts(dictionary, (3, 4), None, held)
    discard(keys)
    return short.drop("key").unionByName(written(long.where(enough).select("lang", "phrase", "f"), CHUNKS))


def _span(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lowest-scoring cut of each phrase of frequent(lang, phrase, f) with two words or more;
    of equal scores the one after the fewest words. Decimals of 38 digits: exact for all counts that a long holds."""
    rows = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cut = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", _span(F.lit(1), F.col("k")).alias("left"), _span(F.col("k") + 1, F.size("words")).alias("right"))
    side = lambda c, n: frequent.select("lang", F.col("phrase").alias(c), F.col("f").alias(n))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return cut.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def covering(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of each phrase of two words or more inside a longer frequent one, the largest count of these."""
    rows = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    inside = F.expr("explode(flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' ')))))")
    return rows.select("lang", F.col("f"), inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, period: int = PERIOD // FIRST) -> DataFrame:
    """Ranked phrases of each language of docs(lang, text): lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to 4 words that occur `least` times or more; a is the count, l and r those of the parts at the cut, n the
    words of the language, score floor(2000000 * a / (l + r)). A phrase goes where a longer candidate around it has 80 % of its
    count or more. The first `top` of a language by score, count and phrase (in byte order) stay. A null language is und, apart
    from nothing else: a language named und is the same. Null and empty texts hold no words; rows that repeat count each time;
    other columns, ids too, are not read; an empty table gives an empty result.
    """
    dictionary = written(parsed(docs, period))
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("freq") * (F.size(F.split("chunk", " ")) - F.when(F.col("last"), 0).otherwise(OVERLAP))).alias("n"))
    frequent = frequent_phrases(dictionary, least)
    whole = scored(frequent).join(covering(frequent), ["lang", "phrase"], "left")
    kept = whole.where("longer IS NULL OR 100 * cast(longer AS decimal(20,0)) < %d * cast(a AS decimal(20,0))" % COVERED).drop("longer")
    kept = written(kept.join(F.broadcast(written(totals)) if totals.limit(100_001).count() <= 100_000 else totals, "lang"))
    discard(dictionary)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    part = kept.select("*", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return part.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same by counting every phrase at every place.
OP11_SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents)),
word AS (SELECT id, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM piece),
place AS (SELECT lang, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS d FROM word WINDOW p AS (PARTITION BY id ORDER BY i)),
gram AS (
  SELECT lang, 1 AS k, a AS phrase FROM place UNION ALL SELECT lang, 2, a || ' ' || b FROM place WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM place WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM place WHERE d IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, s.s, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM cand c JOIN (SELECT unnest([1, 2, 3]) AS s) s ON s.s < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, s.s), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, s.s + 1, c.k), ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1),
inner_phrase AS (
  SELECT c.lang, array_to_string(list_slice(c.w, i.i, i.i + n.n - 1), ' ') AS phrase, max(c.a) AS longer
  FROM cand c JOIN (SELECT unnest([2, 3]) AS n) n ON n.n < c.k JOIN (SELECT unnest([1, 2, 3]) AS i) i ON i.i + n.n - 1 <= c.k
  GROUP BY 1, 2),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, t.n::BIGINT AS n, b.score::BIGINT AS score
FROM best b JOIN total t USING (lang) LEFT JOIN inner_phrase i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a
QUALIFY rank <= 2000"""
