"""Information-theoretic sanitisation of personal data (operator 4), DataFrame functions only.

Base spans (email, ip, card, phone) are found by patterns and checks. The terms of every document that holds a protected
entity, outside its base spans, are weighed by what they tell about it: with document counts over the whole corpus,
PMI(c; t) = log2(n(c,t) N / (n(c) n(t))) against the entity's own information IC(c) = log2(N / n(c)). A term that discloses a
share PMI / IC of at least `remove` is removed, one of at least `generalise` is generalised, both only if entity and term meet
in `support` documents; then every occurrence goes, in every document that holds the entity, wherever it stands.

A generalised term becomes [TERM], or, where the caller sets `broader`, a broader term that the corpus teaches: of the terms
that stand at most `near` terms away at a share `broader` of all its places, that are in more documents than it but at most
half of all, and that disclose no entity, the rarest (then the first by spelling), and [TERM] where there is none. That counts
all pairs of neighbours of such terms, which shuffles a multiple of the texts; the spans are the same either way, and
op4_sanitise, which returns spans and no text, leaves it out.

Patterns run only on texts that hold their key character and each is written so that no start is tried twice in a run. Pairs
are made from the entities found in `support` documents at least, times the distinct terms of their documents; counts are
map-side combined. No vocabulary is collected; the generalised terms are broadcast up to a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.common import checked, table, text_or_empty, written

#: Base kinds in their order. The patterns match what the contract's match, leftmost and non-overlapping; the
#: possessive forms and the look-behinds only keep the search linear.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
ORDER = [*KINDS, "removed", "generalised"]
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Terms in a block when a text's terms are gone through with their neighbours.
BLOCK = 64
#: What a span becomes in the sanitised text; a generalised term only where no broader term is known.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "generalised": "[TERM]"}


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits, n = _digits(match), F.length(_digits(match))
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = F.forall(F.split(match, r"\."), lambda p: part(p) & (F.when(part(p), p.substr(F.greatest(F.lit(1), F.length(p) - 2), F.lit(3)).cast("int")).otherwise(999) <= 255))
    return (
        F.when(kind == "email", True).when(kind == "ip", small)
        .when(kind == "card", F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def base_matches(docs: DataFrame) -> DataFrame:
    """(doc, row, text, found) for each row of docs(doc, row, text); found: (kind, pieces) of the kinds with a valid match, where
    pieces are, in order of place, (gap: code points since the match before, match); text: null where there is none."""

    def one(kind: str) -> Column:
        regex, text = KINDS[kind], F.col("text")
        hit, gap = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
        piece = F.transform(F.arrays_zip(hit.alias("m"), F.slice(gap, F.lit(1), F.size(hit)).alias("b")), lambda z: F.struct(F.length(z["b"]).alias("gap"), z["m"].alias("match")))
        test = F.contains(text, F.lit(NEEDS[kind])) & (text.rlike("[0-9]") if kind != "email" else F.lit(True))
        none = F.array().cast("array<struct<gap:int,match:string>>")
        return F.struct(F.lit(kind).alias("kind"), F.when(test, piece).otherwise(none).alias("pieces"))

    found = F.filter(F.array(*[one(k) for k in KINDS]), lambda k: F.exists(k["pieces"], lambda p: _valid(k["kind"], p["match"])))
    return docs.select("doc", "row", "text", found.alias("found")).withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def base_spans(matches: DataFrame) -> DataFrame:
    """(doc, row, kind, start, end, match): valid base spans; offsets in code points, end exclusive."""
    kinds = matches.select("doc", "row", F.explode("found").alias("f"))
    piece = kinds.select("doc", "row", F.col("f.kind").alias("kind"), F.posexplode("f.pieces").alias("k", "p")).select("doc", "row", "kind", "k", "p.*")
    here = Window.partitionBy("doc", "row", "kind").orderBy("k")
    ends = F.sum(F.col("gap") + F.length("match")).over(here.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = piece.withColumn("end", ends).withColumn("start", F.col("end") - F.length("match"))
    return spans.where(_valid(F.col("kind"), F.col("match"))).select("doc", "row", "kind", "start", "end", "match")


def blanked(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, row, text, blank): the texts with base spans; blank: the text with a space for each character of a base span."""
    places = spans.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))
    blank = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], a["at"]))).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return matches.join(places, ["doc", "row"]).select("doc", "row", "text", blank.alias("blank"))


def term_counts(docs: DataFrame, blanks: DataFrame) -> DataFrame:
    """(term, n_term): documents of docs that hold the term outside their base spans. Texts are read where they are: the terms
    that a document has in base spans only are taken off again."""
    every = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"), F.lit(1).alias("n"))
    inside = blanks.select(F.explode(F.array_except(_terms(F.col("text")), _terms(F.col("blank")))).alias("term"), F.lit(-1).alias("n"))
    return every.unionByName(inside).groupBy("term").agg(F.sum("n").alias("n_term"))


def term_windows(docs: DataFrame, near: int) -> DataFrame:
    """(term, others): each term of the texts, at each of its places, with the distinct other terms at most `near` terms away.

    A text's terms are cut into blocks first, which overlap by `near` on both sides, so that no row holds more than one."""
    seq = docs.select(_terms(F.col("text")).alias("seq"))
    cut = F.transform(F.sequence(F.lit(0), F.size("seq") - 1, F.lit(BLOCK)), lambda i: F.struct(F.least(i, F.lit(near)).alias("lead"), F.slice("seq", F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near)) + BLOCK + near).alias("part")))
    blocks = seq.where(F.size("seq") > 0).select(F.explode(cut).alias("b")).select("b.*")
    own = F.sequence(F.col("lead") + 1, F.least(F.col("lead") + BLOCK, F.size("part")))
    around = lambda i: F.slice("part", F.greatest(i - near, F.lit(1)), i - F.greatest(i - near, F.lit(1)) + near + 1)
    each = blocks.select("part", F.explode(own).alias("i")).select(F.element_at("part", F.col("i")).alias("term"), around(F.col("i")).alias("others"))
    return each.select("term", F.array_except("others", F.array("term")).alias("others"))


def broader_terms(docs: DataFrame, counts: DataFrame, told: DataFrame, total: int, broader: float, near: int) -> DataFrame:
    """(term, instead): the broader terms of the generalised terms in told(term, kind), where there is one.

    counts: (term, n_term), documents by term. All places of such a term in the corpus are counted, map-side combined."""
    wanted = checked(written(told.where("kind = 'generalised'").select("term").distinct()))
    places = term_windows(docs, near).join(wanted, "term")
    each = places.select("term", F.explode(F.concat(F.array("term"), "others")).alias("instead"))
    both = written(each.groupBy("term", "instead").agg(F.count("*").alias("n")))
    every = both.where("term = instead").select("term", F.col("n").alias("n_places"))
    fits = both.where("term != instead").join(every, "term").where(F.col("n") >= F.lit(broader) * F.col("n_places"))
    general = counts.where(F.col("n_term") <= total / 2).join(told.select("term").distinct(), "term", "left_anti")
    general = general.select(F.col("term").alias("instead"), F.col("n_term").alias("n_instead"))
    wider = fits.join(general, "instead").join(counts, "term").where("n_instead > n_term")
    return wider.groupBy("term").agg(F.min(F.struct("n_instead", "instead"))["instead"].alias("instead"))


def disclosures(docs: DataFrame, blanks: DataFrame, holds: DataFrame, support: int, generalise: float, remove: float, broader: float | None, near: int) -> DataFrame:
    """(doc, row, term, kind, instead): the terms to mask in each document; instead: the broader term, else null. holds: (doc,
    row, entity), distinct.

    The pairs that disclose are those of entity and term, counted by document over whole texts; each is masked in all
    documents that hold both."""
    total = docs.count()
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    live = holds.join(entities, "entity")
    pairs = live.join(blanks, ["doc", "row"]).select("doc", "row", "entity", "n_entity", F.explode(F.array_distinct(_terms(F.col("blank")))).alias("term"))
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity")).where(F.col("n_both") >= support)
    share = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term"))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    counts = term_counts(docs, blanks)
    if broader is not None:
        counts = written(counts.where(F.col("n_term") >= support))
    weighed = both.join(counts, "term").withColumn("share", share).where(F.col("share") >= generalise)
    told = written(weighed.select("entity", "term", F.when(F.col("share") >= remove, "removed").otherwise("generalised").alias("kind")))
    masked = pairs.join(told, ["entity", "term"]).select("doc", "row", "term", "kind").distinct()
    if broader is None:
        return masked.withColumn("instead", F.lit(None).cast("string"))
    instead = written(broader_terms(docs, counts, told, total, broader, near))
    return masked.join(checked(instead), "term", "left").select("doc", "row", "term", "kind", F.when(F.col("kind") == "generalised", F.col("instead")).alias("instead"))


def occurrences(blanks: DataFrame, told: DataFrame) -> DataFrame:
    """(doc, row, kind, start, end, instead): every place of the terms told(doc, row, term, kind, instead) in their documents."""
    texts = blanks.join(told.select("doc", "row").distinct(), ["doc", "row"], "left_semi")
    hit, gap = F.regexp_extract_all("blank", F.lit(TERM), F.lit(0)), F.split("blank", TERM, -1)
    piece = F.arrays_zip(hit.alias("t"), F.slice(gap, F.lit(1), F.size(hit)).alias("b"))
    each = texts.select("doc", "row", F.posexplode(piece).alias("k", "p")).select("doc", "row", "k", F.lower("p.t").alias("term"), F.length("p.t").alias("n"), (F.length("p.b") + F.length("p.t")).alias("step"))
    here = Window.partitionBy("doc", "row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum("step").over(here).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    return placed.join(told, ["doc", "row", "term"]).select("doc", "row", "kind", "start", "end", "instead")


def sanitise(docs: DataFrame, support: int = 3, generalise: float = 0.5, remove: float = 0.9, broader: float | None = None, near: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, spans (array of (kind, start, end, instead), base kinds first, then
    start; instead: the broader term of a generalised one, else null), text.

    text is the sanitised text, where a broader term stands in brackets; overlapping spans are masked as one, by the first. A
    null text counts as empty and has no spans. Rows that repeat an id and text, or have a null id, keep a row each, and rows
    that repeat both count as one document; other columns are not read; an empty table gives an empty result. Ties at a
    threshold disclose. Long texts are searched whole.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = texts.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("row"))
    repeated = rows.groupBy("doc", "row").count().where("count > 1").limit(1).count() > 0
    distinct = rows.dropDuplicates(["doc", "row"]) if repeated else rows
    matches = written(base_matches(rows)).where("text IS NOT NULL").dropDuplicates(["doc", "row"])
    spans = written(base_spans(matches))
    blanks = written(blanked(matches, spans))
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match"))
    holds = spans.select("doc", "row", F.concat_ws(":", "kind", value).alias("entity")).distinct()
    told = written(disclosures(distinct, blanks, holds, support, generalise, remove, broader, near))
    rank = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(ORDER) for x in (kind, k)]), F.col("kind"))
    every = spans.drop("match").withColumn("instead", F.lit(None).cast("string")).unionByName(occurrences(blanks, told))
    every = every.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "instead"))).alias("spans"))
    every = written(every)
    out = rows.join(every, ["doc", "row"], "left")
    mask = F.create_map(*[F.lit(x) for t in MASKS.items() for x in t])
    sanitised = F.aggregate(
        F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["instead"].alias("instead")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.coalesce(F.concat(F.lit("["), s["instead"], F.lit("]")), mask[s["kind"]])).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    none = F.array().cast(every.schema["spans"].dataType)
    return out.select("doc_id", F.coalesce("spans", none).alias("spans"), F.when(F.size("spans") > 0, sanitised).otherwise(F.col("text")).alias("text"))


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
