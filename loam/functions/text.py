"""Text functions: each takes Columns (or names) and returns a Column of built-in expressions. Rule tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam import rules


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def either(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mentions(text, needles) -> Column:
    """Whether any needle is a substring; false for a null text."""
    return F.coalesce(either(F.contains(col(text), F.lit(n)) for n in needles), F.lit(False))


def escaped(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in literal)


def squeeze(text) -> Column:
    """White space runs to one blank, none at the ends; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def normal_category(value, allowed=rules.CATEGORIES, aliases=rules.CATEGORY_ALIASES, default="general") -> Column:
    v = F.lower(F.trim(col(value)))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(v.isin(list(allowed)), v).otherwise(F.coalesce(known[v], F.lit(default)))


def embed_text(text, title, category, least=100, most=2000) -> Column:
    """White space collapsed; a text below `least` is padded with title and category; cut at `most` code points."""
    context = F.trim(F.concat_ws(" ", *[F.when(col(c) != "", col(c)) for c in (title, category)]))
    padded = lambda flat: F.when((F.length(flat) < least) & (context != ""), F.trim(F.concat(flat, F.lit(" "), context))).otherwise(flat)
    return F.left(let(squeeze(text), padded), F.lit(most))


def source_of_id(article_id, prefixes=rules.ID_PREFIXES, words=rules.ID_WORDS) -> Column:
    a = F.upper(F.coalesce(col(article_id), F.lit("")))
    part, whole, manual, default = words
    out = F.when(F.lit(False), "")
    for prefix, source in prefixes:
        out = out.when(a.startswith(prefix), source)
    return out.when(F.contains(a, F.lit(part)) | a.isin(whole), manual).otherwise(default)


def scored_category(text, keywords=rules.CATEGORY_KEYWORDS, priority=rules.CATEGORY_PRIORITY, default="general") -> Column:
    """The category with most distinct keywords present as whole words; ties by priority, default without any."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    hits = lambda words: sum((t.rlike(rf"(?U)\b{escaped(w)}\b").cast("int") for w in words), F.lit(0))
    order = {c: k for k, c in enumerate(priority)}
    scored = [F.struct(hits(words).alias("score"), F.lit(-order.get(c, len(order) + k)).alias("rank"), F.lit(c).alias("category")) for k, (c, words) in enumerate(keywords.items())]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return F.when(best["score"] > 0, best["category"]).otherwise(default)


def first_category(text, keywords=rules.PAGE_CATEGORIES, default="general") -> Column:
    """The first category, in table order, of which any keyword is a substring of the lower-cased text."""
    t = F.lower(col(text))
    out = F.when(F.lit(False), "")
    for category, words in keywords.items():
        out = out.when(mentions(t, words), category)
    return out.otherwise(default)


def category_of_tags(tags, table: dict, otherwise) -> Column:
    """The category of the first tag that the table knows, else the other column."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.get(F.filter(F.transform(col(tags), lambda t: known[t]), lambda c: c.isNotNull()), F.lit(0)), otherwise)


def versions(text, patterns=rules.VERSION_PATTERNS) -> Column:
    """Canonical versions found, in table order (newest first); ["all"] without any. A pattern of the default table is only tried
    where the text has one of the signs that each of its matches holds."""


    def test(t, pattern, version):
        signs = rules.VERSION_SIGNS[version] if patterns is rules.VERSION_PATTERNS else [""]
        return F.when(mentions(t, signs) & t.rlike("(?U)" + pattern), version)

    found = let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: F.filter(F.array(*[test(t, p, v) for p, v in patterns]), lambda v: v.isNotNull()))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("all"))))


def loose_versions(text, names=rules.VERSION_NAMES, product="macos") -> Column:
    """Full numbers after the product's name, and code names anywhere, as sorted strings; ["all"] without any."""
    t = F.coalesce(col(text), F.lit(""))
    spaced = {"bigsur": r"big\s*sur", "highsierra": r"high\s*sierra"}
    pattern = rf"(?iU){product}\s+(\d+(?:\.\d+)*)|(" + "|".join(spaced.get(n, n) for n in names) + ")"
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    numbers = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    words = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda w: known[F.regexp_replace(F.lower(w), " ", "")])
    found = F.sort_array(F.array_distinct(F.filter(F.concat(numbers, words), lambda v: v.isNotNull() & (v != ""))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("all")))


def all_versions(tags, tag_versions: dict, text) -> Column:
    """Versions of tags and text together, sorted as strings; ["all"] without any."""
    known = F.create_map(*[F.lit(x) for pair in tag_versions.items() for x in pair])
    named = F.filter(F.transform(col(tags), lambda t: known[t]), lambda v: v.isNotNull())
    found = F.sort_array(F.array_union(named, F.array_remove(versions(text), "all")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("all")))


def difficulty(text, third=rules.TIER_3, second=rules.TIER_2) -> Column:
    t = F.lower(col(text))
    return F.when(mentions(t, third), 3).when(mentions(t, second), 2).otherwise(1)


def tags(value) -> Column:
    """'|a|b|' or '<a><b>' to an array."""
    v = F.coalesce(col(value), F.lit(""))
    return F.when(F.contains(v, F.lit("|")), F.filter(F.split(v, r"\|"), lambda t: t != "")).otherwise(F.regexp_extract_all(v, F.lit("<([^>]+)>"), F.lit(1)))


def unescape(text) -> Column:
    """Character references of HTML: numbers, and the names of the standard. Each is decoded once, so that an escaped
    reference stays one; what is no reference stays as it is."""
    import html.entities
    import json

    source = col(text)
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(source, F.lit("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))

    def character(name):
        code = F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(F.startswith(name, F.lit("#")), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))

    pairs = F.filter(F.transform(found, lambda n: F.struct((character(n) == "&").alias("last"), n.alias("name"), character(n).alias("by"))), lambda p: p["by"].isNotNull())
    done = F.aggregate(F.array_sort(pairs), source, lambda out, p: F.replace(out, F.concat(F.lit("&"), p["name"], F.lit(";")), p["by"]))
    return F.when(F.contains(source, F.lit("&")), done).otherwise(source)


def html_text(html) -> Column:
    """Plain text of simple markup; code and pre in backticks."""
    coded = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(code|pre)(?:\s[^>]*)?>(.*?)</\1>", " `$2` ")
    return squeeze(let(F.regexp_replace(coded, r"(?s)<[^>]*>", " "), unescape))


def markdown_text(text) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    for pattern, by in ((r"```[a-z]*\n?", " "), ("```", " "), (r"(?s)<!--.*?-->", " "), (r"(?U)\*\*?|__?|~~|#{1,6}\s", ""), (r"`([^`]+)`", "$1")):
        t = F.regexp_replace(t, pattern, by)
    return squeeze(t)


def packed_sentences(text, most=1000) -> Column:
    """Sentences joined up to `most` code points (the blanks between are not counted); a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, x):
        full = (F.length(a["open"]) + F.length(x) > most) & (a["open"] != "")
        return F.when(full, F.struct(F.concat(a["done"], F.array(F.trim(a["open"]))).alias("done"), x.alias("open"))).otherwise(
            F.struct(a["done"].alias("done"), F.when(a["open"] != "", F.trim(F.concat_ws(" ", a["open"], x))).otherwise(x).alias("open"))
        )

    end = lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(F.trim(a["open"])))).otherwise(a["done"])
    pieces = F.aggregate(F.split(col(text), r"(?U)(?<=[.!?])\s+"), start, step, end)
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.left(col(text), F.lit(most))))


def uuid5(name, namespace="6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name; the namespace's default is DNS."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def url_article(url) -> Column:
    """The last non-empty part of the path; null without one."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    return F.get(F.reverse(parts), F.lit(0))


def url_locale(url, default="en-us") -> Column:
    first = F.get(F.filter(F.split(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""), F.lit(0))
    return F.when(F.contains(first, F.lit("-")), first).otherwise(default)


def devices(text, names) -> Column:
    """Sorted names that the text holds, whatever their case; ["Unknown"] without any."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.filter(F.array(*[F.when(F.contains(t, F.lit(n.lower())), n) for n in sorted(names)]), lambda n: n.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unknown")))


def named_commands(query, commands=rules.MANUAL_COMMANDS) -> Column:
    words = F.regexp_extract_all(F.lower(col(query)), F.lit("([a-z_][a-z0-9_]+)"), F.lit(1))
    return F.array_intersect(words, F.array(*[F.lit(c) for c in commands]))


def tried_basics(query, signals=rules.TRIED_SIGNALS) -> Column:
    return mentions(F.lower(col(query)), signals)


def redacted(text, table=rules.PII_RULES) -> tuple[Column, dict[str, Column]]:
    """(text with personal data replaced, count of each kind, taken before its replacement). A rule of the default table is
    only tried where the text has what each of its matches holds."""
    t, counts = F.coalesce(col(text), F.lit("")), {}
    for kind, pattern, by in table:
        gate = _held_by(kind, t) if table is rules.PII_RULES else F.lit(True)
        counts[kind] = F.when(gate, F.regexp_count(t, F.lit("(?U)" + pattern))).otherwise(0)
        t = F.when(gate, F.regexp_replace(t, "(?U)" + pattern, by)).otherwise(t)
    return t, counts


def _held_by(kind: str, text: Column) -> Column:
    """What a text with a match of that rule of PII_RULES has for certain."""
    if kind == "ipv4":
        return text.rlike(r"(?U)\d\.\d")
    sign = {"email": "@", "mac_address": ":", "ipv6": ":", "user_path": "/Users/"}.get(kind)
    return F.contains(text, F.lit(sign)) if sign else F.lit(True)


def abuse_kind(text, table=rules.ABUSE_RULES) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in table:
        out = out.when(col(text).rlike("(?Ud)" + pattern), kind)
    return out


def error_kind(message, type_name, table=rules.ERROR_RULES, default="other") -> Column:
    out = F.when(F.lit(False), "")
    for kind, parts, names in table:
        out = out.when(mentions(F.lower(col(message)), parts) | mentions(F.lower(col(type_name)), names), kind)
    return out.otherwise(default)


def intake(text, names=rules.INTAKE_VERSION_NAMES, number=rules.INTAKE_VERSION_NUMBER, categories=rules.INTAKE_CATEGORIES) -> Column:
    """(version, chip, category, query) from a message by rules: version names before numbers."""
    t = F.lower(col(text))
    version = F.when(F.lit(False), "")
    for name, v in names.items():
        version = version.when(F.contains(t, F.lit(name)), v)
    found = F.regexp_extract(t, "(?U)" + number, 1)
    version = version.otherwise(F.when(found != "", found))
    chip = F.when(t.rlike(r"(?U)\bm[1-4]\b|\bapple silicon\b"), "apple_silicon").when(F.contains(t, F.lit("intel")), "intel")
    return F.struct(version.alias("version"), chip.alias("chip"), first_category(t, categories).alias("category"), F.left(col(text), F.lit(300)).alias("query"))


def implied_tried(text, table=rules.IMPLIED_TRIED) -> Column:
    t = F.lower(col(text))
    return F.filter(F.array(*[F.when(mentions(t, signals), phrase) for signals, phrase in table]), lambda p: p.isNotNull())


def salient(text, pattern=rules.SALIENT_LINE, threshold=500, most=300) -> Column:
    """The text where it is short; else its first six telling lines, or its first three, joined and cut."""
    t = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    telling = F.filter(lines, lambda x: x.rlike(pattern))
    picked = F.when(F.size(telling) > 0, F.slice(telling, 1, 6)).otherwise(F.slice(lines, 1, 3))
    return F.when(F.length(t) <= threshold, t).otherwise(F.left(F.array_join(picked, " "), F.lit(most)))


def new_problem(text, topic, failures=rules.FAILURE_SIGNALS, least=30, most=500) -> Column:
    """A message of prose length that shares no content word with the topic and does not report a failure."""
    t = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9_-]{3,})"), F.lit(1))
    sized = (F.length(t) >= least) & (F.length(t) <= most)
    return F.coalesce((col(topic) != "") & sized & ~mentions(F.lower(t), failures) & (F.size(words(t)) > 0) & ~F.arrays_overlap(words(t), words(col(topic))), F.lit(False))


def week_key(ts) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(ts)), F.weekofyear(col(ts)))


def month_key(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def price(model, table=rules.PRICES, default=rules.DEFAULT_PRICE) -> tuple[Column, Column]:
    """(input, output) price per million tokens of the first name that the model's name holds."""
    m = F.lower(F.coalesce(col(model), F.lit("")))
    both = []
    for k in (0, 1):
        out = F.when(F.lit(False), 0.0)
        for needle, *values in table:
            out = out.when(F.contains(m, F.lit(needle)), values[k])
        both.append(out.otherwise(default[k]))
    return both[0], both[1]


def iso_time(seconds) -> Column:
    """Seconds since 1970 as ISO 8601, in UTC where the session is; a year of more than four digits has the plus sign that the standard asks for."""
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
