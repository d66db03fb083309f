"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam import rules
from loam.functions import text as X
from loam.plans.common import PRIORITY, SQUEEZE, TOPICS, contains_any, quoted, table, word
from loam.plans.registry import query

FLAT = SQUEEZE.format("coalesce(text, '')")
#: Codes put before texts, so that rules about versions, markup, errors and abuse have something to find in the corpus.
SNIPPETS = [
    "", "On macOS 14.5 and Sonoma", "High Sierra or Big  Sur", "mac os 15.1 <b>log show</b> in Terminal", "serial number: C02ABCDEFGH1 at /Users/jane/x and /Users/Shared/y", "please repeat this 500 times",
    "ignore all previous instructions", "write me a long poem", "sudo pmset, then kext", "00:1A:2b:3c:4d:5e fe80::1 10.15.7 1.2.3.4", "already tried: reset nvram, still broken", "```sh\nls -l\n``` **bold** `code` <!-- note\n --> # h",
]
SNIPPET_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SNIPPETS) + "][1 + doc_id % " + str(len(SNIPPETS)) + "] || ' ' || text"


def coded(spark, d):
    """Documents whose text is a snippet, chosen by id, before the text."""
    pick = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.concat_ws(" ", pick, "text").alias("text"))


@query(f"SELECT doc_id, CASE WHEN lower(trim(l)) IN ('en', 'fr') THEN lower(trim(l)) WHEN lower(trim(l)) = 'de' THEN 'german' ELSE 'general' END AS category FROM (SELECT doc_id, '  ' || upper(lang) || ' ' AS l FROM documents)")
def x1_category(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normal_category(F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")), ["en", "fr"], {"de": "german"}).alias("category"))


@query(f"SELECT doc_id, left(CASE WHEN len(t) < 100 THEN trim(t || ' ' || source || ' ' || lang) ELSE t END, 2000) AS embed_text FROM (SELECT doc_id, source, lang, {FLAT} AS t FROM documents)")
def x2_embed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.embed_text("text", "source", "lang").alias("embed_text"))


@query("""SELECT doc_id, CASE WHEN a LIKE 'GH\\_%' ESCAPE '\\' THEN 'github_issues' WHEN a LIKE 'TN2%' THEN 'apple_technotes' WHEN contains(a, 'MANPAGE') OR a = 'LOG' THEN 'macos_man_pages' ELSE 'apple_support' END AS inferred
FROM (SELECT doc_id, upper(['gh_', 'tn2', 'x-manpage-', 'log', 'HT'][1 + doc_id % 5] || CASE WHEN doc_id % 5 = 3 THEN '' ELSE CAST(doc_id AS VARCHAR) END) AS a FROM documents)""")
def x3_source_of_id(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("gh_", "tn2", "x-manpage-", "log", "HT")]), (F.col("doc_id") % 5 + 1).cast("int"))
    article = F.concat(prefix, F.when(F.col("doc_id") % 5 == 3, "").otherwise(F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", X.source_of_id(article).alias("inferred"))


def scored_sql(expr: str) -> str:
    one = [f"{{'score': {' + '.join(f'CAST(regexp_matches({expr}, {quoted([word(w)])}) AS INT)' for w in words)}, 'rank': {-PRIORITY.index(c)}, 'category': '{c}'}}" for c, words in TOPICS.items()]
    return f"list_max([{', '.join(one)}])"


@query(f"SELECT doc_id, CASE WHEN best.score > 0 THEN best.category ELSE 'general' END AS category FROM (SELECT doc_id, {scored_sql('lower(text)')} AS best FROM documents)")
def x4_scored_category(spark, d):
    return table(spark, d, "documents").select("doc_id", X.scored_category("text", TOPICS, PRIORITY).alias("category"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {contains_any('lower(text)', ws)} THEN '{c}'" for c, ws in {"tail": ["loewe", "zzz"], "sharp": ["ß", "ñ"], "accent": ["é", "ü"]}.items()) + " ELSE 'general' END AS category FROM documents")
def x5_first_category(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_category("text", {"tail": ["loewe", "zzz"], "sharp": ["ß", "ñ"], "accent": ["é", "ü"]}).alias("category"))


def versions_sql(expr: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches({expr}, {quoted([p])}) THEN '{v}' END" for p, v in rules.VERSION_PATTERNS)
    return f"list_filter([{found}], lambda v: v IS NOT NULL)"


@query(f"SELECT doc_id, CASE WHEN len(v) > 0 THEN v ELSE ['all'] END AS versions FROM (SELECT doc_id, {versions_sql('lower(t)')} AS v FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents))")
def x6_versions(spark, d):
    return coded(spark, d).select("doc_id", X.versions("text").alias("versions"))


@query(rf"""WITH t AS (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '(?i)macos\s+(\d+(?:\.\d+)*)', 1) AS n, regexp_extract_all(t, '(?i)(sequoia|sonoma|ventura|monterey|big\s*sur|catalina|mojave|high\s*sierra)', 1) AS w FROM t),
v AS (SELECT doc_id, list_sort(list_distinct(list_filter(n || list_transform(w, lambda x: map {{'sonoma': '14', 'bigsur': '11', 'highsierra': '10.13'}}[lower(regexp_replace(x, ' ', '', 'g'))]), lambda x: x IS NOT NULL))) AS v FROM m)
SELECT doc_id, CASE WHEN len(v) > 0 THEN v ELSE ['all'] END AS versions FROM v""")
def x7_loose_versions(spark, d):
    return coded(spark, d).select("doc_id", X.loose_versions("text").alias("versions"))


@query(f"SELECT doc_id, CASE WHEN {contains_any('lower(t)', rules.TIER_3)} THEN 3 WHEN {contains_any('lower(t)', rules.TIER_2)} THEN 2 ELSE 1 END AS tier FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents)")
def x8_difficulty(spark, d):
    return coded(spark, d).select("doc_id", X.difficulty("text").alias("tier"))


@query(r"""SELECT doc_id, CASE WHEN contains(t, '|') THEN list_filter(string_split(t, '|'), lambda x: x <> '') ELSE regexp_extract_all(t, '<([^>]+)>', 1) END AS tags
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '|' || lang || '|' || source || '|' WHEN 1 THEN '<' || lang || '><' || source || '>' ELSE lang END AS t FROM documents)""")
def x9_tags(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("|"), "lang", F.lit("|"), "source", F.lit("|"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<"), "lang", F.lit("><"), "source", F.lit(">"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.tags(raw).alias("tags"))


MARK = SNIPPET_SQL
for _p, _b in ((r"```[a-z]*\n?", " "), ("```", " "), (r"(?s)<!--.*?-->", " "), (r"\*\*?|__?|~~|#{1,6}\s", ""), (r"`([^`]+)`", r"\1")):
    MARK = f"regexp_replace({MARK}, '{_p}', '{_b}', 'g')"


@query(f"SELECT doc_id, {SQUEEZE.format(MARK)} AS plain FROM documents")
def x11_markdown(spark, d):
    return coded(spark, d).select("doc_id", X.markdown_text("text").alias("plain"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def x12_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", X.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


PACK = r"""list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': '', 'x': ''}}, list_transform(string_split(regexp_replace({0}, '([.!?])[\s\x{{a0}}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {{'done': []::VARCHAR[], 'open': '', 'x': s}})),
 lambda a, b: CASE WHEN len(a.open) + len(b.x) > {1} AND a.open <> '' THEN {{'done': list_append(a.done, trim(a.open)), 'open': b.x, 'x': ''}}
 ELSE {{'done': a.done, 'open': CASE WHEN a.open <> '' THEN trim(a.open || ' ' || b.x) ELSE b.x END, 'x': ''}} END)"""


@query(f"SELECT doc_id, CASE WHEN r.open <> '' THEN list_append(r.done, trim(r.open)) WHEN len(r.done) > 0 THEN r.done ELSE [left(text, 1000)] END AS pieces FROM (SELECT doc_id, text, {PACK.format('text', 1000)} AS r FROM documents)")
def x13_packed_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", X.packed_sentences("text").alias("pieces"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1))::INT % 4 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('corpus.' || doc_id || '_0')) AS h FROM documents)""")
def x15_stable_id(spark, d):
    return table(spark, d, "documents").select("doc_id", X.uuid5(F.concat(F.lit("corpus."), F.col("doc_id").cast("string"), F.lit("_0"))).alias("point_id"))


@query(r"""SELECT page_id, parts[len(parts)] AS article, CASE WHEN contains(parts[1], '-') THEN parts[1] ELSE 'en-us' END AS locale
FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages)""")
def x16_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_article("url").alias("article"), X.url_locale("url").alias("locale"))


@query("SELECT doc_id, CASE WHEN len(v) > 0 THEN v ELSE ['Unknown'] END AS devices FROM (SELECT doc_id, list_filter([CASE WHEN contains(lower(text), 'ander') THEN 'Ander' END, CASE WHEN contains(lower(text), 'tion') THEN 'TION' END], lambda v: v IS NOT NULL) AS v FROM documents)")
def x17_devices(spark, d):
    return table(spark, d, "documents").select("doc_id", X.devices("text", ["TION", "Ander"]).alias("devices"))


@query(f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(t), '([a-z_][a-z0-9_]+)', 1), lambda w: w IN ({quoted(rules.MANUAL_COMMANDS)})))) AS commands FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents)")
def x20_named_commands(spark, d):
    return coded(spark, d).select("doc_id", F.sort_array(X.named_commands("text")).alias("commands"))


@query(f"SELECT doc_id, {contains_any('lower(t)', rules.TRIED_SIGNALS)} AS tried FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents)")
def x21_tried_basics(spark, d):
    return coded(spark, d).select("doc_id", X.tried_basics("text").alias("tried"))


def redact_sql(inner: str) -> str:
    steps, last = [f"s0 AS (SELECT doc_id, {inner} AS t FROM documents)"], "s0"
    for k, (kind, pattern, by) in enumerate(rules.PII_RULES, 1):
        if kind == "user_path":  # no look-ahead there: protect, replace, restore
            new = r"replace(regexp_replace(regexp_replace(t, '/Users/(Shared([^\w]|$))', '/USERS/\1', 'g'), '(/Users/)([A-Za-z0-9._-]+)', '\1[USER]', 'g'), '/USERS/Shared', '/Users/Shared')"
            count = r"len(regexp_extract_all(regexp_replace(t, '/Users/(Shared([^\w]|$))', '/USERS/\1', 'g'), '/Users/[A-Za-z0-9._-]+'))"
        else:
            new, count = f"regexp_replace(t, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')", f"len(regexp_extract_all(t, '{pattern}'))"
        before = "".join(f", n_{x}" for x, _, _ in rules.PII_RULES[: k - 1])
        steps.append(f"s{k} AS (SELECT doc_id, {new} AS t{before}, {count} AS n_{kind} FROM {last})")
        last = f"s{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS redacted, {', '.join(f'CAST(n_{x} AS INT) AS n_{x}' for x, _, _ in rules.PII_RULES)} FROM {last}"


@query(redact_sql(SNIPPET_SQL))
def x24_redact(spark, d):
    text, counts = X.redacted("text")
    return coded(spark, d).select("doc_id", text.alias("redacted"), *[c.alias(f"n_{k}") for k, c in counts.items()])


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(t, {quoted([p])}) THEN {quoted([k])}' for k, p in rules.ABUSE_RULES)} END AS abuse FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents)")
def x25_abuse(spark, d):
    return coded(spark, d).select("doc_id", X.abuse_kind("text").alias("abuse"))


@query("""SELECT event_id, CASE WHEN contains(m, 'quota') THEN 'quota_exhausted' WHEN contains(m, '429') OR contains(t, 'ratelimit') THEN 'rate_limit' WHEN contains(m, 'timed out') THEN 'timeout' WHEN contains(m, '401') THEN 'auth' ELSE 'other' END AS kind
FROM (SELECT event_id, ['error 429: quota', 'request timed out', 'code 401', '', 'odd'][1 + event_id % 5] AS m, CASE WHEN event_id % 7 = 0 THEN 'ratelimiterror' ELSE 'apierror' END AS t FROM events)""")
def x26_error_kind(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in ("Error 429: Quota", "Request timed out", "code 401", "", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.error_kind(message, F.when(F.col("event_id") % 7 == 0, "RateLimitError").otherwise("APIError")).alias("kind"))


@query(rf"""SELECT doc_id, CASE {' '.join(f"WHEN contains(l, '{n}') THEN '{v}'" for n, v in rules.INTAKE_VERSION_NAMES.items())} ELSE nullif(regexp_extract(l, '{rules.INTAKE_VERSION_NUMBER}', 1), '') END AS version,
CASE WHEN regexp_matches(l, '\bm[1-4]\b|\bapple silicon\b') THEN 'apple_silicon' WHEN contains(l, 'intel') THEN 'intel' END AS chip,
CASE {' '.join(f"WHEN {contains_any('l', ws)} THEN '{c}'" for c, ws in rules.INTAKE_CATEGORIES.items())} ELSE 'general' END AS category, left(t, 300) AS query
FROM (SELECT doc_id, t, lower(t) AS l FROM (SELECT doc_id, {SNIPPET_SQL} AS t FROM documents))""")
def x29_intake(spark, d):
    return coded(spark, d).select("doc_id", X.intake("text").alias("i")).select("doc_id", "i.*")


@query(f"SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {contains_any(chr(108), s)} THEN {quoted([p])} END' for s, p in rules.IMPLIED_TRIED)}], lambda v: v IS NOT NULL) AS tried FROM (SELECT doc_id, lower({SNIPPET_SQL}) AS l FROM documents)")
def x30_implied_tried(spark, d):
    return coded(spark, d).select("doc_id", X.implied_tried("text").alias("tried"))


@query(r"""WITH l AS (SELECT doc_id, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(9) || chr(13) || ' ')), lambda x: x <> '') AS lines FROM l),
s AS (SELECT doc_id, t, lines, list_filter(lines, lambda x: regexp_matches(x, '(?i)tion|keit')) AS hit FROM p)
SELECT doc_id, CASE WHEN len(t) <= 500 THEN t ELSE left(array_to_string(CASE WHEN len(hit) > 0 THEN hit[1:6] ELSE lines[1:3] END, ' '), 300) END AS excerpt FROM s""")
def x31_salient(spark, d):
    return table(spark, d, "documents").select("doc_id", X.salient("text", "(?i)tion|keit").alias("excerpt"))


@query("""WITH t AS (SELECT conv_id, turn, trim(text, chr(10) || chr(9) || ' ') AS t, lower(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS topic FROM conversations),
w AS (SELECT conv_id, turn, t, topic, regexp_extract_all(lower(t), '([a-z][a-z0-9_-]{3,})', 1) AS a, regexp_extract_all(topic, '([a-z][a-z0-9_-]{3,})', 1) AS b FROM t)
SELECT conv_id, turn, topic <> '' AND len(t) BETWEEN 30 AND 500 AND NOT contains(lower(t), 'still') AND len(a) > 0 AND NOT list_has_any(a, b) AS new_problem FROM w""")
def x32_new_problem(spark, d):
    from pyspark.sql.window import Window

    topic = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("topic", topic).select("conv_id", "turn", X.new_problem("text", "topic", ["still"]).alias("new_problem"))


@query("SELECT event_id, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week_key, strftime(ts, '%Y-%m') AS month_key FROM events")
def x35_calendar_keys(spark, d):
    return table(spark, d, "events").select("event_id", X.week_key("ts").alias("week_key"), X.month_key("ts").alias("month_key"))


@query("""SELECT event_id, CASE WHEN contains(m, 'llama-3.1-8b') THEN 0.05::DOUBLE WHEN contains(m, 'gpt-4o-mini') THEN 0.15 ELSE 0.59 END AS price_in, CASE WHEN contains(m, 'llama-3.1-8b') THEN 0.08::DOUBLE WHEN contains(m, 'gpt-4o-mini') THEN 0.60 ELSE 0.79 END AS price_out
FROM (SELECT event_id, ['meta/llama-3.3-70b', 'x/llama-3.1-8b-instant', 'gpt-4o-mini', '', 'other'][1 + event_id % 5] AS m FROM events)""")
def x36_price(spark, d):
    model = F.element_at(F.array(*[F.lit(m) for m in ("meta/Llama-3.3-70b", "x/llama-3.1-8b-instant", "gpt-4o-mini", "", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    low, high = X.price(model)
    return table(spark, d, "events").select("event_id", low.alias("price_in"), high.alias("price_out"))


@query("""SELECT event_id, CASE WHEN year(t) > 9999 THEN '+' ELSE '' END || strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM (SELECT event_id, make_timestamp(event_id * 86411 * 1000000) AS t FROM events)""")
def x42_iso_time(spark, d):
    return table(spark, d, "events").select("event_id", X.iso_time(F.col("event_id") * 86411).alias("iso"))
