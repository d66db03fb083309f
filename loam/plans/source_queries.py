"""Queries on source records and the articles that they make, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.functions import text as X
from loam.functions.rows import once
from loam.operators import articles as A
from loam.plans.common import contains_any, quoted, table
from loam.plans.registry import query
from loam.sources import pages as P
from loam.sources import readers
from loam.sources.storage import shared_dir

WORDS, LABELS, PHRASES = ["and", "der"], ["s1", "s2"], ["the", "ist"]
#: One line of plain words: markup and odd white space have tests of their own.
PLAIN = "regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.]+', ' ', 'g'), '^ | $', '', 'g')"


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def plain(df):
    return once(df, text=F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.]+", " ")))


def docs(spark, d):
    return plain(table(spark, d, "documents"))


def posts(spark, d):
    return docs(spark, d).select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("post_id"), F.lit("mac").alias("group"), F.left("text", F.lit(40)).alias("title"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise(" ").alias("body"), F.lit("/r/x").alias("permalink"),
        (F.col("doc_id") * 60).alias("created"), (F.col("doc_id") % 12).alias("score"), (F.col("doc_id") % 7).alias("comments"), (F.col("doc_id") % 5 != 0).alias("is_self"), (F.col("doc_id") % 11 == 0).alias("stickied"), F.when(F.col("doc_id") % 13 == 0, True).alias("over_18"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 17 == 0, F.lit("Weekly News")).alias("flair"),
    )


WORTH = "doc_id % 5 <> 0 AND doc_id % 9 <> 0 AND t <> '' AND doc_id % 12 >= 5 AND doc_id % 7 >= 3 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND (doc_id % 4 = 0 OR doc_id % 17 <> 0)"
T = f"WITH x AS (SELECT *, {PLAIN} AS t FROM documents)"


@query(f"{T} SELECT 'p' || doc_id AS post_id FROM x WHERE {WORTH}")
def f3_posts(spark, d):
    return A.posts_worth(posts(spark, d)).select("post_id")


@query(f"""{T} SELECT 'REDDIT_P' || doc_id AS article_id, trim(left(t, 40)) AS title, left(trim(left(t, 40)) || '. ' || t, 300) AS summary, strftime(make_timestamp(doc_id * 60000000), '%Y-%m-%dT%H:%M:%SZ') AS last_modified, len(trim(left(t, 40)) || '. ' || t) AS n_body
FROM x WHERE {WORTH} AND len(t) > 80 AND len(trim(left(t, 40)) || '. ' || t) >= 100""")
def c4_post_articles(spark, d):
    out = A.post_articles(posts(spark, d).where(F.length("body") > 80), now(), category=lambda t: F.lit("general"))
    return out.where(F.length(out["sections"][0]["body"]) >= 100).select("article_id", "title", "summary", "last_modified", F.length(F.col("sections")[0]["body"]).cast("long").alias("n_body"))


def issues(spark, d):
    rows = docs(spark, d).where("doc_id % 3 = 0")
    return rows.select(F.lit("own").alias("owner"), F.col("source").alias("repo"), F.col("doc_id").alias("number"), F.left("text", F.lit(30)).alias("title"), F.col("text").alias("body"), F.array("lang", F.upper("source")).alias("labels"), (F.col("doc_id") % 8).alias("comments"), F.lit("u").alias("url"))


def comments(spark, d):
    """Each document is a comment on one of the five issues after it."""
    rows = docs(spark, d)
    on = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("repo"), F.col("doc_id").alias("number"))
    near = rows.select(F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + 5)).alias("number"), F.col("doc_id").alias("pos"), F.col("text").alias("body"), (F.col("doc_id") % 6).alias("reactions"))
    return near.join(on, "number").select(F.lit("own").alias("owner"), "repo", "number", "pos", "body", "reactions")


RELEVANT = f"({contains_any('''lower(left(t, 30) || ' ' || left(t, 500))''', WORDS)} OR lower(lang) IN ({quoted(LABELS)}) OR lower(source) IN ({quoted(LABELS)}))"


@query(f"{T} SELECT doc_id, {RELEVANT} AS relevant FROM x")
def f5_issue_relevant(spark, d):
    rows = docs(spark, d).withColumn("title", F.left("text", F.lit(30))).withColumn("labels", F.array("lang", F.upper("source")))
    return rows.select("doc_id", A.issue_relevant("title", "text", "labels", WORDS, LABELS).alias("relevant"))


PICKED = f"""c AS (SELECT i.doc_id AS number, c.doc_id AS pos, c.t AS body, c.doc_id % 6 AS n, {contains_any('lower(c.t)', PHRASES)} AS said FROM x i JOIN x c ON i.doc_id BETWEEN c.doc_id AND c.doc_id + 5 WHERE i.doc_id % 3 = 0 AND len(c.t) >= 100),
s AS (SELECT number, CASE WHEN max(n) >= 3 THEN arg_max(body, row(n, -pos)) ELSE coalesce(arg_min(body, pos) FILTER (said), arg_max(body, pos)) END AS solution FROM c GROUP BY 1)"""


@query(f"{T}, {PICKED} SELECT number, solution FROM s")
def w6_solutions(spark, d):
    return A.solutions(comments(spark, d).withColumn("issue", F.col("number")), phrases=PHRASES).select(F.col("issue").alias("number"), "solution")


@query(f"""{T}, {PICKED} SELECT 'GH_OWN_' || upper(source) || '_' || doc_id AS article_id, left(t, 30) AS title, left(t, 300) AS summary, left(t, 1000) AS problem, left(solution, 1000) AS solution
FROM x JOIN s ON number = doc_id WHERE {RELEVANT} AND doc_id % 8 >= 3 AND len(t) >= 200""")
def c3_issue_articles(spark, d):
    out = A.issue_articles(issues(spark, d), comments(spark, d), now(), WORDS, LABELS, category=lambda t: F.lit("general"), phrases=PHRASES)
    return out.select("article_id", "title", "summary", F.col("sections")[0]["body"].alias("problem"), F.col("sections")[1]["body"].alias("solution"))


def sessions(spark, d):
    return docs(spark, d).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), (2017 + F.col("doc_id") % 9).cast("int").alias("year"), F.left("text", F.lit(30)).alias("title"), F.left("text", F.lit(200)).alias("description"), "text", F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(200))).otherwise(F.col("text")).alias("content"), F.lit("u").alias("url"))


@query(f"{T} SELECT doc_id, {contains_any('''lower(left(t, 30) || ' ' || left(t, 200))''', WORDS)} AS relevant FROM x")
def f6_session_relevant(spark, d):
    return docs(spark, d).select("doc_id", A.session_relevant(F.left("text", F.lit(30)), F.left("text", F.lit(200)), WORDS).alias("relevant"))


@query(f"""{T} SELECT 'WWDC_' || (2017 + doc_id % 9) || '_S' || doc_id AS article_id, 'WWDC' || (2017 + doc_id % 9) || ': ' || left(t, 30) AS title, coalesce(['10.15', '11', '12', '13', '14', '15'][CASE WHEN doc_id % 9 BETWEEN 2 AND 7 THEN doc_id % 9 - 1 ELSE 99 END], 'all') AS version,
left(CASE WHEN doc_id % 3 = 0 THEN left(t, 200) ELSE t END, 1500) AS content FROM x WHERE {contains_any('''lower(left(t, 30) || ' ' || left(t, 200))''', WORDS)} AND len(t) > 120""")
def c6_session_articles(spark, d):
    out = A.session_articles(sessions(spark, d).where(F.length("text") > 120), now(), WORDS, category=lambda t: F.lit("general"))
    return out.select("article_id", "title", F.col("macos_versions")[0].alias("version"), F.col("sections")[1]["body"].alias("content"))


def thread_posts(spark, d):
    """The turns of a conversation as a thread; assistants' replies may be accepted."""
    rows = plain(table(spark, d, "conversations"))
    c, t = F.col("conv_id"), F.col("turn")
    return rows.select(F.concat(F.lit("https://x.org/thread/"), (c + 1000).cast("string")).alias("url"), F.left("text", F.lit(30)).alias("title"), F.array("role").alias("tags"), t.alias("pos"), "text", ((F.col("role") == "assistant") & ((c + t) % 3 != 0)).alias("is_accepted"))


THREADS = f"""WITH x AS (SELECT conv_id, turn, role, {PLAIN} AS t FROM conversations),
h AS (SELECT conv_id, arg_min(left(t, 30), turn) AS title, arg_min(t, turn) AS post, arg_min(t, turn) FILTER (role = 'assistant' AND (conv_id + turn) % 3 <> 0) AS accepted, count(*) - 1 AS replies FROM x GROUP BY 1)"""


@query(f"{THREADS} SELECT 'https://x.org/thread/' || (conv_id + 1000) AS url, title, post, accepted, replies FROM h")
def s10_threads(spark, d):
    return A.threads_of(thread_posts(spark, d)).drop("tags")


@query(f"{THREADS} SELECT 'https://x.org/thread/' || (conv_id + 1000) AS url FROM h WHERE coalesce(accepted, '') <> '' AND replies >= 2 AND (title <> '' OR post <> '')")
def f7_threads_worth(spark, d):
    return A.threads_worth(A.threads_of(thread_posts(spark, d))).select("url")


@query(f"{THREADS} SELECT 'DEVFORUM_' || (conv_id + 1000) AS article_id, title, left(post, 300) AS summary, accepted AS solution FROM h WHERE coalesce(accepted, '') <> '' AND replies >= 2 AND (title <> '' OR post <> '') AND len(post || accepted) >= 100")
def c7_thread_articles(spark, d):
    threads = A.threads_of(thread_posts(spark, d)).where(F.length(F.concat("post", "accepted")) >= 100)
    return A.thread_articles(threads, now(), category=lambda t: F.lit("general")).select("article_id", "title", "summary", F.col("sections")[1]["body"].alias("solution"))


def manuals(spark, d):
    """Documents as manual pages: name, synopsis with flags, description, examples."""
    rows = docs(spark, d).where(F.length("text") >= 300)
    c = F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string"))
    raw = F.concat(
        F.lit("C(1)\nNAME\n     "), c, F.lit(" - "), F.left("text", F.lit(20)), F.lit("\nSYNOPSIS\n     "), c, F.lit(" -b"), (F.col("doc_id") % 3).cast("string"), F.lit(" --all -x file\n\nDESCRIPTION\n     "), F.substring("text", 21, 200),
        F.lit("\nEXAMPLES\n     $ "), c, F.lit(" -x one\n     # a remark\n     two"), (F.col("doc_id") % 3).cast("string"), F.lit(" words\nEMPTY ONE\nSEE ALSO\n     log"),
    )
    return rows.select("doc_id", c.alias("command"), F.col("doc_id").cast("string").alias("section"), raw.alias("raw_text"))


M = f"{T}, m AS (SELECT doc_id, 'c' || doc_id % 20 AS c, t FROM x WHERE len(t) >= 300)"


@query(f"""{M} SELECT doc_id, u.h AS heading, u.b AS body FROM (SELECT doc_id, unnest([{{'h': 'PREAMBLE', 'b': 'C(1)'}}, {{'h': 'NAME', 'b': trim(c || ' - ' || left(t, 20))}}, {{'h': 'SYNOPSIS', 'b': c || ' -b' || doc_id % 3 || ' --all -x file'}}, {{'h': 'DESCRIPTION', 'b': trim(substr(t, 21, 200))}},
{{'h': 'EXAMPLES', 'b': '$ ' || c || ' -x one' || chr(10) || '     # a remark' || chr(10) || '     two' || doc_id % 3 || ' words'}}, {{'h': 'SEE ALSO', 'b': 'log'}}]) AS u FROM m)""")
def s9_manual_sections(spark, d):
    return once(manuals(spark, d), s=A.manual_sections("raw_text")).select("doc_id", F.inline("s"))


@query(f"{M} SELECT doc_id, '--all|-b' || doc_id % 3 || '|-x' AS flags, c || ' -x one|two' || doc_id % 3 || ' words' AS examples FROM m")
def x18_flags(spark, d):
    parts = once(manuals(spark, d), s=A.manual_sections("raw_text"))
    return parts.select("doc_id", F.array_join(A.manual_flags(A.section_body("s", "SYNOPSIS")), "|").alias("flags"), F.array_join(A.manual_examples(A.section_body("s", "EXAMPLES")), "|").alias("examples"))


WANTED = [f"c{k}" for k in range(0, 20, 3)]


@query(f"{M} SELECT doc_id FROM m WHERE c IN ({quoted(WANTED)})")
def f8_manuals(spark, d):
    return A.manuals_worth(manuals(spark, d), WANTED).select("doc_id")


@query(f"{M} SELECT 'MANPAGE_C' || doc_id % 20 || '_' || doc_id AS article_id, c || '(' || doc_id || ') — ' || trim(left(t, 20)) AS title, trim(left(t, 20)) AS summary, 4 AS n_sections, 2 AS n_steps FROM m WHERE c IN ({quoted(WANTED)})")
def c5_manual_articles(spark, d):
    return A.manual_articles(manuals(spark, d), now(), WANTED).select("article_id", "title", "summary", F.size("sections").alias("n_sections"), F.size("steps").alias("n_steps"))


def urls(spark, d):
    """Addresses of articles in three locales, in the order of the pages."""
    i = F.col("page_id")
    place = F.element_at(F.array(F.lit("/de-de/"), F.lit("/en-us/"), F.lit("/")), (1 + i % 3).cast("int"))
    return table(spark, d, "pages").select(i.alias("pos"), F.concat(F.lit("https://s.org"), place, F.when(i % 7 == 0, F.lit("guide/")).otherwise(""), (100_000 + i % 40).cast("string"), F.when(i % 5 == 0, "?x=1").otherwise("")).alias("url"))


U = "WITH u AS (SELECT page_id AS pos, 'https://s.org' || ['/de-de/', '/en-us/', '/'][1 + page_id % 3] || CASE WHEN page_id % 7 = 0 THEN 'guide/' ELSE '' END || (100000 + page_id % 40) || CASE WHEN page_id % 5 = 0 THEN '?x=1' ELSE '' END AS url FROM pages)"


@query(f"{U} SELECT CAST(100000 + pos % 40 AS VARCHAR) AS article_id, min(pos) AS pos, coalesce(arg_max(url, pos) FILTER (pos % 3 = 1), arg_min(url, pos)) AS url FROM u GROUP BY 1")
def w5_preferred_urls(spark, d):
    return A.preferred_urls(urls(spark, d))


@query(f"{U} SELECT pos, pos % 7 <> 0 AS crawl FROM u")
def f11_crawlable(spark, d):
    return urls(spark, d).select("pos", A.crawlable("url").alias("crawl"))


@query(f"{U}, b AS (SELECT 0 AS list, pos, url FROM u WHERE pos % 2 = 0 UNION ALL SELECT 1, pos, replace(url, '?x=1', '') FROM u) SELECT min(row(list, pos))[1] AS list, min(row(list, pos))[2] AS pos, url FROM b GROUP BY url")
def u1_url_union(spark, d):
    u = urls(spark, d)
    return A.ordered_union(u.where("pos % 2 = 0"), u.withColumn("url", F.replace("url", F.lit("?x=1"), F.lit(""))))


@query(f"{U}, b AS (SELECT 0 AS list, min(pos) AS pos, url FROM u GROUP BY url) SELECT * FROM b ORDER BY list, pos LIMIT 20")
def t4_limited(spark, d):
    return A.limited(A.ordered_union(urls(spark, d)), 20)


@query("SELECT 'c' || doc_id % 50 AS command, min(row(doc_id % 4, source || doc_id))[1]::INT AS directory, min(row(doc_id % 4, source || doc_id))[2] AS path FROM documents GROUP BY 1")
def w9_first_directory(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("command"), (F.col("doc_id") % 4).cast("int").alias("directory"), F.concat("source", F.col("doc_id").cast("string")).alias("path"))
    return A.first_directory(files)


@query("""WITH h AS (SELECT conv_id, turn, role = 'user' AS head, trim(text) AS t, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS n, text FROM conversations)
SELECT conv_id, n, coalesce(max(text) FILTER (head), 'Overview') AS heading, string_agg(text, ' ' ORDER BY turn) FILTER (NOT head AND t <> '') AS body FROM h GROUP BY 1, 2 HAVING count(*) FILTER (NOT head AND t <> '') > 0""")
def w15_sections(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("role") == "user").alias("is_heading"), "text")
    return A.sections_by_heading(rows, "conv_id")


@query(f"""{T}, p AS (SELECT q.doc_id AS id, left(q.t, 30) AS title, q.t AS ask, a.t AS told FROM x q JOIN x a ON a.doc_id = q.doc_id + 1 WHERE q.doc_id % 2 = 0)
SELECT 'ASK_' || id AS article_id, title || ' & more' AS title, left(ask, 300) AS summary, told AS answer FROM p WHERE len(title || ask || told) >= 120 AND len(told) >= 90""")
def c1_pair_articles(spark, d):
    q = docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("question_id"), F.left("text", F.lit(30)).alias("t"), F.col("text").alias("q"))
    a = docs(spark, d).select((F.col("doc_id") - 1).alias("question_id"), F.col("text").alias("a"))
    pairs = q.join(a, "question_id").where((F.length(F.concat("t", "q", "a")) >= 120) & (F.length("a") >= 90))
    pairs = pairs.select("question_id", F.concat("t", F.lit(" &amp; more")).alias("title"), F.array(F.lit("macos")).alias("tags"), F.concat(F.lit("<p>"), "q", F.lit("</p>")).alias("question"), F.concat(F.lit("<div>"), "a", F.lit("</div>")).alias("answer"))
    return A.pair_articles(pairs, now(), category=lambda t: F.lit("general")).select("article_id", "title", "summary", F.col("sections")[1]["body"].alias("answer"))


@query("""SELECT page_id, trim(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)[1]) AS title FROM pages WHERE regexp_matches(html, '<h1>[^<&]*</h1>')""")
def s4_support_titles(spark, d):
    simple = table(spark, d, "pages").where("regexp_like(html, '<h1>[^<&]*</h1>')")
    return P.support_fields(simple).select("page_id", "title")


@query()
def s4_support_pages(spark, d):
    fields = P.support_fields(table(spark, d, "pages"))
    return fields.select("page_id", "title", "summary", F.size("sections").cast("long").alias("n_sections"), F.size("steps").cast("long").alias("n_steps"))


@query()
def s5_notes(spark, d):
    return P.note_fields(table(spark, d, "pages")).select("page_id", "title", F.length(F.col("sections")[0]["body"]).alias("n_body"))


@query()
def s17_sessions(spark, d):
    return P.session_fields(table(spark, d, "pages")).select("page_id", "title", F.length("content").alias("n_content"))


@query()
def c2_page_articles(spark, d):
    pages = table(spark, d, "pages").withColumn("url", F.concat(F.lit("https://s.org/en-us/"), (100_000 + F.col("page_id")).cast("string")))
    return P.page_articles(pages, now(), ["iMac", "MacBook"]).select("article_id", "title", "summary", F.size("sections").alias("n_sections"))


@query("SELECT page_id, y AS year, CAST(page_id % 900 + k AS VARCHAR) AS id FROM pages, (SELECT unnest([{'y': '2023', 'k': 1}, {'y': '2024', 'k': 2}]) AS u), LATERAL (SELECT u.y AS y, u.k AS k)")
def s16_link_pairs(spark, d):
    i = F.col("page_id") % 900
    html = F.concat(F.lit('<a href="/play/wwdc2023/'), (i + 1).cast("string"), F.lit('/">a</a><a href="/play/wwdc2024/'), (i + 2).cast("string"), F.lit('">b</a><a href="/play/wwdc2023/'), (i + 1).cast("string"), F.lit('"></a>'))
    return table(spark, d, "pages").select("page_id", F.inline(P.link_pairs(html)))


def content(spark, d):
    """Documents as documentation files: an opening paragraph, a heading, a list and code."""
    node = lambda kind, **x: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in x.items()])
    piece = lambda a, n: F.trim(F.substring("text", a, n))
    inline = F.array(node("text", text=piece(1, 30)))
    item = F.struct(F.array(F.struct(F.array(node("text", text=piece(61, 30))).alias("inlineContent"))).alias("content"))
    nodes = [F.to_json(node("paragraph", inlineContent=inline)), F.to_json(node("heading", text=piece(31, 30))), F.to_json(node("unorderedList", items=F.array(item))), F.to_json(node("codeListing", code=F.array(F.lit("a"), F.lit("b"))))]
    whole = F.concat(F.lit('{"metadata":{"title":"t'), F.col("doc_id").cast("string"), F.lit('"},"primaryContentSections":[{"kind":"content","content":['), F.concat_ws(",", *nodes), F.lit("]}]}"))
    return docs(spark, d).where(F.length("text") >= 100).select(F.col("doc_id").cast("string").alias("name"), whole.alias("json"))


@query(f"""{T}, m AS (SELECT doc_id, t FROM x WHERE len(t) >= 100) SELECT CAST(doc_id AS VARCHAR) AS name, 't' || doc_id AS title, 'Overview' AS heading, trim(substr(t, 1, 30)) AS body FROM m WHERE trim(substr(t, 1, 30)) <> ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), 't' || doc_id, trim(substr(t, 31, 30)), trim(trim(substr(t, 61, 30)) || ' a b') FROM m""")
def s6_doc_sections(spark, d):
    return P.doc_sections(content(spark, d)).select("name", "title", F.inline("sections"))


@query(f"{T} SELECT 'topic' || (doc_id % 3) AS topic, 0 AS pos, left(t, 10) AS title, '/documentation/x/' || doc_id AS url FROM x WHERE doc_id % 5 <> 0")
def s8_index_links(spark, d):
    name = F.col("doc_id").cast("string")
    place = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/other/"), name)).otherwise(F.concat(F.lit("/documentation/x/"), name))
    refs = F.create_map(F.concat(F.lit("doc://"), name), F.struct(F.left("text", F.lit(10)).alias("title"), place.alias("url")))
    topics = F.array(F.struct(F.concat(F.lit("topic"), (F.col("doc_id") % 3).cast("string")).alias("title"), F.array(F.concat(F.lit("doc://"), name), F.lit("doc://none")).alias("identifiers")))
    return P.index_links(docs(spark, d).select(F.to_json(F.struct(topics.alias("topicSections"), refs.alias("references"))).alias("json")), "/documentation/x/")


@query(f"{T} SELECT doc_id AS number, left(t, 20) AS title, doc_id % 9 AS comments FROM x WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0")
def s11_closed_issues(spark, d):
    record = F.struct(F.col("doc_id").alias("number"), F.left("text", F.lit(20)).alias("title"), F.when(F.col("doc_id") % 4 == 0, "open").otherwise("closed").alias("state"), (F.col("doc_id") % 9).alias("comments"), F.when(F.col("doc_id") % 7 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"))
    return P.closed_issues(docs(spark, d).select(F.to_json(record).alias("json"))).select("number", "title", "comments")


@query("SELECT doc_id AS number, doc_id % 5 + doc_id % 3 AS reactions FROM documents")
def j12_comments(spark, d):
    record = F.to_json(F.struct(F.lit("b").alias("body"), F.create_map(F.lit("+1"), F.col("doc_id") % 5, F.lit("heart"), F.col("doc_id") % 3, F.lit("confused"), F.lit(9).cast("long")).alias("reactions")))
    return P.issue_comments(table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.lit(1).alias("pos"), record.alias("json"))).select("number", F.col("reactions").cast("long").alias("reactions"))


@query(f"{T} SELECT 'p' || doc_id AS post_id, left(t, 20) AS title, doc_id % 50 AS score FROM x")
def s12_listed_posts(spark, d):
    child = F.struct(F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), F.left("text", F.lit(20)).alias("title"), (F.col("doc_id") % 50).alias("score")).alias("data"))
    pages = docs(spark, d).groupBy((F.col("doc_id") % 40).alias("k")).agg(F.collect_list(child).alias("children"))
    return P.listed_posts(pages.select(F.to_json(F.struct(F.struct("children").alias("data"))).alias("json"))).select("post_id", "title", "score")


@query(f"{T} SELECT q.doc_id AS question_id, q.t AS title, a.t AS answer FROM x q JOIN x a ON a.doc_id = q.doc_id + 1 WHERE q.doc_id % 6 >= 2 AND q.doc_id % 4 <> 0 AND a.doc_id % 3 >= 1")
def s13_api_pairs(spark, d):
    q = F.struct(F.col("doc_id").alias("question_id"), F.col("text").alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") + 1).alias("accepted_answer_id"), (F.col("doc_id") % 6).alias("score"))
    a = F.struct(F.col("doc_id").alias("answer_id"), F.col("text").alias("body"), (F.col("doc_id") % 3).alias("score"))
    rows = docs(spark, d)
    return P.api_pairs(rows.select(F.to_json(q).alias("json")), rows.select(F.to_json(a).alias("json"))).select("question_id", "title", "answer")


@query("""SELECT max(doc_id) AS question_id, left(arg_max(text, doc_id), 20) AS title, CAST(-1 - doc_id // 3 AS VARCHAR) AS answer FROM documents WHERE doc_id >= 0 GROUP BY doc_id // 3""")
def j1_shared_answers(spark, d):
    """Three questions accept one answer: the last of them, by id, gets it."""
    i = F.col("doc_id")
    shape = lambda rows, kind, own, accepted, body: rows.select(own.alias("_Id"), F.lit(kind).alias("_PostTypeId"), accepted.cast("long").alias("_AcceptedAnswerId"), F.lit("9").alias("_Score"), F.lit("|macos|").alias("_Tags"), F.left("text", F.lit(20)).alias("_Title"), body.alias("_Body"))
    rows = table(spark, d, "documents").where("doc_id >= 0")
    answer = -1 - F.floor(i / 3)
    posts = shape(rows, 1, i, answer, F.lit("q")).unionByName(shape(rows.where("doc_id % 3 = 0"), 2, answer, F.lit(None), answer.cast("string")))
    return readers.accepted_pairs(posts).select("question_id", F.left(F.coalesce("title", F.lit("")), F.lit(20)).alias("title"), "answer")


LINES = "SELECT 'c' || doc_id AS chunk_id, text FROM documents"


#: Characters of the documents in a file of lines, and the least number of files.
FILE_CHARS, FILES = 64_000_000, 5


def chunk_files(spark, d):
    """documents as files of JSON lines, as many as their size asks for; every seventh line is cut off. The files' names and the
    lines in them are in the order of ids."""
    base = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i, F.to_json(F.struct(F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), "text")).alias("line"))
    rows = rows.select(F.when(i % 7 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line")).alias("value"), i.alias("at"))
    size = table(spark, d, "documents").agg(F.sum(F.coalesce("n_chars", F.lit(0)).cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(FILES, -(-size // FILE_CHARS)), "at").sortWithinPartitions("at")
    dealt.select("value").write.text(f"{base}/lines")
    return f"{base}/lines"


@query(f"{LINES} WHERE doc_id % 7 <> 0")
def s1_chunk_lines(spark, d):
    return readers.chunk_lines(spark, chunk_files(spark, d)).select("chunk_id", "text")


@query("SELECT count(*) AS lines FROM documents WHERE doc_id % 7 = 0")
def s1_quarantine(spark, d):
    return readers.scanned(spark, chunk_files(spark, d))[1].agg(F.count("line").alias("lines"))


@query(f"{LINES} WHERE doc_id % 7 <> 0 ORDER BY doc_id LIMIT 40")
def s1_first_lines(spark, d):
    """The first records in the order of files and lines; files are named in the order of ids here."""
    return readers.scanned(spark, chunk_files(spark, d), 40)[0].select("chunk_id", "text")


@query("SELECT doc_id, source, left(text, 50) AS summary FROM documents")
def s2_article_files(spark, d):
    """documents as JSON lines of articles, in folders by source, read back at any depth."""
    base = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}"
    i = F.col("doc_id")
    table(spark, d, "documents").select(i.cast("string").alias("article_id"), "source", F.left("text", F.lit(50)).alias("summary"), F.coalesce("source", F.lit("none")).alias("folder")).write.partitionBy("folder").json(base)
    rows = readers.article_files(spark, base, one_each=False)
    return rows.select(F.col("article_id").cast("long").alias("doc_id"), "source", "summary")


@query("""WITH p AS (SELECT url, page_id, page_id // 400 AS j, (page_id // 20) % 20 AS k, page_id % 20 AS pos FROM pages)
SELECT url, 3 AS depth, arg_min(j || ',' || (k + 1) || ',' || pos, page_id) AS trail FROM p GROUP BY url""")
def s14_sitemap_pages(spark, d):
    """A robots file names indexes, these sitemaps of twenty pages each; every index also names the first one again."""
    i = F.col("page_id")
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    joined = lambda rows, key, at, line, head: rows.groupBy(key.alias("url")).agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))
    name = lambda kind, n: F.concat(F.lit(f"https://maps.example.org/{kind}/"), n.cast("string"))
    pages = table(spark, d, "pages").select(i, "url")
    index, part = F.floor(i / 400), F.floor(i / 20)
    maps = joined(pages, name("map", part), i, loc(F.col("url")), F.lit(""))
    parts = pages.select(index.alias("j"), part.alias("k")).distinct()
    indexes = joined(parts, name("index", F.col("j")), F.col("k"), loc(name("map", F.col("k"))), F.concat(loc(name("index", F.lit(0))), F.lit("\n")))
    robots = joined(parts.select("j").distinct(), F.lit("https://maps.example.org/robots.txt"), F.col("j"), F.concat(F.lit("Sitemap: "), name("index", F.col("j"))), F.lit("User-agent: *\n"))
    found = readers.sitemap_pages(maps.unionByName(indexes).unionByName(robots), "https://maps.example.org/robots.txt")
    return found.select("url", "depth", F.array_join(F.transform("trail", lambda t: t.cast("string")), ",").alias("trail"))


@query(f"""{T}, p AS (SELECT *, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE doc_id % 8 END AS s FROM x)
SELECT q.doc_id AS question_id, left(q.t, 20) || ' & x' AS title, left(a.t, 20) AS answer FROM p q JOIN p a ON a.doc_id = q.doc_id + 1 WHERE q.doc_id % 2 = 0 AND q.s >= 3 AND q.doc_id % 6 <> 4 AND coalesce(a.s, 0) >= 1""")
def j1_accepted_pairs(spark, d):
    """Even documents ask, odd ones answer; some scores are no numbers, some tags have no delimiters."""
    i, kind = F.col("doc_id"), F.col("doc_id") % 2
    score = F.when(i % 10 == 7, "many").otherwise((i % 8).cast("string"))
    tag = F.when(i % 6 == 0, "|macos|x|").when(i % 6 == 2, "<mac><y>").otherwise("macos")
    posts = docs(spark, d).select(i.alias("_Id"), (1 + kind).cast("int").alias("_PostTypeId"), F.when(kind == 0, i + 1).alias("_AcceptedAnswerId"), score.alias("_Score"), tag.alias("_Tags"), F.concat(F.left("text", F.lit(20)), F.lit(" &amp; x")).alias("_Title"), F.left("text", F.lit(20)).alias("_Body"))
    return readers.accepted_pairs(posts).select("question_id", "title", "answer")


@query("SELECT doc_id, '`' || lang || '` & text' AS text FROM documents")
def x10_html_text(spark, d):
    html = F.concat(F.lit("<div><code class='c'>"), "lang", F.lit("</code> <b>&amp;</b>\n<br/>text</div>"))
    return table(spark, d, "documents").select("doc_id", X.html_text(html).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '13|14' ELSE '14' END AS versions FROM documents")
def u5_all_versions(spark, d):
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ventura"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    rows = table(spark, d, "documents").select("doc_id", tags.alias("tags"), F.lit("on macOS 14.1 now").alias("t"))
    return rows.select("doc_id", F.array_join(X.all_versions("tags", {"ventura": "13"}, "t"), "|").alias("versions"))
