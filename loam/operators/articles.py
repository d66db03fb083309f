"""Records of different sources to articles: which records count, what their solution is, and the article that they make.

Everything is column expressions and grouped aggregates that combine before the shuffle; an issue with any number of comments
is never held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import rules
from loam.functions import text as X
from loam.functions.rows import once
from loam.operators.corpus import long_enough

POST_SCORE, POST_COMMENTS = 5, 3
ISSUE_BODY, ISSUE_COMMENTS, ISSUE_REACTIONS = 200, 3, 3
SOLUTION, THREAD_REPLIES, MANUAL_CHARS = 100, 2, 200


def posts_worth(posts: DataFrame, score: int = POST_SCORE, comments: int = POST_COMMENTS, flairs=rules.SKIPPED_FLAIRS) -> DataFrame:
    """Posts with text of their own, enough score and comments, not pinned, not for adults, without a blocked word in the flair."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    flair = X.mentions(F.lower(F.coalesce("flair", F.lit(""))), flairs)
    own = F.coalesce("is_self", F.lit(False)) & (X.squeeze(F.coalesce("body", F.lit(""))) != "")
    return posts.where(own & (F.col("score") >= score) & (F.col("comments") >= comments) & no("stickied") & no("over_18") & ~flair)


def issue_relevant(title, body, labels, words, wanted) -> Column:
    """A word in the title and the first 500 characters of the body, or one of the labels; without regard to case."""
    text = F.lower(F.concat_ws(" ", X.col(title), F.left(F.coalesce(X.col(body), F.lit("")), F.lit(500))))
    low = F.transform(F.coalesce(X.col(labels), F.array().cast("array<string>")), lambda x: F.lower(x))
    return X.mentions(text, words) | F.arrays_overlap(low, F.array(*[F.lit(w) for w in wanted]))


def session_relevant(title, description, words=rules.SESSION_WORDS) -> Column:
    return X.mentions(F.lower(F.concat_ws(" ", X.col(title), X.col(description))), words)


def threads_worth(threads: DataFrame, replies: int = THREAD_REPLIES) -> DataFrame:
    """Threads with an accepted text, enough replies, and a title or a first post."""
    full = lambda c: X.squeeze(F.coalesce(F.col(c), F.lit(""))) != ""
    return threads.where(full("accepted") & (F.col("replies") >= replies) & (full("title") | full("post")))


def manuals_worth(pages: DataFrame, commands: list[str], least: int = MANUAL_CHARS) -> DataFrame:
    return pages.where(F.col("command").isin(commands) & (F.length("raw_text") >= least))


def crawlable(url, blocked=rules.BLOCKED_URLS, article: str = r"/(?:[a-z]{2}-[a-z]{2}/)?(?:HT)?\d{5,6}/?$") -> Column:
    """Addresses without a blocked part; with a pattern, those whose path is an article's."""
    url = F.coalesce(X.col(url), F.lit(""))
    path = F.regexp_replace(url, r"[?#].*$", "")
    return ~X.mentions(url, blocked) & path.rlike(article)


def preferred_urls(urls: DataFrame, locale: str = "/en-us/") -> DataFrame:
    """(article_id, pos, url): of urls(pos, url) one for each article: the last of the locale, else the first; pos is the
    article's first place, by which the result is in order."""
    mine = F.contains("url", F.lit(locale))
    rank = F.struct(mine.alias("mine"), F.when(mine, F.col("pos")).otherwise(-F.col("pos")).alias("late"))
    return urls.groupBy(X.url_article("url").alias("article_id")).agg(F.min("pos").alias("pos"), F.max_by("url", rank).alias("url"))


def ordered_union(*lists: DataFrame) -> DataFrame:
    """(pos, url): the urls(pos, url) of all lists in turn, each once, at its first place."""
    rows = [x.select(F.lit(k).alias("list"), "pos", "url") for k, x in enumerate(lists)]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    return both.groupBy("url").agg(F.min(F.struct("list", "pos")).alias("first")).select("first.list", "first.pos", "url")


def limited(urls: DataFrame, per_step: int | None) -> DataFrame:
    """The first urls(list, pos, url) of a step, in order; all without a number."""
    return urls if per_step is None else urls.orderBy("list", "pos").limit(per_step)


def first_directory(files: DataFrame) -> DataFrame:
    """Of files(command, directory, path) of one command those in the first directory, of these the first path."""
    return files.groupBy("command").agg(F.min(F.struct("directory", "path")).alias("f")).select("command", "f.directory", "f.path")


def solutions(comments: DataFrame, least: int = SOLUTION, reactions: int = ISSUE_REACTIONS, phrases=rules.RESOLUTION_PHRASES) -> DataFrame:
    """(issue, solution) of comments(issue, pos, body, reactions): of the comments with at least `least` characters of plain text
    the one with most reactions, if these are enough (the earliest of equals); else the first with a phrase of resolution in
    its raw text; else the last. An issue without such a comment has no row."""
    plain = lambda rows: once(rows, plain=X.markdown_text("body")).where(F.length("plain") >= least)
    rows = plain(comments)
    said = X.mentions(F.lower(F.coalesce("body", F.lit(""))), phrases)
    n = F.coalesce("reactions", F.lit(0))
    # the place is chosen by numbers; only the chosen comment's text is moved, by a join that does not gather a group
    best = F.max(F.struct(n.alias("n"), (-F.col("pos")).alias("back"))).alias("best")
    place = rows.groupBy("issue").agg(best, F.min(F.when(said, F.col("pos"))).alias("resolved"), F.max("pos").alias("last"))
    place = place.select("issue", F.coalesce(F.when(F.col("best.n") >= reactions, -F.col("best.back")), "resolved", "last").alias("pos"))
    return plain(comments.join(place, ["issue", "pos"])).groupBy("issue").agg(F.first("plain").alias("solution"))


def article(now, **parts) -> list[Column]:
    """The columns of an article; what is not given has its default."""
    none = F.array().cast("array<string>")
    given = {
        "locale": F.lit("en-us"), "scraped_at": now, "last_modified": F.lit(None).cast("string"), "affected_devices": F.array(F.lit("Mac")), "steps": none,
    } | parts
    order = ["id", "article_id", "locale", "title", "url", "scraped_at", "last_modified", "affected_devices", "macos_versions", "difficulty_tier", "category", "categories", "summary", "sections", "steps", "embed_text", "source"]
    return [given[c].alias(c) for c in order]


def _section(heading: str, body) -> Column:
    return F.struct(F.lit(heading).alias("heading"), body.alias("body"))


def issue_articles(issues: DataFrame, comments: DataFrame, now: Column, words, wanted, category=X.scored_category, phrases=rules.RESOLUTION_PHRASES) -> DataFrame:
    """Articles of issues(owner, repo, number, title, body, labels, comments, url) with a solution among their comments(owner,
    repo, number, pos, body, reactions); the phrases are those of `solutions`."""
    key = ["owner", "repo", "number"]
    good = issues.where(issue_relevant("title", "body", "labels", words, wanted) & (F.col("comments") >= ISSUE_COMMENTS))
    good = once(good, body=X.markdown_text("body")).where(F.length("body") >= ISSUE_BODY)
    picked = solutions(comments.withColumn("issue", F.struct(*key)), phrases=phrases).select("issue.*", "solution")
    rows = once(good.join(picked, key), all=F.concat_ws(" ", "title", "body", "solution")).withColumn("label", X.normal_category(category("all")))
    slug = F.upper(F.concat_ws("_", "owner", "repo"))
    text = F.concat(F.col("title"), F.lit(". "), F.left("body", F.lit(600)), F.lit(" "), F.left("solution", F.lit(600)))
    number = F.col("number").cast("string")
    return long_enough(rows.select(*article(
        now, id=F.lower(F.concat(F.lit("gh_"), slug, F.lit("_"), number)), article_id=F.concat(F.lit("GH_"), slug, F.lit("_"), number), title=F.col("title"), url=F.col("url"), macos_versions=X.loose_versions("all"),
        difficulty_tier=X.difficulty("all"), category=F.col("label"), categories=F.array(F.concat_ws("/", F.lit("GitHub"), "owner", "repo"), F.lit("Open Source Issues")), summary=F.left("body", F.lit(300)),
        sections=F.array(_section("Problem", F.left("body", F.lit(1000))), _section("Solution", F.left("solution", F.lit(1000)))), embed_text=X.embed_text(text, "title", "label"), source=F.lit("github_issues"),
    )))


def post_articles(posts: DataFrame, now: Column, category=X.scored_category) -> DataFrame:
    """Articles of posts(post_id, group, title, body, permalink, created, ...) that are worth it: symptoms without a solution."""
    rows = once(posts_worth(posts), title=X.squeeze(F.coalesce("title", F.lit(""))), body=X.squeeze("body")).where("title <> ''")
    rows = once(rows, all=F.when(F.col("body") != "", F.concat(F.col("title"), F.lit(". "), F.col("body"))).otherwise(F.col("title"))).withColumn("label", X.normal_category(category("all")))
    return long_enough(rows.select(*article(
        now, id=F.concat(F.lit("reddit_"), "post_id"), article_id=F.concat(F.lit("REDDIT_"), F.upper("post_id")), title=F.col("title"), url=F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit(""))),
        last_modified=X.iso_time("created"), macos_versions=X.loose_versions("all"), difficulty_tier=F.lit(1), category=F.col("label"), categories=F.array(F.concat(F.lit("r/"), "group"), F.lit("Community")),
        summary=F.left("all", F.lit(300)), sections=F.array(_section("User Problem", F.col("all"))), embed_text=X.embed_text("all", "title", "label"), source=F.lit("reddit"),
    )))


def session_articles(sessions: DataFrame, now: Column, words=rules.SESSION_WORDS, years: dict = rules.YEAR_VERSIONS, category=X.scored_category) -> DataFrame:
    """Articles of sessions(session_id, year, title, description, content, url) that are relevant."""
    rows = sessions.where(session_relevant("title", "description", words))
    whole = F.when(F.col("content") != F.col("description"), F.trim(F.concat_ws(" ", "description", "content"))).otherwise(F.col("description"))
    rows = once(rows, whole=whole).withColumn("name", F.concat(F.lit("WWDC"), F.col("year").cast("string"), F.lit(": "), "title")).withColumn("label", X.normal_category(category(F.concat_ws(" ", "title", "whole"))))
    version = F.coalesce(F.create_map(*[F.lit(x) for pair in years.items() for x in pair])[F.col("year")], F.lit("all"))
    of = lambda head, name: F.concat(F.lit(head), F.col("year").cast("string"), F.lit("_"), name)
    return long_enough(rows.select(*article(
        now, id=of("wwdc_", F.col("session_id")), article_id=of("WWDC_", F.upper("session_id")), title=F.col("name"), url=F.col("url"), macos_versions=F.array(version), difficulty_tier=F.lit(3), category=F.col("label"),
        categories=F.array(F.concat(F.lit("WWDC"), F.col("year").cast("string")), F.lit("Developer Sessions")), summary=F.left("description", F.lit(300)),
        sections=F.array(_section("Session Overview", F.col("description")), _section("Content", F.left("content", F.lit(1500)))), embed_text=X.embed_text(F.concat(F.col("name"), F.lit(". "), "whole"), "name", "label"), source=F.lit("wwdc_transcripts"),
    )))


def threads_of(posts: DataFrame) -> DataFrame:
    """(url, title, tags, post, accepted, replies) of posts(url, title, tags, pos, text, is_accepted): the first post, the
    accepted reply and the number of replies of each thread."""
    accepted = F.coalesce("is_accepted", F.lit(False))
    first = F.min_by(F.struct("title", "tags", "text"), "pos")
    out = posts.groupBy("url").agg(first.alias("f"), F.min_by(F.when(accepted, F.col("text")), F.when(accepted, F.col("pos"))).alias("accepted"), (F.count("*") - 1).alias("replies"))
    return out.select("url", "f.title", "f.tags", F.col("f.text").alias("post"), "accepted", "replies")


def thread_articles(threads: DataFrame, now: Column, category=X.scored_category) -> DataFrame:
    """Articles of threads(url, title, post, accepted, replies) with an accepted reply."""
    rows = once(threads_worth(threads), all=F.concat_ws(" ", "title", "post", "accepted")).withColumn("label", X.normal_category(category("all")))
    number = F.regexp_extract("url", r"/thread/(\d+)", 1)
    number = F.when(number != "", number).otherwise(F.element_at(F.split("url", "/"), -1))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("post", F.lit("")), F.lit(" "), F.col("accepted"))
    return long_enough(rows.select(*article(
        now, id=F.concat(F.lit("devforum_"), number), article_id=F.concat(F.lit("DEVFORUM_"), number), title=F.col("title"), url=F.col("url"), macos_versions=X.loose_versions("all"), difficulty_tier=X.difficulty("accepted"),
        category=F.col("label"), categories=F.array(F.lit("Apple Developer Forums")), summary=F.left("post", F.lit(300)), sections=F.array(_section("Problem", F.col("post")), _section("Solution", F.col("accepted"))),
        embed_text=X.embed_text(text, "title", "label"), source=F.lit("apple_developer_forums"),
    )))


HEADER = r"^[A-Z][A-Z ]{2,}$"


def manual_sections(raw) -> Column:
    """Array of (heading, body) of a manual page's text: a line of capitals at the margin opens a section, what stands before is
    PREAMBLE; a heading without any line behind it has no section, of repeated headings the last counts."""
    lines = F.split(F.coalesce(X.col(raw), F.lit("")), r"\r\n|\r|\n", -1)
    heads = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.regexp_replace(F.get(a, i), r"\s+$", "").rlike(HEADER))

    def section(a, at, end):
        heading = F.when(at < 0, F.lit("PREAMBLE")).otherwise(F.trim(F.get(a, at)))
        body = F.array_join(F.slice(a, at + 2, end - at - 1), "\n")
        return F.struct(heading.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))

    def cut(a, h):
        spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), h).alias("at"), F.concat(h, F.array(F.size(a))).alias("end"))
        return F.transform(F.filter(spans, lambda z: z["end"] - z["at"] > 1), lambda z: section(a, z["at"], z["end"]))

    found = X.let(lines, lambda a: X.let(heads(a), lambda h: cut(a, h)))
    last = lambda s, names: F.filter(s, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["heading"]))
    return X.let(found, lambda s: X.let(F.transform(s, lambda x: x["heading"]), lambda names: last(s, names)))


def section_body(sections, heading: str) -> Column:
    return F.coalesce(F.get(F.filter(X.col(sections), lambda s: s["heading"] == heading), F.lit(0))["body"], F.lit(""))


def manual_flags(synopsis) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(X.col(synopsis), F.lit(r"(?U)--?[a-zA-Z][\w-]*"), F.lit(0))))


def manual_examples(body) -> Column:
    """Lines of the section of examples that begin with $ or four blanks and no #, without the $, of more than five characters."""
    lines = F.split(X.col(body), r"\r\n|\r|\n")
    tidy = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    some = F.filter(lines, lambda x: F.startswith(tidy(x), F.lit("$")) | (F.startswith(x, F.lit("    ")) & (tidy(x) != "") & ~F.startswith(tidy(x), F.lit("#"))))
    return F.filter(F.transform(some, lambda x: F.regexp_replace(tidy(x), r"^[$ ]+", "")), lambda x: F.length(x) > 5)


def manual_articles(pages: DataFrame, now: Column, commands: list[str]) -> DataFrame:
    """Articles of manual pages(command, section, raw_text) of the wanted commands."""
    rows = once(manuals_worth(pages, commands), parts=manual_sections("raw_text"))
    rows = once(rows, synopsis=section_body("parts", "SYNOPSIS"), description=section_body("parts", "DESCRIPTION"), name=section_body("parts", "NAME"), example_text=section_body("parts", "EXAMPLES"))
    line = F.coalesce(F.nullif(F.regexp_extract(X.squeeze("name"), "(?:-|–|—)\\s+(.*)$", 1), F.lit("")), F.col("command"))
    rows = once(rows, one_line=line, flags=manual_flags("synopsis"), examples=manual_examples("example_text"))
    some = lambda test, s: F.when(test, F.array(s)).otherwise(F.array().cast("array<struct<heading:string,body:string>>"))
    shown = F.array_join(F.transform("examples", lambda e: F.concat(F.lit("  "), e)), "\n")
    sections = F.concat(F.array(_section("Synopsis", F.col("synopsis")), _section("Description", F.col("description"))), some(F.size("flags") > 0, _section("Flags", F.array_join("flags", "  "))), some(F.size("examples") > 0, _section("Examples", shown)))
    text = F.concat(F.lit("Command: "), "command", F.lit(". "), "one_line", F.lit(". Synopsis: "), F.left("synopsis", F.lit(200)), F.lit(". Description: "), "description")
    return long_enough(rows.select(*article(
        now, id=F.concat_ws("_", F.lit("manpage"), "command", "section"), article_id=F.concat_ws("_", F.lit("MANPAGE"), F.upper("command"), "section"), title=F.concat("command", F.lit("("), "section", F.lit(") — "), "one_line"),
        url=F.concat(F.lit("local://manpage/"), "command", F.lit("."), "section"), macos_versions=F.array(F.lit("all")), difficulty_tier=F.lit(2), category=F.lit("system"), categories=F.array(F.lit("Man Pages"), F.lit("System")),
        summary=F.col("one_line"), sections=sections, steps=F.col("examples"), embed_text=X.embed_text(text, F.concat_ws(" ", "command", "one_line"), F.lit("system")), source=F.lit("macos_man_pages"),
    )))


def pair_articles(pairs: DataFrame, now: Column, prefix: str = "ask_", category=X.scored_category, link: str = "https://example.org/questions/") -> DataFrame:
    """Articles of accepted pairs(question_id, title, tags, question, answer), markup removed."""
    rows = once(pairs, title=X.unescape("title"), ask=X.html_text("question"), told=X.html_text("answer"))
    rows = once(rows, all=F.concat_ws(" ", "title", "ask", "told")).withColumn("label", X.normal_category(category("all")))
    key = F.col("question_id").cast("string")
    return long_enough(rows.select(*article(
        now, id=F.concat(F.lit(prefix), key), article_id=F.upper(F.concat(F.lit(prefix), key)), title=F.col("title"), url=F.concat(F.lit(link), key), macos_versions=X.loose_versions("all"), difficulty_tier=X.difficulty("all"), category=F.col("label"),
        categories=F.col("tags"), summary=F.left("ask", F.lit(300)), sections=F.array(_section("Question", F.col("ask")), _section("Answer", F.col("told"))), embed_text=X.embed_text(F.concat(F.col("title"), F.lit(". "), "told"), "title", "label"), source=F.lit("ask_different"),
    )))


def sections_by_heading(rows: DataFrame, key: str, order: str = "pos", first: str = "Overview") -> DataFrame:
    """(key, n, heading, body) of rows(key, pos, is_heading, text): the texts behind each heading, joined by blanks; those before
    the first heading under `first`; a heading without text has no section. Numbering needs the running count of a page's
    headings; the texts of a section then meet in a grouped aggregate."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("n", F.sum(F.col("is_heading").cast("int")).over(upto))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading") & (F.trim("text") != ""), F.struct(order, "text")))), lambda x: x["text"]), " ")
    out = numbered.groupBy(key, "n").agg(F.coalesce(F.max(F.when(F.col("is_heading"), F.col("text"))), F.lit(first)).alias("heading"), F.trim(body).alias("body"))
    return out.where("body <> ''")
