"""What the query modules share."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word(kw: str) -> str:
    """A keyword as a whole word, for engines whose word boundary is ASCII only."""
    escaped = "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in kw)
    return rf"(^|[^\p{{L}}\p{{N}}_]){escaped}($|[^\p{{L}}\p{{N}}_])"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def contains_any(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted([n])})" for n in needles) + ")"


#: Rule tables in the words of the synthetic corpus, which has none of the default tables' words.
TOPICS = {"article": ["the", "der", "le"], "link": ["and", "und", "et", "with"], "place": ["in", "on", "en", "auf"], "rare": ["from", "pour", "von", "thing"]}
PRIORITY = ["rare", "place", "link", "article"]
WEIGHTS = {f"s{k}": 1.05 - 0.01 * k for k in range(8)}
SQUEEZE = "trim(regexp_replace({}, '[\\s\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{a0}}]+', ' ', 'g'))"
