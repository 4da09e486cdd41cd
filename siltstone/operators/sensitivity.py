"""Sensitive tag names with reasons, by patterns that can be added and removed; telemetry without private parts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.tables import load

# The reason of each group of sensitive words, and what is a path in telemetry.
REASONS = {
    "personal_info": "May contain personal or confidential information",
    "financial": "May contain financial information",
    "health": "May contain health-related information",
    "legal": "May contain legal documents",
    "work_sensitive": "May contain work-related sensitive information",
    "identity": "May contain identity documents",
    "relationship": "May contain sensitive family/relationship information",
}
CUSTOM_REASON = "Custom sensitive pattern"
TELEMETRY_PATH = r"[A-Za-z]:\\[^\s]+|/[^\s]+/[^\s]+"


class Pattern(NamedTuple):
    """A group of keywords with its level (0 None to 3 High); a keyword matches as a part of the lower-cased name."""

    name: str
    level: int
    keywords: tuple[str, ...]
    reason: str = CUSTOM_REASON


DEFAULTS = tuple(Pattern(name, level, tuple(words), REASONS[name]) for name, level, words in T.SENSITIVE)


def changed(patterns: tuple[Pattern, ...], add: tuple[Pattern, ...] = (), remove: tuple[str, ...] = ()) -> tuple[Pattern, ...]:
    """``patterns`` without all of the names ``remove``, then ``add`` behind them; a name may occur more than once."""
    return tuple(p for p in patterns if p.name not in remove) + tuple(add)


def matches(name: Column, patterns: tuple[Pattern, ...] = DEFAULTS) -> Column:
    """Array of (pattern, keywords, level, reason) in the order of the patterns, each with its keywords that the name holds.

    A null name matches nothing.  Patterns are a command's list, so they are literals of the plan.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    if not patterns:
        return F.array().cast("array<struct<pattern:string,keywords:array<string>,level:int,reason:string>>")
    table = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.array(*[F.lit(k) for k in p.keywords]).cast("array<string>").alias("keywords"), F.lit(p.level).alias("level"), F.lit(p.reason).alias("reason")) for p in patterns])
    held = F.transform(table, lambda p: p.withField("keywords", F.filter(p["keywords"], lambda k: low.contains(k))))
    return F.filter(held, lambda p: F.size(p["keywords"]) > 0)


def analyse(tags: DataFrame, tag: str = "tag", patterns: tuple[Pattern, ...] = DEFAULTS) -> DataFrame:
    """``tags`` with ``matched`` (see :func:`matches`), ``overall`` (None to High) and ``confirm``: whether a user must confirm the tag."""
    level = F.aggregate("matched", F.lit(0), lambda a, p: F.greatest(a, p["level"]))
    names = F.array(*[F.lit(x) for x in T.LEVELS])
    return tags.withColumn("matched", matches(F.col(tag), patterns)).withColumn("overall", F.get(names, level)).withColumn("confirm", F.col("overall") != T.LEVELS[0])


CHANGED = changed(DEFAULTS, (Pattern("custom", 2, ("tion", "eau")), Pattern("codes", 1, ("eau", "cht"), "May name a code")), ("legal", "relationship"))


def q_sensitivity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different word of the documents as a tag name, judged after patterns were added and removed; those that match."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tag")).distinct()
    a = analyse(words, "tag", CHANGED).where("confirm")
    each = lambda c: F.array_join(F.transform("matched", lambda p: F.array_join(p[c], ",") if c == "keywords" else p[c]), "|")
    return a.select("tag", "overall", "confirm", each("pattern").alias("patterns"), each("keywords").alias("keywords"), each("reason").alias("reasons"))


def q_sensitive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different words are of each level by the patterns that come with the engine."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tag")).distinct()
    return analyse(words).groupBy("overall").agg(F.count("*").alias("tags"))


def sanitise(text: Column, user: str = "", home: str = "") -> Column:
    """A telemetry text without the user's name, then home folder, then whatever looks like a path; in this order."""
    out = text
    if user:
        out = F.replace(out, F.lit(user), F.lit("[USER]"))
    if home:
        out = F.replace(out, F.lit(home), F.lit("[HOME]"))
    return F.regexp_replace(out, TELEMETRY_PATH, "[PATH]")


def sanitised(events: DataFrame, user: str = "", home: str = "") -> DataFrame:
    """Telemetry ``events`` (kind, name, action, context) as they may be sent.

    Feature: name and action are sanitised; Performance: the name; Error: name and context; Session: nothing, it holds no text of the user's.
    """
    only = lambda c, kinds: F.when(F.col("kind").isin(*kinds), sanitise(F.col(c), user, home)).otherwise(F.col(c)).alias(c)
    fields = {"name": only("name", ["Feature", "Performance", "Error"]), "action": only("action", ["Feature"]), "context": only("context", ["Error"])}
    return events.select(*[fields.get(c, F.col(c)) for c in events.columns])


def q_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: what is sent of each, for the user of number 7."""
    kind = F.when(F.col("event_type").isin("click", "view"), "Feature").when(F.col("event_type") == "purchase", "Performance").when(F.col("event_type") == "error", "Error").otherwise("Session")
    who = F.concat(F.lit("user"), F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    e = load(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), F.concat("event_type", F.lit(" by "), who).alias("name"), F.concat(F.lit("open C:\\"), who, F.lit("\\"), F.coalesce("props", F.lit(""))).alias("action"),
        F.concat(F.lit("in /home/"), who, F.lit("/x/"), F.coalesce("props", F.lit("")), F.lit(" of ~"), who).alias("context"))
    return sanitised(e, "user7", "/home/user1")


QUERIES = {"sensitivity_report": q_sensitivity_report, "sensitive_batch": q_sensitive_batch, "telemetry": q_telemetry}


def _values(patterns: tuple[Pattern, ...]) -> str:
    return ", ".join(f"({i}, '{p.name}', {p.level}, '{p.reason}', {j}, '{k}')" for i, p in enumerate(patterns) for j, k in enumerate(p.keywords))


_WORDS = f"w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS tag FROM documents)"
_LEVEL = "(['None', 'Low', 'Medium', 'High'])[max(level) + 1]"
_SENT = "regexp_replace(replace(replace({c}, 'user7', '[USER]'), '/home/user1', '[HOME]'), '" + TELEMETRY_PATH + "', '[PATH]', 'g')"
ORACLE_SQL = {
    "sensitivity_report": f"""WITH {_WORDS}, k(i, pattern, level, reason, j, keyword) AS (VALUES {_values(CHANGED)}),
    m AS (SELECT tag, i, pattern, level, reason, string_agg(keyword, ',' ORDER BY j) AS keywords FROM w JOIN k ON contains(tag, keyword) GROUP BY ALL)
    SELECT tag, {_LEVEL} AS overall, true AS confirm, string_agg(pattern, '|' ORDER BY i) AS patterns, string_agg(keywords, '|' ORDER BY i) AS keywords, string_agg(reason, '|' ORDER BY i) AS reasons FROM m GROUP BY tag""",
    "sensitive_batch": f"""WITH {_WORDS}, k(i, pattern, level, reason, j, keyword) AS (VALUES {_values(DEFAULTS)}),
    m AS (SELECT tag, (['None', 'Low', 'Medium', 'High'])[max(coalesce(level, 0)) + 1] AS overall FROM w LEFT JOIN k ON contains(tag, keyword) GROUP BY tag) SELECT overall, count(*) AS tags FROM m GROUP BY 1""",
    "telemetry": f"""WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'Feature' WHEN event_type = 'purchase' THEN 'Performance' WHEN event_type = 'error' THEN 'Error' ELSE 'Session' END AS kind, event_type, 'user' || coalesce(user_id::VARCHAR, '') AS who, coalesce(props, '') AS props FROM events),
    t AS (SELECT event_id, kind, event_type || ' by ' || who AS name, 'open C:\\' || who || '\\' || props AS action, 'in /home/' || who || '/x/' || props || ' of ~' || who AS context FROM e)
    SELECT event_id, kind, CASE WHEN kind <> 'Session' THEN {_SENT.format(c='name')} ELSE name END AS name, CASE WHEN kind = 'Feature' THEN {_SENT.format(c='action')} ELSE action END AS action, CASE WHEN kind = 'Error' THEN {_SENT.format(c='context')} ELSE context END AS context FROM t""",
}
