"""Joins of points with intervals and with states: hits with the paragraph they lie in, requests with the system's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered, as_of
from siltstone.sources.tables import load

#: Characters of a bin.  Paragraphs do not overlap, so a bin of a document meets at most as many of them.
BIN = 1024
#: What parts the turns of a conversation, and the paragraphs of a text.
BLANK = "\n\n"
HIT = "que"
PREVIEW = 100


def paragraphs(turns: DataFrame) -> DataFrame:
    """(conv_id, number, start, end, preview) of the text that a conversation's turns make with a blank line between them.

    Paragraphs are what blank lines part; a start counts the characters before, an end is the start and
    the length without outer white space; those of white space alone are left out but counted in
    ``number``.  Offsets are running sums over all turns, carried across partitions, so a conversation of
    any length is no one task's work.  Turns without text are left out.
    """
    parts = turns.where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.split("text", BLANK)).alias("part", "p"))
    size = (F.char_length("p") + len(BLANK)).cast("long")
    placed = Ordered(parts, ["conv_id"], ["turn", "part"]).running_sum("start", size, inclusive=False).running_sum("number", F.lit(1).cast("long"), inclusive=False).result()
    bare = F.regexp_replace("p", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    short = F.when(F.char_length("bare") > PREVIEW, F.concat(F.substring("bare", 1, PREVIEW), F.lit("..."))).otherwise(F.col("bare"))
    rows = placed.withColumn("bare", bare).where("bare <> ''")
    return rows.select("conv_id", "number", "start", (F.col("start") + F.char_length("bare")).alias("end"), short.alias("preview"))


def hits(turns: DataFrame, term: str) -> DataFrame:
    """(conv_id, at): where the term stands in the conversation's text, from left to right without overlap inside a turn."""
    parts = turns.where("text IS NOT NULL").select("conv_id", "turn", F.split("text", f"\\Q{term}\\E").alias("parts"))
    parts = parts.select("conv_id", "turn", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "p"))
    follows = F.when(F.col("part") < F.col("n") - 1, len(term)).otherwise(len(BLANK))
    placed = Ordered(parts, ["conv_id"], ["turn", "part"]).running_sum("behind", (F.char_length("p") + follows).cast("long")).result()
    return placed.where("part < n - 1").select("conv_id", (F.col("behind") - len(term)).alias("at"))


def point_in_interval(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """``points`` with the spans of the same key that start at or before them and end behind them.

    An equi-join by key and bin of ``width``: a span is in each bin it touches, a point in one.  So a bin
    of a key meets only the spans that touch it, however many the key has, and large keys fall apart by bin.
    Points with a null key or place, and spans without length, match nothing.  The two sides share only the key's name.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    left = points.withColumn("_bin", F.floor(F.col(at) / width))
    right = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    return left.join(right, [key, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def q_paragraph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit of a term in the conversations with its paragraph."""
    turns = load(spark, sf_dir, "conversations")
    return point_in_interval(hits(turns, HIT), paragraphs(turns), "conv_id", "at", "start", "end")


def q_paragraphs_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(load(spark, sf_dir, "conversations"))


def system_state(event_type: Column, value: Column) -> Column:
    """The state an event reports; a value is the battery's charge, under 20 of 100 is low."""
    return F.when(event_type == "purchase", "FullscreenApp").when(event_type == "signup", "PresentationMode").when((event_type == "error") & (value < 20), "LowPower").when(event_type == "error", "Normal")


def gate(state: Column) -> dict[str, Column]:
    """What may run in a state: full screen and presentations stop indexing, these and low power stop the cloud; an unknown state stops nothing."""
    game = F.coalesce(state.isin("FullscreenApp", "PresentationMode"), F.lit(False))
    return {"may_index": ~game, "may_use_cloud": ~(game | F.coalesce(state == "LowPower", F.lit(False)))}


def q_gated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click and view with the latest state that its user's other events report, and what may run then."""
    e = load(spark, sf_dir, "events")
    states = e.withColumn("state", system_state(F.col("event_type"), F.col("value")))
    out = as_of(e.where("event_type IN ('click', 'view')").select("event_id", "user_id", "ts"), states.select("event_id", "user_id", "ts", "state"), "user_id", "ts", "event_id", "state")
    return out.select("event_id", "user_id", "state", *[c.alias(name) for name, c in gate(F.col("state")).items()])


def q_state_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's reported state: the state before, and since when it held."""
    e = load(spark, sf_dir, "events").withColumn("state", system_state(F.col("event_type"), F.col("value"))).where("state IS NOT NULL").select("event_id", "user_id", "ts", "state")
    seen = Ordered(e, ["user_id"], ["ts", "event_id"]).last_known("was", F.col("state"), inclusive=False)
    changed = seen.running_sum("spell", F.when(F.col("was") == F.col("state"), 0).otherwise(1).cast("long")).result()
    return changed.groupBy("user_id", "spell").agg(F.min("state").alias("state"), F.min("ts").alias("since"), F.count("*").alias("reports"))


QUERIES = {"paragraph_hits": q_paragraph_hits, "paragraphs_of_turns": q_paragraphs_of_turns, "gated_requests": q_gated_requests, "state_spells": q_state_spells}

_PARAGRAPHS = f"""parts AS (SELECT conv_id, turn, unnest(string_split(text, '{BLANK}')) AS p, generate_subscripts(string_split(text, '{BLANK}'), 1) AS part FROM conversations WHERE text IS NOT NULL),
    placed AS (SELECT conv_id, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, coalesce(sum(length(p) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER w - 1 AS number
      FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY turn, part)),
    paragraphs AS (SELECT conv_id, number, start, start + length(bare) AS end, CASE WHEN length(bare) > {PREVIEW} THEN left(bare, {PREVIEW}) || '...' ELSE bare END AS preview FROM placed WHERE bare <> '')"""
_STATE = "CASE WHEN event_type = 'purchase' THEN 'FullscreenApp' WHEN event_type = 'signup' THEN 'PresentationMode' WHEN event_type = 'error' AND value < 20 THEN 'LowPower' WHEN event_type = 'error' THEN 'Normal' END"
ORACLE_SQL = {
    "paragraph_hits": f"""WITH {_PARAGRAPHS}, whole AS (SELECT conv_id, string_agg(text, '{BLANK}' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1),
    pieces AS (SELECT conv_id, unnest(string_split(text, '{HIT}')) AS p, generate_subscripts(string_split(text, '{HIT}'), 1) AS k, len(string_split(text, '{HIT}')) AS n FROM whole),
    found AS (SELECT conv_id, k, n, (sum(length(p) + {len(HIT)}) OVER (PARTITION BY conv_id ORDER BY k) - {len(HIT)})::BIGINT AS "at" FROM pieces)
    SELECT conv_id, "at", number, start, "end", preview FROM found JOIN paragraphs USING (conv_id) WHERE k < n AND start <= "at" AND "at" < "end" """,
    "paragraphs_of_turns": f"WITH {_PARAGRAPHS} SELECT * FROM paragraphs",
    "gated_requests": f"""WITH states AS (SELECT user_id, ts, state FROM (SELECT *, {_STATE} AS state FROM events) WHERE state IS NOT NULL),
    found AS (SELECT r.event_id, r.user_id, s.state FROM (SELECT * FROM events WHERE event_type IN ('click', 'view')) r ASOF LEFT JOIN states s ON r.user_id = s.user_id AND r.ts >= s.ts)
    SELECT *, NOT coalesce(state IN ('FullscreenApp', 'PresentationMode'), false) AS may_index, NOT coalesce(state IN ('FullscreenApp', 'PresentationMode', 'LowPower'), false) AS may_use_cloud FROM found""",
    "state_spells": f"""WITH states AS (SELECT event_id, user_id, ts, {_STATE} AS state FROM events),
    seen AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM states WHERE state IS NOT NULL),
    spells AS (SELECT *, sum(CASE WHEN was = state THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS spell FROM seen)
    SELECT user_id, spell, min(state) AS state, min(ts) AS since, count(*) AS reports FROM spells GROUP BY ALL""",
}
