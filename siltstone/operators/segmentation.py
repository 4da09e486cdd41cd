"""Words of texts without spaces: a dictionary learned from the corpus, and the likeliest path through the graph of its words.

Texts with spaces teach the words between their spaces.  Scripts without spaces teach runs of 2 to
``GRAM`` characters that keep together more than their parts would by chance and that no longer run
swallows.  The dictionary is a table of at most ``SIZE`` rows, whatever the corpus holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.word_graph import WordGraph
from siltstone.sources.scratch import shared_folder, small_batches, written
from siltstone.sources.tables import load

#: Most words of a dictionary (of the highest counts), most characters of a word, most of a run without spaces.
SIZE, LONGEST, GRAM = 200_000, 16, 4
#: A word occurs this often; a run occurs so many times as often as its parts would side by side by chance.
LEAST, COHESION = 2, 8.0
#: A run is swallowed by one a character longer that has this share of its occurrences.
SWALLOWED = 0.9
#: Costs are whole millionths of a negative natural logarithm, so sums are exact and ties are ties.
SCALE = 1_000_000
SPACELESS = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+"
_RUN = re.compile("[぀-ヿ一-鿿]+|[^\\W_぀-ヿ一-鿿]+|_+")


def letters(text: Column) -> Column:
    """Lower-cased words of letters, as scripts with spaces have them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z[\p{L}&&[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]]]+"), F.lit(0))


def spaced_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words between spaces of at most ``LONGEST`` characters."""
    words = docs.select(F.explode(letters(F.col(text))).alias("word"))
    return words.where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def spaceless_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the runs of 1 to ``GRAM`` characters of scripts without spaces that look like words.

    Single characters are words.  A longer run is one if it occurs ``LEAST`` times, at each of its cuts
    ``COHESION`` times as often as chance would have both parts meet, and if no run that is a character
    longer has ``SWALLOWED`` of its occurrences.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(SPACELESS), F.lit(0))).alias("run"))
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("at"))
    grams = starts.select(F.substring("run", F.col("at"), F.lit(GRAM + 1)).alias("gram"))
    grams = grams.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("gram")), lambda k: F.substring(F.col("gram"), F.lit(1), k))).alias("word"))
    counts = written(grams.groupBy("word").agg(F.count("*").alias("n")), shared_folder(docs.sparkSession, "runs"))  # it is read six times, the texts once
    total = counts.where("char_length(word) = 1").agg(F.sum("n").cast("double").alias("total"))
    longer = counts.where("char_length(word) > 2").select(F.explode(F.array(F.expr("left(word, char_length(word) - 1)"), F.expr("substring(word, 2)"))).alias("word"), F.col("n").alias("most"))
    longer = longer.groupBy("word").agg(F.max("most").alias("most"))
    wide = counts.where(f"char_length(word) BETWEEN 2 AND {GRAM} AND n >= {LEAST}").join(longer, "word", "left").where(F.coalesce("most", F.lit(0)) < SWALLOWED * F.col("n"))
    cuts = wide.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("cut"))
    cuts = cuts.select("word", "n", F.expr("left(word, cut)").alias("l"), F.expr("substring(word, cut + 1)").alias("r"))
    cuts = cuts.join(counts.select(F.col("word").alias("l"), F.col("n").alias("nl")), "l").join(counts.select(F.col("word").alias("r"), F.col("n").alias("nr")), "r")
    together = F.col("n").cast("double") * F.col("total") / (F.col("nl").cast("double") * F.col("nr"))
    held = cuts.crossJoin(F.broadcast(total)).groupBy("word").agg(F.max("n").alias("n"), F.min(together).alias("together"))
    return held.where(F.col("together") >= COHESION).select("word", "n").unionByName(counts.where("char_length(word) = 1"))


def dictionary(counts: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(word, n, cost) of the ``size`` most frequent of ``counts`` (word, n); of equal counts the smaller word stays.

    The cost of a word is its negative log-probability among the kept words in whole millionths.  Without
    rows the result is empty.  The total is one broadcast row.
    """
    kept = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
    total = kept.agg(F.sum("n").alias("total"))
    cost = F.round((F.log(F.col("total").cast("double")) - F.log(F.col("n").cast("double"))) * SCALE).cast("long")
    return kept.crossJoin(F.broadcast(total)).select("word", "n", cost.alias("cost"))


def best_path(run: str, costs: dict[str, int], longest: int, unknown: int) -> list[int]:
    """Ends of the words of the cheapest path through ``run``; of equally cheap ones that with the longer last word.

    A character that the dictionary lacks may stand alone at the cost ``unknown``; such characters side by
    side make one word.
    """
    best, back, strange = [0] * (len(run) + 1), [0] * (len(run) + 1), [False] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        least, start = None, end - 1
        for k in range(max(0, end - longest), end):
            c = costs.get(run[k:end])
            if c is not None and (least is None or best[k] + c < least):
                least, start = best[k] + c, k
        alone = best[end - 1] + unknown
        if least is None or alone < least and run[end - 1] not in costs:
            least, start, strange[end] = alone, end - 1, True
        best[end], back[end] = least, start
    ends, at, joined = [], len(run), False
    while at:
        if not (joined and strange[at]):
            ends.append(at)
        at, joined = back[at], strange[at]
    return ends[::-1]


class Segmenter:
    """Cuts texts by a dictionary, which goes to each executor once; its size is bounded by ``SIZE``.

    Reading the dictionary is an action, as fitting a model is; cutting is lazy.
    """

    def __init__(self, words: DataFrame):
        rows = words.select("word", "n", "cost").collect()
        self.costs = {r.word: r.cost for r in rows}
        self.unknown = round(log(max(sum(r.n for r in rows), 1)) * SCALE)
        self.spark = words.sparkSession

    def found(self, docs: DataFrame, key: str, words: Column) -> DataFrame:
        """(key, n_words, n_pieces, n_found): each row's ``words`` joined without spaces, cut again, and how many come back whole.

        Null or no words give zeros; repeated rows give equal rows; texts of any length take linear time.
        """
        small_batches(self.spark)
        graph: Broadcast[WordGraph] = self.spark.sparkContext.broadcast(WordGraph(self.costs, self.unknown))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, graph.value.counts(b.column(1)))], [key, "n_words", "n_pieces", "n_found"])

        return docs.select(key, words.alias("_words")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_words bigint, n_pieces bigint, n_found bigint")

    def tokens(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, language, tokens): lower-cased words of at most 40 bytes; Chinese and Japanese texts are cut by the dictionary.

        Inside such texts, words of other scripts stay whole.  A null text has no tokens.
        """
        model = self.spark.sparkContext.broadcast((self.costs, max(map(len, self.costs), default=1), self.unknown))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            costs, longest, unknown = model.value
            for b in batches:
                out = []
                for one in b.column(2).to_pylist():
                    row: list[str] = []
                    for m in _RUN.findall(one or ""):
                        ends = best_path(m, costs, longest, unknown) if "぀" <= m[0] <= "鿿" else [len(m)]
                        row += [m[i:j] for i, j in zip([0, *ends], ends)]
                    out.append([w for w in row if len(w.encode()) <= 40])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], [key, "language", "tokens"])

        whole = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(key, T.language(whole).alias("language"), whole.alias("_text"))
        cut = rows.where("language IN ('Chinese', 'Japanese')").withColumn("_text", F.lower("_text"))
        plain = rows.where("language NOT IN ('Chinese', 'Japanese')").select(key, "language", T.analysed(F.col("_text")).alias("tokens"))
        return plain.unionByName(cut.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, language string, tokens array<string>"))


def learned(docs: DataFrame) -> DataFrame:
    """The dictionary of a corpus: words between spaces and runs of scripts without."""
    return dictionary(spaced_counts(docs).unionByName(spaceless_counts(docs)))


def q_learned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary that the documents teach."""
    return learned(load(spark, sf_dir, "documents"))


def q_unspaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without the spaces between them, cut by the dictionary of all documents."""
    docs = load(spark, sf_dir, "documents")
    return Segmenter(learned(docs)).found(docs, "doc_id", letters(F.col("text")))


QUERIES = {"learned_words": q_learned_words, "unspaced_words": q_unspaced_words}

ORACLE_SQL = {
    "learned_words": f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
    parts AS (SELECT unnest(regexp_split_to_array(word, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]+')) AS word FROM w),
    runs AS (SELECT unnest(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]+')) AS run FROM documents),
    grams AS (SELECT unnest(list_transform(range(1, least({GRAM + 1}, length(run) - a + 1) + 1), lambda k: substring(run, a, k))) AS word FROM (SELECT run, unnest(range(1, length(run) + 1)) AS a FROM runs)),
    g AS (SELECT word, count(*) AS n FROM grams GROUP BY 1),
    longer AS (SELECT word, max(n) AS most FROM (SELECT left(word, length(word) - 1) AS word, n FROM g WHERE length(word) > 2 UNION ALL SELECT substring(word, 2), n FROM g WHERE length(word) > 2) GROUP BY 1),
    wide AS (SELECT word, n FROM g LEFT JOIN longer USING (word) WHERE length(word) BETWEEN 2 AND {GRAM} AND n >= {LEAST} AND coalesce(most, 0) < {SWALLOWED} * n),
    cuts AS (SELECT word, n, unnest(range(1, length(word))) AS c FROM wide),
    held AS (SELECT cuts.word, min(cuts.n::DOUBLE * (SELECT sum(n) FROM g WHERE length(word) = 1) / (l.n::DOUBLE * r.n)) AS together, max(cuts.n) AS n FROM cuts JOIN g l ON l.word = left(cuts.word, c) JOIN g r ON r.word = substring(cuts.word, c + 1) GROUP BY 1),
    counts AS (SELECT word, count(*) AS n FROM parts WHERE length(word) BETWEEN 1 AND {LONGEST} GROUP BY 1 UNION ALL SELECT word, n FROM held WHERE together >= {COHESION} UNION ALL SELECT word, n FROM g WHERE length(word) = 1),
    kept AS (SELECT word, n FROM counts WHERE n >= {LEAST} ORDER BY n DESC, word LIMIT {SIZE})
    SELECT word, n, CAST(round((ln((SELECT sum(n) FROM kept)::DOUBLE) - ln(n::DOUBLE)) * {SCALE}) AS BIGINT) AS cost FROM kept""",
}
