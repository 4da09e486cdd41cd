"""Text rules over whole tables: query classes, intents, languages, tags by keyword, anonymisation, snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.tables import documents_as_files, load


def q_classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a search query: its class and the weights of vector and text scores."""
    kind = T.classify_query(F.col("text"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))
    w = F.when(F.col("kind") == "ExactKeyword", 0.2).when(F.col("kind") == "NaturalLanguage", 0.8).otherwise(0.6)
    return c.select("conv_id", "turn", "kind", w.alias("vector_weight"), F.round(1 - w, 6).alias("text_weight"))


def q_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, content = T.intent_scores(F.col("text"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(file, 6).alias("file_score"), F.round(content, 6).alias("content_score"), T.time_hint(F.col("text")).alias("time_hint"))
    return c.withColumn("intent", T.intent(F.col("file_score"), F.col("content_score")))


def q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.keywords(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(k, " ").alias("keywords"), F.size(k).cast("long").alias("n"))


def q_lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


def q_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, characters and title (first line, at most 100 characters) of each document."""
    words = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != ""))
    return load(spark, sf_dir, "documents").select("doc_id", words.cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.substring(F.element_at(F.split("text", "\n"), 1), 1, 100).alias("title"))


def q_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir)
    return f.select("doc_id", "extension", T.file_type(F.col("extension")).alias("file_type"), T.type_tag(F.col("extension")).alias("type_tag"))


def q_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below project folders (some of them black-listed) through the directory filter."""
    folders = F.array(*[F.lit(x) for x in ("src", "node_modules", ".git", "docs", "build", "target/keep")])
    p = F.concat(F.lit("/data/"), F.element_at(folders, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")), "path")
    f = documents_as_files(spark, sf_dir).select("doc_id", p.alias("path"))
    return f.withColumn("verdict", T.path_filter(F.col("path"), ["**/keep/**"], T.BLACKLIST))


def q_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.anonymise(F.col("text")).alias("text"))


def q_redact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a log line; secrets, addresses and hosts are blanked."""
    line = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return line.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.redact_log(F.col("line")).alias("line"))


def q_contains_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", (t.rlike(T.EMAIL) | t.rlike(T.IPV4) | t.rlike(T.UNIX_PATH)).alias("sensitive"))


def q_sensitive_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity of each distinct title word as a tag name; keywords count as substrings."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tag")).distinct()
    return words.select("tag", T.sensitivity(F.col("tag")).cast("long").alias("level")).where("level > 0")


def auto_tags(files: DataFrame) -> DataFrame:
    """(doc_id, tag, confidence, status): the type tag and keyword tags, best first; sensitive names wait for approval.

    At most five are assigned, the type tag included; confidence is base + 0.05 a keyword found, at most 1.
    """
    files = files.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).drop("text")
    found = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("low", w)))
    files = files.select("doc_id", "extension", *[found(words).alias(f"n{i}") for i, (_, _, words) in enumerate(T.KEYWORD_TAGS)])
    # sorted by confidence, then by the order of the rules
    rules = [F.struct((-F.round(F.least(F.lit(1.0), F.lit(base) + 0.05 * F.col(f"n{i}")), 6)).alias("order"), F.lit(i + 1).alias("rule"), F.lit(name).alias("tag"), (T.sensitivity(F.lit(name)) > 0).alias("pending"), (F.col(f"n{i}") > 0).alias("hit")) for i, (name, base, _) in enumerate(T.KEYWORD_TAGS)]
    tags = files.select("doc_id", "extension", F.array_sort(F.filter(F.array(*rules), lambda r: r["hit"])).alias("tags"))
    row = lambda r, status: F.struct(r["tag"].alias("tag"), (-r["order"]).alias("confidence"), F.lit(status).alias("status"))
    kind = F.array(F.struct(T.type_tag(F.col("extension")).alias("tag"), F.lit(1.0).alias("confidence"), F.lit("assigned").alias("status")))
    sure = F.transform(F.slice(F.filter("tags", lambda r: ~r["pending"]), 1, 4), lambda r: row(r, "assigned"))
    held = F.transform(F.filter("tags", lambda r: r["pending"]), lambda r: row(r, "pending"))
    return tags.select("doc_id", F.explode(F.concat(kind, sure, held)).alias("r")).select("doc_id", "r.tag", "r.confidence", "r.status")


def q_auto_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto_tags(documents_as_files(spark, sf_dir))


def q_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of every occurrence, overlapping ones too, of a term in each text, without regard to case."""
    return highlights(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), "ion").withColumnRenamed("doc_id", "item_id")


def occurrences(text: str, term: str) -> list[int]:
    """Start of every occurrence, overlapping ones too, of a lower-case term, without regard to case."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    out, at = [], low.find(term)
    while at >= 0:
        out.append(at)
        at = low.find(term, at + 1)
    return out


def highlights(docs: DataFrame, term: str) -> DataFrame:
    """(doc_id, start): every occurrence of the term in the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                found = [occurrences(t, term) for t in b.column("text").to_pylist()]
                row = pa.array([i for i, at in enumerate(found) for _ in at], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), pa.array([x for at in found for x in at], pa.int64())], ["doc_id", "start"])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long")


def q_document_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlights(load(spark, sf_dir, "documents"), "ion")


def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around the first line that holds the term (three on either side), in full."""
    lines = F.split("text", "\n")
    d = load(spark, sf_dir, "documents").where(F.col("text").contains("thtion")).withColumn("lines", lines)
    d = d.withColumn("at", F.expr("cast(array_position(transform(lines, x -> contains(x, 'thtion')), true) as int)"))
    part = F.slice("lines", F.greatest(F.col("at") - 3, F.lit(1)), F.col("at") + 3 - F.greatest(F.col("at") - 3, F.lit(1)) + 1)
    return d.select("doc_id", F.col("at").cast("long").alias("line"), F.array_join(part, "\n").alias("snippet"))


def q_offset_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 characters from the first hit of a term on, with the rest of their lines."""
    d = load(spark, sf_dir, "documents").withColumn("hit", F.instr("text", "thtion") - 1).where("hit >= 0")
    return d.select("doc_id", F.col("hit").cast("long").alias("hit"), T.offset_snippet(F.col("text"), F.col("hit")).alias("snippet"))


def q_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of at most 100 bytes for every text."""
    return load(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("label"))


def q_type_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type tag of each file with its colour and icon."""
    f = documents_as_files(spark, sf_dir).select("doc_id", T.type_tag(F.col("extension")).alias("tag"))
    return f.select("doc_id", "tag", T.named(F.col("tag"), T.TAG_COLOURS).alias("colour"), T.named(F.col("tag"), T.TAG_ICONS).alias("icon"))


def q_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents_as_files(spark, sf_dir)
    return f.select("doc_id", T.human_size(F.col("size_bytes") * 1000).alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


def q_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 words every 128 with a sample of every eighth word (at most 128) as context."""
    w = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    d = load(spark, sf_dir, "documents").select("doc_id", w.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = F.when(F.col("n") <= 512, F.array(F.lit(0))).otherwise(F.slice(F.sequence(F.lit(0), F.col("n") - 1, F.lit(128)), 1, 1001))
    d = d.withColumn("sample", F.array_join(F.slice(F.filter("w", lambda x, i: i % 8 == 0), 1, 128), " ")).select("*", F.posexplode(starts).alias("idx", "start"))
    size = F.when(F.col("n") <= 512, F.col("n")).otherwise(F.lit(256))
    text = F.array_join(F.slice("w", F.col("start") + 1, size), " ")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), F.md5(text).alias("window_md5"), F.md5("sample").alias("sample_md5"))


def _has(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _n(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


_WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> ''))"
_FILES = "(SELECT doc_id, source, lang, text, n_chars, (['txt','md','pdf','docx','xlsx','png','mp4','mp3','py','stl','zip','dat'])[doc_id % 12 + 1] AS ext FROM documents)"


def _case(table: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN lower(ext) IN ({', '.join(repr(k) for k in keys)}) THEN '{name}'" for name, keys in table.items()) + " ELSE 'Other' END"


def _sensitivity(c: str) -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN {_has(f'lower({c})', words)} THEN {level} ELSE 0 END" for _, level, words in T.SENSITIVE) + ")"


_RULES = ", ".join(f"{{'tag': '{n}', 'confidence': least(1.0, {b} + 0.05 * {_n('lower(text)', w)})::DOUBLE, 'hit': {_n('lower(text)', w)} > 0, 'rule': {i + 1}}}" for i, (n, b, w) in enumerate(T.KEYWORD_TAGS))
_GLOBS = "|".join(map(T.glob_regex, T.BLACKLIST)).replace("'", "''")
_ANON = "regexp_replace(regexp_replace(regexp_replace(text, '" + T.UNIX_PATH.replace("'", "''") + "', '[PATH]', 'g'), '" + T.EMAIL + "', '[EMAIL]', 'g'), '" + T.IPV4 + "', '[IP]', 'g')"

QUERIES = {
    "classify_query": q_classify_query, "intent": q_intent, "keywords": q_keywords, "lang_detect": q_lang_detect, "doc_counts": q_doc_counts, "file_type": q_file_type, "glob_filter": q_glob_filter,
    "anonymise": q_anonymise, "redact_log": q_redact_log, "contains_sensitive": q_contains_sensitive, "sensitive_tags": q_sensitive_tags, "auto_tag": q_auto_tag, "highlights": q_highlights, "document_highlights": q_document_highlights, "snippet": q_snippet, "offset_snippet": q_offset_snippet, "truncated": q_truncated, "type_looks": q_type_looks, "human_size": q_human_size, "token_windows": q_token_windows,
}
ORACLE_SQL = {
    "document_highlights": """WITH p AS (SELECT doc_id, unnest(string_split(lower(text), 'ion')) AS p, generate_subscripts(string_split(lower(text), 'ion'), 1) AS k, len(string_split(lower(text), 'ion')) AS n FROM documents)
    SELECT doc_id, start FROM (SELECT doc_id, k, n, CAST(sum(length(p) + 3) OVER (PARTITION BY doc_id ORDER BY k) - 3 AS BIGINT) AS start FROM p) WHERE k < n""",
    "classify_query": rf"""WITH k AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '0x[0-9a-fA-F]+|[0-9]{{4,}}|[A-Z_]{{3,}}|[\p{{L}}\p{{N}}_]+\.[\p{{L}}\p{{N}}_]{{2,4}}') OR contains(text, '"') OR contains(text, '/') OR contains(text, '\') THEN 'ExactKeyword'
      WHEN {_WORDS} >= 3 OR regexp_matches(lower(text), '^({'|'.join(T.QUESTION_WORDS)})') OR {_has('lower(text)', T.SEARCH_WORDS)} THEN 'NaturalLanguage' ELSE 'Mixed' END AS kind FROM conversations)
    SELECT conv_id, turn, kind, CASE kind WHEN 'ExactKeyword' THEN 0.2::DOUBLE WHEN 'NaturalLanguage' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS vector_weight, CASE kind WHEN 'ExactKeyword' THEN 0.8::DOUBLE WHEN 'NaturalLanguage' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS text_weight FROM k""",
    "intent": rf"""WITH s AS (SELECT conv_id, turn, lower(text) AS low, text,
      round(least(1.0, 0.3 * {_n('lower(text)', T.FILE_KEYWORDS)} + 0.2 * {_n('lower(text)', T.FILE_TYPE_WORDS)} + CASE WHEN {_has('lower(text)', ['.pdf', '.doc', '.txt', '.jpg', '.png'])} THEN 0.3 ELSE 0 END + CASE WHEN contains(text, '/') OR contains(text, '\') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS file_score,
      round(least(1.0, 0.3 * {_n('lower(text)', T.CONTENT_KEYWORDS)} + 0.2 * {_n('lower(text)', T.CHUNK_TYPE_WORDS)} + CASE WHEN contains(text, '"') THEN 0.3 ELSE 0 END + CASE WHEN {_WORDS} > 5 THEN 0.1 ELSE 0 END + CASE WHEN {_WORDS} > 10 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS content_score FROM conversations)
    SELECT conv_id, turn, file_score, content_score, CASE {' '.join(f"WHEN contains(low, '{w}') THEN '{h}'" for w, h in T.TIME_WORDS)} END AS time_hint,
      CASE WHEN abs(file_score - content_score) < 0.15 AND greatest(file_score, content_score) < 0.4 THEN 'Ambiguous' WHEN file_score >= content_score THEN 'File' ELSE 'Content' END AS intent FROM s""",
    "keywords": r"""WITH k AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s!-/:-@\[-`{-~]+'), lambda w: strlen(w) > 1 AND NOT list_contains([%s], lower(w))) AS k FROM conversations)
    SELECT conv_id, turn, array_to_string(k, ' ') AS keywords, len(k) AS n FROM k""" % ", ".join(f"'{w}'" for w in T.STOP_WORDS),
    "lang_detect": r"""WITH s AS (SELECT doc_id, length(regexp_replace(text, '[\s!-/:-@\[-`{-~]', '', 'g')) AS total, length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) AS j, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS c, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS e FROM documents)
    SELECT doc_id, CASE WHEN j > 0.1 * total THEN 'Japanese' WHEN c > 0.3 * total THEN 'Chinese' WHEN e > 0.5 * total THEN 'English' ELSE 'Unknown' END AS language FROM s""",
    "doc_counts": f"SELECT doc_id, {_WORDS} AS words, length(text) AS chars, substring(split_part(text, chr(10), 1), 1, 100) AS title FROM documents",
    "file_type": f"SELECT doc_id, ext AS extension, {_case(T.FILE_TYPES)} AS file_type, {_case(T.TYPE_TAGS)} AS type_tag FROM {_FILES}",
    "glob_filter": f"""WITH p AS (SELECT doc_id, '/data/' || (['src','node_modules','.git','docs','build','target/keep'])[doc_id % 6 + 1] || '/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext AS path FROM {_FILES})
    SELECT doc_id, path, CASE WHEN regexp_matches(path, '{T.glob_regex('**/keep/**')}') THEN 'Include' WHEN regexp_matches(path, '{_GLOBS}') THEN 'Blacklisted' WHEN len(string_split(path, '/')) > 20 THEN 'TooDeep' ELSE 'Include' END AS verdict FROM p""",
    "anonymise": f"SELECT doc_id, {_ANON} AS text FROM documents",
    "redact_log": f"""SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '{T.SECRET.replace("'", "''")}', '\\1=[REDACTED]', 'g'), '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IPV4}', '[IP]', 'g') AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)""",
    "contains_sensitive": f"""SELECT doc_id, regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.IPV4}') OR regexp_matches(text, '{T.UNIX_PATH.replace("'", "''")}') AS sensitive FROM documents""",
    "sensitive_tags": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS tag FROM documents) SELECT tag, CAST({_sensitivity('tag')} AS BIGINT) AS level FROM w WHERE {_sensitivity('tag')} > 0",
    "auto_tag": f"""WITH r AS (SELECT doc_id, unnest([{{'tag': {_case(T.TYPE_TAGS)}, 'confidence': 1.0::DOUBLE, 'hit': true, 'rule': 0}}, {_RULES}]) AS r FROM {_FILES}),
    t AS (SELECT doc_id, r.tag AS tag, round(r.confidence, 6) AS confidence, r.rule AS rule, {_sensitivity('r.tag')} > 0 AND r.rule > 0 AS pending FROM r WHERE r.hit),
    a AS (SELECT *, sum(CASE WHEN pending THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY rule > 0, confidence DESC, rule) AS assigned FROM t)
    SELECT doc_id, tag, confidence, CASE WHEN pending THEN 'pending' ELSE 'assigned' END AS status FROM a WHERE pending OR assigned <= 5""",
    "highlights": "SELECT item_id, i - 1 AS start FROM (SELECT item_id, lower(text) AS low, unnest(range(1, greatest(length(text) - 1, 2))) AS i FROM benchmark) WHERE substring(low, i, 3) = 'ion'",
    "snippet": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE contains(text, 'thtion')), p AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, 'thtion')), true) AS pos FROM l)
    SELECT doc_id, CAST(pos AS BIGINT) AS line, array_to_string(lines[greatest(pos - 3, 1):pos + 3], chr(10)) AS snippet FROM p""",
    "offset_snippet": """WITH h AS (SELECT doc_id, text, instr(text, 'thtion') - 1 AS hit FROM documents WHERE contains(text, 'thtion'))
    SELECT doc_id, hit, string_split(substring(text, 1, hit), chr(10))[-1] || substring(text, hit + 1, 500) || split_part(substring(text, hit + 501), chr(10), 1) AS snippet FROM h""",
    "truncated": """SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(0, 98), lambda k: strlen(left(text, k)) <= 97))) || '...' END AS label FROM documents""",
    "type_looks": f"WITH f AS (SELECT doc_id, {_case(T.TYPE_TAGS)} AS tag FROM {_FILES}) SELECT doc_id, tag, CASE tag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TAG_COLOURS.items())} END AS colour, CASE tag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TAG_ICONS.items())} END AS icon FROM f",
    "human_size": """WITH s AS (SELECT doc_id, text, n_chars * 1000 AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', round(n / 1073741824.0, 2)) WHEN n >= 1048576 THEN printf('%.2f MB', round(n / 1048576.0, 2)) WHEN n >= 1024 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE n || ' B' END AS size, sha256(text) AS content_hash FROM s""",
    "token_windows": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
    s AS (SELECT *, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, n, 128)[1:1001] END) AS start FROM n)
    SELECT doc_id, CAST(start // 128 AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, md5(array_to_string(w[start + 1:start + CASE WHEN n <= 512 THEN n ELSE 256 END], ' ')) AS window_md5,
      md5(array_to_string(list_transform(range(1, n + 1, 8)[1:128], lambda i: w[i]), ' ')) AS sample_md5 FROM s""",
}
