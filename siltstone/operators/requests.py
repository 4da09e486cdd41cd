"""What a request means: hints, clarifications, suggestions, request words, prompts and replies; full anonymisation; lookups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.text_rules import ORACLE_SQL as TEXT_SQL
from siltstone.sources.scratch import small_batches
from siltstone.sources.tables import documents_as_files, file_extension, load

# Hints in the order in which they are tried, request words, questions, languages and folders.
FILE_HINTS = [
    ("pdf", "Pdf"), ("document", "TextDocument"), ("doc", "OfficeDocument"), ("docx", "OfficeDocument"), ("image", "Image"), ("photo", "Image"), ("picture", "Image"), ("video", "Video"), ("movie", "Video"), ("code", "Code"), ("source", "Code"), ("script", "Code"),
    ("model", "Model3D"), ("3d", "Model3D"), ("图片", "Image"), ("照片", "Image"), ("视频", "Video"), ("代码", "Code"), ("文档", "TextDocument"),
]
CHUNK_HINTS = [
    ("paragraph", "Paragraph"), ("heading", "Heading"), ("title", "Heading"), ("code", "CodeBlock"), ("function", "CodeBlock"), ("table", "Table"), ("image", "Image"), ("caption", "Caption"),
    ("段落", "Paragraph"), ("标题", "Heading"), ("代码", "CodeBlock"), ("函数", "CodeBlock"), ("表格", "Table"), ("图片", "Image"),
]
#: Texts whose words are found at a time.  White space as Python's \s has it: bytes, and characters of two and three bytes.
SLICE = 256
WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
WIDE_WHITE = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
TAG_TYPES = {"category": "Category", "filetype": "FileType", "file_type": "FileType", "project": "Project", "status": "Status", "autogenerated": "AutoGenerated", "auto_generated": "AutoGenerated"}
RELATION_TYPES = {
    "content_similar": "ContentSimilar", "similar": "ContentSimilar", "same_session": "SameSession", "session": "SameSession", "same_project": "SameProject", "project": "SameProject", "same_author": "SameAuthor", "author": "SameAuthor",
    "reference": "Reference", "ref": "Reference", "derivative": "Derivative", "workflow": "Workflow", "user_defined": "UserDefined", "custom": "UserDefined",
}
BLOCK_SCOPES = {"this_pair_only": "ThisPairOnly", "pair": "ThisPairOnly", "source_to_target_tag": "SourceToTargetTag", "file_to_tag": "SourceToTargetTag", "tag_to_tag": "TagToTag"}
QUESTIONS = ['Are you looking for a specific file or content within files related to "{}"?', "What type of file are you looking for? (document, image, code, etc.)", "Are you looking for recent files or older ones?"]
SUGGESTED_TYPES = [("pdf", "PDF Documents"), ("doc", "Word Documents"), ("image", "Images"), ("video", "Videos"), ("code", "Source Code"), ("audio", "Audio Files")]
LANGUAGES = {
    "Rust": ["rs"], "Python": ["py"], "JavaScript": ["js"], "TypeScript": ["ts"], "JavaScript (JSX)": ["jsx"], "TypeScript (TSX)": ["tsx"], "Java": ["java"], "C": ["c"], "C++": ["cpp", "cc", "cxx"], "C/C++ Header": ["h", "hpp"], "C#": ["cs"], "Go": ["go"],
    "Ruby": ["rb"], "PHP": ["php"], "Swift": ["swift"], "Kotlin": ["kt"], "Scala": ["scala"], "HTML": ["html"], "CSS": ["css"], "SCSS": ["scss"], "SQL": ["sql"], "Shell": ["sh", "bash", "zsh"], "PowerShell": ["ps1"], "Batch": ["bat", "cmd"],
}
NAMED_FOLDERS = {"Desktop": "[DESKTOP]", "Documents": "[DOCUMENTS]", "Downloads": "[DOWNLOADS]", "Pictures": "[PICTURES]", "Videos": "[VIDEOS]", "Music": "[MUSIC]", "AppData": "[APPDATA]", ".config": "[CONFIG]", ".local": "[LOCAL]"}
IPV6 = r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"


def first_hint(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first listed word that the lower-cased text holds; null if none."""
    return F.coalesce(*[F.when(F.lower(text).contains(word), value) for word, value in table])


def parse_intent(text: Column) -> Column:
    """Struct: intent (Ambiguous, File or Content), confidence, hints, what it may be, and questions if ambiguous."""
    file, content = T.intent_scores(text)
    kind = T.intent(file, content)
    unclear = kind == "Ambiguous"
    return F.struct(
        kind.alias("intent"), F.round(F.greatest(file, content), 6).alias("confidence"), first_hint(text, FILE_HINTS).alias("file_type"), first_hint(text, CHUNK_HINTS).alias("chunk_type"), T.time_hint(text).alias("time"),
        F.when(unclear, F.array(F.lit("File"), F.lit("Content"))).alias("possible"),
        F.when(unclear, F.array(F.concat(F.lit(QUESTIONS[0].split("{}")[0]), text, F.lit(QUESTIONS[0].split("{}")[1])), *[F.lit(q) for q in QUESTIONS[1:]])).alias("questions"))


def category(text: Column) -> Column:
    """The second classifier: Ambiguous if the scores are within 0.2 and both under 0.5; File only if strictly ahead."""
    file, content = T.intent_scores(text)
    return F.when((F.abs(file - content) < 0.2) & (file < 0.5) & (content < 0.5), "Ambiguous").when(file > content, "File").otherwise("Content")


def q_intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", parse_intent(F.col("text")).alias("p"), category(F.col("text")).alias("category"))
    none = lambda k: F.coalesce(f"p.{k}", F.lit("-"))
    return c.select("conv_id", "turn", "category", "p.intent", "p.confidence", none("file_type").alias("file_type"), none("chunk_type").alias("chunk_type"), none("time").alias("time"), F.coalesce(F.md5(F.array_join("p.questions", "\n")), F.lit("-")).alias("questions_md5"), F.coalesce(F.array_join("p.possible", "|"), F.lit("-")).alias("possible"))


def suggestions(query: Column, most: int = 10) -> Column:
    """Texts of suggestions: at most three file types, the query as a tag (two bytes or more), two completions."""
    low = F.lower(query)
    types = F.filter(F.array(*[F.when(F.lit(k).contains(low) | low.contains(k), F.lit("type:" + name.lower().replace(" ", "_"))) for k, name in SUGGESTED_TYPES]), lambda x: x.isNotNull())
    tag = F.when(F.octet_length(low) >= 2, F.array(F.concat(F.lit("tag:"), query))).otherwise(F.array().cast("array<string>"))
    more = F.when(query != "", F.array(F.concat(query, F.lit(" files")), F.concat(query, F.lit(" content")))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(F.slice(types, 1, 3), tag, more), 1, most)


def q_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is suggested for the first three characters, and for the first word, of each turn."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.lower(F.substring("text", 1, 3)), F.element_at(F.split("text", " "), 1), F.lit("doc"))).alias("query"))
    return c.select("conv_id", "turn", "query", F.array_join(suggestions(F.col("query")), "|").alias("suggested"))


def q_request_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions and other words as request words: file type, tag type, relation type and scope; unknown ones are '-' (tags: Custom)."""
    words = [*T.REQUEST_TYPES, *TAG_TYPES, *RELATION_TYPES, *BLOCK_SCOPES, "unknown"]
    w = load(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x.upper() if i % 3 == 0 else x) for i, x in enumerate(words)]), (F.pmod("doc_id", F.lit(len(words))) + 1).cast("int")).alias("word"))
    of = lambda table, other: F.coalesce(*[F.when(F.lower("word") == k, v) for k, v in table.items()], F.lit(other))
    return w.select("doc_id", of(T.REQUEST_TYPES, "-").alias("file_type"), of(TAG_TYPES, "Custom").alias("tag_type"), of(RELATION_TYPES, "-").alias("relation_type"), of(BLOCK_SCOPES, "-").alias("scope"))


def q_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programming language of each extension, as the files and the list of known ones have it."""
    known = F.array(*[F.lit(x) for names in LANGUAGES.values() for x in names])
    n = sum(map(len, LANGUAGES.values()))
    f = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.upper(file_extension()), F.element_at(known, (F.pmod("doc_id", F.lit(n)) + 1).cast("int")))).alias("extension"))
    return f.select("doc_id", "extension", T.lookup(F.lower("extension"), LANGUAGES, "Unknown").alias("language"))


def prompt(query: Column, tags: Column, intent: Column, n_recent: Column, summary: Column, searches: Column) -> Column:
    """The text that asks a language model about a query; null summary and empty lists have their own words."""
    kind = F.when(intent["intent"] == "File", F.concat(F.lit("查找文件"), F.coalesce(F.concat(F.lit(" (类型: "), intent["file_type"], F.lit(")")), F.lit("")), F.when(intent["time"].isNotNull(), " (有时间限制)").otherwise("")))
    kind = kind.when(intent["intent"] == "Content", F.concat(F.lit("查找内容"), F.coalesce(F.concat(F.lit(" (类型: "), intent["chunk_type"], F.lit(")")), F.lit("")), F.lit(" (需要定位)"))).otherwise("意图不明确")
    none = F.lit("无")
    recent = F.when(F.size(searches) > 0, F.concat(F.lit("- 最近搜索: "), F.array_join(F.slice(searches, 1, 3), ", "), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit('用户查询: "'), query, F.lit('"\n\n上下文信息:\n- 相关标签: '), F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(none), F.lit("\n- 解析意图: "), kind, F.lit("\n- 最近访问文件数: "), n_recent.cast("string"),
        F.lit("\n- 文件结构: "), F.coalesce(summary, none), F.lit("\n"), recent, F.lit("\n请分析用户意图并提供搜索建议。"))


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each turn; its tags are its first two keywords, the searches before it its conversation's number."""
    c = load(spark, sf_dir, "conversations")
    tags = F.slice(T.keywords(F.col("text")), 1, 2)
    searches = F.when(F.col("turn") > 0, F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))).otherwise(F.array().cast("array<string>"))
    summary = F.when(F.col("conv_id") % 2 == 0, F.concat(F.col("role"), F.lit(" files")))
    p = prompt(F.col("text"), tags, parse_intent(F.col("text")), F.col("turn"), summary, searches)
    return c.select("conv_id", "turn", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("n_chars"))


def reply(content: Column) -> Column:
    """A model's reply: its JSON, or the raw text as intent with confidence 0.5."""
    r = F.from_json(content, "refined_intent string, suggested_terms array<string>, confidence double, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    good = F.try_parse_json(content).isNotNull() & content.startswith("{")
    return F.struct(F.when(good, r["refined_intent"]).otherwise(content).alias("intent"), F.when(good, F.coalesce(r["suggested_terms"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("terms"), F.coalesce(F.when(good, r["confidence"]), F.lit(0.5)).alias("confidence"))


def q_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies: even conversations answer in JSON, odd ones in plain text."""
    c = load(spark, sf_dir, "conversations")
    json = F.to_json(F.struct(F.concat(F.lit("about "), "role").alias("refined_intent"), F.array("role", F.lit("x")).alias("suggested_terms"), F.when(F.col("turn") > 0, 0.9).alias("confidence")))
    c = c.select("conv_id", "turn", reply(F.when(F.col("conv_id") % 2 == 0, json).otherwise(F.col("text"))).alias("r"))
    return c.select("conv_id", "turn", F.md5("r.intent").alias("intent_md5"), F.array_join("r.terms", ",").alias("terms"), F.col("r.confidence").alias("confidence"))


def anonymise_fully(text: Column, user: str = "", home: str = "", preserve: tuple[str, ...] = (), custom: tuple[str, ...] = ()) -> Column:
    """User names, then paths, e-mail addresses, IP addresses and custom patterns (``[CUSTOM_i]``).

    ``user`` goes in any case, whoever owns a home folder too, unless the name is to be preserved; of a
    path only its well-known folders are replaced, as whole components.
    """
    out = text
    if user and user not in preserve:
        out = F.regexp_replace(out, "(?i)" + re.escape(user), "[USER]")
    kept = "|".join(re.escape(p) for p in preserve)
    for lead, rest in ((r"\\Users\\", r"[^\\]+"), ("/home/", "[^/]+"), ("/Users/", "[^/]+")):
        guard = rf"(?!(?:{kept})(?:[/\\]|$))" if kept else ""
        out = F.regexp_replace(out, f"{lead}{guard}{rest}", lead.replace("\\", "\\\\" if "\\\\" not in lead else "\\") + "[USER]")
    if home:
        out = F.replace(out, F.lit(home), F.lit("[HOME]"))
    for folder, mark in NAMED_FOLDERS.items():
        name = re.escape(folder)
        out = F.regexp_replace(out, rf"(/(?:home|Users|var|tmp|etc)/(?:[^\s\"'/]+/)*){name}([/\s\"']|$)", "$1" + mark.replace("[", "\\[") + "$2")
        out = F.regexp_replace(out, rf"([A-Za-z]:\\(?:[^\s\"'\\]+\\)*){name}([\\\s\"']|$)", "$1" + mark.replace("[", "\\[") + "$2")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, T.EMAIL, "[EMAIL]"), T.IPV4, "[IP]"), IPV6, "[IP]")
    for i, pattern in enumerate(custom):
        out = F.regexp_replace(out, pattern, f"[CUSTOM_{i}]")
    return out


def q_anonymise_fully(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text behind a path of its own, with a user, a preserved owner and a custom pattern."""
    path = F.concat(F.element_at(F.array(F.lit("/home/ann"), F.lit("/home/public"), F.lit("/Users/bob")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.lit("/Documents/x/Music "))
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(path, F.lit("ticket-"), F.col("doc_id").cast("string"), F.lit(" by Erin "), "text").alias("text"))
    return d.select("doc_id", anonymise_fully(F.col("text"), "erin", preserve=("public",), custom=("ticket-[0-9]+",)).alias("text"))


def language_tokens(text: Column) -> Column:
    """Tokens by language: character bigrams for Chinese and Japanese (in place of a dictionary, which is not the same), words else; none over 40 bytes."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+|[a-zA-Z0-9_]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-zA-Z0-9_]") | (F.length(r) < 2), F.array(F.lower(r))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(T.language(text).isin("Chinese", "Japanese"), F.filter(pairs, lambda w: F.octet_length(w) <= 40)).otherwise(T.analysed(text))


def q_language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and of its ids written in Chinese: how many, and a digest of them."""
    d = load(spark, sf_dir, "documents")
    cn = F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九")
    rows = d.select("doc_id", F.explode(F.array(F.struct(F.lit("text").alias("of"), F.col("text").alias("t")), F.struct(F.lit("id").alias("of"), cn.alias("t")))).alias("r"))
    k = rows.select("doc_id", "r.of", language_tokens(F.col("r.t")).alias("k"))
    return k.select("doc_id", "of", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens_md5"))


def ink(text: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts, one after the other, are not of white space."""
    out = ~WHITE[text]
    wide = np.flatnonzero(np.isin(text, [0xC2, 0xE1, 0xE2, 0xE3]))
    for n in (2, 3) if len(wide) else ():
        at = wide[(text[wide] >= 0xE1) == (n == 3)]
        blank = at[np.isin(sum(text[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n)), WIDE_WHITE)]
        for k in range(n):
            out[blank + k] = False
    return out


def spans(texts: pa.Array) -> pa.ListArray:
    """(start, end) of the words of each text in bytes, from the buffer that holds all of them; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    to = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    text = np.frombuffer(held, np.uint8)[to[0] : to[-1]] if held is not None else np.zeros(0, np.uint8)
    to = to - to[0]
    full = ink(text)
    bounds = np.zeros(len(text) + 1, bool)  # no word passes from one text to the next
    bounds[to] = True
    starts = np.flatnonzero(full & (bounds[:-1] | ~np.append(False, full[:-1])))
    ends = np.flatnonzero(full & (bounds[1:] | ~np.append(full[1:], False))) + 1
    held_to = np.searchsorted(starts, to)
    before = np.repeat(to[:-1], np.diff(held_to))
    return pa.ListArray.from_arrays(held_to.astype(np.int32), pa.StructArray.from_arrays([starts - before, ends - before], ["start", "end"]))


def word_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, words): (start, end) of every word in bytes of the UTF-8 text; ``SLICE`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([b.column(0), spans(b.column(1))], ["doc_id", "words"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, words array<struct<start:bigint,end:bigint>>")


def q_word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text, where the last one ends, and the sum of all starts."""
    w = word_offsets(load(spark, sf_dir, "documents"))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["start"])
    return w.select("doc_id", F.size("words").cast("long").alias("n"), F.coalesce(F.try_element_at("words", F.lit(-1))["end"], F.lit(0)).alias("last_end"), total.alias("starts"))


def parts_of(docs: DataFrame, sep: str, trim: str = "", most: int = 100) -> DataFrame:
    """(doc_id, number, start, end, preview) of the parts of each text between ``sep``, offsets in characters.

    With ``trim``, these characters go from both ends of a part, and parts of nothing else are left out
    and not counted; without it, every part stays.  One pass over each text, no shuffle; null texts have no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                row, number, start, end, preview = [], [], [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    at = n = 0
                    for p in text.split(sep):
                        left = p.lstrip(trim) if trim else p
                        bare = left.rstrip(trim) if trim else p
                        if bare or not trim:
                            row.append(i)
                            number.append(n)
                            start.append(at + len(p) - len(left))
                            end.append(start[-1] + len(bare))
                            preview.append(bare[:most])
                            n += 1
                        at += len(p) + len(sep)
                longs = [pa.array(c, pa.int64()) for c in (number, start, end)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *longs, pa.array(preview, pa.string())], ["doc_id", "number", "start", "end", "preview"])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, number long, start long, end long, preview string")


def blocks(docs: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id, number, start, end, preview): paragraphs between blank lines, trimmed; empty ones are left out."""
    return parts_of(docs, "\n\n", " \n", most)


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the conversations, each one text of turns with blank lines between."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n ").alias("text"))
    return blocks(c.withColumnRenamed("conv_id", "doc_id"))


def q_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five lines as pages around a target page (the middle), and how many there are."""
    pages = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("p")).withColumn("n", F.size("p")).withColumn("target", F.floor((F.col("n") + 1) / 2).cast("int"))
    first = F.greatest(F.lit(1), F.least(F.col("target") - 2, F.col("n") - 4))
    return pages.select("doc_id", F.col("n").cast("long").alias("pages"), first.cast("long").alias("first"), F.md5(F.array_join(F.slice("p", first, F.lit(5)), "\f")).alias("pages_md5"))


def q_vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document id looked up among the vectors: whether it exists, score 1 if so."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("there"))
    return load(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("exists"), F.when(F.col("there"), 1.0).otherwise(0.0).alias("score"), F.coalesce("label", F.lit(-1)).alias("label"))


def q_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows with a vector, and the newest id of each language."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("file_id"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(v, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("files"), F.count("file_id").alias("indexed"), F.max("doc_id").alias("newest"))


def q_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not excluded by the folder they lie in."""
    folders = F.array(*[F.lit(x) for x in ("src", "node_modules", ".git", "docs", "build", "target/keep")])
    f = documents_as_files(spark, sf_dir).select("doc_id", F.concat(F.lit("/data/"), F.element_at(folders, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")), "path").alias("path"))
    return f.withColumn("is_excluded", T.path_filter(F.col("path"), ["**/keep/**"], T.BLACKLIST) != "Include").where("NOT is_excluded").select("doc_id", "path")


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, position, value): the mean vector of each key, scaled to length 1 unless it is shorter than 1e-8."""
    parts = rows.select(key, F.posexplode(vector).alias("position", "x")).groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return parts.join(norm, key).select(key, F.col("position").cast("long").alias("position"), F.when(F.col("norm") > 1e-8, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"))


def q_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_pool(load(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


def _hint(table: list[tuple[str, str]]) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{h}'" for w, h in table) + " END, '-')"


def _map(table: dict[str, str], other: str) -> str:
    return "CASE lower(word) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


_WORDS = [*T.REQUEST_TYPES, *TAG_TYPES, *RELATION_TYPES, *BLOCK_SCOPES, "unknown"]
_KNOWN = [x for names in LANGUAGES.values() for x in names]
_INTENT = f"""i AS ({TEXT_SQL['intent']}), s AS (SELECT i.*, c.text, c.role, lower(c.text) AS low FROM i JOIN conversations c USING (conv_id, turn))"""
_ASK = QUESTIONS[0].split("{}")
_QS = f"'{_ASK[0]}' || text || '{_ASK[1]}' || chr(10) || '{QUESTIONS[1]}' || chr(10) || '{QUESTIONS[2]}'"
_EXT = "(['txt','md','pdf','docx','xlsx','png','mp4','mp3','py','stl','zip','dat'])[doc_id % 12 + 1]"

QUERIES = {
    "intent_parse": q_intent_parse, "suggestions": q_suggestions, "request_words": q_request_words, "code_language": q_code_language, "prompts": q_prompts, "replies": q_replies, "anonymise_fully": q_anonymise_fully, "language_tokens": q_language_tokens,
    "word_offsets": q_word_offsets, "blocks": q_blocks, "page_slice": q_page_slice, "vector_lookup": q_vector_lookup, "index_counts": q_index_counts, "indexable": q_indexable, "mean_pool": q_mean_pool,
}
ORACLE_SQL = {
    "blocks": """WITH t AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) || ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1),
    p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM t),
    o AS (SELECT doc_id, k, length(p) - length(ltrim(p, ' ' || chr(10))) + coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, trim(p, ' ' || chr(10)) AS t FROM p)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS number, CAST(start AS BIGINT) AS start, CAST(start + length(t) AS BIGINT) AS "end", substring(t, 1, 100) AS preview FROM o WHERE t <> ''""",
    "intent_parse": f"""WITH {_INTENT} SELECT conv_id, turn, CASE WHEN abs(file_score - content_score) < 0.2 AND file_score < 0.5 AND content_score < 0.5 THEN 'Ambiguous' WHEN file_score > content_score THEN 'File' ELSE 'Content' END AS category, intent, greatest(file_score, content_score) AS confidence,
    {_hint(FILE_HINTS)} AS file_type, {_hint(CHUNK_HINTS)} AS chunk_type, coalesce(time_hint, '-') AS time, CASE WHEN intent = 'Ambiguous' THEN md5({_QS}) ELSE '-' END AS questions_md5, CASE WHEN intent = 'Ambiguous' THEN 'File|Content' ELSE '-' END AS possible FROM s""",
    "suggestions": f"""WITH q AS (SELECT conv_id, turn, unnest([lower(substring(text, 1, 3)), split_part(text, ' ', 1), 'doc']) AS query FROM conversations)
    SELECT conv_id, turn, query, array_to_string(list_concat(list_concat(list_filter([{', '.join(f"CASE WHEN contains('{k}', lower(query)) OR contains(lower(query), '{k}') THEN 'type:{n.lower().replace(' ', '_')}' END" for k, n in SUGGESTED_TYPES)}], lambda x: x IS NOT NULL)[1:3],
      CASE WHEN strlen(lower(query)) >= 2 THEN ['tag:' || query] ELSE [] END), CASE WHEN query <> '' THEN [query || ' files', query || ' content'] ELSE [] END)[1:10], '|') AS suggested FROM q""",
    "request_words": f"""WITH w AS (SELECT doc_id, ([{', '.join(f"'{x.upper() if i % 3 == 0 else x}'" for i, x in enumerate(_WORDS))}])[doc_id % {len(_WORDS)} + 1] AS word FROM documents)
    SELECT doc_id, {_map(T.REQUEST_TYPES, '-')} AS file_type, {_map(TAG_TYPES, 'Custom')} AS tag_type, {_map(RELATION_TYPES, '-')} AS relation_type, {_map(BLOCK_SCOPES, '-')} AS scope FROM w""",
    "code_language": f"""WITH e AS (SELECT doc_id, unnest([upper({_EXT}), ([{', '.join(map(repr, _KNOWN))}])[doc_id % {len(_KNOWN)} + 1]]) AS extension FROM documents)
    SELECT doc_id, extension, CASE lower(extension) {' '.join(f"WHEN '{x}' THEN '{n}'" for n, names in LANGUAGES.items() for x in names)} ELSE 'Unknown' END AS language FROM e""",
    "prompts": f"""WITH {_INTENT}, k AS ({TEXT_SQL['keywords']}), h AS (SELECT s.*, {_hint(FILE_HINTS)} AS ft, {_hint(CHUNK_HINTS)} AS ct, string_split(k.keywords, ' ') AS kw, k.n AS nk FROM s JOIN k USING (conv_id, turn)),
    p AS (SELECT conv_id, turn, '用户查询: "' || text || '"' || chr(10) || chr(10) || '上下文信息:' || chr(10) || '- 相关标签: ' || CASE WHEN nk > 0 THEN array_to_string(kw[1:2], ', ') ELSE '无' END || chr(10) || '- 解析意图: '
      || CASE intent WHEN 'File' THEN '查找文件' || CASE WHEN ft <> '-' THEN ' (类型: ' || ft || ')' ELSE '' END || CASE WHEN time_hint IS NOT NULL THEN ' (有时间限制)' ELSE '' END WHEN 'Content' THEN '查找内容' || CASE WHEN ct <> '-' THEN ' (类型: ' || ct || ')' ELSE '' END || ' (需要定位)' ELSE '意图不明确' END
      || chr(10) || '- 最近访问文件数: ' || turn || chr(10) || '- 文件结构: ' || CASE WHEN conv_id % 2 = 0 THEN role || ' files' ELSE '无' END || chr(10) || CASE WHEN turn > 0 THEN '- 最近搜索: ' || conv_id || ', ' || turn || chr(10) ELSE '' END || chr(10) || '请分析用户意图并提供搜索建议。' AS p FROM h)
    SELECT conv_id, turn, md5(p) AS prompt_md5, length(p) AS n_chars FROM p""",
    "replies": "SELECT conv_id, turn, md5(CASE WHEN conv_id % 2 = 0 THEN 'about ' || role ELSE text END) AS intent_md5, CASE WHEN conv_id % 2 = 0 THEN role || ',x' ELSE '' END AS terms, CASE WHEN conv_id % 2 = 0 AND turn > 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM conversations",
    "anonymise_fully": f"""WITH d AS (SELECT doc_id, (['/home/[USER]', '/home/public', '/Users/[USER]'])[doc_id % 3 + 1] || '/[DOCUMENTS]/x/[MUSIC] ticket-' || doc_id || ' by [USER] ' || regexp_replace(text, 'erin', '[USER]', 'gi') AS text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IPV4}', '[IP]', 'g'), '{IPV6}', '[IP]', 'g'), 'ticket-[0-9]+', '[CUSTOM_0]', 'g') AS text FROM d""",
    "language_tokens": f"""WITH t AS (SELECT doc_id, 'text' AS of, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}'), lambda w: strlen(w) <= 40) AS k FROM documents),
    c AS (SELECT doc_id, translate(CAST(doc_id AS VARCHAR), '0123456789', '零一二三四五六七八九') AS s FROM documents), i AS (SELECT doc_id, 'id' AS of, CASE WHEN length(s) < 2 THEN [s] ELSE list_transform(range(1, length(s)), lambda j: substring(s, j, 2)) END AS k FROM c)
    SELECT doc_id, of, len(k) AS n, md5(array_to_string(k, ' ')) AS tokens_md5 FROM (SELECT * FROM t UNION ALL SELECT * FROM i)""",
    "page_slice": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT *, greatest(1, least((n + 1) // 2 - 2, n - 4)) AS first FROM p)
    SELECT doc_id, CAST(n AS BIGINT) AS pages, CAST(first AS BIGINT) AS first, md5(array_to_string(p[first:first + 4], chr(12))) AS pages_md5 FROM f""",
    "vector_lookup": "SELECT doc_id, vec_id IS NOT NULL AS exists, CASE WHEN vec_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, coalesce(label, -1) AS label FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "index_counts": "SELECT lang, count(*) AS files, count(vec_id) AS indexed, max(doc_id) AS newest FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "indexable": f"WITH g AS ({TEXT_SQL['glob_filter']}) SELECT doc_id, path FROM g WHERE verdict = 'Include'",
    "mean_pool": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, position, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
    SELECT label, position, round(CASE WHEN norm > 1e-8 THEN m / norm ELSE m END, 6) AS value FROM m JOIN n USING (label)""",
}
