"""Text rules of search, tagging and anonymisation as column expressions (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Word lists, tables and patterns of the rules.
QUESTION_WORDS = ["what", "where", "how", "why", "when", "which", "who"]
SEARCH_WORDS = ["find", "search", "look for", "show me", "get", "locate", "找", "搜索", "查找", "显示", "获取"]
FILE_KEYWORDS = ["file", "document", "find file", "where is", "locate", "文件", "文档", "找文件", "在哪", "哪个文件", "ファイル", "書類"]
CONTENT_KEYWORDS = ["content", "text", "paragraph", "section", "quote", "mention", "says", "contains", "written", "about", "describes", "内容", "段落", "提到", "写着", "关于", "描述", "内容", "段落", "書いてある"]
FILE_TYPE_WORDS = ["pdf", "document", "doc", "docx", "image", "photo", "picture", "video", "movie", "code", "source", "script", "model", "3d", "图片", "照片", "视频", "代码", "文档"]
CHUNK_TYPE_WORDS = ["paragraph", "heading", "title", "code", "function", "table", "image", "caption", "段落", "标题", "代码", "函数", "表格", "图片"]
TIME_WORDS = [
    ("recent", "Recent"), ("latest", "Recent"), ("new", "Recent"), ("today", "Today"), ("yesterday", "Yesterday"), ("this week", "ThisWeek"), ("this month", "ThisMonth"), ("old", "Old"), ("archive", "Old"),
    ("最近", "Recent"), ("最新", "Recent"), ("今天", "Today"), ("昨天", "Yesterday"), ("本周", "ThisWeek"), ("这周", "ThisWeek"), ("本月", "ThisMonth"), ("这个月", "ThisMonth"), ("旧的", "Old"),
]
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just and but if or because until while this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom find search look get show give"
).split()
SENSITIVE = [
    ("personal_info", 3, ["personal", "private", "confidential", "secret", "password", "credential"]),
    ("financial", 3, ["bank", "account", "tax", "salary", "income", "investment", "credit"]),
    ("health", 3, ["medical", "health", "diagnosis", "prescription", "treatment", "hospital", "doctor"]),
    ("legal", 2, ["legal", "contract", "agreement", "lawsuit", "attorney", "court"]),
    ("work_sensitive", 3, ["nda", "proprietary", "internal", "restricted", "classified"]),
    ("identity", 3, ["passport", "license", "ssn", "social security", "id card", "birth certificate"]),
    ("relationship", 2, ["divorce", "custody", "will", "testament", "inheritance"]),
]
LEVELS = ["None", "Low", "Medium", "High"]
FILE_TYPES = {
    "TextDocument": ["txt", "md", "markdown", "rst", "rtf"],
    "Pdf": ["pdf"],
    "OfficeDocument": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp"],
    "Image": ["png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "ico", "tiff"],
    "Video": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm"],
    "Audio": ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a"],
    "Code": "rs py js ts jsx tsx java c cpp h hpp cs go rb php swift kt scala html css scss json yaml yml toml xml sql".split(),
    "Model3D": ["obj", "fbx", "gltf", "glb", "stl", "3ds", "blend"],
    "Archive": ["zip", "tar", "gz", "7z", "rar", "bz2", "xz"],
}
TYPE_TAGS = {
    "Documents": ["pdf", "doc", "docx"],
    "Spreadsheets": ["xls", "xlsx"],
    "Presentations": ["ppt", "pptx"],
    "Text": ["txt", "md"],
    "Images": ["jpg", "jpeg", "png", "gif", "webp", "svg"],
    "Videos": ["mp4", "avi", "mov", "mkv"],
    "Audio": ["mp3", "wav", "flac", "ogg"],
    "Code": ["rs", "py", "js", "ts", "java", "cpp", "c", "go"],
    "Archives": ["zip", "rar", "7z", "tar", "gz"],
}
# Colour and icon of each type tag.
TAG_COLOURS = {
    "Documents": "#E53935",
    "Spreadsheets": "#43A047",
    "Presentations": "#FB8C00",
    "Text": "#757575",
    "Images": "#8E24AA",
    "Videos": "#D81B60",
    "Audio": "#00ACC1",
    "Code": "#1E88E5",
    "Archives": "#6D4C41",
    "Other": "#808080",
}
TAG_ICONS = {
    "Documents": "📄",
    "Spreadsheets": "📊",
    "Presentations": "📽️",
    "Text": "📝",
    "Images": "🖼️",
    "Videos": "🎬",
    "Audio": "🎵",
    "Code": "💻",
    "Archives": "📦",
    "Other": "📁",
}
KEYWORD_TAGS = [
    ("Work", 0.7, ["work", "project", "meeting", "deadline", "report"]),
    ("Personal", 0.7, ["personal", "family", "vacation", "birthday"]),
    ("Study", 0.7, ["study", "learn", "course", "tutorial", "education"]),
    ("Finance", 0.8, ["finance", "budget", "invoice", "payment", "expense"]),
    ("Health", 0.8, ["health", "medical", "doctor", "prescription"]),
    ("Travel", 0.7, ["travel", "flight", "hotel", "booking"]),
]
REQUEST_TYPES = {
    "pdf": "Pdf", "text": "TextDocument", "txt": "TextDocument", "text_document": "TextDocument", "office": "OfficeDocument", "doc": "OfficeDocument", "docx": "OfficeDocument", "office_document": "OfficeDocument",
    "image": "Image", "img": "Image", "png": "Image", "jpg": "Image", "jpeg": "Image", "video": "Video", "mp4": "Video", "avi": "Video", "audio": "Audio", "mp3": "Audio", "wav": "Audio", "code": "Code", "source": "Code",
    "model": "Model3D", "3d": "Model3D", "model_3d": "Model3D", "archive": "Archive", "zip": "Archive", "rar": "Archive",
}
BLACKLIST = [
    "**/node_modules/**", "**/.git/**", "**/target/**", "**/.idea/**", "**/.vscode/**", "**/vendor/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/dist/**", "**/build/**", "**/.cache/**", "**/bower_components/**", "**/.npm/**", "**/.yarn/**",
    "**/System Volume Information/**", "**/$Recycle.Bin/**", "**/Windows/**", "**/Program Files/**", "**/Program Files (x86)/**", "**/ProgramData/**", "**/proc/**", "**/sys/**", "**/dev/**",
    "**/*.tmp", "**/*.temp", "**/*.swp", "**/*~", "**/.DS_Store", "**/Thumbs.db", "**/*.log", "**/*.lock", "**/package-lock.json", "**/yarn.lock", "**/Cargo.lock",
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
UNIX_PATH = r"/(?:home|Users|var|tmp|etc)/[^\s\"'\n]+"
SECRET = r"(api[_-]?key|token|secret)\s*[=:]\s*['\"]?([a-zA-Z0-9_-]{20,})['\"]?"


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def count_contained(c: Column, words: list[str]) -> Column:
    """How many of the listed words occur as substrings; a word listed twice counts twice."""
    return reduce(lambda a, w: a + F.when(c.contains(w), 1).otherwise(0), words, F.lit(0))


def lookup(c: Column, table: dict[str, list[str]], other: str) -> Column:
    out = None
    for name, keys in table.items():
        out = F.when(c.isin(keys), name) if out is None else out.when(c.isin(keys), name)
    return out.otherwise(other)


def file_type(extension: Column) -> Column:
    return lookup(F.lower(extension), FILE_TYPES, "Other")


def type_tag(extension: Column) -> Column:
    return lookup(F.lower(extension), TYPE_TAGS, "Other")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: ``WORD``, whose commonest characters are tried first."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\p{L}\p{N}]+"), F.lit(0))


def analysed(text: Column) -> Column:
    """Tokens as the index has them: none of over 40 bytes; a null text has none."""
    return F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: F.octet_length(w) <= 40)


def classify_query(q: Column) -> Column:
    """ExactKeyword, NaturalLanguage or Mixed; the order of the tests matters."""
    low = F.lower(q)
    exact = q.rlike(r"0x[0-9a-fA-F]+") | q.rlike(r"[0-9]{4,}") | q.rlike(r"[A-Z_]{3,}") | q.rlike(r"[\p{L}\p{N}_]+\.[\p{L}\p{N}_]{2,4}") | q.contains('"') | q.contains("/") | q.contains("\\")
    words = F.size(F.filter(F.split(q, r"[ \t\r\n]+"), lambda w: w != ""))
    natural = (words >= 3) | reduce(lambda a, w: a | low.startswith(w), QUESTION_WORDS, F.lit(False)) | contains_any(low, SEARCH_WORDS)
    return F.when(exact, "ExactKeyword").when(natural, "NaturalLanguage").otherwise("Mixed")


def intent_scores(q: Column) -> tuple[Column, Column]:
    """File and content score of a query, each at most 1."""
    low = F.lower(q)
    words = F.size(F.filter(F.split(q, r"[ \t\r\n]+"), lambda w: w != ""))
    ext = contains_any(low, [".pdf", ".doc", ".txt", ".jpg", ".png"])
    path = q.contains("/") | q.contains("\\")
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    file = 0.3 * count_contained(low, FILE_KEYWORDS) + 0.2 * count_contained(low, FILE_TYPE_WORDS) + one(ext, 0.3) + one(path, 0.2)
    content = 0.3 * count_contained(low, CONTENT_KEYWORDS) + 0.2 * count_contained(low, CHUNK_TYPE_WORDS) + one(q.contains('"'), 0.3) + one(words > 5, 0.1) + one(words > 10, 0.1)
    return F.least(F.lit(1.0), file), F.least(F.lit(1.0), content)


def intent(file: Column, content: Column) -> Column:
    unclear = (F.abs(file - content) < 0.15) & (F.greatest(file, content) < 0.4)
    return F.when(unclear, "Ambiguous").when(file >= content, "File").otherwise("Content")


def time_hint(q: Column) -> Column:
    """The first matching word of the list decides; null if none does."""
    out = None
    for word, hint in TIME_WORDS:
        hit = F.lower(q).contains(word)
        out = F.when(hit, hint) if out is None else out.when(hit, hint)
    return out


def keywords(q: Column) -> Column:
    """Words of a query without stop words and one-byte words, in order."""
    words = F.split(q, r"[\s!-/:-@\[-`{-~]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~F.lower(w).isin(STOP_WORDS))


def language(text: Column) -> Column:
    """Japanese, Chinese, English or Unknown from the shares of scripts."""
    n = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", ""))
    total = F.length(F.regexp_replace(text, r"[\s!-/:-@\[-`{-~]", ""))
    share = lambda keep: F.try_divide(n(keep), total)
    return F.when(share(r"\x{3040}-\x{30FF}") > 0.1, "Japanese").when(share(r"\x{4E00}-\x{9FFF}") > 0.3, "Chinese").when(share("a-zA-Z") > 0.5, "English").otherwise("Unknown")


def sensitivity(name: Column) -> Column:
    """Highest level (0 to 3) of the groups with a keyword in the lower-cased name."""
    low = F.lower(name)
    return F.greatest(F.lit(0), *[F.when(contains_any(low, words), level).otherwise(0) for _, level, words in SENSITIVE])


def anonymise(text: Column) -> Column:
    out = F.regexp_replace(text, UNIX_PATH, "[PATH]")
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    return F.regexp_replace(out, IPV4, "[IP]")


def redact_log(line: Column) -> Column:
    out = F.regexp_replace(line, SECRET, "$1=[REDACTED]")
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    return F.regexp_replace(out, IPV4, "[IP]")


def glob_regex(pattern: str) -> str:
    """``**/`` any directories, ``**`` anything, ``*`` and ``?`` within one name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if not (pattern[i].isalnum() or pattern[i] in "/_~ ") else "") + pattern[i], i + 1
    return f"^{out}$"


def path_filter(path: Column, whitelist: list[str], blacklist: list[str], max_depth: int = 20) -> Column:
    """Include, Blacklisted or TooDeep: the whitelist wins, then the blacklist, then the depth."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    hit = lambda globs: p.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
    return F.when(hit(whitelist), "Include").when(hit(blacklist), "Blacklisted").when(F.size(F.split(p, "/")) > max_depth, "TooDeep").otherwise("Include")


def named(name: Column, table: dict[str, str]) -> Column:
    """The value of a name in a small table of constants."""
    return F.element_at(F.create_map(*[F.lit(x) for row in table.items() for x in row]), name)


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` (6 or more) bytes of UTF-8: a longer text loses its end to "...", between two characters."""
    raw = F.encode(text, "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    end = most - 3
    # a character has at most three bytes after its first
    cut = F.when(~inside(end), end).when(~inside(end - 1), end - 1).when(~inside(end - 2), end - 2).otherwise(end - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit("...")))


def offset_snippet(text: Column, start: Column, most: int = 500) -> Column:
    """``most`` characters from ``start`` (from 0) on, widened to whole lines."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, start + most + 1, F.length(text))
    return F.concat(F.substring_index(before, "\n", -1), F.substring(text, start + 1, F.lit(most)), F.substring_index(after, "\n", 1))


def human_size(n: Column) -> Column:
    k = 1024.0
    return (
        F.when(n >= k**3, F.format_string("%.2f GB", F.round(n / k**3, 2)))
        .when(n >= k**2, F.format_string("%.2f MB", F.round(n / k**2, 2)))
        .when(n >= k, F.format_string("%.2f KB", F.round(n / k, 2)))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )
