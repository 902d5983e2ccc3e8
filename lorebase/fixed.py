"""Fixed values.

Every constant in this file is a wire format, a default or a pattern that results
depend on. They are data, stated once and in natural order; logic lives elsewhere.
"""

# Whitespace as Python's str.strip / \s see it, for Java and for RE2 (DuckDB).
WS_JAVA = r"[\s\x1C-\x1F]"  # used with the (?U) flag
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_RE2 = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Markup patterns.
SCRIPT_STYLE = r"<(script|style)[^>]*>.*?</\1>"
BLOCK_TAGS = r"</?(br|p|div|li|tr|h[1-6]|hr|blockquote|pre)(\s[^>]*)?/?>"
ANY_TAG = r"<[^>]+>"
BLANKS = r"[ \t]+"
EXCESS_NEWLINES = r"\n[ \t]*\n[ \t]*\n+"
# Patterns of answers and labels.
FENCED_BLOCK = r"```(?:json)?\s*\n(.*?)\n\s*```"
CITATION = "【[^】]*】"
UNSAFE_IN_LABEL = "[^A-Za-z0-9._-]+"
OUTER_DASHES = "^-+|-+$"

BOILERPLATE_ATTR = (
    r"cookie|consent|banner|popup|modal|gdpr|newsletter|subscribe|"
    r"sign-?up|opt-?in|privacy-?notice|bottom-?bar|snackbar"
)
SEMANTIC_TAGS = ("p", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "title", "li")
STRIPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "dialog", "noscript")
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
)
MIN_FRAGMENT_CHARS = 10
MIN_SEMANTIC_PARTS = 3
MIN_BOILERPLATE_KEY = 20
BOILERPLATE_THRESHOLD = 0.5
BOILERPLATE_MIN_PAGES = 4

# File endings that a crawl does not follow.
SKIP_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "tar", "gz", "rar", "7z",
    "jpg", "jpeg", "png", "gif", "svg", "bmp", "webp", "ico",
    "mp3", "mp4", "avi", "mov", "wmv", "flv", "wav",
    "exe", "msi", "dmg", "deb", "rpm",
    "css", "js", "json", "xml", "csv",
    "woff", "woff2", "ttf", "eot",
    "iso", "img", "bin",
    "odt", "ods", "odp", "rtf", "txt",
    "apk", "ipa",
    "sql", "db", "sqlite",
    "log", "bak", "tmp",
    "yml", "yaml", "toml", "ini", "cfg", "conf",
    "sh", "bash", "ps1", "bat", "cmd",
    "py", "rb", "java", "c", "cpp", "h", "go", "rs",
)
PAGE_LIMIT = 20

# Link bodies: MIME token -> kind, leading bytes -> kind; both in order of precedence.
MIME_KINDS = (
    ("pdf", "pdf"),
    ("vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ("vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    ("html", "html"),
    ("xml", "html"),
    ("text/plain", "text"),
    ("text/csv", "text"),
    ("text/markdown", "text"),
    ("json", "text"),
)
MAGIC_KINDS = (("%pdf", "pdf"), ("<!doc", "html"), ("<html", "html"), ("<?xml", "html"))
ZIP_MAGIC_HEX = "504B0304"
MAX_LINK_BYTES = 10 * 1024 * 1024

# Chunking, batching, summaries.
WEBSITE_CHUNK = (2000, 400)
TREE_CHUNK = (9000, 500)
DOC_BATCH = 5
STORE_BATCH = 50
EMBED_BATCH = 50
SUMMARY_MIN_CHUNKS = 4
SUMMARY_CHARS = 10000
MAP_FLOOR_CHARS = 500
SUMMARY_FANIN = 10
SECTION_GROUP_CHARS = 30000
SECTION_GROUP_FLOOR = 1000
SECTION_SEPARATOR = "\n\n---\n\n"
OVERVIEW_DOC_ID = "body-of-knowledge-summary"
OVERVIEW_SOURCE = "generated"
OVERVIEW_TYPE = "bodyOfKnowledgeSummary"
OVERVIEW_TITLE = "Body of Knowledge Overview"
CALLOUT_CONTEXT_CHARS = 400

# Retrieval.
N_RESULTS = 5
MIN_SCORE = 0.3
CONTEXT_CHARS = 20000
NO_CONTEXT = "No relevant context found."
QWEN_PREFIX = "qwen3-embedding"
QWEN_INSTRUCTION = (
    "Instruct: Given a web search query, retrieve relevant passages that "
    "answer the query\nQuery: "
)

# Wire values.
FLAT_TREE_TYPE = "knowledge-base"  # a platform's own name for it is a parameter of the readers
INTERNAL_PATHS = ("/api/", "/rest/")
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
RETRY_ATTEMPTS = 3
RETRY_BASE_SECONDS = 1.0
MAX_DELIVERIES = 3
PIPELINE_TIMEOUT = 3600

# Prompts.
EXPERT_PROMPT = (
    "You are {vc_name}, an AI expert assistant. "
    "Use the following knowledge to answer the user's question.\n\n"
    "Knowledge:\n{knowledge}\n\n"
    "Question: {question}\n\n"
    "Provide a comprehensive and accurate answer based on the knowledge provided. "
    "If the knowledge doesn't contain enough information, say so clearly."
)
GUIDANCE_CONDENSE_PROMPT = (
    "Given the following conversation and a follow-up question, rephrase the "
    "follow-up question to be a standalone question.\n\n"
    "Chat History:\n{chat_history}\n\n"
    "Follow Up Question: {question}\n\n"
    "Standalone question:"
)
GUIDANCE_ANSWER_PROMPT = (
    "Use the following pieces of context to answer the question. "
    "If you don't know the answer, just say that you don't know.\n\n"
    "Context:\n{context}\n\n"
    "Question: {question}\n\n"
    "Answer in {language}. Respond in JSON format with keys: "
    "'answer' (string), 'sources' (list of objects with 'title', 'uri', 'score')."
)
GENERIC_CONDENSE_SYSTEM = (
    "You are a helpful assistant that condenses conversation history into a single, "
    "clear, self-contained question. Given the conversation history and the latest "
    "question from the user, rephrase the latest question so that it can be understood "
    "without any prior context. Return only the rephrased question, nothing else."
)
