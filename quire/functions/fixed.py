"""Fixed values that must equal the original service's for identical
answers.  They are stated once, here, in their natural order."""

# --- fixed values: language handling -------------------------------------
CJK_LANGUAGES = ("ja", "zh", "ko")
DEFAULT_MAX_RESULTS = 20

# --- fixed values: length budgets in text units (non-CJK, CJK) ------------
LENGTH_LIMITS = {
    "very-short": (50, 100),
    "short": (150, 300),
    "medium": (1500, 3000),
}
LENGTHS = ("very-short", "short", "medium", "full")
DEFAULT_LENGTH = "medium"

# --- fixed values: query variant rules ------------------------------------
BRACKET_PAIRS = [("「", "」"), ("『", "』"), ("(", ")"), ("[", "]"), ("【", "】")]
EDGE_STRIP_CHARS = "「」『』\"'()[]【】"
LANG_SUFFIX_PATTERN = r"(.+?)\s+\(([a-z]{2,3})\)$"
PREFIX_PATTERNS = [
    r"^(?:tell me about|explain|what is|what's|describe)\s+",
    r"^(?:was ist|erkläre mir|erzähl mir von|beschreibe)\s+",
    r"^(?:qu'est-ce que|qu'est-ce qu'un|qu'est-ce qu'une|parlez-moi de|expliquez-moi|décris-moi)\s+",
    r"^(?:что такое|расскажи(?:те)? о|опиши(?:те)?)\s+",
    r"^(?:qué es|explícame|háblame de|descríbeme)\s+",
    r"^(?:che cos'è|cos'è|spiegami|parlami di|descrivimi)\s+",
]
SUFFIX_PATTERNS = [
    r"(?:について(?:教えて|おしえて)?|とは|を(?:教えて|おしえて|調べて|しらべて))$",
    r"\s+(?:about|on the topic of|regarding)$",
    r"\s+(?:über|bezüglich|hinsichtlich)$",
    r"\s+(?:sur|à propos de|concernant)$",
    r"\s+(?:о|об|про)$",
    r"\s+(?:sobre|acerca de)$",
    r"\s+(?:su|riguardo a)$",
]
SPLIT_PATTERNS = [
    r"\s+of\s+",
    r"[のでにをは]",
    r"\s+von\s+",
    r"\s+de\s+",
    r"\s+di\s+",
    r"\s+о\s+",
    r"\s*[_\-<>|:;/\\]\s*",
]
MIN_PART_LEN = 6
MIN_PART_LEN_CJK = 3

# --- fixed values: markdown structure -------------------------------------
HEADING_PATTERN = r"^(#{1,6})\s+(.+)$"
LIST_MARKER_PATTERN = r"^\s*([-*+]|\d+\.)\s+"
FENCE_MARK = "```"

# --- fixed values: response texts -----------------------------------------
SNIPPET_OPEN = '<span class="keyword">'
SNIPPET_CLOSE = "</span>"
SNIPPET_MAX_CHARS = 200
HITS_LEAD = "The following articles were found in your search:\n\n"
HITS_SEPARATOR = "\n---\n"
TITLE_HIT = "## [Title Match] {title} ({lang})\n{summary}\n"
REDIRECT_HIT = "## [Redirect Match] {from_title} -> {to_title} ({lang})\n{summary}\n"
BODY_HIT = "## [Body Match] {title} ({lang})\n{snippet}\n"
NO_SUMMARY = "No summary available."
NOT_FOUND = "Article not found: {title}\nPlease try different keywords."
INVALID_TITLE = "Article not found: Invalid title '{title}'"
LENGTH_ERROR = "Error: Length '{length}' is not available. Available lengths: [{available}]"
LANGUAGE_ERROR = "Error: Language '{lang}' is not available. Available languages: [{available}]"
QUOTED = "'{variant}'"
QUOTED_FROM = "'{variant}' (from query '{title}')"
FOUND_NOTICE = "(Found article '{found}' based on your query '{title}')\n\n"
REDIRECT_NOTICE = "(Redirected from '{from_display}' to '{to_title}')\n\n"
OMITTED_TITLE = "\n\n## Omitted Headings"
READ_MORE = ("\n\nIf you want to read more, please use the `{tool}` tool with "
             "`length='{larger}'` to get a more detailed article.\n")
# The tool name inside the read-more hint is a parameter of the renderer;
# this is only the default.
DEFAULT_TOOL_NAME = "search_articles"

# --- fixed values: quoted titles in dump files -----------------------------
# "mysql": backslash escapes and doubled quotes; "reference": doubled quotes
# only (a backslash-quote ends the title early, as the original loader did).
TITLE_BODY = {
    "mysql": r"(?:[^'\\]++|\\.|'')*+",
    "reference": r"[^']*(?:''[^']*)*",
}

# Statement after a table's last row in a dump.
DUMP_END = "/*!40000 ALTER TABLE `{table}` ENABLE KEYS */"
