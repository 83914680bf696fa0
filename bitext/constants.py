"""Patterns, limits, word lists, formats and messages.

Everything in this module has to be exactly what it is for results to be
right.  Nothing here is logic.  Patterns are written for Java's regex engine.
"""

# --------------------------------------------------------------------------
# Character classes.  WS is the white space that collapses; WORD is ASCII.
# --------------------------------------------------------------------------
SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same characters by property: Java tests one property far faster than many ranges.
SPACES_IN_CLASS = r"\t\n\x0B\f\r\p{Z}\x{FEFF}"
WS = r"[\p{IsWhite_Space}\x{FEFF}&&[^\x{85}]]"
NOT_WS = r"[\P{IsWhite_Space}\x{85}&&[^\x{FEFF}]]"
# No white space: Java tells most characters by this range, before it asks for their properties.
NOT_PLAIN = "(?![!-~])"
# A run of white space other than one plain blank.
WS_RUN = NOT_PLAIN + "(?! " + NOT_WS + ")" + WS + "+"
# The same inside a line.
WS_IN_LINE = r"[\p{IsWhite_Space}\x{FEFF}&&[^\x{85}\n]]"
WS_RUN_IN_LINE = NOT_PLAIN + "(?! (?!" + WS_IN_LINE + "))" + WS_IN_LINE + "+"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"

# --------------------------------------------------------------------------
# Limits.
# --------------------------------------------------------------------------
MAX_SEGMENT_CHARACTERS = 1400
MAX_BATCH_CHARACTERS = 3200
MAX_BATCH_SEGMENTS = 12
MIN_GROUP_CHARACTERS = 90
MAX_GROUP_CHARACTERS = 360
TRANSLATE_MAX_SEGMENTS = 24
TRANSLATE_MAX_BYTES = 8000
REVIEW_MAX_SEGMENTS = 12
REVIEW_MAX_BYTES = 7000
MAX_RETRIES = 5
RETRY_STEP_MS = 200
RETRY_CEILING_MS = 800
RECENT_PROJECTS = 8
RECENT_LOCATIONS = 24
SCHEMA_VERSION = 1
FOCUS_RATIO = 0.35
DEAD_ZONE = 18.0
SUPPRESS_AUTO_MS = 160
SUPPRESS_SMOOTH_MS = 700
MIN_IMAGES = 2
MIN_VECTOR_PATHS = 24
LANGUAGES = ["es", "en", "pt", "fr", "de"]
REVIEW_LEVELS = ["none", "normal", "strict"]
REVIEW_RATIO = {"normal": (0.58, 1.65), "strict": (0.72, 1.38)}
STRICT_MIN_CHARACTERS = 20
ORIGINAL_EXTENSIONS = ["pdf"]
TRANSLATION_EXTENSIONS = ["pdf", "md", "markdown", "txt"]
SKIPPED_DIRECTORIES = ["node_modules", "target", "dist", "build", "__pycache__"]

# --------------------------------------------------------------------------
# Page text.
# --------------------------------------------------------------------------
FOOTNOTE_BOUNDARY = "[[FOOTNOTES]]"
FOOTNOTE_MARKER = "[Notas al pie]:"
PAGE_MARKER = "------------[Página N° %d]------------"
PAGE_TITLE = "--- Página %d · %s ---"
FIGURE_QUOTE = "> **Figura o gráfica en el original · página %d.**\n>\n> "
TABLE_QUOTE = "> **Tabla en el original · página %d.**\n>\n> "
VISUAL_TEXT = "Visual content detected in the original document."
SEGMENT_ID = "seg_%05d"

USABLE_WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
HYPHEN_BREAK = r"-\n(?<=\p{L}-\n)(?=\p{Ll})"
FIGURE_CAPTION = (
    r"(?iu)^(?:figure|fig\.?|graph|chart|diagram|plot|figura|gr[aá]fic[oa]|graphe|abbildung)"
    r"\s*(?:\d+|[ivxlcdm]+)?(?:[.:(\s—-]|\z)"
)
TABLE_CAPTION = r"(?iu)^(?:table|tabla|tableau|tabelle)\s*(?:\d+|[ivxlcdm]+)?(?:[.:(\s—-]|\z)"
EQUATION_LABEL = r"(?iu)^(?:equation|eq\.?|ecuaci[oó]n)\s*\(?\d+"
EQUATION_DELIMITED = r"^(?:\$\$[\s\S]+\$\$|\\\[[\s\S]+\\\])\z"
# A cheap range that holds every sign of EQUATION_RELATION.
EQUATION_RELATION_RANGE = r"[=\x{2200}-\x{22FF}]"
EQUATION_RELATION = r"[=≤≥≠≈∑∏∫√]"
EQUATION_SIGNAL = r"[=≤≥≠≈∑∏∫√∞∂∆∇±×÷]|\p{L}\s*[_^]|[₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹]"
EQUATION_WORD = r"\p{L}{3,}"
EQUATION_MAX_CHARACTERS = 260
EQUATION_MAX_WORDS = 10
HEADING_MAX_CHARACTERS = 140
HEADING_MAX_WORDS = 16
# More words than a heading has.
MANY_WORDS = rf"^(?:(?:[!-~]++|{NOT_WS})*+{WS}++){{{HEADING_MAX_WORDS}}}"
HEADING_END = [".", "!", "?", ";", ":"]
HEADING_EXCLUDED = (
    r"(?iu)https?://|" + WORD_START + "doi" + WORD_END + r"|@|©|all rights reserved"
)
FOOTNOTE_LABEL = r"(^|\s)((?:\d{1,3}\s*[.)])|[*†‡])(\s+)(?=[\p{L}0-9«“\"'(])"
CITATION = (
    r"(?iu)(?:" + WORD_START + r"(?:18|19|20)\d{2}" + WORD_END
    + r"|https?://|" + WORD_START + "doi" + WORD_END
    + r"|[\"'«»“”].+[\"'«»“”]|" + WORD_START
    + r"(?:press|ediciones|editorial|revista|journal|vol\.|pp?\.|documento|informe|universidad|university)"
    + r"(?:(?<=\.)(?=[A-Za-z0-9_])|(?<!\.)(?![A-Za-z0-9_])))"
)
READER_METADATA = r"(?imu)^\s*<!--\s*seg_\d+\s*·\s*página\s+\d+\s*-->\s*$"
# A sentence ends at . ! or ? (a closing quote or bracket may follow) before white space.
SENTENCE_BREAK = r"(?<=[.!?]|[.!?][\"”’')\]])\s+"

# --------------------------------------------------------------------------
# Values that a translation must keep.
# --------------------------------------------------------------------------
NUMBER = r"(?<![\p{L}_])[-+]?\d+(?:[.,]\d+)*(?:\s*%)?"
REFERENCE = (
    r"(?iu)https?://[^\s)]+|" + WORD_START + r"doi:\s*[^\s]+|"
    + WORD_START + r"[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}" + WORD_END
)
MATH_PLACEHOLDER = r"⟦MATH_(?:INLINE|DISPLAY)_\d{5,}⟧"
# Stands for notation until its number is known.
MATH_UNNUMBERED = "⟦MATH_INLINE_000000000000000000⟧"
MATH_INLINE_FORMAT = "⟦MATH_INLINE_%05d⟧"
MATH_DISPLAY_FORMAT = "⟦MATH_DISPLAY_%05d⟧"
MATH_ID = "math_%05d"
NUMBER_FORMAT = "[[NUMBER_%05d]]"
REFERENCE_FORMAT = "[[REFERENCE_%05d]]"
EXISTING_MARKER = (
    r"⟦(?:MATH_(?:INLINE|DISPLAY)|(?:NUMBER|REFERENCE))_\d{5,}⟧"
    r"|\[\[(?:MATH_(?:INLINE|DISPLAY)|(?:NUMBER|REFERENCE))_\d{5,}\]\]"
)
STABLE_PLACEHOLDER = r"(?:⟦|\[\[|\[)?((?:NUMBER|REFERENCE)_\d{5,})(?:⟧|\]\]|\])?"
DOI_NUMBER = r"10\.\d{4,9}/[._;()/:A-Z0-9-]+"
STABLE_VALUE = (
    r"https?://[^\s)\]}]+|" + WORD_START + r"doi:\s*[^\s]+|"
    + WORD_START + DOI_NUMBER + "|"
    + WORD_START + r"[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}" + WORD_END
    + r"|" + NUMBER
)
STABLE_REFERENCE = r"(?iu)^(?:https?://|doi:|10\.\d{4,9}/)|@"
MATH = (
    r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([^\n]+?\\\)|\$[^$\n]+?\$"
    r"|(?<![A-Za-z0-9_])[pPrR]\s*(?:<|>|=|≤|≥|≠|≈)\s*-?\d+(?:[.,]\d+)?"
    r"|(?<![A-Za-z0-9_])[A-Za-z]\s*[_^]\s*(?:\{[^{}\n]+\}|[A-Za-z0-9]+)"
    r"|(?<![A-Za-z0-9_])[A-Za-z][₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹]+"
    r"|\p{IsGreek}|[∑∏∫√∞∂∆∇≤≥≠≈±×÷∈∉∪∩⊂⊆→←↔]"
)
# The same language, told by the first character of a match: most characters of a text begin none.
QUICK_MATH = (
    r"(?![ 0-9])(?:(?=[!-~])(?:"
    r"(?<![A-Za-z0-9_])(?=[A-Za-z])(?:(?=[pPrR])[pPrR]\s*[<>=≤≥≠≈]\s*-?\d+(?:[.,]\d+)?"
    r"|[A-Za-z](?=[\s_^²³¹\x{2070}-\x{209C}])(?:\s*[_^]\s*(?:\{[^{}\n]+\}|[A-Za-z0-9]+)|[₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹]+))"
    r"|(?=\$)(?:\$\$[\s\S]+?\$\$|\$[^$\n]+?\$)|(?=\\)(?:\\\[[\s\S]+?\\\]|\\\([^\n]+?\\\)))"
    r"|(?![\x00-\x7F])(?:\p{IsGreek}|[∑∏∫√∞∂∆∇≤≥≠≈±×÷∈∉∪∩⊂⊆→←↔]))"
)
# Every piece of notation holds one of these; few other texts do.
MATH_SIGN = r"[$\\_^<>=\x{B1}-\x{B3}\x{B9}\x{D7}\x{F7}\x{370}-\x{1FFF}\x{2070}-\x{10FFFF}]"
MATH_DISPLAY_START = r"^(?:\$\$|\\\[)"
GREEK_LATEX = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon",
    "θ": "\\theta", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi", "ρ": "\\rho",
    "σ": "\\sigma", "τ": "\\tau", "φ": "\\phi", "χ": "\\chi", "ψ": "\\psi",
    "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda",
    "Π": "\\Pi", "Σ": "\\Sigma", "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega",
}
RELATION_LATEX = {"≤": "\\le ", "≥": "\\ge ", "≠": "\\ne ", "≈": "\\approx "}
LOST_VALUES_NOTE = "\n\n> ⚠ **Verificar cifras o referencias con el original:** "

# --------------------------------------------------------------------------
# Review messages.
# --------------------------------------------------------------------------
WARN_MATH = "La revisión alteró marcadores matemáticos protegidos."
WARN_STABLE = "La revisión alteró cifras o referencias protegidas."
WARN_NUMBER = "La revisión cambió cifras, fechas o porcentajes."
WARN_REFERENCE = "La revisión cambió una URL, DOI o dirección electrónica."
WARN_LENGTH = "La revisión cambió demasiado la extensión del segmento."
WARN_SHORT = "La revisión estricta produjo un resultado demasiado breve."
WARN_MISSING = "El revisor no devolvió este segmento."

# --------------------------------------------------------------------------
# Failures: ordered (pattern, code, recoverable, action), then the fallbacks.
# --------------------------------------------------------------------------
FAILURE_RULES = [
    (r"(?iu)not responding|connection refused|failed to connect|timed?\s*out",
     "MODEL_UNAVAILABLE", True,
     "Comprueba que Ollama esté abierto y vuelve a intentarlo."),
    (r"(?iu)model.*not installed|model.*not found|select an installed.*model",
     "MODEL_UNAVAILABLE", False,
     "Selecciona en Ajustes un modelo local que esté instalado."),
    (r"(?iu)http 5\d\d|internal server error|model runner.*(?:stopped|crash)",
     "MODEL_SERVER_ERROR", True,
     "Ollama tuvo un fallo temporal; vuelve a intentarlo."),
    (r"(?iu)invalid translation json|empty translation|segment identifier|marcadores matemáticos"
     r"|marcadores de cifras o referencias|cifras o referencias|math placeholder|protected marker",
     "MODEL_OUTPUT_INVALID", True,
     "El modelo devolvió una respuesta incompleta o alteró contenido protegido."),
]
FALLBACK_ACTIONS = {
    "PDF_LOAD_FAILED": "Verifica que el archivo sea un PDF válido y legible.",
    "TEXT_EXTRACTION_FAILED": "La página no pudo leerse mediante su capa de texto.",
    "OCR_FAILED": "El reconocimiento local falló; puedes reintentar o desactivar OCR.",
    "SAVE_FAILED": "El original no fue modificado. Revisa el acceso a la carpeta del proyecto.",
    "CLEANUP_FAILED": "Cierra y vuelve a abrir el documento antes de reintentar.",
    "UNKNOWN": "Vuelve a intentarlo; el original no fue modificado.",
}
STAGE_FALLBACK = {
    "loading": "PDF_LOAD_FAILED", "extracting": "TEXT_EXTRACTION_FAILED", "ocr": "OCR_FAILED",
    "translating": "MODEL_OUTPUT_INVALID", "saving": "SAVE_FAILED", "cleanup": "CLEANUP_FAILED",
}
STAGE_LABELS = {
    "loading": "abrir el PDF", "extracting": "extraer el texto",
    "ocr": "reconocer el texto con OCR", "translating": "traducir el documento",
    "reviewing": "revisar la traducción", "saving": "guardar el resultado",
    "cleanup": "liberar los recursos de procesamiento",
}
OUTPUT_FAILURE = (
    r"(?iu)segment identifier|invalid translation json|empty translation|marcadores matemáticos"
    r"|marcadores de cifras o referencias|cifras o referencias|math placeholder|protected marker"
    r"|review batch.*too large"
)
SERVER_FAILURE = (
    r"(?iu)ollama.*(?:http 5\d\d|internal server error|not responding|did not complete)"
    r"|connection refused|failed to connect|timed?\s*out"
)

# --------------------------------------------------------------------------
# Catalog.
# --------------------------------------------------------------------------
LANGUAGE_SUFFIX = r"(?iu)\.(?:es|en|pt|fr|de)\z"
UNTITLED = "Untitled document"
PAIR_STATES = {
    "paired": ("✓", "Complete pair"),
    "missing-original": ("!", "Missing original"),
    "missing-translation": ("!", "Missing translation"),
    "unavailable": ("↗", "File unavailable"),
    "manually-linked": ("≠", "Linked after rename"),
    "conflict": ("⚠", "Pair conflict"),
}
RESERVED_COMPONENT = r"[<>:\"|?*\p{Cc}]|[ .]\z"
RESEGMENT_METHOD = "experimental-sentence-group-v1"
ALIGNMENT_ID = "al_"
EQUAL_CONFIDENCE = 0.82
UNEQUAL_CONFIDENCE = 0.62

# --------------------------------------------------------------------------
# Page layout.  Ratios of text height, page height and page width.
# --------------------------------------------------------------------------
LAYOUT = {
    "max_depth": 32,
    "horizontal_gap_height": 1.15, "horizontal_gap_page": 0.012, "horizontal_bias": 1.08,
    "vertical_gap_height": 1.25, "vertical_gap_page": 0.018,
    "note_quantile": 0.75, "note_band": 0.25, "note_height": 0.86, "note_margin": 0.35,
    "run_reset": 1.5,
    "line_overlap": 0.35, "line_distance": 1.5, "line_distance_height": 0.3,
    "tall": 1.8, "short": 0.75,
    "space_gap": 0.8, "space_gap_character": 0.18, "raised": 0.15,
}
NOTE_LABEL = r"^(?:\d{1,3}\s*[.)]|[*†‡])(?:\s|\z)"
NO_SPACE_BEFORE = r"^[,.;:!?%)\]}]"
NO_SPACE_AFTER = r"[(\[{¿¡]$"
IMAGE_OPERATORS = ["paintImageXObject", "paintImageMaskXObject", "paintInlineImageXObject"]
PATH_OPERATOR = "constructPath"


def wide_space(pattern: str, spaces: str = SPACES) -> str:
    """``pattern`` with Java's ASCII ``\\s`` widened to SPACES, inside classes and outside."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        if pattern.startswith(r"[\s\S]", i):
            out.append(r"[\s\S]")
            i += 6
        elif pattern.startswith(r"\s", i):
            out.append(spaces if depth else WS)
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        else:
            depth += {"[": 1 - depth, "]": -depth}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
    return "".join(out)


# What a class of ASCII letters also holds in a pattern that ignores case by Unicode's rules.
FOLDED = r"\x{130}\x{131}\x{17F}\x{212A}"
EMAIL_NAME = "[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9_.-]+"


def quick(pattern: str) -> str:
    """The same language as ``pattern``: one test for a word character, no case folding there, a look at the first character of a number."""
    if pattern == MATH:
        return QUICK_MATH
    more = FOLDED if pattern.startswith(("(?iu)", "(?imu)")) else ""
    plain = "(?-iu:%s)" if more else "%s"
    for slow, fast in (
        (EMAIL_NAME, rf"[\w{more}][\w.+{more}-]*+@[\w.{more}-]+"),
        (WORD_START, rf"(?<![\w{more}])"),
        (WORD_END, rf"(?![\w{more}])"),
    ):
        pattern = pattern.replace(slow, plain % fast)
    return pattern.replace(NUMBER, r"(?=[-+\d])" + NUMBER)


def java_pattern(pattern: str) -> str:
    """``wide_space`` for Spark: the same language in a form that Java runs faster."""
    return wide_space(quick(pattern), SPACES_IN_CLASS)


def of_line(pattern: str) -> str:
    """``pattern`` of a whole line for where a line of a page begins, whose lines hold no white space but blanks."""
    flags, body = ("(?iu:", pattern.removeprefix("(?iu)")) if pattern.startswith("(?iu)") else ("(?:", pattern)
    body = body.removeprefix("^").replace(r"[\s\S]", r"[^\n]").replace(r"\s", " ").replace(r"\z", r"(?![^\n])")
    return flags + body + ")"


CAPTION_LINE = f"(?:{of_line(FIGURE_CAPTION)}|{of_line(TABLE_CAPTION)})"
LONE_LINE = rf"\[\[FOOTNOTES\]\](?![^\n])|{of_line(EQUATION_LABEL)}[^\n]*+|{of_line(EQUATION_DELIMITED)}"
# Letters and what is between them, up to the end of the next word; nothing is tried twice.
_TO_WORD = r"(?:[^\p{L}\n]++|\p{L}{1,2}+(?!\p{L}))*+\p{L}{3,}+"
SYMBOLIC_LINE = (
    rf"(?=[^\n]*?{EQUATION_RELATION})(?=[^\n]{{0,{EQUATION_MAX_CHARACTERS}}}+(?![^\n]))"
    rf"(?=(?:[^\n]*?{of_line(EQUATION_SIGNAL)}){{2}})(?!(?:{_TO_WORD}){{{EQUATION_MAX_WORDS + 1}}})[^\n]*+"
)
# Where a block opens: after blank lines, at a caption, and at a line that is a block of its own (the first
# group); the second group is the line feed after that line, which is not used up.
_OPENING = r"\n++(?:(?=%s)|(%s)(?=(\n|\z))|(?<=\n\n))"
BLOCK_OPENING = _OPENING % (CAPTION_LINE, LONE_LINE)
BLOCK_OPENING_OR_SYMBOLIC = _OPENING % (CAPTION_LINE, LONE_LINE + "|" + SYMBOLIC_LINE)
# What every caption and every equation that is not told by its signs begins with.
MARKED_START = r"^(?iu:fig|gr[aá]|chart|diagram|plot|abb|tab|eq|ecu|\$\$|\\\[)"
