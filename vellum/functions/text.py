"""Text columns: chunking windows, titles, tags, cleaning, task prefixes, previews.

All of these are plain Catalyst expressions (regexp_*, substring, higher-order functions), so
they run inside whole-stage code generation next to the scan and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced).
#
# Whitespace as Python's str.isspace()/str.split()/str.strip() see it, written as one regex
# character class that both Java regex and RE2 (the oracle) understand:
#   \t \n \x0B \f \r \x1C-\x1F space \x85 \xA0    -          　
WS_CLASS = (
    "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# The same set without brackets, for use inside a larger class.
WS_CHARS = WS_CLASS[1:-1]
# A "word" character (Python's Unicode \w): letters, numbers, underscore.
WORD_CHARS = "\\p{L}\\p{N}_"
# Task prefixes an encoder input may already carry, and the default one for documents.
TASK_PREFIXES = ("search_document:", "search_query:", "clustering:", "classification:")
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
# Sentinel that replaces blank text before encoding.
EMPTY_SENTINEL = "empty_document"
# Markdown header line: '#'s, one space, the rest of the line (non-greedy, up to the line end).
HEADER_PATTERN = "(?md)^#+ (.*?)$"
# Frontmatter tag list and inline hashtags.
FRONTMATTER_TAGS_PATTERN = "(?d)tags:" + WS_CLASS + "*\\[(.*?)\\]"
INLINE_TAG_PATTERN = "#([" + WORD_CHARS + "]+)"
# Default window of the chunker.
DEFAULT_CHUNK_SIZE = 500
DEFAULT_CHUNK_OVERLAP = 50
# ---------------------------------------------------------------------------------------------


# Every character that ``str.strip`` takes as white space.
BLANKS = "".join(map(chr, filter(lambda cp: chr(cp).isspace(), range(0x3001))))
# ASCII characters that cleaning keeps, one by one: Java looks a class of single characters up in a table, one of
# ranges and properties is a chain of tests for every character.
PLAIN_KEPT = "".join(chr(cp) for cp in range(128) if chr(cp).isalnum()) + "_ .,!?\\-"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for NULL, '' and whitespace-only strings."""
    c = _col(c)
    # Blank unless some non-whitespace character exists (found at once for ordinary text).
    return c.isNull() | ~c.rlike(f"[^{WS_CHARS}]")


def split_ws(c: Column | str) -> Column:
    """Python ``str.split()``: whitespace-separated words, no empty strings."""
    return F.filter(F.split(strip_ws(c), f"{WS_CLASS}+"), lambda w: w != "")


# --- T1: overlapping chunking -----------------------------------------------------------------


def check_chunk_params(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk_size must be positive, got {size}")
    if overlap < 0 or overlap >= size:
        raise ValueError(f"chunk_overlap must be in [0, chunk_size), got {overlap} for size {size}")


def chunk_count(text: Column | str, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP) -> Column:
    """Number of windows: 1 when the text fits, else ceil((len-size)/step)+1."""
    check_chunk_params(size, overlap)
    step = size - overlap
    n = F.length(_col(text))
    return F.when(n <= size, F.lit(1)).otherwise((F.ceil((n - size) / F.lit(step)) + 1).cast("int"))


def chunk_array(text: Column | str, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP) -> Column:
    """ARRAY<STRING> of windows of ``size`` characters starting every ``size-overlap`` characters;
    the last window ends at the end of the text. Empty text gives ``[""]``, NULL gives ``[NULL]``."""
    check_chunk_params(size, overlap)
    t = _col(text)
    step = size - overlap
    per_window = -(-size // step)  # pieces a window spans
    # One linear pass cuts the text into pieces of ``step`` characters; window i is pieces
    # i..i+per_window-1 joined and cut to ``size``. (Indexing the text itself per window would walk
    # the UTF-8 bytes from the start every time: quadratic in the document length.)
    pieces = F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % step), 0)
    # The piece array is bound once (outer transform) rather than re-extracted inside the lambda.
    windows = F.element_at(F.transform(F.array(pieces), lambda p: F.transform(
        F.sequence(F.lit(0), chunk_count(t, size, overlap) - 1),
        lambda i: F.substring(F.array_join(F.slice(p, i + 1, per_window), ""), 1, size))), 1)
    return F.when(t.isNull(), F.array(F.lit(None).cast("string"))).otherwise(windows)


# --- T2: title --------------------------------------------------------------------------------


def _capitalize_word(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def title_case(c: Column | str) -> Column:
    """Python ``str.title()``: each run of cased letters starts upper-case, continues lower-case."""
    pieces = F.regexp_extract_all(_col(c), F.lit("([\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+)"), 1)
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike("^[\\p{Lu}\\p{Ll}\\p{Lt}]"), _capitalize_word(p)).otherwise(p),
        ),
        "",
    )


def file_stem(path: Column | str) -> Column:
    """File name without directory and without the last extension."""
    base = basename(path)
    return F.when(base.rlike("^.+\\.[^.]*$"), F.regexp_extract(base, "^(.+)\\.[^.]*$", 1)).otherwise(base)


def doc_title(text: Column | str, path: Column | str | None = None) -> Column:
    """First markdown header (stripped, may be ''), else the first line of the stripped text with
    '#'-words dropped and every word capitalised, else the file stem title-cased."""
    t = _col(text)
    # The text is searched once for a header, and only when it has what every header has.
    line = F.when(t.contains("# "), F.regexp_extract(t, HEADER_PATTERN, 0)).otherwise(F.when(t.isNotNull(), F.lit("")))
    # ``split_ws`` strips the other end, so the end of the text need not be looked at.
    first_line = F.substring_index(F.ltrim(t, F.lit(BLANKS)), "\n", 1)
    words = F.filter(split_ws(first_line), lambda w: ~w.startswith("#"))
    from_line = F.array_join(F.transform(words, _capitalize_word), " ")
    if path is None:
        fallback = F.lit("")
    else:
        fallback = title_case(F.regexp_replace(file_stem(path), "_", " "))

    def title(found: Column) -> Column:
        return F.when(found != "", strip_ws(F.regexp_extract(found, HEADER_PATTERN, 1))).otherwise(
            F.element_at(F.transform(F.array(from_line), lambda own: F.when(own != "", own).otherwise(fallback)), 1))

    return F.element_at(F.transform(F.array(line), title), 1)


# --- T4: tags ---------------------------------------------------------------------------------


def frontmatter_tags(text: Column | str) -> Column:
    """Tags from a leading ``---`` block's ``tags: [a, b]`` line; empty array when absent."""
    t = _col(text)
    end = F.locate("---", t, 4)
    fm = F.substring(t, F.lit(4), end - 4)
    has = t.startswith("---") & (end > 0) & fm.rlike(FRONTMATTER_TAGS_PATTERN)
    listed = F.regexp_extract(fm, FRONTMATTER_TAGS_PATTERN, 1)
    tags = F.transform(F.split(listed, ",", -1), strip_ws)
    return F.when(has, tags).otherwise(F.array().cast("array<string>"))


def inline_tags(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(INLINE_TAG_PATTERN), 1)


def extract_tags(text: Column | str) -> Column:
    """Distinct frontmatter + inline tags, sorted (the source order is a set's, i.e. undefined)."""
    t = _col(text)
    return F.array_sort(F.array_distinct(F.concat(frontmatter_tags(t), inline_tags(t))))


# --- T5: cleaning -----------------------------------------------------------------------------


def preprocess_text(text: Column | str) -> Column:
    """Blank -> sentinel; drop characters other than word, whitespace and ``.,!?-``; collapse
    whitespace; collapse runs of dots; strip. Text made only of symbols ends as ''."""
    t = _col(text)
    # White space becomes spaces first, so that the patterns need name no other. Runs of plain characters are matched
    # whole and put back as they are; only what is between them meets the wide class.
    spaced = F.translate(t, BLANKS, " " * len(BLANKS))
    kept = F.regexp_replace(spaced, f"([{PLAIN_KEPT}]++)|[^{WORD_CHARS} .,!?\\-]++", "$1")
    # Runs of spaces and of dots, both to one; the final strip only has spaces to remove (trim).
    collapsed = F.regexp_replace(kept, "([ .])\\1+", "$1")
    return F.when(is_blank(t), F.lit(EMPTY_SENTINEL)).otherwise(F.trim(collapsed))


# --- T6: task prefix --------------------------------------------------------------------------


def task_prefix(text: Column | str, task: str = "document") -> Column:
    """Prefix the encoder input unless it already carries one of the task prefixes.
    ``task='document'`` matches the source behaviour for corpus text; ``'query'`` is for queries."""
    prefix = {"document": DOCUMENT_PREFIX, "query": QUERY_PREFIX}[task]
    pattern = "^(" + "|".join(p.rstrip(":") for p in TASK_PREFIXES) + "):"
    # Bind the input once: it is usually a regex pipeline that must not run once per reference.
    return F.element_at(F.transform(F.array(_col(text)), lambda t: F.when(t.rlike(pattern), t).otherwise(
        F.concat(F.lit(prefix), t))), 1)


# --- T10 / T11: previews and base names ----------------------------------------------------------


def preview(text: Column | str, n: int = 100) -> Column:
    """First ``n`` characters and '...' only when the text is longer."""
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def excerpt(text: Column | str, n: int = 300) -> Column:
    """First ``n`` characters followed by '...' unconditionally."""
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), "([^/]*)$", 1)
