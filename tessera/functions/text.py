"""Text expressions: all of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a job (fixed values).
STOP_WORDS = (
    "a", "an", "the", "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "will", "would", "could", "should", "might", "must", "shall", "can", "need", "dare", "ought", "used",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "nor", "so", "yet", "both", "either", "neither", "not", "only", "here", "there", "when", "where", "why", "how", "all", "each", "every",
    "few", "more", "most", "other", "some", "such", "no", "own", "same", "than", "too", "very", "just", "also", "now", "etc", "within",
    "role", "position", "job", "work", "working", "team", "company", "looking", "seeking", "required", "requirements", "responsibilities",
    "qualifications", "preferred", "experience", "years", "year", "ability", "skills", "knowledge", "strong", "excellent", "good", "great", "well",
    "include", "including", "includes", "may", "like", "e.g", "i.e", "via",
)
TOKEN = r"[a-z0-9-]+"
#: Credential patterns, the more specific ones first (fixed values).
CREDENTIALS = (
    r"sk-[A-Za-z0-9_\-]{8,}",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"\b[0-9a-fA-F]{32,}\b",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/\-]+=*",
)
#: The same for messages that leave a server: masked keys and header values, prefix included (fixed values).
MESSAGE_CREDENTIALS = (
    r"sk-[A-Za-z0-9_\-*.]{12,}",
    r"AIza[0-9A-Za-z_\-]{10,}",
    r"(?i)(Bearer\s+)[^\s\"']+",
    r"(?i)(api[-_]?key[\"'\s:=]+)[^\s\"',}]+",
)
#: Instructions smuggled into text (fixed values).
INJECTIONS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?above",
    r"forget\s+(everything|all)",
    r"new\s+instructions?:",
    r"system\s*:",
    r"<\s*/?\s*system\s*>",
    r"\[\s*INST\s*\]",
    r"\[\s*/\s*INST\s*\]",
)
#: Introductions that a name follows (fixed values).
INTRODUCTIONS = (
    r"\bI(?:'| a)m\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)",
    r"\b[Mm]y name is\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)",
    r"\b[Nn]ame(?:'s| is)?\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)",
)
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
METRIC = r"\d+%|\d+x|\$\d+"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Chinese, Japanese and Korean characters as ranges (fixed values).
CJK_RANGES = (
    (0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xA960, 0xA97F),
    (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
CJK = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in CJK_RANGES)


def keywords(text: Column) -> Column:
    """Distinct lower-cased ASCII words of three letters or more, neither stop words nor all digits."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def segments(text: Column, words: Column) -> Column:
    """array of (text, is_match): words and the runs between them, in order; joined they give the text again.

    A word matches where its lower-cased form without hyphens at its ends is in `words`.
    """
    parts = F.regexp_extract_all(text, F.lit("[a-zA-Z0-9-]+|[^a-zA-Z0-9-]+"), 0)

    def mark(part: Column) -> Column:
        bare = F.regexp_replace(F.lower(part), "^-+|-+$", "")
        return F.struct(part.alias("text"), (part.rlike("^[a-zA-Z0-9-]") & F.array_contains(words, bare)).alias("is_match"))

    return F.transform(parts, mark)


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def has_term(text: Column, term: str, cjk: bool = True) -> Column:
    """Whether the term stands in the text as a whole: no word character beside it, lower-cased on both sides.

    With `cjk`, terms holding Chinese, Japanese or Korean characters match anywhere, and such
    characters bound other terms. A blank term is in no text; a null text has no term.
    """
    bare = term.strip().lower()
    if not bare:
        return F.lit(False)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    # The term comes first and then what may stand before it, so that the matcher looks around at hits alone.
    q = _quoted(bare)
    if not cjk:
        return F.contains(lowered, F.lit(bare)) & lowered.rlike(f"{q}(?<!{WORD_CHAR}{q})(?!{WORD_CHAR})")
    if any(low <= ord(c) <= high for c in bare for low, high in CJK_RANGES):
        return F.contains(lowered, F.lit(bare))
    return F.contains(lowered, F.lit(bare)) & lowered.rlike(f"{q}(?:(?<!{WORD_CHAR}{q})|(?<=[{CJK}]{q}))(?:(?!{WORD_CHAR})|(?=[{CJK}]))")


def _each(text: Column, patterns: tuple[str, ...], by: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, by)
    return text


def redacted(text: Column) -> Column:
    """Credentials as [REDACTED]."""
    return _each(text, CREDENTIALS, "[REDACTED]")


def redacted_message(text: Column) -> Column:
    """Credentials of an error message as <redacted>, whole matches."""
    return _each(text, MESSAGE_CREDENTIALS, "<redacted>")


def without_injections(text: Column) -> Column:
    return _each(text, tuple("(?i)" + p for p in INJECTIONS), "[REDACTED]")


def without_thinking(text: Column) -> Column:
    """Text outside <think> blocks, an unclosed one included; trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "(?s)<think>.*", ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines without bullets or numbering."""
    bare = F.transform(F.split(text, r"\r?\n+", -1), lambda x: trimmed(F.regexp_replace(x, r"^\s*(?:[-*\u2022]+|\d+[.)])\s*", "")))
    return F.filter(bare, lambda x: x != "")


def aligned_styles(rows: Column, styles: Column) -> Column:
    """One style per row: plain where it says so, bullet otherwise or where none is given."""
    return F.transform(rows, lambda _, i: F.when(F.get(styles, i) == "plain", "plain").otherwise("bullet"))


def has_month(text: Column) -> Column:
    return text.rlike(f"(?i)(?<!{WORD_CHAR})(?:{MONTHS})[a-z]*(?!{WORD_CHAR})")


def date_key(text: Column) -> Column:
    """Years joined by ' - ', with 'current' for an open end; one year where both are equal; '' without years."""
    years = F.regexp_extract_all(text, F.lit("[0-9]{4}"), 0)
    current = text.rlike(rf"(?i)(?<!{WORD_CHAR})(?:present|current|now|ongoing)(?!{WORD_CHAR})")
    twice = (F.size(years) == 2) & (F.get(years, F.lit(0)) == F.get(years, F.lit(1)))
    closed = F.when(twice, F.get(years, F.lit(0))).otherwise(F.array_join(years, " - "))
    return F.when(F.size(years) == 0, "").when(current, F.concat(F.array_join(years, " - "), F.lit(" - current"))).otherwise(closed)


def plain_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*[-\u2013\u2014]\s*", " - ")


def metrics(text: Column) -> Column:
    """Percentages, factors and dollar amounts in their order."""
    return F.regexp_extract_all(text, F.lit(METRIC), 0)


def intro_name(text: Column) -> Column:
    """The name that the first fitting introduction gives, or ''."""
    names = [F.nullif(F.regexp_replace(F.regexp_extract(text, p, 1), r"\.+$", ""), F.lit("")) for p in INTRODUCTIONS]
    return F.coalesce(*names, F.lit(""))


def initials(text: Column) -> Column:
    """First letters, upper case, of the first three words that begin with a letter."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.upper(F.substring(w, 1, 1))), "")


def judge_score(raw: Column) -> Column:
    """1 to 5 rounded half up from text; null for anything else, infinities and NaN included."""
    value = trimmed(raw).try_cast("double")
    whole = F.floor(value + 0.5)
    return F.when(~F.isnan(value) & (F.abs(value) < 1e9) & whole.between(1, 5), whole.cast("int"))


def bounded_int(raw: Column, default: int, low: int, high: int) -> Column:
    """Text as an integer held to its bounds; the default where it is none."""
    return F.least(F.greatest(F.coalesce(trimmed(raw).try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def path_allowed(path: Column) -> Column:
    """Whether a change may touch this path of a record."""
    return path.rlike(r"^(?:summary|(?:workExperience|personalProjects)\[\d+\]\.description(?:\[\d+\])?|education\[\d+\]\.description"
                      r"|additional\.(?:technicalSkills|languages|certificationsTraining|awards))$")


def normalized(text: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def percentage(part: Column, whole: Column) -> Column:
    """0 where there is nothing to match."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))
