"""Small expressions: paths, limits, budgets, masks, verdicts and prompts. All of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

#: Parts of a record that no change may touch, and fields that may not be a path's last (fixed values).
CLOSED = ("personalInfo", "customSections", "sectionMeta")
CLOSED_LEAVES = ("years", "company", "institution", "title", "degree", "name", "role", "github", "website", "location", "id")
#: Limits of a record's JSON, a job's text and a prompt in characters, and of extracted text in bytes (fixed values).
RECORD_CHARS, JOB_CHARS, PROMPT_CHARS, TEXT_BYTES = 200_000, 100_000, 512_000, 2 * 1024 * 1024
#: Keys an answer has to have, by kind (fixed values).
REQUIRED = {"enrichment": ("items_to_enrich", "questions"),
            "interview_prep": ("role_fit_analysis", "resume_questions", "project_follow_ups", "skill_gaps", "talking_points")}
#: Seconds by operation and factors by provider; temperatures of retries; least size of a page (fixed values).
SECONDS, DEFAULT_SECONDS = {"health_check": 30, "completion": 120, "json": 180}, 120
FACTORS = {"openai": 1.0, "anthropic": 1.2, "azure_foundry": 1.2, "openrouter": 1.5, "groq": 1.0, "ollama": 2.0}
LATER_TEMPERATURES = (0.3, 0.5, 0.7)
LEAST_PAGE = 1000
#: Keys of settings whose values are secret (fixed values).
SECRET_KEYS = ("api_key", "api_keys", "llm_api_key", "authorization")
HIDDEN = "[REDACTED]"


def path_blocked(path: Column) -> Column:
    """Whether a path leads into a closed part, ends in a closed field, or into education beyond a description."""
    leaf = F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"\[[0-9]+\]$", "")
    closed = path.rlike(rf"^(?:{'|'.join(CLOSED)})(?:$|[.\[])")
    return closed | leaf.isin(*CLOSED_LEAVES) | (path.startswith("education") & ~path.rlike(r"^education\[[0-9]+\]\.description$"))


def escaped_length(text: Column) -> Column:
    """Characters of a text as a JSON string with everything but ASCII escaped, quotes included."""
    def many(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return F.length(text) + 2 + many(r'["\\\x08\x09\x0A\x0C\x0D]') + 5 * many(r"[\x00-\x07\x0B\x0E-\x1F]") + 5 * many(r"[\x{7f}-\x{ffff}]") - 5 * many(r"\x7f") + 11 * many(r"[\x{10000}-\x{10ffff}]")


def too_long(record_json_chars: Column, job: Column, prompt: Column) -> Column:
    """Which inputs are over their limits: record, job, prompt."""
    return F.array_compact(F.array(F.when(record_json_chars > RECORD_CHARS, "record"), F.when(F.length(job) > JOB_CHARS, "job"), F.when(F.length(prompt) > PROMPT_CHARS, "prompt")))


def text_verdict(text: Column, limit: int = TEXT_BYTES) -> Column:
    """Whether extracted text may be kept: empty, too_large or accepted."""
    return F.when(trimmed(F.coalesce(text, F.lit(""))) == "", "empty").when(F.octet_length(text) > limit, "too_large").otherwise("accepted")


def missing_keys(kind: Column, keys: Column) -> Column:
    """Keys that an answer of this kind lacks, in order; kinds without a rule lack none."""
    rules = reduce(lambda w, k: w.when(kind == k, F.array(*[F.lit(x) for x in REQUIRED[k]])), list(REQUIRED)[1:], F.when(kind == list(REQUIRED)[0], F.array(*[F.lit(x) for x in REQUIRED[list(REQUIRED)[0]]])))
    return F.array_except(F.coalesce(rules, F.array().cast("array<string>")), F.coalesce(keys, F.array().cast("array<string>")))


def page_verdict(is_pdf: Column, size: Column, pages: Column, has_text: Column) -> Column:
    """Whether a page shows something; what isn't known speaks against nothing."""
    return F.coalesce(is_pdf & (size >= LEAST_PAGE), F.lit(False)) & F.coalesce(has_text, F.lit(True)) & F.coalesce(pages != 0, F.lit(True))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 5)) == "255044462D", F.lit(False))


def identical(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether all pairs are equal, nulls included: a request that was carried out before."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def suggestions(skills: Column, duties: Column) -> Column:
    """Up to three skills and two duties as suggestions, or one for neither."""
    some = F.concat(F.transform(F.slice(skills, 1, 3), lambda s: F.concat(F.lit("skill:"), s)), F.transform(F.slice(duties, 1, 2), lambda s: F.concat(F.lit("duty:"), s)))
    return F.when(F.size(some) == 0, F.array(F.lit("general"))).otherwise(some)


def scrubbed(settings: Column) -> Column:
    """A map<string,string> of settings with secret values hidden."""
    return F.transform_values(settings, lambda k, v: F.when(k.isin(*SECRET_KEYS), HIDDEN).otherwise(v))


def masked(key: Column) -> Column:
    """A key by its first and last four characters; short ones by stars alone."""
    n = F.length(key)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(key, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(key, F.lit(4))))


def masked_short(key: Column) -> Column:
    """A key by its last four characters; null for none."""
    n = F.length(key)
    return F.when(n == 0, None).when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.lit("..."), F.right(key, F.lit(4))))


def held_to(text: Column, limit: int, notice: str = "[truncated]") -> Column:
    """A text held to a limit, without the space before the cut; a notice says so."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(limit)), r"[\x20\x09-\x0D]+$", ""), F.lit(f"\n\n{notice}")))


def token_budget(requested: Column, limit: Column, otherwise: int) -> Column:
    """Tokens to ask for: at least one, at most the model's limit, or a cautious one where that isn't known."""
    return F.least(F.greatest(requested, F.lit(1)), F.when(limit > 0, limit).otherwise(otherwise))


def seconds_allowed(operation: Column, tokens: Column, provider: Column) -> Column:
    """Whole seconds for an operation, more for many tokens and slow providers."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SECONDS.items() for x in p]), operation), F.lit(DEFAULT_SECONDS))
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in FACTORS.items() for x in p]), provider), F.lit(1.0))
    return F.floor(base * F.greatest(F.lit(1.0), tokens / 4096) * factor).cast("int")


def retry_temperature(attempt: Column, base: float = 0.1) -> Column:
    """Warmer with each attempt, up to the last step."""
    steps = F.array(F.lit(base), *[F.lit(t) for t in LATER_TEMPERATURES])
    return F.element_at(steps, F.least(attempt, F.lit(len(LATER_TEMPERATURES))) + 1)


def code_block(text: Column, language: str = "text") -> Column:
    shown = F.nullif(trimmed(F.coalesce(text, F.lit(""))), F.lit(""))
    return F.concat(F.lit(f"```{language}\n"), F.coalesce(shown, F.lit("<empty>")), F.lit("\n```"))


def filled_in(template: Column, params: Column) -> Column:
    """A template whose {names} are replaced from a map<string,string>; unknown names stay."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{[^{}]+\}|[^{]+|\{"), 0)

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\{([^{}]+)\}$", 1)
        return F.when((name != "") & F.map_contains_key(params, name), F.element_at(params, name)).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def title_words(text: Column, stop: tuple[str, ...], most: int = 8) -> Column:
    """The first words that are written like names: one capital, then small letters; without punctuation and stop words, each once."""
    bare = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    named = F.filter(bare, lambda w: w.rlike(r"^\p{Lu}\p{Ll}*$") & ~F.lower(w).isin(*stop))
    return F.slice(F.array_distinct(named), 1, most)


def keyword_block(required: Column, preferred: Column, other: Column) -> Column:
    """Keyword lists under their headings; a line of its own where there are none."""
    def part(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}:\n- "), F.array_join(items, "\n- ")))

    text = F.concat_ws("\n\n", part("required", required), part("preferred", preferred), part("other", other))
    return F.when(text == "", "none").otherwise(text)


def target_lines(targets: Column) -> Column:
    """Targets (structs of skill, source, reason) as lines, without those that have no skill."""
    clean = lambda x: trimmed(F.coalesce(x, F.lit("")))
    line = lambda t: F.concat(F.lit("- "), clean(t["skill"]), F.lit(" ("), F.coalesce(F.nullif(clean(t["source"]), F.lit("")), F.lit("unknown")), F.lit(")"), F.when(clean(t["reason"]) != "", F.concat(F.lit(": "), clean(t["reason"]))).otherwise(""))
    lines = F.transform(F.filter(targets, lambda t: clean(t["skill"]) != ""), line)
    return F.when(F.size(lines) == 0, "none").otherwise(F.array_join(lines, "\n"))


def one_of(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(otherwise)


def named_or_null(value: Column) -> Column:
    """A trimmed text, null where nothing is left."""
    return F.nullif(trimmed(value), F.lit(""))


def first_source(*texts: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def presence(matched: Column, total: Column, scale: float, when_empty: float) -> Column:
    """A share of keywords found, on a scale, with what no keywords at all count as."""
    return F.when(total > 0, matched * F.lit(scale) / total).otherwise(F.lit(when_empty))
