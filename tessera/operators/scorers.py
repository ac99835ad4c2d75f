"""Checks of a tailored record against its original."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.patches import _entries, _mapped, _parsed

#: Sections that must stay filled, parts of a custom section, keys and sections that are or aren't content (fixed values).
TRACKED = ("summary", "workExperience", "education", "personalProjects", "additional")
CUSTOM_PARTS = ("text", "strings", "items")
STRUCTURAL = ("id", "sectionType", "descriptionStyles", "isDefault", "isVisible", "order", "key", "displayName")
CONTENT = ("personalInfo", "summary", "workExperience", "education", "personalProjects", "additional", "customSections")
DEPTH = 10


def filled(value: Any) -> bool:
    """Text that isn't blank, a list with items, an object with something filled, or any other value but null."""
    if isinstance(value, dict):
        return any(map(filled, value.values()))
    return bool(value.strip()) if isinstance(value, str) else len(value) > 0 if isinstance(value, list) else value is not None


def meaningful(record: dict) -> bool:
    """Whether any section holds text that a reader would see, not deeper than ten levels."""
    # The names of custom sections are free, so they aren't structural keys.
    level = [v for s in CONTENT for v in ([*record[s].values()] if s == "customSections" and isinstance(record.get(s), dict) else [record.get(s)])]
    for _ in range(DEPTH):
        if any(isinstance(v, str) and v.strip() for v in level):
            return True
        level = [x for v in level for x in (v if isinstance(v, list) else [y for k, y in v.items() if k not in STRUCTURAL] if isinstance(v, dict) else ())]
    return False


def lost_sections(original: dict, tailored: dict) -> list[str]:
    """Sections filled before and no longer."""
    out = [s for s in TRACKED if filled(original.get(s)) and not filled(tailored.get(s))]
    was, now = ((r.get("customSections") if isinstance(r.get("customSections"), dict) else {}) for r in (original, tailored))

    def held(section: Any) -> bool:
        return isinstance(section, dict) and any(filled(section.get(p)) for p in CUSTOM_PARTS)

    return out + [f"customSections.{k}" for k, section in was.items() if held(section) and not held(now.get(k))]


def employers(record: dict) -> dict[str, str]:
    """Companies by their lower-case names, in the casing met first."""
    names = [e["company"].strip() for e in _entries(record, "workExperience") if isinstance(e, dict) and isinstance(e.get("company"), str) and e["company"].strip()]
    return {n.lower(): n for n in reversed(names)}


def made_up_employers(original: dict, tailored: dict) -> list[str]:
    known, named = employers(original), employers(tailored)
    first = {n.lower(): i for i, n in reversed([*enumerate(str(e.get("company") or "").strip() for e in _entries(tailored, "workExperience") if isinstance(e, dict))])}
    return [named[k] for k in sorted(named.keys() - known.keys(), key=first.__getitem__)]


def score_pairs(rows: DataFrame, original: str = "original", tailored: str = "tailored") -> DataFrame:
    """`rows` (two JSON records) with lost array<string>, made_up array<string>, same_identity and is_meaningful boolean."""
    def one(r: dict) -> tuple:
        a, b = _parsed(r[original], dict), _parsed(r[tailored], dict)
        same = json.dumps(a.get("personalInfo", {}), sort_keys=True) == json.dumps(b.get("personalInfo", {}), sort_keys=True)
        return lost_sections(a, b), made_up_employers(a, b), same, meaningful(b)

    return _mapped(rows, "lost array<string>, made_up array<string>, same_identity boolean, is_meaningful boolean", one)


def skill_key(skill: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(skill, r"(?U)\s+", " ")))


def verified_skills(plan: DataFrame, held: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """key, skill, verdict of planned skills: existing, jd_added, supported_by_resume or unsupported.

    plan (key, place, skill), held and wanted (key, skill), texts (key, text), one text a key. A skill
    counts once a key, where it comes first, and shows as those who hold or want it write it.
    """
    def named(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.trim("skill") != "").groupBy("key", skill_key(F.col("skill")).alias("k")).agg(F.min(F.trim("skill")).alias(name))

    first = plan.where(F.trim("skill") != "").groupBy("key", skill_key(F.col("skill")).alias("k")).agg(F.min(F.struct("place", F.trim("skill").alias("s")))["s"].alias("s"))
    both = first.join(named(held, "h"), ["key", "k"], "left").join(named(wanted, "w"), ["key", "k"], "left").join(texts, "key", "left")
    # As a whole term: no word character on either side of the skill.
    text, skill = F.lower(F.coalesce("text", F.lit(""))), F.lower("s")
    quoted = F.regexp_replace(skill, r"([^\p{L}\p{N}_\s])", r"\\$1")
    named_in_text = F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))
    verdict = F.when(F.col("h").isNotNull(), "existing").when(F.col("w").isNotNull(), "jd_added").when(named_in_text, "supported_by_resume").otherwise("unsupported")
    return both.select("key", F.coalesce("h", "w", "s").alias("skill"), verdict.alias("verdict"))
