"""Worn phrases and what is said instead."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrase and replacement (fixed values).
PHRASES = {
    "spearheaded": "led", "orchestrated": "coordinated", "championed": "advocated for", "synergized": "collaborated", "leveraged": "used",
    "revolutionized": "transformed", "pioneered": "introduced", "catalyzed": "initiated", "operationalized": "implemented", "architected": "designed",
    "envisioned": "planned", "effectuated": "completed", "endeavored": "worked", "facilitated": "helped", "utilized": "used",
    "synergy": "collaboration", "synergies": "collaborations", "paradigm": "approach", "paradigm shift": "change", "best-in-class": "top-performing",
    "world-class": "high-quality", "cutting-edge": "modern", "bleeding-edge": "modern", "game-changer": "innovation", "game-changing": "innovative",
    "disruptive": "innovative", "disruptor": "", "holistic": "comprehensive", "robust": "strong", "scalable": "expandable", "actionable": "practical",
    "impactful": "effective", "proactive": "active", "proactively": "actively", "stakeholder": "team member", "deliverables": "outputs",
    "bandwidth": "capacity", "circle back": "follow up", "deep dive": "analysis", "move the needle": "make progress", "low-hanging fruit": "quick wins",
    "touch base": "connect", "value-add": "benefit", "in order to": "to", "for the purpose of": "to", "with a view to": "to", "at the end of the day": "",
    "moving forward": "", "going forward": "", "on a daily basis": "daily", "on a regular basis": "regularly", "in a timely manner": "promptly",
    "at this point in time": "now", "due to the fact that": "because", "in the event that": "if", "in light of the fact that": "since",
    "—": ", ", "---": ", ", "--": ", ",
}
#: Longer phrases first, so that one within another doesn't take it apart.
ORDER = sorted(PHRASES, key=lambda p: (-len(p), p))


def plain_words(text: Column, job: Column | None = None) -> Column:
    """The text with phrases replaced wherever they stand, without regard to case; those in the job's text stay.

    Phrases come in ORDER, each after the ones before it; only those that the text then holds are searched for.
    """
    steps = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit("(?i)" + re.escape(p)).alias("pattern"), F.lit(PHRASES[p]).alias("by")) for p in ORDER])
    if job is not None:
        steps = F.filter(steps, lambda s: ~F.coalesce(F.contains(F.lower(job), s["phrase"]), F.lit(False)))
    return F.aggregate(steps, text, lambda out, s: F.when(F.contains(F.lower(out), s["phrase"]), F.regexp_replace(out, s["pattern"], s["by"])).otherwise(out))
