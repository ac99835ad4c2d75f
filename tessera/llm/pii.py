"""Personal data: base patterns, and bootstrapped contextual extraction (native: DataFrame functions only).

The base patterns find e-mail addresses, IP addresses, card and phone numbers; a fifth kind, secret, has seeds by
format alone (SECRET). These are seed entities. What stands around an entity are its lexical patterns: the word
before it, the two words before it, the label it is glued to ("card=..."), the word after it. In rounds, Spark
scores the graph of patterns and instances: a pattern's confidence in a kind is the lower end (Wilson, Z standard
deviations) of the share of its identifier-like occurrences that known instances of the kind fill; that of an
unknown identifier is the confidence of its patterns together. Identifiers over the threshold become known, vote
for further patterns, and are reported wherever they occur. What has the form of a base kind but fails its check
(a card number's last digit) counts against a pattern and is never reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Java forms of the base patterns that match the same spans without backtracking: possessive repeats, and a
#: run of local-part characters or digits is only tried from its first.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPACE, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Identifier-like: up to seven pieces of digits and their punctuation, or a token with a digit, @, _ or quote.
TOKEN = (rf"(?<!{SOLID})(?:[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+){{1,6}}+(?!{SOLID})"
         r'|[^\x20\x09-\x0D0-9@_"]*+[0-9@_"][^\x20\x09-\x0D]*+)')
#: The token without what encloses it, and the label in front of its value.
CORE, LABEL = r"(?s)(?:\((?=[0-9]+\))|[A-Za-z0-9+]).*[A-Za-z0-9]", r"""^[A-Za-z_][A-Za-z_.-]{1,30}[=:]["']*"""
#: Forms that fail the check of their base kind, where they are no base span.
REFUSED = r"^(?:[0-9](?:[\x20-]?[0-9]){12,18}|[0-9]+(?:\.[0-9]+){3}|\+[0-9][\x20().0-9-]+[0-9])$"
#: Seeds of the kind secret: long hexadecimal strings, keys with a maker's prefix, signed tokens.
SECRET = r"^(?:(?=.*[a-fA-F])(?=.*[0-9])[0-9a-fA-F]{32,}|(?:sk-|AIza|AKIA|gh[pousr]_|xox[abp]-)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
#: Characters looked at before and after an entity.
BEFORE, AFTER = 80, 40
#: Unknown identifiers have so many characters at least; patterns so many distinct known instances.
LEAST_LENGTH, LEAST_SUPPORT = 6, 3
CONFIDENCE, ROUNDS, Z = 0.5, 3, 3.0


def _pieces(rows: DataFrame, pattern: str, has: Column) -> DataFrame:
    """id, digest, start, end, s of every match, and the text on both sides as `before` and `after`.

    Both reach over the neighbouring match at most.
    """
    found = rows.where(has).withColumn("found", F.regexp_extract_all("text", F.lit(pattern), 0)).where(F.size("found") > 0)
    # The parts between the matches give their places.
    parts = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("tail"), F.left(g, F.lit(AFTER)).alias("head")))
    each = found.select("id", "digest", "found", parts.alias("gaps")).select("id", "digest", "gaps", "found", F.posexplode("found").alias("k", "s"))
    at = lambda x, i: F.get(x, F.col("k") + i)
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    before = F.right(F.concat(or_empty(at("gaps", -1)["tail"]), or_empty(at("found", -1)), at("gaps", 0)["tail"]), F.lit(BEFORE))
    after = F.left(F.concat(or_empty(at("gaps", 1)["head"]), or_empty(at("found", 1))), F.lit(AFTER))
    each = each.select("id", "digest", "k", "s", at("gaps", 0)["n"].alias("gap"), before.alias("before"), after.alias("after"))
    order = Window.partitionBy("id", "digest").orderBy("k")
    end = F.sum(F.col("gap") + F.length("s")).over(order).cast("long")
    return each.distinct().withColumn("end", end).select("id", "digest", (F.col("end") - F.length("s")).alias("start"), "end", "s", "before", "after")


def _luhn(digits: Column) -> Column:
    """Holds where the digits, every second from the right doubled, sum to a multiple of 10."""

    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Column:
    digits = F.regexp_replace("s", "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.col("s").rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """id, digest, kind (its place in KINDS), start, end, s, before, after of all base matches in rows(id, digest, text)."""
    out = None
    for k, kind in enumerate(BASE_KINDS):
        has = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("text").rlike("[0-9]")
        part = _pieces(rows, PATTERNS[kind], has).where(_valid(kind)).withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _candidates(rows: DataFrame) -> DataFrame:
    """id, digest, start, end, s, before, after of the values of identifier-like tokens."""
    tokens = _pieces(rows, TOKEN, F.col("text").rlike('[0-9@_"]'))
    tokens = tokens.withColumn("core", F.regexp_extract("s", CORE, 0)).where(F.length("core") >= LEAST_LENGTH)
    tokens = tokens.withColumn("skip", F.instr("s", F.col("core")) - 1 + F.length(F.regexp_extract("core", LABEL, 0)))
    tokens = tokens.withColumn("value", F.substring(F.col("core"), F.length(F.regexp_extract("core", LABEL, 0)) + 1, F.length("core")))
    tokens = tokens.where(F.length("value") >= LEAST_LENGTH)
    start = (F.col("start") + F.col("skip")).cast("long")
    behind = F.substring(F.col("s"), F.col("skip") + F.length("value") + 1, F.length("s"))
    return tokens.select(
        "id", "digest", start.alias("start"), (start + F.length("value")).alias("end"), F.col("value").alias("s"),
        F.concat("before", F.substring(F.col("s"), F.lit(1), F.col("skip"))).alias("before"), F.concat(behind, F.col("after")).alias("after"))


def patterns_around() -> Column:
    """The lexical patterns of an entity with text `before` and `after` it."""
    glued = F.regexp_extract("before", r"""([A-Za-z_][A-Za-z_.-]{1,30}[=:])["'(]*$""", 1)
    left = F.regexp_replace("before", rf"{SOLID}*$", "")
    one = F.regexp_extract(left, rf"({SOLID}+){SPACE}+$", 1)
    two = F.regexp_extract(left, rf"({SOLID}+{SPACE}+{SOLID}+){SPACE}+$", 1)
    right = F.regexp_extract("after", rf"^{SOLID}*{SPACE}+({SOLID}+)", 1)
    plain = lambda x: F.lower(F.regexp_replace(x, rf"{SPACE}+", " "))
    named = [F.when(x != "", F.concat(F.lit(name), plain(x))) for name, x in (("in:", glued), ("left:", one), ("two:", two), ("right:", right))]
    return F.array_compact(F.array(*named))


def wilson(hits: Column, total: Column, z: float) -> Column:
    """Lower end of the interval for a share of hits in total."""
    p = hits / total
    return (p + z * z / (2 * total) - z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def _learned(rows: DataFrame, base: DataFrame, rounds: int, z: float) -> DataFrame:
    """id, digest, kind, start, end of identifiers that formats and contexts disclose, apart from base spans."""
    both = base.unionByName(_candidates(rows).withColumn("kind", F.lit(None).cast("int")))
    order = Window.partitionBy("id", "digest").orderBy("start", F.col("kind").asc_nulls_last())
    is_base = F.col("kind").isNotNull()
    both = both.withColumns({
        "covered": F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next": F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    apart = F.coalesce(F.col("covered") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    seed = F.when(is_base, F.col("kind")).when(F.col("s").rlike(SECRET), F.lit(KINDS.index("secret")))
    seen = both.where(is_base | apart).select(
        "id", "digest", "start", "end", F.lower("s").alias("value"), is_base.alias("base"), seed.alias("seed"),
        (~is_base & F.col("s").rlike(REFUSED)).alias("refused"), patterns_around().alias("patterns"))
    seen = cut(seen)
    seeds = cut(seen.where("seed is not null").groupBy("value").agg(F.min("seed").alias("kind")))
    # Edges of the graph: how often a value has a pattern. Those of patterns that can't reach the support go.
    edges = seen.select("value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= LEAST_SUPPORT).select("pattern", "total")
    edges = cut(edges.join(totals, "pattern"))
    refused = seen.where("refused").select("value").distinct()
    open_edges = cut(edges.join(seeds.hint("merge"), "value", "left_anti").join(refused.hint("merge"), "value", "left_anti").select("pattern", "value"))
    new, size = None, 0
    for _ in range(rounds):
        known = seeds if new is None else seeds.unionByName(new)
        hits = edges.join(known.hint("merge"), "value").groupBy("pattern", "kind", "total").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("instances"))
        scored = hits.where(F.col("instances") >= LEAST_SUPPORT).withColumn("confidence", wilson(F.col("hits"), F.col("total"), z))
        good = cut(scored.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        found = open_edges.join(good, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        best = found.groupBy("value").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
        new, before = cut(best.select("value", (-F.col("b.k")).alias("kind"))), size
        size = new.count()
        if size == before:
            break
    named = seeds.where(F.col("kind") == KINDS.index("secret"))
    named = named.unionByName(new) if new is not None else named
    return seen.where(~F.col("base")).join(named.hint("merge"), "value").select("id", "digest", "kind", "start", "end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, z: float = Z) -> DataFrame:
    """One row per row of docs: id and two arrays of (kind, start, end) in code points, end exclusive: base and all.

    kind is a place in KINDS; arrays are ordered by kind and start and empty where nothing is found. base has
    what the base patterns find; all has these, the secrets and what contexts disclose, which overlap no base
    span. Null text counts as empty. Rows that repeat an id and text come out alike. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    base = cut(base_spans(rows))
    learned = _learned(rows, base, rounds, z)
    every = base.select("id", "digest", "kind", "start", "end", F.lit(True).alias("base")).unionByName(learned.withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    of_doc = cut(every.groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_set(span)).alias("all")))
    joined = rows.select("id", "digest").alias("r").join(of_doc.hint("merge").alias("s"), F.expr("r.id <=> s.id and r.digest = s.digest"), "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return joined.select(F.col("r.id").alias(id_col), F.coalesce("base", empty).alias("base"), F.coalesce("all", empty).alias("all"))


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of personal_data(); n_spans counts all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select(id_col, *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k
