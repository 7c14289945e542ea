"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query of trigrams that every match
must contain. The index lists, for every trigram some rule asks for, the documents that hold
it; posting lists are intersected per conjunction, and only the candidates of a rule run its
expression. A rule without mandatory trigrams runs over every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import documents, packed, query, row_key

_TOO_MANY = 64      # alternatives of one literal run; beyond it the run is cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group ``group`` of it has ``least`` characters."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """The expression ``words`` with every letter in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_WORDS = either_case("(password|passwd|secret|token|api_?key)")
BASE = (
    Rule("assign", _WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
# fixed values: public formats of well-known credentials
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24}[A-Za-z0-9]*"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("uri", r"[a-z]+://[A-Za-z0-9_.-]+:[^\x20\x09-\x0D:/@]+@[A-Za-z0-9.-]+"),
)

Conjunctions = frozenset[frozenset[str]] | None     # any of these sets, or no constraint


# --- from a regular expression to trigrams ----------------------------------------

def _trigrams(texts: set[str]) -> Conjunctions:
    if any(len(t) < 3 for t in texts):
        return None
    return _shortest({frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts})


def _both(a: Conjunctions, b: Conjunctions) -> Conjunctions:
    if a is None or b is None:
        return b if a is None else a
    return _shortest({x | y for x in a for y in b})


def _any(parts: list[Conjunctions]) -> Conjunctions:
    return None if None in parts else _shortest({x for p in parts for x in p})


def _shortest(sets: set[frozenset[str]]) -> Conjunctions:
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _walk(node) -> tuple[set[str] | None, Conjunctions]:
    """(every string the node can match, if they are few; what any match must contain)."""
    run, need = {""}, None
    for op, arg in node:
        name, texts, inner = str(op), None, None
        if name == "LITERAL":
            texts = {chr(arg).lower()}
        elif name == "IN":
            chars = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < _TOO_MANY:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            texts = chars if chars and len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            texts, inner = _walk(arg[3])
        elif name == "BRANCH":
            found = [_walk(branch) for branch in arg[1]]
            texts = None if any(t is None for t, _ in found) else {x for t, _ in found for x in t}
            inner = _any([n if t is None else _both(n, _trigrams(t)) for t, n in found]) if texts is None else None
        elif name == "MAX_REPEAT":
            least, most, body = arg
            texts, inner = _walk(body)
            if (least, most) == (0, 1) and texts is not None:
                texts = texts | {""}
            elif texts is not None and least == most and len(texts) == 1:
                texts = {next(iter(texts)) * least}
            elif least == 0:
                texts, inner = None, None
            else:
                inner, texts = inner if texts is None else _both(inner, _trigrams(texts)), None
        need = _both(need, inner)
        if texts is not None and len(run) * len(texts) <= _TOO_MANY:
            run = {a + b for a, b in product(run, texts)}
        else:
            need, run = _both(need, _trigrams(run)), texts or {""}
            if texts is None:
                return _rest(node, op, arg, need)
    return run, need


def _rest(node, op, arg, need):
    """Go on after an item that can match too many strings: the run is broken there."""
    items = list(node)
    after = items[next(i for i, item in enumerate(items) if item[0] is op and item[1] is arg) + 1:]
    texts, more = _walk(after)
    return None, _both(need, more if texts is None else _both(more, _trigrams(texts)))


def trigram_query(regex: str) -> Conjunctions:
    """Sets of lower-case trigrams of which any match holds all of at least one; None: no constraint."""
    texts, need = _walk(re._parser.parse(regex))
    return need if texts is None else _both(need, _trigrams(texts))


# --- index, candidates, verification ------------------------------------------------

def trigram_index(docs: DataFrame, key: str, text: str, grams: Sequence[str]) -> DataFrame:
    """Postings (gram, key): which rows hold which of the ``grams``, letters in either case."""
    low = F.lower(text)
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(key), F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str, text: str) -> DataFrame | None:
    """(key, rules): the kinds whose trigram query a row satisfies, for rules that have one."""
    wanted = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    if not wanted:
        return None
    grams = sorted({g for q in wanted.values() for c in q for g in c})
    clauses = [(kind, i, len(c), g) for kind, q in wanted.items()
               for i, c in enumerate(sorted(map(sorted, q))) for g in c]
    # the conjunctions are a table as small as the rules
    table = F.broadcast(docs.sparkSession.createDataFrame(clauses, "kind string, clause int, need int, gram string"))
    met = (trigram_index(docs, key, text, grams).distinct().join(table, "gram")
           .groupBy(key, "kind", "clause", "need").agg(F.count(F.lit(1)).alias("have"))
           .where(F.col("have") == F.col("need")))
    return met.groupBy(key).agg(F.collect_set("kind").alias("_rules"))


def _matches(rule: Rule, text: Column) -> Column:
    """Array of (start, stop) of the matches that count, in code points."""
    regex = F.lit(rule.regex)
    between = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    part = F.regexp_extract_all(text, regex, F.lit(rule.group))
    steps = F.transform(F.arrays_zip(between.alias("gap"), whole.alias("hit"), part.alias("part")),
                        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"),
                                           F.length(z["part"]).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,part:int>>").alias("spans"))

    def step(acc, z):
        at = acc["at"] + z["gap"]
        span = F.array(F.struct(at.alias("start"), (at + z["hit"]).alias("stop"), z["part"].alias("part")))
        return F.struct((at + F.coalesce(z["hit"], F.lit(0))).alias("at"),
                        F.when(z["hit"].isNull() | (z["part"] < rule.least), acc["spans"])
                        .otherwise(F.concat(acc["spans"], span)).alias("spans"))

    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def _labelled(spans: Column, rank: int, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,stop:int,part:int>>")
    return F.transform(F.coalesce(spans, none), lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, text: str = "text") -> DataFrame:
    """``row`` (a row of ``docs`` as a struct) and ``spans``: (start, rank, kind, stop) by start, then rule.

    Offsets are code points, ends exclusive; matches of one rule do not overlap, those of
    several may. A null or empty text has no spans; repeated rows each get theirs; other columns
    stay in ``row``, whatever their names; an empty table gives no rows. Texts are searched whole,
    whatever their length.
    """
    keyed = packed(docs, text).withColumnRenamed(text, "_text")
    keyed = keyed.withColumn("_key", row_key("_text", *(["row.doc_id"] if "doc_id" in docs.columns else [])))
    asked = candidates(keyed, rules, "_key", "_text")
    indexed = {r.kind for r in rules if trigram_query(r.regex) is not None}
    if asked is not None:
        keyed = keyed.join(asked, "_key", "left")
    content = F.coalesce("_text", F.lit(""))
    found = []
    for rank, rule in enumerate(rules):
        probe = rule.regex
        if rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.regex):
            # runs of one class: most texts have no run of the least length
            probe = f"{rule.regex[:-1]}{{{rule.least},}}"
        hits = F.when(F.rlike(content, F.lit(probe)), _matches(rule, content))
        if rule.kind in indexed:
            hits = F.when(F.array_contains("_rules", rule.kind), hits)
        found.append(_labelled(hits, rank, rule.kind))
    return keyed.select("row", F.array_sort(F.concat(*found)).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every match of every rule (joined where they overlap) replaced by ``mask`` in ``text``.

    Rows without secrets, null and empty texts are unchanged; ``n_chars`` follows the text. The columns of
    ``docs`` stay, whatever their names; repeated rows stay repeated.
    """
    scanned, text = scan(docs, rules), F.col("row.text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.concat(acc["out"], gap, F.when(fresh, F.lit(mask)).otherwise("")).alias("out"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    row = F.col("row")
    return scanned.select(*[(F.when(F.size("spans") > 0, new[c]).otherwise(row[c]) if c in new else row[c]).alias(c)
                            for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _sql(rules: Sequence[Rule]) -> str:
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for rank, r in enumerate(rules):
        # RE2 has no limit on what stands before a match; gaps are the text between matches
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, hits, parts, gaps, {r.least} AS least FROM (
    SELECT doc_id, regexp_extract_all(t, {quoted(r.regex)}, 0) AS hits,
           regexp_extract_all(t, {quoted(r.regex)}, {r.group}) AS parts,
           string_split_regex(t, {quoted(r.regex)}) AS gaps FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT doc_id, rank, kind, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, rank, kind, CAST(len(array_to_string(gaps[1:i], '')) + len(array_to_string(hits[1:i-1], '')) AS BIGINT) AS start,
         len(hits[i]) AS n FROM u WHERE len(parts[i]) >= least),
g AS (
  SELECT doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign,
         CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank)
                  FILTER (kind IN ('assign', 'access', 'hex')), '') AS base,
         string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


@query("op8_secret_scan", _sql(BASE + MORE))
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("row.doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
