"""Secret scanning through an inverted index of trigrams, in DataFrame operations only.

Each rule's pattern is turned into a Boolean query over trigrams: texts that lack them cannot match. Postings of
the trigrams that some rule asks for are intersected per document and clause; the pattern itself runs only on the
candidates. A rule without mandatory trigrams runs on every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules of the base scan, then further well-known token forms.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = BASE + (
    Rule("private", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
#: More readings of a stretch than this make it say nothing.
_MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which a matching text fulfils one, by holding all its trigrams in lower case; [] for no demand."""
    clauses = _simplify(_sequence(rp.parse(pattern)))
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def _sequence(nodes) -> set[frozenset[str]]:
    """Clauses of nodes one after the other: literal stretches are read out, then joined by conjunction."""
    clauses, readings = {frozenset()}, {""}
    for node in nodes:
        exact = _readings(node)
        if exact is not None and len(exact) * len(readings) <= _MOST:
            readings = {a + b for a, b in product(readings, exact)}
            continue
        clauses = _both(_both(clauses, _demand(readings)), _clauses(node))
        # A repeated stretch still begins with what it repeats; what follows it starts afresh.
        readings = {""}
    return _both(clauses, _demand(readings))


def _readings(node) -> set[str] | None:
    """All strings that a node matches, or None where they are many."""
    kind, value = node
    if kind is rc.LITERAL:
        return {chr(value).lower()}
    if kind is rc.IN:
        found = set()
        for k, v in value:
            if k is not rc.LITERAL:
                return None
            found.add(chr(v).lower())
        return found
    if kind is rc.SUBPATTERN:
        return _all(value[-1])
    if kind is rc.BRANCH:
        parts = [_all(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, body = value
        each = _all(body)
        if each is None or high > 4 or len(each) ** int(high) > _MOST:
            return None
        return {"".join(p) for n in range(low, int(high) + 1) for p in product(each, repeat=n)}
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _readings(node)
        if found is None or len(found) * len(out) > _MOST:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def _clauses(node) -> set[frozenset[str]]:
    kind, value = node
    if kind is rc.SUBPATTERN:
        return _sequence(value[-1])
    if kind is rc.BRANCH:
        return _simplify(set().union(*[_sequence(p) for p in value[1]]))
    if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] > 0:
        return _sequence(value[2])
    return {frozenset()}


def _demand(readings: set[str]) -> set[frozenset[str]]:
    return _simplify({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in readings})


def _both(a, b):
    joined = {x | y for x, y in product(a, b)}
    return _simplify(joined) if len(joined) <= _MOST else a


def _simplify(clauses):
    """Without clauses that demand more than another one."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: a row (``trigram``, ``doc_id``, ``text_hash``) where a lower-cased text holds the trigram."""
    low = docs.select("doc_id", "text_hash", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id``, ``text_hash`` and the kinds of the rules whose trigram query the text fulfils."""
    rows = [(r.kind, n, t, len(clause)) for r in rules for n, clause in enumerate(trigram_query(r.pattern))
            for t in clause]
    if not rows:
        return docs.select("doc_id", "text_hash", F.array().cast("array<string>").alias("kinds")).limit(0)
    asked = docs.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, size int")
    found = postings(docs, sorted({r[2] for r in rows})).distinct()
    met = (found.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
           .groupBy("doc_id", "text_hash", "kind", "clause").agg(F.count("*").alias("n"), F.first("size").alias("size"))
           .where("n = size"))
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches: their places follow from what lies between them."""
    pattern = F.lit(rule.pattern)
    match = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    gap = F.transform(F.split("text", rule.pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,size:int>>")

    def step(done, x):
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(
            start.alias("start"), F.lit(order).alias("kind"), (start + x["match"]).alias("end"), x["value"].alias("size"))))

    placed = F.aggregate(F.arrays_zip(match.alias("match"), F.slice(gap, 1, F.size(match)).alias("gap"),
                                      value.alias("value")), empty, step)
    good = F.filter(placed, lambda s: s["size"] >= rule.least)
    return F.when(F.regexp_like("text", pattern), good).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (``start``, ``kind``, ``end``) in code points by start, then rule.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Null and empty texts have no spans; rows
    without ``doc_id`` and repeated rows are scanned like all others; an empty table gives no rows. Postings
    are bounded by the rules' trigrams per document; texts are shuffled once, to meet their candidate kinds.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    marked = candidates(rows, rules).select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), "kinds")
    rows = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("its_id"))
                     & (F.col("text_hash") == F.col("its_hash")), "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,size:int>>")
    found = []
    for order, rule in enumerate(rules):
        spans = _spans(rule, order)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(nothing)
        found.append(spans)
    ordered = F.array_sort(F.concat(*found))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return rows.select("doc_id", F.transform(ordered, lambda s: F.struct(
        s["start"].alias("start"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
