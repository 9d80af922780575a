"""Secret rules as a table: hundreds of rules for little more than the price of a few.

Hints decide which rules can match a text at all; only their patterns are tried, by the same expressions
that serve the built-in rules. So the rows are those that `secrets.secret_matches` gives for the same rules.
A small table is held by every task, as one automaton over its hints. A larger one stays a table: the texts'
substrings that may be hints are joined with it, and neither the driver nor a task holds the rules.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit.functions import decode_text, evaluated_once, is_placeholder
from corpaudit.operators import secrets
from corpaudit.operators.files import secret_candidates
from corpaudit.operators.findings import finding_rows
from corpaudit.storage import stored

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = (
    "position int, id string, severity string, pattern string, title string, recommendation string, "
    "group int, hints array<string>, folded boolean"
)
# One rule may have so many characters, and more is refused.
LIMIT_CHARS = 64 << 20
# Tables of so many characters are held by every task, larger ones are joined.
HELD_CHARS = 1 << 20
# Texts that are searched at once, in characters; bits of the filter per hint and at most.
CHUNK_CHARS = 1 << 20
HINT_BITS = 32
MOST_BITS = 27

_CANDIDATE = pa.struct([
    ("position", pa.int32()), ("id", pa.string()), ("pattern", pa.string()), ("group", pa.int32()), ("whole", pa.bool_()),
])
_CANDIDATES = "array<struct<position: int, id: string, pattern: string, group: int, whole: boolean>>"
_HITS = "array<struct<line: int, id: string, match: int, evidence: string, length: int, entropy: double>>"


def rules_table(spark: SparkSession, rules: Sequence[secrets.SecretRule]) -> DataFrame:
    """Rules as rows; position is their order within a line."""
    rows = [
        (i, r.id, r.severity, r.pattern, r.title, r.recommendation, r.group, list(r.hints), r.folded)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES)


class _Index:
    """Which rules have a hint in a text."""

    def __init__(self, rules: list[tuple]):
        # (position, id, pattern, group, hints, folded, whole)
        self.rules = [
            {"position": p, "id": i, "pattern": x, "group": g, "whole": w} for p, i, x, g, _, _, w in rules
        ]
        self.always = [k for k, r in enumerate(rules) if not r[4]]
        self.exact = self._machine(rules, False)
        self.folded = self._machine(rules, True)

    @staticmethod
    def _machine(rules: list[tuple], folded: bool):
        owners: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            if rule[5] == folded:
                for hint in rule[4]:
                    owners.setdefault(hint, []).append(k)
        if not owners:
            return None
        try:
            import ahocorasick
        except ImportError:
            # one search per hint: the same rules, found slowly
            return lambda text: {k for hint, owned in owners.items() if hint in text for k in owned}
        machine = ahocorasick.Automaton()
        for hint, owned in owners.items():
            machine.add_word(hint, owned)
        machine.make_automaton()

        def found(text: str) -> set[int]:
            hits: set[int] = set()
            for _, owned in machine.iter(text):
                hits.update(owned)
            return hits

        return found

    def candidates(self, text: str | None) -> list[dict]:
        if text is None:
            return []
        found = set(self.always)
        if self.exact:
            found |= self.exact(text)
        if self.folded:
            found |= self.folded(text.lower())
        return [self.rules[k] for k in sorted(found)]


@cache
def _index(rules: tuple) -> _Index:
    return _Index(list(rules))


def _size(rules: DataFrame) -> int:
    """Characters of all rules, after a check of each."""
    size = F.coalesce(F.length("pattern") + F.length("id") + F.length(F.array_join("hints", "")), F.lit(0))
    chars, longest = rules.agg(F.sum(size), F.max(size)).first()
    if (longest or 0) > LIMIT_CHARS:
        raise ValueError(f"a rule has {longest} characters, more than {LIMIT_CHARS}")
    return chars or 0


def _collected(rules: DataFrame) -> tuple:
    """The rules in order."""
    return tuple(
        (r["position"], r["id"], r["pattern"], r["group"], tuple(h for h in r["hints"] or () if h), bool(r["folded"]),
         not secrets.looks_around(r["pattern"]))
        for r in rules.orderBy("position", "id").collect()
    )


def _hits(text: Column, candidates: Column, min_stars: int) -> Column:
    """Array of (line, id, match, evidence, length, entropy) of one text, by the rules that may match it."""

    def line_hits(line: Column, confirmed: Column) -> Column:
        def of_rule(rule: Column) -> Column:
            values = F.regexp_extract_all(line, rule["pattern"], rule["group"])
            real = F.filter(values, lambda v: ~is_placeholder(v))
            return F.transform(real, lambda v: F.struct(rule["id"].alias("rule"), v.alias("value")))

        return F.flatten(F.transform(confirmed, of_rule))

    # a pattern that looks around can match a line but not the text
    confirmed = F.filter(candidates, lambda r: ~r["whole"] | F.regexp_like(text, r["pattern"]))
    empty = F.array().cast(_HITS)

    def examined(rules: Column) -> Column:
        found = secrets.examined(text, lambda line: line_hits(line, rules), min_stars, _HITS)
        return F.when(F.size(rules) > 0, found).otherwise(empty)

    return evaluated_once(confirmed, examined)


def indexed_hits(text: Column, rules: DataFrame, *, min_stars: int = 4) -> Column:
    """Array of (line, id, match, evidence, length, entropy) of one text; usually empty.

    A rule without hints is tried on every text, an empty hint is none. Rules of one position are
    ordered by id. Every task holds all rules.
    """
    known = _collected(rules)

    @F.arrow_udf(_CANDIDATES)
    def candidates(texts: pa.Array) -> pa.Array:
        index = _index(known)
        return pa.array([index.candidates(t) for t in texts.to_pylist()], pa.list_(_CANDIDATE))

    return _hits(text, candidates(text), min_stars)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _slots(text: str, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of 2**bits for every substring of the size, by its start: a rolling hash."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n)[:n], out=sums[1:])
    hashed = (sums[size:] - sums[:-size]) * _powers(_INVERSE, n)[: n - size + 1]
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    return hashed >> np.uint64(64 - bits), (hashed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


class _HintFilter:
    """Which substrings of a text may be hints: no hint is missed, few others pass."""

    def __init__(self, bits: int, words: np.ndarray, sizes: list[int]):
        self.bits, self.words, self.sizes = bits, words, sizes

    @staticmethod
    def of(hints: DataFrame) -> _HintFilter | None:
        """The driver sees the sizes of the hints and the bits of the filter, whose number is bounded."""
        sizes = sorted(r[0] for r in hints.select(F.length("hint")).distinct().collect())
        if not sizes:
            return None
        bits = min(MOST_BITS, max(6, (HINT_BITS * hints.count()).bit_length()))

        @F.arrow_udf("array<long>")
        def places(texts: pa.Array) -> pa.Array:
            return pa.array([[int(s[0]) for s in _slots(t, len(t), bits)] for t in texts.to_pylist()], pa.list_(pa.int64()))

        place = hints.select(F.explode(places("hint")).alias("place"))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        rows = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return _HintFilter(bits, words.view(np.uint64), sizes)

    def _passes(self, slots: np.ndarray) -> np.ndarray:
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0

    def _search(self, pieces: list[tuple[int, str]], found: list[set[str]]) -> None:
        text = "".join(p for _, p in pieces)
        owners = np.repeat([i for i, _ in pieces], [len(p) for _, p in pieces])
        for size in self.sizes:
            if size > len(text):
                break
            one, other = _slots(text, size, self.bits)
            inside = owners[: len(text) - size + 1] == owners[size - 1 :]
            starts = np.flatnonzero(inside & self._passes(one))
            for at in starts[self._passes(other[starts])].tolist():
                found[owners[at]].add(text[at : at + size])

    def substrings(self, texts: list[str | None]) -> list[set[str]]:
        """Per text. Long texts are searched in pieces that overlap, short ones many at a time."""
        found: list[set[str]] = [set() for _ in texts]
        pieces, chars, overlap = [], 0, self.sizes[-1] - 1
        for i, text in enumerate(texts):
            for at in range(0, len(text or ""), CHUNK_CHARS):
                piece = text[at : at + CHUNK_CHARS + overlap]
                if chars + len(piece) > CHUNK_CHARS and pieces:
                    self._search(pieces, found)
                    pieces, chars = [], 0
                # two pieces of one text do not stand side by side
                pieces.append((i, piece))
                chars += len(piece)
                if at + CHUNK_CHARS < len(text):
                    self._search(pieces, found)
                    pieces, chars = [], 0
        if pieces:
            self._search(pieces, found)
        return found


_RULE = ("position", "id", "rule_key", "pattern", "group", "whole")
_SUBSTRINGS = "array<struct<folded: boolean, hint: string>>"
_SUBSTRING = pa.struct([("folded", pa.bool_()), ("hint", pa.string())])


def joined_hits(texts: DataFrame, rules: DataFrame, *, min_stars: int = 4) -> DataFrame:
    """(repo_id, path, hits) of the texts (repo_id, path, text) that a rule may match; hits as in indexed_hits.

    For tables of rules of any size: only bounded filters over their hints go to all tasks.
    """
    bare = F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: h != "")
    whole = ~F.col("pattern").rlike(secrets.LOOKS_AROUND)
    known = stored(
        rules.select(
            "position", "id", "pattern", "group", F.array_distinct(bare).alias("hints"),
            F.coalesce("folded", F.lit(False)).alias("folded"), whole.alias("whole"),
            F.monotonically_increasing_id().alias("rule_key"),
        ),
        "rules",
    )
    hints = known.select(F.explode("hints").alias("hint"), "folded", *_RULE)
    filters = [(folded, _HintFilter.of(hints.filter(F.col("folded") == folded))) for folded in (False, True)]
    unhinted = known.filter(F.size("hints") == 0).select(F.struct(*_RULE).alias("rule"))
    for_all = not unhinted.isEmpty()

    @F.arrow_udf(_SUBSTRINGS)
    def substrings(batch: pa.Array) -> pa.Array:
        values = batch.to_pylist()
        out: list[list[dict]] = [[] for _ in values]
        for folded, hinted in filters:
            if hinted is not None:
                searched = [t.lower() if folded and t is not None else t for t in values]
                for row, found in zip(out, hinted.substrings(searched)):
                    row.extend({"folded": folded, "hint": h} for h in found)
        return pa.array(out, pa.list_(_SUBSTRING))

    # marked so that the filter on the result does not search a text twice
    looked = texts.withColumn("found", substrings.asNondeterministic()(F.col("text")))
    kept = stored(
        looked.filter((F.size("found") > 0) | F.lit(for_all)).withColumn("text_key", F.monotonically_increasing_id()), "texts"
    )
    found = kept.select("text_key", F.explode("found").alias("f")).select("text_key", "f.folded", "f.hint")
    pairs = found.join(hints, ["folded", "hint"]).select("text_key", F.struct(*_RULE).alias("rule"))
    if for_all:
        rule = F.col("rule")
        may_match = ~rule["whole"] | F.regexp_like(F.col("text"), rule["pattern"])
        pairs = pairs.unionByName(
            kept.filter(F.col("text").isNotNull()).crossJoin(unhinted).filter(may_match).select("text_key", "rule")
        )
    # a text names a rule once, however many of its hints it holds
    candidates = pairs.groupBy("text_key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = kept.join(candidates, "text_key").select("repo_id", "path", "text", "rules")
    return rows.select("repo_id", "path", _hits(F.col("text"), F.col("rules"), min_stars).alias("hits"))


def secret_matches_by_rules(files: DataFrame, rules: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """One row per match of a rule of the table (schema RULES); value redacted."""
    texts = secret_candidates(files).select("repo_id", "path", decode_text(F.col("content"), max_bytes).alias("text"))
    if _size(rules) <= HELD_CHARS:
        hits = texts.select("repo_id", "path", indexed_hits(F.col("text"), rules).alias("hits"))
    else:
        hits = joined_hits(texts, rules)
    exploded = hits.select("repo_id", "path", F.explode_outer("hits").alias("hit")).filter(F.col("hit").isNotNull())
    return exploded.select("repo_id", "path", "hit.line", F.col("hit.id").alias("rule"), "hit.match", "hit.evidence", "hit.length", "hit.entropy")


def findings_by_rules(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the matches; severity and wording come from the table, which is joined whatever its size."""
    told = rules.select(F.col("id").alias("rule"), "severity", "title", "recommendation").dropDuplicates(["rule"])
    joined = matches.join(told, "rule")
    return finding_rows(
        joined,
        id=F.format_string("%s-%03d", F.col("rule"), F.col("match")),
        severity=F.col("severity"),
        category="Security",
        title=F.col("title"),
        path=F.col("path"),
        line=F.col("line"),
        evidence=F.col("evidence"),
        explanation=F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(" holds a value shaped like a secret.")),
        recommendation=F.col("recommendation"),
    )
