"""Secret-like values in text: matching, redaction, findings.

A file's matches are found, numbered and redacted inside its own row, so no
shuffle is needed and no raw value leaves the expression. Cheap byte searches
decide which files and lines meet a regular expression at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import (
    basename, decode_text, evaluated_once, hashed_id, is_placeholder, py_strip, redact,
    shannon_entropy, split_lines,
)
from corpaudit.operators.files import secret_candidates
from corpaudit.operators.findings import finding_rows


@dataclass(frozen=True)
class SecretRule:
    """pattern: Java regular expression applied per line; group: the value.

    hints: literal substrings of which at least one occurs in every match.
    folded: the hints are lower case and compared with the lower-cased text.
    """

    id: str
    severity: str
    pattern: str
    title: str
    recommendation: str
    group: int = 0
    hints: tuple[str, ...] = ()
    folded: bool = False


# Ids, severities and patterns.
SECRET_RULES = (
    SecretRule(
        "SEC-AWS-KEY", "CRITICAL", r"(?U)\bAKIA[0-9A-Z]{16}\b",
        "AWS access key id", "Revoke the key and issue a new one.",
        hints=("AKIA",),
    ),
    SecretRule(
        "SEC-STRIPE-KEY", "HIGH", r"(?U)\b(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}\b",
        "Stripe API key", "Roll the key in the payment account if it is live.",
        hints=("_live_", "_test_"),
    ),
    SecretRule(
        "SEC-PRIVATE-KEY", "CRITICAL",
        r"-----BEGIN (RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----",
        "Private key block", "Take the key out of the tree and replace it.",
        hints=(" PRIVATE KEY-----",),
    ),
    SecretRule(
        "SEC-DB-CONN", "HIGH",
        r"(?U)\b(postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^\s\"']+:[^\s\"'@]+@[^\s\"']+",
        "Database address with credentials", "Keep credentials out of the address.",
        hints=("postgres://", "postgresql://", "mysql://", "mongodb://", "mongodb+srv://"),
    ),
    SecretRule(
        "SEC-GENERIC-ASSIGN", "MEDIUM",
        r"(?iU)\b(api[_-]?key|secret[_-]?key|access[_-]?token|password)\b\s*[:=]\s*['\"]([^'\"\s]{8,})['\"]",
        "Credential written into an assignment", "Read the value from the environment.",
        group=2,
        # the long s folds to s in the pattern but not in lower()
        hints=("password", "key", "token", "\u017f"),
        folded=True,
    ),
)
_HITS = "array<struct<line:int,rule:int,match:int,evidence:string,length:int,entropy:double>>"
_LINE_HITS = "array<struct<rule:int,value:string>>"


# What makes a pattern see more than its own match: anchors and look-arounds.
LOOKS_AROUND = r"[\^$]|\\[AGZz]|\(\?<?[=!]"


# Steps of _redacted that every line gets.
_FEW_STEPS = 3


def looks_around(pattern: str) -> bool:
    return re.search(LOOKS_AROUND, pattern) is not None


def _may_match(rule: SecretRule, text: Column, lowered: Column) -> Column:
    """Necessary condition for a match in some line: a hint, and the pattern over the text.

    A pattern with anchors or look-arounds can match a line but not the text, so for it the hints
    decide alone.
    """
    matches = F.lit(True) if looks_around(rule.pattern) else text.rlike(rule.pattern)
    if not rule.hints:
        return text.isNotNull() & matches
    where = lowered if rule.folded else text
    hinted = reduce(or_, [F.contains(where, F.lit(h)) for h in rule.hints])
    return hinted & matches


def _line_hits(rules: Sequence[SecretRule], line: Column, applies: Column) -> Column:
    """Array of (rule, value) for one line, in rule and match order."""

    def hits(position: int, rule: SecretRule) -> Column:
        values = F.regexp_extract_all(line, F.lit(rule.pattern), rule.group)
        real = F.filter(values, lambda v: ~is_placeholder(v))
        found = F.transform(real, lambda v: F.struct(F.lit(position).alias("rule"), v.alias("value")))
        return F.when(F.get(applies, F.lit(position)), found).otherwise(F.array().cast(_LINE_HITS))

    return F.concat(*[hits(i, r) for i, r in enumerate(rules)])


def _redacted(line: Column, values: Column, min_stars: int) -> Column:
    """The line's first EVIDENCE_CHARS characters with every found value redacted; computed once for
    all its hits.

    One pass from left to right: each step appends the text before the next value and that value's
    redacted form, until there is enough. Only values that begin in the characters still needed are
    looked for, so the work grows with the line, not with the line times its values. Of values that
    begin together the longest is hidden; one that reaches into a later value ends where that begins.
    """
    start = F.struct(F.lit("").alias("done"), py_strip(line).alias("rest"))

    def begins(rest: Column, need: Column, distinct: Column) -> Column:
        at = F.transform(
            distinct,
            lambda v: F.struct(
                F.position(v, F.left(rest, need + F.length(v) - 1)).alias("at"), (-F.length(v)).alias("size"), v.alias("value")
            ),
        )
        return F.array_min(F.filter(at, lambda f: f["at"] > 0))

    def hidden_part(rest: Column, first: Column, distinct: Column) -> Column:
        """How much of the first value is hidden before a later one that reaches beyond it."""
        size = -first["size"]
        inner = F.transform(
            distinct,
            # one character after the first value's start, so that the place is the offset
            lambda v: F.struct(
                F.position(v, F.substring(rest, first["at"] + 1, size + F.length(v) - 2)).alias("at"), F.length(v).alias("size")
            ),
        )
        beyond = F.filter(inner, lambda f: (f["at"] > 0) & (f["at"] + f["size"] > size))
        return F.coalesce(F.array_min(F.transform(beyond, lambda f: f["at"])), size)

    def ended(state: Column) -> Column:
        return (F.length(state["done"]) >= K.EVIDENCE_CHARS) | (state["rest"] == "")

    def step(state: Column, distinct: Column) -> Column:
        done, rest = state["done"], state["rest"]
        need = F.lit(K.EVIDENCE_CHARS) - F.length(done)

        def after(first: Column) -> Column:
            hide = lambda n: F.struct(
                F.concat(done, F.left(rest, first["at"] - 1), redact(F.left(first["value"], n), min_stars=min_stars)).alias("done"),
                F.substring(rest, first["at"] + n, F.length(rest)).alias("rest"),
            )
            plain = F.struct(F.concat(done, F.left(rest, need)).alias("done"), F.lit("").alias("rest"))
            return F.when(first.isNull(), plain).otherwise(evaluated_once(hidden_part(rest, first, distinct), hide))

        return F.when(ended(state), state).otherwise(evaluated_once(begins(rest, need, distinct), after))

    def display(distinct: Column) -> Column:
        def steps(state: Column, most: int) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: step(s, distinct))

        # a step makes a character or more; nearly all lines end within the first few
        return evaluated_once(
            steps(start, _FEW_STEPS),
            lambda s: F.when(ended(s), s["done"]).otherwise(steps(s, K.EVIDENCE_CHARS)["done"]),
        )

    bare = F.filter(F.array_distinct(F.transform(values, py_strip)), lambda v: v != "")
    return F.left(evaluated_once(bare, display), F.lit(K.EVIDENCE_CHARS))


def secret_hits(
    text: Column, rules: Sequence[SecretRule] = SECRET_RULES, *, min_stars: int = 4
) -> Column:
    """Array of (line, rule, match, evidence, length, entropy); usually empty.

    match counts from 1 within the file. The value itself is not kept.
    """
    rules = list(rules)
    applies = evaluated_once(
        F.lower(text),
        lambda low: F.array(*[F.coalesce(_may_match(r, text, low), F.lit(False)) for r in rules]),
    )
    # evaluated once per file; most files end here
    return evaluated_once(
        applies,
        lambda flags: F.when(
            F.array_contains(flags, True), examined(text, lambda line: _line_hits(rules, line, flags), min_stars)
        ).otherwise(F.array().cast(_HITS)),
    )


def examined(text: Column, line_hits: Callable[[Column], Column], min_stars: int, schema: str = _HITS) -> Column:
    """Hits of all lines of a text, numbered, with redacted evidence.

    line_hits gives one line's (rule, value) in order; schema names the fields of the result.
    """
    per_line = F.transform(
        split_lines(text),
        lambda line, i: F.struct((i + 1).alias("number"), line.alias("line"), line_hits(line).alias("hits")),
    )
    kept = F.transform(
        F.filter(per_line, lambda s: F.size(s["hits"]) > 0),
        lambda s: F.struct(
            s["number"].alias("number"), s["hits"].alias("hits"),
            _redacted(s["line"], s["hits"]["value"], min_stars).alias("evidence"),
        ),
    )
    found = F.flatten(
        F.transform(
            kept,
            lambda s: F.transform(
                s["hits"],
                lambda h: F.struct(
                    s["number"].alias("line"),
                    h["rule"].alias("rule"),
                    s["evidence"].alias("evidence"),
                    F.length(h["value"]).alias("length"),
                    shannon_entropy(h["value"]).alias("entropy"),
                ),
            ),
        )
    )
    counted = F.transform(
        found,
        lambda h, i: F.struct(
            h["line"].alias("line"), h["rule"].alias("rule"), (i + 1).alias("match"),
            h["evidence"].alias("evidence"), h["length"].alias("length"),
            h["entropy"].alias("entropy"),
        ),
    )
    return counted.cast(schema)


def secret_matches(files: DataFrame, *, rules: Sequence[SecretRule] = SECRET_RULES,
                   max_bytes: int | None = None) -> DataFrame:
    """One row per match: where, which rule, how long, how random; value redacted."""
    texts = secret_candidates(files).select(
        "repo_id", "path", decode_text(F.col("content"), max_bytes).alias("text")
    )
    hits = texts.select("repo_id", "path", secret_hits(F.col("text"), rules).alias("hits"))
    return explode_hits(hits, rules)


def explode_hits(rows: DataFrame, rules: Sequence[SecretRule] = SECRET_RULES) -> DataFrame:
    """Rows (repo_id, path, hits) to one row per match with the rule's id.

    The outer explode keeps the optimizer from filtering on the size of hits
    first, which would compute them twice.
    """
    ids = F.array(*[F.lit(r.id) for r in rules])
    exploded = rows.select("repo_id", "path", F.explode_outer("hits").alias("hit"))
    return exploded.filter(F.col("hit").isNotNull()).select(
        "repo_id",
        "path",
        F.col("hit.line").alias("line"),
        F.get(ids, F.col("hit.rule")).alias("rule"),
        F.col("hit.match").alias("match"),
        F.col("hit.evidence").alias("evidence"),
        F.col("hit.length").alias("length"),
        F.col("hit.entropy").alias("entropy"),
    )


def secret_findings(matches: DataFrame, *, rules: Sequence[SecretRule] = SECRET_RULES) -> DataFrame:
    def of_rule(attribute: str) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for rule in rules:
            chain = chain.when(F.col("rule") == rule.id, F.lit(getattr(rule, attribute)))
        return chain

    return finding_rows(
        matches,
        id=F.format_string("%s-%03d", F.col("rule"), F.col("match")),
        severity=of_rule("severity"),
        category="Security",
        title=of_rule("title"),
        path=F.col("path"),
        line=F.col("line"),
        evidence=F.col("evidence"),
        explanation=F.concat(
            F.lit("Line "), F.col("line").cast("string"), F.lit(" holds a value shaped like a secret.")
        ),
        recommendation=of_rule("recommendation"),
    )


def env_file_findings(files: DataFrame) -> DataFrame:
    """Environment files, known by name alone."""
    env = secret_candidates(files).filter(F.startswith(F.lower(basename(F.col("path"))), F.lit(".env")))
    return finding_rows(
        env,
        id=hashed_id("SEC-ENV-", F.col("path")),
        severity="MEDIUM",
        category="Security",
        title="Environment file in the tree",
        path=F.col("path"),
        explanation="Such files tend to hold secrets.",
        recommendation="Ignore the file and commit an example without values.",
    )
