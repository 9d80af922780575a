"""Personal data: fixed patterns, and a conditional random field over word shapes that adds to them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.llm import crf
from corpaudit.llm.common import in_arrow, text_slices
from corpaudit.llm.fields import Field

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive runs and the look-behind only spare retries that must fail.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start; a failing match is dropped."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found.groups()]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append(("ip", found.start(), found.end()))
    for found in _CARD.finditer(text):
        digits = _digits(found.group()) if found.end() - found.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", found.start(), found.end()))
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found.group())) <= 15:
            out.append(("phone", found.start(), found.end()))
    return out


# ---- the field ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\d+")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))

#: The labelled table: own sentences, personal data in double brackets with their kind.
LABELLED = (
    "please write to [[email:maria.lopez (at) mail.example.org]] before noon",
    "contact [[email:j.smith [at] example [dot] com]] for details",
    "mail me: [[email:anna_k (at) post (dot) example (dot) net]] thanks",
    "reach [[email:sales(at)shop.example.com]] or the desk",
    "an [[email:info [at] verein.example.de]] wenden",
    "escriba a [[email:ana (at) correo (dot) example (dot) es]] hoy",
    "ask [[email:bob {at} example {dot} org]] about it",
    "his address is [[email:kim@example.com]] and hers too",
    "the old one , [[email:t.o.m@host.example.co.uk]] , bounced",
    "call [[phone:(212) 555-0147]] after six",
    "phone: [[phone:555-123-4567]] or fax",
    "tel. [[phone:030 / 1234 5678]] anrufen",
    "my number is [[phone:(020) 7946 0958]] at home",
    "ring [[phone:212-555-0199]] today",
    "tel: [[phone:415.555.0132]] ext 7",
    "mobile [[phone:(06) 12 34 56 78]] merci",
    "call us at [[phone:+1 (415) 555-0132]] now",
    "dial [[phone:+44 20 7946 0958]] first",
    "tel [[phone:+49 30 1234567]] bitte",
    "server at [[ip:10[.]0[.]0[.]7]] answered",
    "blocked [[ip:192[.]168[.]12[.]1]] again",
    "from [[ip:172(.)16(.)4(.)22]] at night",
    "host [[ip:203.0.113.9]] is up",
    "ping [[ip:198.51.100.77]] fails",
    "card [[card:4111 1111 1111 1111]] was charged",
    "paid with [[card:5500.0000.0000.0004]] online",
    "visa [[card:4012/8888/8888/1881]] expired",
    "card no. [[card:3782-822463-10005]] on file",
    "the year 1998 and 2004 were good",
    "version 3 . 11 . 2 came out in 2023",
    "on 2021-04-05 at 10:30 we met",
    "from 12/05/2019 to 01.06.2020 it ran",
    "chapter 12 , pages 100 - 142 , was cut",
    "it cost 1,250.00 euros or 1.300,50 before",
    "sum 123456 of 789 rows and 1000000 more",
    "isbn 978-3-16-148410-0 is in print",
    "order 20231105 has 16 items",
    "token = \" 24be64439e3e49cf46b2d7c90f3602a3d0b907ff \"",
    "key = 9f86d081884c7d659a2feaa0c55ad015 end",
    "id 4785380592391139 $$$ junk 99 ### 12 %%%",
    "section 1.2.3 of rfc 2616 says so",
    "scores 3-1 and 2-0 , then 10-9",
    "user @ home and @name there",
    "array[12][34] = 56 ; x = 78",
    "at 10 % of 200 (see 15) or [16]",
    "License, version 2.0 (2004) applies",
    "look at the dot (at the end) of 20 lines",
)


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"9*{min(len(token), 9)}"
    if token[0].isalpha():
        case = "x" if token.islower() else "X" if token.isupper() else "Xx"
        return case + ("1" if len(token) == 1 else "")
    return token


def _features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """Shapes and words of every token and its neighbours, and whether white space parts them."""
    shapes = [_shape(t) for t, _, _ in tokens]
    words = [t.lower() if len(t) < 12 else "" for t, _, _ in tokens]
    glued = [i > 0 and tokens[i][1] == tokens[i - 1][2] for i in range(len(tokens))] + [False]
    out = []
    for i in range(len(tokens)):
        item = [f"s={shapes[i]}", f"l={glued[i]}", f"r={glued[i + 1]}", f"s={shapes[i]},{glued[i]},{glued[i + 1]}"]
        if not words[i][:1].isdigit():
            item.append(f"w={words[i]}")
        for d in (-3, -2, -1, 1, 2, 3):
            j = i + d
            near = shapes[j] if 0 <= j < len(shapes) else "#"
            item += [f"s{d}={near}", f"s{d}={near},s={shapes[i]}"]
            if 0 <= j < len(words) and abs(d) < 3 and words[j][:1].isalpha():
                item.append(f"w{d}={words[j]}")
        out.append(item)
    return out


def train() -> crf.Chain:
    """The field, trained on LABELLED."""
    sequences, labels = [], []
    for line in LABELLED:
        text, spans = "", []
        for part in re.split(r"(\[\[\w+:.*?\]\](?!\]))", line):
            found = re.fullmatch(r"\[\[(\w+):(.*)\]\]", part)
            if found:
                spans.append((found[1], len(text), len(text) + len(found[2])))
                part = found[2]
            text += part
        tokens = _tokens(text)
        tags = ["O"] * len(tokens)
        for kind, start, end in spans:
            for i, (_, a, b) in enumerate(tokens):
                if start <= a and b <= end:
                    tags[i] = ("B-" if a == start else "I-") + kind
        sequences.append(_features(tokens))
        labels.append(tags)
    return crf.fit(sequences, labels, LABELS)


def _plausible(kind: str, text: str) -> bool:
    """Whether a decoded span can be what it is called; numbers need the right digits."""
    digits = _digits(text)
    if kind == "email":
        return bool(re.search(r"\w\W{0,3}(?:@|\b(?:at|AT)\b)\W{0,3}\w", text)) and bool(re.search(r"\w\W{0,3}(?:\.|dot|DOT)\W{0,3}\w", text))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", text)) >= 3


def added_spans(texts: list[str], bases: list[list[Span]], chain: crf.Chain | Field) -> list[list[Span]]:
    """Spans that the field adds to each text's base spans, without touching those.

    The field decodes every text whole.
    """
    field = chain if isinstance(chain, Field) else Field(chain)
    names = field.chain.labels
    out: list[list[Span]] = [[] for _ in texts]
    for owner, numbers, starts, ends, tags in field.labels(texts):
        text, base = texts[owner], sorted((a, b) for _, a, b in bases[owner])
        reach = list(accumulate((b for _, b in base), max))
        i, places = 0, list(zip(numbers.tolist(), starts.tolist(), ends.tolist(), (names[t] for t in tags)))
        while i < len(places):
            number, start, end, tag = places[i]
            kind, j = tag[2:], i + 1
            while j < len(places) and places[j][0] == number + j - i and places[j][3] == f"I-{kind}":
                end = places[j][2]
                j += 1
            while end > start and not text[end - 1].isalnum() and text[end - 1] not in ")]}":
                end -= 1
            before = bisect_left(base, (end,))
            free = not before or reach[before - 1] <= start
            if free and _plausible(kind, text[start:end]):
                out[owner].append((kind, start, end))
            i = j
    return out


_SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find(docs: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """`docs` (with text) and `pii`: all spans in code points, end exclusive, by kind, then start.

    The base patterns need a digit or `@`, so only texts with one are searched by them; the field decodes all.
    A null or empty text has none; texts of any length are searched whole; repeated rows are searched
    each; a column named `pii` is replaced.
    """
    field = Field(chain or train())
    order = {kind: i for i, kind in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text")
            hits = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_pylist()
            rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist()
            some = texts.take(pa.array(rows, pa.int64())).to_pylist()
            bases = [base_spans(t) if hits[row] else [] for row, t in zip(rows, some)]
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, base, more in zip(rows, bases, added_spans(some, bases, field)):
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (order[s[0]], s[1]))
                spans[row] = [dict(zip(("kind", "start", "end", "base"), s)) for s in every]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "pii"])

    kept = docs.select(*[c for c in docs.columns if c != "pii"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return in_arrow(kept, run, f"{schema}, pii {_SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of `find`'s result."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")

    def count(kind: str):
        own = F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def masked(docs: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """`docs` with every span of the text replaced by its kind in angle brackets; null stays null.

    Overlapping spans become one, named after the first.
    """
    found = find(docs, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("pii").to_pylist()
            out = []
            for text, own in zip(texts, spans):
                done, parts = 0, []
                for s in sorted(own, key=lambda s: (s["start"], -s["end"])) if own else ():
                    if s["start"] >= done:
                        parts += [text[done:s["start"]], f"<{s['kind']}>"]
                    done = max(done, s["end"])
                out.append("".join(parts) + text[done:] if own else text)
            names = [n for n in batch.schema.names if n != "pii"]
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "pii")
    return in_arrow(found, run, schema)


def digest(spans: list[Span]) -> str:
    """What `digests` gives as base_sha256 for a list of base spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
