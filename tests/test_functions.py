import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpaudit import functions as X


def evaluate(spark, value, expression, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(expression(F.col("v")).alias("x")).first()["x"]


TEXTS = [
    "", "a", "\n", "a\n", "a\n\n", "a\r\nb\rc", "\r\n", "x\x0by\x0cz", "p\x1cq\x1dr\x1es", "a\x85b\u2028c\u2029",
    "one\n \t\n# two\n", "\n\n\n", "a\r\n\r\nb", "  \u00a0\u3000\nend",
]


@pytest.mark.parametrize("text", TEXTS)
def test_lines_are_those_of_python(spark, text):
    assert evaluate(spark, text, X.split_lines) == text.splitlines()


@pytest.mark.parametrize("text", TEXTS + ["x" * 200 + "\n" + "y" * 201, "# todo TODO\nXXXX\nfixme", "é" * 201])
def test_line_counts_agree_with_split_lines(spark, text):
    lines = text.splitlines()
    unified = X.unify_newlines(F.col("v"))
    row = spark.createDataFrame([(text,)], "v string").select(
        X.count_lines(unified), X.count_blank(unified), X.count_long(unified),
        X.count_comments(unified, F.lit(".py")), X.count_comments(unified, F.lit(".php")),
        X.count_marker(F.upper(unified), "TODO"), X.count_marker(F.upper(unified), "XXX"),
    ).first()
    assert tuple(row) == (
        len(lines),
        sum(not l.strip() for l in lines),
        sum(len(l) > 200 for l in lines),
        sum(l.strip().startswith("#") for l in lines),
        sum(l.strip().startswith(("#", "//")) for l in lines),
        sum("TODO" in l.upper() for l in lines),
        sum("XXX" in l.upper() for l in lines),
    )


@pytest.mark.parametrize("text", ["", "  a b ", "\u00a0x\u3000", "\x1c\ty\x1f\n", "\n\n"])
def test_strip(spark, text):
    assert evaluate(spark, text, X.py_strip) == text.strip()


@pytest.mark.parametrize("data", [b"plain", b"caf\xc3\xa9", b"bad\xffbyte", b"", b"nul\x00"])
def test_decode(spark, data):
    assert evaluate(spark, data, X.decode_text, "binary") == data.decode("utf-8", "replace")


def test_decode_can_be_capped(spark):
    assert evaluate(spark, b"abcdef", lambda c: X.decode_text(c, 4), "binary") == "abcd"


@pytest.mark.parametrize("path, name, suffix", [
    ("a/b.TXT", "b.TXT", ".txt"), (".env", ".env", ""), ("x/.env.local", ".env.local", ".local"),
    ("a.tar.gz", "a.tar.gz", ".gz"), ("Makefile", "Makefile", ""), ("d.x/name.", "name.", ""), ("d.x/y", "y", ""),
])
def test_path_parts(spark, path, name, suffix):
    assert evaluate(spark, path, X.basename) == name
    assert evaluate(spark, path, X.suffix) == suffix


def test_relative_path(spark):
    def below(path):
        return evaluate(spark, path, lambda c: X.relative_path(c, F.lit("/a/b")))

    assert [below(p) for p in ("/a/b/c/d", "/a/bc", "/a/b")] == ["c/d", "/a/bc", "."]


@pytest.mark.parametrize("value", ["", "aaaa", "ab", "sk_x9Q", "päß\U0001F600", "hello world"])
def test_entropy(spark, value):
    counts = Counter(value).values()
    expected = -sum(n / len(value) * math.log2(n / len(value)) for n in counts) if value else 0.0
    assert evaluate(spark, value, X.shannon_entropy) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("value, normal, compact", [
    ("", "", ""), ("abcd", "****", "****"), ("abcde", "abcd****", "abcd*"), ("a" * 40, "aaaa" + "*" * 16, "aaaa" + "*" * 16),
])
def test_redact(spark, value, normal, compact):
    assert evaluate(spark, value, X.redact) == normal
    assert evaluate(spark, value, lambda c: X.redact(c, min_stars=0)) == compact


@pytest.mark.parametrize("size, shown", [
    (0, "0B"), (1023, "1023B"), (1024, "1.0KB"), (1280, "1.2KB"), (1331, "1.3KB"), (5 * 1024**2, "5.0MB"),
    (1024**2 - 1, "1024.0KB"), (3 * 1024**4, "3.0TB"), (5000 * 1024**4, "5000.0TB"),
])
def test_human_size(spark, size, shown):
    assert evaluate(spark, size, X.human_size, "bigint") == shown


def test_hashes(spark):
    expected = int(hashlib.sha256(b"src/a.py").hexdigest()[:8], 16)
    assert evaluate(spark, "src/a.py", X.stable_hash_int) == expected % 1000
    assert evaluate(spark, "src/a.py", lambda c: X.stable_hash_int(c, 7)) == expected % 7
    assert evaluate(spark, b"abc", X.content_sha256, "binary") == hashlib.sha256(b"abc").hexdigest()
    assert evaluate(spark, b"abc", lambda c: X.content_sha256(c, 2), "binary") == hashlib.sha256(b"ab").hexdigest()


@pytest.mark.parametrize("value, expected", [
    ("changeme", True), ("'Password'", True), ("short", True), ("xxxxxxxxxx", True), ("********", True),
    ("00000000", True), ("real-value-1", False), ("myFAKEkey99", False),
])
def test_placeholder(spark, value, expected):
    assert evaluate(spark, value, X.is_placeholder) is expected


@pytest.mark.parametrize("text, expected", [
    ("flask==1", "flask"), ("a[b]>1", "a"), ("x ~= 2", "x"), ("plain", "plain"), (">=1", ""),
])
def test_version_spec(spark, text, expected):
    assert evaluate(spark, text, X.strip_version_spec) == expected


def test_readme_sections(spark):
    text = "How to Install. Usage. LICENCE. demo"
    assert evaluate(spark, text, X.readme_sections) == ["installation", "usage", "license", "examples"]
