import pytest

from corpaudit.operators import secrets
from tests.helpers import column, corpus

# assembled, so that no key-like literal stands in this file
AWS = "AK" + "IA" + "ABCDEFGH12345678"
STRIPE = "sk_" + "live_" + "a1B2c3D4e5F6g7H8i9"
PEM = "-----BEGIN EC PRI" + "VATE KEY-----"
URL = "mysql:" + "//user:hunter22@db.example/x"
ASSIGNED = "s3cr3t-Value-9"
ASSIGNMENT = "pass" + f"word = '{ASSIGNED}'"


def hits(spark, files, **options):
    rows = secrets.secret_matches(corpus(spark, files), **options).orderBy("path", "match").collect()
    return [(r.path, r.line, r.rule, r.match) for r in rows], rows


@pytest.mark.parametrize("line, rule", [
    (f"k = {AWS};", "SEC-AWS-KEY"), (f'"{STRIPE}"', "SEC-STRIPE-KEY"), (PEM, "SEC-PRIVATE-KEY"),
    (f"u = {URL}", "SEC-DB-CONN"), (ASSIGNMENT, "SEC-GENERIC-ASSIGN"),
])
def test_rules(spark, line, rule):
    found, rows = hits(spark, {"a.txt": f"first\n{line}\n"})
    assert found == [("a.txt", 2, rule, 1)]
    assert rows[0].entropy > 0


def test_numbers_run_over_the_file(spark):
    text = f"{ASSIGNMENT}\n{URL} {AWS} {AWS}x {STRIPE}\n{PEM}"
    found, _ = hits(spark, {"a.txt": text})
    assert [(line, rule, n) for _, line, rule, n in found] == [
        (1, "SEC-GENERIC-ASSIGN", 1), (2, "SEC-AWS-KEY", 2), (2, "SEC-STRIPE-KEY", 3), (2, "SEC-DB-CONN", 4),
        (3, "SEC-PRIVATE-KEY", 5),
    ]


@pytest.mark.parametrize("value", ["changeme", "xxxxxxxxxx", "00000000", "password"])
def test_placeholders(spark, value):
    assert hits(spark, {"a.txt": "pass" + f'word = "{value}"'})[0] == []


def test_no_value_survives_anywhere(spark):
    line = f"{AWS} {STRIPE} {URL} {ASSIGNMENT}"
    found = secrets.secret_findings(secrets.secret_matches(corpus(spark, {"a.txt": line}))).collect()
    assert len(found) == 4
    for row in found:
        for text in (f for f in row if isinstance(f, str)):
            for value in (AWS, STRIPE, URL, ASSIGNED):
                assert value not in text


def test_evidence_is_stripped_and_cut(spark):
    _, rows = hits(spark, {"a.txt": "   " + ASSIGNMENT + " " + "z" * 400})
    assert len(rows[0].evidence) == 160 and rows[0].evidence.startswith("pass")


def test_binary_files_are_skipped_and_whole_texts_read(spark):
    late = "x\n" * 300_000 + ASSIGNMENT
    found, _ = hits(spark, {"a.png": ASSIGNMENT, "late.txt": late})
    assert found == [("late.txt", 300_001, "SEC-GENERIC-ASSIGN", 1)]


def test_own_rule_without_hints(spark):
    rule = secrets.SecretRule("MINE", "LOW", r"tok-(\w{8,})", "T", "R", group=1)
    found, rows = hits(spark, {"a.txt": "tok-abcdefgh1"}, rules=[rule])
    assert found == [("a.txt", 1, "MINE", 1)]
    assert rows[0].evidence == "tok-abcd*****"


def test_anchored_rule_matches_any_line(spark):
    rule = secrets.SecretRule("MINE", "LOW", r"^tok=(\w{8,})$", "T", "R", group=1)
    found, _ = hits(spark, {"a.txt": "x\ntok=abcdefgh1\ny"}, rules=[rule])
    assert found == [("a.txt", 2, "MINE", 1)]


def test_a_line_of_many_values_is_redacted_in_time_and_whole(spark):
    import time

    took = {}
    for count in (5_000, 10_000, 20_000):
        line = "  " + " ".join('pass' + f'word="v{i:06d}x{i * 7919:08d}"' for i in range(count))
        start = time.time()
        found, rows = hits(spark, {"a.min.js": line})
        took[count] = time.time() - start
        assert len(found) == count
        assert not any(f"v{i:06d}x" in rows[0].evidence for i in range(200))
        assert len(rows[0].evidence) == 160
    assert took[20_000] < 60 and took[20_000] < 3 * took[10_000] + 5


def test_evidence_does_not_depend_on_the_number_of_long_values(spark):
    some = ["access_" + f'token="{i:03d}' + "q" * 897 + '"' for i in range(40)]
    shown = {}
    for count in (15, 16, 17, 40):
        found, rows = hits(spark, {"a.min.js": "  " + " ".join(some[:count]) + " "})
        assert len(found) == count
        shown[count] = {r.evidence for r in rows}
    want = " ".join("access_" + f'token="{i:03d}q' + "*" * 16 + '"' for i in range(15))[:160]
    assert all(evidence == {want} for evidence in shown.values())


def test_values_that_overlap_are_hidden(spark):
    rules = [secrets.SecretRule("A", "LOW", r"abcdefgh\d{4}", "T", "R"), secrets.SecretRule("B", "LOW", r"\d{4}zyxwvutsrq", "T", "R")]
    _, rows = hits(spark, {"a.txt": "k abcdefgh1234zyxwvutsrq end"}, rules=rules)
    assert {r.evidence for r in rows} == {"k abcd****1234********** end"}


def test_env_files(spark):
    files = corpus(spark, {".env": "a", "x/.ENV.prod": "b", "env": "c", "a.env": "d"})
    assert sorted(column(secrets.env_file_findings(files), "path")) == [".env", "x/.ENV.prod"]


def test_hits_are_computed_once(spark):
    matches = secrets.secret_matches(corpus(spark, {"a.txt": "x"}))
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan


def test_lines_of_many_values_are_hidden_to_the_end(spark):
    values = [f"AKIA{i:016d}" for i in range(9)]
    line = " ".join(values)
    found = secrets.secret_matches(corpus(spark, {"a.txt": line})).collect()
    shown = " ".join(["AKIA" + "*" * 16] * 9)[:160]
    assert len(found) == 9 and {r.evidence for r in found} == {shown}
