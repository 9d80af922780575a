import random
import sys

import pytest

from corpaudit.operators import secret_rules, secrets
from corpaudit.operators.secret_rules import findings_by_rules, rules_table, secret_matches_by_rules
from tests.helpers import corpus
from tests.test_scan import APP, DEMO


def rows(frame):
    return sorted(map(repr, frame.collect()))


def odd_rules():
    rule = secrets.SecretRule
    return [
        rule("UNHINTED", "LOW", r"zz[0-9]{6,}", "t", "r"),
        rule("ANCHORED", "LOW", r"^(import os)$", "t", "r", group=1, hints=("import",)),
        rule("BEHIND", "HIGH", r"(?<=key: )\S{8,}", "t", "r", hints=("KEY: ", "key: ")),
        rule("FOLDED", "HIGH", r"(?i)bearer (\w{8,})", "t", "r", group=1, hints=("bearer",), folded=True),
        rule("OVERLAP", "LOW", r"bearer \w+", "t", "r", hints=("bearer", "earer")),
    ]


FILES = {
    **{k: v for k, v in DEMO.items() if v}, "a.txt": "import os\nkey: abcdefgh12 zz1234567\nBEARER tokentoken and bearer anothertoken\n",
    "b.txt": "", "c.txt": "ſecret-key = 'abcdefghij'\nİ Bearer xxxxxxxxx\n", "d.bin": b"\x00bearer tokentoken",
}


def test_equals_the_plain_rules(spark):
    files = corpus(spark, FILES)
    rules = [*secrets.SECRET_RULES, *odd_rules()]
    table = rules_table(spark, rules)
    plain, indexed = secrets.secret_matches(files, rules=rules), secret_matches_by_rules(files, table)
    assert indexed.count() >= 10 and rows(indexed) == rows(plain)
    assert rows(findings_by_rules(indexed, table)) == rows(secrets.secret_findings(plain, rules=rules))


def test_hundreds_of_rules(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdef") for _ in range(6)) for _ in range(200)]
    rules = [secrets.SecretRule(f"R{i}", "LOW", rf"{w}=(\w{{8,}})", "t", "r", group=1, hints=(f"{w}=",)) for i, w in enumerate(words)]
    files = corpus(spark, {f"f{i}": "\n".join(f"{draw.choice(words)}={draw.random()!r}abcdefgh{i}".replace(".", "") for _ in range(5)) for i in range(40)})
    assert rows(secret_matches_by_rules(files, rules_table(spark, rules))) == rows(secrets.secret_matches(files, rules=rules))


def test_without_the_automaton(monkeypatch):
    rules = [(0, "A", "x", 0, ("he", "she"), False, True), (1, "B", "y", 0, ("HERS",), True, True), (2, "C", "z", 0, (), False, True)]
    text = "ushers"
    assert [r["id"] for r in secret_rules._Index(rules).candidates(text)] == ["A", "C"]
    rules[1] = (1, "B", "y", 0, ("hers",), True, True)
    assert [r["id"] for r in secret_rules._Index(rules).candidates("USHERS he")] == ["A", "B", "C"]
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert [r["id"] for r in secret_rules._Index(rules).candidates("USHERS he")] == ["A", "B", "C"]
    assert secret_rules._Index(rules).candidates(None) == []


def test_no_rules_and_too_many(spark, monkeypatch):
    files = corpus(spark, {"a.py": APP})
    assert secret_matches_by_rules(files, rules_table(spark, [])).count() == 0
    monkeypatch.setattr(secret_rules, "LIMIT_CHARS", 10)
    with pytest.raises(ValueError, match="characters"):
        secret_matches_by_rules(files, rules_table(spark, secrets.SECRET_RULES))


def test_joined_rules_equal_the_plain_rules(spark, monkeypatch):
    files = corpus(spark, FILES).unionByName(corpus(spark, FILES))
    rules = [*secrets.SECRET_RULES, *odd_rules(), odd_rules()[4], secrets.SecretRule("EMPTY", "LOW", "token{2,}", "t", "r", hints=("",))]
    table = rules_table(spark, rules)
    plain = rows(secrets.secret_matches(files, rules=rules))
    monkeypatch.setattr(secret_rules, "HELD_CHARS", 0)
    # the driver must not take the table
    monkeypatch.setattr(secret_rules, "_collected", None)
    for chunk in (secret_rules.CHUNK_CHARS, 5):
        monkeypatch.setattr(secret_rules, "CHUNK_CHARS", chunk)
        found = secret_matches_by_rules(files, table)
        assert rows(found) == plain
    hinted = [r for r in rules if any(r.hints)]
    found = secret_matches_by_rules(files, rules_table(spark, hinted))
    assert rows(found) == rows(secrets.secret_matches(files, rules=hinted))


def test_findings_by_rules_broadcasts_no_hint(spark):
    table = rules_table(spark, odd_rules())
    found = findings_by_rules(secret_matches_by_rules(corpus(spark, FILES), table), table)
    assert "strategy=broadcast" not in found._jdf.queryExecution().toString()
