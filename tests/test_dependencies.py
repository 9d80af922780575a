import pytest
from pyspark.sql import functions as F

from corpaudit.operators import dependencies as deps
from tests.helpers import corpus


def summary(spark, files, **options):
    rows = corpus(spark, files)
    found = deps.manifest_summary(deps.manifests(rows, **options), deps.lockfiles(rows))
    return {r.manifest_file: r for r in found.collect()}


def test_requirements(spark):
    row = summary(spark, {"requirements.txt": "flask==1\nRequests\n# c\n-r x\nnumpy==2 ; m\nrequests[x]>=1 # d\nREQUESTS\n"})
    row = row["requirements.txt"]
    assert row.runtime == ["flask", "Requests", "numpy", "requests", "REQUESTS"]
    assert row.duplicates == ["requests", "REQUESTS"]
    assert not row.pinned and not row.lockfile_present and row.ecosystem == "python"


@pytest.mark.parametrize("text, pinned", [("a==1\nb==2", True), ("a==1\nb", False), ("", False), ("a==", False)])
def test_requirements_pinned(spark, text, pinned):
    assert summary(spark, {"requirements.txt": text})["requirements.txt"].pinned is pinned


def test_package_json(spark):
    text = '{"dependencies": {"react": "^18.0.0", "x": "1"}, "devDependencies": {"jest": "29.0.0"}}'
    row = summary(spark, {"package.json": text, "yarn.lock": ""})["package.json"]
    assert (row.runtime, row.dev, row.pinned, row.lockfile_present) == (["react", "x"], ["jest"], False, True)


def test_package_json_dev_version_wins(spark):
    text = '{"dependencies": {"a": "^1"}, "devDependencies": {"a": "1.0"}}'
    assert summary(spark, {"package.json": text})["package.json"].pinned is True


@pytest.mark.parametrize("text", ["{not valid json,,,", "", "{} trailing", "{'a': 1}"])
def test_malformed_package_json(spark, text):
    row = summary(spark, {"package.json": text, "yarn.lock": ""})["package.json"]
    assert (row.runtime, row.dev, row.pinned, row.lockfile_present) == ([], [], False, False)


def test_package_json_odd_shapes(spark):
    for text in ("[]", "{}", '{"dependencies": null}', '{"dependencies": {}}'):
        row = summary(spark, {"package.json": text})["package.json"]
        assert (row.runtime, row.dev, row.pinned) == ([], [], False)


def test_pyproject(spark):
    text = (
        '[project]\ndependencies = [\n  "requests>=2",\n  "rich==13",\n]\n'
        '[tool.poetry.dev-dependencies]\npytest = "7"\n# no = 1\n[other]\nzz = 1\n'
    )
    row = summary(spark, {"pyproject.toml": text, "uv.lock": ""})["pyproject.toml"]
    assert (row.runtime, row.dev, row.pinned, row.lockfile_present) == (["requests", "rich"], ["pytest"], False, True)


def test_pyproject_list_ends_at_first_bracket(spark):
    row = summary(spark, {"pyproject.toml": 'dependencies = ["a==1", "x[y]==2", "z"]'})["pyproject.toml"]
    assert row.runtime == ["a"] and row.pinned
    assert summary(spark, {"pyproject.toml": 'dependencies = ["a"'})["pyproject.toml"].runtime == []


def test_cargo(spark):
    text = '[package]\nname="p"\n[dependencies]\nserde = "1"\n# c = 1\n"q-r" = { v = 1 }\n[dev-dependencies]\nt = "1"\n'
    row = summary(spark, {"Cargo.toml": text, "Cargo.lock": ""})["Cargo.toml"]
    assert (row.runtime, row.dev, row.pinned, row.lockfile_present) == (["serde", "q-r"], ["t"], False, True)


def test_go_mod(spark):
    text = "module m\nrequire one.org/a v1\nrequire (\n\tb.org/c v1\n\n\t// why\n)\nrequire  two.org/d v2\nrequire (\nopen.org/e v1"
    row = summary(spark, {"go.mod": text})["go.mod"]
    assert row.runtime == ["one.org/a", "b.org/c", "//", "two.org/d", "open.org/e"]
    assert row.pinned and not row.lockfile_present


def test_pom(spark):
    text = "<dependency>\n<groupId> g </groupId><artifactId>a</artifactId>\n</dependency><dependency><groupId>x</groupId></dependency>"
    assert summary(spark, {"pom.xml": text})["pom.xml"].runtime == ["g:a"]


def test_only_root_manifests_unless_asked(spark):
    files = {"sub/go.mod": "require a.b/c v1", "sub/go.sum": "", "requirements.txt": "a"}
    assert set(summary(spark, files)) == {"requirements.txt"}
    nested = summary(spark, files, root_only=False)
    assert nested["sub/go.mod"].lockfile_present


def test_findings(spark):
    many = "\n".join(f"dep{i}" for i in range(81))
    rows = corpus(spark, {"requirements.txt": many + "\ndep1", "Cargo.toml": "", "go.mod": "", "pom.xml": ""})
    found = deps.dependency_findings(deps.manifest_summary(deps.manifests(rows), deps.lockfiles(rows)))
    assert sorted((r.id, r.severity) for r in found.collect()) == [
        ("DEP-DUP-python", "LOW"), ("DEP-LARGE-python", "LOW"), ("DEP-NOLOCK-python", "INFO"), ("DEP-NOLOCK-rust", "INFO")]


def test_no_manifest_no_row(spark):
    assert summary(spark, {"a.py": "x"}) == {}


def test_repeats_scale(spark):
    names = spark.range(1).select(F.expr("transform(sequence(1, 20000), i -> named_struct('name', 'N' || (i % 9000)))").alias("e"))
    assert len(names.select(deps.repeated_names(F.col("e"))).first()[0]) == 11000


def test_a_section_is_looked_for_once(spark):
    plan = spark.range(1).select(deps.parse_cargo(F.col("id").cast("string")).alias("e"))._jdf.queryExecution().toString()
    # as a header to look for and within one pattern, in each of four plans
    assert plan.count("dev-dependencies") <= 8


def test_sections_end_where_a_line_opens_the_next(spark):
    lines = "".join(f'k{i} = "1"\n' for i in range(50_000))
    texts = [
        "[dependencies]", "[dependencies]\n", "[dependencies]\n[x]\nb = 1", "x = 1\n[dependencies] a = 1\n\n[[y]]\nc = 1\n[dependencies]\nd = 1",
        "[dependencies]\r\na = 1\r\nb = 1\n [x]\nc = 1\n[x]\n", " [dependencies]\na = 1", "[dependencies]\n" + lines + "[x]\nz = 1\n", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    parsed = frame.select("n", F.transform(deps.parse_cargo(F.col("text")), lambda e: e["name"]).alias("names"))
    found = [r.names for r in parsed.orderBy("n").collect()]
    assert found[:6] == [[], [], [], ["a"], ["a", "b", "c"], []]
    assert len(found[6]) == 50_000 and found[6][-1] == "k49999" and found[7] is None
