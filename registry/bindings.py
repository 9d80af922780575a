"""The driver tables seen as repositories, in Spark and in SQL.

Every binding uses every row of its table. The SQL twin of a binding is a
common table expression of the same name; oracles are built on those, never on
results of the package.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit.sources import file_records
from corpaudit.storage import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_ctes(*names: str) -> str:
    """WITH clause that defines the named bindings (and nothing else)."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names) + "\n"


# Narrow rows of one task: the texts made from them take seconds, whatever the table's size.
ROWS_PER_TASK = 250_000


def spread_out(rows: DataFrame) -> DataFrame:
    """Narrow rows over all cores, and over as many tasks as their number asks for.

    Small tables are one row group, and the texts made from their rows are not small. Tables of more
    splits stay as they are.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK + 1)
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def _rows(base: DataFrame, **columns: Column) -> DataFrame:
    """Base rows to the named columns.

    The generator keeps filters on the results from repeating the expressions.
    """
    spread = spread_out(base)
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return spread.select(F.explode(F.array(made)).alias("made")).select("made.*")


def _raw(rows: DataFrame, content: Column, *, kind=None, size=None, error=None) -> DataFrame:
    error = F.lit(None).cast("string") if error is None else error
    return rows.select(
        "repo_id",
        "path",
        (F.lit("file") if kind is None else kind).alias("kind"),
        (F.octet_length(content) if size is None else size).cast("bigint").alias("size"),
        error.isNotNull().alias("unreadable"),
        error.alias("error"),
        content.alias("content"),
    )


def _pick(index: str, *choices: str) -> Column:
    listed = ", ".join(f"'{c}'" for c in choices)
    return F.expr(f"array({listed})[cast(({index}) % {len(choices)} as int)]")


def _sql_pick(index: str, *choices: str) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"[{listed}][({index}) % {len(choices)} + 1]"


CTES: dict[str, str] = {}

# --- documents: prose files ---------------------------------------------------

DOC_EXTENSIONS = (".md", ".txt", ".py", ".sql", ".js", ".log", ".bak", ".key", ".html", ".rst")


def _doc_rows(spark, folder) -> DataFrame:
    extension = _pick("doc_id", *DOC_EXTENSIONS)
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), extension)
    return table(spark, folder, "documents").select(
        F.col("source").alias("repo_id"), path.alias("path"), "doc_id", "text"
    )


def doc_files(spark, folder) -> DataFrame:
    rows = _doc_rows(spark, folder)
    return file_records(_raw(rows, F.col("text").cast("binary")))


def damaged_files(spark, folder) -> DataFrame:
    """Documents with a NUL or an invalid byte at the end of some."""
    content = F.col("text").cast("binary")
    damaged = (
        F.when(F.col("doc_id") % 9 == 0, F.concat(content, F.lit(b"\x00")))
        .when(F.col("doc_id") % 7 == 0, F.concat(content, F.lit(b"\xff")))
        .otherwise(content)
    )
    return file_records(_raw(_doc_rows(spark, folder), damaged))


def written_tree(files: DataFrame, folder: str) -> DataFrame:
    """The files below folder/repo_id/path, written by Spark's tasks; (repo_id, root) per repository.

    Every executor must see the folder. A task that runs again writes the same files again.
    """

    def write(batches):
        for batch in batches:
            for repo, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "content"))):
                target = os.path.join(folder, repo, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as handle:
                    handle.write(content or b"")
                os.replace(part, target)
            yield batch.select(["repo_id"])

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    written = files.select("repo_id", "path", "content").mapInArrow(write, "repo_id string")
    return stored(written.distinct(), "written").select("repo_id", F.concat(F.lit(folder + "/"), "repo_id").alias("root"))


CTES["doc_files"] = f"""
SELECT source AS repo_id, doc_id, text, extension, octet_length(encode(text)) AS size,
       'docs/' || lang || '/d' || doc_id || extension AS path,
       extension IN ('.py', '.sql', '.js', '.html') AS is_source
FROM (SELECT *, {_sql_pick("doc_id", *DOC_EXTENSIONS)} AS extension FROM documents)
"""

# --- pages: web files ---------------------------------------------------------


def web_files(spark, folder) -> DataFrame:
    rows = table(spark, folder, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        "html",
    )
    return file_records(_raw(rows, F.col("html").cast("binary")))


CTES["web_files"] = """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, 'p' || page_id || '.html' AS path,
       '.html' AS extension, html AS text, octet_length(encode(html)) AS size
FROM pages
"""

# --- lineitem: code files, one per row ----------------------------------------

CODE_EXTENSIONS = (".py", ".js", ".sql", ".rb", ".txt", ".php")

# Written so that no key-like literal stands in the repository.
_FIRST_LINE = """
CASE l_partkey % 8
  WHEN 0 THEN '# TODO ' || l_partkey
  WHEN 1 THEN ''
  WHEN 2 THEN 'import m' || l_partkey
  WHEN 3 THEN 'k = AK' || 'IA' || upper(substr({hash_part}, 1, 16)) || ';'
  WHEN 4 THEN 'pass' || 'word = "pw' || (100000 + l_partkey) || '"'
  WHEN 5 THEN 'u = "mysql:' || '//u' || l_suppkey || ':pw' || l_partkey || '@h/db"'
  WHEN 6 THEN '  // FIXME'
  ELSE 't = "sk_' || 'live_' || substr({hash_part}, 1, 20) || '"'
END"""
_SECOND_LINE = """
CASE l_suppkey % 8
  WHEN 0 THEN ''
  WHEN 1 THEN '   '
  WHEN 2 THEN '# todo: fix and FixMe'
  WHEN 3 THEN '  // note'
  WHEN 4 THEN '-- remark'
  WHEN 5 THEN 'x = 1'
  WHEN 6 THEN repeat('y', cast(180 + l_linenumber * 10 as int))
  ELSE 'a xxx b XXX'
END"""
_THIRD_LINE = """
CASE l_linenumber
  WHEN 1 THEN 'api_' || 'key: ''k' || substr({hash_order}, 1, 10) || ''''
  WHEN 2 THEN 'pass' || 'word = "pass' || 'word"'
  WHEN 3 THEN 'secret-' || 'key="xxxxxxxxxx"'
  WHEN 4 THEN 'pass' || 'word="' || substr({hash_order}, 1, 8) || '" access_' || 'token = "' || substr({hash_order}, 9, 12) || '"'
  WHEN 5 THEN '-----BEGIN RSA PRI' || 'VATE KEY-----'
  ELSE ''
END"""


def _code_lines(hash_call: str) -> str:
    part, order = (hash_call.format(c) for c in ("l_partkey", "l_orderkey"))
    lines = [t.format(hash_part=part, hash_order=order) for t in (_FIRST_LINE, _SECOND_LINE, _THIRD_LINE)]
    return " || nl || ".join(f"({line})" for line in lines) + " || CASE WHEN l_quantity > 25 THEN nl ELSE '' END"


_CODE_PATH = (
    "'src/f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"
    " || '_' || cast(l_quantity as int)"
)


def code_texts(spark, folder) -> DataFrame:
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    rows = table(spark, folder, "lineitem").select(
        *names, F.when(F.col("l_linenumber") % 3 == 0, "\r\n").otherwise("\n").alias("nl")
    )
    return _rows(
        rows,
        repo_id=F.expr("'r' || (l_orderkey % 200)"),
        path=F.concat(F.expr(_CODE_PATH), _pick("l_orderkey", *CODE_EXTENSIONS)),
        text=F.expr(_code_lines("sha2(cast({} as string), 256)")),
    )


def code_files(spark, folder) -> DataFrame:
    return file_records(_raw(code_texts(spark, folder), F.col("text").cast("binary")))


CTES["code_files"] = f"""
SELECT repo_id, path_stem || extension AS path, extension, text, octet_length(encode(text)) AS size
FROM (SELECT 'r' || (l_orderkey % 200) AS repo_id, {_CODE_PATH} AS path_stem,
             {_sql_pick("l_orderkey", *CODE_EXTENSIONS)} AS extension,
             {_code_lines("sha256(CAST({} AS VARCHAR))")} AS text
      FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS nl
            FROM lineitem))
"""
# the lines of code_files, numbered, without the empty one after a final separator
CTES["code_lines"] = """
SELECT repo_id, path, extension, i AS line_no, parts[i] AS line
FROM (SELECT *, unnest(range(1, CASE WHEN parts[len(parts)] = '' THEN len(parts)
                                     ELSE len(parts) + 1 END)) AS i
      FROM (SELECT *, string_split(replace(text, chr(13), ''), chr(10)) AS parts FROM code_files))
"""
CTES["doc_lines"] = """
SELECT repo_id, path, extension, i AS line_no, parts[i] AS line
FROM (SELECT *, unnest(range(1, CASE WHEN parts[len(parts)] = '' THEN len(parts)
                                     ELSE len(parts) + 1 END)) AS i
      FROM (SELECT *, string_split(text, chr(10)) AS parts FROM doc_files))
"""

# --- orders: Python files -----------------------------------------------------

_PYTHON_TEXT = """
'import os, m' || (o_custkey % 9) || nl ||
CASE o_orderkey % 3
  WHEN 0 THEN 'def f():' || nl || '    pass'
  WHEN 1 THEN 'class C:' || nl || '    def g(self): pass'
  ELSE 'async def h(): pass' || nl || '# end'
END || nl ||
CASE WHEN o_custkey % 2 = 0 THEN 'from pkg' || (o_custkey % 5) || '.sub import x' ELSE 'from . import y' END || nl ||
CASE WHEN o_custkey % 40 = 0 THEN 'z = ' || repeat('-', 20) || '1' ELSE 'z = 1' END ||
CASE WHEN o_orderkey % 50 = 0 THEN nl || 'def f(:' ELSE '' END"""


def python_files(spark, folder) -> DataFrame:
    rows = _rows(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.lit("\n").alias("nl")),
        repo_id=F.expr("'r' || (o_custkey % 100)"),
        path=F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'examples/' ELSE 'pkg/' END || 'o' || o_orderkey || '.py'"),
        text=F.expr(_PYTHON_TEXT),
    )
    return file_records(_raw(rows, F.col("text").cast("binary")))


CTES["python_files"] = """
SELECT 'r' || (o_custkey % 100) AS repo_id,
       CASE WHEN o_orderkey % 10 = 0 THEN 'examples/' ELSE 'pkg/' END || 'o' || o_orderkey || '.py' AS path,
       o_orderkey % 50 = 0 AS broken,
       1 AS functions,
       CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS classes,
       2 AS imports,
       o_custkey % 40 = 0 AS deep,
       list_filter(['m' || (o_custkey % 9), 'os',
                    CASE WHEN o_custkey % 2 = 0 THEN 'pkg' || (o_custkey % 5) END], lambda x: x IS NOT NULL) AS modules
FROM orders
"""

# --- orders: manifests, six and four lockfiles per row ------------------------

_MANY = "o_orderkey % 50 = 0"
_LIB_SPEC = "CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '>=2' ELSE '==2' END"
# {deps} is the text of ninety more lines for some rows
_REQUIREMENTS = f"""
'pkg' || (o_custkey % 7) || '==1.' || (o_orderkey % 4) || nl || '# comment' || nl ||
'Lib' || (o_orderkey % 3) || {_LIB_SPEC} || nl ||
'  lib' || (o_custkey % 3) || ' [extra] == 2.0  # note' || nl || '-r other.txt' || nl || nl ||
CASE WHEN {_MANY} THEN {{deps}} ELSE '' END"""
_PYPROJECT = """
'[project]' || nl || 'name = "x"' || nl || 'dependencies = [' || nl || '  "a' || (o_custkey % 20) || '>=1",' || nl ||
'  "b' || (o_orderkey % 20) || '==2",' || nl ||
CASE WHEN o_orderkey % 4 = 0 THEN '  "c[fast]==1", "d==1",' || nl ELSE '' END || ']' || nl ||
'[tool.poetry.group.dev.dependencies]' || nl || 'v' || (o_custkey % 20) || ' = "2.0"' || nl || '# k = 1' || nl ||
'"w' || (o_orderkey % 6) || '" = "^1"' || nl || '[tool.other]' || nl || 'zz = 1' || nl"""
_PACKAGE = """
CASE WHEN o_orderkey % 17 = 0 THEN '{not json,,' ELSE
'{"name": "x", "dependencies": {"d' || (o_custkey % 20) || '": "' ||
CASE WHEN o_custkey % 3 = 0 THEN '^1' ELSE '1.0' END || '", "e' || (o_orderkey % 5) || '": "~2"}' ||
', "devDependencies": {"e' || (o_custkey % 5) || '": "3.0"}}' END"""
_CARGO = """
'[package]' || nl || 'name = "x"' || nl || '[dependencies]' || nl || 'a' || (o_custkey % 20) || ' = "1"' || nl ||
'# b = "1"' || nl || '"c' || (o_orderkey % 20) || '" = { version = "1" }' || nl || '[dev-dependencies]' || nl ||
'v' || (o_custkey % 6) || ' = "2"' || nl"""
_GO = """
'module x' || nl || 'require single.org/s' || (o_custkey % 9) || ' v1.0.0' || nl || 'require (' || nl ||
'  a.org/m' || (o_custkey % 20) || ' v1.2.3' || nl || nl || '  // why' || nl || '  b.org/n' || (o_orderkey % 20) || ' v0.1.0 // indirect' || nl ||
')' || nl || CASE WHEN o_orderkey % 2 = 0 THEN 'require last.org/z v2' || nl ELSE '' END"""
_POM = """
'<project><dependencies><dependency>' || nl || '<groupId> g' || (o_custkey % 20) || ' </groupId>' || nl ||
'<artifactId>a' || (o_orderkey % 20) || '</artifactId></dependency>' || nl ||
'<dependency><artifactId>none</artifactId></dependency>' || nl ||
'<dependency><groupId>g</groupId><artifactId>b' || (o_custkey % 3) || '</artifactId></dependency></dependencies></project>'"""
_MANIFEST_TEXTS = {
    "requirements.txt": _REQUIREMENTS.replace(
        "{deps}", "array_join(transform(sequence(1, 90), i -> 'dep' || i || '==1'), nl)"
    ),
    "pyproject.toml": _PYPROJECT,
    "package.json": _PACKAGE,
    "Cargo.toml": _CARGO,
    "go.mod": _GO,
    "pom.xml": _POM,
}
LOCKS = ("poetry.lock", "package-lock.json", "Cargo.lock", "go.sum")


def manifest_files(spark, folder, *names: str, locks: bool = False) -> DataFrame:
    """Manifests by name, with the lockfile rows on demand."""
    files = [F.struct(F.lit(n).alias("path"), F.expr(_MANIFEST_TEXTS[n]).alias("text")) for n in names]
    if locks:
        present = F.col("o_orderkey") % 3 == 0
        files += [F.when(present, F.struct(F.lit(n).alias("path"), F.lit("lock").alias("text"))) for n in LOCKS]
    rows = (
        spread_out(table(spark, folder, "orders").select("o_orderkey", "o_custkey"))
        .withColumn("nl", F.lit("\n"))
        .select(F.expr("'r' || o_orderkey").alias("repo_id"), F.explode(F.array_compact(F.array(*files))).alias("f"))
        .select("repo_id", "f.path", "f.text")
    )
    return file_records(_raw(rows, F.col("text").cast("binary")))


ALL_MANIFESTS = tuple(_MANIFEST_TEXTS)
# what the six manifests of an order declare, as lists
CTES["declared"] = f"""
SELECT 'r' || o_orderkey AS repo_id, o_orderkey, o_custkey,
  list_concat(['pkg' || (o_custkey % 7), 'Lib' || (o_orderkey % 3), 'lib' || (o_custkey % 3)],
    CASE WHEN {_MANY} THEN list_transform(range(1, 91), lambda i: 'dep' || i) ELSE [] END) AS requirements,
  CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN ['lib' || (o_custkey % 3)] ELSE [] END AS repeats,
  o_custkey % 4 >= 2 AS pinned,
  list_concat(['a' || (o_custkey % 20), 'b' || (o_orderkey % 20)],
    CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [] END) AS pyproject,
  ['v' || (o_custkey % 20), 'w' || (o_orderkey % 6)] AS pyproject_dev,
  CASE WHEN o_orderkey % 17 = 0 THEN [] ELSE ['d' || (o_custkey % 20), 'e' || (o_orderkey % 5)] END AS package,
  CASE WHEN o_orderkey % 17 = 0 THEN [] ELSE ['e' || (o_custkey % 5)] END AS package_dev,
  o_orderkey % 17 <> 0 AND o_custkey % 3 <> 0 AND o_orderkey % 5 = o_custkey % 5 AS package_pinned,
  ['a' || (o_custkey % 20), 'c' || (o_orderkey % 20)] AS cargo,
  ['v' || (o_custkey % 6)] AS cargo_dev,
  list_concat(['single.org/s' || (o_custkey % 9), 'a.org/m' || (o_custkey % 20), '//', 'b.org/n' || (o_orderkey % 20)],
    CASE WHEN o_orderkey % 2 = 0 THEN ['last.org/z'] ELSE [] END) AS go_mod,
  ['g' || (o_custkey % 20) || ':a' || (o_orderkey % 20), 'g:b' || (o_custkey % 3)] AS pom,
  o_orderkey % 3 = 0 AS locked
FROM orders
"""

# --- part: repositories by their paths ----------------------------------------

_SLOTS = (
    ("README.md", "README.rst", "README.txt", "README", "readme.md", "docs/README.md"),
    ("LICENSE", "COPYING", "LICENSE.md", ".gitignore", ".env.local", "id.key"),
    ("go.mod", "package.json", "Makefile", "pom.xml", "Cargo.lock", "setup.py", ".travis.yml", ".git"),
    ("src/main.py", "src/app.ts", "src/App.java", "src/lib.rs", "src/index.js", "src/dump.sql"),
    ("node_modules/x/index.js", "pkg/build/test_a.py", "tests/util.ts", "src/go.mod", "src/Pipfile"),
    (".github/workflows/ci.yml", ".circleci/config.yml", "ci/run.sh", ".git/HEAD", "web/tsconfig.json",
     "a/b/package.json"),
    ("lib/.hidden", "test/test_x.py", "lib/x.py", "web/a.tsx", "core/x.go", "core/y.c", "Web/CMAKELISTS.TXT"),
    ("tests", "big.bin", "lib/z.py", "core/h.h", "web/b.jsx", "env/old.bak"),
)
_README_TEXT = """
'Project ' || p_name || '. ' || CASE WHEN p_size % 2 = 0 THEN 'How to Install it. ' ELSE '' END ||
CASE WHEN p_size % 3 = 0 THEN 'USAGE: run. ' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'Licence terms. ' ELSE '' END ||
CASE WHEN p_size % 7 = 0 THEN 'Demo and options. ' ELSE '' END || repeat('lorem ', cast(p_size * 8 as int))"""
_PATH_ERROR = """
CASE WHEN p_partkey % 8 = 7 AND p_size % 12 = 0 THEN 'not entered' WHEN p_size % 19 = 0 THEN 'broken symlink' WHEN p_size % 23 = 0 THEN 'permission denied' END"""
_PATH_KIND = "CASE WHEN p_partkey % 8 = 7 AND p_size % 6 = 0 THEN 'dir' ELSE 'file' END"


def path_files(spark, folder) -> DataFrame:
    path = F.when(F.lit(False), F.lit(""))
    for slot, names in enumerate(_SLOTS):
        path = path.when(F.col("p_partkey") % 8 == slot, _pick("p_size", *names))
    parts = spread_out(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"))
    rows = parts.withColumn("path", path).withColumn("repo_id", F.expr("'r' || cast(floor(p_partkey / 8) as bigint)"))
    size = F.expr("cast(p_size * 150000 + p_partkey % 1000 as bigint)")
    raw = _raw(
        rows, F.expr(_README_TEXT).cast("binary"), kind=F.expr(_PATH_KIND), size=size, error=F.expr(_PATH_ERROR)
    )
    return file_records(raw)


_SQL_SLOTS = " ".join(f"WHEN {i} THEN {_sql_pick('p_size', *names)}" for i, names in enumerate(_SLOTS))
_SOURCES = "('.py','.ts','.java','.rs','.js','.sql','.sh','.tsx','.go','.c','.h','.jsx')"
CTES["path_files"] = f"""
SELECT *, kind = 'file' AND error IS NULL AND extension IN {_SOURCES} AS is_source,
       error IS NOT NULL AS unreadable
FROM (SELECT *, regexp_extract(lower(name), '^.+([.][^.]+)$', 1) AS extension
      FROM (SELECT 'r' || (p_partkey // 8) AS repo_id, path, p_size, p_partkey,
                   list_last(string_split(path, '/')) AS name,
                   {_PATH_KIND} AS kind, {_PATH_ERROR} AS error, {_README_TEXT} AS text,
                   CAST(p_size * 150000 + p_partkey % 1000 AS BIGINT) AS size
            FROM (SELECT *, CASE p_partkey % 8 {_SQL_SLOTS} END AS path FROM part)))
"""
CTES["path_repos"] = "SELECT DISTINCT repo_id FROM path_files"
CTES["path_scanned"] = """
SELECT * FROM path_files
WHERE kind = 'file' AND NOT list_has_any(string_split(path, '/')[:-2],
  ['.git','node_modules','__pycache__','.venv','venv','env','dist','build','target','coverage','.next',
   '.pytest_cache','.mypy_cache','.tox','egg-info','.idea','.vscode','vendor'])
"""

# --- events: findings, and customers: repositories without any ----------------

EVENT_COLUMNS = {
    "repo_id": "'r' || user_id || '-' || (event_id % 25)",
    "id": "'F' || event_id",
    "severity": "CASE event_type WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'LOW' WHEN 'click' THEN 'MEDIUM' "
                "WHEN 'purchase' THEN 'HIGH' ELSE 'CRITICAL' END",
    "category": "CASE event_id % 6 WHEN 0 THEN 'Security' WHEN 1 THEN 'Dependencies' WHEN 2 THEN 'Code Health' "
                "WHEN 3 THEN 'Documentation' WHEN 4 THEN 'Hygiene' ELSE 'Other' END",
    "title": "'T' || (event_id % 23)",
    "path": "'f' || (event_id % 97)",
    "line": "CAST(CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 50 END AS int)",
    "evidence": "''",
    "explanation": "'why ' || event_type",
    "recommendation": "CASE WHEN event_id % 23 = 5 THEN '' ELSE 'fix ' || (event_id % 23) END",
}
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
# the second run names the errors anew and rates costly clicks higher
_RUN_B = {
    **EVENT_COLUMNS,
    "id": "CASE WHEN event_type = 'error' THEN 'G' ELSE 'F' END || event_id",
    "severity": EVENT_COLUMNS["severity"].replace("WHEN 'click' THEN 'MEDIUM'", "WHEN 'click' THEN CASE WHEN value > 20 THEN 'HIGH' ELSE 'MEDIUM' END"),
}


def _findings(spark, folder, columns: dict[str, str]) -> DataFrame:
    rows = table(spark, folder, "events").select(*[F.expr(e).alias(n) for n, e in columns.items()])
    names = list(columns)
    names.insert(3, "severity_rank")
    return rows.withColumn("severity_rank", F.expr(_RANK)).select(*names)


def event_findings(spark, folder) -> DataFrame:
    return _findings(spark, folder, EVENT_COLUMNS)


def event_findings_b(spark, folder) -> DataFrame:
    return _findings(spark, folder, _RUN_B)


def event_repos(spark, folder) -> DataFrame:
    used = table(spark, folder, "events").select(F.expr(EVENT_COLUMNS["repo_id"]).alias("repo_id")).distinct()
    idle = table(spark, folder, "customer").select(F.expr("'c' || c_custkey").alias("repo_id"))
    return used.unionByName(idle)


def event_doc_scores(spark, folder) -> DataFrame:
    used = table(spark, folder, "events").groupBy(F.expr(EVENT_COLUMNS["repo_id"]).alias("repo_id")).agg(
        F.expr("cast(100 - min(user_id) % 41 as int)").alias("doc_score")
    )
    idle = table(spark, folder, "customer").select(
        F.expr("'c' || c_custkey").alias("repo_id"), F.expr("cast(c_custkey % 101 as int)").alias("doc_score")
    )
    return used.unionByName(idle)


def _findings_sql(columns: dict[str, str]) -> str:
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT *, {_RANK} AS severity_rank FROM (SELECT {listed} FROM events)"


CTES["findings"] = _findings_sql(EVENT_COLUMNS)
CTES["findings_b"] = _findings_sql(_RUN_B)
CTES["repos"] = """
SELECT DISTINCT repo_id FROM findings UNION ALL SELECT 'c' || c_custkey FROM customer
"""
CTES["doc_scores"] = f"""
SELECT {EVENT_COLUMNS["repo_id"]} AS repo_id, CAST(100 - min(user_id) % 41 AS INTEGER) AS doc_score FROM events GROUP BY ALL
UNION ALL SELECT 'c' || c_custkey, CAST(c_custkey % 101 AS INTEGER) FROM customer
"""

# --- part: imports ------------------------------------------------------------

STDLIB = ("blue", "red", "old")
FIRST_PARTY = ("new",)
THIRD_PARTY = ("hot",)


def part_imports(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.expr("'r' || p_size").alias("repo_id"),
        F.expr("'p' || p_partkey || '.py'").alias("path"),
        F.expr("split(p_name, ' ')[0]").alias("module"),
    )


def part_repos(spark, folder) -> DataFrame:
    return part_imports(spark, folder).select("repo_id").distinct()


CTES["imports"] = """
SELECT 'r' || p_size AS repo_id, 'p' || p_partkey || '.py' AS path, string_split(p_name, ' ')[1] AS module FROM part
"""
