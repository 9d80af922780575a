"""Line statistics, secrets, Python facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import code, imports, python_code, secret_rules, secrets
from corpaudit.plans.scan import import_audit as run_import_audit
from corpaudit.storage import stored
from registry import bindings as B
from registry.bindings import with_ctes
from registry.catalog import query

_SOURCE_IDS = "('.py', '.rb', '.php')"
_LINE_STATS = """
stats AS (
  SELECT f.repo_id, f.path, f.extension, any_value(f.size) AS size, count(line) AS total_lines,
         count(*) FILTER (trim(line) = '') AS blank_lines,
         count(*) FILTER (ltrim(line) LIKE '#%' AND f.extension IN ('.py', '.rb', '.php')
                          OR ltrim(line) LIKE '//%' AND f.extension IN ('.js', '.php')
                          OR ltrim(line) LIKE '--%' AND f.extension = '.sql') AS comment_lines,
         count(*) FILTER (length(line) > 200) AS long_lines,
         count(*) FILTER (contains(upper(line), 'TODO')) AS todo,
         count(*) FILTER (contains(upper(line), 'FIXME')) AS fixme,
         count(*) FILTER (contains(upper(line), 'XXX')) AS xxx
  FROM code_files f LEFT JOIN code_lines l ON f.path = l.path AND f.repo_id = l.repo_id
  GROUP BY f.repo_id, f.path, f.extension)
"""
_STATS = with_ctes("code_files", "code_lines") + "," + _LINE_STATS


@query(_STATS + "SELECT *, total_lines - blank_lines - comment_lines AS code_lines FROM stats")
def file_line_stats(spark, sf):
    return code.file_line_stats(B.code_files(spark, sf))


@query(_STATS + """
SELECT repo_id, count(*) AS source_files, sum(total_lines)::BIGINT AS total_lines,
       sum(blank_lines)::BIGINT AS blank_lines, sum(comment_lines)::BIGINT AS comment_lines,
       sum(total_lines - blank_lines - comment_lines)::BIGINT AS code_lines, sum(long_lines)::BIGINT AS long_lines,
       sum(todo)::BIGINT AS todo, sum(fixme)::BIGINT AS fixme, sum(xxx)::BIGINT AS xxx
FROM stats GROUP BY repo_id""")
def code_stats(spark, sf):
    files = B.code_files(spark, sf)
    return code.code_stats(code.file_line_stats(files), files.select("repo_id").distinct())


@query(with_ctes("python_files") + """
SELECT repo_id, count(*) AS source_files, sum(CASE WHEN broken THEN 0 ELSE functions END)::BIGINT AS functions,
       sum(CASE WHEN broken THEN 0 ELSE classes END)::BIGINT AS classes, sum(CASE WHEN broken THEN 0 ELSE imports END)::BIGINT AS imports,
       count(*) FILTER (broken) AS syntax_errors
FROM python_files GROUP BY repo_id""")
def python_code_stats(spark, sf):
    files = B.python_files(spark, sf)
    stats = code.code_stats(code.file_line_stats(files), files.select("repo_id").distinct(), python_code.python_metrics(files))
    return stats.select("repo_id", "source_files", "functions", "classes", "imports", "syntax_errors")


@query(with_ctes("code_files") + "SELECT repo_id, extension, count(*) AS files FROM code_files GROUP BY ALL")
def extension_distribution(spark, sf):
    return code.extension_distribution(code.code_candidates(B.code_files(spark, sf)))


@query(with_ctes("doc_files") + """
SELECT * FROM (
  SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS position
  FROM doc_files WHERE is_source OR extension IN ('.md', '.txt', '.rst'))
WHERE position <= 10""")
def largest_files(spark, sf):
    return code.largest_files(code.code_candidates(B.doc_files(spark, sf)))


@query(with_ctes("doc_files", "doc_lines") + """
SELECT repo_id, 'CODE-LONGLINES-' || lpad(CAST(CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS id,
       'LOW' AS severity, 'Code Health' AS category, path,
       long_lines || ' lines run past 200 characters.' AS explanation
FROM (SELECT repo_id, path, count(*) AS long_lines FROM doc_lines
      WHERE length(line) > 200 AND extension NOT IN ('.log', '.bak', '.key') GROUP BY ALL)
WHERE long_lines > 20""")
def long_line_findings(spark, sf):
    found = code.long_line_findings(code.file_line_stats(B.doc_files(spark, sf)))
    return found.select("repo_id", "id", "severity", "category", "path", "explanation")


# --- secrets ------------------------------------------------------------------

# Fixed values of the rules: rule, severity, RE2 pattern, group of the value
_RULES = (
    ("SEC-AWS-KEY", "CRITICAL", r"\bAKIA[0-9A-Z]{16}\b", 0),
    ("SEC-STRIPE-KEY", "HIGH", r"\b(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}\b", 0),
    ("SEC-PRIVATE-KEY", "CRITICAL", r"-----BEGIN (RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----", 0),
    ("SEC-DB-CONN", "HIGH",
     r"""\b(postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^\s"'']+:[^\s"''@]+@[^\s"'']+""", 0),
    ("SEC-GENERIC-ASSIGN", "MEDIUM",
     r"""(?i)\b(api[_-]?key|secret[_-]?key|access[_-]?token|password)\b\s*[:=]\s*[''"]([^''"\s]{8,})[''"]""", 2),
)
_RAW_HITS = "\nUNION ALL ".join(
    f"SELECT repo_id, path, line_no, line, {i} AS ord, '{rule}' AS rule, '{severity}' AS severity, "
    f"regexp_extract_all(line, '{pattern}', {group}) AS vals FROM code_lines"
    for i, (rule, severity, pattern, group) in enumerate(_RULES)
)
_STARS = "left({0}, 4) || repeat('*', least(16, greatest(4, length({0}) - 4))::INT)"
_HITS = f"""
raw_hits AS (
  SELECT * EXCLUDE (vals), unnest(vals) AS value, unnest(range(1, len(vals) + 1)) AS nth
  FROM ({_RAW_HITS}) WHERE len(vals) > 0),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no, ord, nth) AS match
  FROM raw_hits
  WHERE length(value) >= 8 AND lower(value) NOT IN ('changeme','your_api_key','example','placeholder','dummy','fake','test','password')
    AND NOT regexp_full_match(lower(value), 'x{{4,}}|\\*{{4,}}|0{{4,}}')),
evidence AS (
  SELECT repo_id, path, line_no,
         list_reduce(list_prepend(line, vals), lambda acc, v: replace(acc, v, {_STARS.format('v')})) AS shown
  FROM (SELECT repo_id, path, line_no, line, list(DISTINCT value) AS vals FROM hits GROUP BY ALL))
"""
_SECRETS = with_ctes("code_files", "code_lines") + "," + _HITS


@query(_SECRETS + """
SELECT h.repo_id, h.path, h.line_no::INT AS line, h.rule, h.match::INT AS match, left(trim(shown), 160) AS evidence,
       length(value)::INT AS length
FROM hits h JOIN evidence e ON h.repo_id = e.repo_id AND h.path = e.path AND h.line_no = e.line_no""")
def secret_matches(spark, sf):
    return secrets.secret_matches(B.code_files(spark, sf)).drop("entropy")


@query(_SECRETS + """
SELECT repo_id, rule || '-' || lpad(match::VARCHAR, 3, '0') AS id, severity, 'Security' AS category, path, line_no::INT AS line
FROM hits""")
def secret_findings(spark, sf):
    found = secrets.secret_findings(secrets.secret_matches(B.code_files(spark, sf)))
    return found.select("repo_id", "id", "severity", "category", "path", "line")


@query(_SECRETS + "SELECT repo_id, rule, count(*) AS matches FROM hits GROUP BY ALL")
def secret_rule_counts(spark, sf):
    matches = secrets.secret_matches(B.code_files(spark, sf))
    return matches.groupBy("repo_id", "rule").agg(F.count(F.lit(1)).alias("matches"))


_TOKEN = secrets.SecretRule(
    "TOKEN", "HIGH", r'token = "([0-9a-f]{40})"', "Token", "Revoke it.", group=1, hints=("token = ",)
)


@query(with_ctes("doc_files", "doc_lines") + """
SELECT repo_id, path, line_no::INT AS line,
       left(trim(replace(line, value, left(value, 4) || repeat('*', 16))), 160) AS evidence
FROM (SELECT repo_id, path, line_no, line, unnest(regexp_extract_all(line, 'token = "([0-9a-f]{40})"', 1)) AS value FROM doc_lines)""")
def custom_secret_rule(spark, sf):
    matches = secrets.secret_matches(B.doc_files(spark, sf), rules=[_TOKEN])
    return matches.select("repo_id", "path", "line", "evidence")


_IMPORT = secrets.SecretRule("IMPORT", "LOW", r"^(import m[0-9]{3,})$", "Import", "None.", group=1)


@query(with_ctes("code_files", "code_lines") + """
SELECT repo_id, path, line_no::INT AS line, 'impo' || repeat('*', least(16, length(line) - 4)) AS evidence
FROM code_lines WHERE regexp_full_match(line, 'import m[0-9]{3,}')""")
def anchored_secret_rule(spark, sf):
    matches = secrets.secret_matches(B.code_files(spark, sf), rules=[_IMPORT])
    return matches.select("repo_id", "path", "line", "evidence")


# A rule for every part: the value that its number stands for.
_PART_RULES = {
    "position": "cast(p_partkey as int)", "id": "'PART-' || p_partkey", "severity": "case when p_size > 25 then 'HIGH' else 'LOW' end",
    "pattern": """'"(pw' || (100000 + p_partkey) || ')"'""", "title": "'Value ' || p_partkey", "recommendation": "'Change it.'",
    "group": "1", "hints": "array('pw' || (100000 + p_partkey))", "folded": "p_partkey % 2 = 0",
}
_PART_HITS = with_ctes("code_files", "code_lines") + """, hits AS (
  SELECT repo_id, path, line_no, value, p_partkey, p_size, row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) AS match,
         left(trim(replace(line, value, left(value, 4) || repeat('*', least(16, greatest(4, length(value) - 4))::INT))), 160) AS evidence
  FROM (SELECT repo_id, path, line_no, line, regexp_extract(line, '"(pw[0-9]{6,})"', 1) AS value FROM code_lines)
  JOIN part ON value = 'pw' || (100000 + p_partkey))
"""


def _part_matches(spark, sf):
    rules = B.table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _PART_RULES.items()])
    return secret_rules.secret_matches_by_rules(B.code_files(spark, sf), rules), rules


@query(_PART_HITS + """
SELECT repo_id, path, line_no::INT AS line, 'PART-' || p_partkey AS rule, match::INT AS match, evidence, length(value)::INT AS length FROM hits""")
def secret_matches_by_rules(spark, sf):
    """As many rules as there are parts, from a table."""
    return _part_matches(spark, sf)[0].drop("entropy")


@query(_PART_HITS + """
SELECT repo_id, 'PART-' || p_partkey || '-' || lpad(match::VARCHAR, 3, '0') AS id, 'Value ' || p_partkey AS title, path,
       CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity FROM hits""")
def findings_by_rules(spark, sf):
    found = secret_rules.findings_by_rules(*_part_matches(spark, sf))
    return found.select("repo_id", "id", "title", "path", "severity")


@query(with_ctes("path_files") + """
SELECT repo_id, 'SEC-ENV-' || lpad(CAST(CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS id, path
FROM path_files WHERE lower(name) LIKE '.env%' AND kind = 'file' AND NOT unreadable""")
def env_file_findings(spark, sf):
    return secrets.env_file_findings(B.path_files(spark, sf)).select("repo_id", "id", "path")


# --- Python facts -------------------------------------------------------------

@query(with_ctes("python_files") + """
SELECT repo_id, path, CASE WHEN broken THEN 0 ELSE functions END AS functions,
       CASE WHEN broken THEN 0 ELSE classes END AS classes, CASE WHEN broken THEN 0 ELSE imports END AS imports,
       deep AND NOT broken AS deep, broken AS syntax_error
FROM python_files""")
def python_metrics(spark, sf):
    return python_code.python_metrics(B.python_files(spark, sf)).select(
        "repo_id", "path", "functions", "classes", "imports",
        (F.col("max_depth") > 14).alias("deep"), F.col("syntax_error").isNotNull().alias("syntax_error"),
    )


@query(with_ctes("python_files") + "SELECT repo_id, path, unnest(modules) AS module FROM python_files WHERE NOT broken")
def python_imports(spark, sf):
    return python_code.python_imports(python_code.python_metrics(B.python_files(spark, sf)))


@query(with_ctes("python_files") + """
SELECT repo_id, CASE WHEN broken THEN 'CODE-SYNTAX-' ELSE 'CODE-NESTING-' END ||
         lpad(CAST(CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS id,
       CASE WHEN broken THEN 'MEDIUM' ELSE 'LOW' END AS severity, path
FROM python_files WHERE broken OR deep""")
def python_findings(spark, sf):
    # stored, so that a file is parsed once for both checks
    metrics = stored(python_code.python_metrics(B.python_files(spark, sf)), "metrics")
    found = python_code.syntax_findings(metrics).unionByName(python_code.nesting_findings(metrics))
    return found.select("repo_id", "id", "severity", "path")


# --- imports ------------------------------------------------------------------

def _modules(spark):
    return imports.module_classes(spark, B.FIRST_PARTY, stdlib=B.STDLIB, third_party=B.THIRD_PARTY)


_CLASSES = with_ctes("imports") + """, classes AS (
SELECT repo_id, module, count(*) AS files,
       CASE WHEN module = 'new' THEN 'first_party' WHEN module IN ('blue', 'red', 'old') THEN 'stdlib'
            WHEN module = 'hot' THEN 'third_party' ELSE 'needs_review' END AS class
FROM imports GROUP BY repo_id, module)
"""


@query(_CLASSES + "SELECT * FROM classes")
def import_classes(spark, sf):
    classes = imports.import_classes(B.part_imports(spark, sf), _modules(spark))
    return classes.select("repo_id", "module", "files", "class")


@query(_CLASSES + "SELECT repo_id, module FROM classes WHERE class IN ('third_party', 'needs_review')")
def unknown_modules(spark, sf):
    return imports.unknown_modules(B.part_imports(spark, sf), _modules(spark))


@query(_CLASSES + """
SELECT repo_id, count(*) AS modules, count(*) FILTER (class = 'stdlib') AS stdlib,
       count(*) FILTER (class = 'first_party') AS first_party, count(*) FILTER (class = 'third_party') AS third_party,
       count(*) FILTER (class = 'needs_review') AS needs_review,
       CASE WHEN count(*) FILTER (class = 'needs_review') > 0 THEN 'NEEDS REVIEW'
            WHEN count(*) FILTER (class = 'third_party') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM classes GROUP BY repo_id""")
def import_census(spark, sf):
    classes = imports.import_classes(B.part_imports(spark, sf), _modules(spark))
    return imports.import_census(classes, B.part_repos(spark, sf))


@query(with_ctes("python_files") + """, used AS (
  SELECT DISTINCT repo_id, module FROM (SELECT repo_id, unnest(modules) AS module FROM python_files
                                        WHERE NOT broken AND path LIKE 'pkg/%'))
SELECT f.repo_id, count(DISTINCT f.path) FILTER (f.path LIKE 'pkg/%') AS python_files,
       count(DISTINCT module) AS modules, count(DISTINCT module) FILTER (module = 'os') AS stdlib,
       count(DISTINCT module) FILTER (module = 'pkg1') AS first_party,
       count(DISTINCT module) FILTER (module NOT IN ('os', 'pkg1')) AS needs_review
FROM python_files f LEFT JOIN used u ON f.repo_id = u.repo_id GROUP BY f.repo_id""")
def import_audit(spark, sf):
    audit = run_import_audit(B.python_files(spark, sf), first_party=["pkg1"])
    return audit.select("repo_id", "python_files", "modules", "stdlib", "first_party", "needs_review")
