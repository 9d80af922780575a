"""Dependencies, hygiene, technologies, README."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import dependencies as deps
from corpaudit.operators import docs, hygiene
from corpaudit.operators import technologies as tech
from corpaudit.operators.files import scanned_files
from registry import bindings as B
from registry.bindings import with_ctes
from registry.catalog import query

_DECLARED = with_ctes("declared")


def _declared(spark, sf, *names, scope="runtime"):
    parsed = deps.manifests(B.manifest_files(spark, sf, *names))
    rows = deps.dependencies(parsed).filter(F.col("scope") == scope)
    return rows.select("repo_id", "ecosystem", "manifest_file", "ordinal", "name")


def _listed(manifest: str, ecosystem: str, column: str, offset: str = "0") -> str:
    return _DECLARED + f"""
SELECT repo_id, '{ecosystem}' AS ecosystem, '{manifest}' AS manifest_file,
       unnest(range(1, len({column}) + 1)) + {offset} AS ordinal, unnest({column}) AS name
FROM declared"""


@query(_DECLARED + """
SELECT repo_id, ordinal, name,
       CASE WHEN ordinal IN (1, 3) OR ordinal > 3 THEN '==' WHEN o_custkey % 4 = 0 THEN ''
            WHEN o_custkey % 4 = 1 THEN '>=' ELSE '==' END AS operator,
       CASE WHEN ordinal = 1 THEN '1.' || (o_orderkey % 4) WHEN ordinal = 3 THEN '2.0' WHEN ordinal > 3 THEN '1'
            WHEN o_custkey % 4 = 0 THEN '' ELSE '2' END AS version
FROM (SELECT *, unnest(range(1, len(requirements) + 1)) AS ordinal, unnest(requirements) AS name FROM declared)""")
def requirements(spark, sf):
    rows = deps.dependencies(deps.manifests(B.manifest_files(spark, sf, "requirements.txt")))
    return rows.select("repo_id", "ordinal", "name", "operator", "version")


@query(_listed("pyproject.toml", "python", "pyproject"))
def pyproject(spark, sf):
    return _declared(spark, sf, "pyproject.toml")


@query(_listed("pyproject.toml", "python", "pyproject_dev", "2"))
def pyproject_dev(spark, sf):
    return _declared(spark, sf, "pyproject.toml", scope="dev")


@query(_listed("package.json", "node", "package"))
def package_json(spark, sf):
    return _declared(spark, sf, "package.json")


@query(_listed("package.json", "node", "package_dev", "2"))
def package_json_dev(spark, sf):
    return _declared(spark, sf, "package.json", scope="dev")


@query(_listed("Cargo.toml", "rust", "cargo"))
def cargo(spark, sf):
    return _declared(spark, sf, "Cargo.toml")


@query(_listed("Cargo.toml", "rust", "cargo_dev", "2"))
def cargo_dev(spark, sf):
    return _declared(spark, sf, "Cargo.toml", scope="dev")


@query(_listed("go.mod", "go", "go_mod"))
def go_mod(spark, sf):
    return _declared(spark, sf, "go.mod")


@query(_listed("pom.xml", "java", "pom"))
def pom(spark, sf):
    return _declared(spark, sf, "pom.xml")


_SUMMARY = _DECLARED + """, summary AS (
SELECT repo_id, 'requirements.txt' AS manifest_file, 'python' AS ecosystem, requirements AS runtime, [] AS dev,
       pinned, false AS lockfile_present, repeats AS duplicates FROM declared
UNION ALL SELECT repo_id, 'pyproject.toml', 'python', pyproject, pyproject_dev, false, locked, [] FROM declared
UNION ALL SELECT repo_id, 'package.json', 'node', package, package_dev, package_pinned,
                 locked AND o_orderkey % 17 <> 0, [] FROM declared
UNION ALL SELECT repo_id, 'Cargo.toml', 'rust', cargo, cargo_dev, false, locked, [] FROM declared
UNION ALL SELECT repo_id, 'go.mod', 'go', go_mod, [], true, locked, [] FROM declared
UNION ALL SELECT repo_id, 'pom.xml', 'java', pom, [], false, false, [] FROM declared)
"""


def _summary(spark, sf):
    files = B.manifest_files(spark, sf, *B.ALL_MANIFESTS, locks=True)
    return deps.manifest_summary(deps.manifests(files), deps.lockfiles(files))


@query(_SUMMARY + """
SELECT repo_id, manifest_file, ecosystem, array_to_string(runtime, ',') AS runtime, array_to_string(dev, ',') AS dev,
       pinned, lockfile_present, array_to_string(duplicates, ',') AS duplicates FROM summary""")
def manifest_summary(spark, sf):
    joined = [F.array_join(c, ",").alias(c) for c in ("runtime", "dev", "duplicates")]
    return _summary(spark, sf).select(
        "repo_id", "manifest_file", "ecosystem", "pinned", "lockfile_present", *joined
    )


@query(_SUMMARY + """
SELECT repo_id, 'DEP-LARGE-' || ecosystem AS id, 'LOW' AS severity, manifest_file AS path,
       len(runtime) || ' runtime dependencies are declared.' AS explanation FROM summary WHERE len(runtime) > 80
UNION ALL
SELECT repo_id, 'DEP-DUP-' || ecosystem, 'LOW', manifest_file, 'Declared again: ' || array_to_string(duplicates, ', ')
FROM summary WHERE len(duplicates) > 0
UNION ALL
SELECT repo_id, 'DEP-NOLOCK-' || ecosystem, 'INFO', manifest_file, 'Without a lockfile the resolved versions can change.'
FROM summary WHERE NOT lockfile_present AND ecosystem IN ('node', 'python', 'rust')""")
def dependency_findings(spark, sf):
    return deps.dependency_findings(_summary(spark, sf)).select("repo_id", "id", "severity", "path", "explanation")


@query(_SUMMARY + """
SELECT repo_id, manifest_file FROM summary WHERE NOT lockfile_present AND ecosystem IN ('node', 'python', 'rust')""")
def missing_lockfile(spark, sf):
    return deps.missing_lockfiles(_summary(spark, sf)).select("repo_id", "manifest_file")


# --- duplicates ---------------------------------------------------------------

_HASHED = with_ctes("doc_files") + ", hashed AS (SELECT *, sha256(text) AS digest FROM doc_files)"


def _digests(spark, sf):
    return hygiene.with_digest(B.doc_files(spark, sf))


def _doc_lists(spark, sf, scope="repo"):
    digests = _digests(spark, sf)
    return hygiene.duplicate_lists(digests, hygiene.duplicate_groups(digests, scope=scope), scope=scope)


@query(_HASHED + """
SELECT repo_id, digest, count(*) AS copies, min(path) AS first_path, min(size) * (count(*) - 1) AS reclaimable_bytes,
       string_agg(path, ',' ORDER BY path) AS paths, 0 AS page
FROM hashed GROUP BY repo_id, digest HAVING count(*) > 1""")
def duplicate_files(spark, sf):
    return _doc_lists(spark, sf).withColumn("paths", F.array_join("paths", ","))


@query(_HASHED + """
SELECT digest, count(*) AS copies, min(repo_id || '/' || path) AS first_path,
       min(size) * (count(*) - 1) AS reclaimable_bytes,
       string_agg(repo_id || '/' || path, ',' ORDER BY repo_id || '/' || path) AS paths, 0 AS page
FROM hashed GROUP BY digest HAVING count(*) > 1""")
def duplicate_files_corpus(spark, sf):
    return _doc_lists(spark, sf, "corpus").withColumn("paths", F.array_join("paths", ","))


@query(_HASHED + """
SELECT digest, repo_id || '/' || path AS member FROM hashed
WHERE digest IN (SELECT digest FROM hashed GROUP BY digest HAVING count(*) > 1)""")
def duplicate_members(spark, sf):
    digests = _digests(spark, sf)
    groups = hygiene.duplicate_groups(digests, scope="corpus")
    return hygiene.duplicate_members(digests, groups, scope="corpus")


@query(_HASHED + """
SELECT repo_id, 'HYG-DUP-' || lpad(CAST(CAST(('0x' || substr(sha256(string_agg(path, ':' ORDER BY path)), 1, 8)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS id,
       'LOW' AS severity, min(path) AS path
FROM hashed GROUP BY repo_id, digest HAVING count(*) > 1""")
def duplicate_findings(spark, sf):
    digests = _digests(spark, sf)
    found = hygiene.duplicate_findings(digests, hygiene.duplicate_groups(digests))
    return found.select("repo_id", "id", "severity", "path")


# --- hygiene ------------------------------------------------------------------

def _at(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    below = " OR ".join(f"starts_with(path, '{n}/')" for n in names)
    return f"coalesce(bool_or(path IN ({listed}) AND coalesce(error, '') <> 'broken symlink' OR {below}), false)"


_PRESENCE = with_ctes("path_files", "path_scanned") + f""", presence AS (
SELECT repo_id, {_at('README.md', 'README.rst', 'README.txt', 'README')} AS has_readme,
       {_at('LICENSE', 'LICENSE.md', 'LICENSE.txt', 'COPYING')} AS has_license, {_at('.gitignore')} AS has_gitignore,
       {_at('.github/workflows', '.gitlab-ci.yml', '.travis.yml', 'azure-pipelines.yml', 'Jenkinsfile', '.circleci/config.yml')} AS has_ci,
       bool_or(path LIKE 'tests/%' OR path LIKE 'test/%' OR path IN ('tests', 'test') AND kind = 'dir')
         OR repo_id IN (SELECT repo_id FROM path_scanned WHERE is_source AND lower(path) LIKE '%test%') AS has_tests,
       {_at('.git')} AS has_git
FROM path_files GROUP BY repo_id)
"""


@query(_PRESENCE + "SELECT * FROM presence")
def presence(spark, sf):
    files = B.path_files(spark, sf)
    return hygiene.presence(files, files.select("repo_id").distinct())


def _hashed_id(prefix: str) -> str:
    return (
        f"'{prefix}' || lpad(CAST(CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
    )


_RISK = """CASE extension WHEN '.key' THEN 'HIGH' WHEN '.bak' THEN 'LOW' WHEN '.sql' THEN 'INFO' WHEN '.log' THEN 'INFO' END"""
_HYGIENE = _PRESENCE + f""", found AS (
SELECT repo_id, 'HYG-001' AS id, 'MEDIUM' AS severity, '' AS path FROM presence WHERE NOT has_readme
UNION ALL SELECT repo_id, 'HYG-002', 'LOW', '' FROM presence WHERE NOT has_license
UNION ALL SELECT repo_id, 'HYG-003', 'LOW', '' FROM presence WHERE NOT has_gitignore
UNION ALL SELECT repo_id, 'HYG-004', 'LOW', '' FROM presence WHERE NOT has_ci
UNION ALL SELECT repo_id, 'HYG-005', 'MEDIUM', '' FROM presence WHERE NOT has_tests
UNION ALL SELECT repo_id, 'HYG-GIT-000', 'LOW', '' FROM presence WHERE NOT has_git
UNION ALL SELECT repo_id, {_hashed_id('HYG-RISK-')}, {_RISK}, path FROM path_scanned WHERE {_RISK} IS NOT NULL
UNION ALL SELECT repo_id, {_hashed_id('HYG-LARGE-')}, 'LOW', path FROM path_scanned WHERE size > 5 * 1024 * 1024
UNION ALL SELECT repo_id, {_hashed_id('HYG-SYMLINK-')}, 'INFO', path FROM path_scanned WHERE error = 'broken symlink')
"""


@query(_HYGIENE + "SELECT repo_id, id, severity, path FROM found")
def hygiene_findings(spark, sf):
    files = B.path_files(spark, sf)
    found = hygiene.hygiene_findings(files, files.select("repo_id").distinct())
    return found.select("repo_id", "id", "severity", "path")


@query(_HYGIENE + "SELECT repo_id FROM found WHERE id = 'HYG-GIT-000'")
def git_presence(spark, sf):
    files = B.path_files(spark, sf)
    facts = hygiene.presence(files, files.select("repo_id").distinct())
    return hygiene.presence_findings(facts, checks=["has_git"]).select("repo_id")


@query(with_ctes("doc_files") + f"""
SELECT repo_id, {_hashed_id('HYG-RISK-')} AS id, {_RISK} AS severity, 'Hygiene' AS category, path
FROM doc_files WHERE {_RISK} IS NOT NULL""")
def risky_files(spark, sf):
    found = hygiene.risky_findings(scanned_files(B.doc_files(spark, sf)))
    return found.select("repo_id", "id", "severity", "category", "path")


@query(with_ctes("path_files", "path_scanned") + f"""
SELECT repo_id, {_hashed_id('HYG-LARGE-')} AS id, path,
       format('{{:.1f}}MB is much for version control.', size / 1048576.0::DOUBLE) AS explanation
FROM path_scanned WHERE size > 5 * 1024 * 1024""")
def large_files(spark, sf):
    found = hygiene.large_findings(scanned_files(B.path_files(spark, sf)))
    return found.select("repo_id", "id", "path", "explanation")


@query(with_ctes("path_files", "path_scanned") + f"""
SELECT repo_id, {_hashed_id('HYG-SYMLINK-')} AS id, path FROM path_scanned WHERE error = 'broken symlink'""")
def broken_symlinks(spark, sf):
    return hygiene.symlink_findings(scanned_files(B.path_files(spark, sf))).select("repo_id", "id", "path")


# --- technologies -------------------------------------------------------------

# Names that show a technology or a file that should be there
_ROOT = {
    "Python": ("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile"),
    "Node.js": ("package.json",), "Rust": ("Cargo.toml",), "Go": ("go.mod",), "Java (Maven)": ("pom.xml",),
    "Java (Gradle)": ("build.gradle", "build.gradle.kts"), "C/C++": ("CMakeLists.txt", "Makefile"),
}
_BY_COUNT = [
    ("TypeScript", "'.ts', '.tsx'"), ("Python", "'.py'"), ("JavaScript", "'.js', '.jsx'"), ("Go", "'.go'"),
    ("Rust", "'.rs'"), ("Java", "'.java'"), ("C/C++", "'.c', '.cpp', '.h'"),
]
_NAMES = " ".join(
    f"WHEN lower(name) IN ({', '.join(repr(n.lower()) for n in names)}) THEN '{t}'" for t, names in _ROOT.items()
)
_TECH = with_ctes("path_files", "path_scanned", "path_repos") + """, evidence AS (
""" + "\nUNION ALL ".join(
    f"SELECT repo_id, '{t}' AS tech, 0 AS phase, {i} AS place, '' AS path FROM path_files "
    f"WHERE path IN ({', '.join(repr(n) for n in names)}) AND coalesce(error, '') <> 'broken symlink'"
    for i, (t, names) in enumerate(_ROOT.items())
) + f"""
UNION ALL SELECT repo_id, tech, 1, 0, path
FROM (SELECT *, CASE WHEN lower(name) = 'tsconfig.json' THEN 'TypeScript' {_NAMES} END AS tech FROM path_scanned)
WHERE tech IS NOT NULL
""" + "".join(
    f"UNION ALL SELECT repo_id, '{t}', 2, {i}, '' FROM path_scanned WHERE extension IN ({e}) AND extension <> '.bin' "
    "GROUP BY repo_id HAVING count(*) >= 2\n"
    for i, (t, e) in enumerate(_BY_COUNT)
) + """), kept AS (
SELECT repo_id, tech, min((phase, place, path)) AS first FROM evidence e
WHERE NOT (tech = 'JavaScript' AND EXISTS (
  SELECT 1 FROM evidence x WHERE x.repo_id = e.repo_id AND x.tech IN ('TypeScript', 'Node.js')
    AND (x.phase < 2 OR x.tech = 'TypeScript')))
GROUP BY repo_id, tech)
SELECT r.repo_id, coalesce(string_agg(tech, ', ' ORDER BY first), 'Unknown / Generic') AS technologies
FROM path_repos r LEFT JOIN kept k ON r.repo_id = k.repo_id GROUP BY r.repo_id"""


@query(_TECH)
def technologies(spark, sf):
    files = B.path_files(spark, sf)
    found = tech.technologies(files, files.select("repo_id").distinct())
    return found.select("repo_id", F.array_join("technologies", ", ").alias("technologies"))


# --- README -------------------------------------------------------------------

_README = with_ctes("path_files", "path_repos") + """, candidates AS (
SELECT repo_id, path, lower(text) AS low, length(text) AS chars,
       list_position(['README.md', 'README.rst', 'README.txt', 'README'], path) AS preference
FROM path_files WHERE path IN ('README.md', 'README.rst', 'README.txt', 'README') AND coalesce(error, '') <> 'broken symlink'),
best AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY preference) = 1),
facts AS (
SELECT *, list_filter([
  CASE WHEN low LIKE '%install%' OR low LIKE '%setup%' OR low LIKE '%getting started%' THEN 'installation' END,
  CASE WHEN low LIKE '%usage%' OR low LIKE '%how to use%' OR low LIKE '%quick start%' OR low LIKE '%example%' THEN 'usage' END,
  CASE WHEN low LIKE '%features%' OR low LIKE '%what it does%' THEN 'features' END,
  CASE WHEN low LIKE '%config%' OR low LIKE '%options%' OR low LIKE '%environment variables%' THEN 'configuration' END,
  CASE WHEN low LIKE '%testing%' OR low LIKE '%tests%' OR low LIKE '%how to test%' THEN 'testing' END,
  CASE WHEN low LIKE '%license%' OR low LIKE '%licence%' THEN 'license' END,
  CASE WHEN low LIKE '%contributing%' OR low LIKE '%contribution%' THEN 'contribution' END,
  CASE WHEN low LIKE '%example%' OR low LIKE '%demo%' THEN 'examples' END], lambda s: s IS NOT NULL) AS sections
FROM best),
scores AS (
SELECT r.repo_id, path AS readme, coalesce(chars, 0) AS length_chars, coalesce(sections, []) AS sections,
       CASE WHEN path IS NULL THEN 0 ELSE least(100, least(50, chars // 40) + (50 * len(sections)) // 8) END AS doc_score
FROM path_repos r LEFT JOIN facts f ON r.repo_id = f.repo_id)
"""


def _readme_scores(spark, sf):
    files = B.path_files(spark, sf)
    return docs.readme_scores(docs.readme_candidates(files), files.select("repo_id").distinct())


@query(_README + """
SELECT repo_id, readme, length_chars, array_to_string(sections, ',') AS sections, doc_score FROM scores""")
def readme_score(spark, sf):
    return _readme_scores(spark, sf).withColumn("sections", F.array_join("sections", ","))


@query(_README + """
SELECT repo_id, 'DOC-000' AS id, 'MEDIUM' AS severity, '' AS path, 'Nothing documents the project.' AS explanation
FROM scores WHERE readme IS NULL
UNION ALL SELECT repo_id, 'DOC-001', 'MEDIUM', readme, 'It has ' || length_chars || ' characters.'
FROM scores WHERE readme IS NOT NULL AND length_chars < 500
UNION ALL SELECT repo_id, 'DOC-002', 'LOW', readme, 'It says nothing on: ' || array_to_string(
  list_filter(['installation', 'usage', 'license'], lambda s: NOT list_contains(sections, s)), ', ')
FROM scores WHERE readme IS NOT NULL AND NOT list_has_all(sections, ['installation', 'usage', 'license'])""")
def readme_findings(spark, sf):
    found = docs.readme_findings(_readme_scores(spark, sf))
    return found.select("repo_id", "id", "severity", "path", "explanation")
