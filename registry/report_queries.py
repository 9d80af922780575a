"""Findings tables, scores, reports, comparisons, whole scans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.operators import dependencies as deps
from corpaudit.operators import diff, findings, hygiene, reports, scoring
from corpaudit.plans import live
from corpaudit.plans import scan as plans
from corpaudit.plans.reuse import FeatureStore
from corpaudit.sinks import ReportFolder
from corpaudit.sources import write_files
from corpaudit.storage import new_folder, shuffles_dropped
from registry import bindings as B
from registry.bindings import with_ctes
from registry.catalog import query
from registry.code_queries import _HITS as _SECRET_HITS
from registry.repo_queries import _HYGIENE, _README, _SUMMARY, _hashed_id, _at, _summary

_FINDINGS = with_ctes("findings", "repos", "doc_scores")
_ORDER = "severity_rank, category, path, coalesce(line, 0), id"
_LOCATION = "CASE WHEN coalesce(line, 0) <> 0 THEN path || ':' || line WHEN path <> '' THEN path ELSE '{}' END"


@query(_FINDINGS + "SELECT * FROM findings")
def sorted_findings(spark, sf):
    return findings.sorted_findings(B.event_findings(spark, sf))


@query(_FINDINGS + "SELECT repo_id, id, severity FROM findings WHERE severity_rank <= 1")
def severity_at_or_above(spark, sf):
    return findings.severity_at_or_above(B.event_findings(spark, sf), "high").select("repo_id", "id", "severity")


@query(_FINDINGS + "SELECT repo_id, id FROM findings WHERE severity <> 'INFO'")
def drop_info(spark, sf):
    return findings.drop_info(B.event_findings(spark, sf)).select("repo_id", "id")


@query(_FINDINGS + """
SELECT r.repo_id, count(id) FILTER (severity = 'CRITICAL') AS "CRITICAL", count(id) FILTER (severity = 'HIGH') AS "HIGH",
       count(id) FILTER (severity = 'MEDIUM') AS "MEDIUM", count(id) FILTER (severity = 'LOW') AS "LOW",
       count(id) FILTER (severity = 'INFO') AS "INFO"
FROM repos r LEFT JOIN findings f ON r.repo_id = f.repo_id GROUP BY r.repo_id""")
def finding_counts(spark, sf):
    return findings.finding_counts(B.event_findings(spark, sf), B.event_repos(spark, sf))


_PENALTY = "CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 6 WHEN 'LOW' THEN 2 ELSE 0 END"


def _scores_sql(source: str, name: str) -> str:
    dims = ", ".join(
        f"greatest(0, 100 - coalesce(sum({_PENALTY}) FILTER (category = '{c}'), 0))::INT AS {d}"
        for c, d in (("Security", "security"), ("Dependencies", "dependencies"), ("Code Health", "code_health"),
                     ("Documentation", "doc_findings"), ("Hygiene", "hygiene"))
    )
    return f"""
{name}_dims AS (
  SELECT r.repo_id, {dims} FROM repos r LEFT JOIN {source} f ON r.repo_id = f.repo_id GROUP BY r.repo_id),
{name} AS (
  SELECT repo_id, round_even(security * 0.30::DECIMAL(9,6) + code_health * 0.25::DECIMAL(9,6) + documentation * 0.15::DECIMAL(9,6)
           + dependencies * 0.15::DECIMAL(9,6) + hygiene * 0.15::DECIMAL(9,6), 0)::INT AS overall,
         security, dependencies, code_health, documentation, hygiene
  FROM (SELECT d.*, least(doc_findings, doc_score)::INT AS documentation
        FROM {name}_dims d JOIN doc_scores s ON d.repo_id = s.repo_id))"""


_SCORES = _FINDINGS + "," + _scores_sql("findings", "scores")


def _event_scores(spark, sf, found=None):
    found = B.event_findings(spark, sf) if found is None else found
    return scoring.scores(found, B.event_repos(spark, sf), B.event_doc_scores(spark, sf))


@query(_SCORES + "SELECT repo_id, security, dependencies, code_health, documentation, hygiene FROM scores")
def dimension_scores(spark, sf):
    return scoring.dimension_scores(
        B.event_findings(spark, sf), B.event_repos(spark, sf), B.event_doc_scores(spark, sf)
    )


@query(_SCORES + "SELECT * FROM scores")
def overall_score(spark, sf):
    return _event_scores(spark, sf)


@query(_SCORES + """
SELECT repo_id, round_even(security * 0.4::DECIMAL(9,6) + code_health * 0.3::DECIMAL(9,6) + hygiene * 0.3::DECIMAL(9,6), 0)::INT AS overall,
       security, code_health, hygiene FROM scores""")
def score_compact(spark, sf):
    return scoring.scores(B.event_findings(spark, sf), B.event_repos(spark, sf), weights=K.WEIGHTS_COMPACT)


@query(_FINDINGS + f"""
SELECT repo_id, CASE category WHEN 'Security' THEN 'security' WHEN 'Dependencies' THEN 'dependencies'
         WHEN 'Code Health' THEN 'code_health' WHEN 'Documentation' THEN 'documentation' ELSE 'hygiene' END AS dimension,
       '-' || {_PENALTY} || ' for ' || severity || ' finding [' || id || '] ' || title AS reason
FROM findings WHERE {_PENALTY} > 0 AND category <> 'Other'
UNION ALL SELECT repo_id, 'documentation', 'README score: ' || doc_score || '/100' FROM doc_scores""")
def score_reasons(spark, sf):
    return scoring.score_reasons(B.event_findings(spark, sf), B.event_doc_scores(spark, sf))


@query(_FINDINGS + f""", firsts AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, title ORDER BY {_ORDER}) AS nth FROM findings WHERE severity <> 'INFO'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}) AS position FROM firsts WHERE nth = 1 AND recommendation <> '')
SELECT r.repo_id, coalesce(position, 1)::INT AS position,
       coalesce(recommendation, 'Nothing of note was found; keep it that way.') AS recommendation
FROM repos r LEFT JOIN (SELECT * FROM ranked WHERE position <= 8) k ON r.repo_id = k.repo_id""")
def recommendations(spark, sf):
    return findings.recommendations(B.event_findings(spark, sf), B.event_repos(spark, sf))


@query(_FINDINGS + f"""
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}) AS step, severity AS priority, id, title,
       {_LOCATION.format('Repository-wide')} AS location, explanation AS reason,
       CASE WHEN recommendation <> '' THEN recommendation
            ELSE 'Look into the finding and settle it as your policies require.' END AS action
FROM findings""")
def fix_plan(spark, sf):
    return findings.fix_plan(B.event_findings(spark, sf))


@query(_FINDINGS + """
SELECT r.repo_id, CASE WHEN count(id) FILTER (severity_rank <= 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS gate
FROM repos r LEFT JOIN findings f ON r.repo_id = f.repo_id GROUP BY r.repo_id""")
def quality_gate(spark, sf):
    return findings.quality_gate(B.event_findings(spark, sf), B.event_repos(spark, sf), fail_on="high")


@query(_FINDINGS + """
SELECT r.repo_id, CASE WHEN count(id) > 0 THEN 'FAIL' ELSE 'PASS' END AS gate
FROM repos r LEFT JOIN findings f ON r.repo_id = f.repo_id GROUP BY r.repo_id""")
def quality_gate_any(spark, sf):
    return findings.quality_gate(B.event_findings(spark, sf), B.event_repos(spark, sf))


# --- unions and reports -------------------------------------------------------

_ALL = with_ctes("path_files", "path_scanned", "findings", "declared") + "," + \
    _HYGIENE[_HYGIENE.index("presence AS"):] + "," + _SUMMARY[_SUMMARY.index("summary AS"):]


@query(_ALL + """
SELECT repo_id, id, severity, path FROM findings
UNION ALL SELECT repo_id, id, severity, path FROM found
UNION ALL SELECT repo_id, 'DEP-NOLOCK-' || ecosystem, 'INFO', manifest_file FROM summary
          WHERE NOT lockfile_present AND ecosystem IN ('node', 'python', 'rust')
UNION ALL SELECT repo_id, 'DEP-LARGE-' || ecosystem, 'LOW', manifest_file FROM summary WHERE len(runtime) > 80
UNION ALL SELECT repo_id, 'DEP-DUP-' || ecosystem, 'LOW', manifest_file FROM summary WHERE len(duplicates) > 0""")
def all_findings(spark, sf):
    files = B.path_files(spark, sf)
    parts = [
        B.event_findings(spark, sf),
        hygiene.hygiene_findings(files, files.select("repo_id").distinct()),
        deps.dependency_findings(_summary(spark, sf)),
    ]
    return findings.all_findings(parts).select("repo_id", "id", "severity", "path")


@query(_SCORES + """, counts AS (
  SELECT repo_id, count(*) AS n FROM findings GROUP BY repo_id)
SELECT s.*, coalesce(count(id), 0) AS files_scanned, coalesce(count(id), 0) AS source_files,
       coalesce(sum(line), 0)::BIGINT AS total_lines,
       count(id) FILTER (severity = 'CRITICAL') AS "CRITICAL", count(id) FILTER (severity = 'HIGH') AS "HIGH",
       count(id) FILTER (severity = 'MEDIUM') AS "MEDIUM", count(id) FILTER (severity = 'LOW') AS "LOW",
       count(id) FILTER (severity = 'INFO') AS "INFO"
FROM scores s LEFT JOIN findings f ON s.repo_id = f.repo_id GROUP BY ALL""")
def summary(spark, sf):
    found, repos = B.event_findings(spark, sf), B.event_repos(spark, sf)
    # every finding stands for one file of as many lines as its line number
    stats = found.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("source_files"), F.coalesce(F.sum("line"), F.lit(0)).alias("total_lines")
    )
    return reports.summary(repos, reports.file_counts(found), stats, found, _event_scores(spark, sf, found))


@query(_FINDINGS + f"""
SELECT repo_id, id, severity, category, title, {_LOCATION.format('')} AS location, explanation FROM findings""")
def dashboard_findings(spark, sf):
    return reports.dashboard_findings(B.event_findings(spark, sf))


@query(_SUMMARY + """
SELECT repo_id, ecosystem, manifest_file, len(runtime) AS runtime_dependencies,
       CASE WHEN lockfile_present THEN 'yes' ELSE 'no' END AS lockfile FROM summary""")
def dashboard_dependencies(spark, sf):
    return reports.dashboard_dependencies(_summary(spark, sf))


@query(_FINDINGS + """
SELECT repo_id, id, severity, category, title, path, coalesce(CAST(line AS VARCHAR), '') AS line, explanation, recommendation
FROM findings""")
def csv_report(spark, sf):
    return reports.csv_findings(B.event_findings(spark, sf))


@query(_SCORES + """
SELECT repo_id, unnest(['overall_score', 'security_score', 'dependencies_score', 'code_health_score',
                        'documentation_score', 'hygiene_score', 'files_scanned', 'source_files', 'total_lines']) AS name,
       unnest([overall, security, dependencies, code_health, documentation, hygiene, 0, 0, 0])::BIGINT AS value
FROM scores""")
def csv_summary(spark, sf):
    zeros = {n: F.lit(0) for n in ("files_scanned", "source_files", "total_lines")}
    return reports.csv_summary(_event_scores(spark, sf).withColumns(zeros))


def _report(spark, sf, part_rows):
    found, repos = B.event_findings(spark, sf), B.event_repos(spark, sf)
    stats = repos.select("repo_id", F.lit(0).alias("source_files"), F.lit(0).alias("total_lines"))
    return reports.json_report(
        repos=repos,
        summaries=summary(spark, sf),
        technologies=repos.withColumn("technologies", F.array(F.lit(K.UNKNOWN_TECHNOLOGY))),
        manifests=_summary(spark, sf).join(repos, "repo_id", "left_semi"),
        code_stats=stats,
        extensions=found.groupBy("repo_id", F.col("path").alias("extension")).agg(F.count(F.lit(1)).alias("files")),
        largest=found.select("repo_id", F.lit(1).alias("position"), "path", F.lit(0).alias("size")).filter("false"),
        findings=found,
        duplicate_members=found.filter("line = 0 or line is null").select(
            "repo_id", F.col("title").alias("first_path"), F.col("id").alias("member")
        ),
        doc_scores=B.event_doc_scores(spark, sf),
        recommendations=recommendations(spark, sf),
        errors=found.filter("severity = 'CRITICAL'").select("repo_id", "path", F.col("id").alias("error")),
        part_rows=part_rows,
    )


@query(_SCORES + f""", steps AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}) - 1 AS step FROM findings),
types AS (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS step
  FROM (SELECT DISTINCT repo_id, path FROM findings)),
copies AS (
  SELECT repo_id, title, id, row_number() OVER (PARTITION BY repo_id ORDER BY title, id) - 1 AS step
  FROM findings WHERE coalesce(line, 0) = 0),
failures AS (
  SELECT repo_id, path, id, row_number() OVER (PARTITION BY repo_id ORDER BY path, id) - 1 AS step
  FROM findings WHERE severity = 'CRITICAL'),
parts AS (
  SELECT repo_id, 0 AS part FROM repos UNION SELECT repo_id, step // 5 FROM steps UNION SELECT repo_id, step // 5 FROM types
  UNION SELECT repo_id, step // 5 FROM copies UNION SELECT repo_id, step // 5 FROM failures)
SELECT p.repo_id, p.part::INT AS part, CASE WHEN p.part = 0 THEN s.overall END AS overall,
       coalesce((SELECT string_agg(id, ',' ORDER BY step) FROM steps t WHERE t.repo_id = p.repo_id AND t.step // 5 = p.part), '') AS ids,
       coalesce((SELECT string_agg(path, ',' ORDER BY step) FROM types t WHERE t.repo_id = p.repo_id AND t.step // 5 = p.part), '') AS types,
       coalesce((SELECT count(*) FROM steps t WHERE t.repo_id = p.repo_id AND t.step // 5 = p.part
                   AND category = 'Security' AND severity <> 'INFO'), 0) AS security_reasons,
       coalesce((SELECT string_agg(title || '>' || id, ',' ORDER BY step) FROM copies t WHERE t.repo_id = p.repo_id AND t.step // 5 = p.part), '') AS copies,
       coalesce((SELECT string_agg(path || ': ' || id, ',' ORDER BY step) FROM failures t WHERE t.repo_id = p.repo_id AND t.step // 5 = p.part), '') AS errors
FROM parts p LEFT JOIN scores s ON p.repo_id = s.repo_id""")
def json_report(spark, sf):
    report = _report(spark, sf, part_rows=5)
    return report.select(
        "repo_id",
        "part",
        F.col("scores.overall").alias("overall"),
        F.array_join(F.transform("findings", lambda f: f["id"]), ",").alias("ids"),
        F.coalesce(F.array_join(F.transform("extension_distribution", lambda f: f["extension"]), ","), F.lit("")).alias("types"),
        F.size("scores.reasons.security").alias("security_reasons"),
        F.coalesce(F.array_join(F.transform("duplicate_groups", lambda d: F.concat_ws(">", d["first"], d["path"])), ","), F.lit("")).alias("copies"),
        F.coalesce(F.array_join("errors", ","), F.lit("")).alias("errors"),
    )


# --- two runs -----------------------------------------------------------------

_RUNS = with_ctes("findings", "findings_b", "repos", "doc_scores")


@query(_RUNS + """
SELECT 'a' AS only_in, repo_id, id, path, line FROM findings a
WHERE NOT EXISTS (SELECT 1 FROM findings_b b WHERE b.repo_id = a.repo_id AND b.id = a.id AND b.path = a.path
                  AND b.line IS NOT DISTINCT FROM a.line)
UNION ALL SELECT 'b', repo_id, id, path, line FROM findings_b b
WHERE NOT EXISTS (SELECT 1 FROM findings a WHERE b.repo_id = a.repo_id AND b.id = a.id AND b.path = a.path
                  AND b.line IS NOT DISTINCT FROM a.line)""")
def scan_diff(spark, sf):
    return diff.scan_diff(B.event_findings(spark, sf), B.event_findings_b(spark, sf))


@query(_RUNS + """
SELECT repo_id, id, 'a' AS only_in FROM (SELECT repo_id, id FROM findings EXCEPT SELECT repo_id, id FROM findings_b)
UNION ALL SELECT repo_id, id, 'b' FROM (SELECT repo_id, id FROM findings_b EXCEPT SELECT repo_id, id FROM findings)""")
def run_difference(spark, sf):
    return diff.run_difference(B.event_findings(spark, sf), B.event_findings_b(spark, sf))


@query(_RUNS + "," + _scores_sql("findings", "a") + "," + _scores_sql("findings_b", "b") + """
SELECT a.repo_id, a.overall AS a_overall, b.overall AS b_overall, a.security AS a_security, b.security AS b_security
FROM a JOIN b ON a.repo_id = b.repo_id
WHERE (a.overall, a.security, a.dependencies, a.code_health, a.documentation, a.hygiene)
   IS DISTINCT FROM (b.overall, b.security, b.dependencies, b.code_health, b.documentation, b.hygiene)""")
def score_diff(spark, sf):
    changed = diff.score_diff(
        _event_scores(spark, sf), _event_scores(spark, sf, B.event_findings_b(spark, sf))
    )
    return changed.select("repo_id", "a_overall", "b_overall", "a_security", "b_security")


_CHECK_COLUMNS = ["repo_id", "id", "severity", "category", "path", "line"]


def _checksum_sql(source: str) -> str:
    return f"""
SELECT repo_id, count(*) AS rows, sha256(count(*) || ':' || sum(CAST('0x' || substr(sha256(concat_ws(chr(31),
         repo_id, id, severity, category, path, coalesce(CAST(line AS VARCHAR), ''))), 1, 15) AS HUGEINT))) AS checksum
FROM {source} GROUP BY repo_id"""


@query(_RUNS + _checksum_sql("findings"))
def run_checksum(spark, sf):
    return diff.run_checksum(B.event_findings(spark, sf), columns=_CHECK_COLUMNS)


@query(_RUNS + f"""
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, a.checksum IS NOT DISTINCT FROM b.checksum AS repeatable
FROM ({_checksum_sql("findings")}) a FULL JOIN ({_checksum_sql("findings_b")}) b ON a.repo_id = b.repo_id""")
def repeatable(spark, sf):
    verdict = diff.repeatable(
        B.event_findings(spark, sf), B.event_findings_b(spark, sf), columns=_CHECK_COLUMNS
    )
    return verdict.select("repo_id", "repeatable")


_EVENT_KEYS = ", ".join(f"{B.EVENT_COLUMNS[k]} AS {k}" for k in ("repo_id", "id", "path", "line"))
_ROW = "repo_id, id, severity, path, line"


def _event_runs(spark, sf):
    runs = B.event_findings(spark, sf), B.event_findings_b(spark, sf)
    return [diff.KeptRun.write(run, new_folder(spark, "run")) for run in runs]


@query(_RUNS + f""", a AS (SELECT {_ROW}, count(*) AS n FROM findings GROUP BY ALL),
b AS (SELECT {_ROW}, count(*) AS n FROM findings_b GROUP BY ALL)
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.id, b.id) AS id, coalesce(a.severity, b.severity) AS severity,
       coalesce(a.path, b.path) AS path, coalesce(a.line, b.line) AS line, coalesce(a.n, 0) AS in_a, coalesce(b.n, 0) AS in_b
FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.id = b.id AND a.severity = b.severity AND a.path = b.path
  AND a.line IS NOT DISTINCT FROM b.line
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def differing_rows(spark, sf):
    """Rows of two kept runs that differ, found by descending the trees of their checksums."""
    return diff.differing_rows(*_event_runs(spark, sf)).select(*_ROW.split(", "), "in_a", "in_b")


# A finding is there in the runs that its event's number names: some disappear, some come back.
_FIVE_RUNS = (
    "case event_id % 7 when 0 then array(1, 2, 3, 4, 5) when 1 then array(1) when 2 then array(1, 3) when 3 then array(4, 5) "
    "when 4 then array(2, 3, 5) when 5 then array(1, 2, 4, 5) else array(1, 3, 5) end"
)


@query(with_ctes("findings") + f""", runs AS (
  SELECT unnest({_FIVE_RUNS.replace("array(", "list_value(")}) AS run, {_EVENT_KEYS} FROM events),
marked AS (
  SELECT *, run - lag(run) OVER (PARTITION BY repo_id, id, path, line ORDER BY run) AS gap FROM (SELECT DISTINCT * FROM runs)),
spells AS (
  SELECT *, count(*) FILTER (gap IS NULL OR gap > 1) OVER (PARTITION BY repo_id, id, path, line ORDER BY run) AS spell FROM marked)
SELECT repo_id, id, path, line, spell::INT AS spell, min(run) AS first_seen, max(run) AS last_seen, max(run) = 5 AS open
FROM spells GROUP BY repo_id, id, path, line, spell""")
def finding_history(spark, sf):
    """First and last sight of every finding over five runs, reopened ones apart."""
    keys = ["repo_id", "id", "path", "line"]
    runs = B.table(spark, sf, "events").select(
        F.explode(F.expr(_FIVE_RUNS)).alias("run"), *[F.expr(B.EVENT_COLUMNS[k]).alias(k) for k in keys]
    )
    return diff.finding_history(runs)


# --- whole scans --------------------------------------------------------------

@query()
def scan(spark, sf):
    """Summary per repository of a full scan over code, prose and path rows."""
    files = B.code_files(spark, sf).unionByName(B.doc_files(spark, sf)).unionByName(B.path_files(spark, sf))
    return plans.scan(files).summary


@query()
def scan_compact(spark, sf):
    files = B.code_files(spark, sf).unionByName(B.path_files(spark, sf))
    return plans.scan_compact(files).summary


@query()
def verify_repeatable(spark, sf):
    return plans.verify_repeatable(B.doc_files(spark, sf))


# Path rows hold prose, so what a scan finds in them follows from their names.
_SCANNED_PATHS = with_ctes("path_files", "path_scanned", "path_repos") + "," + \
    _HYGIENE[_HYGIENE.index("presence AS"):] + "," + _README[_README.index("candidates AS"):] + f""",
copies AS (
  SELECT repo_id, string_agg(path, ':' ORDER BY path) AS path, min(path) AS first_path
  FROM path_scanned WHERE NOT unreadable AND extension <> '.bin' GROUP BY repo_id, sha256(text) HAVING count(*) > 1),
whole AS (
SELECT repo_id, id, severity, path, 'Hygiene' AS category FROM found
UNION ALL SELECT repo_id, {_hashed_id('HYG-DUP-')}, 'LOW', first_path, 'Hygiene' FROM copies
UNION ALL SELECT repo_id, 'DOC-000', 'MEDIUM', '', 'Documentation' FROM scores WHERE readme IS NULL
UNION ALL SELECT repo_id, 'DOC-001', 'MEDIUM', readme, 'Documentation' FROM scores WHERE readme IS NOT NULL AND length_chars < 500
UNION ALL SELECT repo_id, 'DOC-002', 'LOW', readme, 'Documentation' FROM scores
          WHERE readme IS NOT NULL AND NOT list_has_all(sections, ['installation', 'usage', 'license'])
UNION ALL SELECT repo_id, {_hashed_id('SEC-ENV-')}, 'MEDIUM', path, 'Security' FROM path_scanned
          WHERE lower(name) LIKE '.env%' AND NOT unreadable
UNION ALL SELECT repo_id, {_hashed_id('CODE-SYNTAX-')}, 'MEDIUM', path, 'Code Health' FROM path_scanned
          WHERE extension = '.py' AND NOT unreadable
UNION ALL SELECT repo_id, 'DEP-NOLOCK-node', 'INFO', path, 'Dependencies' FROM path_files
          WHERE path = 'package.json' AND coalesce(error, '') <> 'broken symlink')
"""


@query(_SCANNED_PATHS + "SELECT * FROM whole")
def scan_findings(spark, sf):
    found = plans.scan(B.path_files(spark, sf)).findings
    return found.select("repo_id", "id", "severity", "path", "category")


def _lost(category: str, source: str = "whole") -> str:
    return (
        f"greatest(0, 100 - coalesce((SELECT sum({_PENALTY}) FROM {source} w "
        f"WHERE w.repo_id = r.repo_id AND category = '{category}'), 0))::INT"
    )


def _new_store(spark) -> FeatureStore:
    return FeatureStore(spark, new_folder(spark, "features-by-content"))


@query(_SCANNED_PATHS + "SELECT * FROM whole")
def scan_again(spark, sf):
    """A scan that finds the content of many of its files in the store of an earlier one."""
    files, store = B.path_files(spark, sf), _new_store(spark)
    plans.features_of(files.filter("repo_id < 'r5'"), store=store)
    found = plans.scan(files, feature_store=store).findings
    return found.select("repo_id", "id", "severity", "path", "category")


@query(_SCANNED_PATHS + "SELECT * FROM whole")
def scan_by_batches(spark, sf):
    """A stream over three deliveries, the last of which replaces repositories of the first; one is replayed."""
    files, store = B.path_files(spark, sf), _new_store(spark)
    packed, folder = new_folder(spark, "packed"), new_folder(spark, "live")
    first = F.col("repo_id") < "r5"
    deliveries = [files.filter(first & (F.col("kind") == "file") & F.col("is_source")), files.filter(~first), files.filter(first)]
    for n, delivered in enumerate(deliveries):
        write_files(delivered, f"{packed}/{n}")
        live.follow(spark, packed, folder, feature_store=store).awaitTermination()
    live.apply_batch(deliveries[1], 1, folder, plans.ScanOptions(), store)
    return live.current(spark, folder, "findings").select("repo_id", "id", "severity", "path", "category")


@query(_SCANNED_PATHS + "SELECT * FROM whole WHERE category NOT IN ('Security', 'Dependencies')")
def enable_flags(spark, sf):
    options = replace(plans.ScanOptions(), enable_secrets=False, enable_dependencies=False)
    return plans.scan(B.path_files(spark, sf), options=options).findings.select("repo_id", "id", "severity", "path", "category")


# Code files hold secrets and copies, and nothing of what a repository should have.
_MIXED = _SCANNED_PATHS + ", code_files AS (" + B.CTES["code_files"] + "), code_lines AS (" + B.CTES["code_lines"] + ")," + _SECRET_HITS + """,
code_copies AS (
  SELECT 'code/' || repo_id AS repo_id, string_agg(path, ':' ORDER BY path) AS path, min(path) AS first_path
  FROM code_files WHERE size > 0 GROUP BY repo_id, sha256(text) HAVING count(*) > 1),
mixed AS (
SELECT * FROM whole
UNION ALL SELECT 'code/' || repo_id, rule || '-' || lpad(match::VARCHAR, 3, '0'), severity, path, 'Security' FROM hits
UNION ALL SELECT repo_id, """ + _hashed_id("HYG-DUP-") + """, 'LOW', first_path, 'Hygiene' FROM code_copies
UNION ALL SELECT 'code/' || repo_id, """ + _hashed_id("HYG-RISK-") + """, 'INFO', path, 'Hygiene' FROM code_files WHERE extension = '.sql'
UNION ALL SELECT 'code/' || repo_id, id, severity, '', category
FROM (SELECT DISTINCT repo_id FROM code_files),
     (VALUES ('HYG-001', 'MEDIUM', 'Hygiene'), ('HYG-002', 'LOW', 'Hygiene'), ('HYG-003', 'LOW', 'Hygiene'), ('HYG-004', 'LOW', 'Hygiene'),
             ('HYG-005', 'MEDIUM', 'Hygiene'), ('HYG-GIT-000', 'LOW', 'Hygiene'), ('DOC-000', 'MEDIUM', 'Documentation')) AS v(id, severity, category))
"""


@query(_MIXED + "SELECT * FROM mixed")
def scan_mixed_findings(spark, sf):
    """A scan over path rows and code files; what only a Python parser can tell of the code is left out."""
    code_files = B.code_files(spark, sf).withColumn("repo_id", F.concat(F.lit("code/"), "repo_id"))
    found = plans.scan(code_files.unionByName(B.path_files(spark, sf))).findings
    told = found.filter(~(F.startswith("repo_id", F.lit("code/")) & F.startswith("id", F.lit("CODE-SYNTAX"))))
    return told.select("repo_id", "id", "severity", "path", "category")


_REPORT = _SCANNED_PATHS + """, code AS (
  SELECT * FROM path_scanned WHERE NOT unreadable AND (is_source OR extension IN ('.md', '.txt', '.rst'))),
counted AS (
  SELECT r.repo_id, (SELECT count(*) FROM path_scanned s WHERE s.repo_id = r.repo_id) AS files_scanned,
         (SELECT count(*) FROM code c WHERE c.repo_id = r.repo_id) AS source_files FROM path_repos r),
"""


@query(_REPORT + f"""rated AS (
  SELECT r.repo_id, {_lost('Security')} AS security, {_lost('Dependencies')} AS dependencies,
         {_lost('Code Health')} AS code_health, least({_lost('Documentation')}, doc_score)::INT AS documentation,
         {_lost('Hygiene')} AS hygiene
  FROM path_repos r JOIN scores s ON r.repo_id = s.repo_id)
SELECT repo_id, unnest(['overall_score', 'security_score', 'dependencies_score', 'code_health_score', 'documentation_score',
                        'hygiene_score', 'files_scanned', 'source_files', 'total_lines']) AS name,
       unnest([round_even(security * 0.30::DECIMAL(9,6) + code_health * 0.25::DECIMAL(9,6) + documentation * 0.15::DECIMAL(9,6)
         + dependencies * 0.15::DECIMAL(9,6) + hygiene * 0.15::DECIMAL(9,6), 0)::BIGINT, security, dependencies, code_health,
         documentation, hygiene, files_scanned, source_files, source_files]) AS value
FROM rated JOIN counted USING (repo_id)""")
def scan_csv_summary(spark, sf):
    """All nine measures of a scan; every text of a path row is one line."""
    return reports.csv_summary(plans.scan(B.path_files(spark, sf)).summary)


@query(_REPORT + """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
           WHEN 'LOW' THEN 3 ELSE 4 END, category, path, id) - 1 AS step FROM whole),
types AS (
  SELECT repo_id, extension, count(*) AS files, row_number() OVER (PARTITION BY repo_id ORDER BY extension) - 1 AS step
  FROM code GROUP BY repo_id, extension),
members AS (
  SELECT s.repo_id, c.first_path, s.path, row_number() OVER (PARTITION BY s.repo_id ORDER BY c.first_path, s.path) - 1 AS step
  FROM path_scanned s JOIN copies c ON s.repo_id = c.repo_id AND list_contains(string_split(c.path, ':'), s.path)),
failures AS (
  SELECT repo_id, path, error, row_number() OVER (PARTITION BY repo_id ORDER BY path, error) - 1 AS step
  FROM path_files WHERE kind = 'dir' AND error IS NOT NULL),
largest AS (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS position FROM code),
parts AS (
  SELECT repo_id, 0 AS part FROM path_repos UNION SELECT repo_id, step // 3 FROM ordered UNION SELECT repo_id, step // 3 FROM types
  UNION SELECT repo_id, step // 3 FROM members UNION SELECT repo_id, step // 3 FROM failures)
SELECT p.repo_id, p.part::INT AS part, CASE WHEN p.part = 0 THEN files_scanned END AS files_scanned,
       CASE WHEN p.part = 0 THEN source_files END AS total_lines, CASE WHEN p.part = 0 THEN doc_score END AS doc_score,
       CASE WHEN p.part = 0 THEN (SELECT string_agg(path, ',' ORDER BY position) FROM largest l WHERE l.repo_id = p.repo_id AND position <= 10) END AS largest,
       coalesce((SELECT string_agg(id, ',' ORDER BY step) FROM ordered t WHERE t.repo_id = p.repo_id AND t.step // 3 = p.part), '') AS ids,
       coalesce((SELECT string_agg(extension || ':' || files, ',' ORDER BY step) FROM types t WHERE t.repo_id = p.repo_id AND t.step // 3 = p.part), '') AS types,
       coalesce((SELECT string_agg(first_path || '>' || path, ',' ORDER BY step) FROM members t WHERE t.repo_id = p.repo_id AND t.step // 3 = p.part), '') AS copies,
       coalesce((SELECT string_agg(path || ': ' || error, ',' ORDER BY step) FROM failures t WHERE t.repo_id = p.repo_id AND t.step // 3 = p.part), '') AS errors
FROM parts p JOIN counted c ON c.repo_id = p.repo_id JOIN scores s ON s.repo_id = p.repo_id""")
def scan_documents(spark, sf):
    """The documents of a scan's report, written by batches, taken up again, and read back."""
    report = plans.scan(B.path_files(spark, sf)).report(part_rows=3)
    folder = ReportFolder(spark, new_folder(spark, "documents"), batches=4)
    folder.write(report)
    folder.write(report)
    told = folder.read(report.schema)
    head = F.col("part") == 0

    def joined(column, entry):
        return F.coalesce(F.array_join(F.transform(column, entry), ","), F.lit(""))

    return told.select(
        "repo_id", "part", "summary.files_scanned", "code.total_lines",
        F.when(head, F.regexp_extract(F.array_join("scores.reasons.documentation", ";"), "README score: ([0-9]+)", 1).cast("int")).alias("doc_score"),
        F.when(head, F.array_join(F.transform("largest_files", lambda f: f["path"]), ",")).alias("largest"),
        joined("findings", lambda f: f["id"]).alias("ids"),
        joined("extension_distribution", lambda e: F.concat_ws(":", e["extension"], e["files"])).alias("types"),
        joined("duplicate_groups", lambda d: F.concat_ws(">", d["first"], d["path"])).alias("copies"),
        F.coalesce(F.array_join("errors", ","), F.lit("")).alias("errors"),
    )


@query(with_ctes("code_files") + """, sizes AS (SELECT count(*) AS n, count(DISTINCT (text, extension)) AS texts FROM code_files)
SELECT 'originals' AS run, n AS files, texts AS examined FROM sizes
UNION ALL SELECT 'with copies', 2 * n, 0 FROM sizes
UNION ALL SELECT 'other options', 2 * n, texts FROM sizes""")
def feature_reuse(spark, sf):
    """Contents that scans of code files, then of these and their vendored copies, have to examine."""
    originals, store = B.code_files(spark, sf), _new_store(spark)
    copies = originals.withColumn("repo_id", F.concat(F.lit("fork/"), "repo_id"))
    both, other = originals.unionByName(copies), replace(plans.ScanOptions(), min_stars=0)
    rows = []
    for run, files, options in (
        ("originals", originals, plans.ScanOptions()), ("with copies", both, plans.ScanOptions()), ("other options", both, other)
    ):
        name = plans.options_key(options)
        before = store.size(name)
        with shuffles_dropped(spark):
            scanned = plans.features_of(files, options, store).count()
        rows.append((run, scanned, store.size(name) - before))
    return spark.createDataFrame(rows, "run string, files long, examined long")


@query(_SCANNED_PATHS + f""", rated AS (
  SELECT r.repo_id, {_lost('Security')} AS security, {_lost('Dependencies')} AS dependencies,
         {_lost('Code Health')} AS code_health, least({_lost('Documentation')}, doc_score)::INT AS documentation,
         {_lost('Hygiene')} AS hygiene
  FROM path_repos r JOIN scores s ON r.repo_id = s.repo_id)
SELECT repo_id, round_even(security * 0.30::DECIMAL(9,6) + code_health * 0.25::DECIMAL(9,6) + documentation * 0.15::DECIMAL(9,6)
         + dependencies * 0.15::DECIMAL(9,6) + hygiene * 0.15::DECIMAL(9,6), 0)::INT AS overall,
       security, dependencies, code_health, documentation, hygiene FROM rated""")
def scan_scores(spark, sf):
    return plans.scan(B.path_files(spark, sf)).scores


_COMPACT_PATHS = with_ctes("path_files", "path_repos") + f""", seen AS (
  SELECT * FROM path_files WHERE kind = 'file' AND NOT unreadable AND NOT list_has_any(string_split(path, '/')[:-2],
    ['.git','node_modules','__pycache__','.venv','venv','dist','build','target','coverage','.next','.pytest_cache','vendor'])),
facts AS (
  SELECT repo_id, {_at('README.md', 'README.rst', 'README.txt', 'README')} AS readme, {_at('LICENSE', 'LICENSE.md')} AS license,
         {_at('.gitignore')} AS gitignore,
         bool_or(path LIKE 'tests/%' OR path LIKE 'test/%' OR path IN ('tests', 'test') AND kind = 'dir')
           OR repo_id IN (SELECT repo_id FROM seen WHERE lower(path) LIKE '%test%') AS tests
  FROM path_files GROUP BY repo_id),
whole AS (
SELECT repo_id, 'HYG-001' AS id, 'MEDIUM' AS severity, '' AS path, 'Hygiene' AS category FROM facts WHERE NOT readme
UNION ALL SELECT repo_id, 'HYG-002', 'LOW', '', 'Hygiene' FROM facts WHERE NOT license
UNION ALL SELECT repo_id, 'HYG-003', 'LOW', '', 'Hygiene' FROM facts WHERE NOT gitignore
UNION ALL SELECT repo_id, 'HYG-005', 'MEDIUM', '', 'Hygiene' FROM facts WHERE NOT tests
UNION ALL SELECT repo_id, {_hashed_id('SEC-ENV-')}, 'MEDIUM', path, 'Security' FROM seen WHERE lower(name) LIKE '.env%'
UNION ALL SELECT repo_id, {_hashed_id('CODE-SYNTAX-')}, 'MEDIUM', path, 'Code Health' FROM seen WHERE extension = '.py')
"""


@query(_COMPACT_PATHS + "SELECT * FROM whole")
def compact_findings(spark, sf):
    found = plans.scan_compact(B.path_files(spark, sf)).findings
    return found.select("repo_id", "id", "severity", "path", "category")


@query(_COMPACT_PATHS + f""", rated AS (
  SELECT repo_id, {_lost('Security')} AS security, {_lost('Code Health')} AS code_health, {_lost('Hygiene')} AS hygiene
  FROM path_repos r)
SELECT repo_id, round_even(security * 0.4::DECIMAL(9,6) + code_health * 0.3::DECIMAL(9,6) + hygiene * 0.3::DECIMAL(9,6), 0)::INT AS overall,
       security, code_health, hygiene FROM rated""")
def compact_scores(spark, sf):
    return plans.scan_compact(B.path_files(spark, sf)).scores


@query(_SCANNED_PATHS + "SELECT repo_id, count(*) AS rows_a, count(*) AS rows_b, true AS repeatable FROM whole GROUP BY repo_id")
def repeated_scan(spark, sf):
    """Two scans under different schedules, and how many findings each has."""
    verdict = plans.verify_repeatable(B.path_files(spark, sf), reorder=True)
    return verdict.select("repo_id", "rows_a", "rows_b", "repeatable")
