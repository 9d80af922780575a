"""Sources, file filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit import functions as X
from corpaudit.operators import files as ops
from corpaudit.operators.code import lines, with_text
from corpaudit.operators.findings import error_limit
from corpaudit.sources import file_records as records
from corpaudit.sources import read_errors, read_repo_dirs, size_gate_drop
from corpaudit.sources import read_files as read_packed
from corpaudit.sources import write_files
from corpaudit.storage import new_folder
from registry import bindings as B
from registry.bindings import with_ctes
from registry.catalog import query


@query(with_ctes("doc_files") + """
SELECT repo_id, path, extension, size, false AS is_binary, is_source FROM doc_files""")
def file_records(spark, sf):
    return B.doc_files(spark, sf).select("repo_id", "path", "extension", "size", "is_binary", "is_source")


@query(with_ctes("doc_files") + """
SELECT repo_id, path, 'file' AS kind, size, extension, is_source, sha256(text) AS digest FROM doc_files
UNION ALL SELECT DISTINCT repo_id, unnest(['docs', string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]), 'dir', 0, '', false, NULL
FROM doc_files""")
def repo_dirs(spark, sf):
    """The documents as trees of files, listed level by level and read again."""
    folder = new_folder(spark, "trees").removeprefix("file:")
    roots = B.written_tree(B.doc_files(spark, sf), folder)
    found = records(read_repo_dirs(spark, roots)).withColumn("digest", F.sha2("content", 256))
    return found.select("repo_id", "path", "kind", "size", "extension", "is_source", "digest")


@query(with_ctes("doc_files") + """
SELECT repo_id, path, extension, size, false AS is_binary, is_source, sha256(text) AS digest FROM doc_files
WHERE repo_id IN (SELECT DISTINCT 'src' || (p_partkey % 3) FROM part)""")
def read_files(spark, sf):
    """Some repositories of a packed corpus, named by a table."""
    path = new_folder(spark, "packed")
    write_files(B.doc_files(spark, sf), path, file_bytes=1 << 20, group_bytes=1 << 18)
    repos = B.table(spark, sf, "part").select(F.expr("'src' || (p_partkey % 3)").alias("repo_id"))
    some = read_packed(spark, path, repos).withColumn("digest", F.sha2("content", 256))
    return some.select("repo_id", "path", "extension", "size", "is_binary", "is_source", "digest")


@query(with_ctes("doc_files") + """
SELECT repo_id, path, doc_id % 9 = 0 AND size < 8192 AS is_binary,
       is_source AND NOT (doc_id % 9 = 0 AND size < 8192) AS is_source
FROM doc_files""")
def classify_binary(spark, sf):
    return B.damaged_files(spark, sf).select("repo_id", "path", "is_binary", "is_source")


@query(with_ctes("doc_files") + """
SELECT repo_id, path,
       sha256(CASE WHEN doc_id % 9 = 0 THEN text || chr(0)
                   WHEN doc_id % 7 = 0 THEN text || chr(65533) ELSE text END) AS text_hash
FROM doc_files""")
def decode_text(spark, sf):
    text = X.decode_text(F.col("content"))
    return B.damaged_files(spark, sf).select(
        "repo_id", "path", F.sha2(text.cast("binary"), 256).alias("text_hash")
    )


@query(with_ctes("web_files") + """
SELECT repo_id, path, extension, size, sha256(text) AS content_hash FROM web_files""")
def web_records(spark, sf):
    return B.web_files(spark, sf).select(
        "repo_id", "path", "extension", "size", X.content_sha256(F.col("content")).alias("content_hash")
    )


@query(with_ctes("path_files", "path_scanned") + "SELECT repo_id, path, size FROM path_scanned")
def drop_ignored_dirs(spark, sf):
    return ops.drop_ignored_dirs(ops.only_files(B.path_files(spark, sf))).select("repo_id", "path", "size")


@query(with_ctes("path_files") + """
SELECT repo_id, path FROM path_files
WHERE len(list_filter(string_split(path, '/'), lambda p: p LIKE '.%')) = 0""")
def drop_hidden(spark, sf):
    return ops.drop_hidden(B.path_files(spark, sf)).select("repo_id", "path")


@query(with_ctes("path_files") + """
SELECT repo_id, path, true AS secret, is_source OR extension IN ('.md', '.txt', '.rst') AS code
FROM path_files WHERE kind = 'file' AND NOT unreadable AND name <> 'big.bin'""")
def secret_and_code_candidates(spark, sf):
    return ops.secret_candidates(B.path_files(spark, sf)).select(
        "repo_id", "path", F.lit(True).alias("secret"), ops.is_code_candidate().alias("code")
    )


@query(with_ctes("path_files") + """
SELECT repo_id, path, size FROM path_files WHERE kind = 'file' AND NOT unreadable AND name <> 'big.bin' AND size BETWEEN 1 AND 5000000""")
def duplicate_candidates(spark, sf):
    return ops.duplicate_candidates(B.path_files(spark, sf), max_bytes=5_000_000).select("repo_id", "path", "size")


@query(with_ctes("path_files") + """
SELECT repo_id, path, size FROM path_files WHERE NOT unreadable AND size <= 4 * 1024 * 1024""")
def size_gate(spark, sf):
    return size_gate_drop(B.path_files(spark, sf), max_file_size_mb=4).select("repo_id", "path", "size")


@query(with_ctes("path_files") + """
SELECT repo_id, path, error FROM path_files WHERE kind = 'dir' AND error IS NOT NULL""")
def scan_errors(spark, sf):
    return read_errors(B.path_files(spark, sf))


@query(with_ctes("path_files") + """
SELECT * FROM (
  SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path, error) AS position, path, error
  FROM path_files WHERE kind = 'dir' AND error IS NOT NULL)
WHERE position <= 10""")
def first_errors(spark, sf):
    return error_limit(read_errors(B.path_files(spark, sf)))


@query(with_ctes("python_files") + "SELECT repo_id, path FROM python_files WHERE path NOT LIKE 'examples/%'")
def python_audit_files(spark, sf):
    return ops.python_audit_files(B.python_files(spark, sf)).select("repo_id", "path")


@query(with_ctes("path_files") + """
SELECT repo_id, path, name AS basename, coalesce(extension, '') AS suffix,
       substr(path, 1, length(path) - length(name)) AS folder FROM path_files""")
def path_parts(spark, sf):
    path = F.col("path")
    name = X.basename(path)
    whole = F.concat(F.lit("/corpus/"), path)
    folder = F.substr(X.relative_path(whole, F.lit("/corpus")), F.lit(1), F.length(path) - F.length(name))
    return B.path_files(spark, sf).select(
        "repo_id", "path", name.alias("basename"), X.suffix(path).alias("suffix"), folder.alias("folder")
    )


@query(with_ctes("doc_files") + """
SELECT path, sha256(text) AS full_hash, CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 1000 AS short_hash
FROM doc_files""")
def content_hash(spark, sf):
    return B.doc_files(spark, sf).select(
        "path",
        X.content_sha256(F.col("content")).alias("full_hash"),
        X.stable_hash_int(F.col("path")).alias("short_hash"),
    )


@query("""
SELECT doc_id, round(coalesce(sum(-(n / total) * log2(n / total)), 0.0), 6) AS entropy
FROM (SELECT doc_id, c, count(*)::DOUBLE AS n, any_value(total)::DOUBLE AS total
      FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, length(text) AS total FROM documents)
      GROUP BY doc_id, c)
GROUP BY doc_id""")
def entropy(spark, sf):
    bits = X.shannon_entropy(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", F.round(bits, 6).alias("entropy"))


@query("""
SELECT p_partkey,
       CASE WHEN length(p_name) <= 4 THEN repeat('*', length(p_name))
            ELSE left(p_name, 4) || repeat('*', least(16, greatest(4, length(p_name) - 4))::INT) END AS redacted,
       CASE WHEN length(p_name) <= 4 THEN repeat('*', length(p_name))
            ELSE left(p_name, 4) || repeat('*', least(16, length(p_name) - 4)::INT) END AS redacted_compact,
       length(p_brand) < 8 AS placeholder
FROM part""")
def redact(spark, sf):
    name = F.col("p_name")
    return B.table(spark, sf, "part").select(
        "p_partkey",
        X.redact(name).alias("redacted"),
        X.redact(name, min_stars=0).alias("redacted_compact"),
        X.is_placeholder(F.concat(F.lit(" '"), F.col("p_brand"), F.lit("' "))).alias("placeholder"),
    )


@query("""
SELECT o_orderkey,
       CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1024 ** 2 THEN format('{:.1f}KB', b / 1024.0::DOUBLE)
            WHEN b < 1024 ** 3 THEN format('{:.1f}MB', b / (1024.0 ** 2)::DOUBLE)
            ELSE format('{:.1f}GB', b / (1024.0 ** 3)::DOUBLE) END AS shown
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * (o_custkey % 20) AS b FROM orders)""")
def human_size(spark, sf):
    size = F.expr("o_orderkey * o_orderkey * (o_custkey % 20)")
    return B.table(spark, sf, "orders").select("o_orderkey", X.human_size(size).alias("shown"))


@query("""
SELECT p_partkey, CASE WHEN p_size * 2 >= 80 THEN 'good' WHEN p_size * 2 >= 60 THEN 'fair' ELSE 'poor' END AS band,
       CASE WHEN p_size % 3 <> 0 THEN p_name || ':' || (p_size % 3) WHEN p_size % 2 = 0 THEN p_name
            ELSE 'Repository-wide' END AS location,
       CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rank
FROM part""")
def bands_and_locations(spark, sf):
    path = F.expr("if(p_size % 3 <> 0 or p_size % 2 = 0, p_name, '')")
    severity = F.expr("array('CRITICAL','HIGH','MEDIUM','LOW','INFO')[p_size % 5]")
    return B.table(spark, sf, "part").select(
        "p_partkey",
        X.score_band(F.col("p_size") * 2).alias("band"),
        X.location(path, F.expr("p_size % 3")).alias("location"),
        X.severity_rank(severity).alias("rank"),
    )


@query("""
SELECT p_partkey, regexp_extract(p_type || ['>=1', ' ~=2', '[x]', '!3', ''][p_size % 5 + 1], '^([^<>=!~\\[\\s]*)', 1) AS name
FROM part""")
def version_specs(spark, sf):
    text = F.concat(F.col("p_type"), F.expr("array('>=1', ' ~=2', '[x]', '!3', '')[p_size % 5]"))
    return B.table(spark, sf, "part").select("p_partkey", X.strip_version_spec(text).alias("name"))


@query(with_ctes("doc_files", "doc_lines") + "SELECT repo_id, path, line_no, line FROM doc_lines")
def text_lines(spark, sf):
    return lines(with_text(B.doc_files(spark, sf)))


@query(with_ctes("code_files", "code_lines") + """
SELECT repo_id, extension, count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank,
       count(*) FILTER (ltrim(line) LIKE '#%' AND extension IN ('.py', '.rb', '.php')
                        OR ltrim(line) LIKE '//%' AND extension IN ('.js', '.php')
                        OR ltrim(line) LIKE '--%' AND extension = '.sql') AS comments,
       count(*) FILTER (contains(upper(line), 'FIXME')) AS fixme
FROM code_lines GROUP BY ALL""")
def line_flags(spark, sf):
    files = B.code_files(spark, sf)
    flagged = lines(with_text(files)).withColumn("extension", X.suffix(F.col("path")))
    line = F.col("line")
    return flagged.groupBy("repo_id", "extension").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(X.py_strip(line) == "").alias("blank"),
        F.count_if(X.is_comment_line(line, F.col("extension"))).alias("comments"),
        F.count_if(X.has_marker(line, "FIXME")).alias("fixme"),
    )
