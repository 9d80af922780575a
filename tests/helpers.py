from corpaudit.schemas import RAW_FILES
from corpaudit.sources import file_records


def raw_rows(spark, files, repo="r"):
    """{path: text, bytes, or None for a directory} to raw rows."""
    rows = []
    for path, content in files.items():
        data = content.encode() if isinstance(content, str) else content
        kind = "dir" if data is None else "file"
        rows.append((repo, path, kind, len(data or b""), False, None, data))
    return spark.createDataFrame(rows, RAW_FILES)


def corpus(spark, files, repo="r", **options):
    return file_records(raw_rows(spark, files, repo), **options)


def repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names or ("r",)], "repo_id string")


def column(frame, name):
    return [r[name] for r in frame.select(name).collect()]
