"""Dependencies declared in root manifests.

A manifest is one row, so each parser is a column expression that yields the
declared entries as an array of (scope, name, operator, version); summaries
are array expressions on the same row. Nothing is shuffled except the tiny
lockfile facts per repository.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import basename, decode_text, evaluated_once, py_strip, strip_version_spec, unify_newlines
from corpaudit.operators.files import only_files
from corpaudit.operators.findings import explode_reports, report_if

_ENTRIES = "array<struct<scope:string,name:string,operator:string,version:string>>"
# Whitespace within a line. The patterns below start at a line and stay on it.
_SPACE = r"[\s\x1c-\x1f&&[^\n]]"
# What a requirement line and the development sections look like.
# name, extras, operator, version
_REQUIREMENT = (
    rf"(?dmU)^{_SPACE}*([A-Za-z0-9][A-Za-z0-9._-]*){_SPACE}*(\[[^\]\n]*\])?"
    rf"{_SPACE}*(==|>=|<=|~=|!=|>|<)?{_SPACE}*([^\s#;]*)"
)
_KEY = rf'(?dmU)^{_SPACE}*"?([A-Za-z0-9._-]+)"?{_SPACE}*='
_DEV_SECTIONS = (
    "[project.optional-dependencies.dev]",
    "[tool.poetry.dev-dependencies]",
    "[tool.poetry.group.dev.dependencies]",
)


def _entry(scope, name, operator="", version="") -> Column:
    columns = [c if isinstance(c, Column) else F.lit(c) for c in (scope, name, operator, version)]
    names = ("scope", "name", "operator", "version")
    return F.struct(*[c.alias(n) for c, n in zip(columns, names)])


def _none() -> Column:
    return F.array().cast(_ENTRIES)


def _keys(block: Column, scope: str) -> Column:
    """Keys of "key = value" lines."""
    names = evaluated_once(block, lambda b: F.regexp_extract_all(unify_newlines(b), F.lit(_KEY), 1))
    return F.transform(names, lambda n: _entry(scope, n))


def parse_requirements(text: Column) -> Column:
    def zipped(unified: Column) -> Column:
        parts = {
            part: F.regexp_extract_all(unified, F.lit(_REQUIREMENT), group).alias(part)
            for part, group in (("name", 1), ("operator", 3), ("version", 4))
        }
        return F.arrays_zip(*parts.values())

    rows = evaluated_once(unify_newlines(text), zipped)
    return F.transform(rows, lambda r: _entry("runtime", r["name"], r["operator"], r["version"]))


def parse_pyproject(text: Column) -> Column:
    """The first dependencies array, up to its first "]", and three dev tables."""
    # [^\]]* runs to the first closing bracket; without one nothing matches
    array = F.regexp_extract(text, r"(?dmU)^\s*dependencies\s*=\s*\[([^\]]*)\]", 1)
    items = F.regexp_extract_all(array, F.lit('"([^"]+)"'), 1)
    runtime = F.transform(
        items,
        lambda i: _entry(
            "runtime", strip_version_spec(i), F.when(F.contains(i, F.lit("==")), "==").otherwise("")
        ),
    )
    return F.concat(runtime, *[_keys(_section(text, s), "dev") for s in _DEV_SECTIONS])


def _section(text: Column, header: str, *, at_line: bool = False) -> Column:
    """Text after the first header up to the next line that starts with "[".

    Whole lines are taken without a way back, so that the time grows with the section alone.
    """
    start = "^" if at_line else ""
    section = rf"(?dm){start}\Q{header}\E([^\n]*(?:\n(?!\[)[^\n]*)*+\n?)"
    return F.when(~F.contains(text, F.lit(header)), "").otherwise(F.regexp_extract(text, section, 1))


def parse_package_json(text: Column) -> Column:
    """Keys and versions of both sections; null unless the text is one JSON value.

    Read as the only element of an array, so that anything after it is an error.
    """
    shape = "array<struct<dependencies:map<string,string>,devDependencies:map<string,string>>>"
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), shape, {"allowSingleQuotes": "false"}
    )

    def declared(section: Column, scope: str) -> Column:
        def once(entries: Column) -> Column:
            # a repeated key keeps its first place and its last value
            keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
            last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
            return F.when(F.size(keys) == F.size(entries), entries).otherwise(last)

        kept = evaluated_once(F.map_entries(section), once)
        rows = F.transform(kept, lambda e: _entry(scope, e["key"], "", e["value"]))
        return F.coalesce(rows.cast(_ENTRIES), _none())

    def entries(document: Column) -> Column:
        return F.concat(
            declared(document["dependencies"], "runtime"), declared(document["devDependencies"], "dev")
        )

    return evaluated_once(
        listed, lambda l: F.when(F.size(l) == 1, F.flatten(F.transform(l, entries)).cast(_ENTRIES))
    )


def parse_cargo(text: Column) -> Column:
    return F.concat(
        _keys(_section(text, "[dependencies]", at_line=True), "runtime"),
        _keys(_section(text, "[dev-dependencies]", at_line=True), "dev"),
    )


def parse_go_mod(text: Column) -> Column:
    """Modules of require blocks and of single require lines, in file order.

    A block closes at a line that is just ")", else it runs to the end.
    """
    block = rf"^{_SPACE}*require \((?s:.*?)(?:^{_SPACE}*\){_SPACE}*$|\z)"
    single = rf"^{_SPACE}*require [^\n]*"
    pieces = F.regexp_extract_all(unify_newlines(text), F.lit(f"(?dmU){block}|{single}"), 0)
    in_block = rf"(?dmU)^{_SPACE}*(?!require \()(?!\){_SPACE}*$)(\S+)"
    alone = r"(?U)\A\s*require \s*(\S+)"

    def modules(piece: Column) -> Column:
        is_block = piece.rlike(r"(?U)\A\s*require \(")
        name = F.regexp_extract(piece, alone, 1)
        return F.when(is_block, F.regexp_extract_all(piece, F.lit(in_block), 1)).otherwise(
            F.filter(F.array(name), lambda n: n != "")
        )

    return F.transform(F.flatten(F.transform(pieces, modules)), lambda n: _entry("runtime", n))


def parse_pom(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)

    def named(block: Column) -> Column:
        group = r"<groupId>([^\n]*?)</groupId>"
        artifact = r"<artifactId>([^\n]*?)</artifactId>"
        name = F.concat(
            py_strip(F.regexp_extract(block, group, 1)), F.lit(":"),
            py_strip(F.regexp_extract(block, artifact, 1)),
        )
        return F.when(block.rlike(group) & block.rlike(artifact), name)

    return F.transform(F.array_compact(F.transform(blocks, named)), lambda n: _entry("runtime", n))


PARSERS = {
    "requirements.txt": parse_requirements,
    "pyproject.toml": parse_pyproject,
    "package.json": parse_package_json,
    "Cargo.toml": parse_cargo,
    "go.mod": parse_go_mod,
    "pom.xml": parse_pom,
}


def manifests(files: DataFrame, *, root_only: bool = True) -> DataFrame:
    """Manifest rows with their entries. Takes all files, unfiltered.

    A manifest counts whatever its size or folder flags say; root_only=False
    also takes manifests below the root, named by their path.
    """
    name = basename(F.col("path"))
    known = F.col("path").isin(*PARSERS) if root_only else name.isin(*PARSERS)
    broken = F.coalesce(F.col("error") == K.BROKEN_SYMLINK, F.lit(False))
    rows = only_files(files).filter(known & ~broken)
    texts = rows.select("repo_id", "path", decode_text(F.col("content")).alias("text"))
    return parse_manifests(texts)


def manifest_facts(name: Column, text: Column) -> dict[str, Column]:
    """ecosystem, entries (null if unparsable) of a manifest by name and text."""
    entries = F.when(F.lit(False), _none())
    ecosystem = F.when(F.lit(False), F.lit(""))
    for manifest, parse in PARSERS.items():
        entries = entries.when(name == manifest, parse(text).cast(_ENTRIES))
        ecosystem = ecosystem.when(name == manifest, F.lit(K.MANIFESTS[manifest][0]))
    return {"ecosystem": ecosystem, "entries": entries}


def parse_manifests(texts: DataFrame) -> DataFrame:
    """(repo_id, path, text) of manifests to (…, entries); null when unparsable."""
    name = basename(F.col("path"))
    unread_pyproject = (name == "pyproject.toml") & F.col("text").isNull()
    facts = manifest_facts(name, F.col("text"))
    return texts.filter(~unread_pyproject).select(
        "repo_id",
        facts["ecosystem"].alias("ecosystem"),
        F.col("path").alias("manifest_file"),
        facts["entries"].alias("entries"),
    )


def dependencies(parsed: DataFrame) -> DataFrame:
    """One row per declared dependency."""
    # outer, as otherwise a size filter would parse every manifest a second time
    rows = parsed.select(
        "repo_id", "ecosystem", "manifest_file", F.posexplode_outer("entries").alias("pos", "entry")
    )
    return rows.filter(F.col("pos").isNotNull()).select(
        "repo_id",
        "ecosystem",
        "manifest_file",
        F.col("entry.scope").alias("scope"),
        (F.col("pos") + 1).alias("ordinal"),
        F.col("entry.name").alias("name"),
        F.col("entry.operator").alias("operator"),
        F.col("entry.version").alias("version"),
    )


def _names(scope: str) -> Column:
    kept = F.filter("entries", lambda e: e["scope"] == scope)
    return F.transform(kept, lambda e: e["name"])


def _pinned(name: Column) -> Column:
    entries = F.col("entries")

    def of_runtime(test) -> Column:
        return evaluated_once(F.filter(entries, lambda e: e["scope"] == "runtime"), test)

    def exact(runtime: Column) -> Column:
        return (F.size(runtime) > 0) & F.forall(runtime, lambda e: e["operator"] == "==")

    def fixed(merged: Column) -> Column:
        return (F.size(merged) > 0) & F.forall(
            merged, lambda e: ~F.coalesce(e["version"].rlike(r"\A[\^~><*]"), F.lit(False))
        )

    # a name in both sections counts with its dev version
    merged = evaluated_once(
        _names("dev"),
        lambda dev: F.filter(entries, lambda e: (e["scope"] == "dev") | ~F.array_contains(dev, e["name"])),
    )
    return (
        F.when(name == "requirements.txt", of_runtime(lambda r: exact(r) & F.forall(r, lambda e: e["version"] != "")))
        .when(name == "pyproject.toml", of_runtime(exact))
        .when(name == "package.json", evaluated_once(merged, fixed))
        .when(name == "go.mod", F.lit(True))
        .otherwise(F.lit(False))
    )


def repeated_names(entries: Column) -> Column:
    """Names declared before in the same array, ignoring case, one per repeat."""
    keyed = F.array_sort(
        F.transform(
            entries,
            lambda e, i: F.struct(F.lower(e["name"]).alias("key"), i.alias("at"), e["name"].alias("name")),
        )
    )
    # neighbours in key order; the pair before each item decides
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.transform(keyed, lambda k: k["key"]))
    pairs = F.arrays_zip(keyed.alias("item"), shifted.alias("previous"))
    repeats = F.filter(pairs, lambda p: p["item"]["key"] == p["previous"])
    in_order = F.array_sort(
        F.transform(repeats, lambda p: F.struct(p["item"]["at"].alias("at"), p["item"]["name"].alias("name")))
    )
    return F.transform(in_order, lambda p: p["name"])


def lockfiles(files: DataFrame) -> DataFrame:
    """Lockfile names present per repository and directory. Reads paths only."""
    names = sorted({lock for _, locks in K.MANIFESTS.values() for lock in locks})
    name = basename(F.col("path"))
    broken = F.coalesce(F.col("error") == K.BROKEN_SYMLINK, F.lit(False))
    present = files.filter(name.isin(*names) & ~broken)
    return present.groupBy("repo_id", _directory(F.col("path")).alias("directory")).agg(
        F.collect_set(name).alias("locks")
    )


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def manifest_summary(parsed: DataFrame, locks: DataFrame) -> DataFrame:
    """One row per manifest: names, repeats, pinning, lockfile."""
    name = basename(F.col("manifest_file"))
    locked = [
        (name == manifest) & F.arrays_overlap("locks", F.array(*[F.lit(n) for n in accepted]))
        for manifest, (_, accepted) in K.MANIFESTS.items()
        if accepted
    ]
    repeats = F.when(name == "requirements.txt", repeated_names(F.col("entries")))
    own = parsed.select(
        "repo_id", "ecosystem", "manifest_file",
        _directory(F.col("manifest_file")).alias("directory"),
        F.coalesce("entries", _none()).alias("entries"),
        F.col("entries").isNull().alias("unparsed"),
    )
    # the join moves names, not entries
    facts = own.select(
        "repo_id", "ecosystem", "manifest_file", "directory", "unparsed",
        _names("runtime").alias("runtime"),
        _names("dev").alias("dev"),
        (_pinned(name) & ~F.col("unparsed")).alias("pinned"),
        F.coalesce(repeats, F.array().cast("array<string>")).alias("duplicates"),
    )
    present = F.coalesce(reduce(or_, locked), F.lit(False)) & ~F.col("unparsed")
    return facts.join(locks, ["repo_id", "directory"], "left").select(
        "repo_id", "ecosystem", "manifest_file", "runtime", "dev", "pinned", present.alias("lockfile_present"), "duplicates"
    )


def _unlocked() -> Column:
    return ~F.col("lockfile_present") & F.col("ecosystem").isin(*K.LOCKED_ECOSYSTEMS)


def missing_lockfiles(summary: DataFrame) -> DataFrame:
    return summary.filter(_unlocked())


def dependency_findings(summary: DataFrame) -> DataFrame:
    """Large lists, repeats and missing lockfiles, in one pass over the manifests."""
    count, path = F.size("runtime"), F.col("manifest_file")

    def named(rule: str) -> Column:
        return F.concat(F.lit(f"{rule}-"), F.col("ecosystem"))

    reports = [
        report_if(
            count > K.MANY_DEPENDENCIES, id=named("DEP-LARGE"), severity="LOW",
            title="Very long dependency list", path=path,
            explanation=F.concat(count.cast("string"), F.lit(" runtime dependencies are declared.")),
            recommendation="Check which of them are still used.",
        ),
        report_if(
            F.size("duplicates") > 0, id=named("DEP-DUP"), severity="LOW",
            title="Dependency declared twice", path=path,
            explanation=F.concat(F.lit("Declared again: "), F.array_join("duplicates", ", ")),
            recommendation="Keep one declaration of each.",
        ),
        report_if(
            _unlocked(), id=named("DEP-NOLOCK"), severity="INFO", title="No lockfile", path=path,
            explanation="Without a lockfile the resolved versions can change.",
            recommendation="Commit the lockfile of the package manager.",
        ),
    ]
    return explode_reports(summary, reports, "Dependencies")
