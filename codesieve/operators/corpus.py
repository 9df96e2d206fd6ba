"""Crates of a project, and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_lines


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def resolved(base: Column, relative: Column) -> Column:
    """The directory that a path written in a manifest names: `.` and `a/..` are folded, an absolute path stands alone."""
    parts = F.filter(F.split(F.when(relative.startswith("/"), relative).otherwise(F.concat(base, F.lit("/"), relative)), "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def glob_regex(pattern: Column) -> Column:
    """A directory pattern (*, **, ?, [..]) as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    stars = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    single = F.regexp_replace(F.regexp_replace(stars, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(single, "\u0001", "(?:.*/)?"), "\u0002", ".*"), F.lit("$"))


def roots(manifests: DataFrame) -> DataFrame:
    """The manifest that no other manifest's directory of the target lies above: the shortest."""
    return manifests.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy(F.length("dir"), "dir"))).filter("n = 1").drop("n")


def bad_targets(targets: DataFrame, manifests: DataFrame) -> DataFrame:
    """Targets without a readable root manifest. targets: target, root."""
    root = manifests.select("target", F.col("dir").alias("root"), "parse_ok")
    return targets.join(root.filter("parse_ok"), ["target", "root"], "left_anti").select("target", "root", F.lit("no readable root manifest").alias("problem"))


def resolve_crates(targets: DataFrame, manifests: DataFrame) -> DataFrame:
    """(target, name, root_dir, manifest_path) of each crate. targets: target, root (absolute).

    In a workspace: the root if it is a package, then members whose manifest can be read and that aren't excluded; a
    directory that two members name stands twice. Patterns match directories below the root."""
    root = targets.join(manifests.filter("parse_ok"), (targets["target"] == manifests["target"]) & (F.col("root") == F.col("dir"))).select(targets["target"], "root", "package_name", "is_workspace", "members", "exclude")
    member = root.filter("is_workspace").select("target", "root", "exclude", F.explode("members").alias("member"))
    is_glob = F.col("member").rlike(r"[*?\[]")
    plain = member.filter(~is_glob).select("target", "exclude", "root", resolved(F.col("root"), F.col("member")).alias("dir"))
    known = manifests.select("target", "dir")
    below = member.filter(is_glob).join(known, "target").filter(F.col("dir").startswith(F.concat("root", F.lit("/"))) & F.rlike(F.expr("substring(dir, length(root) + 2)"), glob_regex(F.regexp_replace("member", "^\\./|/$", "")))).select("target", "exclude", "root", "dir")
    excluded = F.exists(F.coalesce("exclude", F.expr("cast(array() as array<string>)")), lambda e: resolved(F.col("root"), e) == F.col("dir"))
    named = plain.unionByName(below).filter(~excluded).select("target", "dir").join(manifests.filter("parse_ok").select("target", "dir", "package_name"), ["target", "dir"])
    own = root.filter("not is_workspace or package_name is not null").select("target", F.col("root").alias("dir"), "package_name")
    return own.unionByName(named).select("target", F.coalesce("package_name", basename(F.col("dir"))).alias("name"), F.col("dir").alias("root_dir"), F.concat("dir", F.lit("/Cargo.toml")).alias("manifest_path"))


def project_info(targets: DataFrame, manifests: DataFrame) -> DataFrame:
    root = targets.join(manifests, (targets["target"] == manifests["target"]) & (F.col("root") == F.col("dir")))
    return root.select(targets["target"], F.coalesce("package_name", basename(F.col("root"))).alias("project_name"), "is_workspace")


def filter_crates(crates: DataFrame, names: list[str]) -> DataFrame:
    """The named crates; an error if there are none. Without names all."""
    if not names:
        return crates
    kept = crates.filter(F.col("name").isin(names))
    if kept.isEmpty():
        raise ValueError(f"no crate is named {', '.join(names)}")
    return kept


def attribute_files(files: DataFrame, crates: DataFrame) -> DataFrame:
    """files (target, path, ...) with crate, that of the innermost root above them; files in no crate go.

    Ancestor directories are rows, so this is an equi-join and not a comparison of all prefixes. Text doesn't take part
    in the shuffle of ancestors."""
    parts = F.split("path", "/")
    ancestors = files.select("target", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root_dir"))
    owner = ancestors.join(crates.select("target", "root_dir", "name"), ["target", "root_dir"]).groupBy("target", "path").agg(F.max_by("name", F.struct(F.length("root_dir"), "name")).alias("crate"))
    return files.drop("crate").join(owner, ["target", "path"])


def limit_files(files: DataFrame, crates: DataFrame, n: int) -> DataFrame:
    """The first n files of each target: of deeper crates first, then by path. 0 means all."""
    if not n:
        return files
    depth = crates.groupBy("target", F.col("name").alias("crate")).agg(F.max(F.length("root_dir")).alias("depth"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("depth"), "rel_path"))
    return files.join(depth, ["target", "crate"]).withColumn("place", place).filter(F.col("place") <= n).drop("place", "depth")


def corpus_stats(files: DataFrame, *by: str) -> DataFrame:
    """Files and lines per project, or per the columns named."""
    return files.groupBy(*(by or ("target",))).agg(F.count(F.lit(1)).alias("files"), F.sum(count_lines(F.col("content"))).alias("lines"))
