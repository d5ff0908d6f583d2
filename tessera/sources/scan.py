"""Which files of a tree belong to an index: rules, precedence and reasons."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are ignored by default.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "dist", "build", "coverage", ".next", ".turbo", ".cache", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".parcel-cache", ".svelte-kit", ".nuxt", ".venv", "__pycache__", "vendor",
)
IGNORED_FILES = (".DS_Store", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
WATCH_IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules")
MOST_BYTES, SNIFFED = 1 << 20, 8000


def glob_regex(pattern: str) -> str:
    """** spans folders, * and ? stay within a name, all else is literal."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file; base is its folder."""

    pattern: str
    negated: bool = False
    directory_only: bool = False
    anchored: bool = False
    base: str = ""

    @classmethod
    def parse(cls, line: str, base: str = "") -> Rule | None:
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[negated:]
        directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = line.startswith("/")
        line = line.lstrip("/")
        return cls(line, negated, directory, anchored, base) if line else None

    def matches(self, path: Column, is_directory: bool = False) -> Column:
        relative = F.regexp_replace(path, f"^{re.escape(self.base)}/", "") if self.base else path
        inside = path.startswith(f"{self.base}/") if self.base else F.lit(True)
        regex = glob_regex(self.pattern)
        if "/" not in self.pattern and not self.anchored:
            # Any component of the path; a folder's rule holds for what lies in it too.
            return inside & relative.rlike(f"(?:^|/){regex}(?:/|$)")
        if self.directory_only:
            return inside & ((relative == self.pattern) | relative.startswith(f"{self.pattern}/"))
        return inside & relative.rlike(f"^{regex}$")


def last_match(path: Column, rules: list[Rule]) -> Column:
    """True if the last rule that matches ignores, False if it is a negation, null if none matches."""
    out = F.lit(None).cast("boolean")
    for r in rules:
        out = F.when(r.matches(path), F.lit(not r.negated)).otherwise(out)
    return out


def _overrides(globs: tuple[str, ...]) -> list[Rule]:
    """Globs that include or exclude; a negated one is refused."""
    if bad := [g for g in globs if g.strip().startswith("!")]:
        raise ValueError(f"an override can't be negated: {bad}")
    return [r for g in globs if (r := Rule.parse(g))]


def decide(files: DataFrame, ignore: list[Rule], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """files (path, size, binary) with ``reason``: one projection, in the order of precedence.

    An excluded folder is not entered, so a negation inside it can't bring a file back:
    every ancestor is tested against the rules.
    """
    path = F.col("path")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    pruned = (F.size(parts) > 1) & F.exists(prefixes, lambda p: F.coalesce(last_match(p, ignore), F.lit(False)))
    return files.withColumn("reason", _reason(last_match(path, ignore), pruned, include, exclude))


def _reason(ignored: Column, pruned: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """ignored: what the last rule that matches says, null without one; pruned: whether a folder above is ignored."""
    path, name, parts = F.col("path"), F.regexp_extract("path", "([^/]*)$", 1), F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    any_of = lambda globs: reduce(lambda a, b: a | b, (r.matches(path) for r in _overrides(globs)), F.lit(False))
    included = any_of(include)
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRS))), "default-ignore-dir")
        .when(name.isin(*IGNORED_FILES), "default-ignore-file")
        .when(name.startswith(".env"), "default-env-file")
        .when(pruned | F.coalesce(ignored, F.lit(False)), "gitignore")
        .when(any_of(exclude), "cli-exclude")
        .when(F.lit(bool(include)) & ~included, "cli-include-filter")
        .when(F.col("size") > MOST_BYTES, "too-large")
        .when(F.col("binary"), "binary")
        .when(included, "included-by-include")
        .when(ignored == False, "included-by-gitignore-negation")  # noqa: E712
        .otherwise("included")
    )


def load_rules(ignore_files: DataFrame) -> DataFrame:
    """Rules of ignore files (base, text), a row each: base, line, pattern, negated and regex, which tests a path relative to the base.

    base: the file's folder, "" at the top. Blank lines and comments say nothing.
    """
    lines = ignore_files.select("base", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", "^\\s+|\\s+$", ""))
    lines = lines.where("raw <> '' and not startswith(raw, '#')").withColumn("negated", F.col("raw").startswith("!"))
    rows = lines.withColumn("body", F.when(F.col("negated"), F.expr("substring(raw, 2)")).otherwise(F.col("raw")))
    rows = rows.withColumns({"folder": F.col("body").endswith("/"), "body": F.regexp_replace("body", "/+$", "")})
    rows = rows.withColumns({"anchored": F.col("body").startswith("/"), "body": F.regexp_replace("body", "^/+", "")}).where("body <> ''")
    escaped = F.regexp_replace("body", "([.\\\\+^$(){}|\\[\\]])", "\\\\$1")
    glob = F.replace(F.replace(F.replace(escaped, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    glob = F.replace(glob, F.lit("\x01"), F.lit(".*"))
    whole = F.when(~F.contains("body", F.lit("/")) & ~F.col("anchored"), F.concat(F.lit("(?:^|/)"), glob, F.lit("(?:/|$)"))).when(F.col("folder"), F.concat(F.lit("^\\Q"), "body", F.lit("\\E(?:/|$)"))).otherwise(F.concat(F.lit("^"), glob, F.lit("$")))
    return rows.select("base", "line", F.col("body").alias("pattern"), "negated", whole.alias("regex"))


def decide_nested(files: DataFrame, rules: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """files (path, size, binary) with ``reason`` and ``rule``, the pattern that spoke last, by rules of many ignore files.

    Each path meets the rules of the folders above it, in an equi-join on those folders; of the rules that
    match it, or a folder above it, the one of the deepest folder and the last line counts.
    """
    parts = F.split("path", "/")
    above = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    targets = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), above(n).alias("target")))).alias("t"))
    targets = targets.select("path", "t.target", F.explode(F.transform(F.sequence(F.lit(0), F.col("t.depth") - 1), lambda n: F.struct(n.alias("level"), F.when(n == 0, "").otherwise(above(n)).alias("base")))).alias("b"))
    met = targets.select("path", "target", "b.level", "b.base").join(rules, "base")
    relative = F.when(F.col("base") == "", F.col("target")).otherwise(F.expr("substring(target, length(base) + 2)"))
    met = met.where(F.rlike(relative, F.col("regex")))
    spoken = met.groupBy("path", "target").agg(F.max_by(F.struct("negated", "pattern"), F.struct("level", "line")).alias("r"))
    own = F.col("target") == F.col("path")
    verdict = spoken.groupBy("path").agg(F.max(F.when(own, ~F.col("r.negated"))).alias("__ignored"), F.coalesce(F.max(F.when(~own, ~F.col("r.negated"))), F.lit(False)).alias("__pruned"), F.max(F.when(own, F.col("r.pattern"))).alias("rule"))
    out = files.join(verdict, "path", "left").withColumn("reason", _reason(F.col("__ignored"), F.coalesce("__pruned", F.lit(False)), include, exclude))
    return out.drop("__ignored", "__pruned")


def diagnostics(decided: DataFrame) -> DataFrame:
    """(included, reason, n, bytes) of all decisions."""
    return decided.groupBy(F.col("reason").startswith("included").alias("included"), "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def included(decided: DataFrame) -> DataFrame:
    """The paths that belong to the index, for display in the order of a reader."""
    return decided.where(F.col("reason").startswith("included")).select("path").orderBy(F.expr("path collate UNICODE"), "path")


def looks_binary(content: Column) -> Column:
    return F.instr(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"), "\x00") > 0


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, content and binary of all files below a folder, read in parallel.

    Spark lists no file or folder whose name begins with "." or "_".
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", f"^(?:[a-z]+:/*)?(?=/){base}/|^.*?{base}/", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), "content", looks_binary(F.col("content")).alias("binary"))


def texts(files: DataFrame) -> DataFrame:
    """path, text and hash of files that are no binary ones (a null content gives a null text)."""
    text = F.decode("content", "UTF-8")
    return files.where("not binary").select("path", text.alias("text"), F.sha2(text, 256).alias("hash"))


def ignored_event(path: Column, index: str | None = None) -> Column:
    """Whether a watcher drops an event: within an ignored folder, or of the index itself."""
    own = F.lit(False) if index is None else (path == index) | path.startswith(f"{index}-")
    return (path != "") & (own | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, WATCH_IGNORED_DIRS))))
