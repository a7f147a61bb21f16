"""File sources: a recursive scan of a folder, safe text reading, languages, and a git log as text.

Extensions, languages and default ignore names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.redact import is_secret_file
from ..functions.text import extension, ignored

# Extensions that are not read, languages by extension, names that scans leave out.
SKIPPED = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "tiff", "svg", "pyc", "pyo", "class", "o", "so", "dylib", "dll", "exe",
    "wasm", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "jar", "war", "db", "sqlite", "sqlite3", "bin", "dat", "pkl",
    "pickle", "parquet", "arrow", "lance", "mp3", "mp4", "wav", "avi", "mov", "flv", "ogg", "webm", "ttf", "otf", "woff",
    "woff2", "eot", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "lock", "map",
]
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "tsx", "md": "markdown", "php": "php",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "less": "css", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "sh": "bash", "bash": "bash", "zsh": "bash", "rb": "ruby", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "sql": "sql",
    "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "xml": "xml", "r": "r", "R": "r", "lua": "lua", "ex": "elixir",
    "exs": "elixir", "erl": "erlang", "hs": "haskell", "scala": "scala", "clj": "clojure", "dart": "dart", "vue": "vue",
    "svelte": "svelte", "pl": "perl", "pm": "perl", "cs": "csharp", "fs": "fsharp", "zig": "zig", "nim": "nim", "v": "vlang",
    "tf": "terraform", "hcl": "hcl", "dockerfile": "dockerfile",
}
IGNORED_NAMES = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "bower_components", ".pnpm-store", ".pnpm", ".yarn", ".venv", "venv",
    "env", ".env", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", "Pods", "dist", "build", "_build",
    "out", "target", "bin", "obj", ".next", ".nuxt", ".output", ".vercel", ".turbo", ".parcel-cache", ".idea", ".vscode", ".vs",
    "coverage", ".coverage", "htmlcov", ".nyc_output", ".DS_Store", "__pycache__", ".sass-cache", ".gradle", ".terraform",
    ".vagrant", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "storage", "logs", "tmp",
    "temp",
]


def language(path: Column) -> Column:
    """By extension in its own case; plaintext for others."""
    pairs = [F.lit(x) for ext, name in LANGUAGES.items() for x in (f".{ext}", name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("plaintext"))


def wanted(path: Column, patterns=(), ignored_names=tuple(IGNORED_NAMES)) -> Column:
    """Whether a relative path is indexed: no part ignored, no skipped extension, no secret file, no pattern hit."""
    names = F.split(path, "/")
    skipped = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(SKIPPED)
    return ~F.arrays_overlap(names, F.array(*map(F.lit, ignored_names))) & ~skipped & ~is_secret_file(path) & ~ignored(path, patterns)


def readable(content: Column) -> Column:
    """Whether bytes are valid UTF-8 of the size that is indexed."""
    return (F.octet_length(content) <= SETTINGS.file_bytes) & F.is_valid_utf8(content.cast("string"))


def project_files(spark: SparkSession, root: str, patterns=(), target: str | None = None) -> DataFrame:
    """(file_path, content, language) of a folder's readable text files, or of a file or subtree in it."""
    base = root.rstrip("/")
    if target is not None and (target.startswith("/") or ".." in target.split("/")):
        raise ValueError("the target has to be inside the root")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    tail = base.split("://")[-1].removeprefix("file:").strip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?:[^/]*:[0-9]+/)?", ""), "^\\Q" + tail + "\\E/*", "")
    rows = raw.where(F.col("length") <= SETTINGS.file_bytes).withColumn("file_path", path).where(wanted(F.col("file_path"), patterns))
    if target:
        rows = rows.where((F.col("file_path") == target) | F.col("file_path").startswith(target.rstrip("/") + "/"))
    return rows.where(readable(F.col("content"))).select("file_path", F.col("content").cast("string").alias("content"), language(F.col("file_path")).alias("language"))


def walked_files(spark: SparkSession, root: str, patterns=(), target: str | None = None, follow: bool = False, stream: bool = False) -> DataFrame:
    """``project_files`` by the ``file_tree`` source: no folder with an ignored name is entered, links are followed once or not
    at all, and with ``stream`` what changes later comes as it changes."""
    from .tree import register

    if target is not None and (target.startswith("/") or ".." in target.split("/")):
        raise ValueError("the target has to be inside the root")
    reader = register(spark).readStream if stream else register(spark).read
    rows = reader.format("file_tree").option("follow", str(follow).lower()).load(root)
    rows = rows.where(wanted(F.col("file_path"), patterns) & readable(F.col("content")))
    if target:
        rows = rows.where((F.col("file_path") == target) | F.col("file_path").startswith(target.rstrip("/") + "/"))
    return rows.select("file_path", F.col("content").cast("string").alias("content"), language(F.col("file_path")).alias("language"))


def commits(log: DataFrame) -> DataFrame:
    """(sha, short_sha, author, committed, subject, body, id, file_path, content) of log records.

    log: one row with ``text``: records sha, author, date, subject and body on lines of their own, each ended by
    NUL. Records of fewer than four lines or without a 40-digit sha are dropped.
    """
    records = F.transform(F.split("text", "\\x00"), lambda r: F.regexp_replace(r, r"\A\s+", ""))
    rows = log.select(F.explode(records).alias("record")).withColumn("line", F.split("record", "\n"))
    rows = rows.where((F.size("line") >= 4) & F.get("line", F.lit(0)).rlike("^[0-9a-f]{40}$"))
    body = F.regexp_replace(F.array_join(F.slice("line", 5, F.greatest(F.size("line") - 4, F.lit(1))), "\n"), r"\A\s+|\s+\z", "")
    own = rows.select(*(F.get("line", F.lit(k)).alias(name) for k, name in enumerate(("sha", "author", "committed", "subject"))), F.when(F.size("line") > 4, body).otherwise("").alias("body"))
    short = F.substring("sha", 1, 7)
    content = F.when(F.col("body") == "", F.col("subject")).otherwise(F.concat_ws("\n\n", "subject", "body"))
    return own.select("*", short.alias("short_sha"), F.concat(F.lit("commit_"), short).alias("id"), F.concat(F.lit("git:"), short).alias("file_path"), content.alias("content"), F.lit("git").alias("language"), F.lit("commit").alias("chunk_type"))


def changed_files(lines: DataFrame) -> DataFrame:
    """(sha, file_path) of name-only output (at, line): a 40-digit line starts a group, the lines after it are its files.

    The order is one log's, so the window runs over one partition of it (``log`` names it if there are several).
    """
    by = [c for c in ("log",) if c in lines.columns] or [F.lit(0)]
    own = F.when(F.col("line").rlike("^[0-9a-f]{40}$"), F.col("line"))
    sha = F.last(own, ignorenulls=True).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select(sha.alias("sha"), own.alias("own"), F.trim("line").alias("file_path")).where("own is null and sha is not null and file_path <> ''").select("sha", "file_path")


def commit_edges(commit_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Modifies edges of commits (id, sha) to the files that they changed."""
    return commit_rows.join(files, "sha").select(F.col("id").alias("source_id"), F.concat(F.lit("file_"), files["file_path"]).alias("target_id"), F.lit("modifies").alias("edge_type")).distinct()


def working_state(root: str, shown: int = 10, recent: int = 15, depth: int = 5) -> dict[str, list[str]]:
    """Branch, changes, last commits and recently changed files of a git folder; empty lists outside of one.

    A driver-side helper for one local folder; nothing here is distributed.
    """
    import os
    import subprocess

    def git(*args: str) -> list[str]:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
        return [x for x in done.stdout.splitlines() if x.strip()] if done.returncode == 0 else []

    branch = git("branch", "--show-current")
    counts = git("rev-list", "--left-right", "--count", "@{upstream}...HEAD")
    behind, ahead = map(int, counts[0].split()) if counts else (0, 0)
    state = [f"Branch: {branch[0]}"] if branch else []
    state += [f"{word} remote by {n} commit(s)" for word, n in (("Ahead of", ahead), ("Behind", behind)) if n]
    for title, args in (("Staged:", ("diff", "--cached", "--name-status")), ("Modified (unstaged):", ("diff", "--name-status"))):
        if lines := git(*args):
            state += [title, *(f"  {x}" for x in lines[:shown])]
    if others := git("ls-files", "--others", "--exclude-standard"):
        state.append(f"Untracked files: {len(others)}")
    changed = dict.fromkeys([*git("diff", "--name-only"), *git("log", f"-{depth}", "--pretty=format:", "--name-only")])
    return {"state": state, "commits": git("log", "--oneline", f"-{shown}"), "files": [f for f in changed if os.path.exists(os.path.join(root, f))][:recent]}


def git_log(spark: SparkSession, root: str, since: str | None = None, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(log text, name-only lines) of a local git folder, for ``commits`` and ``changed_files``."""
    import subprocess

    span = [f"{since}..HEAD"] if since else [f"-{most}"]
    run = lambda *args: subprocess.run(["git", "-C", root, "log", *span, *args], capture_output=True, text=True, timeout=60).stdout
    text, names = run("--format=%H%n%an%n%ai%n%s%n%b%x00"), run("--format=%H", "--name-only")
    return spark.createDataFrame([(text,)], "text string"), spark.createDataFrame(list(enumerate(names.splitlines())) or [], "at int, line string")
