"""Tables of files: scanning, languages, modules, incremental change, chunks.

A files table has path, content and what is derived from them; it comes from ``read_files`` or from
any table with a path and a text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_name, depth, extension, line_count, parent_path

#: Fixed values of a scan.
IGNORE_DIRS = (
    ".git .svn .hg node_modules __pycache__ .pytest_cache venv .venv env .env dist build target out "
    ".idea .vscode .tox coverage .coverage htmlcov"
).split()
IGNORE_EXTENSIONS = ".pyc .pyo .pyd .class .jar .war .o .obj .so .dll .exe .min.js .min.css .lock".split()
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".pyw": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
}
#: Marker files of module roots in order of precedence.
MARKERS = (
    ("__init__.py", "python"), ("pyproject.toml", "python"), ("setup.py", "python"), ("setup.cfg", "python"), ("package.json", "javascript"),
    ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "java"),
)
#: The smaller scan of the second generation.
IGNORE_DIRS_V2 = "node_modules dist build .git .vscode .idea coverage .next .nuxt out target bin obj __pycache__ .pytest_cache venv env".split()
IGNORE_EXTENSIONS_V2 = ".lock .log .map .min.js .min.css".split()

#: Languages of the second generation.
LANGUAGES_V2 = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".md": "markdown", ".mdx": "markdown",
}


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), content, size_bytes and last_modified of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + "/" + root.strip("/") + "/", "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))


def language_of(path: Column, languages=LANGUAGES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    return table[extension(path)]


def scan_files(files: DataFrame, *, languages=None, known=LANGUAGES, ignore_dirs=IGNORE_DIRS, ignore_extensions=IGNORE_EXTENSIONS, max_bytes: int = 10 << 20, dot_dirs: bool = False) -> DataFrame:
    """path, language, size_bytes, line_count, sha256 of the files that a scan keeps."""
    dirs = F.filter(F.split(parent_path(F.col("path")), "/"), lambda d: d != "")
    skipped = F.exists(dirs, lambda d: d.isin(list(ignore_dirs)) | (F.lit(not dot_dirs) & d.startswith(".")))
    lang = language_of(F.col("path"), known)
    out = files.withColumn("language", lang).where(F.col("language").isNotNull() & ~skipped & ~extension(F.col("path")).isin(list(ignore_extensions)))
    if languages:
        out = out.where(F.col("language").isin(list(languages)))
    text = F.coalesce("content", F.lit(""))
    size = F.octet_length(text)
    return out.where(size <= max_bytes).select("path", "language", size.cast("long").alias("size_bytes"), line_count(text).cast("long").alias("line_count"), F.sha2(text, 256).alias("sha256"))


def scan_files_v2(files: DataFrame) -> DataFrame:
    """path, language, size_bytes of the files that the second generation's scan keeps: dot folders are not special, sizes not bounded, texts not hashed."""
    dirs = F.split(parent_path(F.col("path")), "/")
    kept = ~F.exists(dirs, lambda d: d.isin(IGNORE_DIRS_V2)) & ~extension(F.col("path")).isin(IGNORE_EXTENSIONS_V2)
    lang = language_of(F.col("path"), LANGUAGES_V2)
    return files.where(kept & lang.isNotNull()).select("path", lang.alias("language"), F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size_bytes"))


def scan_totals(scanned: DataFrame) -> DataFrame:
    """total_files, total_size of a scan; one row."""
    return scanned.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def scan_directory(files: DataFrame, directory: str, limit: int = 50) -> DataFrame:
    return files.where(parent_path(F.col("path")) == directory).orderBy("path").limit(limit)


def collect_directories(files: DataFrame) -> DataFrame:
    """path and depth of all directories that hold files, themselves or below."""
    parts = F.split(parent_path(F.col("path")), "/")
    every = files.where(F.col("path").contains("/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return every.distinct().withColumn("depth", depth(F.col("path")))


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"))


def primary_language(files: DataFrame) -> DataFrame:
    """The language of most files; of equals, that of the first path."""
    n = files.groupBy("language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(1).select("language")


def module_group(files: DataFrame) -> DataFrame:
    """A row for each directory with files: path, name, depth, file_count, primary_language."""
    d = files.groupBy(parent_path(F.col("path")).alias("module"), "language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    out = d.groupBy("module").agg(F.sum("n").alias("file_count"), F.min_by("language", F.struct(-F.col("n"), F.col("first"))).alias("primary_language"))
    return out.select(F.col("module").alias("path"), F.when(F.col("module") == "", "root").otherwise(base_name(F.col("module"))).alias("name"), depth(F.col("module")).alias("depth"), "file_count", "primary_language")


def detect_module_roots(files: DataFrame) -> DataFrame:
    """path, marker and language of directories that hold a marker file; the marker of highest precedence counts."""
    markers = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("marker"), F.lit(lang).alias("language")) for i, (m, lang) in enumerate(MARKERS)])
    named = files.select(parent_path(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"))
    found = named.withColumn("hit", F.filter(markers, lambda m: m["marker"] == F.col("base"))).select("dir", F.explode("hit").alias("m"))
    return found.groupBy("dir").agg(F.min("m").alias("m")).select(F.col("dir").alias("path"), "m.marker", "m.language")


def build_state(files: DataFrame) -> DataFrame:
    return files.select("path", "sha256")


def incremental_scan(files: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are new or changed against a snapshot, and paths that are gone."""
    return files.join(snapshot.select("path", "sha256"), ["path", "sha256"], "left_anti").select(*files.columns), snapshot.select("path").join(files.select("path"), "path", "left_anti")


def commits_since(commits: DataFrame, since: DataFrame) -> DataFrame:
    """repo and n: commits (repo, ts) after each repo's time in since (repo, ts)."""
    s = since.select("repo", F.col("ts").alias("since"))
    return commits.join(s, "repo").where(F.col("ts") > F.col("since")).groupBy("repo").agg(F.count("*").alias("n"))


def change_decision(state: DataFrame, catalog: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """repo, updated, reason for every repo of state (repo, sha, mtime) against catalog (repo, sha, created_at); commits: counts (repo, n)."""
    prior = catalog.select("repo", F.col("sha").alias("prior_sha"), "created_at", F.lit(True).alias("known"))
    x = state.join(prior, "repo", "left")
    x = x.join(commits, "repo", "left") if commits is not None else x.withColumn("n", F.lit(None).cast("long"))
    both, one = F.col("sha").isNotNull() & F.col("prior_sha").isNotNull(), F.col("sha").isNotNull() & F.col("created_at").isNotNull()
    reason = (
        F.when(F.col("known").isNull(), "no_prior_graph")
        .when(both, F.when(F.col("sha") == F.col("prior_sha"), "no_change").otherwise("git_sha_changed"))
        .when(one, F.when(F.coalesce("n", F.lit(0)) == 0, "no_change").otherwise("git_commits_found"))
        .when(F.col("mtime") <= F.col("created_at"), "no_change")
        .otherwise("mtime_changed")
    )
    return x.select("repo", (reason != "no_change").alias("updated"), reason.alias("reason"))


def chunk_file(files: DataFrame) -> DataFrame:
    """One chunk for each file: its lines from 1 to the last."""
    return files.select("path", F.lit(1).alias("start_line"), line_count(F.coalesce("content", F.lit(""))).cast("int").alias("end_line"), F.coalesce("content", F.lit("")).alias("code"))


def chunk_lines(files: DataFrame, max_lines: int = 1000) -> DataFrame:
    """Chunks of up to max_lines lines, by functions alone."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    n = F.size("lines")
    start = files.select("path", lines.alias("lines")).select("path", "lines", F.explode(F.sequence(F.lit(0), n - 1, F.lit(max_lines))).alias("at"))
    return start.select("path", (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + max_lines, n).alias("end_line"), F.array_join(F.slice("lines", F.col("at") + 1, F.lit(max_lines)), "\n").alias("code"))


def chunk_stream(files: DataFrame, max_bytes: int = 50_000, max_lines: int = 1000) -> DataFrame:
    """Greedy chunks: one ends with the line that takes it to max_bytes bytes or max_lines lines. A file is one row, so tasks hold no more than a batch of files."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held, size, start = [], 0, 1
                for i, line in enumerate((content or "").split("\n"), 1):
                    held.append(line)
                    size += len(line.encode()) + 1
                    if size >= max_bytes or len(held) >= max_lines:
                        rows.append((path, start, i, "\n".join(held)))
                        held, size, start = [], 0, i + 1
                if held:
                    rows.append((path, start, start + len(held) - 1, "\n".join(held)))
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "code"])

    return files.select("path", "content").mapInPandas(run, "path string, start_line int, end_line int, code string")


def parents_first(files: DataFrame) -> DataFrame:
    """Files with their rank inside the directory."""
    return files.withColumn("k", F.row_number().over(Window.partitionBy(parent_path(F.col("path"))).orderBy("path")))
