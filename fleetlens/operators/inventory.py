"""Project inventory from file listings: modules, languages, source folder,
project name and entry files.

``files(project, path)`` holds relative paths; ``manifests(project, name,
text)`` holds the text of root manifest files when names are resolved.
Marker and language tables are fixed dimensions of a known small size
(below), so they are broadcast; file tables are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Module scan roots, entry-file names and probe roots,
# source-folder candidates in priority order, marker files and languages.
MODULE_ROOTS = ["src", "lib", "app", "source"]
ENTRY_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "main.js", "main.jsx",
               "main.py", "app.py", "main.go", "main.rs", "lib.rs", "app.js", "app.ts", "server.ts", "server.js"]
ENTRY_ROOTS = ["src", "lib", "app", "source", "sources", "."]
SRC_DIR_CANDIDATES = ["src", "lib", "app", "main"]
# marker file -> languages it signals (typescript needs package.json too)
MARKERS = [
    ("package.json", "javascript"), ("pyproject.toml", "python"), ("setup.py", "python"), ("go.mod", "go"),
    ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "java"), ("build.gradle.kts", "kotlin"),
    ("Cargo.toml", "rust"), ("Gemfile", "ruby"), ("composer.json", "php"), ("CMakeLists.txt", "c"),
    ("CMakeLists.txt", "cpp"), ("Makefile", "c"), ("Makefile", "cpp"), ("Package.swift", "swift"),
]
LANGUAGE_ORDER = ["javascript", "typescript", "python", "go", "java", "kotlin", "rust", "ruby", "php", "csharp",
                  "c", "cpp", "swift"]
# language -> (extensions, linter, formatter, style guide)
LANGUAGE_TOOLS = {
    "typescript": ([".ts", ".tsx"], "eslint", "prettier", "typescript/coding-style.md"),
    "javascript": ([".js", ".jsx"], "eslint", "prettier", "javascript/coding-style.md"),
    "python": ([".py"], "ruff", "black", "python/coding-style.md"),
    "go": ([".go"], "golangci-lint", "gofmt", "go/coding-style.md"),
    "java": ([".java"], "checkstyle", "google-java-format", "java/coding-style.md"),
    "kotlin": ([".kt", ".kts"], "detekt", "ktlint", "kotlin/coding-style.md"),
    "rust": ([".rs"], "clippy", "rustfmt", "rust/coding-style.md"),
    "ruby": ([".rb"], "rubocop", "standardrb", "ruby/coding-style.md"),
    "php": ([".php"], "phpstan", "php-cs-fixer", "php/coding-style.md"),
    "csharp": ([".cs"], "dotnet format", "dotnet format", "csharp/coding-style.md"),
    "c": ([".c", ".h"], "cppcheck", "clang-format", "c/coding-style.md"),
    "cpp": ([".cpp", ".hpp", ".cc", ".cxx"], "cppcheck", "clang-format", "cpp/coding-style.md"),
    "swift": ([".swift"], "swiftlint", "swift-format", "swift/coding-style.md"),
}
NOT_AVAILABLE = "not available"
NAME_ASSIGNMENT = r"name\s*=\s*[\"']([^\"']+)[\"']"
PROJECT_SECTION = r"(?s)\[project\]([^\[]*)"


def modules_from_files(files: DataFrame) -> DataFrame:
    """Modules of a file listing: every folder directly under a module root
    is a module holding all files below it; a .ts/.tsx/.js/.jsx file directly
    under a root is its own module named without its last extension.
    Returns (project, name, path, n_files) - files stay a table
    (``module_members``)."""
    return module_members(files).groupBy("project", "name", "path").agg(F.count(F.lit(1)).alias("n_files"))


def module_members(files: DataFrame) -> DataFrame:
    """(project, name, path, file) for every file that belongs to a module."""
    parts = F.split("path", "/")
    root, first = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    f = files.select("project", F.col("path").alias("file"), parts.alias("_p"), root.alias("_root"), first.alias("_first"))
    f = f.where(F.col("_root").isin(MODULE_ROOTS) & (F.size("_p") >= 2))
    is_dir_member = F.size("_p") >= 3
    is_file_module = (F.size("_p") == 2) & F.col("_first").rlike(r"\.[jt]sx?$")
    name = F.when(is_dir_member, F.col("_first")).otherwise(F.regexp_replace("_first", r"\.\w+$", ""))
    path = F.concat_ws("/", "_root", "_first")
    return f.where(is_dir_member | is_file_module).select("project", name.alias("name"), path.alias("path"), "file")


def root_entries(files: DataFrame) -> DataFrame:
    """(project, name) of the top-level entries (files and folders)."""
    return files.select("project", F.try_element_at(F.split("path", "/"), F.lit(1)).alias("name")).distinct()


def detect_languages(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """(project, language, position) from marker files among the root
    entries; typescript needs both package.json and tsconfig.json, csharp any
    ``*.csproj``. The marker table has a fixed size and is broadcast."""
    markers = F.broadcast(spark.createDataFrame(MARKERS, "name string, language string"))
    direct = roots.join(markers, "name").select("project", "language")
    csharp = roots.where(F.col("name").endswith(".csproj")).select("project", F.lit("csharp").alias("language"))
    ts = (roots.where(F.col("name").isin("package.json", "tsconfig.json")).groupBy("project")
          .agg(F.countDistinct("name").alias("_n")).where(F.col("_n") == 2)
          .select("project", F.lit("typescript").alias("language")))
    langs = direct.unionByName(csharp).unionByName(ts).distinct()
    order = F.array_position(F.array(*[F.lit(x) for x in LANGUAGE_ORDER]), F.col("language"))
    return langs.withColumn("position", order.cast("int"))


def language_tools(spark: SparkSession, languages: DataFrame) -> DataFrame:
    """Left join of languages to the fixed language -> tools dimension; an
    unknown language gets 'not available' tools instead of an error."""
    dim = spark.createDataFrame(
        [(k, v[0], v[1], v[2], v[3]) for k, v in LANGUAGE_TOOLS.items()],
        "language string, extensions array<string>, linter string, formatter string, style_guide string")
    j = languages.join(F.broadcast(dim), "language", "left")
    na = F.lit(NOT_AVAILABLE)
    return j.select(*languages.columns,
                    F.coalesce("extensions", F.array().cast("array<string>")).alias("extensions"),
                    F.coalesce("linter", na).alias("linter"), F.coalesce("formatter", na).alias("formatter"),
                    F.coalesce("style_guide", na).alias("style_guide"))


def languages_by_extension(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(project, language, n_files): languages whose file extensions occur in
    a project's files. The extension -> language table is the fixed language
    dimension (a few dozen rows), broadcast."""
    ext = spark.createDataFrame([(e, lang) for lang, v in LANGUAGE_TOOLS.items() for e in v[0]],
                                "ext string, language string")
    f = files.select("project", F.lower(F.regexp_extract(F.try_element_at(F.split("path", "/"), F.lit(-1)),
                                                         r"(\.[^.]+)$", 1)).alias("ext"))
    return (f.join(F.broadcast(ext), "ext").groupBy("project", "language")
            .agg(F.count(F.lit(1)).alias("n_files")))


def source_dir(spark: SparkSession, files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """First existing folder of src, lib, app, main; else '.'."""
    parts = F.split("path", "/")
    dirs = files.where(F.size(parts) >= 2).select("project", F.try_element_at(parts, F.lit(1)).alias("dir")).distinct()
    rank = F.array_position(F.array(*[F.lit(x) for x in SRC_DIR_CANDIDATES]), F.col("dir"))
    best = (dirs.withColumn("_r", rank).where(F.col("_r") > 0).groupBy("project")
            .agg(F.min_by("dir", "_r").alias("src_dir")))
    base = (projects if projects is not None else files).select("project").distinct()
    return base.join(best, "project", "left").select("project", F.coalesce("src_dir", F.lit(".")).alias("src_dir"))


def project_name(manifests: DataFrame, projects: DataFrame, folder_col: str = "folder") -> DataFrame:
    """package.json ``name`` -> setup.py ``name=`` -> pyproject ``[project]``
    name -> folder name. ``manifests(project, name, text)``; malformed JSON
    falls through."""
    m = manifests.groupBy("project").agg(
        F.max(F.when(F.col("name") == "package.json", F.col("text"))).alias("_pkg"),
        F.max(F.when(F.col("name") == "setup.py", F.col("text"))).alias("_setup"),
        F.max(F.when(F.col("name") == "pyproject.toml", F.col("text"))).alias("_pyproject"))
    # only a JSON string is a name: its type is that of the parsed value, whatever its text looks like
    parsed = F.try_parse_json("_pkg")
    pkg = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.name", "variant")) == "STRING",
                 F.try_variant_get(parsed, "$.name", "string"))
    setup = F.regexp_extract("_setup", NAME_ASSIGNMENT, 1)
    section = F.regexp_extract("_pyproject", PROJECT_SECTION, 1)
    pyproj = F.regexp_extract(section, NAME_ASSIGNMENT, 1)
    j = projects.join(m, "project", "left")
    return j.select("project", F.coalesce(F.nullif(pkg, F.lit("")), F.nullif(setup, F.lit("")),
                                          F.nullif(pyproj, F.lit("")), F.col(folder_col)).alias("name"))


def entry_files(files: DataFrame) -> DataFrame:
    """Files named like an entry point directly in a probe root (no recursion):
    the 17 names in src, lib, app, source, sources and the project root."""
    parts = F.split("path", "/")
    base = F.try_element_at(parts, F.lit(-1))
    in_root = (F.size(parts) == 1) | ((F.size(parts) == 2) & F.try_element_at(parts, F.lit(1)).isin(ENTRY_ROOTS))
    return files.where(in_root & base.isin(ENTRY_FILES)).select("project", "path")


# --------------------------------------------------------------------------- A7

def folder_sizes(files: DataFrame, group: Sequence[str] = ("project",), path_col: str = "path",
                 size_col: str = "size") -> DataFrame:
    """(group..., folder, n_files, n_bytes) of every folder on a file's path,
    '' for the root: all that lies below it. Files are summed per folder
    first; what then goes to the folders above is one row per folder and
    level, not one per file."""
    group = list(group)
    folder = F.regexp_replace(path_col, "/?[^/]*$", "")
    own = files.groupBy(*group, folder.alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.sum(size_col).alias("_b"))
    parts = F.split("_f", "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return (own.select(*group, F.explode(above).alias("folder"), "_n", "_b").groupBy(*group, "folder")
            .agg(F.sum("_n").alias("n_files"), F.sum("_b").alias("n_bytes")))


def size_below(files: DataFrame, prefix: str, group: Sequence[str] = ("project",), path_col: str = "path",
               size_col: str = "size") -> DataFrame:
    """(group..., n_files, n_bytes) below one path prefix; groups without such
    files have no row."""
    inside = F.lit(True) if prefix in ("", ".") else F.col(path_col).startswith(prefix.rstrip("/") + "/")
    return files.where(inside).groupBy(*group).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size_col).alias("n_bytes"))
