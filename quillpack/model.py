"""Fixed data of the engine: the file row, defaults, presets, language names, comment styles and symbols."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: The canonical row of a file. kind is 'file' or 'marker'; status is one of STATUSES; error says why content is missing.
FILE_ROW = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("repo", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("relative", T.StringType()),
        T.StructField("display", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
STATUSES = ("ok", "error", "oversize", "binary", "content_filtered", "marker")

SYSTEM_IGNORE = (
    "node_modules/", "bin/", "obj/", "package-lock.json", "yarn.lock", "Cargo.lock", ".DS_Store", "Thumbs.db", ".git/",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".pdf", ".exe", ".bin", ".pyc", ".dll", ".pdb", ".min.js", ".min.css", ".meta",
    "id_rsa", "id_dsa", ".pem", ".key", ".p12", ".env", "secrets", "credentials",
)

_BUILD_DIRS = ("node_modules", ".git", ".svn", ".hg", "bin", "obj", "dist", "build", "target", "out", ".vs", ".idea", "coverage", ".next", ".nuxt", "__pycache__", "venv", ".env")
#: Folders (names in any case) that a walk for files, and a search for repositories, never enter.
WALK_SKIP = (*_BUILD_DIRS, ".env.local", "node_modules_cache")
REPO_SKIP = _BUILD_DIRS

LANGUAGES = {
    "js": "javascript", "ts": "typescript", "py": "python", "cs": "cs", "sh": "bash", "md": "markdown", "h": "c", "hpp": "cpp", "razor": "html", "vue": "html",
    "shader": "glsl", "cginc": "glsl", "hlsl": "glsl", "uss": "css", "uxml": "xml", "ps1": "powershell", "dockerfile": "dockerfile", "makefile": "makefile",
    "gemfile": "ruby", "rakefile": "ruby",
}

PRESETS = {
    "web": "html htm css scss sass less js jsx ts tsx json svg vue svelte",
    "backend": "py rb php pl go rs java cs cpp cc cxx h c hpp hxx swift kt ex exs sh",
    "dotnet": "cs razor csproj json http xaml",
    "unity": "cs shader cginc hlsl glsl asmdef asmref uss uxml json yaml",
    "java": "java kt kts scala",
    "cpp": "c h cpp cc cxx hpp hxx",
    "script": "py rb php pl pm lua sh bash zsh ps1",
    "data": "sql xml json yaml yml toml ini md csv graphql",
    "config": "env conf ini Dockerfile Makefile Gemfile package.json cargo.toml go.mod",
    "build": "Dockerfile Makefile Gemfile package.json",
    "docs": "md txt rst adoc",
}
PRESETS = {name: tuple(words.split()) for name, words in PRESETS.items()}


@dataclass(frozen=True)
class CommentStyle:
    """What the minifier takes for a comment: a block's ends, and whether //, # and -- run to the end of the line."""

    block: tuple[str, str] | None
    slashes: bool = False
    hashes: bool = False
    dashes: bool = False


DEFAULT_STYLE = CommentStyle(("/*", "*/"), slashes=True, hashes=True)
_STYLES = (
    (CommentStyle(("/*", "*/"), slashes=True), "cs csharp c cpp cc cxx c++ h hpp hxx h++ js javascript ts typescript css uss glsl shader cginc hlsl razor"),
    (CommentStyle(("/*", "*/"), slashes=True, hashes=True), "py python"),
    (CommentStyle(None, hashes=True), "rb ruby sh bash zsh shell ps1 powershell dockerfile makefile gemfile rakefile bagfile"),
    (CommentStyle(("/*", "*/"), slashes=True, dashes=True), "sql pgsql psql mysql sqlite mariadb mssql oracle plsql tsql transactsql"),
    (CommentStyle(("<!--", "-->")), "html htm xml vue svelte"),
    (CommentStyle(("/*", "*/"), slashes=True), "yaml yml toml ini cfg conf properties json jsonc"),
    (CommentStyle(None), "md markdown"),
)
STYLES = {name: style for style, names in _STYLES for name in names.split()}


def style_of(language: str | None) -> CommentStyle:
    return STYLES.get((language or "").lower(), DEFAULT_STYLE)


_SYMBOL_RANGES = ((0xE000, 60), (0xE04C, 16), (0xE080, 20), (0xE100, 20))
SYMBOLS = tuple(chr(first + k) for first, n in _SYMBOL_RANGES for k in range(n))


@dataclass(frozen=True)
class Settings:
    """Options with the defaults that change answers."""

    max_file_size: str = "1MB"
    max_clipboard_size: str = "10MB"
    max_output: str = "100MB"
    max_files: int = 100_000
    discovery: str = "auto"
    max_depth: int | None = None
    follow_symlinks: bool = False
    system_ignore: tuple[str, ...] = SYSTEM_IGNORE
    exclude_path: tuple[str, ...] = ()
    include_path: tuple[str, ...] = ()
    drop_line_prefixes: tuple[str, ...] = ()
    presets: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PRESETS))
    languages: dict[str, str] = field(default_factory=lambda: dict(LANGUAGES))
    header: str = "## File: {path}"
    structure_header: str = "_Project Structure:_ "
    fence: str = "```"
    sort: bool = True
    cluster_depth: int = 2
    cluster_separator: str = "---"
    cluster_headers: bool = True
    cluster_fail_fast: bool = False
    cluster_skip: tuple[str, ...] = ()

    def but(self, **changes) -> Settings:
        return replace(self, **changes)
