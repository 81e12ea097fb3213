"""Schemas, document flags and the language table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCS = "doc_id bigint, path string, size bigint, mtime bigint, language string, flags int, segment_id int, text string"
MATCH = "doc_id bigint, path string, line_number int, line string, match_start int, match_end int"
RANKED = "doc_id bigint, path string, line_number int, score double"
CHANGE = "path string, kind string, ts timestamp, seq bigint"

MINIFIED, STALE, TOMBSTONE = 8, 16, 32

MAX_FILE_BYTES = 10 * 1024 * 1024
FILES_PER_SEGMENT = 2000

#: Extensions by language; what is not here is ``Unknown``.
LANGUAGES = {
    "Rust": "rs",
    "Python": "py pyi pyw",
    "JavaScript": "js mjs cjs jsx",
    "TypeScript": "ts mts cts tsx",
    "Go": "go",
    "C": "c h",
    "Cpp": "cpp cc cxx hpp hxx hh",
    "Java": "java",
    "Ruby": "rb rake",
    "Shell": "sh bash zsh fish",
    "Markdown": "md markdown",
    "Json": "json",
    "Yaml": "yaml yml",
    "Toml": "toml",
    "Html": "html htm",
    "Css": "css scss sass less",
    "Sql": "sql",
    "Haskell": "hs lhs",
    "Scala": "scala sc",
    "Kotlin": "kt kts",
    "Swift": "swift",
    "Php": "php",
    "CSharp": "cs",
    "Elixir": "ex exs",
    "Clojure": "clj cljs cljc edn",
    "Lua": "lua",
    "Perl": "pl pm",
    "R": "r",
    "Zig": "zig",
    "Nim": "nim",
    "Ocaml": "ml mli",
}
BY_EXTENSION = {e: name for name, extensions in LANGUAGES.items() for e in extensions.split()}

#: What ``lang:`` understands; anything else selects ``Unknown``.
LANG_FILTER = {
    "rust": "Rust", "rs": "Rust", "python": "Python", "py": "Python", "javascript": "JavaScript", "js": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript", "go": "Go", "c": "C", "cpp": "Cpp", "c++": "Cpp", "java": "Java",
    "ruby": "Ruby", "rb": "Ruby", "shell": "Shell", "sh": "Shell", "bash": "Shell",
}

BINARY_EXTENSIONS = frozenset(
    """7z a apk avi bmp cache cer class crt crx db dex dll doc docx ear eot exe flac gif gz bz2 icc icm ico jar jpeg jpg ldf lib
    mdb mdf mkv mov mp3 mp4 nupkg o obj oga ogg otf p12 p7b p7s pak pdb pdf pfx png ppt pptx psd rar snk so dylib sqlite svgz
    tar tif tiff ttf war wasm wav webm webp woff woff2 xls xlsx xz zip""".split()
)
#: Folders that are never indexed, besides hidden ones.
IGNORED_DIRS = ("__pycache__", "node_modules", "target", "venv")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension of a path; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    lookup = F.create_map(*(F.lit(x) for x in chain(*BY_EXTENSION.items())))
    return F.coalesce(F.try_element_at(lookup, extension(path)), F.lit("Unknown"))


def parse_language(name: str, every: bool = False) -> str:
    """Language that ``lang:name`` selects; with ``every`` all names of the table count, not the ten of the filter."""
    key = name.lower()
    if every:
        return LANG_FILTER.get(key) or next((x for x in LANGUAGES if x.lower() == key), "Unknown")
    return LANG_FILTER.get(key, "Unknown")


def is_valid(flags: Column) -> Column:
    return flags.bitwiseAND(STALE | TOMBSTONE) == 0
