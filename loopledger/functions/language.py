"""Language of a source unit: declared, else by extension, else by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import JAVA, JAVASCRIPT, LANGUAGES, PYTHON, UNKNOWN
from .text import contains_any, let

# Extensions, path exclusions, and the words that give a language away.
EXTENSIONS = {
    PYTHON: (".py", ".pyw"),
    JAVASCRIPT: (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"),
    JAVA: (".java",),
}
DEFAULT_EXCLUDES = ("node_modules", ".git", "__pycache__", "venv", ".venv")
INDICATORS = {
    PYTHON: (
        "def ", "import ", "from ", "class ", "::", "self.",
        "elif ", "except:", "with open", "__init__",
    ),
    JAVASCRIPT: (
        "const ", "let ", "var ", "function ", "=> ", "require(", "import ",
        "export ", "async ", "await ", "console.log", ".then(", ".catch(",
    ),
    JAVA: (
        "public class", "private ", "protected ", "static void main", "system.out",
        "@override", "@autowired", "new ", "throws ", "implements ", "extends ",
    ),
}


def extension(path: Column) -> Column:
    """Last suffix of the file name, lower-cased; empty for names such as ``.py``."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(F.lower(name), r"(?s)^.+(\.[^./]+)\z", 1)


def language_by_extension(path: Column) -> Column:
    ext = extension(path)
    pick = F.lit(None).cast("string")
    for language in reversed(LANGUAGES):
        pick = F.when(ext.isin(*EXTENSIONS[language]), F.lit(language)).otherwise(pick)
    return pick


def is_supported(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*(e for exts in EXTENSIONS.values() for e in exts)), F.lit(False))


def is_excluded(path: Column, patterns: tuple[str, ...] | list[str] | None = None) -> Column:
    """True when any pattern occurs anywhere in the whole path."""
    return contains_any(path, patterns or DEFAULT_EXCLUDES)


def _score(lowered: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.lit(list(words)), lambda word: F.contains(lowered, word)))


def content_scores(code: Column) -> Column:
    """Number of indicator words present, per language, as a struct."""
    return let(
        F.lower(code),
        lambda low: F.struct(*(_score(low, INDICATORS[lang]).alias(lang) for lang in LANGUAGES)),
    )


def best_scored(scores: Column) -> Column:
    """Language with most indicators; ties favour the earlier of ``LANGUAGES``."""
    top = F.greatest(*(scores[lang] for lang in LANGUAGES))
    choice = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(UNKNOWN))
    for lang in LANGUAGES:
        choice = choice.when(scores[lang] == top, F.lit(lang))
    return choice


def language_by_content(code: Column) -> Column:
    return let(content_scores(code), best_scored)


def resolve_language(declared: Column, path: Column, code: Column) -> Column:
    """Declared name if valid, else extension, else content, else ``unknown``."""
    lowered = F.lower(declared)
    return F.coalesce(
        F.when(lowered.isin(*LANGUAGES), lowered),
        language_by_extension(path),
        language_by_content(code),
        F.lit(UNKNOWN),
    )
