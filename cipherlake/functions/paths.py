"""Column functions over file paths (no content is read)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import alternation, any_literal, first_match, has_any, lookup


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def language(path: Column, variant: str = "base") -> Column:
    """Language by file extension; the variants disagree and are all kept."""
    table, unknown = V.LANGUAGE_TABLES[variant]
    if variant == "wrapper":  # text after the last dot of the whole path, case kept
        ext = F.regexp_extract(path, r"\.([^.]*)$", 1)
    else:
        ext = extension(path)
    return lookup(table, ext, unknown)


def is_vendored(path: Column) -> Column:
    return has_any(path, V.VENDOR_PARTS)


def is_generated(path: Column) -> Column:
    return has_any(F.lower(path), V.GENERATED_PARTS)


def is_test(path: Column) -> Column:
    return has_any(path, V.TEST_PARTS)


def is_test_strict(path: Column) -> Column:
    """Benchmark variant: strong parts first, then 'test' anywhere except in C sources."""
    low = F.lower(path)
    c_source = low.rlike("(?:" + alternation(V.C_TEST_SUFFIXES) + ")$")
    return first_match([(has_any(low, V.STRONG_TEST_PARTS), True),
                        (low.contains("test"), ~c_source)], False)


def is_config(path: Column) -> Column:
    return F.lower(path).rlike("(?:" + alternation(V.CONFIG_SUFFIXES) + ")$")


def is_documentation(path: Column) -> Column:
    """Extension, base-name prefix or documentation directory."""
    return (extension(path).isin(V.DOC_EXTENSIONS)
            | F.lower(base_name(path)).rlike("^(?:" + "|".join(V.DOC_PREFIXES) + ")")
            | has_any(path, V.DOC_DIRECTORIES))


def is_documentation_loose(path: Column) -> Column:
    """Benchmark variant: the marks may stand anywhere in the path."""
    return has_any(F.lower(path), V.DOC_PARTS)


def file_category(path: Column) -> Column:
    return first_match([(is_test_strict(path), "test_files"), (is_vendored(path), "vendor_files"),
                        (is_config(path), "config_files"), (is_documentation_loose(path), "doc_files")],
                       "source_files")


def is_binary_extension(path: Column) -> Column:
    return extension(path).isin(V.BINARY_EXTENSIONS)


def is_binary_name(path: Column) -> Column:
    """Binary by extension or by a word in the base name."""
    return is_binary_extension(path) | has_any(F.lower(base_name(path)), V.BINARY_NAME_WORDS)


def is_known_text(path: Column) -> Column:
    return extension(path).isin(V.TEXT_EXTENSIONS) | F.lower(base_name(path)).isin(V.TEXT_FILENAMES)


def is_library_implementation(path: Column) -> Column:
    return has_any(F.lower(path), [p for p in V.LIBRARY_IMPLEMENTATION_PARTS if p == p.lower()])


def is_crypto_library(path: Column) -> Column:
    return has_any(F.lower(path), V.LIBRARY_PARTS)


def library_name(path: Column) -> Column:
    """Name of the crypto library a path belongs to; null when none.  Names are
    tried in alphabetical order so that the answer is stable."""
    low = F.lower(path)
    return first_match([(has_any(low, parts), name) for name, parts in V.LIBRARY_NAMES.items()])


def skip_reason(path: Column, suppress_file: Column | None = None) -> Column:
    """Why the layered scan leaves a file out; null means it is scanned."""
    low = F.lower(path)
    third_party = ~has_any(low, V.SKIP_EXCEPTIONS) & (is_vendored(path) | is_generated(path))
    irrelevant = (low.rlike("(?:" + alternation(V.IRRELEVANT_SUFFIXES) + ")$")
                  | has_any(path, V.IRRELEVANT_PARTS))
    cases = [(third_party, "third_party"), (irrelevant, "irrelevant")]
    if suppress_file is not None:
        cases.append((suppress_file, "suppressed"))
    return first_match(cases)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a path glob; ``*`` stops at a slash."""
    return "^" + "".join("[^/]*" if c == "*" else alternation([c]) for c in glob) + "$"


def is_ignored(path: Column, patterns: list[str] | None = None, variant: str = "base") -> Column:
    """Ignore patterns: the glob matches the whole path, or the stem occurs in it.
    Base variant drops one trailing ``*`` from the stem, layered drops all edge ones."""
    patterns = V.DEFAULT_IGNORE_PATTERNS if patterns is None else patterns
    if variant == "base":
        stems = [p[:-1] if p.endswith("*") else p for p in patterns]
    else:
        stems = [p.strip("*") for p in patterns]
    globs = path.rlike("|".join(glob_pattern(p) for p in patterns))
    return globs | any_literal(path, stems)


def profile_excluded(rel_path: Column) -> Column:
    """Exclusion used while profiling a project."""
    prefixes = rel_path.rlike("^(?:" + alternation(V.PROFILE_EXCLUSIONS) + ")")
    exact = rel_path.isin([p.removesuffix("/") for p in V.PROFILE_EXCLUSIONS])
    return prefixes | exact | is_binary_extension(rel_path)
