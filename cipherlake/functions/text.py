"""Small Column helpers shared by all operators."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def alternation(words: Iterable[str]) -> str:
    """Regular expression that finds any of the literal words."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def has_any(col: Column, words: Iterable[str]) -> Column:
    """True when the text contains at least one of the words, letter case as given.  Plain substring tests: an
    alternation tries every word at every character, which costs about ten times as much on a context."""
    return any_literal(col, words)


def has_any_lower(col: Column, words: Iterable[str], fix_case: bool = False) -> Column:
    """Words against lower-cased text.  Words holding capitals can never match
    unless ``fix_case`` lower-cases them first."""
    if fix_case:
        words = [w.lower() for w in words]
    return has_any(F.lower(col), [w for w in words if w == w.lower()])


def any_literal(col: Column, words: Iterable[str]) -> Column:
    """Plain substring test, cheaper than a regular expression on long texts.  A word that holds another one is left out:
    where it stands, the other one does."""
    words, out = list(dict.fromkeys(words)), None
    for w in (w for w in words if not any(other in w for other in words if other != w)):
        out = col.contains(w) if out is None else out | col.contains(w)
    return F.lit(False) if out is None else out


def word_flags(texts: Column, lists: list[list[str]]) -> Column:
    """For each text of an array a number whose bit k tells whether the text holds a word of list k.  Arrow looks for all
    words of a list in one pass over a batch; on contexts, a substring test of each word takes about twenty times as long."""
    if len(lists) > 63:
        raise ValueError("a number holds 63 lists")
    patterns = [alternation(words) for words in lists]

    @F.arrow_udf("array<bigint>")
    def flags(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        found = np.zeros(len(flat), dtype="int64")
        for k, pattern in enumerate(patterns):
            if pattern:
                found |= pc.match_substring_regex(flat, pattern).fill_null(False).to_numpy(zero_copy_only=False).astype("int64") << k
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))

    return flags(texts)


def lists_held(text: Column, lists: list[list[str]]) -> Column:
    """Places of the lists of which a text holds a word, ascending; an empty list is never held.  One pass over a batch of
    texts for each list, as in ``word_flags``, for any number of lists."""
    patterns = [alternation(words) for words in lists]

    @F.arrow_udf("array<int>")
    def held(batch: pa.Array) -> pa.Array:
        found = np.zeros((len(batch), len(patterns)), dtype=bool)
        for k, pattern in enumerate(patterns):
            if pattern:
                found[:, k] = pc.match_substring_regex(batch, pattern).fill_null(False).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], found.sum(axis=1)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(found)[1], pa.int32()))

    return held(text)


def java_pattern(pattern: str) -> str:
    """Only a line feed ends a line, as in the rule dialect.  Where every match starts with one of a few characters, those
    are tested first, which refuses most places of a text before the alternatives are tried there."""
    first = first_characters(pattern)
    return "(?d)" + (f"(?=[{first}])" if first else "") + pattern


_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)


def first_characters(pattern: str) -> str:
    """First characters of all matches of ``(?i)\\b(one|two|...)rest``, where each alternative starts with a plain letter or
    digit; of other forms nothing is said (''), nor of patterns with quotes, nested classes or flags inside."""
    head = re.match(r"(\(\?i\))?(?:\\b)?\((?:\?:)?(?!\?)", pattern)
    if not head or re.search(r"\\Q|\(\?[^:=!<]|\[[^\]]*(\[|&&)", pattern[head.end():]):
        return ""
    depth, starts, begins, closed = 1, [], True, False
    tokens = _TOKEN.findall(pattern[head.end():]) + [""]
    for token, after in zip(tokens, tokens[1:] + [""]):
        if begins and not (re.fullmatch("[A-Za-z0-9]", token) and after not in ("?", "*", "{")):
            return ""
        if begins:
            starts.append(token)
        depth += (token == "(") - (token == ")")
        begins = token == "|" and depth == 1 and not closed
        if token == "|" and closed and depth == 0:
            return ""
        if depth == 0 and not closed:
            closed = True
            if after in ("?", "*", "{"):
                return ""
    if not closed or depth:
        return ""
    both = {c for s in starts for c in ((s.lower(), s.upper()) if head[1] else (s,))}
    return "".join(sorted(both))


def lookup(mapping: dict, key: Column, default) -> Column:
    """Literal map lookup with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Ordered CASE expression: the first true condition gives the value."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def dimension(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small fixed table as an inline literal: no files, no Python worker."""
    return spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{ddl}>>")))
    )


def count_literal(col: Column, literal: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
