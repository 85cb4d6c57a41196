"""SQL surface: a table function that scans a text, and the SQL risk function.

``scan_text`` is a SQL function: its body is one expression over the built-in functions with the rules as literals, so a
query that uses it has no Python in its plan and is optimised like any other.  The scan plan is the way to scan a table:
it finds positions in linear time, this one in the square of a text's matches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cipherlake.functions.text import java_pattern
from cipherlake.operators import risk
from cipherlake.operators.rules import Rule, l0_rules


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _words(words: list[str]) -> str:
    return "array(" + ", ".join(map(_quoted, words)) + ")" if words else "cast(array() as array<string>)"


def _rule_struct(r: Rule) -> str:
    listed = f"'languages', {_words([x.lower() for x in r.languages])}, 'guards', {_words(r.guards)}"
    return f"named_struct('rule_id', {_quoted(r.rule_id)}, 'severity', {_quoted(r.severity)}, {listed}, 'regex', {_quoted(java_pattern(r.pattern))})"


def scan_expression(rules: list[Rule]) -> str:
    """Array of all matches in ``content`` of the rules for ``language``, in the order of rules and positions.

    A rule's literals are looked for before its pattern is tried.  A match's place follows from the text before it: the
    pieces between matches and the matches themselves."""
    listed = "array(" + ", ".join(map(_rule_struct, rules)) + ")"
    applies = "size(r.languages) = 0 or array_contains(r.languages, '*') or array_contains(r.languages, lower(language))"
    guarded = "size(r.guards) = 0 or exists(r.guards, g -> contains(low, g))"
    hit = f"filter({listed}, r -> ({applies}) and ({guarded}) and rlike(content, r.regex))"
    cut = f"transform({hit}, r -> named_struct('r', r, 'pieces', split(content, r.regex, -1), 'matches', regexp_extract_all(content, r.regex, 0)))"
    before = "array_join(zip_with(slice(h.pieces, 1, i + 1), slice(h.matches, 1, i), (p, q) -> concat(p, coalesce(q, ''))), '')"
    found = f"transform(h.matches, (m, i) -> named_struct('text', m, 'head', {before}))"
    row = ("named_struct('rule_id', h.r.rule_id, 'line', size(split(f.head, '\\n', -1)), 'column', octet_length(substring_index(f.head, '\\n', -1)) + 1,"
           " 'pos', length(f.head), 'match_text', f.text, 'severity', h.r.severity)")
    return f"flatten(transform(array(lower(content)), low -> flatten(transform({cut}, h -> transform({found}, f -> {row})))))"


def register(spark: SparkSession, rules: list[Rule] | None = None) -> None:
    """``SELECT ... FROM texts t, LATERAL scan_text(t.content, t.path, t.language)``: one row per match, with the positions
    of the first stage before its floor and its one-match-a-line rule."""
    body = scan_expression(l0_rules() if rules is None else rules)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION scan_text(content STRING, path STRING, language STRING)"
              " RETURNS TABLE (rule_id STRING, line INT, `column` INT, pos INT, match_text STRING, severity STRING)"
              f" RETURN SELECT m.rule_id, m.line, m.column, m.pos, m.match_text, m.severity FROM (SELECT explode({body}) AS m)")
    risk.register_sql_functions(spark)
