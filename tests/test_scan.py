"""The scan against expectations and against a plain loop over the text."""

import re

import pytest
from pyspark.sql import functions as F

from cipherlake.functions import text as T
from cipherlake.operators import rules as RU
from cipherlake.operators import scan as S
from cipherlake.operators import structural as ST
from cipherlake.sources import corpus as C


def as_files(spark, rows):
    return spark.createDataFrame([(f"repo/{n}", "repo", lang, text) for n, lang, text in rows],
                                 "path string, repo string, language string, content string")


# (name, language, text, lowest and highest confidence of the falcon finding, None when there must be none)
FALCON = [
    ("driver.c", "c", "static struct platform board: falcon ide driver for the atari machine", None),
    ("tree.c", "c", 'if (of_find_compatible_node(NULL, "lantiq,falcon-sysctrl")) return;', None),
    ("frame.py", "python", ">>> df = frame([('falcon', 'bird', 389.0), ('lion', 'mammal', 80.5)])", (0.39, 0.41)),
    ("row.py", "python", "row 'falcon', 'bird', 389.0", None),
    ("note.rst", "", "Note: problems on a falcon computer, cause not yet known", None),
    ("signer.go", "go", 'signer.Init("FALCON-512", nil)', (0.4, 1.0)),
    ("plain.go", "go", "keys := falcon.KeyPair(seed)", (0.4, 1.0)),
]


@pytest.mark.parametrize("name,lang,text,want", FALCON)
def test_first_stage_confidence(spark, name, lang, text, want):
    rows = S.l0_scan(as_files(spark, [(name, lang, text)])).filter(F.lower("match_text").contains("falcon") & (F.col("rule_id") == "l0-pq-algorithms")).collect()
    if want is None:
        assert rows == []
    else:
        assert rows and want[0] <= rows[0]["confidence"] <= want[1]


def plain_scan(content, rules, language):
    """Every match with offset, line and byte column, by a loop."""
    out = set()
    for r in rules:
        if r.languages and "*" not in r.languages and language not in r.languages:
            continue
        for m in re.finditer(r.pattern, content, re.ASCII):
            head = content[:m.start()]
            line_start = head.rfind("\n") + 1
            out.add((r.rule_id, m.start(), head.count("\n") + 1, len(head[line_start:].encode()) + 1, m.group(0),
                     content[max(0, m.start() - 50):m.end() + 50]))
    return out


def test_positions_equal_a_plain_loop(spark, sf_dir):
    files = C.file_context(C.mixed_files(spark, sf_dir))
    rules = RU.l0_rules()
    got = {}
    for r in S.l0_candidates(files).select("path", "rule_id", "pos", "line", "col", "match_text", "context").collect():
        got.setdefault(r["path"], set()).add(tuple(r)[1:])
    n = 0
    for f in files.select("path", "language", "content").collect():
        want = plain_scan(f["content"], rules, f["language"])
        assert got.get(f["path"], set()) == want, f["path"]
        n += len(want)
    assert n > 500


def test_dense_matches_and_line_crossing(spark):
    text = "é md5\r\n" * 400 + "md5 sha1 " * 300 + "\nrsa.GenerateKey\n  (x, 2048)\n"
    got = {tuple(r) for r in S.l0_candidates(as_files(spark, [("a.go", "go", text)])).select("rule_id", "pos", "line", "col", "match_text", "context").collect()}
    assert got == plain_scan(text, RU.l0_rules(), "go")
    assert any(r[0] == "go-rsa-keygen" and "\n" in r[4] for r in got)


def test_guards_never_hide_a_match(spark):
    """Each rule fires on a text without its guard test exactly as with it."""
    rules = RU.l0_rules()
    bare = [RU.Rule(**{**r.__dict__, "guards": []}) for r in rules]
    rows = [(f"f{i}.{ext}", lang, text) for i, (mid, ext, lines) in enumerate(C.SNIPPETS) for lang in ("go", "c", "ruby", "python", "java", "rust", "csharp", "javascript")
            for text in ["\n".join(lines)]]
    rows = [(f"{lang}/{n}", lang, t) for n, lang, t in rows]
    f = as_files(spark, rows)
    pick = lambda df: {tuple(r) for r in df.select("path", "rule_id", "pos").collect()}
    assert pick(S.l0_candidates(f, rules)) == pick(S.l0_candidates(f, bare))


def test_first_match_per_line_wins(spark):
    f = as_files(spark, [("a.go", "go", "md5 sha1 md5\nmd5")])
    rows = S.l0_scan(f).filter(F.col("rule_id") == "l0-hash-algorithms").orderBy("line").select("line", "col", "match_text").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "md5"), (2, 1, "md5")]


def test_dedupe_is_idempotent_and_keeps_the_best(spark):
    rows = [("p", 1, 1, "r", "m", 0.4, 5), ("p", 1, 1, "r", "m", 0.9, 7), ("p", 1, 2, "r", "m", 0.1, 9)]
    df = spark.createDataFrame(rows, "path string, line int, col int, rule_id string, message string, confidence double, pos bigint")
    once = S.dedupe_findings(df)
    assert {(r["col"], r["confidence"]) for r in once.collect()} == {(1, 0.9), (2, 0.1)}
    assert S.dedupe_findings(once).count() == 2


def test_key_size_decides_severity(spark):
    rows = [("a.go", "go", "rsa.GenerateKey(rand.Reader, 1024)"), ("b.go", "go", "rsa.GenerateKey(rand.Reader, 2048)"), ("c.go", "go", "rsa.GenerateKey(rand.Reader, 4096)"),
            ("d.java", "java", 'KeyPairGenerator.getInstance("RSA");\n x.y();')]
    got = {r["path"]: (r["severity"], r["key_size"]) for r in ST.l1_scan(as_files(spark, rows)).filter(F.col("crypto_type") == "key_generation").collect()}
    assert got["repo/a.go"] == ("critical", 1024) and got["repo/b.go"] == ("medium", 2048) and got["repo/c.go"] == ("low", 4096)
    assert got["repo/d.java"][0] == "high"


def test_rule_validation_finds_a_broken_pattern(spark):
    rules = [RU.Rule("ok", "a+", "high", message="m"), RU.Rule("bad", "a(", "high", message="m"), RU.Rule("sev", "a", "urgent", message="m")]
    got = {(r["rule_id"], r["problem"]) for r in RU.validate_rules(RU.rules_table(spark, rules)).collect()}
    assert got == {("bad", "pattern does not compile"), ("sev", "invalid severity")}
    assert RU.validate_rules(RU.rules_table(spark)).count() == 0


def test_rules_survive_a_round_trip(spark, tmp_path):
    RU.rules_table(spark, RU.default_rules()).write.json(str(tmp_path / "rules"))
    back = RU.rules_from_table(RU.load_rules(spark, [str(tmp_path / "rules")]))
    assert {(r.rule_id, r.pattern) for r in back} == {(r.rule_id, r.pattern) for r in RU.default_rules()}


def test_plan_has_one_shuffle_of_short_rows(spark, sf_dir):
    """Scanning shuffles matches only: one exchange for the windows and the dedupe, none of file text."""
    f = C.file_context(C.document_files(spark, sf_dir)).withColumn("content", F.concat("content", F.lit(" md5")))
    plan = S.l0_scan(f)._jdf.queryExecution().sparkPlan().toString()
    executed = S.l0_scan(f)._jdf.queryExecution().executedPlan().toString()
    hash_exchanges = [line for line in executed.splitlines() if "Exchange hashpartitioning" in line]
    assert len(hash_exchanges) == 1 and plan


def exchanged_columns(df):
    """Names of the columns that any exchange of the plan moves."""
    found, todo = set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.initialPlan())
            continue
        if "Exchange" in name:
            found |= {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_stay_where_they_are(spark, sf_dir):
    """No exchange moves file texts: layered scan, profile, suppressions, incremental scan."""
    from cipherlake.operators import profile as PR
    from cipherlake.plans import jobs as J

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = C.file_context(C.code_files(spark, sf_dir))
        scan = J.layered_scan(f)
        done = f.filter("repo = 'repo0'").select("path", F.sha2(F.col("content"), 256).alias("content_hash"))
        frames = [scan["L0"], scan["L1"], scan["L2"], scan["findings"], C.not_yet_scanned(f, done), S.rule_scan(f),
                  PR.filter_by_profile(f.select("path", "repo"), PR.ignore_patterns(PR.project_languages(f)))]
        for df in frames:
            moved = exchanged_columns(df)
            assert moved and not moved & {"content", "content_lower", "pieces"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_and_repeated_files_are_scanned(spark):
    """Files over five and over ten MiB give findings, and files of one path don't mix their positions."""
    pad = "value = 1 \n" * 600_000
    rows = [("r/a.go", "r", "go", "x := md5.New()\n" + pad), ("r/a.go", "r", "go", pad + pad + "y := md5.New()\n")]
    f = spark.createDataFrame(rows, "path string, repo string, language string, content string")
    got = sorted((r["pos"], r["line"]) for r in S.rule_scan(f).filter("match_text like '%md5%'").collect())
    assert {p for p, _ in got} >= {5} and max(line for _, line in got) == 1_200_001


def test_rules_of_one_id_keep_their_positions(spark):
    rules = [RU.Rule("dup", "foo", "low", message="a"), RU.Rule("dup", "bar", "high", message="b")]
    f = spark.createDataFrame([("r/a.c", "r", "c", "x foo y bar z foo")], "path string, repo string, language string, content string")
    got = sorted((r["pos"], r["match_text"], r["severity"]) for r in S.rule_scan(f, rules).collect())
    assert got == [(2, "foo", "low"), (8, "bar", "high"), (14, "foo", "low")]
    problems = RU.validate_rules(RU.rules_table(spark, [RU.Rule("e", "x*", "low", message="m"), RU.Rule("p", r"\p{Lu}+foo", "low", message="m"), RU.Rule("n", "(?P<n>a)", "low", message="m")])).collect()
    assert {(r["rule_id"], r["problem"]) for r in problems} == {("e", "pattern matches nothing"), ("n", "pattern does not compile")}


def test_equal_files_are_scanned_each(spark):
    """Rows equal in path and content keep positions of their own, in all three scans."""
    text = "x foo y foo\nmd5(foo) foo é foo"
    rows = [("p", text)] * 3 + [("p", text + " foo"), ("q", text)]
    files = spark.createDataFrame([(f"repo/{p}.go", "repo", "go", t) for p, t in rows], "path string, repo string, language string, content string").repartition(4)
    rules = [RU.Rule("foo", "foo", "high", message="m"), RU.Rule("bar", "fo+", "low", message="n")]
    want = sorted((f"repo/{p}.go", r, t[: m.start()].count("\n") + 1, m.start(), t[max(0, m.start() - 50) : m.end() + 50]) for p, t in rows for r in ("foo", "bar") for m in re.finditer("foo", t))
    assert sorted(tuple(r) for r in S.rule_scan(files, rules).select("path", "rule_id", "line", "pos", "context").collect()) == want
    table = RU.rules_table(spark, rules)
    assert sorted(tuple(r) for r in S.rule_scan_table(files, table).select("path", "rule_id", "line", "pos", "context").collect()) == want
    first = [w[:3] for w in want]
    found = S.l0_scan(files, rules, min_confidence=0.0).select("path", "rule_id", "line").collect()
    assert sorted(tuple(r) for r in found) == sorted((p, r, n) for p, r, n in {w: 1 for w in first} for _ in range(rows.count((p[5:-3], text)) if p == "repo/q.go" else 4))


@pytest.mark.parametrize("pattern", ["x*", r"\b", "^", "(?:foo)?", "a|"])
def test_patterns_that_match_nothing_are_refused(spark, pattern):
    files, rules = as_files(spark, [("a.go", "go", "abxcd")]), [RU.Rule("fine", "abx", "low"), RU.Rule("empty", pattern, "low")]
    with pytest.raises(ValueError, match="empty"):
        S.rule_scan(files, rules)
    with pytest.raises(Exception, match="empty"):
        S.rule_scan_table(files, RU.rules_table(spark, rules)).collect()


def test_an_empty_match_in_the_text_is_an_error(spark):
    with pytest.raises(Exception, match="without characters"):
        S.rule_scan(as_files(spark, [("a.go", "go", "zz foo")]), [RU.Rule("ahead", "(?=foo)", "low")]).collect()


@pytest.mark.parametrize("block", [50, 333])
def test_blocks_of_pieces_change_nothing(spark, block):
    """Positions, contexts and the dedupe by line are the same however a file's pieces are cut into blocks."""
    long_line = "é md5 sha1 (" * 300
    texts = [long_line, long_line + "\r\n" + "md5\n" * 500 + long_line + "\nrsa.GenerateKey\n  (x, 2048)\n" + "sha1 md5 \n\né " * 200, "md5", "\n" * 90 + "md5;" * 120,
             "md5" * 400, "x" * 70 + "md5 " * 101 + "\n", "md5 " * (block - 1), "md5\n" * block, "md5 " * (block + 1), ""]
    files = as_files(spark, [(f"f{i}.go", "go", t) for i, t in enumerate(texts)] + [("f1.go", "go", texts[1])])
    rules = [r for r in RU.l0_rules() if r.rule_id in ("l0-hash-algorithms", "go-rsa-keygen")]
    cols = ["path", "rule_id", "pos", "line", "col", "match_text", "context"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(S.l0_candidates(files, rules, block=block)) == rows(S.l0_candidates(files, rules, block=10**9))
    assert rows(S.l0_scan(files, rules, block=block)) == rows(S.l0_scan(files, rules, block=10**9))
    assert rows(S.rule_scan(files, rules, block=block)) == rows(S.rule_scan(files, rules, block=10**9))
    got = {tuple(r)[1:] for r in S.l0_candidates(files, rules, block=block).filter("path = 'repo/f1.go'").select(*cols).collect()}
    assert got == plain_scan(texts[1], rules, "go")


def test_blocks_bound_the_windows(spark):
    """No window of a file with one very common match holds more than a block, whole lines aside."""
    text = "md5 sha1\n" * 5_000
    rules = [RU.Rule("hash", r"md5|sha1", "high", message="m")]
    found = S.match_positions(S.rule_hits(as_files(spark, [("a.go", "go", text)]), rules, "base"), block=500)
    sizes = [r["count"] for r in found.groupBy("block").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 500
    lines = S.match_positions(S.rule_hits(as_files(spark, [("a.go", "go", text)]), rules, "base"), whole_lines=True, block=501)
    assert lines.groupBy("line").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0
    assert max(r["count"] for r in lines.groupBy("block").count().collect()) <= 503


def test_blocks_need_room_for_contexts(spark):
    with pytest.raises(ValueError, match="pieces"):
        S.rule_scan(as_files(spark, [("a.go", "go", "md5")]), block=10)


def test_derived_files_are_built_by_many_tasks(spark, sf_dir):
    """A seed table of one row group is one task when it is read; the files made from it are not."""
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    assert C.code_files(spark, sf_dir).rdd.getNumPartitions() >= 8


def test_texts_with_marks_are_cut_as_others(spark):
    """The mark that stands around matches may occur in a text."""
    text = f"x{S.MARK} md5 {S.MARK}md5{S.MARK}\nsha1 {S.MARK}{S.MARK}"
    rows = [("r/a.c", "r", "c", text), ("r/b.c", "r", "c", text.replace(S.MARK, "~")), ("r/c.c", "r", "c", S.MARK + "nothing")]
    f = spark.createDataFrame(rows, "path string, repo string, language string, content string")
    rules = [RU.Rule("a", "md5", "low", message="a"), RU.Rule("b", r"sha1\s|md5", "low", message="b")]
    got = {p: sorted((r["rule_id"], r["pos"], r["line"], r["col"], r["match_text"], r["context"].replace(S.MARK, "~")) for r in S.rule_scan(f, rules).filter(F.col("path") == p).collect())
           for p in ("r/a.c", "r/b.c", "r/c.c")}
    want = sorted((r.rule_id, m.start(), text[:m.start()].count("\n") + 1, m.start() - text[:m.start()].rfind("\n"), m.group(), text.replace(S.MARK, "~"))
                  for r in rules for m in re.finditer(r.pattern, text))
    assert got == {"r/a.c": want, "r/b.c": want, "r/c.c": []}


def test_no_scan_method_is_too_long_to_compile(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes, however often they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = S.l0_scan(C.file_context(C.code_files(spark, sf_dir)))._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_no_filter_matches_a_text_a_second_time(spark, sf_dir):
    files = C.file_context(C.code_files(spark, sf_dir))
    plan = S.l0_scan(files)._jdf.queryExecution().optimizedPlan()
    while True:  # the one chain from the findings down to the files
        if plan.nodeName() in ("Filter", "Union"):
            assert "regexp_replace" not in plan.expressions().toString()
        if plan.children().size() != 1:
            break
        plan = plan.children().apply(0)


def test_first_characters_hide_no_match():
    said = {r.pattern: T.first_characters(r.pattern) for r in RU.l0_rules()}
    assert sum(map(bool, said.values())) > 40
    assert T.first_characters(r"(?i)\b(?:md5|sha1|3des)\b") == "3MSms"
    for pattern in (r"(a|b)?c", r"(a|b)|c", r"(a?b|c)", r"(a|)", r"((a)|b)", r"(a|b){0,1}c", r"(?!a)", r"a|b", r"(ab(?i)|cd)", r"\b(a\Q)|b\E|c)", r"(a[x[(]]|b)"):
        assert T.first_characters(pattern) == ""


def test_patterns_with_first_characters_match_the_same(spark):
    text = "\n".join(w.replace("a", x) for x in ("a", "A", "é") for s in C.SNIPPETS for w in s[2]) + "\nMD5 xmd5 rsa.New 1024 ECDSA.generate Falcon-512 test md5 TEST ssl"
    patterns = [r.pattern for r in RU.l0_rules()]
    both = [F.size(F.regexp_extract_all(F.col("t"), F.lit(p), F.lit(0))) for pattern in patterns for p in ("(?d)" + pattern, T.java_pattern(pattern))]
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(str(i)) for i, c in enumerate(both)]).first()
    assert row[0::2] == row[1::2] and sum(n > 0 for n in row[0::2]) > 25


def test_any_literal_leaves_out_words_that_hold_others(spark):
    words = ["tls", "dnstls", "ssl", "ssl", "openssl"]
    texts = ["a dnstls b", "openssl", "SSL", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.any_literal(F.col("t"), words)).collect()]
    assert got == [None if t is None else any(w in t for w in words) for t in texts]


def test_filters_on_files_stay_behind_the_deal(spark, sf_dir):
    """A filter on a text that is built from a seed row runs in the many tasks, not in the one that reads the seed."""
    found = C.code_files(spark, sf_dir).filter(F.col("content").rlike("md5"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.split("RepartitionByExpression")[0].split("\n") if "RLIKE" in line.upper()]
    below = "RepartitionByExpression".join(plan.split("RepartitionByExpression")[1:])
    assert above and "Generate" in plan
    assert all("RLIKE" not in part.split("Relation [")[0].upper() for part in below.split("RepartitionByExpression"))


def test_positions_need_no_sort_and_no_window(spark, sf_dir):
    """Positions, contexts and the dedupe by line are told in the row that holds the text."""
    for found in (S.l0_scan(C.file_context(C.code_files(spark, sf_dir))), S.rule_scan(C.file_context(C.code_files(spark, sf_dir), "base"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("n", [0, 1, S.RUN, S.RUN + 1, 10 * S.RUN + 3])
def test_running_totals_of_any_length(spark, n):
    items = F.lit(list(range(n))).cast("array<bigint>") if n else F.array().cast("array<bigint>")
    got = spark.range(1).select(S.running(items, F.lit(7).cast("bigint"), lambda s, x: s + x)).first()[0]
    assert got == [7 + sum(range(i)) for i in range(n)]


def test_word_lists_are_held_as_by_substring_tests(spark):
    lists = [["md5", "a.b"], [], ["("], ["é+", "x|y"]]
    texts = ["md5 (", "a.b", "axb", "", None, "é+x|y(", "éé x y"]
    want = [[k for k, words in enumerate(lists) if t is not None and any(w in t for w in words)] for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    assert sorted(map(str, (r[0] for r in df.select(T.lists_held(F.col("t"), lists)).collect()))) == sorted(map(str, want))
    flags = spark.createDataFrame([(texts,), ([],), (texts[:1],)], "ts array<string>").select(T.word_flags(F.col("ts"), lists)).collect()
    masks = [sum(1 << k for k in w) for w in want]
    assert [r[0] for r in flags] == [masks, [], masks[:1]]
