"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed patterns with their checks and always stay. Looser patterns name further candidates:
disguised mail addresses, long and defanged network addresses, cards and phone numbers in other notations. Labelers vote
on every candidate, for, against or not at all: the pattern it comes from, gazetteers (top-level domains, issuer numbers,
reserved networks), the words before it, the characters around it, and digit counts and checksums. Expectation-
maximisation over the counts of vote patterns estimates each labeler's reliability and each pattern's probability; a
logistic classifier of span features, trained on those probabilities, decides on candidates that don't overlap a base
span, and alone: votes against are features like others, with the weight that training gives them.

Texts are cut at the matches inside their task; only short pieces are exchanged, keyed by document and pattern, where
running sums give code-point offsets. Vote patterns and feature patterns are few whatever the corpus (their number is
bounded by the labelers), so the driver fits on counts. Patterns are written without backtracking over long runs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm.common import cut
from cipherlake.llm.op1_lines import row_key

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# gazetteers and context words of labelers, and looser patterns
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "ch", "at", "nl", "be", "pl", "jp", "cn", "in", "br", "au")
_AT, _DOT = r" ?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}) ?", r"(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}) ?| dot |\.)"
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}|\\?@| at (?=(?:[A-Za-z0-9-]{{1,63}} dot ){{1,3}}(?:{'|'.join(DOMAINS)})\b))[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}})+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])|(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9._/-])[0-9]{4}([._/ ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9._/-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z.-])|(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{1,4}\)?[ .-]?){2,5}(?![0-9A-Za-z.-])",
}
_GUARD = {
    ("email", True): "@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): "[0-9]", ("phone", True): r"\+[0-9]",
    ("email", False): r"(?i)[\[({] ?at ?[\])}]|\\@| dot ", ("ip", False): r"(?i)[0-9a-f]:[0-9a-f]{1,4}:|[\[(](?:\.|dot)[\])]", ("card", False): r"[0-9]{4}[._/ ][0-9]{4}", ("phone", False): r"[0-9]{3}[-. )]",
}
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|3[68]|6011|65|62|35)"
RESERVED = r"^(?:0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)"
WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|reach|write|correo|courriel|kontakt|adress?e?)\W{0,4}(?:\w+\W{1,3})?$",
    "ip": r"(?i)(?:\bip|ipv6|host|server|address|addr|client|adresse|dirección)\W{0,4}(?:\w+\W{1,3})?$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\W{0,4}(?:\w+\W{1,3})?$",
    "phone": r"(?i)(?:phone|\btel|telefon|call|mobile|cell|fax|handy|téléphone|teléfono|portable|móvil|whatsapp)\W{0,4}(?:\w+\W{1,3})?$",
}
AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|figure|section|chapter|sha|hash|token|serial|build|page|lines?)\W{0,4}$"
# a candidate is as likely true as false before any vote: base spans, nearly all true, say nothing of the looser ones'
# share; where hardly any vote is against, labelers keep part of their first reliability
BALANCE, PRIOR = 0.5, 0.5
LABELERS = ("pattern", "gazetteer", "words", "edges", "digits")
FEATURES = ("pattern", "gazetteer", "words_for", "words_against", "open_left", "open_right", "digits", "separated", "long")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the checksum."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _parts_fit(match: Column) -> Column:
    """True where no number between dots is above 255, leading zeros aside."""
    plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def valid(kind: Column, match: Column) -> Column:
    """The checks of base spans."""
    n = F.length(_digits(match))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", _parts_fit(match))
            .when(kind == "card", n.between(12, 19) & luhn(_digits(match))).otherwise(n.between(9, 15)))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All matches of all patterns, once for rows equal in id and text: key, kind, base, start, end, match, before, after."""
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    none = F.array().cast("array<string>")
    found = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind, pattern in patterns.items():
            hit = F.rlike("text", F.lit(_GUARD[kind, base]))
            found.append(F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias("found"),
                                  F.when(hit, F.split("text", pattern, -1)).otherwise(none).alias("pieces")))
    rows = keyed.where(F.rlike("text", F.lit(r"(?i)[0-9@]|[\[({] ?at ?[\])}]| dot "))).select("key", F.explode(F.array(*found)).alias("p")).where(F.size("p.found") > 0).select("key", "p.*")
    pieces = F.transform("found", lambda m, i: F.struct(i.alias("i"), m.alias("match"), F.length(F.get("pieces", i)).alias("gap"), F.right(F.get("pieces", i), F.lit(40)).alias("before"),
                                                        F.left(F.get("pieces", i + 1), F.lit(20)).alias("after")))
    # rows of equal keys are one document: their pieces count once in the sums
    rows = rows.select("key", "kind", "base", F.explode(pieces).alias("x")).select("key", "kind", "base", "x.*").dropDuplicates(["key", "kind", "base", "i"])
    upto = W.partitionBy("key", "kind", "base").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.length("match")).over(upto)
    return rows.withColumn("end", end).select("key", "kind", "base", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after")


def votes(rows: DataFrame) -> DataFrame:
    """A vote of each labeler (1, -1, or 0: none) and the features of each candidate."""
    kind, match, digits = F.col("kind"), F.col("match"), _digits(F.col("match"))
    n = F.length(digits)
    domain = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    gazetteer = (F.when(kind == "email", vote(domain.isin(*DOMAINS), F.rlike(domain, F.lit("^[0-9-]+$"))))
                 .when(kind == "ip", vote(F.lit(False), F.rlike(match, F.lit(RESERVED))))
                 .when(kind == "card", vote(F.rlike(digits, F.lit(ISSUERS)), F.rlike(digits, F.lit(r"^(?:([0-9])\1+|0)")))).otherwise(vote(F.lit(False), F.rlike(digits, F.lit(r"^([0-9])\1+$")))))
    words = F.lit(0)
    for k, pattern in WORDS.items():
        words = F.when((kind == k) & F.rlike("before", F.lit(pattern)), 1).otherwise(words)
    against = F.rlike("before", F.lit(AGAINST))
    left, right = F.rlike("before", F.lit(r"[\p{L}\p{N}/_#$]$")), F.rlike("after", F.lit(r"^[\p{L}\p{N}=/_#$]"))
    check = (F.when(kind == "email", vote(F.length(match).between(6, 120), F.length(match) > 254))
             .when(kind == "ip", F.when(F.instr(match, ":") > 0, 1).when(_parts_fit(F.regexp_replace(match, r"[^0-9]+", ".")), 1).otherwise(-1))
             .when(kind == "card", F.when(n.between(12, 19) & luhn(digits), 1).otherwise(-1)).otherwise(vote(n.between(9, 15), (n < 7) | (n > 15))))
    return rows.withColumns({
        "pattern": F.when(F.col("base"), 1).otherwise(0), "gazetteer": gazetteer, "words": F.when(against, -1).otherwise(words), "edges": F.when(left | right, -1).otherwise(1), "digits": check,
        "words_for": words, "words_against": against.cast("int"), "open_left": (~left).cast("int"), "open_right": (~right).cast("int"), "separated": F.rlike(match, F.lit(r"[^A-Za-z0-9]")).cast("int"),
        "long": (F.length(match) > 24).cast("int"),
    })


def reliabilities(counts: Iterable[tuple[tuple[int, ...], float]], rounds: int = 50, balance: float | None = None, prior: float = 0.0) -> tuple[float, np.ndarray]:
    """EM over vote patterns with their counts: the share of true candidates (estimated, or held at `balance`) and, for each
    labeler, the chances of a vote against, none, for (columns) given a false or a true candidate (rows). Labelers start
    out better than chance; that belief counts as much as four candidates, or as `prior` times all there are."""
    patterns = [(np.array(v), n) for v, n in counts]
    share, chance = balance or 0.5, np.tile(np.array([[0.45, 0.3, 0.25], [0.1, 0.3, 0.6]]), (len(LABELERS), 1, 1))
    believed = chance * max(4.0, prior * sum(n for _, n in patterns))
    for _ in range(rounds):
        total, hits = np.array([1.0, 1.0]), believed.copy()
        for v, n in patterns:
            p = probability(share, chance, v)
            total += n * np.array([1 - p, p])
            for k, x in enumerate(v):
                hits[k, :, x + 1] += n * np.array([1 - p, p])
        share, chance = balance or total[1] / total.sum(), hits / hits.sum(2, keepdims=True)
    return share, chance


def probability(share: float, chance: np.ndarray, vote: np.ndarray) -> float:
    """Chance that a candidate with these votes is true. A labeler that doesn't vote says nothing."""
    logs = np.log([1 - share, share])
    for k, x in enumerate(vote):
        if x:
            logs = logs + np.log(chance[k, :, x + 1] / (chance[k, :, 0] + chance[k, :, 2]))
    return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))


def classifier(rows: list[tuple[np.ndarray, float, float]], rounds: int = 50, pull: float = 0.1) -> np.ndarray:
    """Weights (the last is the bias) of a logistic classifier of feature patterns with (probability, count), by Newton's
    method. The pull towards zero is in counts, so that a rare pattern tells as much in a large corpus as in a small one."""
    x = np.array([[*f, 1.0] for f, _, _ in rows]).reshape(-1, len(FEATURES) + 1)
    p, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)

    def loss(w: np.ndarray) -> float:
        return float(n @ (np.logaddexp(0, x @ w) - p * (x @ w)) + pull * w @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(rows) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (q - p)) + pull * w
        step = np.linalg.solve((x.T * (n * q * (1 - q))) @ x + pull * np.eye(len(w)), slope)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _accepted(cands: DataFrame) -> DataFrame:
    """Candidates of loose patterns that the classifier of their kind takes."""
    table = cands.groupBy("kind", *LABELERS, *[f for f in FEATURES if f not in LABELERS]).agg(F.count("*").alias("n")).collect()
    score = F.lit(-1.0)
    for kind in KINDS:
        own = [r for r in table if r["kind"] == kind]
        merged: dict[tuple, float] = {}
        for r in own:
            v = tuple(r[c] for c in LABELERS)
            merged[v] = merged.get(v, 0) + r["n"]
        share, chance = reliabilities(sorted(merged.items()), balance=BALANCE, prior=PRIOR)
        rows = sorted((tuple(r[c] for c in FEATURES), probability(share, chance, np.array([r[c] for c in LABELERS])), r["n"]) for r in own)
        w = classifier(rows)
        linear = sum((F.col(c) * F.lit(float(x)) for c, x in zip(FEATURES, w, strict=False)), F.lit(float(w[-1])))
        score = F.when(F.col("kind") == kind, linear).otherwise(score)
    return cands.where(~F.col("base") & (score > 0))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, kind, start, end, base, match) of all personal data; key as of row_key()."""
    cands = cut(votes(matches(docs, id_col, text_col)))
    base = cands.where("base").where(valid(F.col("kind"), F.col("match")))
    added = _accepted(cands.where(~F.col("base") | valid(F.col("kind"), F.col("match"))))
    columns = ("key", "kind", "start", "end", "base", "match")
    every = base.select(*columns).unionAll(added.select(*columns))
    # an added span must not overlap a base span, nor an added one that starts before it
    order = [F.col("start"), F.col("base").desc(), F.col("end").desc(), F.col("kind")]
    before = W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("key").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    marked = every.withColumn("free", (reach <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end")))
    return marked.where("base or free").drop("free")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and found, all its spans by start and kind as array<struct<start, rank, kind, end, base,
    match>> (offsets in code points, end exclusive; rank is the kind's place in KINDS).

    Null and empty texts have none. Rows of equal ids are rows of their own; rows equal in id and text have equal spans.
    Other columns aren't looked at; an empty table gives no rows."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("rank")
    own = spans(docs, id_col, text_col).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", rank, "kind", "end", "base", "match"))).alias("found"))
    keys = docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    none = F.array().cast(own.schema["found"].dataType)
    return keys.join(own, "key", "left").select(id_col, F.coalesce("found", none).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "text_redacted") -> DataFrame:
    """(id, text with a tag in place of each span). Overlapping spans, which only base patterns of different kinds can
    give, are replaced as one, with the tag of the first."""
    marks = spans(docs, id_col, text_col)
    before = W.partitionBy("key").orderBy("start", F.col("end").desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    whole = marks.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(-1)))
    group = W.partitionBy("key").orderBy("start", F.col("end").desc(), "kind")
    whole = whole.withColumn("run", F.sum(F.when(F.col("start") >= F.col("reach"), 1).otherwise(0)).over(group))
    runs = whole.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", F.negate("end"), "kind")).alias("kind"))
    runs = runs.withColumn("from", F.coalesce(F.lag("end").over(W.partitionBy("key").orderBy("start")), F.lit(0)))
    own = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("runs"))
    keyed = docs.select(F.col(id_col), F.col(text_col), row_key(F.col(id_col), F.col(text_col)).alias("key")).join(own, "key", "left")
    pieces = F.transform("runs", lambda r: F.concat(F.substring(F.col(text_col), (r["from"] + 1).cast("int"), (r["start"] - r["from"]).cast("int")), F.lit("<"), r["kind"], F.lit(">")))
    tail = F.substring(F.col(text_col), (F.element_at("runs", -1)["end"] + 1).cast("int"), F.length(F.col(text_col)))
    return keyed.select(id_col, F.when(F.col("runs").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias(target))
