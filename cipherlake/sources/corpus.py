"""Corpus sources: files on storage, text tables, and the derived test corpora."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P


def read_files(spark: SparkSession, root: str, max_size: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Files under a root, all of them by default.  A size limit is pushed into the source, so the bytes of larger
    files are never read; drop ``content`` to list without reading at all (binary files of over 2 GiB can only be
    listed)."""
    root_depth = len(root.rstrip("/").split("/"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw if max_size is None else raw.filter(F.col("length") <= max_size)
    path = F.regexp_replace("path", "^file:/+", "/")
    out = raw.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    return out if max_depth is None else out.filter(P.depth(F.col("path")) - root_depth <= max_depth)


HEAD_BYTES = 1024
WHOLE_BYTES = 64 << 20  # files up to this size are read as one value


def file_heads(spark: SparkSession, root: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, modified, head): all files under a root with their first bytes, for ``looks_binary``.

    A value holds less than 2 GiB, and a task several copies of it, so files over ``whole_bytes`` are listed by Spark, and
    their heads are read through the file system of their path, one kilobyte each, by threads of the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumnRenamed("modificationTime", "modified")
    head = F.substring("content", 1, HEAD_BYTES)
    small = raw.filter(F.col("length") <= whole_bytes).select("path", "length", "modified", head.alias("head"))
    large = raw.filter(F.col("length") > whole_bytes).select("path", "length", "modified")
    conf, hadoop = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs

    def first_bytes(row) -> tuple[str, bytes]:
        path = hadoop.Path(row["path"])
        stream = path.getFileSystem(conf).open(path)
        try:
            return row["path"], bytes(stream.readNBytes(HEAD_BYTES))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(first_bytes, large.select("path").toLocalIterator()))
    if heads:
        small = small.unionByName(large.join(spark.createDataFrame(heads, "path string, head binary"), "path"))
    return small.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def oversized(files: DataFrame, max_size: int = V.MAX_FILE_SIZE) -> DataFrame:
    """(path, length, reason) of the files that a size limit leaves out."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    return files.filter(size > max_size).select("path", size.cast("bigint").alias("length"), F.lit("too_large").alias("reason"))


def decode_text(files: DataFrame) -> DataFrame:
    """Bytes to text; broken UTF-8 is replaced, never an error."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def looks_binary(content: Column) -> Column:
    """First 1024 bytes hold a zero byte, or more than 30 % control bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    n_ctrl = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.coalesce(head.contains("\x00")
                      | ((F.length(head) > 0) & (n_ctrl / F.greatest(F.length(head), F.lit(1)) > 0.3)),
                      F.lit(False))


def read_failures(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """(path, error) of files a scan can't take as they are, to keep beside its findings: larger than a limit that the
    caller sets, binary by name, or text with broken UTF-8 (which is scanned with the broken bytes replaced)."""
    raw = F.col("content").cast("binary")
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    large = F.lit(False) if max_size is None else size > max_size
    error = F.when(large, "too large").when(P.is_binary_extension(F.col("path")), "binary").when(~F.is_valid_utf8(raw.cast("string")), "broken text")
    return files.select("path", error.alias("error")).filter(F.col("error").isNotNull())


def text_corpus(df: DataFrame, path: Column, content: Column, repo: Column | None = None) -> DataFrame:
    """Use any text table as the corpus."""
    repo = F.split(path, "/")[0] if repo is None else repo
    return df.select(path.alias("path"), repo.alias("repo"), content.alias("content"))


def select_files(files: DataFrame, patterns: list[str] | None = None, variant: str = "base",
                 max_size: int | None = None) -> DataFrame:
    """Ignore patterns, binary names and (where given) a size limit, all on path and length only."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    path = F.col("path")
    keep = ~P.is_ignored(path, patterns, variant)
    if variant == "base":
        keep = keep & ~P.is_binary_name(path)
    return files.filter(keep if max_size is None else keep & (size <= max_size))


def drop_binary(files: DataFrame) -> DataFrame:
    """Binary sniff on content, skipped for known text names."""
    return files.filter(P.is_known_text(F.col("path")) | ~looks_binary(F.col("content").cast("binary")))


def latest_objects(files: DataFrame, n: int = 10) -> DataFrame:
    """The newest n objects (top-k, no global sort)."""
    newest = files.select("path", "modified").orderBy(F.desc("modified"), "path").limit(n)
    return files.join(newest.select("path"), "path", "left_semi")


def not_yet_scanned(files: DataFrame, done: DataFrame) -> DataFrame:
    """(path, content_hash) of the files without a stored result for that path and content.  Texts are hashed where
    they are and only the keys meet ``done``; read the files of these paths next (a text table bucketed by path meets
    them without moving)."""
    keyed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return keyed.join(done.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def not_yet_listed(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Listed files (path, length, modified) without a stored result of the same length and time; no file is read."""
    keys = ["path", "length", "modified"]
    return listing.drop("content").join(done.select(*keys), keys, "left_anti")


def paths_differ(files: DataFrame) -> bool:
    """Whether no two files share a path, so that ids made of a path and a place in the file are unique.  Only paths are
    read and counted."""
    return not files.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count()


MARKER = r"suppress:([\w*-]+)(?:\s+(line|block|file))?"


def suppressed_as_a_whole(content: Column) -> Column:
    """A line whose first marker is ``suppress:* file``; found in the row, so the text meets no table of markers."""
    first = r"(?dm)^(?:(?!suppress:[\w*-])[^\n])*+suppress:\*[^\S\n]+file"
    return F.coalesce(content.contains("suppress:*") & content.rlike(first), F.lit(False))


def inline_suppressions(files: DataFrame) -> DataFrame:
    """``suppress:<rule>`` comment markers with an optional scope (line, block, file)."""
    marker = MARKER
    lines = (files.filter(F.col("content").contains("suppress:"))
             .select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
             .filter(F.col("text").rlike(marker)))
    scope = F.regexp_extract("text", marker, 2)
    return lines.select("path", (F.col("i") + 1).alias("line"),
                        F.regexp_extract("text", marker, 1).alias("rule_id"),
                        F.when(scope == "", F.lit("line")).otherwise(scope).alias("scope"))


def file_context(files: DataFrame, variant: str = "scan") -> DataFrame:
    """Path-derived columns every later stage uses."""
    path = F.col("path")
    return files.withColumns({
        "language": P.language(path, variant),
        "is_vendored": P.is_vendored(path),
        "is_generated": P.is_generated(path),
        "is_test": P.is_test(path),
    })


# ---------------------------------------------------------------------------
# Corpora derived from the given tables
# ---------------------------------------------------------------------------

# (path middle and suffix, lines of code)
SNIPPETS: list[tuple[str, str, list[str]]] = [
    ("/src/", ".go", ["package main", 'import "crypto/rsa"',
                      "func load(r *http.Request) { user := request.Form }",
                      "key, err := rsa.GenerateKey(rand.Reader, 2048)", "weak, _ := rsa.GenerateKey(rand.Reader, 1024)"]),
    ("/pkg/", "_test.go", ["package pki", 'import "crypto/ecdsa"', "func TestSign(t *testing.T) {",
                           "k, err := ecdsa.GenerateKey(elliptic.P256(), rand.Reader)",
                           "assert.Equal(t, 256, k.Size()) // mock signer"]),
    ("/src/main/", ".java", ["import java.security.KeyPairGenerator;",
                             'KeyPairGenerator kpg = KeyPairGenerator.getInstance("RSA");', "kpg.initialize(1024);",
                             'MessageDigest md = MessageDigest.getInstance("MD5");']),
    ("/app/", ".py", ["import hashlib", "def digest(path):", "    data = open(path).read()",
                      "    user = input.get('name') or form.name",
                      "    return hashlib.md5(data).hexdigest() + hashlib.sha1().hexdigest()"]),
    ("/lib/", ".js", ["const crypto = require('crypto');", "const raw = query.name + process.env.SALT;",
                      "const h = crypto.createHash('md5').update(raw);",
                      "const p = crypto.generateKeyPair('rsa'); crypto.publicEncrypt(p, raw);"]),
    ("/crypto/evp/", ".c", ["#include <openssl/rsa.h>", "enum SSL_VERSION { TLS_1_0, TLS_1_2 };",
                            "RSA *k = RSA_generate_key(1024, 65537, 0, 0); EC_KEY_generate_key(ec);",
                            "EVP_MD_CTX_init(&c, EVP_sha1()); /* digest */"]),
    ("/src/", ".rs", ["use rsa::RsaPrivateKey;", "let key = RsaPrivateKey::generate(&mut rng, 2048)?;",
                      "let sig = ecdsa::SigningKey::random(&mut rng);", "let h = sha256::digest(secret);"]),
    ("/vendor/lib/", ".go", ["package sha1", "h := sha1.New()", "sum := md5.New() // vendored copy"]),
    ("/src/net/", ".cs", ["using System.Security.Cryptography;", "var rsa = RSA.Create();",
                          "var p = new RSACryptoServiceProvider (2048);", "byte[] h = SHA256.HashData(buf);"]),
    ("/lib/", ".rb", ["require 'rbnacl'", "key = RbNaCl::SigningKey.generate",
                      "box = RbNaCl::SimpleBox.from_secret_key(secret)", "tag = RbNaCl::HMAC::SHA256.auth(k, m)",
                      "RbNaCl::Random.random_bytes(32)"]),
    ("/docs/", ".md", ["# Notes", "RSA, ECDSA and MD5 are explained here.", "Use TLS and https with a certificate."]),
    ("/config/", ".kconfig", ["config MBEDTLS_TLS12", "bool \"enable tls cipher suite\"",
                              "modules/net/ssl_client", "# default cipher list"]),
    ("/drivers/", ".c", ["/* atari falcon ide driver, compatible = \"motorola,falcon\" */",
                         "static int falcon_ide_init(void) { return pata_falcon(512); }"]),
    ("/src/pq/", ".py", ["from oqs import KeyEncapsulation", "signer.init('falcon-512', None)",
                         "kem = KeyEncapsulation('kyber768')", "hybrid = rsa_key + kyber_key  # hybrid crypto",
                         "sig = dilithium3.sign(message)"]),
    ("/tests/", ".ts", ["import { expect } from 'jest';", "const ssl = conf.set('ssl', true);",
                        "expect(crypto.createHash('sha1')).toBeDefined();"]),
    ("/src/hash/", ".go", ["package hash", "hasher := md5.New() // checksum of object uid",
                           "rsa.generate(request.URL)", "aes.new(key)", "blowfish.create(1)"]),
    ("/src/resolve/", ".c", ["case DNSSEC_ALGORITHM_RSASHA1: return EVP_sha1();",
                             "SSL_CTX_new(TLS_client_method()); /* suppress:dns-tls-client-usage block */",
                             "switch (algorithm) { case X: dns_tls_connect(fd); }"]),
    ("/images/", ".png", ["PNG header", "IHDR"]),
]
# root-level project files, one of them per repository and size class
MARKERS = ["go.mod", "package.json", "Cargo.toml", "requirements.txt", "README", "Makefile", "yarn.lock", "setup.py"]


# rows of a seed table that one task turns into files
SEED_ROWS = 5_000


def deal_rows(seed: DataFrame, key: str) -> DataFrame:
    """Short rows dealt over tasks by key.  A table of a few row groups is read by as few tasks, and a row that becomes a
    file costs far more to scan than to move; the files themselves are built after this exchange.  The number of tasks
    grows with the rows and is at least twice the cores, so it is given, not left to be merged by size.  The dealt rows
    pass a generator, or filters on the files would be pushed below the exchange and build them in the tasks that read."""
    n = seed.select(F.lit(1)).count()
    tasks = max(2 * seed.sparkSession.sparkContext.defaultParallelism, -(-n // SEED_ROWS))
    dealt = seed.repartition(max(1, min(tasks, -(-n // 50))), key)
    return dealt.select(F.inline(F.array(F.struct(*seed.columns))))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-code corpus derived from the ``part`` table, one file per part (plus a project
    file per part whose size is at most 3).  Every third part falls into ``repo0``, so one
    repository holds about a third of all files.  Path and content are functions of the row;
    the snippet list is a small dimension joined by position."""
    part = deal_rows(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    n = len(SNIPPETS)
    mids = F.array(*[F.lit(s[0]) for s in SNIPPETS])
    sufs = F.array(*[F.lit(s[1]) for s in SNIPPETS])
    body = F.array(*[F.lit("\n".join(s[2])) for s in SNIPPETS])
    key = F.col("p_partkey")
    pick = (F.pmod(key, F.lit(n)) + 1).cast("int")
    other = (F.pmod(key + F.col("p_size"), F.lit(n)) + 1).cast("int")
    repo = F.concat(F.lit("repo"), F.when(key % 3 == 0, F.lit(0)).otherwise(key % 20).cast("string"))
    filler = F.repeat(F.concat(F.lit("\nvalue = "), F.col("p_name")), F.col("p_size"))
    main = part.select(
        repo.alias("repo"),
        F.concat(repo, F.element_at(mids, pick), F.lit("f"), key.cast("string"), F.element_at(sufs, pick)).alias("path"),
        F.concat(F.lit("// "), F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit("\n"), F.element_at(body, pick),
                 filler, F.lit("\n"), F.element_at(body, other), F.lit("\n")).alias("content"),
    )
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (F.pmod(key, F.lit(len(MARKERS))) + 1).cast("int"))
    roots = part.filter(F.col("p_size") <= 3).select(
        repo.alias("repo"),
        F.concat(repo, F.lit("/"), F.lit("p"), key.cast("string"), F.lit("/"), marker).alias("path"),
        F.concat(F.lit("name: "), F.col("p_name"), F.lit("\n")).alias("content"),
    )
    return main.unionByName(roots)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose corpus as files; ``source`` plays the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".dat")))
    return docs.select(F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents wrapped in code: long accented texts with matches before and after."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    n = len(SNIPPETS)
    body = F.array(*[F.lit("\n".join(s[2])) for s in SNIPPETS])
    sufs = F.array(*[F.lit(s[1]) for s in SNIPPETS])
    first = (F.pmod(F.col("doc_id"), F.lit(n)) + 1).cast("int")
    last = (F.pmod(F.col("doc_id") + 5, F.lit(n)) + 1).cast("int")
    path = F.concat(F.col("source"), F.lit("/src/d"), F.col("doc_id").cast("string"), F.element_at(sufs, first))
    return docs.select(F.col("source").alias("repo"), path.alias("path"),
                       F.concat(F.element_at(body, first), F.lit("\n"), F.col("text"), F.lit(" "),
                                F.element_at(body, last)).alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files; the URL path is the file path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return pages.select(host.alias("repo"),
                        F.concat(host, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
                        F.col("html").alias("content"))
