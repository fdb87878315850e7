"""Known results of single functions and operators."""

import json

import pytest
from pyspark.sql import functions as F

from siftstone.functions import documents as D
from siftstone.functions import metrics as M
from siftstone.functions import paths as P
from siftstone.functions import text as X
from siftstone.operators import evaluate as V
from siftstone.operators import lexical
from siftstone.operators import index as I
from siftstone.operators import lines as L
from siftstone.operators import search as S
from siftstone.operators.extract import extract_symbols
from siftstone.operators.search import prefer_lexical, sort_distance
from siftstone.plans.workflows import run_suite
from siftstone.sources import files, logs, rules, suites


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_search_text(spark):
    assert column(spark, ["  Global_model-cache!!  ", "ΣΑΣ", "İx"], X.normalize_text) == ["global model cache", "σασ", "ix"]
    assert column(spark, ["database Database sqlite sqlite", ""], X.query_tokens) == [["database", "sqlite"], []]


def test_variants(spark):
    tokens = spark.createDataFrame([("database",), ("libraries",), ("ies",), ("is",)], "token string")
    got = {}
    for row in lexical.expand_variants(tokens).collect():
        got.setdefault(row.token, {})[row.variant] = row.weight
    assert {"database", "databases", "db", "sqlite", "sql"} <= set(got["database"])
    assert got["libraries"] == {"libraries": 1.0, "library": 0.92, "lib": 0.72}
    assert got["ies"] == {"ies": 1.0, "i": 0.92}
    assert got["is"] == {"is": 1.0, "i": 0.92}


def test_router(spark):
    queries = ["hui", "RunCLI", "internal/runtime/model_cache.go", "qwen install", "qwen3 install", "global model cache", ""]
    assert column(spark, queries, X.prefers_lexical) == [True, True, True, False, False, False, False]


def test_prefer_lexical_results(spark):
    rows = spark.createDataFrame(
        [("a", "RunCLI", 0.9, 0.7), ("b", "qwen install", 0.72, 0.95), ("c", "RunCLI", None, 0.1), ("d", "RunCLI", 0.9, None)],
        "query_id string, text string, semantic_distance double, lexical_score double")
    assert {r.query_id: r.prefer_lexical for r in prefer_lexical(rows).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_lexical_scores(spark):
    rows = [("q1", "database", "internal/repository.go", "SQLiteStore\nSQLite repository schema"),
            ("q2", "RunCLI", "internal/cli.go", "RunCLI dispatches search subcommand"),
            ("q3", "hui", "internal/repository.go", "SQLite repository schema")]
    pairs = spark.createDataFrame(rows, "query_id string, text string, path string, body string").select(
        "query_id", "text", X.normalize_text(F.col("body")).alias("text_norm"), X.normalize_text(F.col("path")).alias("path_norm"),
        X.normalize_text(P.base_name(F.col("path"))).alias("base_norm"))
    got = {r.query_id: r.lexical_score for r in lexical.score_pairs(pairs, ["query_id"]).collect()}
    assert got["q1"] > 0 and got["q2"] == 1.0 and got["q3"] == 0.0


def test_path_weights(spark):
    rules_ = {"**/*_test.*": 0.82, "**/examples/**": 0.88, "**/vendor/**": 0.72}
    paths = ["pkg/service.go", "pkg/service_test.go", "./examples/demo_test.go", "vendor/acme/lib.go"]
    assert column(spark, paths, lambda p: P.path_weight(p, rules_)) == [1.0, 0.82, 0.82, 0.72]
    with pytest.raises(ValueError):
        P.check_weights({"**/*_test.*": 1.2})
    low, high = spark.range(1).select(sort_distance(F.lit(0.4), F.lit(1.0)), sort_distance(F.lit(0.4), F.lit(0.82))).first()
    assert high > low


def test_skipped_and_ignored_paths(spark):
    cases = {".": False, "internal/cli.go": False, ".git/config": True, ".semsearch/index.db": True, "README.md": True,
             "docs/README.dev.md": True, "guides/readme.txt": True, "internal/READMEParser.go": False,
             "pkg/readme_utils.py": False, "web/ReadmeClient.ts": False}
    assert column(spark, list(cases), P.is_builtin_skipped) == list(cases.values())
    lines = ["# note", "build/", "!build/keep.txt", "*.log", "!main.log", "/top"]
    paths = ["build/keep.txt", "x/build/a", "a.log", "main.log", "top/a", "x/top", "src/a.go"]
    assert column(spark, paths, lambda p: P.is_ignored(p, lines)) == [False, True, True, False, True, False, False]
    # A directory that is ignored itself stays closed.
    lines = ["build", "!build/keep.txt"]
    assert column(spark, ["build/keep.txt", "keep.txt"], lambda p: P.is_ignored(p, lines)) == [True, False]


def test_binary(spark):
    values = [b"package main\nfunc main() {}\n", b"\x00\x01\x02\x03", b"", b"\x01" + b"a" * 9, b"\x01\x01" + b"a" * 8]
    got = column(spark, [bytearray(v) for v in values], files.is_binary, "binary")
    assert got == [False, True, False, False, True]


def test_directives(spark):
    rows = ["// @search: semantic search entrypoint", "/* @search: block comment works */", "* @filectx: file level context",
            "# @search: shell style", "// @search something", "// regular comment"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "path string, line int, text string")
    got = {r.line: (r.directive, r.payload) for r in L.match_directives(lines).collect()}
    assert got == {0: ("search", "semantic search entrypoint"), 1: ("search", "block comment works"),
                   2: ("context", "file level context"), 3: ("search", "shell style"), 4: ("search", "something")}


def test_annotations(spark):
    content = "\n".join(["// @filectx: file context", "// @search: first comment", "func First() {}", "// regular comment",
                         "// @search second comment", "func Second() {}"])
    df = spark.createDataFrame([("sample.txt", content), ("long.txt", "// @search: x\n" + "y" * (1 << 20))], "path string, content string")
    got = L.extract_annotations(df).orderBy("line").collect()
    long = [r for r in got if r.path == "long.txt"]
    assert len(long) == 1 and len(long[0].body) == 1 << 20
    got = [r for r in got if r.path != "long.txt"]
    assert [(r.line, r.documentation, r.file_context) for r in got] == [
        (1, "file context", "file context"), (2, "first comment", "file context"), (5, "second comment", "file context")]
    assert got[1].body == "func First() {}\n// regular comment\n// @search second comment\nfunc Second() {}"


def test_following_lines(spark):
    df = spark.createDataFrame([("f", "line1\nline2\nline3\nline4\nline5\n")], "path string, content string")
    got = {r.line: r.following for r in L.following_lines(df, 2).collect()}
    assert got[2] == "line3\nline4" and got[4] == "line5" and got[5] == "" and len(got) == 5


SOURCES = {
    "sample.go": "// Package docs.\npackage demo\n\ntype Store interface {\n\t// Get docs.\n\tGet(id string) string\n}\n\nfunc Run() {}\n",
    "sample.ts": "/** Client docs. */\nexport class Client {\n  // Run docs.\n  run(): void {}\n  constructor() {}\n}\n\nexport interface Store {\n"
                 "  get(id: string): string\n}\n\nexport const parse = (value: string) => value\n",
    "sample.py": 'class Client:\n    """Client docs."""\n    # Run docs.\n    def run(self):\n        """Run body docs."""\n        pass\n\n'
                 "def add(a, b):\n    return a + b\n\nLIMIT = 3\nlow = 4\n",
    "sample.rs": "/// Store docs.\npub trait Store {\n    /// Get docs.\n    fn get(&self, id: &str) -> String;\n}\n\n/// PgStore docs.\n"
                 "pub struct PgStore {\n    pool: usize,\n}\n\nimpl PgStore {\n    /// Delete docs.\n    pub fn delete(&self, id: &str) {}\n}\n\n"
                 "pub fn parse(value: &str) -> &str {\n    value\n}\n",
    "sample.sql": "-- @search: query entrypoint\nSELECT 1;\n",
    "empty.go": "package empty\n// @search: supported files never fall back\n",
    "group.go": "package g\n\n// Grouped docs.\nconst (\n\tA, B = 1, 2\n\tC = \"{\"\n)\n\ntype (\n\tS struct {\n\t\tx int\n\t}\n)\n\n"
                "// Close docs.\nfunc (s *S) Close() error { // inner\n\treturn nil\n}\n\nvar limit = 3 // trailing\n",
}


def test_declarations(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    got = {}
    for r in extract_symbols(df).orderBy("path", "line", "name").collect():
        got.setdefault(r.path, []).append(r)
    names = {path: [(r.kind, r.qualified_name) for r in rows] for path, rows in got.items()}
    assert names == {
        "sample.go": [("interface", "Store"), ("method", "Store.Get"), ("function", "Run")],
        "sample.ts": [("class", "Client"), ("method", "Client.run"), ("interface", "Store"), ("method", "Store.get"), ("function", "parse")],
        "sample.py": [("class", "Client"), ("method", "Client.run"), ("function", "add"), ("constant", "LIMIT")],
        "sample.rs": [("interface", "Store"), ("method", "Store.get"), ("struct", "PgStore"), ("method", "PgStore.delete"), ("function", "parse")],
        "sample.sql": [("annotation", "annotation:1")],
        "group.go": [("constant", "A"), ("constant", "B"), ("constant", "C"), ("struct", "S"), ("method", "S.Close"), ("variable", "limit")],
    }
    docs = {(r.path, r.qualified_name): r.documentation for rows in got.values() for r in rows}
    assert docs["sample.py", "Client"] == "Client docs."
    assert docs["sample.py", "Client.run"] == "Run docs.\nRun body docs."
    assert docs["sample.rs", "PgStore"] == "PgStore docs." and docs["sample.rs", "Store.get"] == "Get docs."
    assert docs["group.go", "B"] == "Grouped docs." and docs["group.go", "S.Close"] == "Close docs."
    assert docs["group.go", "limit"] == "trailing"
    assert got["sample.go"][2].file_context == "Package docs."
    assert got["sample.go"][0].body == "interface {\n\t// Get docs.\n\tGet(id string) string\n}"


def test_documents(spark):
    symbol = spark.createDataFrame(
        [("/tmp/internal/model_cache.go", "function", "Resolve", "ModelCache.Resolve", "func Resolve() string", "doc line", "ctx", "func a() {}\r\nfunc b() {}")],
        "path string, kind string, name string, qualified_name string, signature string, documentation string, file_context string, body string")
    gemma = D.build_documents(symbol, F.lit("gemma")).first().document
    assert gemma == ("title: model_cache.go ModelCache.Resolve | text: Path: /tmp/internal/model_cache.go\nKind: function\nName: Resolve\n"
                     "Qualified name: ModelCache.Resolve\nSignature:\nfunc Resolve() string\nDocumentation:\ndoc line\nFile context:\nctx\n"
                     "Body snippet:\nfunc a() {}\nfunc b() {}")
    assert D.build_documents(symbol, F.lit("qwen")).first().document.startswith("Title: model_cache.go ModelCache.Resolve\nPath: ")
    assert column(spark, ["global model cache"], lambda t: D.format_query(F.lit("gemma"), t)) == ["task: code retrieval | query: global model cache"]
    order = [D.fingerprint_of("@search:", "@filectx:", ex) for ex in (["a", "b"], ["b", "a"], ["a"])]
    a, b, c = spark.range(1).select(*order).first()
    assert a == b != c


def test_display(spark):
    assert column(spark, ["/tmp/project/internal/cli.go", "internal/cli.go", "/etc/hosts", "a/./b/../c", "/tmp/project"],
                  lambda p: P.relative_path(p, "/tmp/project")) == ["internal/cli.go", "internal/cli.go", "/etc/hosts", "a/c", "."]
    assert column(spark, [" line one\n\n line   two "], lambda t: X.compact(t, 20)) == ["line one line two"]
    assert column(spark, ["abcdefghijklmnopqrstuvwxyz"], lambda t: X.compact(t, 10)) == ["abcdefg..."]
    assert column(spark, [999.994, 1000.0], M.format_duration_ms, "double") == ["999.99ms", "1.00s"]


def test_scoring(spark):
    hits = spark.createDataFrame(
        [("r", "a", 1, "mux.go", 32), ("r", "b", 1, "o.go", 1), ("r", "b", 3, "mux.go", 32), ("r", "c", 11, "mux.go", 32), ("r", "d", 2, "b.go", 20)],
        "repo string, query_id string, rank int, path string, line int")
    expected = spark.createDataFrame(
        [("r", "a", "mux.go:32"), ("r", "b", "mux.go:32"), ("r", "c", "mux.go:32"), ("r", "d", "a.go:10"), ("r", "d", "b.go:20"), ("r", "e", "x:1")],
        "repo string, query_id string, expected_ref string")
    got = {r.query_id: (r.top1_success, r.top3_success, r.rr, r.observed_rank) for r in V.score_queries(expected, hits).collect()}
    assert got == {"a": (True, True, 1.0, 1), "b": (False, True, 1 / 3, 3), "c": (False, False, 0.0, 0),
                   "d": (False, True, 0.5, 2), "e": (False, False, 0.0, 0)}
    rows = lambda *r: spark.createDataFrame(list(r), "top1_success boolean, top3_success boolean, rr double")
    assert V.aggregate_quality(rows((True, True, 1.0), (False, True, 0.5), (False, False, 0.0))).first().quality_score == 45
    assert V.aggregate_quality(rows((True, True, 1.0), (False, True, 0.5))).first().quality_score == 68
    assert tuple(V.aggregate_quality(rows((True, True, 1.0)).filter("false")).first()) == (0.0, 0.0, 0.0, 0)


def test_latest_run(spark):
    runs = spark.createDataFrame([("r", "cold_index", 1, 278, 16), ("r", "warm_index", 1, 0, 0)],
                                 "repo string, run_kind string, run_no int, indexed_symbols int, indexed_files int")
    row = V.latest_index_run(runs).first()
    assert (row.run_kind, row.indexed_symbols, row.indexed_files) == ("cold_index", 278, 16)


def test_logs(spark):
    out = spark.createDataFrame([(1, " 1. mux.go:32  0.7747\n 2. route.go:177  0.8123\n"), (2, "Loaded\nNo matches found\n"), (3, "weird output\n")],
                                "run int, stdout string")
    got = [(r.run, r.rank, r.path, r.line, r.ok) for r in logs.parse_hits(out).orderBy("run", "rank").collect()]
    assert got == [(1, 1, "mux.go", 32, True), (1, 2, "route.go", 177, True), (2, None, None, None, True), (3, None, None, None, False)]
    index = spark.createDataFrame([(1, "x\nIndexed 278 symbols in 16 files\n"), (2, "Index already up to date\n"), (3, "no")], "run int, stdout string")
    got = [(r.indexed_symbols, r.indexed_files, r.ok) for r in logs.parse_index_log(index).orderBy("run").collect()]
    assert got == [(278, 16, True), (0, 0, True), (0, 0, False)]


def test_suite_files(spark, tmp_path):
    suite = {"suite_id": "s", "suite_version": 1, "name": "s", "repositories": [
        {"id": "r", "url": "u", "commit": "a" * 40, "language": "go",
         "queries": [{"id": "q", "text": "find", "mode": "auto", "expected_hits": ["main.go:12"]}]},
        {"id": "r", "url": "", "commit": "zz", "language": "go", "queries": []}]}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps(suite, indent=1))
    rows = suites.read_suite(spark, str(path))
    assert [tuple(r) for r in suites.expected_hits(rows).collect()] == [("r", "q", "main.go:12")]
    assert {r.violation for r in V.validate_suite(rows).collect()} == {
        "repository has empty url", "repository must pin a 40-character commit sha", "repository must define at least one query",
        "repository is duplicated"}
    assert files.file_revisions(spark, str(path)).first().revision.startswith("sha256:")
    suites.write_report(rows.select("suite_id", F.struct("repo").alias("top_hit")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_rules_and_manifests(spark, tmp_path):
    path = str(tmp_path / "weights.json")
    assert rules.load_path_weights(spark, path) == {}
    assert rules.write_default_weights(path) and not rules.write_default_weights(path)
    assert len(rules.load_path_weights(spark, path)) == 31
    for name, text in (("a", {"version": -2, "source": " Remote ", "remote": {"ci_url": " "}}), ("b", {"source": "moon"}),
                       ("c", {"version": 4, "source": "remote", "remote": {"ci_url": " https://ci "}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
    good, bad = rules.read_manifests(spark, *[str(tmp_path / f"{n}.json") for n in "abc"])
    got = sorted((r.schema_version, r.version, r.source, r.remote and r.remote.ci_url) for r in good.collect())
    assert got == [(1, 0, "remote", None), (1, 4, "remote", "https://ci")]
    assert [r.error for r in bad.collect()] == ["invalid manifest source"]


def test_repository_scan(spark, tmp_path):
    tree = {"keep.go": b"package demo\n", "ignored.go": b"x", "README.md": b"x", ".semsearch/a": b"x", ".git/config": b"x",
            "pkg/__init__.py": b"A = 1\n", "bin/data": b"\x00\x01", ".gitignore": b"ignored.go\n", "deep/a/b/c.txt": b"hi"}
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    scanned = files.scan_repository(spark, str(tmp_path), excludes=["deep/a/b/*.md"])
    listed = [r.path for r in files.hashed_files(scanned).collect()]
    assert listed == [".gitignore", "deep/a/b/c.txt", "keep.go", "pkg/__init__.py"]


def test_repositories_share_query_ids(spark):
    expected = spark.createDataFrame([("r1", "q1", "a.go:1"), ("r2", "q1", "a.go:1")], "repo string, query_id string, expected_ref string")
    hits = spark.createDataFrame([("r1", "q1", 1, "a.go", 1)], "repo string, query_id string, rank int, path string, line int")
    got = {r.repo: r.quality_score for r in run_suite(expected, hits).collect()}
    assert got == {"r1": 100, "r2": 0, "": 50}


def test_modes_are_read(spark):
    rows = [("a", None), ("b", " AUTO "), ("c", "fuzzy"), ("d", "Lexical")]
    queries = spark.createDataFrame([(q, "open store", m, [1.0, 0.0]) for q, m in rows], "query_id string, text string, mode string, query_vector array<float>")
    symbol = {"path": "a.go", "symbol_id": "s", "line": 1, "kind": "function", "name": "openStore", "container": "", "qualified_name": "openStore", "signature": "open store",
              "documentation": "", "body": "open store", "file_context": "", "embedding_hash": "h", "provider": "p", "model_id": "m"}
    symbols = spark.createDataFrame([tuple(symbol.values())], ", ".join(f"{k} {'int' if k == 'line' else 'string'}" for k in symbol))
    vectors = spark.createDataFrame([("h", "p", "m", 2, [1.0, 0.1])], "embedding_hash string, provider string, model_id string, dim int, embedding array<float>")
    got = {r.query_id: r.metric for r in S.auto_search(queries, symbols, vectors, limit=0).collect()}
    assert got["a"] == got["b"] and got["d"] == "lexical" and "c" not in got
    assert [r.query_id for r in S.unknown_modes(queries).collect()] == ["c"]


def test_manifest_refresh(spark):
    columns = "repo string, schema_version int, version long, indexing_hash string, source string, ci_url string"
    local = spark.createDataFrame([(x, s, 1, " h", " Remote", u, True) for x, s, u in (
        ("same", 0, " u "), ("no-url", 1, "u"), ("moved", 1, "u"), ("schema", 1, "u"), ("gone", 1, "u"), ("blank", 1, " "))], columns + ", has_index boolean")
    published = spark.createDataFrame([("same", 1, 1, "h", "", "u"), ("no-url", 0, 1, "h", "", " "), ("moved", 1, 1, "h ", "", "v"), ("schema", 2, 1, "h", "", "u"), ("blank", 1, 1, "h", "", "u")], columns)
    got = {r.repo: r.action for r in I.reconcile_manifests(local, published).collect()}
    assert got == {"same": "up-to-date", "no-url": "up-to-date", "moved": "metadata-refresh", "schema": "metadata-refresh", "gone": "keep-local", "blank": "unbound"}


@pytest.mark.parametrize("path, content, found", [
    ("a.py", "S = 'a ('\n\ndef later(x):\n    return x\n", [("S", None, None), ("later", "def later(x):", "return x")]),
    ("b.py", "@cache\ndef deco():\n    return 1\n\n@frozen\nclass Gone:\n    def lost(self):\n        pass\n\nclass Kept:\n    @property\n    def hidden(self):\n        return 1\n"
             "    def shown(self):\n        return 2\n", [("Kept", "class Kept:", None), ("shown", "def shown(self):", "return 2")]),
    ("c.py", "def many(\n" + "".join(f"    a{i},\n" for i in range(15)) + "):\n    return 1\n", [("many", "def many(\n    a0,\n    a1,\n    a2,", "return 1")]),
    ("d.py", 'def doc():\n    """text ( {\n    def inner(\n    """\n    return 1\n\ndef after():\n    pass\n', [("doc", "def doc():", None), ("after", "def after():", "pass")]),
    ("a.go", "package a\n\nvar q = `one {\n two (`\n\nfunc After() int {\n\treturn '{'\n}\nfunc Last() {}\n", [("q", "q = `one {\n two (`", ""), ("After", "func After() int", None), ("Last", "func Last()", "{}")]),
    ("b.go", "package b\n\nfunc Many(\n" + "".join(f"\ta{i} int,\n" for i in range(16)) + ") int {\n\treturn 1\n}\n", [("Many", "func Many(\n\ta0 int,\n\ta1 int,\n\ta2 int,", "{\n\treturn 1\n}")]),
    ("a.js", "const re = /[({]/\nconst t = `a {\n ( \n`\nfunction later() {\n  return 1\n}\n", [("re", None, None), ("t", None, None), ("later", "function later()", "{\n  return 1\n}")]),
    ("b.js", "function one() { return 1 }\n/* " + "x" * 1_100_000 + " */\nfunction two() { return 2 }\n", [("one", "function one()", "{ return 1 }"), ("two", "function two()", "{ return 2 }")]),
    ("c.js", "function one() {\r\n  return \"(\"\r\n}\r\nfunction two() {}\r\n", [("one", "function one()", None), ("two", "function two()", "{}")]),
    ("a.rs", 'const S: &str = r#"a { ( "#;\nfn f<\'a>(x: &\'a str) -> char { \'{\' }\npub enum E {\n    A,\n}\npub trait T {\n    fn m(&self);\n}\npub fn g() {}\n',
     [("S", None, None), ("f", "fn f<'a>(x: &'a str) -> char", "{ '{' }"), ("E", "pub enum E", None), ("T", "pub trait T", None), ("m", None, None), ("g", "pub fn g()", "{}")]),
])
def test_literals_do_not_nest(spark, path, content, found):
    got = extract_symbols(spark.createDataFrame([(path, content)], "path string, content string")).orderBy("line").collect()
    assert [r.name for r in got] == [name for name, _, _ in found]
    for row, (_, signature, body) in zip(got, found):
        assert signature is None or row.signature == signature
        assert body is None or row.body == body
