"""Every query of the engine with the SQL that must give the same rows. Keys follow the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CODE, Config
from ..functions import paths
from ..functions import text as T
from ..operators import budget, classify, extract, graph, ranking, relations, report, scoring, snapshot
from ..session import cut
from . import corpora, fixtures
from .corpora import D_CLASSIFIED, D_EDGES, D_FILES, D_TRADE, duck_sql, run

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duck_sql(oracle)
        return f

    return register


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Derived files, classified by our own operator."""
    return classify.classify(run(spark, sf, D_FILES).withColumn("is_binary", F.lit(False)))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, D_EDGES).withColumns({"evidence": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "analyzer": F.lit("derived")})


def trade(spark: SparkSession, sf: str) -> DataFrame:
    return cut(run(spark, sf, D_TRADE), "trade")


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixtures.TEXTS.items()), "path string, text string")


def fixture_files(spark: SparkSession) -> DataFrame:
    return classify.classify(fixture(spark).select("path").withColumns({"size_bytes": F.lit(1).cast("long"), "is_binary": F.lit(False)}), Config(support_patterns=tuple([*Config().support_patterns, "**/*.yaml"])))


SEED = "SELECT path FROM (SELECT path, row_number() OVER (ORDER BY doc_id) AS n FROM ({}) c WHERE kind = 'code') s WHERE n IN (2, 5)".format(D_CLASSIFIED)


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The second and the fifth code file by id."""
    return run(spark, sf, SEED)


# ---- scans, classes, scalars

_EXT = " ".join(sorted(x[5:] for x in CODE))


@query(f"SELECT path, kind, language, support_category, content_policy FROM ({D_CLASSIFIED}) c")
def classify_files(spark, sf):
    return files(spark, sf).select("path", "kind", "language", "support_category", "content_policy")


@query(f"SELECT path, parent, name, suffix, CASE WHEN suffix = '' THEN name ELSE name[1 : len(name) - len(suffix)] END AS stem FROM (SELECT path, regexp_extract(path, '^(.*)/', 1) AS parent, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '([.][^./]+)$', 1) AS suffix FROM ({D_FILES}) f) g")
def path_columns(spark, sf):
    return paths.with_path_columns(run(spark, sf, D_FILES)).select("path", "parent", "name", "suffix", "stem")


@query(rf"""SELECT path, regexp_matches(path, '^(.*/)?[^/]*\.py$') AS any_py, starts_with(path, 'src0/') AS below, regexp_matches(path, '(^|/)test_[^/]*$') AS named, regexp_matches(path, '(^|/)m[0-9]\.rs$') AS one FROM ({D_FILES}) f""")
def glob_match(spark, sf):
    f, p = run(spark, sf, D_FILES), F.col("path")
    return f.select("path", paths.matches(p, "**/*.py").alias("any_py"), paths.matches(p, "src0/**").alias("below"), paths.matches(p, "test_*").alias("named"), paths.matches(p, "m?.rs").alias("one"))


@query(f"SELECT path FROM ({D_FILES}) f WHERE NOT (CASE WHEN regexp_matches(path, '(^|/)main[.]py$') THEN false WHEN starts_with(path, 'src1/') THEN true ELSE regexp_matches(path, '[.](go|rs)$') END)")
def ignore_rules(spark, sf):
    rules = paths.parse_ignore_file("# sources\n*.go\n*.rs\nsrc1/\n\n!main.py\n")
    return run(spark, sf, D_FILES).where(~paths.ignored(F.col("path"), rules)).select("path")


@query(f"SELECT path, CASE WHEN chars <= 0 THEN 0 ELSE greatest(1, CAST(floor(chars / 4.0) AS BIGINT)) END AS tokens FROM (SELECT path, length(text) AS chars FROM ({D_FILES}) f JOIN documents d USING (doc_id)) g")
def token_estimate_chars(spark, sf):
    f = run(spark, sf, D_FILES).select("doc_id", "path")
    return f.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").select("path", T.tokens(F.col("text"), "chars").alias("tokens"))


_RATIO = "CASE language WHEN 'python' THEN 3.8 WHEN 'markdown' THEN 3.8 WHEN 'typescript' THEN 3.5 WHEN 'rust' THEN 3.6 WHEN 'toml' THEN 3.6 WHEN 'go' THEN 3.7 WHEN 'json' THEN 3.4 WHEN 'java' THEN 3.9 ELSE 4.0 END::DOUBLE"
_BYTES = f"CASE WHEN size_bytes <= 0 THEN 0 ELSE greatest(1, CAST(trunc(size_bytes / {_RATIO}) AS BIGINT)) END"


@query(f"SELECT path, CASE WHEN n <= 0 THEN 0 ELSE greatest(1, CAST(trunc(n / {_RATIO}) AS BIGINT)) END AS tokens FROM (SELECT c.path, c.language, length(d.text) AS n FROM ({D_CLASSIFIED}) c JOIN documents d USING (doc_id)) g")
def token_estimate_auto(spark, sf):
    f = files(spark, sf).select("doc_id", "path", "language")
    return f.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").select("path", T.tokens(F.col("text"), "auto", language=F.col("language")).alias("tokens"))


@query(f"SELECT path, {_BYTES} AS tokens FROM ({D_CLASSIFIED}) c")
def token_estimate_bytes(spark, sf):
    return files(spark, sf).select("path", T.tokens_from_bytes(F.col("size_bytes"), F.col("language")).alias("tokens"))


@query(f"SELECT language, count(*) AS n, sum(size_bytes) AS bytes FROM ({D_CLASSIFIED}) c GROUP BY language")
def language_histogram(spark, sf):
    return files(spark, sf).groupBy("language").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


_ROLE = "CASE WHEN path IN ('main.py', 'src/main.py', 'cli/main.py') THEN 'entrypoint' WHEN kind = 'code' AND starts_with(name, 'test_') THEN 'test' WHEN contains(lower(path), 'readme') THEN 'docs' WHEN kind = 'support' THEN 'support' ELSE 'unknown' END"
_ROLE_SCORE = f"CASE {_ROLE} WHEN 'entrypoint' THEN 95 WHEN 'test' THEN 55 WHEN 'docs' THEN 35 WHEN 'support' THEN 45 ELSE 20 END"


@query(f"SELECT path, {_ROLE} AS role, {_ROLE_SCORE} AS role_score FROM ({D_CLASSIFIED}) c")
def role_score(spark, sf):
    role = T.role(F.col("path"), F.col("kind"), F.col("language"))
    return files(spark, sf).withColumn("role", role).select("path", "role", T.role_score(F.col("role")).alias("role_score"))


@query(r"SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))) AS fence, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell FROM documents")
def fences_and_cells(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.fence(F.col("text")).alias("fence"), T.table_cell(F.col("text")).alias("cell"))


# ---- relations

_STEM = "CASE WHEN suffix = '' THEN name ELSE name[1 : len(name) - len(suffix)] END"


@query(f"""WITH c AS (SELECT *, lower({_STEM}) AS stem FROM ({D_CLASSIFIED}) x)
SELECT a.path AS src, b.path AS dst, 'test_of' AS kind, CAST(0.85 AS DOUBLE) AS weight, CAST(0.9 AS DOUBLE) AS confidence FROM c a JOIN c b ON replace(replace(replace(a.stem, 'test_', ''), '_test', ''), '.test', '') = regexp_replace(b.stem, '[^a-z0-9]', '', 'g')
WHERE (starts_with(a.name, 'test_') OR ends_with(a.name, '_test.py') OR contains(a.name, '.test.')) AND NOT (starts_with(b.name, 'test_') OR ends_with(b.name, '_test.py') OR contains(b.name, '.test.')) AND a.path <> b.path""")
def test_of_edges(spark, sf):
    return relations.test_of(files(spark, sf)).select("src", "dst", "kind", "weight", "confidence")


@query(f"""WITH c AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS parent FROM ({D_CLASSIFIED}) x WHERE kind = 'code')
SELECT a.path AS src, b.path AS dst, CAST(0.5 AS DOUBLE) AS weight FROM c a JOIN c b USING (parent) WHERE a.path <> b.path QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY b.path) <= 8""")
def same_package_edges(spark, sf):
    return relations.same_package(files(spark, sf)).select("src", "dst", "weight")


_HREF = "SELECT DISTINCT CAST(page_id AS VARCHAR) AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS key FROM pages"


@query(f"WITH k AS ({_HREF}) SELECT a.path AS src, b.path AS dst, min(a.key) AS evidence FROM k a JOIN k b ON a.key = b.key AND a.path <> b.path GROUP BY 1, 2")
def shared_key_edges(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return relations.shared_keys(pages.select(F.col("page_id").cast("string").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("key")))


_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{12,}')) AS word FROM benchmark) w"


@query(f"""SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, w.word AS dst FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_./-]+')) AS run FROM documents) d
JOIN ({_WORDS}) w ON regexp_extract(d.run, '^[\\p{{L}}\\p{{N}}_]+', 0) = w.word""")
def mention_edges(spark, sf):
    """Documents and the words of benchmark items that they mention as whole words, by equi-join."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = b.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{12,})"), F.lit(1))).alias("path")).distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    return relations.mentions(docs, words)


_ALL = f"""SELECT src, dst, kind, weight, confidence, 'a' AS analyzer, 1 AS ord FROM ({D_EDGES}) e UNION ALL
SELECT src, dst, kind, CASE WHEN length(src) % 2 = 0 THEN 0.4 ELSE 1.0 END AS weight, confidence, 'b' AS analyzer, 2 AS ord FROM ({D_EDGES}) e"""


@query(f"SELECT src, dst, kind, weight, confidence, analyzer FROM ({_ALL}) a QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY weight DESC, confidence DESC, ord) = 1")
def edge_dedup(spark, sf):
    e = edges(spark, sf)
    again = e.withColumns({"weight": F.when(F.length("src") % 2 == 0, 0.4).otherwise(1.0), "analyzer": F.lit("b"), "ord": F.lit(2)})
    return relations.dedup(e.withColumns({"analyzer": F.lit("a"), "ord": F.lit(1)}).unionByName(again), "ord").select("src", "dst", "kind", "weight", "confidence", "analyzer")


@query(f"SELECT kind, count(*) AS n FROM ({D_EDGES}) e GROUP BY kind")
def edge_kind_histogram(spark, sf):
    return graph.kind_histogram(edges(spark, sf))


@query(f"WITH e AS ({D_EDGES}) SELECT (SELECT count(*) FROM e) AS edges, count(*) AS nodes, round(2.0 * (SELECT count(*) FROM e) / count(*), 6) AS avg_degree FROM (SELECT src FROM e UNION SELECT dst FROM e) n")
def graph_stats(spark, sf):
    return graph.stats(edges(spark, sf)).withColumn("avg_degree", F.round("avg_degree", 6))


# ---- extraction (on literal texts, as the test tables hold no code)


def _lit(ext: str, regex: str, group: int = 1) -> str:
    return f"SELECT DISTINCT path, unnest(regexp_extract_all(text, '{regex}', {group})) AS spec FROM (SELECT path, replace(text, '¶', chr(10)) AS text FROM (VALUES {fixtures.values(ext)}) t(path, text)) u"


def _specs(spark, ext: str, extractor) -> DataFrame:
    own = fixture(spark).where(F.col("path").rlike(r"\.(?:" + "|".join(x[1:] for x in ext.split()) + r")\z"))
    return own.select("path", F.explode(extractor(F.col("text"))).alias("spec")).distinct()


@query("SELECT * FROM (" + _lit(".ts .tsx .js", r"(?:export|import)\s+(?:[{},*\w\s]*\s+from\s+)?[''\"]([^''\"]+)[''\"]") + " UNION " + _lit(".ts .tsx .js", r"require\s*\(\s*[''\"]([^''\"]+)[''\"]\s*\)") + ") x")
def extract_js(spark, sf):
    return _specs(spark, ".ts .tsx .js", extract.js_imports)


@query("SELECT path, 'mod:' || spec AS spec FROM (" + _lit(".rs", r"\bmod\s+([_\w]+)\s*;") + r") m UNION SELECT path, 'use:' || trim(CASE WHEN contains(spec, '{') THEN split_part(spec, '{', 1) || trim(p) ELSE spec END) AS spec FROM (SELECT path, spec, unnest(CASE WHEN contains(spec, '{') THEN string_split(replace(split_part(spec, '{', 2), '}', ''), ',') ELSE [''] END) AS p FROM (" + _lit(".rs", r"\buse\s+([^;]+?)\s*;") + ") u) v")
def extract_rust(spark, sf):
    return _specs(spark, ".rs", extract.rust_imports)


@query("SELECT * FROM (" + _lit(".go", r"\bimport\s+\"([^\"]+)\"") + ") a UNION SELECT path, regexp_extract(line, '\"([^\"]+)\"', 1) AS spec FROM (SELECT path, unnest(string_split(spec, chr(10))) AS line FROM (" + _lit(".go", r"\bimport\s*[(]([^)]+)[)]") + ") b) c WHERE NOT starts_with(ltrim(line), '//') AND contains(line, '\"')")
def extract_go(spark, sf):
    return _specs(spark, ".go", extract.go_imports)


@query(_lit(".cpp .h .hpp", r"#include\s*[\"<]([^\">]+)[\">]"))
def extract_cpp(spark, sf):
    return _specs(spark, ".cpp .h .hpp", extract.cpp_includes)


@query(_lit(".java", r"\bimport\s(?:\s*static\s)?\s*([_A-Za-z][.\w]*)\s*;"))
def extract_java(spark, sf):
    return _specs(spark, ".java", extract.java_imports)


_CODE_EXT = ".py .ts .tsx .js .rs .go .cpp .h .hpp .java"


@query("SELECT path, string_agg(spec, ',' ORDER BY spec) AS keys FROM (" + " UNION ".join(_lit(_CODE_EXT, r) for r in (r"os\.environ(?:\.get[(]|\[)[''\"](\w+)[''\"]", r"os\.getenv\([''\"](\w+)[''\"]\)", r"process\.env\.(\w+)", r"process\.env\[[''\"](\w+)[''\"]\]")) + ") k GROUP BY path")
def extract_env(spark, sf):
    own = fixture(spark).where(F.col("path").rlike(r"\.(?:" + "|".join(x[1:] for x in _CODE_EXT.split()) + r")\z"))
    return own.select("path", F.array_join(relations.env_keys(F.col("text")), ",").alias("keys")).where("keys <> ''")


def _values(rows, names) -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names})"


@query(_values([
    ("src/app/auth.py", "Auth", "class", 6, 11, None), ("src/app/auth.py", "__init__", "function", 7, 8, "Auth"), ("src/app/auth.py", "login", "function", 10, 11, "Auth"),
    ("src/app/session.py", "Session", "class", 1, 2, None), ("src/app/main.py", "run", "function", 5, 6, None)], "path, name, kind, line_start, line_end, parent"))
def extract_python_symbols(spark, sf):
    """The expected rows of the fixture are derived by hand."""
    facts = extract.python_facts(fixture(spark).where(F.endswith("path", F.lit(".py"))))
    return facts.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.line_start", "s.line_end", "s.parent")


_IMPORTS = [
    ("cmd/main.go", "pkg/db/db.go"), ("cmd/main.go", "pkg/db/more.go"), ("crate/src/auth.rs", "crate/src/token/mod.rs"), ("crate/src/main.rs", "crate/src/auth.rs"),
    ("java/A.java", "other/C.java"), ("java/A.java", "src/main/java/com/example/B.java"), ("native/main.cpp", "native/auth.h"), ("native/main.cpp", "native/deep/utils/helper.hpp"),
    ("src/api/routes.py", "src/app/auth.py"), ("src/api/routes.py", "src/app/__init__.py"), ("src/app/auth.py", "src/app/config.py"), ("src/app/auth.py", "src/app/session.py"), ("src/app/main.py", "src/app/auth.py"), ("src/app/main.py", "src/app/config.py"),
    ("tests/test_auth.py", "src/app/auth.py"), ("web/main.ts", "lib/deep/util.js"), ("web/main.ts", "web/auth.ts"), ("web/main.ts", "web/pages/index.tsx"),
]


@query(_values(_IMPORTS, "src, dst"))
def import_edges(spark, sf):
    """All languages resolved on the fixture; the expected rows are derived by hand."""
    e = extract.import_edges(fixture_files(spark), fixture(spark), aliases={"@lib": "lib"}, module=extract.go_module(fixtures.TEXTS["go.mod"]))
    return e.where("kind = 'import'").select("src", "dst")


@query(_values([("src/api/routes.py", "src/app/auth.py", "type_reference"), ("src/app/auth.py", "src/app/session.py", "inherits"), ("src/app/auth.py", "src/app/session.py", "type_reference"), ("src/app/main.py", "src/app/auth.py", "type_reference"), ("tests/test_auth.py", "src/app/auth.py", "type_reference")], "src, dst, kind"))
def symbol_edges(spark, sf):
    e = extract.symbol_edges(extract.python_facts(fixture(spark).where(F.endswith("path", F.lit(".py")))))
    return relations.dedup(e).select("src", "dst", "kind")


@query(_values([("Dockerfile", "src/app/main.py"), ("Dockerfile", "src/api/routes.py"), ("README.md", "src/app/auth.py"), ("README.md", "src/app/config.py"), ("config/app.yaml", "src/app/main.py"), ("config/app.yaml", "web/main.ts")], "src, dst"))
def mention_fixture(spark, sf):
    """Mentions of code in configuration and documents; the expected rows are derived by hand."""
    f, t = fixture_files(spark), fixture(spark)
    return relations.config_refs(f, t).unionByName(relations.doc_mentions(f, t)).select("src", "dst").distinct()


_NAMES = f"SELECT path AS id, replace(regexp_replace(path, '[.][a-z]+$', ''), '/', '.') AS name FROM ({D_FILES}) f"
_KNOWN = "SELECT DISTINCT source || '.' || lang AS module FROM documents UNION SELECT DISTINCT source FROM documents"


@query(f"SELECT id, name, module AS dst FROM ({_NAMES}) n JOIN ({_KNOWN}) k ON n.name = k.module OR starts_with(n.name, k.module || '.') QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY length(module) DESC) = 1")
def module_longest_prefix(spark, sf):
    names = run(spark, sf, D_FILES).select(F.col("path").alias("id"), F.replace(F.regexp_replace("path", r"\.[a-z]+\z", ""), F.lit("/"), F.lit(".")).alias("name"))
    known = run(spark, sf, _KNOWN).withColumn("dst", F.col("module"))
    return extract.longest_prefix(names, known)


@query(f"SELECT path, replace(regexp_replace(path, '[.]py$', ''), '/', '.') AS module FROM ({D_CLASSIFIED}) c WHERE language = 'python'")
def python_modules(spark, sf):
    return extract.modules(files(spark, sf)).select("path", "module")


@query(_values([("src/app/auth.py", "os,.session.Session,.config.settings".replace(".session", "session").replace(".config", "config"), "Auth", "", 11), ("src/app/main.py", "app.auth.Auth,app.config,json", "", "run", 9)], "path, imports, classes, functions, tokens"))
def outline(spark, sf):
    o = extract.outlines(fixture_files(spark), fixture(spark)).where(F.col("path").isin("src/app/auth.py", "src/app/main.py"))
    return o.select("path", F.array_join("imports", ",").alias("imports"), F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"), F.col("token_estimate").alias("tokens"))


# ---- graph

_ENDS = "SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e"


@query(f"WITH e AS ({D_TRADE}) SELECT node, round(sum(weight), 6) AS degree FROM ({_ENDS}) x GROUP BY node")
def degree_weighted(spark, sf):
    return graph.degree(trade(spark, sf)).select("node", F.round("degree", 6).alias("degree"))


@query(f"WITH e AS ({D_EDGES}) SELECT node, CAST(count(*) AS DOUBLE) AS degree FROM ({_ENDS}) x GROUP BY node")
def degree_raw(spark, sf):
    return graph.degree(edges(spark, sf), weighted=False)


@query(f"WITH e AS ({D_TRADE}) SELECT node, round(sum(weight), 6) AS degree FROM ({_ENDS}) x GROUP BY node ORDER BY 2 DESC, 1 LIMIT 5")
def top_hubs(spark, sf):
    return graph.degree(trade(spark, sf)).select("node", F.round("degree", 6).alias("degree")).orderBy(F.desc("degree"), "node").limit(5)


def _pagerank_sql(rounds: int) -> str:
    steps = ["a AS MATERIALIZED (SELECT DISTINCT src, dst FROM e)", "o AS MATERIALIZED (SELECT src, count(*) AS k FROM a GROUP BY src)", "n AS MATERIALIZED (SELECT node, (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) z) AS c FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) y)", "r0 AS (SELECT node, 1.0::DOUBLE / c AS r, c FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT p.node, coalesce(g.v, 0) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / p.c + 0.15 / p.c AS r, p.c FROM r{i} p LEFT JOIN (SELECT a.dst, sum(q.r * 0.85 / o.k) AS v FROM a JOIN o USING (src) JOIN r{i} q ON q.node = a.src GROUP BY a.dst) g ON g.dst = p.node)")
    return f"WITH e AS ({D_TRADE}), {', '.join(steps)} SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(20))
def pagerank(spark, sf):
    return graph.pagerank(trade(spark, sf), iterations=20, tolerance=0.0).select("node", F.round("rank", 6).alias("rank"))


_REACH = "reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b)"
_NODES = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_SCC = f"WITH RECURSIVE e AS ({D_TRADE}), {_REACH}, {_NODES}, s AS (SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS scc FROM n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = n.node GROUP BY n.node)"


@query(f"{_SCC} SELECT node, scc FROM s")
def scc(spark, sf):
    return graph.scc(trade(spark, sf))


@query(f"{_SCC} SELECT scc, count(*) AS size FROM s GROUP BY scc HAVING count(*) > 1 OR scc IN (SELECT src FROM e WHERE src = dst)")
def cycles(spark, sf):
    return graph.cycles(trade(spark, sf))


_SPARSE = f"SELECT src, dst, kind, weight, confidence FROM ({D_TRADE}) t WHERE weight >= 0.9 OR length(src) % 3 = 0"


@query(f"WITH RECURSIVE e0 AS ({_SPARSE}), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), {_REACH}, {_NODES} SELECT n.node, least(n.node, min(r.b)) AS component FROM n JOIN reach r ON r.a = n.node GROUP BY n.node")
def components(spark, sf):
    return graph.components(cut(run(spark, sf, _SPARSE), "sparse"))


@query(f"""WITH RECURSIVE e AS ({D_TRADE}), {_REACH}, {_NODES}, bad AS (SELECT a AS node FROM reach WHERE a = b), late AS (SELECT node FROM bad UNION SELECT r.b FROM reach r JOIN bad ON bad.node = r.a),
ok AS (SELECT node FROM n WHERE node NOT IN (SELECT node FROM late)), walk(node, d) AS (SELECT node, 0 FROM ok UNION SELECT e.dst, w.d + 1 FROM walk w JOIN e ON e.src = w.node WHERE e.dst IN (SELECT node FROM ok)),
placed AS (SELECT node, max(d) AS layer FROM walk GROUP BY node) SELECT node, layer FROM placed UNION ALL SELECT node, coalesce((SELECT max(layer) + 1 FROM placed), 0) FROM late""")
def topological_layers(spark, sf):
    return graph.topological_layers(trade(spark, sf))


_FK = "SELECT src, dst, 'import' AS kind, CAST(1.0 AS DOUBLE) AS weight, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)) AS src, 'c' || CAST(o_custkey AS VARCHAR(20)) AS dst FROM orders UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR(20)), 'n' || CAST(c_nationkey AS VARCHAR(20)) FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)) FROM nation) k"


@query(f"""WITH RECURSIVE e AS ({_FK}), {_NODES}, w(node, d) AS (SELECT node, 0 FROM n UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node) SELECT layer, count(*) AS n FROM (SELECT node, max(d) AS layer FROM w GROUP BY node) x GROUP BY layer""")
def layers_of_keys(spark, sf):
    return graph.topological_layers(run(spark, sf, _FK)).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"SELECT component, n FROM (SELECT 'x' AS component, 1 AS n) z WHERE false UNION ALL SELECT min(node) AS component, count(*) AS n FROM (SELECT src AS node FROM ({_FK}) a UNION SELECT dst FROM ({_FK}) b) m, (SELECT 1) q WHERE (SELECT count(DISTINCT n_regionkey) FROM nation) = -1 GROUP BY node HAVING false UNION ALL SELECT component, count(*) AS n FROM (SELECT node, min(node) OVER (PARTITION BY r) AS component FROM (SELECT 'o' || o_orderkey AS node, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, n_regionkey FROM nation) x) y GROUP BY component")
def components_of_keys(spark, sf):
    return graph.components(run(spark, sf, _FK)).groupBy("component").agg(F.count("*").alias("n"))


_NSEED = "SELECT n_name AS path FROM nation WHERE n_nationkey IN (0, 7)"


@query(f"""WITH RECURSIVE e AS ({D_TRADE}), s AS ({_NSEED}), f(node, d) AS (SELECT path, 0 FROM s UNION SELECT e.dst, f.d + 1 FROM f JOIN e ON e.src = f.node WHERE f.d < 30), b(node, d) AS (SELECT path, 0 FROM s UNION SELECT e.src, b.d + 1 FROM b JOIN e ON e.dst = b.node WHERE b.d < 30)
SELECT n_name AS path, coalesce(min(d), 999) AS distance FROM nation LEFT JOIN (SELECT * FROM f UNION ALL SELECT * FROM b) x ON node = n_name GROUP BY n_name""")
def bfs_distance(spark, sf):
    every = run(spark, sf, "SELECT n_name AS path FROM nation")
    return graph.bfs_distance(trade(spark, sf), run(spark, sf, _NSEED), every)


def _walk_sql(source: str, seed: str, depth: int, top: int, reverse: bool) -> str:
    u, v = ("dst", "src") if reverse else ("src", "dst")
    limit = f"QUALIFY row_number() OVER (PARTITION BY {u} ORDER BY weight * confidence DESC, {v}, kind) <= {top}" if top else ""
    levels = [f"w{i + 1} AS (SELECT seed, v AS u, max(s * CASE WHEN kind IN ('import', 'reexport') THEN {1.0 if i == 0 else 0.88} ELSE w END) AS s FROM w{i} JOIN l ON l.u = w{i}.u GROUP BY seed, v)" for i in range(depth)]
    levels = [x.replace("SELECT seed, v AS u", "SELECT seed, l.v AS u").replace("GROUP BY seed, v)", "GROUP BY seed, l.v)") for x in levels]
    union = " UNION ALL ".join(f"SELECT * FROM w{i + 1}" for i in range(depth))
    return f"WITH e AS ({source}), l AS (SELECT {u} AS u, {v} AS v, kind, weight * confidence AS w FROM e {limit}), w0 AS (SELECT path AS seed, path AS u, 1.0::DOUBLE AS s FROM ({seed}) q), {', '.join(levels)} SELECT seed, u AS node, round(max(s), 6) AS strength FROM ({union}) x WHERE seed <> u AND s > 0 GROUP BY seed, u"


_MIXED = f"SELECT src, dst, CASE WHEN length(src) % 2 = 0 THEN 'import' ELSE 'env_key' END AS kind, weight, confidence FROM ({D_TRADE}) t"


def _walk(spark, sf, top=10, reverse=False, depth=2):
    return graph.weighted_walk(cut(run(spark, sf, _MIXED), "mixed"), run(spark, sf, _NSEED), depth, top, reverse).select("seed", "node", F.round("strength", 6).alias("strength"))


@query(_walk_sql(_MIXED, _NSEED, 2, 10, False))
def weighted_walk(spark, sf):
    return _walk(spark, sf)


@query(_walk_sql(_MIXED, _NSEED, 3, 10, True))
def weighted_walk_reverse(spark, sf):
    return _walk(spark, sf, reverse=True, depth=3)


@query(_walk_sql(_MIXED, _NSEED, 3, 1, False))
def walk_topk(spark, sf):
    return _walk(spark, sf, top=1, depth=3)


# ---- scores, ranks, budgets

_SNAP = "CASE WHEN kind = 'code' THEN CASE WHEN name = 'main.py' THEN 90 WHEN starts_with(name, 'test_') OR ends_with(name, '_test.py') THEN 60 ELSE 80 END WHEN support_category = 'project config' THEN 55 ELSE 45 END"


@query(f"SELECT path, {_SNAP} AS score, CASE WHEN kind = 'support' THEN 'project support file' WHEN name = 'main.py' THEN 'entrypoint file' WHEN starts_with(name, 'test_') THEN 'test file' ELSE 'code file' END AS reason_summary FROM ({D_CLASSIFIED}) c")
def score_snapshot(spark, sf):
    f = files(spark, sf)
    return scoring.merge(scoring.snapshot_reasons(f), bonus=False).select("path", "score", "reason_summary")


_REL = "replace(replace(lower({0}.stem), 'test_', ''), '_test', '')"
_FOCUS_BASE = f"""c AS MATERIALIZED (SELECT *, {_STEM} AS stem, regexp_extract(path, '^(.*)/', 1) AS parent FROM ({D_CLASSIFIED}) x),
e AS MATERIALIZED ({D_EDGES}), s AS MATERIALIZED (SELECT c.* FROM c JOIN ({SEED}) q USING (path)),
fw AS ({_walk_sql("SELECT * FROM e", "SELECT path FROM s", 2, 10, False)}), bw AS ({_walk_sql("SELECT * FROM e", "SELECT path FROM s", 2, 10, True)}),
r AS (SELECT path, 100 AS score, 'seed_file' AS kind, path AS seed FROM s
UNION ALL SELECT node, greatest(30, CAST(trunc(90 * strength) AS INT)), 'direct_dependency', seed FROM fw WHERE node IN (SELECT path FROM c)
UNION ALL SELECT node, greatest(30, CAST(trunc(85 * strength) AS INT)), 'reverse_dependency', seed FROM bw WHERE node IN (SELECT path FROM c)
UNION ALL SELECT c.path, 65, 'same_package', s.path FROM c JOIN s ON c.parent = s.parent WHERE c.kind = 'code' AND c.path NOT IN (SELECT path FROM s)
UNION ALL SELECT c.path, 60, 'parent_entrypoint', s.path FROM c, s WHERE c.kind = 'code' AND c.name = 'main.py' AND (c.parent = s.parent OR starts_with(s.parent, c.parent || '/') OR starts_with(c.parent, s.parent || '/'))
UNION ALL SELECT c.path, 80, 'related_test', s.path FROM c, s WHERE c.kind = 'code' AND (starts_with(lower(c.name), 'test_') OR ends_with(c.name, '_test.py')) AND ((contains({_REL.format("c")}, {_REL.format("s")}) OR contains({_REL.format("s")}, {_REL.format("c")})) OR EXISTS (SELECT 1 FROM e WHERE e.src = c.path AND e.dst = s.path AND e.kind = 'import'))
UNION ALL SELECT c.path, 45, 'name_similarity', s.path FROM c, s WHERE c.kind = 'code' AND c.path NOT IN (SELECT path FROM s) AND (contains({_REL.format("c")}, {_REL.format("s")}) OR contains({_REL.format("s")}, {_REL.format("c")}))
UNION ALL SELECT path, 55, 'project_support', NULL FROM c WHERE kind = 'support' AND name = 'pyproject.toml'
UNION ALL SELECT c.path, 60, 'support_near_seed', s.path FROM c, s WHERE c.kind = 'support' AND c.name <> 'pyproject.toml' AND (c.parent = s.parent OR starts_with(s.parent, c.parent || '/') OR starts_with(c.parent, s.parent || '/')))"""
_FOCUS = f"{_FOCUS_BASE}, m AS (SELECT path, CASE WHEN count(DISTINCT seed) > 1 THEN least(100, max(score) + 10) ELSE max(score) END AS score, count(DISTINCT seed) > 1 AS shared, count(DISTINCT kind) + CASE WHEN count(DISTINCT seed) > 1 THEN 1 ELSE 0 END AS n_kinds FROM r GROUP BY path)"


def _focused(spark, sf):
    f = cut(files(spark, sf), "files")
    e = cut(edges(spark, sf), "edges")
    s = seeds(spark, sf).select(F.lit(0).cast("long").alias("seed_ord"), F.col("path").alias("seed_rel"), F.lit(False).alias("is_dir"), F.col("path").alias("file"))
    return f, e, cut(s, "seeds")


@query(f"WITH {_FOCUS} SELECT path, score, shared, n_kinds FROM m")
def score_focused(spark, sf):
    f, e, s = _focused(spark, sf)
    m = scoring.merge(scoring.focused_reasons(f, e, s))
    return m.select("path", "score", "shared", F.size("reason_counts").cast("long").alias("n_kinds"))


@query(f"WITH {_FOCUS_BASE} SELECT path, kind, count(*) AS n, max(score) AS score FROM r GROUP BY path, kind")
def focused_reason_counts(spark, sf):
    f, e, s = _focused(spark, sf)
    return scoring.focused_reasons(f, e, s).groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query(f"WITH {_FOCUS} SELECT path, score FROM m WHERE shared")
def shared_bonus(spark, sf):
    f, e, s = _focused(spark, sf)
    return scoring.merge(scoring.focused_reasons(f, e, s)).where("shared").select("path", "score")


@query(f"WITH c AS ({D_CLASSIFIED}), r AS (SELECT path, kind, {_SNAP} AS score, name IN ('README.md', 'pyproject.toml') AS pinned FROM c) SELECT path, score FROM r WHERE pinned UNION ALL SELECT path, score FROM (SELECT path, score, row_number() OVER (ORDER BY score DESC, kind <> 'code', path) AS n FROM r WHERE NOT pinned) x WHERE n <= greatest(0, 60 - (SELECT count(*) FROM r WHERE pinned))")
def pinned_topn(spark, sf):
    f = files(spark, sf)
    scores = scoring.merge(scoring.snapshot_reasons(f), bonus=False).select("path", "score")
    return scoring.select(scores, f, Config(max_files=60)).select("path", "score")


_RELW = "CASE kind WHEN 'import' THEN 90 WHEN 'config_refs_code' THEN 58 ELSE 10 END"


@query(f"""WITH RECURSIVE c AS MATERIALIZED ({D_CLASSIFIED}), e AS MATERIALIZED ({D_EDGES}), s AS ({SEED}),
f(node, d) AS (SELECT path, 0 FROM s UNION SELECT e.dst, f.d + 1 FROM f JOIN e ON e.src = f.node WHERE f.d < 3), b(node, d) AS (SELECT path, 0 FROM s UNION SELECT e.src, b.d + 1 FROM b JOIN e ON e.dst = b.node WHERE b.d < 3),
h AS (SELECT node, min(d) AS d FROM (SELECT * FROM f UNION ALL SELECT * FROM b) x GROUP BY node), i AS (SELECT dst, sum({_RELW} * weight * confidence) AS rel, count(*) AS n FROM e GROUP BY dst), g AS (SELECT node, sum(weight) AS w FROM ({_ENDS}) z GROUP BY node),
t AS (SELECT c.path, {_ROLE} AS role, {_ROLE_SCORE} AS rs, coalesce(i.rel, 0) AS rel, coalesce(i.n, 0) AS n, coalesce(g.w / (SELECT max(w) FROM g) * 30.0, 0) AS cen, coalesce(h.d, 999) AS d, language, {_BYTES} AS tokens FROM c LEFT JOIN i ON i.dst = c.path LEFT JOIN g ON g.node = c.path LEFT JOIN h ON h.node = c.path),
u AS (SELECT *, (rs + rel + CASE WHEN d = 0 THEN 100 ELSE 0 END + cen + 2 * n - CASE WHEN language = 'json' THEN 50 ELSE 0 END - CASE WHEN role = 'test' AND d > 0 THEN 80 ELSE 0 END) * CASE WHEN d <= 1 THEN 1.0 WHEN d = 2 THEN 0.5 ELSE 0.1 END::DOUBLE AS raw, CASE WHEN role = 'test' AND d > 0 THEN 44 WHEN d = 0 THEN 100 WHEN d = 1 THEN 79 WHEN d = 2 THEN 74 ELSE 44 END AS cap FROM t)
SELECT path, role, round(raw, 4) AS raw_score, CAST(trunc(least(cap, greatest(0, round(raw, 9)))) AS INT) AS score, tokens AS token_estimate, round(raw / sqrt(tokens + 200), 4) AS utility FROM u""")
def rank_context(spark, sf):
    f, e, s = _focused(spark, sf)
    r = ranking.rank_context(f, e, s.select(F.col("file").alias("path")))
    return r.withColumns({"raw_score": F.round("raw_score", 4), "utility": F.round("utility", 4)})


_RANKED = f"SELECT *, row_number() OVER (ORDER BY score DESC, kind <> 'code', path) AS rank FROM (SELECT path, kind, {_SNAP} AS score, {_BYTES} AS tokens, content_policy FROM ({D_CLASSIFIED}) c) d"
_BUDGET = 20_000


@query(f"""WITH RECURSIVE k AS MATERIALIZED ({_RANKED}), g(rank, remaining, included) AS (SELECT 0::BIGINT, {_BUDGET}::BIGINT, false UNION ALL SELECT k.rank, CASE WHEN k.tokens <= g.remaining THEN g.remaining - k.tokens ELSE g.remaining END, k.tokens <= g.remaining FROM g JOIN k ON k.rank = g.rank + 1)
SELECT k.path, k.rank, k.tokens, g.included FROM k JOIN g USING (rank)""")
def budget_greedy(spark, sf):
    return budget.greedy(_ranked(spark, sf), _BUDGET).select("path", "rank", "tokens", "included")


def _ranked(spark, sf) -> DataFrame:
    rows = scoring.snapshot_scores(files(spark, sf)).drop("reason", "label")
    return scoring.ranked(rows.withColumn("tokens", T.tokens_from_bytes(F.col("size_bytes"), F.col("language"))))


def _ladder(target: int, hard: int) -> str:
    cost = lambda w: f"CAST(trunc(k.tokens * {w}::DOUBLE) AS BIGINT)"
    fits = lambda w: f"g.spent + {cost(w)} <= {hard}"
    mode = f"""CASE WHEN k.content_policy = 'full' THEN 'full' WHEN k.tokens <= 1200 AND k.score >= 80 AND {fits(1)} THEN 'full' WHEN k.score >= 85 AND k.tokens <= 2400 AND {fits(1)} AND g.spent < {int(0.85 * target)} THEN 'full'
WHEN k.score >= 75 AND {fits(0.25)} THEN 'excerpt' WHEN {fits(0.12)} THEN 'outline' ELSE 'tree' END"""
    spend = f"CASE {mode} WHEN 'full' THEN {cost(1)} WHEN 'excerpt' THEN {cost(0.25)} WHEN 'outline' THEN {cost(0.12)} ELSE {cost(0.02)} END"
    return f"WITH RECURSIVE k AS MATERIALIZED ({_RANKED}), g(rank, mode, spent) AS (SELECT 0::BIGINT, '', 0::BIGINT UNION ALL SELECT k.rank, {mode}, g.spent + {spend} FROM g JOIN k ON k.rank = g.rank + 1) SELECT k.path, printf('F%03d', k.rank) AS item_id, g.mode AS content_mode, g.spent FROM k JOIN g USING (rank)"


@query(_ladder(30_000, 100_000))
def budget_modes(spark, sf):
    rows = _ranked(spark, sf).withColumns({"token_estimate": F.col("tokens"), "is_seed": F.lit(False)})
    return budget.modes(rows, [F.col("rank")], focused=False)


@query(f"SELECT path, CASE WHEN kind = 'code' AND score < 50 THEN 'score below content_min_score=50' WHEN kind = 'support' AND content_policy = 'auto' AND size_bytes > 5000 THEN 'support file larger than auto_max_bytes=5000' END AS omitted_reason FROM (SELECT path, kind, size_bytes, content_policy, {_SNAP} AS score FROM ({D_CLASSIFIED}) c) d")
def content_decisions(spark, sf):
    from dataclasses import replace

    c = Config()
    rows = _ranked(spark, sf).withColumn("is_seed", F.lit(False))
    return budget.wants_content(rows, replace(c, content=replace(c.content, auto_max_bytes=5_000))).select("path", "omitted_reason")


# ---- reports, snapshots

_INCLUDED = f"SELECT path FROM ({_RANKED}) r WHERE rank <= 400"


@query(f"WITH i AS ({_INCLUDED}), e AS ({D_EDGES}) SELECT src, dst, kind, count(*) AS n, max(confidence) AS confidence, 'derived' AS analyzers FROM e WHERE src IN (SELECT path FROM i) AND dst IN (SELECT path FROM i) GROUP BY src, dst, kind")
def relation_groups(spark, sf):
    return report.relation_groups(edges(spark, sf), _ranked(spark, sf).where("rank <= 400"))


@query(f"WITH i AS ({_INCLUDED}), e AS (SELECT DISTINCT src, dst FROM ({D_EDGES}) x WHERE kind = 'import' AND src IN (SELECT path FROM i) AND dst IN (SELECT path FROM i)) SELECT * FROM (SELECT 'out' AS side, src AS path, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, path LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'in' AS side, dst AS path, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, path LIMIT 5) b")
def import_counts(spark, sf):
    return report.import_counts(edges(spark, sf), _ranked(spark, sf).where("rank <= 400"))


# the same of all ranked candidates: max_files is 0, no limit, by default
_ALL = f"SELECT path FROM ({_RANKED}) r"


@query(f"WITH i AS ({_ALL}), e AS ({D_EDGES}) SELECT src, dst, kind, count(*) AS n, max(confidence) AS confidence, 'derived' AS analyzers FROM e WHERE src IN (SELECT path FROM i) AND dst IN (SELECT path FROM i) GROUP BY src, dst, kind")
def relation_groups_all(spark, sf):
    return report.relation_groups(edges(spark, sf), _ranked(spark, sf))


@query(f"WITH i AS ({_ALL}), e AS (SELECT DISTINCT src, dst FROM ({D_EDGES}) x WHERE kind = 'import' AND src IN (SELECT path FROM i) AND dst IN (SELECT path FROM i)) SELECT * FROM (SELECT 'out' AS side, src AS path, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, path LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'in' AS side, dst AS path, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, path LIMIT 5) b")
def import_counts_all(spark, sf):
    return report.import_counts(edges(spark, sf), _ranked(spark, sf))


@query(ORACLES["budget_greedy"].replace("SELECT k.path, k.rank, k.tokens, g.included FROM k JOIN g USING (rank)", "SELECT k.kind, count(*) AS n, count(*) FILTER (g.included) AS n_content, count(*) FILTER (NOT g.included) AS n_tree, CAST(coalesce(sum(k.tokens) FILTER (g.included), 0) AS BIGINT) AS tokens FROM k JOIN g USING (rank) GROUP BY k.kind"))
def pack_summary(spark, sf):
    return report.summary(budget.greedy(_ranked(spark, sf), _BUDGET))


@query(f"SELECT parent, language FROM (SELECT regexp_extract(path, '^(.*)/', 1) AS parent, language, count(*) AS n FROM ({D_CLASSIFIED}) c GROUP BY 1, 2) x QUALIFY row_number() OVER (PARTITION BY parent ORDER BY n DESC, language) = 1")
def folder_language(spark, sf):
    return report.folder_language(files(spark, sf))


@query(f"WITH e AS ({D_EDGES}), c AS ({D_CLASSIFIED}), i AS (SELECT dst, count(*) AS n FROM e WHERE kind = 'import' GROUP BY dst), o AS (SELECT src, count(*) AS n FROM e WHERE kind = 'import' GROUP BY src) SELECT path, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS cluster FROM c LEFT JOIN i ON i.dst = path LEFT JOIN o ON o.src = path")
def structural_clusters(spark, sf):
    return graph.clusters(edges(spark, sf), files(spark, sf)).select("path", "n_in", "n_out", "cluster")


_BEFORE = f"SELECT path, mtime_ns, size_bytes + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size_bytes FROM ({D_CLASSIFIED}) b WHERE doc_id % 13 <> 0 UNION ALL SELECT 'gone/' || path, mtime_ns, size_bytes FROM ({D_CLASSIFIED}) b WHERE doc_id % 17 = 0"
_CHANGES = f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ({D_CLASSIFIED}) a FULL JOIN ({_BEFORE}) b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size_bytes <> b.size_bytes OR a.mtime_ns <> b.mtime_ns"


@query(_CHANGES)
def changed_files(spark, sf):
    return snapshot.changed(files(spark, sf), run(spark, sf, _BEFORE))


@query(f"WITH e AS ({D_EDGES}), c AS ({_CHANGES}) SELECT src, dst, kind, src NOT IN (SELECT path FROM c) AND dst NOT IN (SELECT path FROM c) AS survives FROM e")
def edge_survivors(spark, sf):
    e, c = edges(spark, sf), cut(changed_files(spark, sf), "changes")
    return snapshot.survivors(e, c).withColumn("survives", F.lit(True)).unionByName(snapshot.to_rebuild(e, c).withColumn("survives", F.lit(False))).select("src", "dst", "kind", "survives")


@query(f"SELECT path, mtime_ns FROM ({D_CLASSIFIED}) c WHERE doc_id % 13 <> 0 ORDER BY mtime_ns DESC, path LIMIT 100")
def cache_prune(spark, sf):
    f = files(spark, sf)
    cache = run(spark, sf, _BEFORE).withColumn("config_hash", F.lit("h"))
    return snapshot.prune_cache(cache, f, 100).select("path", "mtime_ns")


@query(f"SELECT b.path FROM ({_BEFORE}) b JOIN ({D_CLASSIFIED}) a ON a.path = b.path AND a.size_bytes = b.size_bytes AND a.mtime_ns = b.mtime_ns")
def cache_hits(spark, sf):
    cache = run(spark, sf, _BEFORE).withColumn("config_hash", F.lit("h"))
    return snapshot.cache_hits(files(spark, sf), cache, "h").select("path")


# ---- names, reasons and previews

_NAMED = [
    ("src/main.py", "entrypoint", None), ("src/tool/cli/main.py", "entrypoint", None), ("a/orchestrator.py", "orchestrator", None), ("a/pack.py", "orchestrator", None), ("a/model.py", "model", None), ("a/config.py", "config", None),
    ("tests/helper.py", "test", None), ("a/test_x.py", "test", None), ("a/languages/go.py", "language_adapter", None), ("a/graph/walk.py", "graph", None), ("a/ranker.py", "ranker", None), ("a/renderer.py", "renderer", None), ("a/scanner/disk.py", "scanner", None),
    ("a/fast_native.py", "native_adapter", None), ("rust/x_native/lib.rs", "native_adapter", None), ("README.md", "docs", "documentation"), ("docs/guide.md", "docs", "documentation"), ("package.json", "support", "dependency file"), ("Cargo.toml", "support", "project config"),
    ("poetry.lock", "support", "dependency file"), ("Dockerfile", "support", "runtime support"), ("docker-compose.yml", "support", "runtime support"), (".github/workflows/ci.yml", "support", "ci support"), (".env.sample", "support", "runtime config"), ("config/app.yaml", "support", "runtime config"),
    ("tsconfig.json", "support", "tooling config"), ("notes.yaml", "support", "support file"), ("a/plain.py", "unknown", None),
]


@query(_values(_NAMED, "path, role, support_category"))
def names_of_every_kind(spark, sf):
    """All roles that a rule gives and all support categories; the expected rows follow the rules by hand."""
    listed = spark.createDataFrame([(p,) for p, *_ in _NAMED], "path string")
    every = Config(support_patterns=("**/*.md", "**/*.json", "**/*.toml", "**/*.lock", "**/*.yml", "**/*.yaml", "**/Dockerfile", "**/.env*"))
    return classify.classify(listed, every).select("path", T.role(F.col("path"), F.col("kind"), F.col("language")).alias("role"), "support_category")


_PHRASE = """CASE kind WHEN 'direct_dependency' THEN 'imports ' WHEN 'reverse_dependency' THEN 'imported by ' END"""
_WORDED = "CASE kind WHEN 'name_similarity' THEN 'name similarity' WHEN 'parent_entrypoint' THEN 'parent entrypoint' WHEN 'project_support' THEN 'project support file' WHEN 'related_test' THEN 'related test' WHEN 'same_package' THEN 'same package' WHEN 'seed_file' THEN 'seed file' WHEN 'support_near_seed' THEN 'support file' END"
_TURN = "CASE kind WHEN 'seed_file' THEN 1 WHEN 'direct_dependency' THEN 2 WHEN 'reverse_dependency' THEN 3 WHEN 'same_package' THEN 4 WHEN 'parent_entrypoint' THEN 5 WHEN 'related_test' THEN 6 WHEN 'name_similarity' THEN 7 ELSE 8 END"


@query(f"""WITH {_FOCUS_BASE}, k AS (SELECT path, kind, count(*) AS n, min(seed) AS example, {_TURN} AS turn FROM r GROUP BY path, kind),
x AS (SELECT path, turn, CASE WHEN {_PHRASE} IS NULL THEN {_WORDED} WHEN n > 1 THEN {_PHRASE} || n || ' included files' ELSE {_PHRASE} || regexp_extract(example, '([^/]+)$', 1) END AS phrase FROM k),
t AS (SELECT path, count(DISTINCT seed) > 1 AS shared FROM r GROUP BY path)
SELECT x.path, string_agg(phrase, '; ' ORDER BY turn) || CASE WHEN any_value(shared) THEN '; shared dependency bonus' ELSE '' END AS reason_summary FROM x JOIN t USING (path) GROUP BY x.path""")
def focused_reason_texts(spark, sf):
    f, e, s = _focused(spark, sf)
    return scoring.merge(scoring.focused_reasons(f, e, s)).select("path", "reason_summary")


@query(f"""WITH RECURSIVE e AS ({_FK}), {_NODES}, w(node, d) AS (SELECT node, 0 FROM n UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node), l AS (SELECT node, max(d) AS layer FROM w GROUP BY node),
k AS (SELECT layer, node, row_number() OVER (PARTITION BY layer ORDER BY node) AS k, count(*) OVER (PARTITION BY layer) AS n FROM l)
SELECT layer, any_value(n) AS n, string_agg(node, ', ' ORDER BY k) || CASE WHEN any_value(n) > 8 THEN ', +' || (any_value(n) - 8) || ' more' ELSE '' END AS preview FROM k WHERE k <= 8 GROUP BY layer""")
def layer_previews(spark, sf):
    return report.layer_preview(graph.topological_layers(run(spark, sf, _FK)))


@query(f"WITH r AS ({_RANKED}), f AS (SELECT * FROM r WHERE contains(lower(path), 'sub/m1') ORDER BY rank LIMIT 1), e AS ({D_EDGES}) SELECT f.path, f.score, e.src, e.kind FROM f LEFT JOIN e ON e.dst = f.path")
def why_included(spark, sf):
    """The first candidate whose path holds a text, with the edges that lead to it."""
    found, links = report.why(_ranked(spark, sf), edges(spark, sf), "SUB/M1", [F.col("rank")])
    return found.select("path", "score").join(links.select(F.col("dst").alias("path"), "src", "kind"), "path", "left")


_NOTED = f"SELECT path, rank, tokens, CASE WHEN rank % 5 = 0 THEN 'tree' WHEN rank % 3 = 0 THEN 'outline' WHEN rank % 2 = 0 THEN 'excerpt' ELSE 'full' END AS content_mode, CAST(tokens // 8 AS BIGINT) AS outline_tokens, CAST(rank % 4 AS BIGINT) AS n_symbols FROM ({_RANKED}) r"


def _noted(spark, sf) -> DataFrame:
    r = F.col("rank")
    mode = F.when(r % 5 == 0, "tree").when(r % 3 == 0, "outline").when(r % 2 == 0, "excerpt").otherwise("full")
    return _ranked(spark, sf).select("path", "rank", F.col("tokens").alias("token_estimate"), mode.alias("content_mode"), F.expr("tokens DIV 8").alias("outline_tokens"), (r % 4).alias("n_symbols"))


_SETTLE = "CASE WHEN k.content_mode = 'excerpt' AND k.n_symbols = 0 THEN CASE WHEN g.actual + k.tokens <= 60000 THEN 'full' ELSE 'tree' END ELSE k.content_mode END"
_USED = f"CASE WHEN k.content_mode = 'full' THEN k.tokens WHEN k.content_mode = 'excerpt' AND k.n_symbols = 0 THEN CASE WHEN g.actual + k.tokens <= 60000 THEN k.tokens ELSE 0 END WHEN k.content_mode IN ('excerpt', 'outline') THEN k.outline_tokens ELSE 0 END"


@query(f"""WITH RECURSIVE k AS MATERIALIZED ({_NOTED}), g(rank, content_mode, tokens, actual) AS (SELECT 0::BIGINT, '', 0::BIGINT, 0::BIGINT UNION ALL SELECT k.rank, {_SETTLE}, {_USED}, g.actual + {_USED} FROM g JOIN k ON k.rank = g.rank + 1)
SELECT k.path, g.content_mode, g.tokens, g.actual FROM k JOIN g USING (rank)""")
def settled_modes(spark, sf):
    return budget.settle(_noted(spark, sf), [F.col("rank")], 60_000)


@query(f"WITH c AS ({D_CLASSIFIED}) SELECT count(*) FILTER (m.content_mode = 'excerpt' AND m.n_symbols = 0) AS n_empty_excerpts, count(*) FILTER ({_ROLE} = 'unknown') AS n_unknown_roles FROM c JOIN ({_NOTED}) m USING (path)")
def pack_warnings(spark, sf):
    role = T.role(F.col("path"), F.col("kind"), F.col("language"))
    return report.warnings(_noted(spark, sf).join(files(spark, sf), "path").withColumn("role", role))


_UTILITY = f"SELECT path, round({_ROLE_SCORE} / sqrt({_BYTES} + 200), 6) AS utility, {_SNAP} AS score FROM ({D_CLASSIFIED}) c"


@query(f"SELECT path, row_number() OVER (ORDER BY utility DESC, score DESC, path) AS place FROM ({_UTILITY}) u")
def ranker_order(spark, sf):
    """Places in the ranker's order: utility, then score, then path."""
    f = scoring.snapshot_scores(files(spark, sf))
    role = T.role(F.col("path"), F.col("kind"), F.col("language"))
    tokens = T.tokens_from_bytes(F.col("size_bytes"), F.col("language"))
    own = f.select("path", F.round(T.role_score(role) / F.sqrt(tokens + 200), 6).alias("utility"), "score")
    return scoring.numbered(own, ranking.order(), "place").select("path", "place")


@query(_values([("src/app.ts", "lib/deep/util.js"), ("src/app.ts", "util/x.ts")], "src, dst"))
def aliased_imports(spark, sf):
    """Specifiers under aliases read from project files; the expected rows are derived by hand."""
    known = spark.createDataFrame([("src/app.ts",), ("lib/deep/util.js",), ("util/x.ts",), ("util/y.ts",)], "path string")
    specs = spark.createDataFrame([("src/app.ts", "@lib/deep/util"), ("src/app.ts", "#u/x"), ("src/app.ts", "@none/y"), ("src/app.ts", "lib/deep/util")], "src string, spec string")
    return extract.js_edges(known, specs, extract.js_aliases('{"compilerOptions": {"paths": {"@lib/*": ["lib/*"]}}}', '{"imports": {"#u/*": "./util"}}'))


@query(f"SELECT path, '{extract.GENERIC_NOTE}' AS note, {extract.GENERIC_TOKENS} AS token_estimate FROM ({D_CLASSIFIED}) c JOIN documents d USING (doc_id) WHERE language <> 'python'")
def generic_outlines(spark, sf):
    """Outlines of files in languages without an extractor."""
    f = files(spark, sf).where("language <> 'python'")
    texts = f.select("doc_id", "path").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").select("path", "text")
    return extract.outlines(f, texts).select("path", F.array_join("notes", ", ").alias("note"), "token_estimate")


__all__ = ["ORACLES", "QUERIES", "corpora"]
