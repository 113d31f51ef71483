"""Registered queries: each applies operators of this library to the synthetic tables, and has its SQL.

Analogies: documents are text files (path = source/doc_id), pages are files with references (their links),
trade between nations is a dependency graph, parts are penalties, suppliers are declared packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..functions import text as fn
from ..operators import budgets, coverage, duplication, filters, graph, joins, rules, score
from ..operators.common import running_total
from ..sources import manifest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINES = r"""CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\r\n|[\r\n\x{2028}\x{2029}]'))
 - CAST(regexp_matches(text, '[\r\n\x{2028}\x{2029}]$') AS INT) END"""
DOCS = f"docs AS (SELECT doc_id, text, lang, source, source || '/' || doc_id AS file, {LINES} AS lines FROM documents)"
MIN_LINES, MIN_BYTES, FILE_LINES, TURN_LINES = 5, 100, 20, 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", "lang", "source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"))


# --- texts -------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, lines FROM docs")
def text_line_metric(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, sha256(text) AS hash, strlen(text) AS bytes FROM documents")
def text_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.fingerprint(F.col("text")).alias("hash"), F.octet_length("text").alias("bytes"))


GROUPS = f"""{DOCS}, sized AS (SELECT file, source, sha256(text) AS hash, strlen(text) AS bytes, lines FROM docs
 WHERE lines >= {MIN_LINES} AND strlen(text) >= {MIN_BYTES}),
 grp AS (SELECT hash, bytes, min(file) AS file, count(*) AS n FROM sized GROUP BY hash, bytes HAVING count(*) > 1)"""


@query(f"WITH {GROUPS} SELECT 'duplicate-text:' || hash || ':' || file AS id, bytes, n FROM grp")
def exact_text_duplicates(spark, d):
    files = doc_files(spark, d)
    groups = duplication.text_groups(duplication.text_candidates(files, MIN_LINES, MIN_BYTES))
    return groups.select(F.concat_ws(":", F.lit("duplicate-text"), "hash", "file").alias("id"), "bytes", "n")


@query(f"WITH {GROUPS} SELECT g.file AS group_file, s.file, s.lines FROM sized s JOIN grp g ON s.hash = g.hash AND s.bytes = g.bytes")
def duplicate_occurrences(spark, d):
    files = doc_files(spark, d)
    candidates = duplication.text_candidates(files, MIN_LINES, MIN_BYTES)
    return duplication.verified_occurrences(files, candidates, duplication.text_groups(candidates)).select("group_file", "file", "lines")


@query(f"""WITH {GROUPS} SELECT g.file AS group_file, string_agg(DISTINCT s.source, ',' ORDER BY s.source) AS sources
 FROM sized s JOIN grp g ON s.hash = g.hash AND s.bytes = g.bytes GROUP BY g.file""")
def duplicate_related_sources(spark, d):
    files = doc_files(spark, d)
    candidates = duplication.text_candidates(files, MIN_LINES, MIN_BYTES)
    found = duplication.verified_occurrences(files, candidates, duplication.text_groups(candidates))
    sources = found.select("group_file", fn.dirname(F.col("file")).alias("source")).distinct()
    return sources.groupBy("group_file").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


def line_tokens(spark, d) -> DataFrame:
    docs = doc_files(spark, d)
    lines = docs.select("file", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line_text"))
    return lines.select("file", "idx", F.sha2("line_text", 256).alias("hash"), (F.col("idx") + 1).alias("line"), F.lit(1).alias("column"), (F.col("idx") + 1).alias("end_line"))


def line_blocks(tokens: DataFrame, widths: list[int]) -> DataFrame:
    """Every run of so many lines, and the whole file."""
    sizes = tokens.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n"))
    whole = sizes.select("file", F.lit(0).alias("start"), F.col("n").alias("end"))
    out = whole
    for w in widths:
        starts = sizes.filter(F.col("n") >= w).select("file", F.explode(F.sequence(F.lit(0), F.col("n") - w)).alias("start"))
        out = out.unionByName(starts.select("file", "start", (F.col("start") + w).alias("end")))
    return out


TOKENS = """d AS (SELECT source || '/' || doc_id AS file, string_split(text, chr(10)) AS ls FROM documents),
 tok AS (SELECT file, unnest(range(len(ls))) AS idx, sha256(unnest(ls)) AS hash FROM d),
 n AS (SELECT file, count(*) AS n FROM tok GROUP BY file)"""


def block_sql(widths: list[int]) -> str:
    runs = "".join(f" UNION SELECT file, s AS \"start\", s + {w} AS \"end\" FROM (SELECT file, unnest(range(n - {w} + 1)) AS s FROM n WHERE n >= {w})" for w in widths)
    return f"""blk AS (SELECT file, 0 AS "start", n AS "end" FROM n{runs}),
 seq AS (SELECT b.file, b."start", b."end", b."end" - b."start" AS length, sha256(string_agg(t.hash, ',' ORDER BY t.idx)) AS hash
  FROM blk b JOIN tok t ON t.file = b.file AND t.idx >= b."start" AND t.idx < b."end"
  WHERE b."end" - b."start" >= 2 GROUP BY b.file, b."start", b."end"),
 rep AS (SELECT length, hash FROM seq GROUP BY length, hash HAVING count(*) > 1),
 occ AS (SELECT s.* FROM seq s JOIN rep r ON s.length = r.length AND s.hash = r.hash)"""


@query(f'WITH {TOKENS}, {block_sql([2])} SELECT file, "start", "end", length, hash FROM occ')
def line_block_duplicates(spark, d):
    tokens = line_tokens(spark, d)
    sequences = duplication.block_sequences(tokens, line_blocks(tokens, [2]), 2, 1)
    return duplication.token_groups(sequences).select("file", "start", "end", "length", "hash")


@query(f"""WITH {TOKENS}, {block_sql([2, 3])}, free AS (SELECT DISTINCT length, hash FROM occ o WHERE NOT EXISTS (
 SELECT 1 FROM occ p WHERE p.file = o.file AND p."start" <= o."start" AND p."end" >= o."end" AND p.length > o.length))
 SELECT o.file, o."start", o."end", o.length FROM occ o JOIN free f ON o.length = f.length AND o.hash = f.hash""")
def nested_group_suppression(spark, d):
    tokens = line_tokens(spark, d)
    sequences = duplication.block_sequences(tokens, line_blocks(tokens, [2, 3]), 2, 1)
    return duplication.without_nested(duplication.token_groups(sequences)).select("file", "start", "end", "length")


@query(f"""WITH {TOKENS}, {block_sql([2])} SELECT length AS tokens, hash, count(*) AS n, min(file) AS first_file,
 count(DISTINCT file) AS related FROM occ GROUP BY length, hash""")
def token_duplicate_groups(spark, d):
    tokens = line_tokens(spark, d)
    found = duplication.token_groups(duplication.block_sequences(tokens, line_blocks(tokens, [2]), 2, 1))
    per_file = found.groupBy("length", "hash", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(F.col("length").alias("tokens"), "hash").agg(F.sum("n").alias("n"), F.min("file").alias("first_file"), F.count(F.lit(1)).alias("related"))


# --- sizes, roles, languages -------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT file, lines, 'oversized-file' AS rule_id FROM docs WHERE lines > {FILE_LINES}")
def oversized_docs(spark, d):
    metrics = doc_files(spark, d).select("file", fn.line_count(F.col("text")).alias("lines"))
    return rules.oversized_files(metrics, FILE_LINES).select("file", F.col("observed").alias("lines"), "rule_id")


@query(f"""WITH t AS (SELECT conv_id, turn, role, {LINES} AS lines FROM conversations)
 SELECT 'conversation/' || conv_id AS file, role || ':' || turn || ':1' AS subject, lines FROM t WHERE lines > {TURN_LINES}""")
def oversized_turns(spark, d):
    turns = table(spark, d, "conversations").select(
        F.concat(F.lit("conversation/"), F.col("conv_id").cast("string")).alias("file"), F.col("role").alias("name"),
        F.col("turn").cast("int").alias("line"), F.lit(1).alias("column"), fn.line_count(F.col("text")).alias("lines"),
    )
    found = rules.oversized_functions(turns.withColumn("end_line", F.col("line") + F.col("lines") - 1), TURN_LINES)
    return found.select("file", "subject", F.col("observed").alias("lines"))


ROLE = """CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN source = 'src3' THEN 'tooling' WHEN source = 'src4' THEN 'migration' ELSE 'application' END"""
FACTOR = "CASE role WHEN 'migration' THEN 0.0 WHEN 'test' THEN 0.25 WHEN 'tooling' THEN 0.5 ELSE 1.0 END"
CONTEXT = f"""{DOCS}, r AS (SELECT file, lines, {ROLE} AS role FROM docs WHERE lines > {FILE_LINES}),
 x AS (SELECT *, least(greatest(lines / {FILE_LINES}.0 - 1, 0), 1) AS excess, {FACTOR} AS role_factor FROM r)"""


def doc_role():
    return (
        F.when(F.col("source").isin("src1", "src2"), "test").when(F.col("source") == "src3", "tooling")
        .when(F.col("source") == "src4", "migration").otherwise("application")
    )


def sized_with_roles(spark, d) -> DataFrame:
    sized = doc_files(spark, d).select("file", fn.line_count(F.col("text")).alias("lines"), doc_role().alias("role"))
    return rules.size_context(sized.filter(F.col("lines") > FILE_LINES), F.lit(FILE_LINES))


@query(f"WITH {CONTEXT} SELECT file, role, lines, CAST(round(CAST(excess * role_factor AS DOUBLE), 6) AS DOUBLE) AS factor FROM x")
def size_context_factor(spark, d):
    return sized_with_roles(spark, d).select("file", "role", "lines", "factor")


@query(f"""WITH {CONTEXT} SELECT CASE WHEN role = 'migration' OR excess <= 0.2 OR (role_factor < 1 AND lines < {FILE_LINES * 4})
 THEN 'info' ELSE 'warning' END AS severity, role, count(*) AS n FROM x GROUP BY 1, 2""")
def severity_labels(spark, d):
    return sized_with_roles(spark, d).groupBy("severity", "role").agg(F.count(F.lit(1)).alias("n"))


PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def page_paths(spark, d) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", "url", path.alias("path"))


@query(f"""WITH p AS (SELECT {PATH} AS path FROM pages) SELECT path, CASE WHEN regexp_matches(path, '(?:^|/)(?:de|es)/') THEN 'test'
 WHEN regexp_matches(path, '\\.html$') THEN 'tooling' WHEN regexp_matches(path, '(?:^|/)(?:fr)/') THEN 'application' ELSE 'unknown' END AS role FROM p""")
def role_assignment(spark, d):
    path = F.col("path")
    return page_paths(spark, d).select("path", rules.role(path, F.lit(False), path.rlike("(?:^|/)(?:de|es)/"), F.lit(False), path.rlike(r"\.html$"), "(?:^|/)(?:fr)/").alias("role"))


SUFFIX = "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.TS' WHEN 'de' THEN '.go' ELSE '.xyz' END"


@query(f"""WITH f AS (SELECT {SUFFIX} AS e, text FROM documents), g AS (SELECT CASE lower(e) WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.go' THEN 'Go' END AS name, text FROM f)
 SELECT name, CASE WHEN name = 'TypeScript' THEN 'syntax' ELSE 'text' END AS mode, count(*) AS discovered, count(*) FILTER (text <> '') AS analyzed
 FROM g WHERE name IS NOT NULL GROUP BY 1, 2""")
def language_inventory(spark, d):
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".TS").when(F.col("lang") == "de", ".go").otherwise(".xyz")
    files = doc_files(spark, d).select(F.concat("file", suffix).alias("path"), (F.col("text") != "").alias("analyzed"))
    return rules.language_inventory(files)


# --- paths -------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {PATH} AS path FROM pages WHERE regexp_matches({PATH} || '/', '^(?:[^/]*/)*fr/[^/]*\\.html/$|^www\\.[^/]*/(?:[^/]*/)*$')")
def glob_filter(spark, d):
    return filters.glob_filter(page_paths(spark, d), ["**/fr/*.html", "www.*/**"]).select("page_id", "path")


@query(f"SELECT page_id, {PATH} AS path FROM pages WHERE NOT regexp_matches({PATH} || '/', '^(?:[^/]*/)*de/(?:[^/]*/)*$|^(?:[^/]*/)*[^/]*\\.html/$')")
def exclusion_anti(spark, d):
    return filters.without_excluded(page_paths(spark, d), ["**/de/**", "**/*.html"]).select("page_id", "path")


@query("""WITH f AS (SELECT source || '/' || doc_id AS path FROM documents) SELECT path FROM f
 WHERE path = 'src1' OR starts_with(path, 'src1/') OR path = 'src2/7' OR starts_with(path, 'src2/7/')""")
def scope_filter(spark, d):
    return filters.scope_filter(doc_files(spark, d).select(F.col("file").alias("path")), ["src1", "src2/7"])


@query("""WITH s(scope) AS (VALUES ('src1'), ('src1/1'), ('nowhere'), ('src2')), f AS (SELECT source || '/' || doc_id AS path FROM documents)
 SELECT scope FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE path = scope OR starts_with(path, scope || '/'))""")
def empty_scopes(spark, d):
    scopes = spark.createDataFrame([("src1",), ("src1/1",), ("nowhere",), ("src2",)], "scope STRING")
    return filters.empty_scopes(scopes, doc_files(spark, d).select(F.col("file").alias("path")))


IGNORE_RULES = [("", 0, 0, r"(^|.*/)src1/?$", False), ("src2", 0, 0, r"^[0-9]*2$", False), ("src2", 1, 0, r"^[0-9]*22$", True), ("", 0, 1, r"^src3/[0-9]*3$", False)]


@query("""WITH f AS (SELECT source, doc_id, source || '/' || doc_id AS path FROM documents)
 SELECT path, CASE WHEN source = 'src1' THEN true WHEN source = 'src2' THEN (doc_id % 10 = 2 AND doc_id % 100 <> 22)
 WHEN source = 'src3' THEN doc_id % 10 = 3 ELSE false END AS ignored FROM f""")
def ignore_layers_last_match(spark, d):
    rules_ = spark.createDataFrame(IGNORE_RULES, "directory STRING, file_rank INT, rule_no INT, regex STRING, negated BOOLEAN")
    return filters.ignored_paths(doc_files(spark, d).select(F.col("file").alias("path")), rules_)


HREFS = "h AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages), e AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href FROM h)"


def page_links(spark, d) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


@query(f"WITH {HREFS} SELECT page_id, pos, href FROM e")
def reference_extraction(spark, d):
    return page_links(spark, d)


KINDED = f"""{HREFS}, dep AS (SELECT page_id, pos, CASE pos % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' ELSE 'unresolved' END AS resolution,
 CASE WHEN pos % 2 = 0 THEN 'runtime' ELSE 'type-only' END AS kind, CASE WHEN pos % 3 = 0 THEN href END AS to_file FROM e)"""


@query(f"WITH {KINDED} SELECT page_id, pos, to_file FROM dep WHERE resolution = 'internal' AND kind = 'runtime'")
def runtime_edges(spark, d):
    pos = F.col("pos")
    resolution = F.when(pos % 3 == 0, "internal").when(pos % 3 == 1, "external").otherwise("unresolved")
    links = page_links(spark, d).select("page_id", "pos", resolution.alias("resolution"), F.when(pos % 2 == 0, "runtime").otherwise("type-only").alias("kind"), F.when(pos % 3 == 0, F.col("href")).alias("to_file"))
    return filters.runtime_edges(links).select("page_id", "pos", "to_file")


@query(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), g(pattern, regex) AS (VALUES ('**/fr/*.html', '^(?:[^/]*/)*fr/[^/]*[.]html/$'), ('**/de/**', '^(?:[^/]*/)*de/(?:[^/]*/)*$'))
 SELECT DISTINCT pattern, path FROM p, g WHERE regexp_matches(path || '/', regex)""")
def glob_join(spark, d):
    return joins.glob_join(["**/fr/*.html", "**/de/**"], page_paths(spark, d)).distinct()


LOCAL = f"""{HREFS}, w AS (SELECT page_id, pos, regexp_replace(substr(href, 2), '[^A-Za-z]', '', 'g') AS t FROM e),
 s AS (SELECT *, CASE pos % 4 WHEN 0 THEN './' || t WHEN 1 THEN '@lib/' || t WHEN 2 THEN t || '/sub' ELSE '../../' || t END AS specifier FROM w WHERE t <> ''),
 known AS (SELECT DISTINCT t FROM w WHERE t <> '' AND len(t) % 2 = 0)"""


@query(f"""WITH {LOCAL} SELECT page_id, s.pos, specifier,
 CASE WHEN pos % 4 = 2 THEN 'external' WHEN pos % 4 < 2 AND known.t IS NOT NULL THEN 'internal' ELSE 'unresolved' END AS resolution,
 CASE WHEN pos % 4 = 0 AND known.t IS NOT NULL THEN 'pages/' || s.t || '.ts' WHEN pos % 4 = 1 AND known.t IS NOT NULL THEN 'lib/' || s.t || '/index.ts' END AS to_file
 FROM s LEFT JOIN known ON known.t = s.t""")
def resolved_references(spark, d):
    from ..sources.tsconfig import TSConfig
    from .scan import configuration_table, resolve_references

    word = F.regexp_replace(F.substr("href", F.lit(2)), "[^A-Za-z]", "")
    links = page_links(spark, d).withColumn("t", word).filter("t != ''")
    n = F.col("pos") % 4
    spec = F.when(n == 0, F.concat(F.lit("./"), "t")).when(n == 1, F.concat(F.lit("@lib/"), "t")).when(n == 2, F.concat("t", F.lit("/sub"))).otherwise(F.concat(F.lit("../../"), "t"))
    edges = links.select(
        F.lit("site").alias("repo_id"), "page_id", "pos", F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("from_file"), F.lit(1).alias("line"), F.lit(1).alias("column"),
        spec.alias("specifier"), F.lit("runtime").alias("kind"), F.lit("import").alias("syntax"), F.lit("unresolved").alias("resolution"), F.lit(None).cast("string").alias("to_file"), F.lit(None).cast("string").alias("reason"),
    )
    known = links.filter(F.length("t") % 2 == 0).select("t").distinct()
    files = known.select(F.concat(F.lit("pages/"), "t", F.lit(".ts")).alias("path")).unionByName(known.select(F.concat(F.lit("lib/"), "t", F.lit("/index.ts")).alias("path")))
    configs = configuration_table(spark, {"site": [TSConfig("pages", aliases=[("@lib/*", ["lib/*"], ["../lib/*"])])]})
    return resolve_references(edges, files.withColumn("repo_id", F.lit("site")), configs).select("page_id", "pos", "specifier", "resolution", "to_file")


@query(f"""WITH {HREFS}, t AS (SELECT DISTINCT 'en/' || substr(href, 2) AS path FROM e WHERE NOT regexp_matches(href, '[.,]$')
 UNION SELECT DISTINCT 'fr/' || substr(href, 2) FROM e WHERE regexp_matches(href, '^/[A-Z]'))
 SELECT e.page_id, e.pos, coalesce(max(CASE WHEN t.path = 'fr/' || substr(href, 2) THEN t.path END), max(CASE WHEN t.path = 'en/' || substr(href, 2) THEN t.path END)) AS to_file
 FROM e LEFT JOIN t ON t.path IN ('fr/' || substr(href, 2), 'en/' || substr(href, 2)) GROUP BY e.page_id, e.pos""")
def reference_resolution(spark, d):
    links = page_links(spark, d)
    name, href = F.substr(F.col("href"), F.lit(2)), F.col("href")
    en, fr = F.concat(F.lit("en/"), name), F.concat(F.lit("fr/"), name)
    targets = links.filter(~href.rlike("[.,]$")).select(en.alias("path")).unionByName(links.filter(href.rlike("^/[A-Z]")).select(fr.alias("path")))
    rows = links.select("page_id", "pos", F.array(fr, en).alias("candidates"))
    return joins.first_match(rows, ["page_id", "pos"], "candidates", targets)


HOST, SECTION = "regexp_extract(path, '^([^/]*)/', 1)", "regexp_extract(path, '^([^/]*/[^/]*)/', 1)"


def page_directories(spark, d, section_pattern: str) -> DataFrame:
    """Hosts of secure pages, and their sections where the address matches."""
    pages = page_paths(spark, d)
    host, section = F.regexp_extract("path", "^([^/]*)/", 1), F.regexp_extract("path", "^([^/]*/[^/]*)/", 1)
    secure, deep = pages.filter(F.col("url").startswith("https")), pages.filter(F.col("url").rlike(section_pattern))
    return secure.select(host.alias("directory")).unionByName(deep.select(section.alias("directory"))).distinct()


@query(f"""WITH p AS (SELECT page_id, url, {PATH} AS path FROM pages), d AS (SELECT {HOST} AS dir FROM p WHERE starts_with(url, 'https')
 UNION SELECT {SECTION} FROM p WHERE regexp_matches(url, '\\?') UNION SELECT '')
 SELECT page_id, arg_max(dir, length(dir)) AS nearest FROM p JOIN d ON dir = '' OR starts_with(path, dir || '/') GROUP BY page_id""")
def nearest_ancestor(spark, d):
    dirs = page_directories(spark, d, r"\?").unionByName(spark.createDataFrame([("",)], "directory STRING"))
    return joins.nearest_ancestor(page_paths(spark, d), ["page_id"], "path", dirs)


@query(f"""WITH p AS (SELECT page_id, url, {PATH} AS path FROM pages), m AS (SELECT {HOST} AS directory FROM p WHERE starts_with(url, 'https')
 UNION SELECT {SECTION} FROM p WHERE regexp_matches(url, '#')), r AS (SELECT page_id, directory,
 row_number() OVER (PARTITION BY page_id ORDER BY length(directory) DESC) AS n FROM p JOIN m ON starts_with(path, directory || '/'))
 SELECT page_id, directory || '/manifest' AS manifest FROM r WHERE n = 1""")
def longest_prefix_owner(spark, d):
    dirs = page_directories(spark, d, "#")
    declared = dirs.select(F.lit("site").alias("name"), "directory", F.concat("directory", F.lit("/manifest")).alias("manifest"))
    edges = page_paths(spark, d).select("page_id", F.lit("site").alias("name"), F.col("path").alias("from_file"))
    return joins.longest_prefix_owner(edges, ["page_id"], declared).select("page_id", "manifest")


@query(f"""WITH {HREFS}, s AS (SELECT DISTINCT CASE pos % 4 WHEN 0 THEN '@s' || href WHEN 1 THEN substr(href, 2) WHEN 2 THEN '.' || href ELSE 'node:' || substr(href, 2) END AS specifier FROM e)
 SELECT specifier, CASE WHEN specifier = '' OR regexp_matches(specifier, '(?i)^(?:\\.|/|#|[a-z][a-z0-9+.-]*:)') THEN NULL
 WHEN regexp_matches(CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE string_split(specifier, '/')[1] END, '(?i)^(@[a-z0-9_.-]+/)?[a-z0-9_.-]+$')
 THEN CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE string_split(specifier, '/')[1] END END AS package FROM s""")
def package_names(spark, d):
    name, pos = F.substr(F.col("href"), F.lit(2)), F.col("pos") % 4
    spec = F.when(pos == 0, F.concat(F.lit("@s"), "href")).when(pos == 1, name).when(pos == 2, F.concat(F.lit("."), "href")).otherwise(F.concat(F.lit("node:"), name))
    specs = page_links(spark, d).select(spec.alias("specifier")).distinct()
    return specs.select("specifier", fn.package_name(F.col("specifier")).alias("package"))


# --- graphs ------------------------------------------------------------------------------------------------

TRADE = """edge AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount = 0.1 AND l_quantity >= 49 AND l_returnflag = 'R')"""


def trade_edges(spark, d) -> DataFrame:
    sold = table(spark, d, "lineitem").filter("l_discount = 0.1 AND l_quantity >= 49 AND l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("from_file"))
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("to_file"))
    return sold.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").select("from_file", "to_file").distinct()


def trade_graph(spark, d) -> DataFrame:
    return trade_edges(spark, d).select(F.lit("trade").alias("repo_id"), F.col("from_file").cast("string"), F.col("to_file").cast("string"), F.lit(1).alias("line"), F.lit(1).alias("column"))


PATHS = f"WITH RECURSIVE {TRADE}, path(a, b) AS (SELECT a, b FROM edge UNION SELECT p.a, e.b FROM path p JOIN edge e ON p.b = e.a)"


@query(f"WITH {TRADE} SELECT a AS from_file, b AS to_file FROM edge")
def dependency_edges(spark, d):
    return trade_edges(spark, d)


@query(f"WITH {TRADE} SELECT a AS from_file, count(*) AS fan_out, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS targets FROM edge GROUP BY a")
def adjacency(spark, d):
    return trade_edges(spark, d).groupBy("from_file").agg(F.count(F.lit(1)).alias("fan_out"), F.array_join(F.sort_array(F.collect_list("to_file")), ",").alias("targets"))


SEED = "(SELECT min(a) AS s FROM edge)"


@query(f"{PATHS} SELECT s AS node FROM {SEED} UNION SELECT b FROM path, {SEED} WHERE a = s")
def reachability(spark, d):
    edges = trade_edges(spark, d)
    return graph.reachable(edges, edges.agg(F.min("from_file").alias("node")))


@query(f"{PATHS} SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT s FROM {SEED} UNION SELECT b FROM path, {SEED} WHERE a = s)")
def unreachable_anti(spark, d):
    edges = trade_edges(spark, d)
    reached = graph.reachable(edges, edges.agg(F.min("from_file").alias("node")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node")).join(reached, "node", "left_anti")


@query(f"""{PATHS}, r AS (SELECT s AS node FROM {SEED} UNION SELECT b FROM path, {SEED} WHERE a = s)
 SELECT CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN node IS NULL THEN 'candidate' ELSE 'reachable' END AS state,
 CASE WHEN node IS NULL THEN 'LIKELY' ELSE 'CONFIRMED' END AS confidence FROM nation LEFT JOIN r ON node = n_nationkey""")
def file_usage(spark, d):
    edges = trade_edges(spark, d)
    reached = graph.reachable(edges, edges.agg(F.min("from_file").alias("node"))).select(F.col("node").cast("string").alias("node"))
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"))
    return graph.file_usage(files, reached, True, False).select("file", "state", "confidence")


@query(f"""{PATHS}, r AS (SELECT s AS node FROM {SEED} UNION SELECT b FROM path, {SEED} WHERE a = s)
 SELECT 'potentially-unused-file' AS rule_id, CAST(n_nationkey AS VARCHAR) AS file, 'LIKELY' AS confidence FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)""")
def unused_files(spark, d):
    edges = trade_edges(spark, d)
    reached = graph.reachable(edges, edges.agg(F.min("from_file").alias("node"))).select(F.col("node").cast("string").alias("node"))
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"))
    return rules.unused_files(graph.file_usage(files, reached, True, False), 1).select("rule_id", "file", "confidence")


@query("""WITH seed AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 0),
 s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN seed ON o_custkey = seed.k)
 SELECT 'c' || k AS node FROM seed UNION SELECT 's' || k FROM s UNION SELECT 'p' || l_partkey FROM lineitem JOIN s ON l_suppkey = s.k""")
def purchase_reach(spark, d):
    """What the customers of one nation lead to: suppliers that sold to them, and all parts of those. The graph is
    that of all orders, and grows with the tables."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supplier"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("part"))
    buyer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), buyer.alias("buyer"))
    bought = items.join(orders, "l_orderkey").select(F.col("buyer").alias("from_file"), F.col("supplier").alias("to_file"))
    edges = bought.unionByName(items.select(F.col("supplier").alias("from_file"), F.col("part").alias("to_file")))
    seeds = table(spark, d, "customer").filter("c_nationkey = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reachable(edges, seeds)


@query(f"{PATHS} SELECT a, b FROM path")
def transitive_closure(spark, d):
    return graph.closure(trade_edges(spark, d))


MUTUAL = "m AS (SELECT p.a, min(p.b) AS least, count(*) AS size FROM path p JOIN path q ON p.a = q.b AND p.b = q.a GROUP BY p.a)"


@query(f"{PATHS}, {MUTUAL} SELECT CAST(a AS VARCHAR) AS member, size FROM m")
def scc_components(spark, d):
    return graph.strong_components(trade_graph(spark, d)).select(F.explode("members").alias("member"), F.col("size").cast("long"))


@query(f"""{PATHS}, p2 AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM path),
 m AS (SELECT p.a, min(p.b) AS start FROM p2 p JOIN p2 q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
 SELECT 'runtime-cycle' AS rule_id, start AS file, string_agg(a, ',' ORDER BY a) AS members FROM m GROUP BY start""")
def runtime_cycles(spark, d):
    found = rules.cycle_findings(graph.strong_components(trade_graph(spark, d)))
    return found.select("rule_id", "file", F.array_join("related_files", ",").alias("members"))


@query(f"""{PATHS}, p2 AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM path),
 m AS (SELECT p.a, min(p.b) AS start FROM p2 p JOIN p2 q ON p.a = q.b AND p.b = q.a GROUP BY p.a),
 ce AS (SELECT m.start, m.a, n.a AS b FROM edge e JOIN m ON m.a = CAST(e.a AS VARCHAR) JOIN m n ON n.a = CAST(e.b AS VARCHAR) AND n.start = m.start),
 head AS (SELECT start, min(b) AS f FROM ce WHERE a = start GROUP BY start),
 dist(start, node, n) AS (SELECT start, f, 0 FROM head UNION SELECT d.start, c.b, d.n + 1 FROM dist d JOIN ce c ON c.start = d.start AND c.a = d.node WHERE d.n < 26 AND d.node <> d.start),
 least AS (SELECT start, min(n) AS n FROM dist WHERE node = start GROUP BY start),
 walk(start, node, route) AS (SELECT start, f, [f] FROM head UNION ALL
  SELECT w.start, c.b, list_append(w.route, c.b) FROM walk w JOIN ce c ON c.start = w.start AND c.a = w.node JOIN least l ON l.start = w.start WHERE len(w.route) - 1 < l.n),
 best AS (SELECT w.start, min(list_prepend(w.start, w.route)) AS route FROM walk w JOIN least l ON l.start = w.start WHERE w.node = w.start AND len(w.route) - 1 = l.n GROUP BY w.start),
 s AS (SELECT start, route, unnest(range(len(route) - 1)) AS step FROM best)
 SELECT start AS file, CAST(step AS INT) AS step, route[step + 1] AS from_file, route[step + 2] AS to_file FROM s""")
def cycle_evidence(spark, d):
    found = rules.cycle_findings(graph.strong_components(trade_graph(spark, d)))
    return found.select("file", F.posexplode("evidence").alias("step", "e")).select("file", "step", "e.from_file", "e.to_file")


@query(f"""{PATHS}, p2 AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM path),
 m AS (SELECT p.a, min(p.b) AS start FROM p2 p JOIN p2 q ON p.a = q.b AND p.b = q.a GROUP BY p.a), c AS (SELECT start, count(*) AS size FROM m GROUP BY start)
 SELECT start, CAST(size AS INT) AS size, (SELECT count(*) FROM c) > 1 AS truncated FROM c ORDER BY start LIMIT 1""")
def capped_cycles(spark, d):
    """The first component by its smallest member, and whether there are more: the cap is the operator."""
    return graph.capped_components(graph.strong_components(trade_graph(spark, d)), 1).select("start", "size", "truncated")


@query(f"""WITH RECURSIVE {TRADE}, walk(s, b, n) AS (SELECT a, b, 1 FROM edge UNION SELECT s, e.b, n + 1 FROM walk JOIN edge e ON walk.b = e.a WHERE n < 26)
 SELECT CAST(s AS VARCHAR) AS node, min(n) AS length FROM walk WHERE s = b GROUP BY s""")
def shortest_cycle_length(spark, d):
    return graph.shortest_cycles(trade_graph(spark, d), 26)


# --- packages ----------------------------------------------------------------------------------------------

PACKAGES = """used AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-20'),
 s AS (SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal < 0 THEN 'peerDependencies' ELSE 'dependencies' END AS section FROM supplier)"""
STATE = "CASE WHEN k IS NOT NULL THEN 'used' WHEN section = 'peerDependencies' THEN 'indirect' ELSE 'candidate' END"


def package_states(spark, d) -> DataFrame:
    section = F.when(F.col("s_acctbal") < 0, "peerDependencies").otherwise("dependencies")
    declared = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("package.json").alias("manifest"), F.array(section).alias("sections"), "s_suppkey")
    used = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.expr("timestamp_ntz'2001-10-20 00:00:00'")).select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    evidence = used.join(declared, "s_suppkey").select("name", "manifest", F.lit("runtime").alias("kind"))
    return rules.package_usage(declared.drop("s_suppkey"), evidence, False)


@query(f"WITH {PACKAGES} SELECT name, {STATE} AS state FROM s LEFT JOIN used ON k = s_suppkey")
def package_usage_state(spark, d):
    return package_states(spark, d).select("name", "state")


@query(f"WITH {PACKAGES} SELECT name AS subject, 'SUSPICIOUS' AS confidence FROM s LEFT JOIN used ON k = s_suppkey WHERE {STATE} = 'candidate'")
def unused_packages(spark, d):
    return rules.unused_packages(package_states(spark, d)).select("subject", "confidence")


def user_manifests(spark, d) -> DataFrame:
    """A package.json a user: event types are packages, declared for use, for development or both; a script by event."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    pairs = lambda when: F.map_from_entries(F.collect_list(F.when(when, F.struct("event_type", F.lit("1")))))
    name, first = F.concat(F.lit("run-"), "event_type"), F.col("first").cast("string")
    script = F.concat(F.lit("node src/e"), first, F.lit(".js; "), "event_type", F.lit(" lib/x"), first, F.lit(".ts"))
    per = rows.groupBy("user_id").agg(
        pairs(F.col("first") % 2 == 0).alias("dependencies"), pairs(F.col("first") % 3 == 0).alias("devDependencies"),
        F.map_from_entries(F.collect_list(F.struct(name, script))).alias("scripts"),
    )
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/package.json"))
    return per.select(F.lit("users").alias("repo_id"), path.alias("path"), F.to_json(F.struct("dependencies", "devDependencies", "scripts")).alias("content"))


USERS = "u AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type)"


@query(f"""WITH {USERS} SELECT 'u' || user_id || '/package.json' AS manifest, event_type AS name,
 concat_ws(',', CASE WHEN first % 2 = 0 THEN 'dependencies' END, CASE WHEN first % 3 = 0 THEN 'devDependencies' END) AS sections FROM u WHERE first % 2 = 0 OR first % 3 = 0""")
def manifest_packages(spark, d):
    found = manifest.manifest_facts(user_manifests(spark, d)).select("manifest", F.inline("packages"))
    return found.select("manifest", "name", F.array_join("sections", ",").alias("sections"))


@query(f"""WITH {USERS} SELECT 'u' || user_id || '/package.json' AS manifest, 'run-' || event_type AS script, 'src/e' || first || '.js' AS target, true AS required, 'tooling' AS purpose FROM u
 UNION ALL SELECT 'u' || user_id || '/package.json', 'run-' || event_type, 'lib/x' || first || '.ts', false, 'tooling' FROM u""")
def script_entries(spark, d):
    return manifest.manifest_facts(user_manifests(spark, d)).select("manifest", F.inline("entries"))


@query(f"""WITH {USERS} SELECT 'u' || user_id || '/package.json' AS manifest, 'run-' || event_type AS script, event_type AS name FROM u WHERE first % 2 = 0 OR first % 3 = 0""")
def script_tools(spark, d):
    return manifest.manifest_facts(user_manifests(spark, d)).select("manifest", F.inline("tools"))


# --- penalties ---------------------------------------------------------------------------------------------

CAT = "CASE p_size % 5 WHEN 0 THEN 'cycles' WHEN 1 THEN 'unusedFiles' WHEN 2 THEN 'packages' WHEN 3 THEN 'size' ELSE 'duplication' END"
CAPPED = "CASE category WHEN 'cycles' THEN 30 WHEN 'unusedFiles' THEN 15 WHEN 'packages' THEN 15 ELSE 20 END"
RAW = f"part_raw AS (SELECT p_partkey, {CAT} AS category, CAST(p_retailprice / 10000 AS DECIMAL(18,6)) AS raw FROM part)"
ALLOCATED = f"""{RAW}, c AS (SELECT *, sum(raw) OVER (PARTITION BY category ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS c, CAST({CAPPED} AS DECIMAL(18,6)) AS cap FROM part_raw),
 a AS (SELECT *, least(c, cap) - least(c - raw, cap) AS a FROM c),
 t AS (SELECT *, sum(a) OVER (ORDER BY category, p_partkey ROWS UNBOUNDED PRECEDING) AS t FROM a),
 alloc AS (SELECT p_partkey, category, CAST(least(t, 100) - least(t - a, 100) AS DECIMAL(18,6)) AS applied FROM t)"""


def part_penalties(spark, d) -> DataFrame:
    n = F.col("p_size") % 5
    category = F.when(n == 0, "cycles").when(n == 1, "unusedFiles").when(n == 2, "packages").when(n == 3, "size").otherwise("duplication")
    return table(spark, d, "part").select("p_partkey", category.alias("category"), (F.col("p_retailprice") / 10000).cast("decimal(18,6)").alias("raw_penalty"))


def part_allocated(spark, d) -> DataFrame:
    return score.allocate(part_penalties(spark, d), key="p_partkey")


@query(f"WITH {ALLOCATED} SELECT p_partkey, category, CAST(applied AS DOUBLE) AS applied FROM alloc")
def capped_score_allocation(spark, d):
    return part_allocated(spark, d).select("p_partkey", "category", F.col("applied_penalty").cast("double").alias("applied"))


@query(f"WITH {ALLOCATED} SELECT category, CAST(sum(applied) AS DOUBLE) AS penalty FROM alloc GROUP BY category")
def category_penalties(spark, d):
    return score.category_penalties(part_allocated(spark, d)).select("category", F.col("penalty").cast("double").alias("penalty"))


@query(f"""WITH {ALLOCATED} SELECT 'partial' AS status, CAST(NULL AS DOUBLE) AS value, CAST(round(greatest(0, 100 - sum(applied)), 2) AS DOUBLE) AS observed_value FROM alloc""")
def final_score(spark, d):
    states = spark.createDataFrame([("cycles", "complete"), ("unusedFiles", "partial"), ("packages", "unavailable"), ("size", "complete"), ("duplication", "complete")], "category STRING, status STRING")
    return score.final_score(part_allocated(spark, d), states, 1)


LABELLED = """f AS (SELECT d.doc_id, source || '/' || d.doc_id AS file, CASE WHEN d.doc_id % 4 = 0 THEN 'oversized-file' WHEN d.doc_id % 4 = 1 THEN 'duplicate-block' WHEN d.doc_id % 4 = 2 THEN 'potentially-unused-file' ELSE 'potentially-unused-package' END AS rule_id,
 CASE d.doc_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'LIKELY' ELSE 'SUSPICIOUS' END AS confidence, source FROM documents d)"""
PENALTY = """CAST(round(CASE rule_id WHEN 'oversized-file' THEN 4 WHEN 'duplicate-block' THEN 5 WHEN 'potentially-unused-file' THEN 2 ELSE 3 END
 * CASE confidence WHEN 'CONFIRMED' THEN 1 WHEN 'LIKELY' THEN 0.75 ELSE 0.25 END, 6) AS DOUBLE)"""


def labelled_findings(spark, d) -> DataFrame:
    n, m = F.col("doc_id") % 4, F.col("doc_id") % 3
    rule = F.when(n == 0, "oversized-file").when(n == 1, "duplicate-block").when(n == 2, "potentially-unused-file").otherwise("potentially-unused-package")
    category = F.when(n == 0, "size").when(n == 1, "duplication").when(n == 2, "unused").otherwise("packages")
    confidence = F.when(m == 0, "CONFIRMED").when(m == 1, "LIKELY").otherwise("SUSPICIOUS")
    return doc_files(spark, d).select(
        "doc_id", "file", "source", rule.alias("rule_id"), category.alias("category"), confidence.alias("confidence"),
        F.col("file").alias("subject"), F.array().cast("array<string>").alias("related_files"), F.lit(1.0).alias("context_factor"),
    )


@query(f"WITH {LABELLED} SELECT doc_id, rule_id, {PENALTY} AS raw_penalty FROM f")
def raw_penalty(spark, d):
    f = labelled_findings(spark, d)
    weight = score._lookup(score.WEIGHTS, F.col("rule_id"))
    return f.select("doc_id", "rule_id", fn.raw_penalty(weight, fn.confidence_factor(F.col("confidence")), F.lit(1.0)).cast("double").alias("raw_penalty"))


@query(f"""WITH {LABELLED}, p AS (SELECT source AS file, rule_id, {PENALTY} AS raw FROM f), b AS (SELECT file, CASE rule_id WHEN 'oversized-file' THEN 'size' WHEN 'duplicate-block' THEN 'duplication'
 WHEN 'potentially-unused-file' THEN 'unusedFiles' ELSE 'packages' END AS category, raw FROM p)
 SELECT '["' || category || '","' || file || CASE WHEN category = 'size' THEN '"]' ELSE '","x"]' END AS key, max(raw) AS raw_penalty FROM b GROUP BY category, file""")
def argmax_dedupe(spark, d):
    f = labelled_findings(spark, d).withColumn("file", F.col("source")).withColumn("subject", F.lit("x"))
    return score.contributions(f).select("key", F.col("raw_penalty").cast("double").alias("raw_penalty"))


TOP = 25


@query(f"""WITH {LABELLED} SELECT rule_id, file, {PENALTY} AS raw_penalty FROM f ORDER BY {PENALTY} DESC, rule_id, file LIMIT {TOP}""")
def findings_union_topk(spark, d):
    """The findings of four producers, the first TOP by relevance: the cap is the operator."""
    f = labelled_findings(spark, d)
    producers = [f.filter(F.col("rule_id") == r) for r in ("oversized-file", "duplicate-block", "potentially-unused-file", "potentially-unused-package")]
    every = producers[0]
    for p in producers[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    every = every.withColumn("severity", F.lit("warning")).withColumn("line", F.lit(None).cast("int"))
    return rules.relevance_order(every).limit(TOP).select("rule_id", "file", F.col("raw_penalty").cast("double").alias("raw_penalty"))


@query(f"WITH {LABELLED} SELECT rule_id, count(*) AS n FROM f WHERE rule_id IN ('potentially-unused-file', 'potentially-unused-package') GROUP BY rule_id")
def view_filter(spark, d):
    return filters.view(labelled_findings(spark, d), "dead-code").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


CONTEXTS = f"""{LABELLED}, {DOCS}, x AS (SELECT f.doc_id, f.rule_id, {ROLE.replace("source", "f.source")} AS role, lines FROM f JOIN docs USING (doc_id)),
 y AS (SELECT *, least(greatest(lines / {FILE_LINES}.0 - 1, 0), 1) AS excess, {FACTOR} AS role_factor FROM x)
 SELECT doc_id, rule_id, role, CAST(round(CAST(CASE WHEN rule_id = 'oversized-file' THEN excess * role_factor
  WHEN (rule_id = 'duplicate-block' AND role = 'test') OR (rule_id = 'potentially-unused-file' AND role = 'tooling') THEN 0.5 ELSE 1.0 END AS DOUBLE), 6) AS DOUBLE) AS factor,
  CASE WHEN rule_id = 'oversized-file' AND (role = 'migration' OR excess <= 0.2 OR (role_factor < 1 AND lines < {FILE_LINES * 4})) THEN 'info' ELSE 'warning' END AS severity FROM y"""


# --- redaction, escaping -----------------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:password|token|api[_-]?key|secret) = "([^"]*)"', 1)) AS v FROM documents)
 SELECT doc_id, v <> '' AS found, '[redacted:' || left(sha256(v), 12) || ']' AS mark FROM m""")
def secret_redaction_digest(spark, d):
    values = F.regexp_extract_all("text", F.lit('(?i)(?:password|token|api[_-]?key|secret) = "([^"]*)"'), F.lit(1))
    found = table(spark, d, "documents").select("doc_id", F.explode(values).alias("v"))
    safe = redaction.safe_text_udf(F.concat(F.lit('secret = "'), "v", F.lit('"')))
    return found.select("doc_id", (F.col("v") != "").alias("found"), F.regexp_extract(safe, '"(.*)"$', 1).alias("mark"))


@query(f"WITH {CONTEXTS}")
def contextualized_findings(spark, d):
    docs = doc_files(spark, d)
    f = labelled_findings(spark, d).withColumn("line", F.lit(None).cast("int")).withColumn("severity", F.lit("warning")).withColumn("recommendation", F.lit("Look at it."))
    f = f.withColumn("evidence", F.array(F.struct(F.lit(1).alias("column")))).drop("context_factor")
    lines = docs.select(F.lit("oversized-file").alias("rule_id"), "file", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), fn.line_count(F.col("text")).alias("lines"))
    found = rules.contextualized(f, docs.select("file", doc_role().alias("role")), lines, FILE_LINES, FILE_LINES)
    return found.select("doc_id", "rule_id", "context.role", "context.factor", "severity")


@query()
def redacted_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", redaction.safe_text_udf(F.col("text")).alias("text"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(fn.html_escape(F.col("html"))).alias("escaped"))


# --- budgets, diagnostics, coverage ------------------------------------------------------------------------


@query("""WITH r AS (SELECT source, doc_id, strlen(text) AS bytes, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents)
 SELECT source, count(*) FILTER (total <= 50000) AS kept, count(*) FILTER (total > 50000) AS dropped, CAST(max(CASE WHEN total <= 50000 THEN total END) AS BIGINT) AS used FROM r GROUP BY source""")
def running_byte_budget(spark, d):
    files = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("bytes"))
    return budgets.summary(budgets.byte_budget(files, "bytes", ["doc_id"], 50_000, ["source"]), ["source"])


@query("""SELECT event_id, sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS value FROM events)""")
def running_sum(spark, d):
    rows = table(spark, d, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    return running_total(rows, "value", ["event_id"], "total").select("event_id", "total")


@query("""WITH e AS (SELECT 'E' || user_id % 7 AS code, event_id FROM events WHERE event_type = 'error'),
 r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY event_id) AS n FROM e)
 SELECT code, count(*) AS n, string_agg(CASE WHEN n <= 3 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS samples FROM r GROUP BY code""")
def diagnostics_by_code(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("E"), (F.col("user_id") % 7).cast("string")).alias("code"), "event_id")
    return rules.by_code(rows, "event_id").select("code", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("""WITH s AS (SELECT source, count(*) AS files, count(*) FILTER (text = '') AS failed FROM documents GROUP BY source)
 SELECT source, CASE WHEN files = 0 THEN 'unavailable' WHEN failed > 0 OR source = 'src1' THEN 'partial' ELSE 'complete' END AS status FROM s""")
def category_coverage(spark, d):
    facts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("text") == "").alias("failed"))
    state = coverage.status(F.col("files") > 0, (F.col("failed") > 0) | (F.col("source") == "src1"))
    return facts.select("source", state.alias("status"))


@query("SELECT count(*) AS discovered, count(*) FILTER (text <> '') AS analyzed, CAST(sum(strlen(text)) AS BIGINT) AS bytes_read FROM documents")
def acquisition_coverage(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("text") != "").alias("analyzed"), F.sum(F.octet_length("text")).alias("bytes_read"))


@query("SELECT bool_or(event_type = 'error' AND value > 100) AS uncertain FROM events")
def uncertainty(spark, d):
    resolution = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "unresolved").otherwise("internal")
    return filters.is_uncertain(table(spark, d, "events").select(resolution.alias("resolution")))


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 f(source, n, doc_id, bytes, before, used) AS (
  SELECT source, n, doc_id, bytes, 0::BIGINT, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END::BIGINT FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.n, r.doc_id, r.bytes, f.used, (f.used + CASE WHEN f.used < 20000 AND f.used + r.bytes <= 20000 THEN r.bytes ELSE 0 END)::BIGINT
  FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
 SELECT source, doc_id, bytes, before, before < 20000 AND before + bytes <= 20000 AS within FROM f""")
def dependency_budget(spark, d):
    """A fold: what would overflow its source's budget is left out, and later, smaller texts may still fit."""
    files = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("bytes"))
    return budgets.skipping_budget(files, "source", "bytes", ["doc_id"], 20_000)


# --- parsing: sources are written from the tables, parsed, and held against the tables ----------------------


def parsed_sources(files: DataFrame) -> DataFrame:
    from ..model import Configuration
    from .scan import parse_files

    # no source is left out for its size or time; the token lists, which nothing here reads, keep their bound
    limits = {"maxDuplicationTokens": Configuration().limits["maxDuplicationTokens"]}
    return parse_files(files.select(F.lit("tables").alias("repo_id"), "path", "content"), limits)


@query(f"WITH {HREFS} SELECT 'page' || page_id || '.ts' AS file, pos + 1 AS line, '.' || href AS specifier, 'runtime' AS kind FROM e")
def parsed_references(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    text = F.array_join(F.transform(links, lambda x: F.concat(F.lit("import '."), x, F.lit("';"))), "\n")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), text.alias("content"))
    edges = parsed_sources(pages).select(F.inline("dependencies"))
    return edges.select(F.col("from_file").alias("file"), "line", "specifier", "kind")


KINDS = {  # statement around a specifier -> (kind, syntax)
    "import type {{ T }} from {};": ("type-only", "import"), "export * from {};": ("runtime", "re-export"), "const a = require({});": ("runtime", "require"),
    "import({});": ("runtime", "dynamic-import"), "type A = import({});": ("type-only", "import-type"), "import b = require({});": ("runtime", "require"),
}


@query(f"""WITH {HREFS}, k(n, kind, syntax) AS (VALUES {', '.join(f"({i}, '{kind}', '{syntax}')" for i, (kind, syntax) in enumerate(KINDS.values()))})
 SELECT 'page' || page_id || '.ts' AS file, pos + 1 AS line, '.' || href AS specifier, kind, syntax FROM e JOIN k ON n = pos % {len(KINDS)}""")
def parsed_reference_kinds(spark, d):
    def statement(x, i):
        out = F.lit("")
        for n, shape in enumerate(KINDS):
            head, tail = shape.format("|").split("|")
            out = F.when(i % len(KINDS) == n, F.concat(F.lit(head + "'."), x, F.lit("'" + tail))).otherwise(out)
        return out

    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    text = F.array_join(F.transform(links, statement), "\n")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), text.alias("content"))
    edges = parsed_sources(pages).select(F.inline("dependencies"))
    return edges.select(F.col("from_file").alias("file"), "line", "specifier", "kind", "syntax")


@query("""SELECT 'c' || conv_id || '_' || turn || '.ts' AS file, CASE turn % 4 WHEN 0 THEN role || turn WHEN 1 THEN role || turn WHEN 2 THEN 'method' || turn ELSE '(anonymous/computed)' END AS name,
 1 AS line, 3 AS lines FROM conversations""")
def parsed_function_kinds(spark, d):
    """Arrows bound to a name, generators, methods, and callbacks."""
    turns, n = table(spark, d, "conversations"), F.col("turn") % 4
    turn, body = F.col("turn").cast("string"), F.lit(" {\n  step();\n}")
    name = F.concat("role", turn)
    source = (
        F.when(n == 0, F.concat(F.lit("const "), name, F.lit(" = async (x: number): Promise<void> =>"), body, F.lit(";\n")))
        .when(n == 1, F.concat(F.lit("export function* "), name, F.lit("()"), body, F.lit("\n")))
        .when(n == 2, F.concat(F.lit("class A { static method"), turn, F.lit("(y: string): void"), body, F.lit(" }\n")))
        .otherwise(F.concat(F.lit("run(function ()"), body, F.lit(");\n")))
    )
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn, F.lit(".ts"))
    found = parsed_sources(turns.select(path.alias("path"), source.alias("content"))).select(F.inline("functions"))
    return found.select("file", "name", "line", "lines")


@query(f"""WITH t AS (SELECT conv_id, turn, role, {LINES} AS lines FROM conversations)
 SELECT 'c' || conv_id || '_' || turn || '.ts' AS file, role || turn AS name, lines + 2 AS lines FROM t""")
def parsed_functions(spark, d):
    turns = table(spark, d, "conversations")
    name = F.concat("role", F.col("turn").cast("string"))
    body = F.repeat(F.lit("  step();\n"), fn.line_count(F.col("text")))
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".ts"))
    source = F.concat(F.lit("function "), name, F.lit("() {\n"), body, F.lit("}\n"))
    found = parsed_sources(turns.select(path.alias("path"), source.alias("content"))).select(F.inline("functions"))
    return found.select("file", "name", "lines")


@query(f"""WITH {HREFS}, p AS (SELECT page_id, pos, regexp_replace(substr(href, 2), '[^A-Za-z]', '', 'g') AS t FROM e)
 SELECT page_id, pos, '["lib/' || t || '.ts", "lib/' || t || '.tsx"]' AS first_two, 'lib/' || t AS resolved FROM p""")
def candidate_sources(spark, d):
    name = F.regexp_replace(F.substr("href", F.lit(2)), "[^A-Za-z]", "")
    links = page_links(spark, d).withColumn("t", name)
    path = fn.resolved_path(F.lit("src/deep/page.ts"), F.concat(F.lit("../../lib/./"), "t", F.lit(".js")))
    first = F.slice(fn.candidate_paths(path), F.lit(1), F.lit(2))
    shown = F.concat(F.lit('["'), F.array_join(first, '", "'), F.lit('"]'))
    return links.select("page_id", "pos", shown.alias("first_two"), F.regexp_replace(path, r"\.js$", "").alias("resolved"))
