"""A query per operator over the supplied tables, and the same in SQL, written by hand for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.globs import glob_match
from ..functions.minify import minify_udf
from ..functions.tokens import token_estimate
from ..model import Settings
from ..operators import cluster, content, filters, lines, render, shard, sinks, transforms
from ..operators.rows import file_rows as rows_of
from ..sources import files as S
from ..sources import history as H
from ..sources.tables import conversation_files, document_files, page_files, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_EXT = "['cs','py','js','md','json','sql','txt','html']"
#: Views of the file rows, in SQL.
_F = f"f AS (SELECT doc_id AS ord, source || '/' || lang || '/doc' || doc_id || '.' || ext AS relative, ext AS extension, text AS content, CAST(strlen(text) AS BIGINT) AS size, lang FROM (SELECT *, {_EXT}[doc_id % 8 + 1] AS ext FROM documents))"
_LANG = "CASE extension WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' ELSE extension END"
_FOLDERS = ("src", "node_modules", "a/bin", ".git", "lib/secrets", "Docs/API", "src/obj/x", "")
_P = f"{_F}, p AS (SELECT *, [{', '.join(repr(x) for x in _FOLDERS)}][ord % 8 + 1] AS folder FROM f), q AS (SELECT ord, CASE folder WHEN '' THEN relative ELSE folder || '/' || relative END AS path FROM p)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """ord and path of the documents under folders of all kinds, by id in turn."""
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("ord") % len(_FOLDERS) + 1).cast("int"))
    return document_files(spark, d).select("ord", F.when(folder == "", F.col("relative")).otherwise(F.concat_ws("/", folder, "relative")).alias("path"))


# --- file rows


@query(f"WITH {_F} SELECT ord, relative, relative AS display, extension, {_LANG} AS language, size FROM f")
def file_rows(spark, d):
    return document_files(spark, d).select("ord", "relative", "display", "extension", "language", "size")


@query(r"SELECT page_id AS ord, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || '.html' AS relative, 'html' AS extension, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def page_rows(spark, d):
    return page_files(spark, d).select("ord", "relative", "extension", "size")


@query(f"WITH {_F} SELECT {_LANG} AS language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def language_lookup(spark, d):
    return document_files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {_P} SELECT ord, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END AS module FROM q")
def path_parts(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("ord", X.file_name(p).alias("name"), X.extension(p).alias("extension"), X.module_key(p).alias("module"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F]', chr(65533), 'g') AS shown FROM documents")
def printable_path(spark, d):
    return table(spark, d, "documents").select("doc_id", X.printable(F.col("text")).alias("shown"))


@query(f"WITH {_P} SELECT ord, CASE WHEN starts_with('/data/' || path, '/data/src/') THEN substring('/data/' || path, 11) ELSE '/data/' || path END AS relative FROM q")
def root_split(spark, d):
    full = F.concat(F.lit("\\data\\"), "path")
    return _paths(spark, d).select("ord", X.relative_path(full, "/data/src").alias("relative"))


# --- path filters


@query(f"WITH {_P} SELECT ord, path FROM q WHERE regexp_matches(path, '\\.(cs|py)$')")
def ext_filter(spark, d):
    return _paths(spark, d).where(filters.has_extension(F.col("path"), X.normalise_extensions([".CS, py"])))


@query(f"WITH {_P} SELECT ord, path FROM q WHERE regexp_matches(path, '\\.(sql|xml|json|yaml|yml|toml|ini|md|csv|graphql)$')")
def preset_filter(spark, d):
    return _paths(spark, d).where(filters.passes(F.col("path"), filters.PathRules(presets=("data",), system_ignore=())))


@query(f"WITH {_P} SELECT ord, path FROM q WHERE NOT (path LIKE 'node_modules/%' OR path LIKE '%/bin/%' OR path LIKE '.git/%' OR path LIKE '%/secrets/%' OR path LIKE '%/obj/%')")
def system_ignore(spark, d):
    return _paths(spark, d).where(filters.passes(F.col("path"), filters.PathRules()))


@query(rf"WITH {_P} SELECT ord, path FROM q WHERE NOT (regexp_matches(path, '(^|/)doc[^/]*1\.[^/]*(/|$)') OR regexp_matches(path, '\.md$') OR regexp_matches(path, '^src/.*/doc[^/]\.[^/]*$'))")
def glob_exclude(spark, d):
    return _paths(spark, d).where(~glob_match(F.col("path"), ["doc*1.*", "*.md", "src/**/doc?.*"]))


@query(rf"WITH {_P} SELECT ord, path FROM q WHERE regexp_matches(path, '^.*/en/.*$') OR regexp_matches(path, '(^|/)fr/') OR regexp_matches(lower(path), '^docs/api/src1/[^/]*/[^/]*$')")
def glob_include(spark, d):
    rules = filters.PathRules(system_ignore=(), include_path=("**/en/**", "fr/", "DOCS/api/src1/*/*"))
    return _paths(spark, d).where(filters.passes(F.col("path"), rules))


@query(f"WITH {_P} SELECT ord, path FROM q WHERE starts_with(lower(path), 'src/src1/') OR contains(lower(path), '/src/src1/') OR starts_with(lower(path), 'docs/') OR contains(lower(path), '/docs/')")
def search_paths(spark, d):
    return _paths(spark, d).where(filters.under_search_path(F.col("path"), ["./SRC/src1/", "docs"]))


@query(
    rf"WITH {_P} SELECT ord, path, CASE WHEN NOT regexp_matches(path, '\.(cs|py|js|md)$') THEN 'extension' WHEN path LIKE 'node_modules/%' OR path LIKE '%/bin/%' OR path LIKE '.git/%' OR path LIKE '%/secrets/%' OR path LIKE '%/obj/%' THEN 'system_ignore' "
    rf"WHEN regexp_matches(path, '(^|/)doc[^/]*7\.[^/]*(/|$)') THEN 'exclude' WHEN regexp_matches(path, '(^|/)es/') THEN 'exclude_path' WHEN NOT regexp_matches(path, '^.*src1.*$') THEN 'include_path' "
    rf"WHEN NOT (starts_with(path, 'src/') OR contains(path, '/src/')) THEN 'search_path' ELSE 'included' END AS decision FROM q"
)
def explain_filter(spark, d):
    rules = filters.PathRules(extensions=("cs", "py", "js", "md"), exclude=("doc*7.*",), exclude_path=("es/",), include_path=("**src1**/**", "**src1**"), search=("src",))
    return _paths(spark, d).withColumn("decision", filters.explain(F.col("path"), rules))


@query(f"WITH {_F} SELECT ord, relative FROM f WHERE extension = 'py' ORDER BY ord LIMIT 100")
def max_files(spark, d):
    kept = filters.filter_paths(document_files(spark, d), filters.PathRules(extensions=("py",)))
    return filters.first_files(kept, 100).select("ord", "relative")


# --- content

_DIRTY = "SELECT doc_id AS ord, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || chr(0) || text WHEN 2 THEN replace(text, ' ', chr(1)) WHEN 3 THEN '' ELSE repeat('x', 4096) || chr(0) || text END AS content FROM documents"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts: as they are, with a NUL behind them (within the probe or not), with control characters for spaces, empty, and with a NUL just behind the probe, by id in turn."""
    t, k = F.col("text"), F.col("doc_id") % 5
    made = (
        F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("\x00"), t)).when(k == 2, F.translate(t, " ", "\x01"))
        .when(k == 3, F.lit("")).otherwise(F.concat(F.lit("x" * 4096 + "\x00"), t))
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), made.alias("content"))


@query(f"WITH x AS ({_DIRTY}) SELECT ord, instr(left(content, 4096), chr(0)) > 0 AS is_binary, instr(left(content, 4096), chr(0)) > 0 OR len(regexp_extract_all(left(content, 4096), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) > length(left(content, 4096)) * 0.1 AS is_binary_strict FROM x")
def binary_flag(spark, d):
    c = F.col("content")
    return _dirty(spark, d).select("ord", content.is_binary(c).alias("is_binary"), content.is_binary_strict(c).alias("is_binary_strict"))


@query(f"WITH {_F} SELECT ord, relative FROM f WHERE NOT (contains(content, '!!') OR contains(content, '$$$')) AND (contains(content, 'License') OR contains(content, 'the '))")
def content_include_exclude(spark, d):
    kept = content.content_passes(F.col("content"), ["License", "the "], ["!!", "$$$", ""])
    return document_files(spark, d).where(kept).select("ord", "relative")


_MANY = [*(f"{k} " for k in range(100, 150)), *(f"w{k}." for k in range(10)), "$$$", "a|b", "^(x)", "\\\\E", "the end"]


@query(f"WITH {_F} SELECT ord, relative FROM f WHERE {' OR '.join(f'contains(content, {chr(39)}{x}{chr(39)})' for x in _MANY)}")
def many_literals(spark, d):
    """More literals than a chain of contains is made for."""
    return document_files(spark, d).where(content.contains_any(F.col("content"), _MANY)).select("ord", "relative")


@query(f"WITH {_F} SELECT CASE WHEN size > 1048576 THEN 'oversize' WHEN contains(content, '###') THEN 'content_filtered' ELSE 'ok' END AS status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def file_status(spark, d):
    found = content.with_status(document_files(spark, d), 1 << 20, exclude=["###"])
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


# --- lines

_EOL = r"'\r\n|[\n\r\f\x{85}\x{2028}\x{2029}]'"


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, {_EOL}), lambda l: NOT starts_with(ltrim(l, ' '), 'The') AND NOT starts_with(ltrim(l, ' '), 'Et ')), chr(10)) AS content FROM documents")
def line_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", lines.drop_lines(F.col("text"), ["The", "Et "]).alias("content"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), {_EOL}), lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l, ' '), 'A')), chr(10)) AS content FROM documents")
def blank_line_filter(spark, d):
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n"))
    return table(spark, d, "documents").select("doc_id", lines.drop_lines(spaced, ["\\n", "A"]).alias("content"))


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE '```' || CASE doc_id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'JSON ' ELSE '' END || chr(10) || text || chr(10) || '```' || chr(10) || 'after' || chr(10) || '```go' || chr(10) || lang || chr(10) || '```' END AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM t),
    n AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
    o AS (SELECT *, last_value(CASE WHEN fence AND fences % 2 = 1 THEN lower(trim(substring(line, 4))) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS info FROM n)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM o JOIN (SELECT doc_id, contains(text, '```') AS fenced FROM t) USING (doc_id) WHERE NOT fenced OR NOT fence AND fences % 2 = 1 AND info NOT IN ('xml','json','yaml','yml','log','txt','csv','md','sql')"""
)
def fenced_code_lines(spark, d):
    k = F.col("doc_id") % 3
    fenced = F.concat(F.lit("```"), F.when(k == 0, "py").when(k == 1, "JSON ").otherwise(""), F.lit("\n"), "text", F.lit("\n```\nafter\n```go\n"), "lang", F.lit("\n```"))
    text = F.when(F.col("doc_id") % 4 == 3, F.col("text")).otherwise(fenced)
    return lines.fenced_code_lines(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


# --- tokens and other functions

_D = r"\t\n\r\x0b\x0c !-/:-@\[-^`{-~"


def _tokens_sql(c: str) -> str:
    c2 = rf"regexp_replace({c}, '(^|[{_D}])[^\x00-\x7f]+', '\1', 'g')"

    def n(text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, '{pattern}'))"

    runs = rf"coalesce(list_sum(list_transform(regexp_extract_all({c}, '(?:^|[{_D}])([^\x00-\x7f]+)', 1), lambda x: ((length(x) + len(regexp_extract_all(x, '[\x{{10000}}-\x{{10ffff}}]'))) * 2 + 2) // 3)), 0)"
    return rf"CAST({n(c, r'[!-/:-@\[-^`{-~]')} + {n(c, rf'[^{_D}]*[^{_D}\x80-\x{{10ffff}}][^{_D}]*')} + {runs} + {n(c2, f'[^{_D}A-Z][A-Z]')} + {n(c2, '[A-Z][A-Z][a-z]')} + {n(c2, '[0-9][a-z]')} + {n(c2, '[A-Za-z][0-9]')} AS BIGINT)"


@query(f"WITH {_F} SELECT ord, relative, {_LANG} AS language, size, {_tokens_sql('content')} AS tokens FROM f WHERE extension IN ('cs', 'py', 'js', 'md', 'json') ORDER BY upper(relative), ord")
def token_manifest(spark, d):
    kept = filters.filter_paths(document_files(spark, d), filters.PathRules(extensions=("cs", "py", "js", "md", "json")))
    return kept.orderBy(*render.path_order()).select("ord", "relative", "language", "size", token_estimate(F.col("content")).alias("tokens"))


@query(f"SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum({_tokens_sql('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_totals(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || 'KB' WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.5 mb' WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || 'B' END AS given, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1024 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE c_custkey END AS bytes FROM customer")
def size_parse(spark, d):
    k = F.col("c_custkey")
    given = F.when(k % 4 == 0, F.concat(k, F.lit("KB"))).when(k % 4 == 1, F.concat(k, F.lit(".5 mb"))).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(k, F.lit("B")))
    return table(spark, d, "customer").select("c_custkey", given.alias("given")).withColumn("bytes", X.size_in_bytes(F.col("given")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 AND a BETWEEN 1 AND b THEN a END AS slice, CASE WHEN c_custkey % 3 < 2 AND a BETWEEN 1 AND b THEN b END AS shards FROM (SELECT c_custkey, CAST(c_custkey % 9 AS INTEGER) AS a, CAST(c_custkey % 7 AS INTEGER) AS b FROM customer)")
def shard_spec(spark, d):
    k = F.col("c_custkey")
    mark = F.when(k % 3 == 0, F.lit("/")).when(k % 3 == 1, F.lit(" . ")).otherwise(F.lit("-"))
    return table(spark, d, "customer").select("c_custkey", X.shard_of(F.concat((k % 9).cast("string"), mark, (k % 7).cast("string"))).alias("s")).select("c_custkey", "s.slice", "s.shards")


@query("SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.2f KB', floor(s * 100 / 1024.0 + 0.5) / 100) ELSE printf('%.2f MB', floor(s * 100 / 1048576.0 + 0.5) / 100) END AS shown FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1500 WHEN 1 THEN o_orderkey * 64 ELSE o_orderkey * 4096 END AS s FROM orders)")
def size_format(spark, d):
    k = F.col("o_orderkey")
    size = F.when(k % 3 == 0, k % 1500).when(k % 3 == 1, k * 64).otherwise(k * 4096)
    return table(spark, d, "orders").select("o_orderkey", X.format_size(size).alias("shown"))


@query(
    """WITH e AS (SELECT event_id, CAST(floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s < 7200 THEN '' ELSE 's' END || ' ago' WHEN s < 172800 THEN 'yesterday'
    WHEN s < 2592000 THEN (s // 86400) || ' days ago' WHEN s < 31536000 THEN (s // 2592000) || ' month' || CASE WHEN s < 5184000 THEN '' ELSE 's' END || ' ago' ELSE (s // 31536000) || ' year' || CASE WHEN s < 63072000 THEN '' ELSE 's' END || ' ago' END AS shown FROM e"""
)
def relative_time(spark, d):
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts").alias("now"))
    return events.crossJoin(F.broadcast(latest)).select("event_id", X.relative_time(F.col("ts"), F.col("now")).alias("shown"))


_SYMBOLS_SQL = "list_concat(list_concat(range(57344, 57404), range(57420, 57436)), list_concat(range(57472, 57492), range(57600, 57620)))"


@query(f"SELECT p_partkey, chr(CAST({_SYMBOLS_SQL}[(((p_partkey - 50) % 116) + 116) % 116 + 1] AS INTEGER)) AS symbol FROM part")
def symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", X.symbol(F.col("p_partkey") - 50).alias("symbol"))


@query(r"SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n, CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[\p{L}\p{Nd}_]*$'))) AS BIGINT) AS names, CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '[\p{L}\p{Nd}_]{6}'))) AS BIGINT) AS long_words FROM documents")
def literal_search(spark, d):
    words = F.split("text", " ", -1)
    names, long_words = F.size(F.filter(words, X.is_identifier)), F.size(F.filter(words, lambda w: X.has_long_word(w)))
    return table(spark, d, "documents").select("doc_id", X.count_occurrences(F.col("text"), F.lit("the")).alias("n"), names.cast("long").alias("names"), long_words.cast("long").alias("long_words"))


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+'), lambda w: CASE w WHEN 'the' THEN 'THE' ELSE w END), '') AS text FROM documents")
def word_replace(spark, d):
    return table(spark, d, "documents").select("doc_id", X.replace_word(F.col("text"), "the", "THE").alias("text"))


# --- rendering

#: The limit of the settings' default, and one that shows what becomes of longer files.
_WHOLE, _SHORT = 1 << 20, 20_000


def _r(limit: int) -> str:
    return f"{_F}, s AS (SELECT *, CASE WHEN size > {limit} THEN 'oversize' WHEN contains(content, '!!') THEN 'content_filtered' ELSE 'ok' END AS status, regexp_replace(content, '[ \\t\\r\\n]+$', '') AS body FROM f), r AS (SELECT *, CASE status WHEN 'ok' THEN '## File: ' || relative || chr(10) || '````' || {_LANG} || chr(10) || CASE body WHEN '' THEN '' ELSE body || chr(10) END || '````' || chr(10) || chr(10) WHEN 'oversize' THEN '[File too large: ' || relative || ']' || chr(10) ELSE '[Skipped by content filter: ' || relative || ']' || chr(10) END AS section FROM s)"


_R = _r(_WHOLE)


def _rendered(spark: SparkSession, d: str, limit: int = _WHOLE) -> DataFrame:
    found = content.with_status(document_files(spark, d), limit, exclude=["!!"])
    return render.with_section(render.with_body(found))


@query(f"WITH {_r(_SHORT)} SELECT ord, status, section, CAST(strlen(section) AS BIGINT) AS section_bytes FROM r")
def render_sections(spark, d):
    """With the short limit, to show the placeholder of longer files."""
    return _rendered(spark, d, _SHORT).select("ord", "status", "section", "section_bytes")


@query(f"WITH {_R} SELECT ord, split_part(relative, '/', 1) AS module, CAST(sum(CASE status WHEN 'ok' THEN strlen(section) ELSE 0 END) OVER (PARTITION BY split_part(relative, '/', 1) ORDER BY upper(relative), ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM r")
def running_bytes_guard(spark, d):
    found = render.check_output_size(_rendered(spark, d), 1 << 50).withColumn("module", X.module_key(F.col("relative")))
    return render.running_bytes(found, render.path_order(), "module").select("ord", "module", "running_bytes")


_STRUCTURE = "'_Project Structure:_ ' || chr(10) || '```text' || chr(10) || string_agg(relative || chr(10), '' ORDER BY upper(relative), ord) || '```' || chr(10) || chr(10)"


@query(f"WITH {_R} SELECT split_part(relative, '/', 1) AS module, {_STRUCTURE} AS structure FROM r WHERE status = 'ok' GROUP BY ALL")
def structure_footer(spark, d):
    return render.structure(_rendered(spark, d).withColumn("module", X.module_key(F.col("relative"))), by=["module"])


@query(f"WITH {_R}, a AS (SELECT split_part(relative, '/', 1) AS module, string_agg(section, '' ORDER BY upper(relative), ord) AS sections FROM r GROUP BY ALL), b AS (SELECT split_part(relative, '/', 1) AS module, {_STRUCTURE} AS structure FROM r WHERE status = 'ok' GROUP BY ALL) SELECT module, sections || coalesce(structure, '') AS document FROM a LEFT JOIN b USING (module)")
def packed_document(spark, d):
    return render.document(_rendered(spark, d).withColumn("module", X.module_key(F.col("relative"))), by=["module"])


@query(f"WITH {_R} SELECT count(*) AS files, count(*) FILTER (WHERE status = 'ok') AS shown, CAST(sum(strlen(section)) AS BIGINT) AS bytes, CAST(sum({_tokens_sql('section')}) FILTER (WHERE status = 'ok') AS BIGINT) AS tokens FROM r")
def totals(spark, d):
    return render.totals(_rendered(spark, d))


@query("SELECT doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 3)) + 1) AS fence, regexp_replace(t, '[ \\t\\r\\n]+$', '') AS trimmed FROM (SELECT doc_id, text || repeat('`', CAST(doc_id % 7 AS INTEGER)) || 'x' || repeat('`', CAST(doc_id % 3 AS INTEGER)) || '  ' || chr(9) || chr(13) || chr(10) AS t FROM documents)")
def fence_and_trim(spark, d):
    k = F.col("doc_id")
    t = F.concat(F.col("text"), F.repeat(F.lit("`"), (k % 7).cast("int")), F.lit("x"), F.repeat(F.lit("`"), (k % 3).cast("int")), F.lit("  \t\r\n"))
    return table(spark, d, "documents").select("doc_id", X.fence_for(t).alias("fence"), X.trim_end(t).alias("trimmed"))


@query(
    f"""WITH x AS ({_DIRTY}), s AS (SELECT ord, 'd' || ord || '.txt' AS relative, content, CASE WHEN ord % 7 = 0 THEN 'error' WHEN instr(left(content, 4096), chr(0)) > 0 THEN 'binary' ELSE 'ok' END AS status, regexp_replace(content, '[ \\t\\r\\n]+$', '') AS body FROM x)
    SELECT ord, status, CASE status WHEN 'ok' THEN '## File: ' || relative || chr(10) || '````txt' || chr(10) || CASE body WHEN '' THEN '' ELSE body || chr(10) END || '````' || chr(10) || chr(10) WHEN 'binary' THEN '[Skipping binary file: ' || relative || ']' || chr(10) ELSE '[Error reading file: ' || relative || ']' || chr(10) END AS section FROM s"""
)
def render_placeholders(spark, d):
    """Texts with NULs and files that could not be read: what stands in their place."""
    k = F.col("ord")
    failed = F.when(k % 7 == 0, F.lit("gone"))
    found = rows_of(_dirty(spark, d), F.concat(F.lit("d"), k.cast("string"), F.lit(".txt")), k, F.col("content"), error=failed)
    return render.with_section(render.with_body(content.with_status(found, 1 << 30))).select("ord", "status", "section")


@query(f"WITH {_R} SELECT CAST(sum({_tokens_sql('content')}) AS BIGINT) AS tokens FROM r WHERE status = 'ok'")
def token_count(spark, d):
    return sinks.count_tokens(content.with_status(document_files(spark, d), _WHOLE, exclude=["!!"]))


@query(f"WITH {_F} SELECT relative AS display FROM f WHERE extension IN ('py', 'md')")
def dry_run(spark, d):
    return sinks.dry_run(filters.filter_paths(document_files(spark, d), filters.PathRules(extensions=("py", "md"))))


# --- shards

_SHARDS = 5
_U = f"""{_F}, m AS (SELECT *, split_part(relative, '/', 1) AS module FROM f),
g AS (SELECT module, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM m GROUP BY module),
t AS (SELECT CAST(floor(sum(bytes) / {_SHARDS}.0 * 1.5) AS BIGINT) AS target FROM g),
u AS (SELECT module, bytes, 0 AS pos, CAST(NULL AS BIGINT) AS ord, bytes AS unit FROM g, t WHERE files = 1 OR bytes <= target
  UNION ALL SELECT module, bytes, row_number() OVER (PARTITION BY module ORDER BY size DESC, ord), ord, size FROM m JOIN g USING (module), t WHERE files > 1 AND bytes > target),
n AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, module, pos) AS k FROM u),
w(k, loads, pick) AS (SELECT CAST(0 AS BIGINT), list_transform(range({_SHARDS}), lambda i: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
  UNION ALL SELECT n.k, list_transform(range({_SHARDS}), lambda i: CASE WHEN i + 1 = list_position(w.loads, list_min(w.loads)) THEN w.loads[i + 1] + n.unit ELSE w.loads[i + 1] END), CAST(list_position(w.loads, list_min(w.loads)) AS BIGINT)
  FROM w JOIN n ON n.k = w.k + 1),
z AS (SELECT n.*, w.pick FROM n JOIN w USING (k)),
a AS (SELECT m.ord, m.relative, m.size, CAST(z.pick AS INTEGER) AS shard_id FROM m JOIN z ON m.module = z.module AND (z.pos = 0 OR z.ord = m.ord))"""


def _modules(spark: SparkSession, d: str) -> DataFrame:
    return document_files(spark, d)


@query(f"WITH RECURSIVE {_U} SELECT ord, relative, shard_id FROM a")
def shard_assign(spark, d):
    return shard.assign_shards(_modules(spark, d), _SHARDS).select("ord", "relative", "shard_id")


@query(f"WITH RECURSIVE {_U} SELECT shard_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY shard_id")
def shard_sizes(spark, d):
    return shard.shard_sizes(shard.assign_shards(_modules(spark, d), _SHARDS))


@query(f"WITH RECURSIVE {_U} SELECT ord, relative, size FROM a WHERE shard_id = 2")
def shard_slice(spark, d):
    return shard.take_shard(shard.assign_shards(_modules(spark, d), _SHARDS), 2).select("ord", "relative", "size")


# --- clusters


@query(
    """WITH c AS (SELECT 'conv' || conv_id AS repo, turn || '_' || role || '.md' AS relative, conv_id * 1000 + turn AS ord, text FROM conversations),
    o AS (SELECT repo, row_number() OVER (ORDER BY upper(repo), repo) AS repo_order FROM (SELECT DISTINCT repo FROM c)),
    a AS (SELECT repo_order, 1 AS seq, ord, repo || '/' || relative AS display, regexp_replace(text, '[ \\t\\r\\n]+$', '') AS body FROM c JOIN o USING (repo)),
    s AS (SELECT repo_order, seq, ord, display, '## File: ' || display || chr(10) || '````markdown' || chr(10) || CASE body WHEN '' THEN '' ELSE body || chr(10) END || '````' || chr(10) || chr(10) AS section FROM a
      UNION ALL SELECT repo_order, 0, 0, '[' || repo || ']', CASE WHEN repo_order = 1 THEN '# ' || repo ELSE '---' || chr(10) || '# ' || repo || chr(10) || '---' END || chr(10) || chr(10) FROM o)
    SELECT CAST(repo_order AS BIGINT) AS repo_order, seq, ord, display, section FROM s"""
)
def cluster_pack(spark, d):
    marked = cluster.with_markers(conversation_files(spark, d))
    found = render.with_section(render.with_body(content.with_status(marked, 1 << 20)))
    return found.select("repo_order", "seq", "ord", "display", "section")


@query(
    """WITH c AS (SELECT 'conv' || conv_id AS repo, conv_id % 11 = 0 AS bad, turn || '_' || role || '.md' AS relative FROM conversations)
    SELECT repo, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, count(*) AS files, CAST(sum(CASE WHEN bad THEN strlen('[Error reading file: ' || repo || '/' || relative || ']') + 1 ELSE 0 END) AS BIGINT) AS note_bytes FROM c GROUP BY ALL"""
)
def fault_isolation(spark, d):
    """Repositories that can't be read keep their place and leave the others alone."""
    number = F.substring("repo", 5, 20).cast("long")
    found = conversation_files(spark, d).withColumn("error", F.when(number % 11 == 0, F.lit("broken")))
    shown = render.with_section(render.with_body(content.with_status(cluster.with_markers(cluster.with_errors(found)), 1 << 20))).where("kind = 'file'")
    notes = F.when(F.col("status") == "error", F.col("section_bytes")).otherwise(F.lit(0))
    return shown.groupBy("repo", "status").agg(F.count(F.lit(1)).alias("files"), F.sum(notes).cast("long").alias("note_bytes"))


# --- snapshots and history


@query("SELECT doc_id AS ord, source || '/' || doc_id AS relative FROM documents WHERE contains(text, '!!') OR doc_id NOT IN (SELECT doc_id FROM labels)")
def changed_since(spark, d):
    """The documents against an older snapshot of them: it has the labelled ones, all without '!!'."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative"), F.col("text").alias("content"))
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("ord"))
    old = docs.join(labelled, "ord", "left_semi").withColumn("content", F.replace("content", F.lit("!!"), F.lit("")))
    return S.changed_since(old, docs).select("ord", "relative")


@query(
    """WITH e AS (SELECT 'u' || user_id AS directory, event_type AS arguments, max(ts) AS last_run FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (ORDER BY last_run DESC, directory, arguments) AS number FROM e)
    SELECT CAST(number AS INTEGER) AS number, directory, arguments, last_run FROM n WHERE number <= 50"""
)
def history_upsert(spark, d):
    runs = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("directory"), F.array("event_type").alias("arguments"), F.col("ts").alias("last_run"))
    old, new = runs.where("last_run < timestamp'2000-01-01'"), runs
    return H.numbered(H.upsert(old, new)).select("number", "directory", F.element_at("arguments", 1).alias("arguments"), "last_run")


# --- Python functions: no SQL, tested against plain Python


@query()
def minify(spark, d):
    return spread(document_files(spark, d)).select("ord", minify_udf(F.col("content"), F.col("language")).alias("content"))


@query()
def minify_pages(spark, d):
    return spread(page_files(spark, d)).select("ord", minify_udf(F.col("content"), F.col("language")).alias("content"))


@query()
def phrase_candidates(spark, d):
    return transforms.phrase_candidates(spread(table(spark, d, "documents")), "doc_id", "text")


@query()
def phrase_compress(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", F.col("text").alias("document"))
    return transforms.apply_transforms(docs, [transforms.compress_phrases()])


@query()
def brain_pack(spark, d):
    """Documents of each module: minified, packed, and their phrases compressed; above render.PART bytes of files in parts, one row each."""
    from .pack import pack

    result = pack(spread(document_files(spark, d)), brain=True, max_output="999GB", settings=Settings(max_files=filters.NO_LIMIT))
    parts = render.document_parts(result.rows.withColumn("module", X.module_key(F.col("relative"))), "module")
    return transforms.compress_parts(parts).drop("legend", "parts")


