"""Queries of text functions, chunking and files."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import decisions, grammar, redact, scoring, tokens
from ..functions import text as tx
from ..operators import chunks, memory
from ..sources import files as fs
from .base import AS_OF, files, query, t

IGNORE = ("*.html", "src1/*", "**/fr/*", "build/")
URL_PATH = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _paths(spark, sf):
    own = t(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("file_path"))
    return files(spark, sf).select("file_path").unionByName(own).distinct()


PATHS = f"paths AS (SELECT file_path FROM files UNION SELECT {URL_PATH} FROM pages)"


@query("chunk_module_ids", r"SELECT substr(sha256(file_path || ':module'), 1, 16) AS id, file_path, 1 AS start_line, CAST(len(string_split(trim(content, E' \t\n\r\x0b\x0c'), chr(10))) AS INT) AS end_line, language FROM files", ("files",))
def chunk_module_ids(spark, sf):
    return chunks.module_chunks(files(spark, sf)).select("id", "file_path", "start_line", "end_line", "language")


@query("ignore_glob_filter", f", {PATHS} SELECT file_path, regexp_matches(split_part(file_path, '/', -1), '^(?s:.*\\.html)$') OR starts_with(file_path, 'src1/') OR contains('/' || file_path, '/fr/') AS ignored FROM paths", ("files",))
def ignore_glob_filter(spark, sf):
    return _paths(spark, sf).select("file_path", tx.ignored(F.col("file_path"), IGNORE).alias("ignored"))


@query("language_map", f", {PATHS}, e AS (SELECT file_path, regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1) AS ext FROM paths) SELECT file_path, CASE ext " + " ".join(f"WHEN '.{k}' THEN '{v}'" for k, v in fs.LANGUAGES.items()) + " ELSE 'plaintext' END AS language FROM e", ("files",))
def language_map(spark, sf):
    return _paths(spark, sf).select("file_path", fs.language(F.col("file_path")).alias("language"))


@query("safe_read_filter", "SELECT file_path, octet_length(encode(content)) AS n_bytes, octet_length(encode(content)) <= 2097152 AS readable FROM files", ("files",))
def safe_read_filter(spark, sf):
    raw = F.col("content").cast("binary")
    return files(spark, sf).select("file_path", F.octet_length("content").cast("bigint").alias("n_bytes"), fs.readable(raw).alias("readable"))


@query("token_counts", "SELECT doc_id, greatest(1, CAST(floor(length(content) / 3.3) AS BIGINT)) AS packed, greatest(1, length(content) // 4) AS counted, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END AS memory, octet_length(encode(content)) // 6 AS json FROM files", ("files",))
def token_counts(spark, sf):
    c = F.col("content")
    return files(spark, sf).select("doc_id", tokens.packed_tokens(c).alias("packed"), tokens.counted_tokens(c).alias("counted"), tokens.memory_tokens(c).alias("memory"), tokens.json_tokens(F.octet_length(c)).alias("json"))


CONFIDENCE = "greatest(0.0, least(1.0, 0.5 * greatest(0.0, 1 - d) + 0.4 * greatest(0.0, 1 - k / 5) + 0.1 * CASE WHEN m IS NULL THEN 0.5 WHEN 1700000000 - m <= 0 THEN 1.0 ELSE pow(0.5, (1700000000 - m) / 604800) END))"


@query(
    "confidence_levels",
    "SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, " + CONFIDENCE + " AS score FROM (SELECT doc_id, n_chars / 5000.0 AS d, CASE lang WHEN 'en' THEN 0.0 WHEN 'de' THEN 2.0 ELSE 6.0 END AS k, CASE WHEN lang <> 'es' THEN 1700000000 + 1000000 - n_chars * 1000 END AS m FROM documents))",
)
def confidence_levels(spark, sf):
    keyword = F.when(F.col("lang") == "en", 0.0).when(F.col("lang") == "de", 2.0).otherwise(6.0)
    modified = F.when(F.col("lang") != "es", F.lit(1_701_000_000) - F.col("n_chars") * 1000)
    score = scoring.confidence(F.col("n_chars") / 5000.0, keyword, modified)
    return t(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score"), scoring.level(score).alias("level"))


FORMS = ("{}", "how does {} work", "where is {} defined", "why did we {}", "find the {} function in main.py")
ASKED = "s AS (SELECT item_id, form, " + "CASE form " + " ".join(f"WHEN {i} THEN '" + f.replace("{}", "' || text || '") + "'" for i, f in enumerate(FORMS)) + " END AS q FROM benchmark, generate_series(0, 4) g(form))"


def _spoken(spark, sf):
    forms = F.explode(F.array(*(F.struct(F.lit(i).alias("form"), F.concat(*(x for k, part in enumerate(f.split("{}")) for x in ([F.lit(part)] if k == 0 else [F.col("text"), F.lit(part)]))).alias("q")) for i, f in enumerate(FORMS))))
    return t(spark, sf, "benchmark").select("item_id", forms.alias("x")).select("item_id", "x.*")


def _any(patterns):
    return "regexp_matches(lower(q), '" + "|".join(f"(?:{p})" for p in patterns) + "')"


INTENT = f"CASE WHEN {_any(tx.DECISION)} THEN 'decision_recall' WHEN {_any(tx.ARCHITECTURE)} THEN 'architecture' WHEN {_any(tx.CODE)} THEN 'code_lookup' ELSE 'general' END"


@query("intent_classify", f"WITH {ASKED} SELECT item_id, CAST(form AS INT) AS form, {INTENT} AS intent FROM s")
def intent_classify(spark, sf):
    return _spoken(spark, sf).select("item_id", "form", tx.intent(F.col("q")).alias("intent"))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "keyword_extract",
    f"WITH {ASKED}, k AS (SELECT item_id, form, list_concat(regexp_extract_all(q, '[A-Z][a-zA-Z0-9]+'), list_filter(regexp_extract_all(q, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains({_list(tx.STOP_WORDS)}, lower(w)) AND ({INTENT} = 'code_lookup' OR NOT list_contains({_list(tx.CODE_PREFIXES)}, lower(w))))) AS words FROM s) SELECT item_id, CAST(form AS INT) AS form, array_to_string(list_filter(words, lambda w, i: list_position(words, w) = i), '|') AS keywords FROM k",
)
def keyword_extract(spark, sf):
    return _spoken(spark, sf).select("item_id", "form", F.array_join(tx.keywords(F.col("q")), "|").alias("keywords"))


@query("file_hints", f"SELECT item_id AS id, array_to_string(regexp_extract_all(text, '{tx.FILE_HINT}'), '|') AS hints FROM benchmark UNION ALL SELECT page_id, array_to_string(regexp_extract_all(url, '{tx.FILE_HINT}'), '|') FROM pages")
def file_hints(spark, sf):
    hints = lambda c: F.array_join(tx.file_hints(F.col(c)), "|").alias("hints")
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), hints("text")).unionByName(t(spark, sf, "pages").select(F.col("page_id").alias("id"), hints("url")))


@query("stopword_strip", r"WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM conversations), c AS (SELECT *, list_filter(list_transform(words, lambda x: lower(x)), lambda x: NOT list_contains(" + _list(tx.TOPIC_STOP_WORDS) + ", x)) AS content FROM w) SELECT conv_id, turn, array_to_string(CASE WHEN len(content) > 0 THEN content ELSE words END, ' ') AS topic FROM c")
def stopword_strip(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tx.topic_words(F.col("text")), " ").alias("topic"))


@query(
    "keyword_distance",
    f"WITH k AS (SELECT item_id AS query_id, list_concat(regexp_extract_all(text, '[A-Z][a-zA-Z0-9]+'), list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains({_list(tx.STOP_WORDS + tx.CODE_PREFIXES)}, lower(w)))) AS words, regexp_extract_all(text, '{tx.FILE_HINT}') AS hints FROM benchmark WHERE item_id % 50 = 0) "
    "SELECT query_id, page_id, CASE WHEN coalesce(list_bool_or(list_transform(hints, lambda h: contains(url, h))), false) OR coalesce(list_bool_or(list_transform(words, lambda w: contains(lower(html), lower(w)))), false) THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS distance FROM k, pages",
)
def keyword_distance(spark, sf):
    from ..operators.search import small

    words = t(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), tx.keywords(F.col("text"), F.lit("general")).alias("words"), tx.file_hints(F.col("text")).alias("hints"))
    pages = t(spark, sf, "pages").crossJoin(small(words))
    return pages.select("query_id", "page_id", tx.keyword_distance(F.col("words"), F.col("hints"), F.col("url"), F.col("html")).alias("distance"))


@query("truncation_summary", r"SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(substr(s, 1, 199), '\s+$', '') || '…' END AS summary FROM (SELECT doc_id, regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '') AS s FROM files)", ("files",))
def truncation_summary(spark, sf):
    return files(spark, sf).select("doc_id", tx.truncated(F.col("content")).alias("summary"))


@query("fallback_compress", "SELECT doc_id, level, CASE WHEN length(content) <= most THEN content ELSE substr(content, 1, most) || '...' END AS compressed FROM files, (VALUES ('minimal', 100), ('standard', 300), ('full', 800), ('other', 300)) v(level, most)", ("files",))
def fallback_compress(spark, sf):
    levels = F.explode(F.array(*map(F.lit, ("minimal", "standard", "full", "other"))))
    return files(spark, sf).select("doc_id", "content", levels.alias("level")).select("doc_id", "level", tx.fallback(F.col("content"), F.col("level")).alias("compressed"))


@query(
    "signature_extract",
    ", f AS (SELECT doc_id, string_split(content, chr(10)) AS lines, 0 AS k, 0 AS chars, false AS doc, false AS done FROM files "
    "UNION ALL SELECT doc_id, lines, CASE WHEN over THEN k ELSE k + 1 END, CAST(chars + length(line) + 1 AS INT), doc OR quote, over OR (quote AND doc) OR (NOT (doc OR quote) AND ends_with(rtrim(line, ' '), ':') AND k > 0) "
    "FROM (SELECT *, lines[k + 1] AS line, chars + length(lines[k + 1]) > 300 AND k > 0 AS over, contains(lines[k + 1], '\"\"\"') OR contains(lines[k + 1], repeat(chr(39), 3)) AS quote FROM f WHERE NOT done AND k < len(lines))) "
    "SELECT doc_id, array_to_string(any_value(lines)[1:max(k)], chr(10)) AS signature FROM f GROUP BY doc_id",
    ("files",),
)
def signature_extract(spark, sf):
    return files(spark, sf).select("doc_id", tx.signature(F.col("content"), 300).alias("signature"))


IDENTIFIERS = (
    "WITH i AS (SELECT conv_id, turn, text, list_concat(list_filter(list_concat(regexp_extract_all(text, '" + tx.IDENTIFIER_PATTERNS[0] + "', 1), list_concat(regexp_extract_all(text, '" + tx.IDENTIFIER_PATTERNS[1] + "', 1), regexp_extract_all(text, '" + tx.IDENTIFIER_PATTERNS[2] + "', 1))), lambda w: length(w) >= 3 AND NOT list_contains(['self', 'None', 'True', 'False'], w)), "
    r"list_concat(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '(?:def|function)\s+\w+\s*\(([^)]*)\)', 1), lambda p: string_split_regex(p, '[,\s]+'))), lambda p: trim(split_part(split_part(p, ':', 1), '=', 1), ' ')), lambda w: length(w) >= 3 AND NOT list_contains(['self', 'cls', 'None', 'True', 'False'], w)), "
    r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]+')))) AS found FROM conversations), "
    "n AS (SELECT *, list_sort(list_distinct(found)) AS names, lower(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '...' END) AS summary FROM i) "
    "SELECT conv_id, turn, array_to_string(names, '|') AS identifiers, len(names) = 0 OR len(list_filter(names, lambda w: contains(summary, lower(w)))) / greatest(len(names), 1) >= 0.4 AS kept FROM n"
)


@query("identifier_quality", IDENTIFIERS)
def identifier_quality(spark, sf):
    summary = tx.fallback(F.col("text"), F.lit("standard"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tx.identifiers(F.col("text")), "|").alias("identifiers"), tx.keeps_identifiers(F.col("text"), summary).alias("kept"))


@query(
    "relative_time",
    f"WITH d AS (SELECT event_id, greatest(0, {AS_OF} - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' WHEN s < 31536000 THEN (s // 2592000) || 'mo ago' ELSE (s // 31536000) || 'y ago' END AS age FROM d",
)
def relative_time(spark, sf):
    return t(spark, sf, "events").select("event_id", tx.relative_time(F.unix_seconds(F.col("ts").cast("timestamp")), AS_OF).alias("age"))


@query("grammar_compress")
def grammar_compress(spark, sf):
    out = t(spark, sf, "conversations").select("conv_id", "turn", "text", *(grammar.compressed(F.col("text"), x).alias(x) for x in ("lite", "full", "ultra")))
    return out.select("conv_id", "turn", "lite", "full", "ultra", tokens.memory_tokens(F.col("text")).alias("raw_tokens"), tokens.memory_tokens(F.col("lite")).alias("lite_tokens"), F.round(grammar.ratio(F.col("text"), F.col("ultra")), 6).alias("ratio"))


@query("grammar_expand")
def grammar_expand(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", grammar.expanded(grammar.compressed(F.col("text"), "ultra")).alias("expanded"))


@query("decision_extract")
def decision_extract(spark, sf):
    told = F.concat(F.lit("We decided to use "), F.substring_index("text", ".", 1), F.lit(" because of "), F.substring_index(F.substring_index("text", ".", 2), ".", -1), F.lit(". "), F.col("text"))
    rows = t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.posexplode(decisions.extracted(told)).alias("place", "d")).select("session_id", "at", "place", "d.*")
    return memory.first_decisions(rows)


_IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"


def _personal_sql():
    luhn = "list_sum(list_transform(list_reverse(string_split(regexp_replace(c, '[ -]', '', 'g'), '')), lambda d, i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(d AS INT) > 4 THEN CAST(d AS INT) * 2 - 9 ELSE CAST(d AS INT) * 2 END ELSE CAST(d AS INT) END)) % 10 = 0"
    out = "masked"
    for kind, pattern in redact.PERSONAL:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    kinds = ", ".join(f"CASE WHEN regexp_matches(masked, '{p}') THEN '{k}' END" for k, p in redact.PERSONAL)
    return (
        f"WITH n AS (SELECT doc_id, text, list_filter(list_distinct(regexp_extract_all(text, '{redact.CARD}')), lambda c: {luhn}) AS cards FROM documents), "
        "m AS (SELECT doc_id, cards, list_reduce(list_concat([text], cards), lambda x, c: replace(x, c, '[REDACTED:CARD]')) AS masked FROM n) "
        f"SELECT doc_id, sha256({out}) AS text_sha256, concat_ws(',', CASE WHEN len(cards) > 0 THEN 'CARD' END, {kinds}) AS kinds FROM m"
    )


@query("redact_pii", _personal_sql())
def redact_pii(spark, sf):
    out, kinds = redact.personal(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.sha2(out, 256).alias("text_sha256"), F.array_join(kinds, ",").alias("kinds"))


@query("redact_email_ipv4", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '" + dict(redact.PERSONAL)["EMAIL"] + "', '[REDACTED:EMAIL]', 'g'), '" + _IPV4 + "', '[REDACTED:IPV4]', 'g')) AS text_sha256 FROM documents")
def redact_email_ipv4(spark, sf):
    out, _ = redact._replaced(F.col("text"), redact.PERSONAL[:2])
    return t(spark, sf, "documents").select("doc_id", F.sha2(out, 256).alias("text_sha256"))


def _secrets_sql():
    """The same patterns for an engine without look-ahead, whose groups are \\1 and so on."""
    out, kinds = "text", []
    for kind, pattern in redact.SECRETS:
        own = pattern.replace("(?=@)", "(@)").replace("'", "''")
        left, right = ("\\1" if own != pattern or kind == "ASSIGNED_SECRET" else ""), ("\\2" if kind == "URL_PASSWORD" else "")
        out = f"regexp_replace({out}, '{own}', '{left}[REDACTED:{kind}]{right}', 'g')"
        kinds.append(f"CASE WHEN regexp_matches(text, '{own}') THEN '{kind}' END")
    return f"SELECT doc_id, sha256({out}) AS text_sha256, concat_ws(',', {', '.join(kinds)}) AS kinds FROM documents"


@query("redact_secrets", _secrets_sql())
def redact_secrets(spark, sf):
    out, kinds = redact.secrets(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.sha2(out, 256).alias("text_sha256"), F.array_join(kinds, ",").alias("kinds"))


@query("secret_files", r", " + PATHS + r" SELECT file_path, regexp_matches(lower(file_path), '^(?:" + "|".join(redact.SECRET_FILES) + r")$') AS secret FROM paths", ("files",))
def secret_files(spark, sf):
    return _paths(spark, sf).select("file_path", redact.is_secret_file(F.col("file_path")).alias("secret"))


@query("extractive_summary")
def extractive_summary(spark, sf):
    return memory.summaries(t(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "summary", memory.tier(F.col("text")).alias("tier"))


@query(
    "import_extract",
    ", w AS (SELECT file_path, source, split_part(ltrim(regexp_replace(lower(split_part(content, ' ', 1)), '[^a-z.]', '', 'g'), '.'), '.', 1) AS m FROM files) "
    "SELECT file_path, 0 AS place, m AS module FROM w WHERE m <> '' UNION ALL SELECT file_path, CASE WHEN m <> '' THEN 1 ELSE 0 END AS place, source AS module FROM w WHERE m <> source",
    ("files",),
)
def import_extract(spark, sf):
    """Import lines made of words of the documents, as no source code is at hand."""
    line = F.concat(F.lit("import "), F.regexp_replace(F.lower(F.substring_index("content", " ", 1)), "[^a-z.]", ""), F.lit("\nfrom "), F.col("source"), F.lit(".base import x\n"))
    return chunks.imports(files(spark, sf).select("file_path", line.alias("content"), F.lit("python").alias("language")))


JS_SOURCE = ("class C {\n  m(a) { return \"}\"; }\n}\n/* ", " */\nexport const f = x => x + 1;\nfunction g() { return '{'; }\n")
RUST_SOURCE = ("pub struct S { x: i32 }\n/* ", " */\nimpl S {\n    fn m(&self) -> char { '}' }\n}\n")
#: (file, type, first and last line, whether the text's lines come before, content)
SOURCE_CHUNKS = [
    ("js", "class", 1, 3, 0, "class C {\n  m(a) { return \"}\"; }\n}"),
    ("js", "function", 2, 2, 0, "m(a) { return \"}\"; }"),
    ("js", "function", 5, 5, 1, "x => x + 1"),
    ("js", "function", 6, 6, 1, "function g() { return '{'; }"),
    ("rs", "class", 1, 1, 0, "pub struct S { x: i32 }"),
    ("rs", "class", 3, 5, 1, "impl S {\n    fn m(&self) -> char { '}' }\n}"),
    ("rs", "function", 4, 4, 1, "fn m(&self) -> char { '}' }"),
]


@query(
    "source_chunks",
    ", n AS (SELECT file_path, length(content) - length(replace(content, chr(10), '')) AS n FROM files) "
    + " UNION ALL ".join(f"SELECT file_path || '.{x}' AS file_path, '{kind}' AS chunk_type, CAST({a} + {k} * n AS INTEGER) AS start_line, CAST({b} + {k} * n AS INTEGER) AS end_line, '{hashlib.sha256(c.encode()).hexdigest()}' AS content_sha256 FROM n" for x, kind, a, b, k, c in SOURCE_CHUNKS),
    ("files",),
)
def source_chunks(spark, sf):
    """Two sources for each document, with its whole text as a comment amid definitions, as no source code is at hand."""
    quiet = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit("/*"), F.lit("/ *"))
    rows = None
    for ending, language, (before, after) in (("js", "javascript", JS_SOURCE), ("rs", "rust", RUST_SOURCE)):
        own = files(spark, sf).select(F.concat("file_path", F.lit(f".{ending}")).alias("file_path"), F.concat(F.lit(before), quiet, F.lit(after)).alias("content"), F.lit(language).alias("language"))
        rows = own if rows is None else rows.unionByName(own)
    return chunks.chunks(rows).select("file_path", "chunk_type", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


@query(
    "commit_log_parse",
    ", c AS (SELECT substr(sha256(file_path), 1, 40) AS sha, source, file_path, split_part(content, chr(10), 1) AS subject FROM files) "
    "SELECT sha, 'commit_' || substr(sha, 1, 7) AS id, 'git:' || substr(sha, 1, 7) AS file_path, source AS author, subject, file_path AS body, sha256(subject || chr(10) || chr(10) || file_path) AS content_sha256 FROM c",
    ("files",),
)
def commit_log_parse(spark, sf):
    """Documents as commit records of a log."""
    sha = F.substring(F.sha2("file_path", 256), 1, 40)
    record = F.concat_ws("\n", sha, F.col("source"), F.lit("2024-01-01"), F.substring_index("content", "\n", 1), F.col("file_path"))
    log = files(spark, sf).select(F.concat(record, F.lit("\x00")).alias("text"))
    return fs.commits(log).select("sha", "id", "file_path", "author", "subject", "body", F.sha2("content", 256).alias("content_sha256"))


@query("cost_estimate", "SELECT doc_id, n, round(n * 15.0 / 1e6, 9) AS cost, CASE WHEN n >= 1000 THEN (w // 10) || '.' || (w % 10) || 'k' ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT doc_id, n, n // 100 + CASE WHEN n % 100 > 50 OR (n % 100 = 50 AND n // 100 % 2 = 1) THEN 1 ELSE 0 END AS w FROM (SELECT doc_id, greatest(1, length(content) // 4) AS n FROM files))", ("files",))
def cost_estimate(spark, sf):
    n = tokens.counted_tokens(F.col("content"))
    return files(spark, sf).select("doc_id", n.alias("n"), F.round(tokens.cost(n, F.lit(15.0)), 9).alias("cost"), tokens.short_number(n).alias("shown"))


@query("project_slugs", "SELECT DISTINCT source || '-' || substr(sha256('projects/' || source), 1, 6) AS slug FROM documents")
def project_slugs(spark, sf):
    return files(spark, sf).select(tx.slug(F.concat(F.lit("projects/"), "source")).alias("slug")).distinct()


@query("node_names", "SELECT doc_id, CASE WHEN contains(content, '(') THEN trim(split_part(split_part(content, '(', 1), ':', -1), ' ') ELSE substr(sha256(file_path || ':module'), 1, 16) END AS name FROM files", ("files",))
def node_names(spark, sf):
    return files(spark, sf).select("doc_id", tx.node_name(F.col("content"), tx.module_id(F.col("file_path"))).alias("name"))


@query("payload_cap", "SELECT doc_id, CASE WHEN length(content) <= 4000 THEN content ELSE substr(content, 1, 4000) || chr(10) || '…[truncated, ' || (length(content) - 4000) || ' more chars]' END AS payload FROM files", ("files",))
def payload_cap(spark, sf):
    return files(spark, sf).select("doc_id", tx.capped_payload(F.col("content")).alias("payload"))
