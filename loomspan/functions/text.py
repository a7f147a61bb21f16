"""Text functions as column expressions: queries, keys, identifiers, truncation, paths.

Patterns and word lists are fixed values that results depend on.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TRUNCATION

DECISION = ("what did we decide", "decision about", "why did we", "last session", "previous discussion", "agreed on")
ARCHITECTURE = ("how is .+ structured", "architecture", "module.+structure", "component.+design", "how does .+ work", "overview of", "explain the .+ system")
CODE = ("find .+ function", "show me .+ class", "where is .+ defined", "implementation of", r"\.py|\.js|\.ts", "function|class|method|def |import ")
STOP_WORDS = (
    "the a an is are was were do does did what how why where when who which in on at to for of with about "
    "me my we our it its i you tell give"
).split()
CODE_PREFIXES = "show find get set fetch save validate create update delete".split()
FILE_HINT = r"[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,10}"
#: Function words that a topic is searched without, by kind.
TOPIC_STOP_WORDS = (
    # articles, determiners
    "a an the this that these those some any no all both each every other another such "
    # auxiliaries
    "is are was were be been being am have has had having do does did doing done "
    "will would shall should can could may might must ought "
    # pronouns
    "i we you he she it they me us him her them my our your his its their mine ours yours hers theirs "
    "myself ourselves yourself yourselves himself herself itself themselves "
    # prepositions, conjunctions
    "of in on at to for with by from as into onto upon about above below under over between among through during "
    "before after since until while and or but nor so if than then because though although unless "
    # questions and places
    "how what when where which who whom whose why here there "
    # fillers and times
    "just only even also very too still now today tomorrow yesterday "
    # verbs without a topic
    "get got make made go went see saw let"
).split()


def any_of(text: Column, patterns) -> Column:
    return text.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))


def intent(query: Column) -> Column:
    """decision_recall, architecture, code_lookup or general: the first list with a match."""
    q = F.lower(query)
    return F.when(any_of(q, DECISION), "decision_recall").when(any_of(q, ARCHITECTURE), "architecture").when(any_of(q, CODE), "code_lookup").otherwise("general")


def keywords(query: Column, kind: Column | None = None) -> Column:
    """Capitalised identifiers, then words of three letters or more that are no stop words; each once, in order."""
    kind = intent(query) if kind is None else kind
    capital = F.regexp_extract_all(query, F.lit("[A-Z][a-zA-Z0-9]+"), F.lit(0))
    words = F.filter(F.regexp_extract_all(query, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)), lambda w: F.length(w) > 2)
    kept = F.when(kind == "code_lookup", F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))).otherwise(F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS + CODE_PREFIXES)))
    return F.array_distinct(F.concat(capital, kept))


def file_hints(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(FILE_HINT), F.lit(0))


def keyword_distance(words: Column, hints: Column, path: Column, content: Column) -> Column:
    """0.0 if a hint is part of the path or a keyword of the content (any case), else 2.0."""
    text = F.lower(content)
    hit = F.exists(hints, lambda h: path.contains(h)) | F.exists(words, lambda w: text.contains(F.lower(w)))
    return F.when(hit, 0.0).otherwise(2.0)


def topic_words(topic: Column) -> Column:
    """Lower-case words of a topic without function words; all of its words if none is left."""
    words = F.filter(F.split(topic, r"\s+"), lambda w: w != "")
    content = F.filter(F.transform(words, F.lower), lambda w: ~w.isin(TOPIC_STOP_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def index_terms(text: Column) -> Column:
    """Terms of full text: letters and digits, lower case, without diacritics."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and their bases by canonical decomposition, then the marks, which have none and go."""
    import unicodedata

    def base(c: str) -> str:
        return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))

    pairs = [(c, base(c)) for c in map(chr, (*range(0x80, 0x30000), *range(0xE0100, 0xE01F0))) if unicodedata.category(c)[0] == "M" or unicodedata.decomposition(c)]
    pairs = sorted((x for x in pairs if x[0] != x[1]), key=lambda x: x[1] == "")
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def relative_time(epoch: Column, as_of: int) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, 4mo ago or 1y ago; empty for null."""
    d = F.greatest(F.lit(0), F.lit(as_of) - epoch)
    out = F.when(epoch.isNull(), "").when(d < 60, "just now")
    for below, size, unit in ((3_600, 60, "m"), (86_400, 3_600, "h"), (2_592_000, 86_400, "d"), (31_536_000, 2_592_000, "mo")):
        out = out.when(d < below, F.concat(F.floor(d / size).cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.concat(F.floor(d / 31_536_000).cast("string"), F.lit("y ago")))


def capped_payload(text: Column, cap: int = 4_000) -> Column:
    more = F.concat(F.substring(text, 1, cap), F.lit("\n…[truncated, "), (F.length(text) - cap).cast("string"), F.lit(" more chars]"))
    return F.when(text.isNull(), "<no value>").when(F.length(text) <= cap, text).otherwise(more)


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def truncated(text: Column, most: int = 200) -> Column:
    """The text, or its first characters and an ellipsis."""
    own = stripped(text)
    cut = F.concat(F.regexp_replace(F.substring(own, 1, most - 1), r"(?U)\s+\z", ""), F.lit("…"))
    return F.when(F.length(own) <= most, own).otherwise(cut)


def fallback(content: Column, level: Column) -> Column:
    """A chunk that is no function or class, cut at its level's limit (300 for unknown levels)."""
    limit = F.lit(300)
    for name, n in TRUNCATION.items():
        limit = F.when(level == name, n).otherwise(limit)
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(F.substr(content, F.lit(1), limit), F.lit("...")))


def signature(content: Column, limit: int) -> Column:
    """Leading lines of code: up to the limit, the end of a docstring, or a later line that ends with a colon."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("chars"), F.lit(False).alias("doc"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        over = (acc.chars + F.length(line) > limit) & (F.size(acc.lines) > 0)
        quote = line.contains('"""') | line.contains("'''")
        doc = acc.doc | quote
        ends = (quote & acc.doc) | (~doc & F.rtrim(line).endswith(":") & (F.size(acc.lines) > 0))
        lines = F.concat(acc.lines, F.array(line))
        taken = F.struct(lines.alias("lines"), (acc.chars + F.length(line) + 1).alias("chars"), doc.alias("doc"), ends.alias("done"))
        stop = F.struct(acc.lines.alias("lines"), acc.chars.alias("chars"), acc.doc.alias("doc"), F.lit(True).alias("done"))
        return F.when(acc.done, acc).when(over, stop).otherwise(taken)

    return F.aggregate(F.split(content, "\n"), start, step, lambda acc: F.array_join(acc.lines, "\n"))


IDENTIFIER_PATTERNS = (r"(?:def|class|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"([a-zA-Z_][a-zA-Z0-9_]*)\s*[=:(]", r"self\.([a-zA-Z_][a-zA-Z0-9_]*)")


def identifiers(code: Column) -> Column:
    """Names that a summary of code should keep, sorted, each once."""
    own = F.concat(*(F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in IDENTIFIER_PATTERNS))
    own = F.filter(own, lambda w: (F.length(w) >= 3) & ~w.isin("self", "None", "True", "False"))
    lists = F.regexp_extract_all(code, F.lit(r"(?:def|function)\s+\w+\s*\(([^)]*)\)"), F.lit(1))
    params = F.flatten(F.transform(lists, lambda p: F.split(p, r"[,\s]+")))
    params = F.transform(params, lambda p: F.trim(F.substring_index(F.substring_index(p, ":", 1), "=", 1)))
    params = F.filter(params, lambda w: (F.length(w) >= 3) & ~w.isin("self", "cls", "None", "True", "False"))
    capital = F.regexp_extract_all(code, F.lit(r"(?U)\b([A-Z][a-zA-Z0-9]+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(own, params, capital)))


def keeps_identifiers(code: Column, summary: Column, least: float = 0.4) -> Column:
    """Whether a summary names enough of the code's identifiers; true if there are none."""
    names, text = identifiers(code), F.lower(summary)
    kept = F.size(F.filter(names, lambda w: text.contains(F.lower(w))))
    return F.when(F.size(names) == 0, True).otherwise(kept / F.greatest(F.size(names), F.lit(1)) >= least)


def sentences(text: Column) -> Column:
    """Sentences of each line, trimmed; white space after a full stop, exclamation or question mark ends one."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), stripped)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])(?U)\s+")))
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def glob_regex(pattern: str) -> str:
    """A Java pattern for a shell pattern; ``*`` also matches slashes."""
    return re.sub(r"\(\?s:(.*)\)\\[zZ]", r"(?s)\\A(?:\1)\\z", fnmatch.translate(pattern)).replace("(?>", "(?:")


def ignored(path: Column, patterns, is_dir: bool = False) -> Column:
    """Whether a relative path matches a pattern: without a slash its last part, with one the whole path."""
    rel = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A[./]+", "")
    name = F.element_at(F.split(rel, "/"), -1)
    out = F.lit(False)
    for pattern in patterns:
        if pattern.endswith("/") and not is_dir:
            continue
        own = pattern.rstrip("/") if pattern.endswith("/") else pattern
        if "/" not in own:
            out = out | name.rlike(glob_regex(own))
            continue
        own = own.lstrip("/")
        out = out | rel.rlike(glob_regex(own))
        if own.startswith("**/"):
            out = out | rel.rlike(glob_regex(own[3:])) | rel.rlike(glob_regex("*/" + own[3:]))
    return out


def extension(path: Column) -> Column:
    """The last part's suffix with its dot, in the case it has; empty without one."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), F.substring(content, 1, 100)), 256), 1, 16)


def module_id(path: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":module")), 256), 1, 16)


def content_hash(text: Column, salt: str | None = None) -> Column:
    return F.sha2(text if salt is None else F.concat(F.lit(f"{salt}:"), text), 256)


def node_name(content: Column, own_id: Column) -> Column:
    """What stands before the first parenthesis, after the last colon; the id without one."""
    head = F.substring_index(content, "(", 1)
    return F.when(content.contains("("), F.trim(F.substring_index(head, ":", -1))).otherwise(own_id)


def import_module(raw: Column) -> Column:
    """The package of an imported name: its first part; two for scoped packages; null for bare dots."""
    name = F.regexp_replace(raw, r"\A['\"]+|['\"]+\z", "")
    scoped = F.substring_index(name, "/", 2)
    plain = F.substring_index(F.substring_index(F.regexp_replace(name, r"\A\.+", ""), "/", 1), ".", 1)
    return F.nullif(F.when(name.startswith("@"), scoped).otherwise(plain), F.lit(""))


def slug(path: Column) -> Column:
    """A safe name of a project folder: its last part and six digits of its hash."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^A-Za-z0-9_.-]", "_")
    return F.concat_ws("-", name, F.substring(F.sha2(path, 256), 1, 6))
