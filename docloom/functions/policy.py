"""Declarative screens for questions, answers and SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: phrases and patterns that the screens look for. ---
COMPARISON_PHRASES = ["compare", "comparison", "compared", "comparing", "versus", " vs ", " vs.", " vs,", "difference between", "differences between", "year-over-year", "year on year", "year over year", "year-on-year", "quarter over quarter", "quarter-on-quarter", "side by side", "higher than", "lower than", "increased by", "decreased by", "growth rate", "rate of growth", "how much did", "how much has", "change from", "changed from", "change between", "changed between", "from last year", "from the prior year", "prior year", "previous year", "same period", "two-year", "three-year", "five-year", "multi-year"]
REPORT_PHRASES = ["financial highlights", "key figures", "key metrics", "financial summary", "financial performance", "financial results", "annual results", "quarterly results", "segment revenue", "revenue by", "profit by", "sales by", "by region", "by segment", "by geography", "by business", "income statement", "balance sheet", "cash flow statement"]
METRIC_TERMS = ["revenue", "revenues", "sales", "turnover", "topline", "income", "profit", "profits", "profitable", "profitability", "earnings", "ebitda", "ebit", "ebt", "net", "gross", "margin", "margins", "operating", "cashflow", "liquidity", "dividend", "dividends", "eps", "roe", "roa", "roi", "roce", "assets", "liabilities", "equity", "debt", "capex", "opex", "expenditure", "expenditures", "expenses", "costs", "cost", "spend", "spending", "cogs", "arpu", "arr", "mrr", "gmv", "highlights", "highlight", "figures", "metrics", "kpi", "kpis", "breakdown", "segment", "segments", "regional", "region", "regions", "geography", "geographic", "fiscal", "fy", "yoy", "qoq", "mom", "billion", "millions", "million", "billions", "percent", "percentage"]
OUTPUT_RULES = [
    ("connection_string", "(?i)\\b(?:postgres(?:ql)?|mysql|mariadb|mssql)://\\S+"),
    ("api_key", "\\b(?:sk-[A-Za-z0-9_-]{10,}|Bearer\\s+[A-Za-z0-9._-]{10,})\\b"),
    ("stack_trace", "(?i)Traceback \\(most recent call last\\):"),
    ("raw_sql", "(?is)\\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|GRANT)\\b.{0,200}?\\bFROM\\b"),
    ("raw_sql", "(?i)```\\s*sql\\b"),
]
EMAIL = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
RISK_ANCHOR = "(?i)postgres(?:ql)?://|mysql://|mariadb://|mssql://|sk-[A-Za-z0-9_-]|Bearer\\s|Traceback \\(most recent call last\\):|```|\\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|GRANT)\\b"
DESTRUCTIVE_SQL = ["\\bdrop\\s+(table|schema|database)\\b", "\\bdelete\\s+from\\b", "\\btruncate\\s+(table\\s+)?\\w+", "\\balter\\s+(table|database|schema)\\b", "\\bupdate\\s+\\w+\\s+set\\b", "\\binsert\\s+into\\b", "\\bmerge\\s+into\\b", "\\breplace\\s+into\\b", "\\bcreate\\s+(table|database|user|role)\\b", "\\bgrant\\b.{0,30}\\b(to|on)\\b", "\\brevoke\\b.{0,30}\\b(from|on)\\b", "\\bcopy\\b.{0,40}\\bto\\b", "\\bexecute\\b.{0,20}\\b(immediate|procedure|function)\\b", "\\bexec\\b\\s*\\(", ";\\s*(drop|delete|truncate|alter|insert|update|create|grant|revoke)\\b", "\\bpassword\\s+hash(es)?\\b", "\\bpg_sleep\\s*\\(", "\\bunion\\b.{0,40}\\bselect\\b.{0,40}\\bfrom\\b"]
FORBIDDEN_KEYWORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "COPY", "EXECUTE", "CALL", "MERGE", "REPLACE", "VACUUM", "ANALYZE", "COMMENT", "REINDEX", "CLUSTER", "DISCARD", "RESET", "SET", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "LOCK", "UNLOCK", "RENAME", "ATTACH", "DETACH", "DO", "PREPARE", "DEALLOCATE", "LISTEN", "NOTIFY", "UNLISTEN", "LOAD", "REFRESH", "SECURITY"]
FORBIDDEN_FUNCTIONS = ["pg_read_file", "pg_read_binary_file", "pg_ls_dir", "pg_ls_logdir", "pg_ls_waldir", "pg_ls_tmpdir", "pg_ls_archive_statusdir", "pg_stat_file", "lo_import", "lo_export", "lo_read", "lo_write", "lo_open", "lo_creat", "lo_create", "dblink", "dblink_connect", "dblink_connect_u", "dblink_exec", "dblink_send_query", "dblink_open", "pg_terminate_backend", "pg_cancel_backend", "pg_reload_conf", "pg_rotate_logfile", "pg_sleep", "pg_sleep_for", "pg_sleep_until"]
# --- End of fixed values. ---


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is found once."""
    return F.transform(F.array(value), body)[0]


def any_phrase(text: Column, phrases: list[str]) -> Column:
    return _once(text, lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in phrases]))


def numeric_comparison(query: Column) -> Column:
    """Comparison or report phrases, metric words, or two years."""
    # By first letter, so that a word is held against few of them.
    metric = "\\b(?:" + "|".join(f"{c}(?:{'|'.join(t[1:] for t in METRIC_TERMS if t[0] == c)})" for c in sorted({t[0] for t in METRIC_TERMS})) + ")\\b"
    years = lambda t: F.size(F.regexp_extract_all(t, F.lit("\\b(19|20)\\d{2}\\b"), F.lit(0))) >= 2
    return _once(F.concat(F.lit(" "), F.lower(F.trim(query)), F.lit(" ")), lambda t: any_phrase(t, COMPARISON_PHRASES + REPORT_PHRASES) | t.rlike(metric) | years(t))


def screen_input(query: Column) -> Column:
    """destructive_sql or null, on the text as it is and with look-alike digits folded."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(query), "01345@$", "oieasas"), "[_\\-]+", " "), "\\s+", " "))
    bad = F.lower(query).rlike("|".join(DESTRUCTIVE_SQL)) | folded.rlike("|".join(DESTRUCTIVE_SQL))
    return F.when(bad, F.lit("destructive_sql"))


# --- Fixed values: families of questions that are refused, and of those that are looked at more closely. ---
ABUSE = ["\\b(kill yourself|kys)\\b"]
#: One more wording of a destructive request, which screens of questions have.
CREDENTIALS = ["\\beveryone'?s\\b.{0,20}\\bpassword\\b"]
JAILBREAK = [
    "\\bignore\\b.{0,40}\\b(instructions?|rules|policy|prompt|guidelines)\\b",
    "\\bignore\\b.{0,20}\\b(all|any|previous|prior|earlier|my)\\b.{0,20}\\b(instructions?|rules|prompts?)\\b",
    "\\b(disregard|forget|override|bypass|disable)\\b.{0,30}\\b(instructions|rules|system prompt|guardrails|safety|restrictions|content filter)\\b",
    "\\b(pretend|act)\\b.{0,20}\\b(unrestricted|uncensored|jailbroken|without rules|without limits)\\b",
    "\\b(reveal|expose|leak|output|print|show|repeat|dump|recite)\\b.{0,30}\\b(system prompt|hidden prompt|instructions|developer message|hidden instructions|initial prompt|original prompt)\\b",
    "\\bwhat are your (instructions|rules|system prompt|guidelines)\\b",
    "\\b(bypass|disable|turn off|remove)\\b.{0,20}\\b(guardrails|safety|content filter|restrictions)\\b",
    "\\b(developer|sudo|god|jailbreak|dan)\\s+mode\\b",
    "\\byou are now\\b.{0,30}\\b(unrestricted|unfiltered|developer mode|dan)\\b",
    "\\bact as (if )?you (have|had) no (rules|restrictions|limits|guidelines)\\b",
    "\\bfrom now on\\b.{0,30}\\b(ignore|disregard|forget)\\b",
    "\\bnew (system )?prompt\\b",
    "\\bsystem override\\b",
    "\\bend of user message\\b",
    "\\[/system\\]|\\[system\\]|</user>|<system>",
    "\\bdo anything now\\b",
    "\\bDAN\\b",
    "\\booc:\\s",
    "\\brepeat (everything|the text|the message) above\\b",
]
SQL_QUERY_REQUEST = [
    "\\b(show|print|reveal|display|give|tell|share|repeat|dump|output)\\b.{0,25}\\b(the\\s+)?(sql\\s+)?(query|queries|statement|statements)\\b.{0,20}\\b(you\\s+)?(ran|used|executed|wrote)\\b",
    "\\bwhat (sql\\s+)?(query|queries) did you (run|use|execute|write)\\b",
    "\\bwhat (sql\\s+)?(query|queries) (was|were) (run|used|executed|written)\\b",
    "\\bgive me the (sql\\s+)?(select|query|statement)\\b",
    "\\bshow me the (sql\\s+)?(select|query|statement)\\b",
    "\\b(reveal|print|show|repeat|dump)\\b.{0,20}\\bthe (sql\\s+)?(select|query|statement)\\b",
    "\\brepeat the (sql\\s+)?(query|statement) (you\\s+)?(ran|used|executed)\\b",
    "\\bshare (your|the) (internal\\s+)?(sql\\s+)?(query|queries)\\b",
]
SCHEMA_REQUEST = [
    "\\b(show|list|describe|give|tell|display|dump|print|reveal)\\b.{0,25}\\b(the\\s+)?(db|database)\\s+schema\\b",
    "\\b(show|list|describe|give|tell|display|dump|print|reveal)\\b.{0,25}\\b(the\\s+)?(schema|table structure|column names|columns and types)\\b",
    "\\bwhat tables\\b.{0,30}\\b(in the\\s+)?(database|db)\\b",
    "\\blist\\b.{0,20}\\b(all\\s+)?tables\\b",
    "\\bdescribe\\s+(the\\s+)?(database|schema|tables)\\b",
    "\\binformation_schema\\b",
]
# --- End of fixed values. ---
#: In the order in which they are asked: family, patterns, whether it is refused at once.
INPUT_FAMILIES = [("abuse", ABUSE, True), ("destructive_sql_request", DESTRUCTIVE_SQL + CREDENTIALS, True), ("jailbreak", JAILBREAK, False), ("sql_query_request", SQL_QUERY_REQUEST, False), ("schema_request", SCHEMA_REQUEST, False)]


def folded(query: Column) -> Column:
    """Lower case, with look-alike digits as letters and marks and white space between words as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(query), "01345@$", "oieasas"), "[_\\-]+", " "), "\\s+", " "))


def input_verdict(query: Column) -> Column:
    """struct(allowed, family, place): the first family that a question falls under, as it stands or folded.

    Families of INPUT_FAMILIES that are not refused are allowed with their name, to be looked at more closely. place: from 0,
    where the question itself first says so; null where only its folded form does.
    """
    out = F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("int").alias("place"))
    cases = F.when(F.trim(F.coalesce(query, F.lit(""))) == "", out)
    plain = folded(query)
    for family, patterns, refused in INPUT_FAMILIES:
        # One scan of a family: its patterns are one alternation.
        any_of = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        at = F.nullif(F.regexp_instr(query, F.lit(any_of)), F.lit(0)) - 1
        cases = cases.when(query.rlike(any_of) | plain.rlike(any_of), F.struct(F.lit(not refused).alias("allowed"), F.lit(family).alias("family"), at.alias("place")))
    return cases.otherwise(out)


def screen_output(text: Column) -> Column:
    """The first rule that an answer breaks, or null; three addresses or more are possible_pii."""
    cases = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(None).cast("string"))
    for reason, pattern in OUTPUT_RULES:
        cases = cases.when(text.rlike(pattern), reason)
    return cases.when(F.size(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))) >= 3, "possible_pii")


def risk_anchor_offset(text: Column) -> Column:
    """Index from 0 of the first place where a secret, trace or statement may begin; null without one."""
    return F.nullif(F.regexp_instr(text, F.lit(RISK_ANCHOR)), F.lit(0)) - 1


def sql_refusal(sql: Column) -> Column:
    """Why a statement is not a single read-only SELECT; null where it is one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), "(?s)/\\*.*?\\*/", " "), "--[^\\n]*", " "))
    single = F.regexp_replace(bare, ";\\s*$", "")
    words = F.upper(F.regexp_replace(single, "'[^']*'|\"[^\"]*\"", " "))
    return (
        F.when(bare == "", "empty")
        .when(F.instr(single, ";") > 0, "several statements")
        .when(~words.rlike("^\\s*\\(*\\s*(SELECT|WITH)\\b"), "not a query")
        .when(words.rlike("\\b(" + "|".join(FORBIDDEN_KEYWORDS) + ")\\b"), "forbidden keyword")
        .when(single.rlike("(?i)\\b(" + "|".join(FORBIDDEN_FUNCTIONS) + ")\\s*\\("), "forbidden function")
        .when(single.rlike("(?i)\\b(pg_catalog|information_schema)\\s*\\."), "system catalog")
    )


def has_inline_table(text: Column) -> Column:
    """A separator cell inside a line that is more than a separator."""
    return F.exists(F.split(text, "\n"), lambda x: x.rlike("\\|\\s*:?-{3,}:?\\s*\\|") & ~F.trim(x).rlike("^\\|?[\\s:|-]+\\|?$"))


def route(tools: Column) -> Column:
    """rag, sql or hybrid by the tools used."""
    rag, sql = F.array_contains(tools, "search_documents"), F.array_contains(tools, "query_database")
    return F.when(rag & sql, "hybrid").when(sql, "sql").otherwise("rag")


# --- Fixed values: where an answer may come from, and what a chart request says. ---
DB_ONLY = "(?i)\\b(?:from the (?:db|database)|in the (?:db|database)|(?:db|database) only|sql only|only (?:the )?(?:db|database)|ignore (?:the )?documents?|don't use (?:the )?documents?)\\b"
DOCS_ONLY = "(?i)\\b(?:from the (?:doc|docs|document|pdf|upload|file|spreadsheet|excerpt)s?|in the (?:doc|docs|document|pdf|upload|file|spreadsheet|excerpt)s?|(?:doc|docs|document|pdf|upload|file|spreadsheet|excerpt)s? only|ignore (?:the )?(?:db|database)|don't use (?:the )?(?:db|database))\\b"
CHART_MARKERS = ["chart", "graph", "plot", "visualize", "visualise", "draw a", "draw the"]
GREETINGS = ["hi", "hello", "hey", "thanks", "thank you", "bye", "goodbye", "ok", "okay", "good morning", "good afternoon", "good evening"]
OPENINGS = ["hi ", "hello ", "hey "]
META_QUESTIONS = ["what can you do", "how can you help"]
CLARIFYING = ["could you clarify", "please specify", "do you mean", "which one", "can you tell me which", "more specific", "clarify"]
SCOPE_QUESTIONS = ["which document", "which file", "uploaded documents", "what document", "what file"]
# --- End of fixed values. ---


def source_intent(query: Column) -> Column:
    """docs_only, db_only, or null where both or neither is said."""
    docs, db = query.rlike(DOCS_ONLY), query.rlike(DB_ONLY)
    return F.when(docs & ~db, "docs_only").when(db & ~docs, "db_only")


def chart_requested(query: Column) -> Column:
    return any_phrase(F.lower(query), CHART_MARKERS)


def small_talk(query: Column) -> Column:
    """A greeting, thanks or a question about the assistant, and nothing at all; not a question about documents."""
    said = F.regexp_replace(F.lower(F.trim(F.coalesce(query, F.lit("")))), "[?!.]+$", "")
    opening = F.exists(F.array(*map(F.lit, OPENINGS)), lambda p: F.startswith(said, p)) & (F.length(said) < 40)
    return (said == "") | said.isin(GREETINGS) | opening | any_phrase(said, META_QUESTIONS)


def clarification(answer: Column) -> Column:
    """An answer that asks back what is meant, but not which document."""
    said = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (F.instr(said, "?") > 0) & any_phrase(said, CLARIFYING) & ~any_phrase(said, SCOPE_QUESTIONS)


def search_top_k(kind: Column, query: Column, asked: Column) -> Column:
    """5 for spreadsheets, 6 for PDFs and numeric questions, else what is asked for, from 1 to 50."""
    return F.when(kind == "xlsx", 5).when((kind == "pdf") | numeric_comparison(query), 6).otherwise(F.least(F.greatest(asked, F.lit(1)), F.lit(50)))


def strip_fences(text: Column) -> Column:
    """The inside of a ``` block, or the text itself, trimmed."""
    inner = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def json_object(text: Column) -> Column:
    """The JSON object at the start of a text, to its own closing brace, whatever follows; null where none ends."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    # What lies between marks is passed over at once: a piece ends with a quote, a brace, or a backslash and the sign after it.
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)[^"{}\\]*+(?:\\.|["{}])'), F.lit(0))

    def step(acc, p):
        c, escaped = F.substring(p, -1, 1), acc["quoted"] & (F.substring(p, -2, 1) == "\\")
        free = ~acc["quoted"]
        depth = acc["depth"] + F.when(free & (c == "{"), 1).when(free & (c == "}"), -1).otherwise(0)
        quoted = F.when((c == '"') & ~escaped, free).otherwise(acc["quoted"])
        n = acc["n"] + F.length(p)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), n.alias("n"), F.when((acc["end"] == 0) & free & (depth == 0) & (c == "}"), n).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.nullif(F.substr(text, F.lit(1), F.when(text.startswith("{"), end).otherwise(0)), F.lit(""))


def tool_calls(text: Column) -> Column:
    """array of struct(name, arguments) of '<function=name{json}</function>' marks, nested objects whole; marks without an object are left out."""
    mark = F.lit("<function=([^<{]*)(\\{[^<]*)")
    names, bodies = F.regexp_extract_all(text, mark, F.lit(1)), F.regexp_extract_all(text, mark, F.lit(2))
    calls = F.zip_with(names, bodies, lambda n, b: F.struct(F.trim(n).alias("name"), json_object(b).alias("arguments")))
    return F.filter(calls, lambda c: (c["name"] != "") & F.schema_of_variant(F.try_parse_json(c["arguments"])).startswith("OBJECT"))


def clean_sql_answer(text: Column) -> Column:
    """Prose without fenced code and without a leading SELECT line."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", " "), "(?i)^\\s*SELECT\\b[^\\n]*(\\n|$)", "")
    return F.regexp_replace(bare, "^\\s+|\\s+$", "")


def over_expanded(original: Column, rewritten: Column) -> Column:
    """A rewrite that is longer by more than 50 characters and more than 1.75 times."""
    return (F.length(rewritten) > F.length(original) + 50) & (F.length(rewritten) > 1.75 * F.length(original))


# --- Fixed values: words that say which source a question needs. ---
SECOND_CUES = ["and also", "as well as", "and tell me", "and what", "plus"]
METRIC_CUES = ["revenue", "growth", "segment", "segments", "cagr", "profit", "total", "count", "average", "sum", "how many"]
NARRATIVE_CUES = ["chairwoman", "chairman", "statement", "stated", "says", "message from", "in the document", "in the pdf", "in the text", "from the document", "from the pdf", "from the text", "document", "pdf", "uploaded", "docx", "xlsx", "spreadsheet", "figure", "image"]
DOCUMENT_WORDS = ["document", "pdf", "docx", "xlsx", "uploaded", "spreadsheet", "page ", "figure", "image"]
AGGREGATE_WORDS = ["how many", "count", "total", "average", "sum", "top ", "bottom ", "group by"]
CONTENT_TOOLS = ["search_documents", "search_images", "create_chart"]
# --- End of fixed values. ---


def sql_route(query: Column, tables: list[str]) -> Column:
    """hybrid for a question about both numbers and a document's words, sql for one about a table or an aggregate, else null."""
    text = F.lower(F.trim(query))
    says = lambda cues: text.rlike("\\b(?:" + "|".join(cues) + ")\\b")
    both = says(NARRATIVE_CUES) & (says(METRIC_CUES) | says(SECOND_CUES) | (F.instr(text, "compare") > 0))
    named = F.arrays_overlap(F.regexp_extract_all(text, F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), F.array(*[F.lit(t.lower()) for t in tables]))
    return F.when(both, "hybrid").when(any_phrase(text, DOCUMENT_WORDS), F.lit(None).cast("string")).when(any_phrase(text, AGGREGATE_WORDS) | named, "sql")


def tool_gate(calls: DataFrame, sql: str) -> DataFrame:
    """calls with reason and allowed: the audit of every statement that a tool would run."""
    return calls.withColumn("reason", sql_refusal(F.col(sql))).withColumn("allowed", F.col("reason").isNull())


def _used(tools: Column) -> tuple[Column, Column]:
    """Whether a turn has read documents, and the database."""
    return F.arrays_overlap(tools, F.array(*map(F.lit, CONTENT_TOOLS))), F.array_contains(tools, "query_database")


def stop_after_tools(tools: Column, sql_allowed: Column, docs_allowed: Column, indexed: Column) -> Column:
    """Whether the tools used so far are enough: both sources, or one where the other is not allowed or empty."""
    docs, db = _used(tools)
    return F.when(docs & db, True).when(docs, ~sql_allowed).when(db, ~docs_allowed | (indexed <= 0)).otherwise(False)


def needs_documents(tools: Column, docs_allowed: Column, indexed: Column) -> Column:
    """The database was asked and documents, which may hold an answer too, were not."""
    return _used(tools)[1] & ~F.array_contains(tools, "search_documents") & docs_allowed & (indexed > 0)


def needs_database(tools: Column, sql_allowed: Column) -> Column:
    docs, db = _used(tools)
    return docs & ~db & sql_allowed
