"""Phrases and entities that a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS, distinctive, raw_tokens

_QUOTED = "[\"“”']([^\"“”']{4,})[\"“”']"
_TITLE = "\\b([A-Z][A-Za-z0-9]*(?:\\s+[A-Z0-9][A-Za-z0-9]*)+)\\b"
_COLON = "([A-Z][A-Za-z0-9 ]{1,40}:\\s*[A-Z][A-Za-z0-9 ]{1,40})"


def named_phrases(text: Column) -> Column:
    """Quoted, colon and Title Case phrases of four letters or more, longest first, caseless distinct."""
    every = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)) for p in (_QUOTED, _COLON, _TITLE)])
    long = F.filter(every, lambda x: F.length(x) >= 4)
    ordered = F.transform(F.array_sort(F.transform(long, lambda x: F.struct((-F.length(x)).alias("n"), F.lower(x).alias("k"), x.alias("x")))), lambda s: s)
    once = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda t: t["k"] == s["k"]), acc).otherwise(F.concat(acc, F.array(s))))
    return F.transform(once, lambda s: s["x"])


def lookup_phrases(text: Column, most: int = 6) -> Column:
    """Runs of two to most tokens of which two are distinctive, or one is short or has a digit; longest first, then by the alphabet."""
    digit = lambda t: t.rlike("[0-9]")
    plain = lambda t: ~t.isin(STOP_WORDS)
    telling = lambda t: digit(t) | ((F.length(t) >= 2) & plain(t))
    short = lambda t: digit(t) | ((F.length(t) <= 2) & t.rlike("^[a-z]+$") & plain(t))

    def runs(tokens: Column) -> Column:
        begins = F.filter(F.transform(tokens, lambda t, i: F.when(telling(t) | short(t), i + 1)), lambda i: i.isNotNull())
        longest = lambda i: F.filter(F.sequence(F.lit(2), F.lit(most)), lambda n: i + n - 1 <= F.size(tokens))
        every = F.flatten(F.transform(begins, lambda i: F.transform(longest(i), lambda n: F.slice(tokens, i, n))))
        kept = F.filter(every, lambda r: (F.size(F.filter(r, telling)) >= 2) | (F.exists(r, telling) & F.exists(r, short)))
        return F.array_distinct(F.transform(kept, lambda r: F.array_join(r, " ")))

    found = F.transform(F.array(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), runs)[0]
    return F.transform(F.array_sort(F.transform(found, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])


def merge_anchor_phrases(query: Column, earlier: Column) -> Column:
    """The query behind the named phrases, its own and those of earlier questions (an array), that it does not hold yet."""
    target = F.trim(query)
    found = F.flatten(F.transform(F.concat(F.array(target), earlier), lambda t: named_phrases(F.coalesce(t, F.lit("")))))
    missing = F.filter(found, lambda p: F.instr(F.lower(target), F.lower(p)) == 0)
    once = F.aggregate(missing, F.slice(missing, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.coalesce(target, F.lit("")) == "", query).otherwise(F.array_join(F.concat(once, F.array(target)), " "))


# --- Fixed values: what comes before a name that is looked up, and fillers at its beginning. ---
MARKERS = ["about the movie ", "about the film ", "about the show ", "about the series ", "for the movie ", "for the film ", "for the show ", "for the series ", "about ", "for ", "titled ", "called ", "named "]
FILLERS = "the|a|an|movie|film|show|series"
# --- End of fixed values. ---


def marked_phrases(text: Column) -> Column:
    """What follows each marker up to a punctuation mark, fillers at its beginning left out, six words at most."""

    def after(marker: str) -> Column:
        pieces = F.split(text, "(?i)" + marker)
        tails = F.slice(pieces, F.lit(2), F.size(pieces))
        plain = F.transform(tails, lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_extract(F.trim(t), "^[^?.!,;\n]*", 0)), f"(?i)^(?:(?:{FILLERS})\\s+)+", "")))
        return F.transform(plain, lambda t: F.array_join(F.slice(F.filter(F.split(t, "\\s+"), lambda w: w != ""), 1, 6), " "))

    return F.filter(F.concat(*[after(m) for m in MARKERS]), lambda t: t != "")


def match_profiles(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrases, tokens): what rows and entities are matched with.

    Phrases: named ones, what follows a marker, and telling runs of tokens, longest first, each once. Tokens: those of the
    phrases that tell something, then the telling ones of three letters or more, each once.
    """
    asked = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(named_phrases(asked), marked_phrases(asked), lookup_phrases(asked))
    plain = F.filter(F.transform(every, lambda p: F.array_join(raw_tokens(p), " ")), lambda p: p != "")
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(plain, lambda p: F.struct((-F.length(p)).alias("n"), F.lower(p).alias("k"))))), lambda x: x["k"])
    rows = questions.select(key, asked.alias("_t"), ordered.alias("phrases"))
    low = lambda ts: F.transform(ts, lambda t: F.lower(t))
    short = lambda t: (F.length(t) <= 2) & t.rlike("^[A-Za-z]+$") & ~F.lower(t).isin(STOP_WORDS)
    of_phrases = F.filter(F.flatten(F.transform("phrases", lambda p: raw_tokens(p))), lambda t: distinctive(t) | short(t))
    of_text = F.filter(raw_tokens(F.col("_t")), lambda t: (F.length(t) >= 3) & distinctive(t))
    return rows.select(key, F.array_distinct("phrases").alias("phrases"), F.array_distinct(low(F.concat(of_phrases, of_text))).alias("tokens"))
