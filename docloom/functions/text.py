"""String functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about what is asked for.
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "its", "me", "my", "of", "on", "or", "tell", "the", "to", "was", "what", "when", "where", "who", "why", "with"]


def normalize_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one blank; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")), F.lit(""))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)[a-z0-9]+"), F.lit(0))


def distinctive(token: Column) -> Column:
    """Has a digit, or two letters or more and is no stop word."""
    folded = F.lower(token)
    return folded.rlike("[0-9]") | ((F.length(folded) >= 2) & ~folded.isin(STOP_WORDS))


def query_tokens(text: Column) -> Column:
    """Distinct distinctive tokens, lower-cased, in order of first occurrence."""
    return F.array_distinct(F.transform(F.filter(raw_tokens(text), distinctive), lambda t: F.lower(t)))


def row_match_score(row: Column, tokens: Column, phrases: Column | None = None) -> Column:
    """1 if a phrase stands in the row, else the share of tokens that do."""
    low = F.lower(row)
    share = F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.instr(low, t) > 0)) / F.size(tokens)).otherwise(0.0)
    if phrases is None:
        return share
    return F.when(F.exists(phrases, lambda p: F.instr(low, F.lower(p)) > 0), 1.0).otherwise(share)


def token_overlap(query: Column, text: Column, keep_digits: bool = True) -> Column:
    """Share of the query's distinct tokens that the text has."""

    def kept(value: Column) -> Column:
        found = F.array_distinct(F.transform(raw_tokens(value), lambda t: F.lower(t)))
        return found if keep_digits else F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))

    wanted = kept(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, kept(text))) / F.size(wanted)).otherwise(0.0)


def header_position(headers: Column, name: Column) -> Column:
    """Index from 0 of the first header equal to name, cases and outer blanks aside; null where absent."""
    at = F.array_position(F.transform(headers, lambda h: F.lower(F.trim(h))), F.lower(F.trim(name)))
    return F.nullif(at, F.lit(0)) - 1


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a markdown table; short rows are padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(F.element_at(padded, 1)), line(F.array_repeat(F.lit("---"), width))), body), "\n")


def parse_markdown_table(text: Column) -> Column:
    """Lines that begin with a bar, without separator lines, cut at bars, cells trimmed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike("^\\|[\\s:|-]+\\|?$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c)))


def markdown_to_plain(text: Column) -> Column:
    """No separator lines, bars as blanks, white space collapsed."""
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(text, "(?m)^\\s*\\|?[\\s:|-]*-{3,}[\\s:|-]*$", " "), "\\|", " "))


def section_content(section: Column, subsection: Column, body: Column) -> Column:
    """Section, subsection (if another) and body, one a line, empty ones left out."""
    parts = F.array(section, F.when(~subsection.eqNullSafe(section), subsection), body)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def snippet(text: Column, limit: int = 200) -> Column:
    """One line of at most limit characters, the last one an ellipsis where cut."""
    flat = normalize_whitespace(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def title_from_message(text: Column, limit: int = 60) -> Column:
    flat = normalize_whitespace(text)
    return F.when(flat == "", "New chat").otherwise(snippet(flat, limit))


def wrap_excerpt(text: Column, tag: str = "document_excerpt") -> Column:
    return F.when(F.trim(text) == "", text).otherwise(F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>")))


def normalize_email(value: Column) -> Column:
    return F.lower(F.trim(value))


def image_url(path: Column) -> Column:
    """The last two segments of an image path below /images/; null with fewer."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^(data/images/|images/)", ""), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat(F.lit("/images/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)))


def column_label(index: Column) -> Column:
    """1 is A, 27 is AA: base 26 without a zero."""
    start = F.struct(index.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        letter = F.char(F.lit(65) + F.pmod(acc["n"] - 1, F.lit(26)))
        return F.when(acc["n"] > 0, F.struct(((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(letter, acc["s"]).alias("s"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, step, lambda acc: acc["s"])


def merge_scope_ids(ids: Column, one: Column) -> Column:
    """Ordered distinct of trimmed ids, blanks dropped, the single one last; null where none is left."""
    every = F.filter(F.transform(F.concat(F.coalesce(ids, F.array().cast("array<string>")), F.array(one)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_distinct(every), F.array().cast("array<string>"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last) of one 'bytes=a-b' range, open or suffix ranges too; null where it can't be met."""
    a, b = F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 1), F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 2)
    first = F.when(a != "", a.cast("long")).otherwise(F.greatest(size - b.cast("long"), F.lit(0)))
    last = F.when((a != "") & (b != ""), F.least(b.cast("long"), size - 1)).otherwise(size - 1)
    ok = header.rlike("^bytes=(\\d+-\\d*|-\\d+)$") & (first < size) & (first <= last)
    return F.when(ok, F.struct(first.alias("first"), last.alias("last")))


#: What Windows-1252 has at 0x80 to 0x9F, in that order, its unassigned places left out, and those places.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_PLACES = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))


def repair_mojibake(text: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, read aright; other text stays."""
    bytes_ = F.translate(text, _CP1252, _PLACES)
    broken = bytes_.rlike("[\u00C2-\u00F4][\u0080-\u00BF]") & bytes_.rlike("^[\u0000-\u00FF]*$")
    read = F.try_validate_utf8(F.encode(F.when(broken, bytes_), "ISO-8859-1").cast("string"))
    return F.coalesce(read, text)


def inspect_table(content: Column, metric: Column) -> Column:
    """struct(row_count, labels_lost, metric_found) of a chunk's markdown table: whether all of its rows lack a label, and one speaks of the metric."""
    rows = parse_markdown_table(content)
    lost = (F.size(rows) > 2) & F.forall(F.slice(rows, 3, 1_000_000), lambda r: F.element_at(r, 1) == "")
    found = F.exists(rows, lambda r: F.exists(r, lambda c: F.instr(F.lower(c), F.lower(metric)) > 0))
    return F.struct(F.size(rows).alias("row_count"), lost.alias("labels_lost"), found.alias("metric_found"))
