"""Text functions as column expressions: normalisation, sections, tokens, hashes.

Java's ``\\s`` and ``\\w`` are ASCII-only, so Unicode-aware patterns carry ``(?U)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotation marks and dashes that normalisation unifies.
CURLY = ("‘’“”", "''\"\"")
QUOTES = "\"'‘’“”«»"
DASHES = "‐‑‒–—―−"
#: Names of character references; those without a semicolon may be followed by anything.
CLOSED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
OPEN = {k: v for k, v in html5.items() if not k.endswith(";")}
_OPEN_NAME = "^(" + "|".join(sorted(OPEN, key=len, reverse=True)) + ")"
#: What numbers 128 to 159 mean in web pages.
WINDOWS = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)} | {0: "\ufffd", 13: "\r"}
#: Patterns of citations, dates and volatile lines.
CITATION = r"^(?:\d+\s+)?[A-Z]{2,6}\.?\s+\d[\w.\-]*$"
DATE_LIKE = r"(?i)^(?:\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z.]*\s+\d{1,2}?,?\s*\d{4})$"
VOLATILE_LINE = r"(?im)^.*(generated|last updated|as of)\b.*$|\b\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}\S*)?\b"
#: Texts shorter than this are hashed as raw bytes.
HASH_LEAST = 200


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ws_only(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_ws(c: Column) -> Column:
    return ws_only(F.translate(c, *CURLY))


def fold(c: Column) -> Column:
    """For containment tests: no quotation marks, one dash, one space, lower case."""
    unified = F.translate(F.translate(c, DASHES, "-" * len(DASHES)), QUOTES, "")
    return F.lower(ws_only(unified))


def _looked_up(table: dict, key: Column) -> Column:
    """Value of a constant table, which the planner folds to one literal."""
    written = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(written), F.lit("\x01"), F.lit("\x02"))[key]


def _character(point: Column) -> Column:
    """The character of a number in a reference: replaced if it can be none, empty if it stands for nothing."""
    none = (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    empty = point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return F.when(point.isNull() | none, "\ufffd").when(point.between(128, 159) | point.isin(0, 13), _looked_up(WINDOWS, point.cast("string"))).when(empty, "").otherwise(plain)


def _reference(rest: Column) -> Column:
    """What an ampersand and the text behind it are; common names first, for the tables are searched from the start."""
    number = F.regexp_extract(rest, r"^#(\d+|[xX][0-9a-fA-F]+);?", 1)
    digits = F.regexp_replace(F.regexp_replace(number, "^[xX]", ""), "^0+(?=.)", "")
    long = F.length(digits) > 9
    point = F.when(long, F.lit(0x110000).cast("long")).when(number.rlike("^[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    name = F.regexp_extract(rest, "^([A-Za-z][A-Za-z0-9]*);", 1)
    opened = F.regexp_extract(rest, _OPEN_NAME, 1)
    after = lambda n: F.substring(rest, n, F.length(rest))
    numeric = F.concat(_character(point), F.regexp_replace(rest, r"^#(\d+|[xX][0-9a-fA-F]+);?", ""))
    closed = F.when(name == "amp", "&").when(name == "nbsp", "\xa0").when(name == "quot", '"').when(name == "lt", "<").when(name == "gt", ">").when(name != "", _looked_up(CLOSED, name))
    named = F.when(closed.isNotNull(), F.concat(closed, after(F.length(name) + 2)))
    legacy = F.when(opened != "", F.concat(_looked_up(OPEN, opened), after(F.length(opened) + 1)))
    return F.when(number != "", numeric).otherwise(F.coalesce(named, legacy, F.concat(F.lit("&"), rest)))


def unescape(c: Column) -> Column:
    """All character references of HTML, natively: the text is cut at ampersands and every part told what it begins with."""
    parts = F.split(c, "&")
    decoded = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _reference)
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(decoded, ""))).otherwise(c)


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style).*?</\1>", " "), "<[^>]+>", " ")


def html_to_text(c: Column) -> Column:
    """Scripts, styles and tags out, references decoded, runs of spaces and tabs collapsed."""
    return F.regexp_replace(unescape(drop_tags(c)), "[ \\t]+", " ")


def strip_volatile(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def content_hash(raw: Column, kind: Column, patterns: list[str] = (), extract: Callable[[Column], Column] = lambda c: ws_only(html_to_text(c))) -> Column:
    """SHA-256 of the normalised text of HTML or XML with 200 characters or more, else of the bytes; ``extract`` gives that text."""
    text = extract(strip_volatile(raw, list(patterns)))
    markup = kind.isin("html", "xml") & (F.length(text) >= HASH_LEAST)
    return F.when(markup, F.sha2(text.cast("binary"), 256)).otherwise(F.sha2(raw.cast("binary"), 256))


def snapshot_hash(txt: Column, raw: Column) -> Column:
    normal = ws_only(txt)
    return F.when(F.length(normal) >= HASH_LEAST, F.sha2(normal.cast("binary"), 256)).otherwise(F.sha2(raw, 256))


def _quoted(heading: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", heading)


def section(body: Column, heading: str, level: int = 2, stripped: bool = True) -> Column:
    """Text under the first heading of that name up to the next of its level or above; null if there is none."""
    mark = "#" * level
    stop = "|".join(f"^{'#' * k} " for k in range(2, level + 1))
    pattern = rf"(?ms)^{mark} {_quoted(heading)}\s*$(.*?)(?={stop}|\z)"
    found = F.regexp_extract(body, pattern, 1)
    return F.when(body.rlike(pattern), strip(found) if stripped else found)


def headings(body: Column, level: int = 2) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?m)^{'#' * level} (.+)$"), 1)


def searchable_body(body: Column, configured: list[str] | None = None) -> Column:
    """Configured sections joined by a blank line; otherwise the full text, or the key provisions, or nothing."""
    if configured:
        parts = F.array_compact(F.array(*(F.when(section(body, h) != "", section(body, h)) for h in configured)))
        return F.array_join(parts, "\n\n")
    full, key = section(body, "Full text"), section(body, "Key provisions")
    return F.coalesce(F.when(full != "", full), key, F.lit(""))


def verbatim_quotes(body: Column) -> Column:
    plain = F.regexp_replace(body, r"(?m)^\s*>\s?", "")
    return F.regexp_extract_all(plain, F.lit(r'(?s)\*\*\[VERBATIM\]\*\*\s*"(.*?)"'), 1)


def index_tokens(c: Column) -> Column:
    """Case-folded runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(c: Column) -> Column:
    """Terms as typed; a punctuated term is a phrase of its tokens."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[\w.\-]+"), 0)


def extraction_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9A-Za-z][0-9A-Za-z._/§\-]*"), 0)


def is_slug(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")


def is_legal_id(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9][a-z0-9._-]+$")


def is_registry_slug(c: Column) -> Column:
    """Two words or more joined by hyphens; a single word may be a quotation."""
    return c.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)+$")


def is_date_like(c: Column) -> Column:
    """A whole ISO date, or a month's name, a day and a year."""
    return c.rlike(DATE_LIKE)


def is_citation(c: Column) -> Column:
    """An abbreviated authority and a number."""
    return c.rlike(CITATION)


def report_body(c: Column) -> Column:
    """A generated report without dates and lines that tell when it was made, for comparing its content."""
    return strip(F.regexp_replace(c, VOLATILE_LINE, ""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)))


def kilobytes(n: Column) -> Column:
    return F.format_string("%d KB", F.floor(n / 1024).cast("long"))


def source_format(declared: Column, url: Column) -> Column:
    """The declared format, else that of the URL's last path segment; everything unknown is html."""
    last = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)
    ext = F.lower(F.regexp_extract(last, r"\.([^./]+)$", 1))
    return F.coalesce(F.when(declared != "", declared), F.when(ext.isin("pdf", "xls", "xlsx", "docx", "xml"), ext), F.lit("html"))


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def ordered_containment(lines: Column, text: Column) -> Column:
    """First line that does not occur at or after the end of the one before; null if all do."""
    start = F.struct(F.lit(1).alias("pos"), F.lit(None).cast("string").alias("bad"))

    def step(acc, line):
        at = F.call_function("locate", line, text, acc["pos"])
        moved = F.struct((at + F.length(line)).alias("pos"), F.lit(None).cast("string").alias("bad"))
        failed = F.struct(acc["pos"].alias("pos"), line.alias("bad"))
        return F.when(acc["bad"].isNotNull() | (F.length(line) == 0), acc).when(at > 0, moved).otherwise(failed)

    return F.aggregate(lines, start, step)["bad"]


def quote_contained(quote: Column, text: Column) -> Column:
    """Segments between ellipses must occur in order."""
    return ordered_containment(F.transform(F.split(quote, "…"), lambda s: normalize_ws(s)), text).isNull()


def coverage_ratio(full: Column, source: Column) -> Column:
    return F.length(normalize_ws(full)) / F.greatest(F.lit(1), F.length(normalize_ws(source)))


def quantize(vector: Column) -> Column:
    """Components times 127, rounded half to even, kept within -127 and 127."""
    return F.transform(vector, lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v.cast("double") * 127))).cast("tinyint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
