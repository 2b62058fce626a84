"""Column functions on text: n-grams, hashes, previews, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in a search text, for Java regular expressions.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF


def normalise_space(text: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's characters, as a long.

    A product of two 32-bit numbers fits a long, as the prime has 25 bits.
    """

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        return (x * FNV_PRIME).bitwiseAND(F.lit(MASK32))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), step)


def grams(text: Column, n: int) -> Column:
    """All runs of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), F.array().cast("array<string>"))


def padded_kgrams(text: Column, k: int = 3) -> Column:
    """Runs of k characters of $text$."""
    return grams(F.concat(F.lit("$"), text, F.lit("$")), k)


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def identifier_parts(name: Column) -> Column:
    """The lower-cased name and its parts at case changes, underscores, hyphens and dots."""
    spaced = F.regexp_replace(camel_split(name), r"[_\-.]+", " ")
    parts = F.filter(F.split(spaced, r"\s+"), lambda x: x != "")
    return F.array_distinct(F.transform(F.concat(F.array(name), parts), F.lower))


def hash_tokens(text: Column) -> Column:
    """Words of [a-z0-9_] and single other characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+|[^\s])"), 1)


def truncate_line(line: Column, position: Column | None = None, width: int = 150) -> Column:
    """A line cut to width characters with an ellipsis; around a 0-based position if one is given."""
    if position is None:
        return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width - 1), F.lit("…")))
    n = F.length(line)
    begin = F.greatest(F.lit(0), position - width // 2)
    end = F.least(n, begin + width)
    begin = F.when((end == n) & (end - begin < width), F.greatest(F.lit(0), end - width)).otherwise(begin)
    cut = F.substring(line, begin + 1, end - begin)
    cut = F.when(begin > 0, F.concat(F.lit("…"), F.substring(cut, F.lit(2), F.length(cut)))).otherwise(cut)
    cut = F.when(end < n, F.concat(F.substring(cut, F.lit(1), F.length(cut) - 1), F.lit("…"))).otherwise(cut)
    return F.when(n <= width, line).otherwise(cut)


def sanitise(line: Column) -> Column:
    """A line without control characters, tabs as two spaces."""
    return F.regexp_replace(F.regexp_replace(line, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", ""), "\t", "  ")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def preview(text: Column, line: Column, context: int = 10, width: int = 150) -> Column:
    """struct(start_line, lines) around a 1-based line: 3 lines before and 6 after it at most."""
    before = max(0, min(context // 2, 3))
    after = max(0, min(context - context // 2 - 1, 6))
    every = lines(text)
    target = F.greatest(F.lit(0), F.least(line - 1, F.size(every) - 1))
    begin = F.greatest(F.lit(0), target - before)
    end = F.least(F.size(every) - 1, target + after)
    shown = F.transform(F.slice(every, begin + 1, F.least(end - begin + 1, F.lit(10))), lambda x: sanitise(truncate_line(x, width=width)))
    return F.struct((begin + 1).alias("start_line"), shown.alias("lines"))


def code_by_span(text: Column, start: Column, end: Column) -> Column:
    """The lines from start to end, 1-based and inclusive."""
    every = lines(text)
    begin = F.greatest(F.lit(0), start - 1)
    stop = F.least(F.size(every) - 1, end - 1)
    return F.array_join(F.slice(every, begin + 1, F.greatest(F.lit(0), stop - begin + 1)), "\n")


def marked_preview(text: Column, line: Column, context: int = 2, numbered: bool = False) -> Column:
    """Lines around a 1-based line with an arrow at it, or null if the line is out of range."""
    every = lines(text)
    begin = F.greatest(F.lit(0), line - 1 - context)
    end = F.least(F.size(every), line + context)
    width = F.length(end.cast("string"))

    def show(x: Column, i: Column) -> Column:
        number = begin + i + 1
        if numbered:
            return F.concat(F.lpad(number.cast("string"), width, F.lit(" ")), F.when(number == line, "→").otherwise(" "), F.lit(" "), x)
        return F.concat(F.when(number == line, "→ ").otherwise("  "), x)

    dots = lambda c: F.when(c, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.slice(every, begin + 1, end - begin), show)
    out = F.array_join(F.concat(dots(begin > 0), body, dots(end < F.size(every))), "\n")
    return F.when((line >= 1) & (line <= F.size(every)), out)


def dedent(text: Column) -> Column:
    """A text without blank lines at its ends and without the indentation all its lines share."""
    every = F.transform(lines(text), lambda x: F.struct(x.alias("x"), (F.regexp_instr(x, F.lit(r"\S")) == 0).alias("blank")))
    full = F.filter(every, lambda x: ~x["blank"])
    indent = F.array_min(F.transform(full, lambda x: F.regexp_instr(x["x"], F.lit(r"\S")) - 1))
    cut = F.transform(every, lambda x: F.when(F.length(x["x"]) >= indent, F.substring(x["x"], indent + 1, F.length(x["x"]))).otherwise(x["x"]))
    joined = F.array_join(cut, "\n")
    return F.when(F.size(full) == 0, F.lit("")).otherwise(F.regexp_replace(joined, r"^\s+|\s+$", ""))


def chunk_id(text: Column) -> Column:
    return F.sha2(dedent(text), 256)


def is_chunk_id(value: Column) -> Column:
    return value.rlike("^[a-f0-9]{64}$")


def semantic_hash(signature: Column, body: Column) -> Column:
    """16 hexadecimal digits that comments and white space do not change."""
    bare = F.regexp_replace(body, r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*", " ")
    return F.lpad(F.lower(F.hex(F.xxhash64(normalise_space(signature), normalise_space(bare)))), 16, "0")


def count_lines(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(lines(text)))


def has_nul(text: Column, sample: int = 8192) -> Column:
    return F.substring(text, 1, sample).contains("\0")


def is_text(text: Column, sample: int = 8192) -> Column:
    """No control characters but tab, line feed and carriage return."""
    return ~F.substring(text, 1, sample).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def looks_binary(text: Column, sample: int = 8000) -> Column:
    """A NUL, or over 30 % of control characters."""
    head = F.substring(text, 1, sample)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]", ""))
    return head.contains("\0") | (odd > 0.3 * F.length(head))


def format_bytes(n: Column) -> Column:
    unit = lambda x, name: F.format_string(f"%.2f {name}", n / x)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1024.0, "KB")).when(n < 1024**3, unit(1024.0**2, "MB")).otherwise(unit(1024.0**3, "GB"))


def format_score(score: Column) -> Column:
    return F.format_string("%.3f", score)


def format_match(path: Column, line: Column, context: Column) -> Column:
    return F.concat(path, F.lit(":"), F.lpad(line.cast("string"), F.greatest(F.lit(4), F.length(line.cast("string"))), F.lit(" ")), F.lit(": "), context)


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) <= 4, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(key, F.lit(4))))


def valid_key(key: Column) -> Column:
    return F.length(key) >= 20


def retry_delay(attempt: Column, initial: float = 1000, factor: float = 2, most: float = 30000) -> Column:
    """The delay before an attempt, without jitter."""
    return F.floor(F.least(F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(most))))


def anchor(path: Column, line: Column, column: Column | None = None) -> Column:
    parts = [path, line.cast("string"), *([column.cast("string")] if column is not None else [])]
    return F.concat_ws(":", *parts)


def qualified_name(class_name: Column, namespace: Column, name: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.concat(full(class_name), F.lit("."), name), F.concat(full(namespace), F.lit("."), name), name)


def sanitise_input(text: Column) -> Column:
    """Text without control characters and shell or markup metacharacters, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F<>|;&$`\\\"']", ""))


#: Error codes by what to do about them.
RETRYABLE_CODES = ("EBUSY", "EAGAIN", "ETIMEDOUT", "ENOTFOUND", "ECONNRESET", "EPIPE", "EMFILE", "ENFILE")


def error_category(code: Column) -> Column:
    return F.when(code.isin(*RETRYABLE_CODES), "transient").otherwise("permanent")


#: Letters of a change list and what they stand for.
FILE_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed", "U": "unmerged"}


def file_status(letter: Column) -> Column:
    key = F.upper(F.substring(F.trim(letter), 1, 1))
    table = F.create_map(*(F.lit(x) for pair in FILE_STATUS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit("unknown"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
