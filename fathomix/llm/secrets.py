"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Base spans follow three patterns: assignments of 12 or more characters to a password-like name, access
keys of 18 or more, and runs of 16 or more hexadecimal digits.  The method adds tokens of 20 or more
characters of [A-Za-z0-9+/_=-], outside base spans, that look random.

For each token an encoding is inferred from its characters, and its digits, as positions in that
alphabet, take three tests against uniform digits: chi-squared over cells of the alphabet (digits,
symbols, common and rare letters of either case, so that no cell is expected to be empty), the number of runs of
character classes, and serial correlation.  Their squared normal scores add up to one distance from uniform
digits: small for random tokens, large for ordinary ones.

The null hypothesis is an ordinary token.  Its distribution of the logarithm of that distance is taken
from the documents themselves, for each encoding and band of length: from the tokens that uniform digits
would hardly give (a level of ``REJECT``, so that secrets, however many, do not shape it), and a fixed number of made-up
ordinary tokens, which decide where a corpus has few.  The median and the spread of the lower half give
a normal tail, and so each tested token a p-value.  The Benjamini-Hochberg procedure runs over all
tested tokens of each band of length, from a histogram of bounded size, so that many long tokens do not
lend their discoveries to a short one.

Positions are code points, ends exclusive.  Null and empty texts have no spans; repeated rows are
reported row by row; very long texts cost in proportion to their length; an empty table gives no rows;
other columns are ignored in reports and passed through by ``redact``.
"""

from __future__ import annotations

import bisect
import math
import operator
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text
from fathomix.storage import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest alphabet on; a token has the first that holds all its characters.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Shares of the letters in ordinary words, by the usual order of their frequency; together 1.
WORD_SHARES = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (0.127, 0.091, 0.082, 0.075, 0.070, 0.067, 0.063, 0.061, 0.060, 0.043, 0.040, 0.028, 0.028, 0.024, 0.024, 0.022, 0.020, 0.020, 0.019, 0.015, 0.010, 0.008, 0.0015, 0.0015, 0.001, 0.001), strict=True))
#: The letters that make up most of ordinary words.
COMMON = frozenset("etaoinshrdl")
BANDS = (20, 28, 40, 64, 128)
FALSE_DISCOVERY = 0.01
#: Tokens beyond this distance are random with a probability of 0.001 at most (chi-squared of three).
REJECT = 16.27
#: Bins of the logarithm of 1 + distance; made-up ordinary tokens for each encoding and band.
WIDTH, MADE_UP = 0.05, 100
#: The spread of ordinary tokens is taken to be so much at least.
LEAST_SPREAD = 0.25

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
TESTED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("bin", T.IntegerType())]))
FIELDS = [T.StructField("base", SPANS), T.StructField("tested", TESTED)]


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


class Encoding:
    """An alphabet with its cells and classes, and their shares among uniform digits."""

    def __init__(self, alphabet: str):
        names = [(kind_of(c), c.lower() in COMMON) for c in alphabet]
        self.value = {c: i for i, c in enumerate(alphabet)}
        cells = sorted(set(names))
        self.cell = {c: cells.index(x) for c, x in zip(alphabet, names, strict=True)}
        self.shares = [names.count(x) / len(alphabet) for x in cells]
        self.kind = {c: kind_of(c) for c in alphabet}
        kinds = [k for k, _ in names]
        self.change = 1 - sum((kinds.count(k) / len(kinds)) ** 2 for k in set(kinds))

    def distance(self, body: str) -> float:
        """The sum of squared scores of the three tests."""
        n = len(body)
        counts = [0] * len(self.shares)
        for c in body:
            counts[self.cell[c]] += 1
        chi = sum((x - n * p) ** 2 / (n * p) for x, p in zip(counts, self.shares, strict=True))
        df = len(counts) - 1
        uniform = max(0.0, ((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
        kinds = [self.kind[c] for c in body]
        m = n - 1
        changes = sum(map(operator.ne, kinds, kinds[1:]))
        runs = (changes - m * self.change) / math.sqrt(m * self.change * (1 - self.change))
        x = [self.value[c] for c in body]
        mu = sum(x) / n
        x = [v - mu for v in x]
        ss = sum(map(operator.mul, x, x))
        serial = (sum(map(operator.mul, x, x[1:])) / ss + 1 / n) * math.sqrt(n) if ss else math.sqrt(n)
        return uniform**2 + runs**2 + serial**2


CODES = [Encoding(a) for _, a in ENCODINGS]


def infer(token: str) -> int:
    """The place in ENCODINGS of the narrowest one that holds a token without its padding."""
    chars = set(token)
    return next((i for i, e in enumerate(CODES) if chars <= e.value.keys()), len(CODES) - 1)


def battery(token: str) -> tuple[int, int, float] | None:
    """(encoding, band of length, distance from uniform digits); None for little but padding."""
    body = token.replace("=", "")
    if len(body) < 8:
        return None
    code = infer(body)
    return code, bisect.bisect_right(BANDS, len(token)), CODES[code].distance(body)


def bin_of(distance: float) -> int:
    return int(math.log1p(distance) / WIDTH)


def made_up(code: int, band: int, n: int = MADE_UP) -> list[float]:
    """Distances of ordinary tokens of an encoding: words of its letters, in capitals, lower case or both, apart by symbols or digits."""
    r = random.Random(code * 100 + band)
    alphabet = CODES[code].value
    low, high = (BANDS[band - 1] if band else 8), (BANDS[band] if band < len(BANDS) else 2 * BANDS[-1])
    forms = [f for f, ok in ((str.lower, "e" in alphabet), (str.upper, "E" in alphabet), (str.capitalize, "E" in alphabet and "e" in alphabet)) if ok]
    joins = ["", *(c for c in "-_/+" if c in alphabet)]
    out = []
    for _ in range(n):
        form, join, numbers, size, token = r.choice(forms), r.choice(joins), r.random() < 0.3, r.randrange(low, high), ""
        while len(token) < size:
            if numbers and r.random() < 0.3:
                part = str(r.randrange(3000))
            else:
                part = form("".join(r.choices([c for c in WORD_SHARES if form(c) in alphabet or c in alphabet], [p for c, p in WORD_SHARES.items() if form(c) in alphabet or c in alphabet], k=r.randint(3, 9))))
            token += (join if token else "") + "".join(c for c in part if c in alphabet)
        out.append(CODES[code].distance(token[:size]))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(texts: pa.Array) -> list:
    base, tested = [], []
    for text in texts.to_pylist():
        found = base_spans(text) if text else []
        out, k, reach = [], 0, 0
        for m in TOKEN.finditer(text or ""):
            s, e = m.span()
            while k < len(found) and found[k][0] < e:
                reach = max(reach, found[k][2])
                k += 1
            x = battery(m.group()) if reach <= s else None
            if x:
                out.append({"start": s, "end": e, "cell": x[0] * (len(BANDS) + 1) + x[1], "bin": bin_of(x[2])})
        base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
        tested.append(out)
    return [base, tested]


def null_of(cell: int, counts: dict[int, int]) -> tuple[float, float]:
    """Median and spread of ordinary tokens' bins, of the histogram of a cell's tested tokens."""
    ordinary = {b: n for b, n in counts.items() if b > bin_of(REJECT)}
    for d in made_up(*divmod(cell, len(BANDS) + 1)):
        ordinary[bin_of(d)] = ordinary.get(bin_of(d), 0) + 1
    total = sum(ordinary.values())

    def quantile(share: float) -> int:
        so_far = 0
        for b in sorted(ordinary):
            so_far += ordinary[b]
            if so_far >= share * total:
                break
        return b

    median = quantile(0.5)
    return median, max(LEAST_SPREAD / WIDTH, (median - quantile(0.1)) / 1.2816)


def accepted(histogram: list[tuple[int, int, int]], level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """cell -> the highest bin that Benjamini and Hochberg's procedure accepts, of rows (cell, bin, count)."""
    cells: dict[int, dict[int, int]] = {}
    for cell, b, n in histogram:
        cells.setdefault(cell, {})[b] = n
    bands: dict[int, list[tuple[float, int, int, int]]] = {}
    for cell, counts in cells.items():
        median, spread = null_of(cell, counts)
        for b, n in counts.items():
            p = upper_tail((median - b) / spread) if b < median else 1.0
            bands.setdefault(cell % (len(BANDS) + 1), []).append((p, cell, b, n))
    out: dict[int, int] = {}
    for tests in bands.values():
        m, so_far, last = sum(n for *_, n in tests), 0, -1.0
        for p, _, _, n in sorted(tests):
            so_far += n
            if p <= level * so_far / m:
                last = p
        for p, cell, b, _ in tests:
            if p <= last:
                out[cell] = max(out.get(cell, -1), b)
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: float = FALSE_DISCOVERY, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, by default the id as doc_id, with base and spans (arrays of start, kind, end): one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "secrets")
    if keep is None:
        docs, keep = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]
        text = "text"
    found = scratch.write(map_text(docs, text, FIELDS, lambda: scan, keep))
    cells = len(ENCODINGS) * (len(BANDS) + 1)
    # At most so many cells and 15,000 bins: a distance is finite and its logarithm below 750.
    rows = found.select(F.explode("tested").alias("c")).groupBy("c.cell", "c.bin").count().collect()
    highest = accepted([tuple(r) for r in rows], level)
    limits = F.array(*(F.lit(highest.get(c, -1)) for c in range(cells)))
    random = F.transform(F.filter("tested", lambda c: c["bin"] <= F.get(limits, c["cell"])), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select(*(c for c in keep), "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_string(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, mark: str = "<secret>", text: str = "text", level: float = FALSE_DISCOVERY) -> DataFrame:
    """docs with each stretch of spans, of the patterns and of the battery, replaced by a mark."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    found = find_secrets(packed, level=level, keep=["doc"]).select("doc", F.col("doc")[text].alias("text"), "spans")

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, parts = 0, []
                for x in spans:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], mark]
                    at = max(at, x["end"])
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], names=["doc", "clean"])

    schema = T.StructType([found.schema["doc"], T.StructField("clean", T.StringType())])
    done = found.mapInArrow(run, schema)
    return done.select(*((F.col("clean") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns))
