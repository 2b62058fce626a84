"""Benchmark decontamination: word n-grams of test items looked up in training documents.

Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters.  A window is n
consecutive words of an item; an item of fewer words, but not none, is one window.  A document word
inside any occurrence of a window is hit.

The index of windows is arrays: a sorted 64-bit hash and a place for each window, the items' words once,
and a table of hash prefixes with four entries or more a window, so that few words of a clean document
reach the search.  Equal hashes are verified by their words.  The bytes that it takes are measured
before it is built.  Up to ``built_bytes`` it is broadcast and documents are scanned once, without a
shuffle.  Beyond, they are still scanned once: what is broadcast is a bitmap of bounded size, and the windows
that it lets pass meet the items' windows in a join by their words.

Defined cases: a null or wordless text has no words, no hits and no items; a null or wordless item has
no windows; an item without an id hits words but is not counted; rows that repeat an item id add their windows to that id; repeated documents are reported
row by row; an empty benchmark hits nothing; very long texts are scanned whole; columns other than id and text are ignored in reports and
passed through by ``remove_contamination``; kept columns named like a result give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text
from fathomix.llm.textbytes import ALNUM, Powers, Words, windows
from fathomix.storage import Scratch

WINDOW = 13
#: An index of so many bytes at most is broadcast.
BUILT_BYTES = 64 << 20
#: Bytes of an index for each word besides its own: hash, place, flag, limits and prefix table.
WORD_BYTES = 8 + 4 + 1 + 16 + 8
#: The bitmap of larger benchmarks: bits for each window, as powers of two, and their least and greatest number.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 4, 16, 29
#: Windows whose items a task remembers.
REMEMBERED = 100_000

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_spans", SPAN),
    T.StructField("byte_spans", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
]


#: Plain arrays, as a broadcast is pickled by reference and workers may have no copy of this library.
Index = dict


def item_windows(w: Words, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each window length the hashes of all windows of the rows, which are items, and their first words."""
    counts = w.count()
    length = np.minimum(counts, n)
    out = {}
    for size in np.unique(length[length > 0]).tolist():
        h = windows(w.hashes, size)
        at = np.arange(len(h))
        row = np.searchsorted(w.rows, at, side="right") - 1
        at = at[(length[row] == size) & (at + size <= w.rows[row + 1])]
        out[size] = h[at], at
    return out


def window_index(items: list[tuple[str | None, str | None]], n: int) -> Index:
    """The index of benchmark items (id, text)."""
    w = Words(pa.array([t for _, t in items], pa.string()), ALNUM, Powers())
    joined = [w.text(int(a), int(b)) for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)]
    words = [x for part in joined for x in part]
    limits = np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])]).astype(np.int64) if words else np.zeros(1, np.int64)
    sizes = {}
    for size, (h, at) in item_windows(w, n).items():
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order].astype(np.int32)
        same = np.zeros(len(h), bool)  # whether a window has the words of the one before
        for i in (np.flatnonzero(h[1:] == h[:-1]) + 1).tolist():
            same[i] = words[at[i] : at[i] + size] == words[at[i - 1] : at[i - 1] + size]
        bits = min(30, max(10, int(4 * len(h) - 1).bit_length()))
        prefixes = np.zeros(1 << bits, bool)
        prefixes[h >> np.uint64(64 - bits)] = True
        sizes[size] = h, at, same, bits, prefixes
    return {"ids": [i for i, _ in items], "first": np.asarray(w.rows, np.int64), "text": b" ".join(words) + b" ", "limits": limits, "sizes": sizes}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _spans(w: Words, n: int, hits: dict[int, list[tuple[int, int]]]) -> list:
    """n_words, and the merged spans of each of n rows in words and in bytes."""
    word_spans, byte_spans = [[] for _ in range(n)], [[] for _ in range(n)]
    for r, spans in hits.items():
        first, offset = int(w.rows[r]), int(w.offsets[r])
        for s, e in _merged(spans):
            word_spans[r].append({"start": s - first, "end": e - first})
            byte_spans[r].append({"start": int(w.starts[s]) - offset, "end": int(w.ends[e - 1]) - offset})
    return [w.count(), word_spans, byte_spans]


def scanner(index: Index):
    """A function from a slice of texts to the values of FIELDS."""
    powers = Powers()
    ids, first, text, limits = index["ids"], index["first"], index["text"], index["limits"]
    held: dict[tuple[int, int], list[tuple[bytes, frozenset]]] = {}

    def windows_at(size: int, k: int) -> list[tuple[bytes, frozenset]]:
        """(words, item ids) of the different windows whose hash is at place k."""
        found = held.get((size, k))
        if found is None:
            h, at, same, _, _ = index["sizes"][size]
            found, j = [], k
            while j < len(h) and h[j] == h[k]:
                if not same[j]:
                    found.append((text[limits[at[j]] : limits[at[j] + size]], set()))
                found[-1][1].add(ids[int(np.searchsorted(first, at[j], side="right")) - 1])
                j += 1
            if len(held) >= REMEMBERED:
                held.clear()
            found = held[size, k] = [(x, frozenset(y)) for x, y in found]
        return found

    def scan(texts: pa.Array) -> list:
        w = Words(texts, ALNUM, powers)
        n = len(texts)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for size, (hashes, _, _, bits, prefixes) in index["sizes"].items():
            h = windows(w.hashes, size)
            at = np.flatnonzero(prefixes[h >> np.uint64(64 - bits)])
            k = np.searchsorted(hashes, h[at])
            equal = hashes[np.minimum(k, len(hashes) - 1)] == h[at]
            at, k = at[equal], k[equal]
            row = np.searchsorted(w.rows, at, side="right") - 1
            inside = at + size <= w.rows[row + 1]
            for i, r, j in zip(at[inside].tolist(), row[inside].tolist(), k[inside].tolist(), strict=True):
                words = b" ".join(w.text(i, i + size)) + b" "
                for same, found in windows_at(size, j):
                    if words == same:
                        hits.setdefault(r, []).append((i, i + size))
                        items.setdefault(r, set()).update(found)
        return [*_spans(w, n, hits), [sorted(x for x in items.get(r, ()) if x is not None) for r in range(n)]]

    return scan


#: Windows that a bitmap lets pass: first word, number of words, their bytes in the text, and the words themselves.
PASSED = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.StringType())]))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))


def _built_bytes(items: DataFrame) -> int:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + WORD_BYTES * words)).first()[0] or 0


def _window_table(items: DataFrame, n: int) -> DataFrame:
    """(item, size, words, hash) of all windows of the items."""
    fields = [T.StructField("w", T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("hash", T.LongType())])))]

    def make():
        powers = Powers()

        def run(texts: pa.Array) -> list:
            w = Words(texts, ALNUM, powers)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for size, (h, at) in item_windows(w, n).items():
                row = np.searchsorted(w.rows, at, side="right") - 1
                for r, i, x in zip(row.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                    out[r].append({"size": size, "words": b" ".join(w.text(i, i + size)).decode(), "hash": x})
            return [out]

        return run

    return map_text(items, "text", fields, make, ["item"]).select("item", F.explode("w").alias("w")).select("item", "w.*").distinct()


def _bitmap(table: DataFrame, bits: int) -> np.ndarray:
    """Whether a window's hash begins with so many bits; 2 ** bits - 3 bytes at most come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits) + 1  # as buckets of 4096 bytes are numbered from 1, and bits in them from 1 on
    rows = table.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * len(r["bits"])
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
        out[at : at + len(part)] |= part
    return out


def _joined(docs: DataFrame, items: DataFrame, n: int, text: str, keep: list[str]) -> DataFrame:
    """The same by a bitmap and a join of the windows that it lets pass."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    table = scratch.write(_window_table(items, n))
    total = table.count()
    sizes = [r[0] for r in table.select("size").distinct().collect()]  # at most n
    bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length() + BITS_A_WINDOW))
    shared = spark.sparkContext.broadcast((sizes, bits, _bitmap(table, bits)))

    def make():
        powers = Powers()
        sizes, bits, bitmap = shared.value

        def run(texts: pa.Array) -> list:
            w = Words(texts, ALNUM, powers)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for size in sizes:
                place = windows(w.hashes, size) >> np.uint64(64 - bits)
                at = np.flatnonzero((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(w.rows, at, side="right") - 1
                inside = at + size <= w.rows[row + 1]
                for i, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                    offset = int(w.offsets[r])
                    out[r].append({"place": i - int(w.rows[r]), "size": size, "start": int(w.starts[i]) - offset, "end": int(w.ends[i + size - 1]) - offset, "words": b" ".join(w.text(i, i + size)).decode()})
            return [w.count(), out]

        return run

    numbered = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    scanned = map_text(numbered, "text", [FIELDS[0], T.StructField("passed", PASSED)], make, ["kept"])
    scanned = scratch.write(scanned.withColumn("row", F.monotonically_increasing_id()))
    passed = scanned.select("row", F.explode("passed").alias("p")).select("row", "p.*")
    met = passed.join(table.drop("hash"), ["size", "words"])
    hits = met.groupBy("row").agg(_merged_spans("place", F.col("place") + F.col("size")).alias("word_spans"), _merged_spans("start", F.col("end")).alias("byte_spans"), F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast(SPAN)
    out = scanned.select("row", "kept", "n_words").join(hits, "row", "left")
    new = {"n_words": F.col("n_words"), "word_spans": F.coalesce("word_spans", none), "byte_spans": F.coalesce("byte_spans", none), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return out.select(*(F.col("kept")[c].alias(c) for c in keep if c not in new), *(v.alias(k) for k, v in new.items()))


def _merged_spans(start: str, end):
    """Spans of a group, overlapping or touching ones joined; a row's hits are bounded by its own windows."""
    spans = F.array_sort(F.collect_set(F.struct(F.col(start).cast("long").alias("start"), end.cast("long").alias("end"))))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    return F.aggregate(spans, F.array().cast(SPAN), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), longer(acc, x)).otherwise(F.concat(acc, F.array(x))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, built_bytes: int = BUILT_BYTES) -> DataFrame:
    """Per document row: ``keep`` columns, n_words, merged word_spans and byte_spans of hits, items."""
    keep = [doc_id] if keep is None else keep
    items = _items(benchmark, item_id, item_text)
    if _built_bytes(items) > built_bytes:
        return _joined(docs, items, n, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(window_index([tuple(r) for r in items.collect()], n))
    return map_text(docs, text, FIELDS, lambda: scanner(shared.value), keep)


def n_hit(spans: str = "word_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """docs without the rows of which ``share`` of the words or more are hit; other hits are cut out."""
    text = options.get("text", "text")
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__words"))
    found = find_contamination(packed, benchmark, keep=["__doc"], **{**options, "text": "__words"})
    few = (F.size("word_spans") == 0) | (n_hit() < share * F.col("n_words"))
    words = F.col("__doc")[text]
    cut = F.aggregate(
        "byte_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], _bytes(words, a["at"], s["start"])).alias("out")),
        lambda a: F.concat(a["out"], _bytes(words, a["at"], F.octet_length(words).cast("long"))),
    )
    clean = F.when(F.size("byte_spans") > 0, cut).otherwise(words)
    return found.filter(few).select(*(clean.alias(c) if c == text else F.col("__doc")[c].alias(c) for c in docs.columns))


def _bytes(text, start, end):
    part = F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))
    return F.decode(part, "UTF-8")
