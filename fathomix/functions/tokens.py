"""Word ids for an embedder's input, and Porter stems."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD, UNKNOWN, START, STOP = 0, 1, 2, 3
WORD_IDS = 30000
_IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])


def word_id(word: str) -> int:
    """A 32-bit string hash (31 h + c over UTF-16 units), folded to the ids after the special ones."""
    h = 0
    units = word.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (31 * h + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h) % WORD_IDS + 4


def split_words(text: str) -> list[str]:
    """Words between white space and punctuation, lower-cased."""
    marked = "".join(" " if unicodedata.category(c)[0] == "P" else c for c in text.lower())
    return marked.split()


def encode_words(text: str | None, size: int = 512) -> tuple[list[int], list[int]]:
    ids = [START, *(word_id(w) for w in split_words(text or "")[: size - 2]), STOP]
    return ids + [PAD] * (size - len(ids)), [1] * len(ids) + [0] * (size - len(ids))


def word_ids(text: Column, size: int = 512) -> Column:
    """struct(ids, mask) of a text, padded to one size."""

    @F.arrow_udf(_IDS)
    def encode(batch: pa.Array) -> pa.Array:
        # Two matrices of small numbers; no list of Python numbers outlives its text.
        ids, mask = np.zeros((len(batch), size), np.int32), np.zeros((len(batch), size), np.int32)
        for i, t in enumerate(batch):
            ids[i], mask[i] = encode_words(t.as_py(), size)
        starts = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, pa.array(m.ravel())) for m in (ids, mask)], names=["ids", "mask"])

    return encode(text)


def _form(stem: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Fixed values of the published algorithm: suffixes and what takes their place, of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm of 1980."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _form(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words: Column) -> Column:
    """The stems of an array of words, without accents."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batch: pa.Array) -> pa.Array:
        # Each different word once; the words of a batch stay Arrow buffers.
        coded = batch.flatten().dictionary_encode()

        def one(w: str | None) -> str | None:
            return None if w is None else porter("".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)))

        stemmed = pa.array([one(w.as_py()) for w in coded.dictionary], pa.string()).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(starts, stemmed, mask=batch.is_null())

    return run(words)
