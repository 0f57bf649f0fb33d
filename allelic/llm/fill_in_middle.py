"""Fill-in-the-middle: a text cut at two drawn boundaries into prefix, middle and suffix, and put together anew.

Boundaries are found by bit-parallelism over one big integer a text: `bytes.translate` maps each byte of the UTF-8 text to 1
if it is in a class and else to 0, which read as a big-endian integer has one bit a byte; shifts and boolean operations on
these class masks mark the first byte of each unit; `bit_count` gives the number n of units; and the byte of the k-th mark
is found by halving the integer again and again, keeping the half that holds it. Every step is linear in the text and runs
on machine words.

The draw depends on the key and the seed alone: h1 to h4 are the first four groups of 8 hex digits of
sha256("<seed>:<key>"). The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the
larger. A text is left plain if it is empty, holds a sentinel, or h3 % 100 >= rate; otherwise suffix-prefix-middle if
h4 % 100 < spm, else prefix-suffix-middle. Where no sentinel is in a text, the first occurrences of the sentinels in its
output are those that were put there (a sentinel that starts with "<" can't overlap one that ends with ">"), so that
`restore` gives the exact text.

Defined results: null and empty texts have n = 0 and form plain with empty output; a null key draws as an empty one; equal
keys draw alike, so repeated rows give equal rows, and no result depends on the order of rows, so that there are no ties;
an empty table gives an empty one; texts of any length are cut whole, one text at a time in memory. Other columns stay;
where one has the name of an added column it stays and the added column gets underscores in front.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, small_batches

ship(__name__)

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
KIND = "n long, form string, prefix_chars long, middle_chars long, output binary"


def _table(ones: bytes) -> bytes:
    return bytes(b in ones for b in range(256))


#: Bytes that begin a code point; white space and other bytes; line feeds.
HEADS = _table(bytes(b for b in range(256) if b & 0xC0 != 0x80))
BLANKS = _table(b"\t\n\v\f\r ")
LINES = _table(b"\n")


def _mask(text: bytes, table: bytes) -> int:
    return int.from_bytes(text.translate(table), "big")


def _full(size: int) -> int:
    """A one for each of so many bytes."""
    return int.from_bytes(b"\x01" * size, "big")


def boundaries(text: bytes, unit: str = "char") -> int:
    """One bit a byte, on where a unit begins: a code point, a word with the white space before it (the first word takes
    the text's start), or a line with its line feed."""
    if unit == "char":
        return _mask(text, HEADS)
    if not text:
        return 0
    first = 1 << 8 * (len(text) - 1)
    if unit == "line":
        return (_mask(text, LINES) >> 8 | first) & _full(len(text))
    if unit == "word":
        blank = _mask(text, BLANKS)
        after_word = (blank ^ _full(len(text))) >> 8  # the byte before is in a word
        return blank & after_word | first
    raise ValueError(f"unit: {unit!r}")


def nth_mark(marks: int, size: int, k: int) -> int:
    """Byte of the k-th mark (from 0) among so many bytes, or the end of the text where there is none."""
    if k >= marks.bit_count():
        return size
    at = 0
    while size > 1:
        right = size // 2
        head = marks >> 8 * right
        if k < (ones := head.bit_count()):
            marks, size = head, size - right
        else:
            k, at = k - ones, at + size - right
            marks, size = marks & ((1 << 8 * right) - 1), right
    return at


def draw(key: str, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(text: bytes, key: str, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS) -> tuple:
    """(n, form, code points of the prefix, of the middle, output)."""
    marks = boundaries(text, unit)
    n = marks.bit_count()
    h1, h2, h3, h4 = draw(key, seed)
    p, s, m = (x.encode() for x in sentinels)
    if not text or p in text or s in text or m in text or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    i, j = (nth_mark(marks, len(text), k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    chars = [_mask(x, HEADS).bit_count() for x in (prefix, middle)]
    if h4 % 100 < spm:
        return n, SPM, *chars, s + suffix + p + prefix + m + middle
    return n, PSM, *chars, p + prefix + s + suffix + m + middle


def fill_in_middle(df: DataFrame, key: str, text: str, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars (null if plain) and output. rate and spm are percentages; unit is char,
    word or line."""
    if len(set(sentinels)) != 3 or any(len(s) < 2 or s[0] != "<" or s[-1] != ">" or "<" in s[1:] or ">" in s[:-1] for s in sentinels):
        raise ValueError("sentinels must be three different strings that begin with < and end with >, neither of them inside")
    small_batches(df.sparkSession)

    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, k, seed, rate, spm, unit, sentinels) for k, t in zip(keys, texts, strict=True)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    as_text = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    held = free_name(df.columns, "_fim")
    out = df.withColumn(held, F.pandas_udf(cut, KIND)(as_text(key), as_text(text).cast("binary")))
    names = {c: free_name(df.columns, c) for c in ADDED}
    added = [(F.col(f"{held}.{c}").cast("string") if c == "output" else F.col(f"{held}.{c}")).alias(names[c]) for c in ADDED]
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *added)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that an output and its form came from."""
    p, s, m = sentinels

    def between(a: str, b: str | None) -> Column:
        rest = F.substring(output, F.locate(a, output) + len(a), F.length(output))
        return rest if b is None else F.substring(rest, F.lit(1), F.locate(b, rest) - 1)

    return F.when(form == PLAIN, output).when(form == SPM, F.concat(between(p, m), between(m, None), between(s, p))).otherwise(F.concat(between(p, s), between(m, None), between(s, m)))
