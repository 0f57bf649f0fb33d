"""Byte-level BPE encoding and decoding by traversing a trie of distinct words.

A word's encoding is unique, and every prefix of an encoding is the encoding of the bytes it covers. So the
encoding of a byte string is known from its last token and the encoding of what stands before that token. The
distinct words of a batch go into a trie; a depth-first walk finds the last token of each node from the nodes above
it, so that a prefix which many words share is encoded once.

Defined results: a null text counts as empty; an empty text has no tokens. Repeated rows and extra columns pass
through unchanged; a column named like the result gives way to it. Very long texts are encoded whole. Special tokens that stand in a text are encoded as themselves unless `special=False`.

A text's tokens depend on that text alone, so there are no ties among rows; between merges the vocabulary's order decides. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, free_name, ship, small_batches

#: The pattern that a byte-level vocabulary was trained with; a fixed value of the public format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers before it starts anew, the bytes of a word that it remembers, and pairs of tokens.
REMEMBER, SHORT_WORD, PAIRS = 250_000, 64, 1_000_000
#: Distinct words whose number of tokens a worker remembers.
COUNTED = 100_000
#: Rows whose words are walked together: the more, the more prefixes are shared.
TOGETHER = 768


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level format: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks and the added tokens of a tokenizer file."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._whole: dict[bytes, bool] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether the token is what its own bytes encode to."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = token in self.id_of and self.merge(token) == [token]
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        return self.merge(a + b) == [a, b]

    def automaton(self) -> None:
        """Suffix automaton of the tokens: step[state << 8 | byte] leads to the state of the longest suffix that begins
        a token; ends[state] has the (length, id) of the tokens that end there, the longest first."""
        self.step: dict[int, int] = {}
        self.ends: list[tuple] = [()]
        parent = [(0, 0)]
        for token, i in self.id_of.items():
            state = 0
            for b in token:
                to = self.step.get(state << 8 | b)
                if to is None:
                    to = self.step[state << 8 | b] = len(self.ends)
                    self.ends.append(())
                    parent.append((state, b))
                state = to
            if self.whole(token):
                self.ends[state] = ((len(token), i),)
        self.fail = [0] * len(self.ends)
        depth = [0] * len(self.ends)
        for s in range(1, len(self.ends)):
            depth[s] = depth[parent[s][0]] + 1
        for s in sorted(range(1, len(self.ends)), key=depth.__getitem__):
            up, b = parent[s]
            f = 0
            if up:
                f = self.fail[up]
                while f and f << 8 | b not in self.step:
                    f = self.fail[f]
                f = self.step.get(f << 8 | b, 0)
            self.fail[s] = f
            self.ends[s] += self.ends[f]
        self._pairs: dict[int, bool] = {}

    def follow(self, state: int, b: int) -> int:
        """A step that isn't in the table: by failure links; the result is kept."""
        f = state
        while f and f << 8 | b not in self.step:
            f = self.fail[f]
        to = self.step.get(f << 8 | b, 0)
        if len(self.step) < 4_000_000:
            self.step[state << 8 | b] = to
        return to

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The encoding of each distinct word. The trie is walked depth first: sorted words visit its nodes in that
        order, and the stacks hold the states on the path to the present node, so that what a word shares with the one
        before it isn't done again."""
        if not hasattr(self, "step"):
            self.automaton()
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        step, ends, pairs, known, follow = self.step.get, self.ends, self._pairs, self._pairs.get, self.follow
        states, last, came = [0], [0], [0]  # by depth: automaton state, last token, depth at which that token begins
        before, n = b"", 0
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], came[shared + 1 :]
            state, depth = states[shared], shared
            for b in word[shared:]:
                depth += 1
                to = step(state << 8 | b)
                state = follow(state, b) if to is None else to
                for size, token in ends[state]:
                    at = depth - size
                    if not at:
                        break
                    pair = last[at] << 20 | token
                    fits = known(pair)
                    if fits is None:
                        fits = pairs[pair] = self.fits(self.bytes_of[last[at]], self.bytes_of[token])
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                states.append(state)
                last.append(token)
                came.append(at)
            before, out, n = word, [], depth
            while n:
                out.append(last[n])
                n = came[n]
            out.reverse()
            yield word, out

    def pieces(self, text: str, special: bool = True) -> Iterator[tuple[bool, str]]:
        """(is it a special token, piece) from left to right."""
        at = 0
        if special and self.at_special:
            for m in self.at_special.finditer(text):
                yield from ((False, p) for p in self.split.findall(text[at : m.start()]))
                yield True, m[0]
                at = m.end()
        yield from ((False, p) for p in self.split.findall(text[at:] if at else text))


class Coder:
    """Encodes and decodes texts with a Vocabulary, remembering words up to a bound."""

    def __init__(self, vocabulary: Vocabulary, special: bool = True):
        self.v, self.special = vocabulary, special
        self.sizes: dict[str, int] = {}  # word -> number of ids
        self.known: dict[str, tuple[str, bytes]] = {}  # word -> ids joined by commas, bytes they decode to
        self.digits = {i: str(i) for i in vocabulary.bytes_of}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards `found` has every piece."""
        if len(self.known) > REMEMBER:
            self.known = {}
        self.once: dict[str, tuple[str, bytes]] = {}
        special = self.special and self.v.at_special
        split, known, digits, raw = self.v.split.findall, self.known, self.digits.__getitem__, self.v.bytes_of.__getitem__
        out, fresh = [], set()
        for text in texts:
            if special and special.search(text):
                pieces = []
                for is_special, p in self.v.pieces(text):
                    if is_special:
                        known[p] = (digits(self.v.special[p]), p.encode())
                    pieces.append(p)
            else:
                pieces = split(text)
            fresh.update(pieces)
            out.append(pieces)
        # long words hardly come again: they are known for these texts alone
        for word, ids in self.v.walk([p.encode() for p in fresh.difference(known)]):
            (known if len(word) <= SHORT_WORD else self.once)[word.decode()] = (",".join(map(digits, ids)), b"".join(map(raw, ids)))
        return out

    def found(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        known, once = self.known, self.once
        if not once:
            return list(map(known.__getitem__, pieces))
        return [known.get(p) or once[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for x in self.found(pieces) for i in x[0].split(",")] for pieces in self.learn(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.bytes_of[i] for i in ids if i in self.v.bytes_of).decode("utf-8", "replace")

    def counts(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(tokens, pieces of the split) of each text. Of words only the number of their tokens is remembered."""
        if len(self.sizes) > COUNTED:
            self.sizes = {}
        special = self.special and self.v.at_special
        split, sizes, once, out, fresh = self.v.split.findall, self.sizes, {}, [], set()
        for text in texts:
            if special and special.search(text):
                pieces = []
                for is_special, p in self.v.pieces(text):
                    if is_special:
                        sizes[p] = 1
                    pieces.append(p)
            else:
                pieces = split(text)
            fresh.update(pieces)
            out.append(pieces)
        for word, ids in self.v.walk([p.encode() for p in fresh.difference(sizes)]):
            (sizes if len(word) <= SHORT_WORD else once)[word.decode()] = len(ids)
        for pieces in out:
            yield sum(map(sizes.__getitem__, pieces)) if not once else sum([sizes.get(p) or once[p] for p in pieces]), len(pieces)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded text) of each text."""
        for pieces in self.learn(texts):
            found = self.found(pieces)
            digits = ",".join([x[0] for x in found])
            raw = b"".join([x[1] for x in found])
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            yield digits.count(",") + 1 if digits else 0, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def load(spark: SparkSession, path: str):
    """The tokenizer file, read on the driver and broadcast as text (a vocabulary has a fixed size)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def coder_of(shared, special: bool = True) -> Coder:
    """One coder for each worker process and vocabulary. Functions travel by value, with globals of their own in each task,
    so what a process keeps from task to task stands beside them; the last coder only."""
    text = shared.value
    key = (hashlib.sha256(text.encode()).hexdigest(), special)
    held = sys.__dict__.setdefault(HELD, {})
    if key not in held:
        held.clear()
        held[key] = Coder(Vocabulary(json.loads(text)), special)
    return held[key]


def _rest(df: DataFrame, name: str) -> list[str]:
    """The columns that pass through: all but the result's."""
    return [c for c in df.columns if c.lower() != name.lower()]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", special: bool = True) -> DataFrame:
    """df with the token ids of each text as array<int>, in place of a column of that name."""
    small_batches(df.sparkSession)
    shared, rest = load(df.sparkSession, path), _rest(df, ids)
    source = free_name(df.columns, "_text")

    def run(batches):
        coder = coder_of(shared, special)
        for batch in batches:
            out = coder.encode([t or "" for t in batch.column(source).to_pylist()])
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(out, pa.list_(pa.int32()))], names=[*rest, ids])

    quoted = [f"`{c}`" for c in rest]
    return df.selectExpr(*quoted, f"`{text}` as `{source}`").mapInArrow(run, df.limit(0).selectExpr(*quoted, f"cast(null as array<int>) as `{ids}`").schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for, in place of a column of that name."""
    small_batches(df.sparkSession)
    shared, rest = load(df.sparkSession, path), _rest(df, text)
    source = free_name(df.columns, "_ids")

    def run(batches):
        coder = coder_of(shared)
        for batch in batches:
            out = [coder.decode(x or []) for x in batch.column(source).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(out, pa.string())], names=[*rest, text])

    quoted = [f"`{c}`" for c in rest]
    return df.selectExpr(*quoted, f"`{ids}` as `{source}`").mapInArrow(run, df.limit(0).selectExpr(*quoted, f"cast(null as string) as `{text}`").schema)


def _gathered(batches, rows: int):
    """Batches put together until they have so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for every row; a narrow stage without a shuffle."""
    small_batches(docs.sparkSession)
    shared = load(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder = coder_of(shared)
        for held in _gathered(batches, TOGETHER):
            rows = list(coder.digests([t or "" for batch in held for t in batch.column("text").to_pylist()]))
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.concat_arrays([batch.column("doc_id") for batch in held]), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(df: DataFrame, path: str, text: str = "text", names: tuple[str, str] = ("n_tokens", "n_pieces")) -> DataFrame:
    """df without its text, with the number of tokens of each, and that of the pieces which the vocabulary's split gives."""
    small_batches(df.sparkSession)
    shared = load(df.sparkSession, path)
    own = next(c for c in df.columns if c.lower() == text.lower())
    rest = [c for c in df.columns if c != own and c.lower() not in {n.lower() for n in names}]

    def run(batches):
        coder = coder_of(shared)
        for batch in batches:
            rows = list(coder.counts([t or "" for t in batch.column(own).to_pylist()]))
            if rows:
                yield pa.record_batch([*(batch.column(c) for c in rest), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], names=[*rest, *names])

    quoted = [f"`{c}`" for c in rest]
    return df.selectExpr(*quoted, f"`{own}`").mapInArrow(run, df.limit(0).selectExpr(*quoted, *(f"0L as `{n}`" for n in names)).schema)


ship(__name__)
