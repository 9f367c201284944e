"""Token counts by a transducer compiled from a byte-level BPE vocabulary.

The vocabulary's merges are compiled to a deterministic transducer over bytes. Its state is
what can still matter of the bytes read: each suffix that may yet grow into a token, with
the token that precedes it and the count up to there. A transition carries the change of the
token count, which is negative where earlier tokens fuse. Adjacent tokens of a BPE result
are exactly the pairs that BPE leaves apart when it sees the two alone, so one pass over the
bytes gives the count of the whole piece. States are made when first reached.

Texts are cut into chunks. A chunk's state map is ``(head, count, tail)``: whatever state it
is entered in, the pieces between its first and its last certain border count the same; the
open ends are settled when maps are composed. Composition is associative, and maps are
composed pairwise in rounds, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held, small_batches

CHUNK = 1 << 16
GROUP = 1 << 20
# Bounds of what a worker remembers; both tables are emptied when full.
MOST_STATES = 400_000
MOST_PIECES = 600_000

LETTER, NUMBER, BLANK, OTHER, END = range(5)
# A border that no context can move: white space never continues a piece.
CERTAIN = re.compile(r"(?<=\S)(?=[ \n])")


def byte_letters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(sys.maxunicode + 1))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for found in regex.finditer(pattern, everything):
            kind[found.start() : found.end()] = value
    return kind


class Transducer:
    """Counts the tokens of a byte string under a vocabulary's merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.growing = {t[:i] for t in self.tokens for i in range(len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", None, 0),)
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """BPE by its definition: the pair of the lowest rank fuses, leftmost first."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def stay_apart(self, left: bytes, right: bytes) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= MOST_STATES:
                self.apart.clear()
            parts = self.merged([bytes([b]) for b in left + right])
            known = self.apart[left, right] = parts == [left, right]
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count; compiles the transition."""
        letter = bytes([byte])
        for suffix, before, count in self.states[state]:
            token = suffix + letter
            if token in self.tokens and (before is None or self.stay_apart(before, token)):
                change = count + 1
                break
        alive = [(s + letter, t, c - change) for s, t, c in self.states[state] if s + letter in self.growing]
        target = (*alive, (b"", token, 0))
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        self.moves[state << 8 | byte] = number, change
        return number, change

    def count(self, piece: bytes) -> int:
        if len(self.states) >= MOST_STATES:
            self.reset()
        state = total = 0
        known = self.moves.get
        for byte in piece:
            state, change = known(state << 8 | byte) or self.move(state, byte)
            total += change
        return total


class Pieces(dict):
    """Counts of pieces, made when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, text: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        number = self[text] = self.transducer.count(text.encode("utf-8"))
        return number


class Counter:
    """Counts the tokens of texts as the tokenizer of ``path`` does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda text: bytes(letters[c] for c in text)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.known = Pieces(Transducer([(raw(a), raw(b)) for a, b in pairs]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text by itself."""
        out = np.zeros(len(texts), np.int64)
        first, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text) + 1
            if held >= GROUP or i == len(texts) - 1:
                out[first : i + 1] = self.counts_of_group(texts[first : i + 1])
                first, held = i + 1, 0
        return out

    def counts_of_group(self, texts: list[str]) -> np.ndarray:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = piece_starts(points, ends)
        at = np.flatnonzero(starts)
        borders = [*at.tolist(), len(points)]
        pieces = map(joined.__getitem__, map(slice, borders, borders[1:]))
        found = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(at))
        found[np.searchsorted(at, ends)] = 0
        total = np.concatenate(([0], np.cumsum(found)))
        upto = total[np.searchsorted(at, ends)]
        return np.diff(np.concatenate(([0], upto)))

    def chunk_map(self, chunk: str) -> tuple[str, str | None, str]:
        """Head, settled middle and tail; the middle is None where no border is certain."""
        borders = [m.start() for m in CERTAIN.finditer(chunk)]
        if not borders:
            return chunk, None, ""
        return chunk[: borders[0]], chunk[borders[0] : borders[-1]], chunk[borders[-1] :]

    def long_text(self, text: str) -> int:
        """Count over chunks: state maps, composed in rounds."""
        parts = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        middles = self.counts([m or "" for _, m, _ in parts]).tolist()
        maps = [(h, None if m is None else c, t) for (h, m, t), c in zip(parts, middles)]
        while len(maps) > 1:
            maps = [self.composed(*maps[i : i + 2]) for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return (count or 0) + int(self.counts([head, tail]).sum())

    def composed(self, left: tuple, right: tuple | None = None) -> tuple:
        if right is None:
            return left
        if left[1] is None:
            return left[0] + right[0], right[1], right[2]
        if right[1] is None:
            return left[0], left[1], left[2] + right[0]
        return left[0], left[1] + right[1] + int(self.counts([left[2] + right[0]])[0]), right[2]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string counts as one token, as by default."""
        out = np.zeros(len(texts), np.int64)
        short, owner = [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if "<" in text else [text]
            out[i] = len(pieces) - 1
            for piece in pieces:
                if len(piece) > CHUNK:
                    out[i] += self.long_text(piece)
                elif piece:
                    short.append(piece)
                    owner.append(i)
        if short:
            np.add.at(out, owner, self.counts(short))
        return out


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the first character of each piece that merges do not cross.

    A piece is a contraction ('s 't 'm 'd 're 've 'll), or letters, numbers or other signs
    with one space before them, or white space. ``ends``: one mark after each text.
    """
    kind = classes()[points]
    kind[ends] = END
    n = len(kind)
    starts = np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # The last blank before a text's next sign goes with it if it is a space, else stands alone.
    after = np.flatnonzero((kind[1:] != BLANK) & (kind[1:] != END) & (kind[:-1] == BLANK)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 32]] = False
    quotes = np.flatnonzero((points == 39) & starts)
    if len(quotes):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        starts[quotes[single] + 1] = starts[quotes[double] + 1] = False
        starts[quotes[single] + 2] = starts[quotes[double] + 3] = True
    return starts


def counter(path: str) -> Counter:
    return held(("token counts", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to each row of ``docs``.

    ``vocabulary`` is a file of the tokenizers library (byte-level BPE) that workers can
    read. A row gives a row: repeated rows and ids are counted alike, a null id stays, a null
    text counts as empty. Only ``doc_id`` and ``text`` are read; other columns are left out.
    """
    small_batches(docs.sparkSession)

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in rows:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens(texts))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = given.mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
