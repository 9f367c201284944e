"""Ids of a lower-casing, word-wise BPE vocabulary, with words remembered.

White space is dropped and never crossed, so a text's ids are those of its words one after the
other. Each distinct word of a batch is looked up once. New ones are encoded together: every
pre-token gets a closing NUL byte that stands for the end-of-word mark, and the vocabulary's
merges are applied to the bytes of the distinct ones.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from footfall.llm.common import held

MOST_WORDS = 500_000
# New words that are looked through at once for any that needs the library.
TOGETHER = 1_000
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
# Letters on which all Unicode versions agree; words with others go through the library.
SETTLED = r"[\x01-\u0377\u0390-\u0527\u05d0-\u05ea\u0620-\u065e\u1e00-\u1ef9\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
# What PIECE tells apart in ASCII without apostrophes: white space, letters, numerals, the rest.
KINDS = np.full(128, 3, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]], KINDS[97:123], KINDS[48:58] = 0, 1, 2


def pieces(text: bytes) -> bytes:
    """Lower-cased ASCII words without apostrophes, each pre-token with a NUL byte after it."""
    letters = np.frombuffer(text, np.uint8)
    kind = KINDS[letters]
    ends = (kind == 2) | (kind != np.append(kind[1:], np.uint8(0)))
    return np.insert(letters, np.flatnonzero(ends & (kind > 0)) + 1, 0).tobytes()


def numbered(values: pa.Array) -> tuple[list[bytes], pa.Array]:
    """The distinct values of a binary array, and which of them each value is."""
    coded = values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices


def joined(values: pa.Array, cuts: np.ndarray) -> list[bytes]:
    """What lies between neighbouring cuts of a binary array, put together."""
    _, starts, data = values.buffers()
    starts = np.frombuffer(starts, np.int32)[cuts]
    parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(starts), data])
    return parts.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    """``encode(texts)``: the ids of each text (UTF-8 bytes) as 16-bit numbers, little-endian."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from footfall.llm.token_counts import byte_letters

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        known = {t["content"] for t in spec["added_tokens"]}
        ranks, ends = {}, []
        for token, number in spec["model"]["vocab"].items():
            if token in known:
                continue
            closed = token.endswith(end)
            ranks[bytes(letters[c] for c in token.removesuffix(end)) + b"\0" * closed] = number
            if closed:
                ends.append(number)
        self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.closes[ends] = True
        if len(self.closes) > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00\s]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.piece, self.settled = regex.compile(PIECE), regex.compile(SETTLED)
        # Words met in several batches, and those met in one so far.
        self.words: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}

    def settles(self, words: list[bytes]) -> bool:
        """Whether none of these words needs the library."""
        text = b"\n".join(words)
        fixed = b"\0" not in text and not (b"<" in text and any(s in text for s in self.special))
        return fixed and (text.isascii() or bool(self.settled.fullmatch(text.decode("utf-8"))))

    def learn(self, words: list[bytes]) -> list[bytes]:
        given = pa.array(words, pa.binary()).view(pa.string())
        simple = pc.string_is_ascii(given).to_numpy(zero_copy_only=False)
        for sign in ("\0", "<", "'"):
            simple &= ~pc.match_substring(given, sign).to_numpy(zero_copy_only=False)
        simple, rest = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        others, odd = [], []
        for start in range(0, len(rest), TOGETHER):
            part = rest[start : start + TOGETHER]
            if self.settles([words[k] for k in part]):
                others += part
            else:
                for k in part:
                    (others if self.settles([words[k]]) else odd).append(k)
        learnt = [b""] * len(words)
        whole = self.whole.encode_batch([words[k].decode("utf-8") for k in odd], add_special_tokens=False)
        for k, found in zip(odd, whole):
            learnt[k] = np.array(found.ids, np.uint16).tobytes()
        for k, found in zip(simple, self.merged(pieces(b"\n".join([words[k] for k in simple]).lower()))):
            learnt[k] = found
        text = unicodedata.normalize("NFC", b"\n".join([words[k] for k in others]).decode("utf-8"))
        # Lower case letter by letter: no final sigma.
        text = self.piece.sub("\\g<0>\0", text.replace("Σ", "σ").lower())
        for k, found in zip(others, self.merged(text.encode("utf-8"))):
            learnt[k] = found
        return learnt

    def merged(self, text: bytes) -> list[bytes]:
        """The ids of each line of pre-tokens."""
        letters = np.frombuffer(text + b"\n", np.uint8)
        at = np.concatenate(([0], np.cumsum(letters == 0)[letters == 10]))
        letters = letters[letters != 10]
        ends = np.concatenate(([0], np.flatnonzero(letters == 0) + 1)).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        distinct, which = numbered(own)
        ids = self.merge.encode_to_numpy(b"".join(distinct).decode("utf-8")).astype(np.uint16)
        ends = (np.concatenate(([0], np.flatnonzero(self.closes[ids]) + 1)) * 2).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        return joined(found.take(which), at)

    def looked_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these words, which are all different."""
        ids = list(map(self.words.get, words))
        gaps = [k for k, x in enumerate(ids) if x is None]
        rare = [words[k] for k in gaps]
        # Words met in a second batch join those that are looked up first, which stay few.
        seen = list(map(self.once.get, rare))
        here = {w: x for w, x in zip(rare, seen) if x is not None}
        if len(self.words) + len(here) > MOST_WORDS // 2:
            self.words.clear()
        self.words.update(here)
        new = [w for w, x in zip(rare, seen) if x is None]
        learnt = self.learn(new)
        if len(self.once) + len(new) > MOST_WORDS // 2:
            self.once.clear()
        self.once.update(zip(new, learnt))
        fresh = iter(learnt)
        for k, x in zip(gaps, seen):
            ids[k] = next(fresh) if x is None else x
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        distinct, which = numbered(split.flatten().view(pa.binary()))
        return joined(pa.array(self.looked_up(distinct), pa.binary()).take(which), split.offsets.to_numpy())


def word_tokens(path: str) -> WordTokens:
    return held(("word tokens", path), lambda: WordTokens(path))
