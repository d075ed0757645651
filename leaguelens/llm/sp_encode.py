"""Sub-word encoding with a public BPE piece model, by the merge-type prefix table.

For every prefix of a text the last token of its encoding is unique.  The table stores
that token per prefix: an automaton lists the pieces that end at a position, and the one
that may follow the last token of the prefix before it (a pair-compatibility test) is
kept.  Reading the table backwards gives the ids.  The work is linear in the text.

No piece holds a space mark after another character, and characters outside the
vocabulary never merge, so a text falls apart at those places; the chunks between them
are encoded once per worker and remembered in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks remembered per worker, and the longest chunk that is remembered.
CACHE_CHUNKS, CACHE_CHARS = 500_000, 64


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[key] = found
        return found


class PieceEncoder:
    """Encoder and decoder for a piece model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.out: list[bytes] = [b""] * size
        self.piece: list[str] = [""] * size
        machine = ahocorasick.Automaton()
        for i in range(size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                self.out[i] = bytes([int(text[3:5], 16)])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                if SPACE in text.lstrip(SPACE):
                    raise ValueError("a piece crosses a space mark")
                self.piece[i] = text
                self.id[text] = i
                self.score[text] = sp.get_score(i)
                self.out[i] = text.replace(SPACE, " ").encode()
                machine.add_word(text, (len(text), i))
        machine.make_automaton()
        self.machine = machine
        self.follows: dict[int, bool] = {}
        self.ids_of = _Cache(self._chunk_bytes)
        self.text_of = _Cache(self._chunk_text)
        self._split = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")

    def merge(self, text: str) -> list[str]:
        """The pieces left by merging the best adjacent pair, leftmost first, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        """Whether ``token`` directly after ``last`` (-1: nothing) survives merging."""
        key = (last + 1) * 65536 + token
        found = self.follows.get(key)
        if found is None:
            b = self.piece[token]
            found = self.merge(b) == [b] if last < 0 else self.merge(self.piece[last] + b) == [self.piece[last], b]
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[key] = found
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk, space marks included, by the prefix table."""
        n = len(chunk)
        last, size, follows = [-2] * (n + 1), [0] * (n + 1), self.follows
        last[0] = -1
        for end, (length, token) in self.machine.iter(chunk):
            end += 1
            if last[end] == -2:
                start = end - length
                before = last[start]
                if before == -2:
                    self._gap(chunk, last, start)
                    before = last[start]
                    if before == -2:
                        continue
                ok = follows.get((before + 1) * 65536 + token)
                if ok or (ok is None and self.may_follow(before, token)):
                    last[end], size[end] = token, length
        out: list[int] = []
        while n:
            if size[n]:
                out.append(last[n])
                n -= size[n]
            else:
                n -= 1
                out += [self.byte_id[b] for b in reversed(chunk[n].encode("utf-8", "surrogatepass"))]
        return out[::-1]

    def _gap(self, chunk: str, last: list[int], end: int) -> None:
        """Characters outside the vocabulary before ``end`` start anew: nothing merges with them."""
        while end and last[end] == -2 and chunk[end - 1] not in self.id:
            last[end] = -1
            end -= 1

    def _key_ids(self, key: str) -> list[int]:
        return self.chunk_ids(key if key[:1] == "\n" else SPACE + key)

    def _chunk_bytes(self, key: str) -> bytes:
        return pack(f"<{len(ids := self._key_ids(key))}I", *ids)

    def _chunk_text(self, key: str) -> bytes:
        return self.decode_bytes(memoryview(self.ids_of[key]).cast("I"))

    def keys(self, text: str) -> list[str]:
        """Chunks of a text; the dummy prefix and a chunk's first space mark are left out."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text or " \n" in text:
            found = self._split.findall(SPACE + text.replace(" ", SPACE))
            return [k if k[0] == "\n" else k[1:] for k in found]
        return text.replace("\n", " \n").split(" ")

    def encode_bytes(self, keys: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids, begin and end ids included."""
        return b"".join([self.bos.to_bytes(4, "little"), *map(self.ids_of.__getitem__, keys), self.eos.to_bytes(4, "little")])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(self.keys(text)), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.out[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self._finish(self.decode_bytes(ids))

    @staticmethod
    def _finish(raw: bytes) -> str:
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")

    def decoded(self, keys: list[str]) -> str:
        """The decoded text of chunks, each decoded from its ids."""
        return self._finish(b"".join(map(self.text_of.__getitem__, keys)))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """One encoder per worker process and model."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = PieceEncoder(model_path)
    return _ENCODERS[model_path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, with ``full``, ids
    (array<int>) and decoded.  ``model_path`` must be readable on every executor (None:
    the installed public model).  A null or empty text gives the begin and end ids
    alone.  Other columns of ``docs`` are ignored, repeated rows give repeated rows, null ids stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_path or default_model())
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["k"], pdf["t"]):
                keys = enc.keys(text or "")
                raw, back = enc.encode_bytes(keys), enc.decoded(keys)
                row = [key, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                rows.append([*row, np.frombuffer(raw, "<i4"), back] if full else row)
            yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)[id_col]
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    schema = "k string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    # ids travel as text, as pandas would turn longs with nulls into floats
    done = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, schema)
    return done.select(F.col("k").cast(kind).alias(id_col), *names[1:])
