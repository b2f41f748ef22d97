"""Encoding with a public byte-level BPE vocabulary by a lazily determinised transducer.

The merges are not replayed word by word. For byte strings the pair encoding has two properties: the last
token of every prefix is unique, and a sequence of tokens is the encoding exactly when every adjacent pair
is the encoding of its own bytes. So a transducer can read a word byte by byte and keep only the tokens
that a longer word might still change. A state is the committed token (only while a merge across it is
still possible) and the bytes not yet committed; a transition emits every token that all ways to go on
share, which is known after a bounded lookahead. States and transitions are made when first met.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.batches import map_batches

#: fixed value: the published split pattern of the byte-level vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT) -> str:
    """Where a public vocabulary file is: INKWELL_TOKENIZERS, else the installed ``public_tokenizers``."""
    folder = os.environ.get("INKWELL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> bytes:
    """The vocabulary file as bytes (under a few MB), for a broadcast."""
    with open(path, "rb") as f:
        return f.read()


class PairTransducer:
    """The transducer of one vocabulary; ``encode_word`` runs it over one split word."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks = ranks
        self.most_states = most_states
        prefixes = set()
        for t in ranks:
            for i in range(1, len(t) + 1):
                prefixes.add(t[:i])
        self.prefixes = prefixes
        self.longest = max(map(len, ranks))
        self._pair = lru_cache(maxsize=500_000)(self._compatible)
        self._whole = lru_cache(maxsize=200_000)(lambda t: self._merge(t) == [t])
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        self.states: list[tuple[bytes, bytes]] = [(b"", b"")]
        self.moves: list[dict[int, tuple[int, tuple[int, ...] | None]]] = [{}]
        self.finals: list[tuple[int, ...] | None] = [None]

    def _merge(self, word: bytes) -> list[bytes]:
        """The pair encoding by its definition; only for the few strings the compilation asks about."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: bytes, b: bytes) -> bool:
        return self._merge(a + b) == [a, b]

    def _last_tokens(self, committed: bytes, pending: bytes) -> list[bytes | None]:
        """last[j]: the last token of the encoding of what is committed and ``pending[:j]``.

        None where that token starts before the committed end; no way to go on passes there.
        """
        last: list[bytes | None] = [committed]
        for j in range(1, len(pending) + 1):
            for i in range(max(0, j - self.longest), j):
                t = pending[i:j]
                if last[i] is not None and t in self.ranks and self._whole(t) and (not last[i] or self._pair(last[i], t)):
                    last.append(t)
                    break
            else:
                last.append(None)
        return last

    def _matters(self, committed: bytes, pending: bytes) -> bool:
        """Whether some token could still reach from inside ``committed`` over its end."""
        for i in range(len(committed)):
            tail = committed[i:]
            if tail + pending in self.prefixes or any(tail + pending[:k] in self.ranks for k in range(1, len(pending) + 1)):
                return True
        return False

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...] | None]:
        committed, pending = self.states[state]
        pending += bytes([byte])
        if committed and not self._matters(committed, pending):
            committed = b""
        last = self._last_tokens(committed, pending)
        n = len(pending)
        live = [j for j in range(n) if last[j] is not None and pending[j:] in self.prefixes] + [n] * (last[n] is not None)
        chains = []
        for j in live:
            chain = {0}
            while j > 0:
                chain.add(j)
                j -= len(last[j])
            chains.append(chain)
        at = max(set.intersection(*chains))
        emitted: list[int] = []
        j = at
        while j > 0:
            emitted.append(self.ranks[last[j]])
            j -= len(last[j])
        if at:
            committed, pending = last[at], pending[at:]
            if pending and not self._matters(committed, pending):
                committed = b""
        key = (committed, pending)
        to = self.numbers.get(key)
        if to is None:
            if len(self.states) >= self.most_states:
                raise MemoryError  # the caller starts the table afresh
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.finals.append(None)
        move = self.moves[state][byte] = (to, tuple(reversed(emitted)) or None)
        return move

    def _final(self, state: int) -> tuple[int, ...]:
        committed, pending = self.states[state]
        last = self._last_tokens(committed, pending)
        out, j = [], len(pending)
        while j > 0:
            out.append(self.ranks[last[j]])
            j -= len(last[j])
        self.finals[state] = done = tuple(reversed(out))
        return done

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None and self._whole(word):
            return [whole]
        out: list[int] = []
        state, moves = 0, self.moves
        try:
            for byte in word:
                move = moves[state].get(byte)
                if move is None:
                    move = self._step(state, byte)
                state, emitted = move
                if emitted is not None:
                    out += emitted
            done = self.finals[state]
            out += self._final(state) if done is None else done
        except MemoryError:
            self._reset()
            return self.encode_word(word)
        return out


class Encoder:
    """Texts to ids: split, then the transducer, with a bounded memory of words already encoded."""

    def __init__(self, ranks_file: bytes, split: str = SPLIT, most_words: int = 300_000):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks_file.splitlines() if line)}
        self.transducer = PairTransducer(ranks)
        self._split = regex.compile(split)
        self._words: dict[str, list[int]] = {}
        self._most = most_words
        self._bytes = {r: t for t, r in ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; strings that spell one are ordinary. Null: no ids."""
        if not text:
            return []
        words, out, run = self._words, [], self.transducer.encode_word
        for w in self._split.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= self._most:
                    words.clear()
                # unpaired surrogates can't come from stored text; they take the replacement character
                ids = words[w] = run(w.encode("utf-8", "replace"))
            out += ids
        return out

    def bytes_of(self, token: int) -> bytes:
        return self._bytes[token]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; an incremental UTF-8 machine carries characters over token borders."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        parts = [machine.decode(self._bytes[i]) for i in ids]
        return "".join(parts) + machine.decode(b"", final=True)


@cache
def _encoder(ranks_file: bytes) -> Encoder:
    return Encoder(ranks_file)


def _flat(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids) of every row; null and empty texts give an empty list. The file is read once, on the driver."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path or tokenizer_path()))

    def make():
        encode = _encoder(ranks.value).encode

        def convert(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(0), "ids": _flat([encode(t) for t in batch.column(1).to_pylist()])}

        return convert

    return map_batches(df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("__text")), f"{id_col} bigint, ids array<int>", make)


def token_counts(df: DataFrame, keep: list[str], text_col: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and n_tokens of every row; null and empty texts count 0."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path or tokenizer_path()))
    source = df.select(*keep, F.col(text_col).alias("__text"))
    schema = source.drop("__text").schema.add("n_tokens", T.LongType())

    def make():
        encode = _encoder(ranks.value).encode

        def convert(batch: pa.RecordBatch) -> dict:
            at = batch.num_columns - 1
            out = {name: batch.column(i) for i, name in enumerate(keep)}
            return out | {"n_tokens": [len(encode(t)) for t in batch.column(at).to_pylist()]}

        return convert

    return map_batches(source, schema, make)


def decoded(df: DataFrame, id_col: str, path: str | None = None) -> DataFrame:
    """(id, text) from (id, ids): the exact round trip of non-null texts."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path or tokenizer_path()))

    def make():
        decode = _encoder(ranks.value).decode

        def convert(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(0), "text": [decode(x or []) for x in batch.column(1).to_pylist()]}

        return convert

    return map_batches(df.select(id_col, "ids"), f"{id_col} bigint, text string", make)
