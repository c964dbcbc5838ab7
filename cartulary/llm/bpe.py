"""BPE encoding and decoding with word ends, by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. Each round finds
the rank of every neighbouring pair by binary search over the sorted pair keys,
takes each word's lowest, merges it at all its places and drops the words that
have no pair left. Words that were seen keep their ids in a bounded cache, so a
batch costs merge rounds only for its new words.

Defined cases: null and empty texts have no ids; decoding no ids gives an empty
text; the strings of special tokens inside a text give the special ids, as in
the tokenizers library; ids outside the vocabulary are dropped by decode.
Very long words only take more rounds. Extra columns stay untouched.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.batches import as_lists, bound_batches, pieces, texts_of
from cartulary.session import ship

#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 500_000
#: Texts of these characters only are split here; in them NFC changes nothing and lower case is one to one.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with an end-of-word suffix, from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.cache: dict[str, bytes] = {t: np.int32(i).tobytes() for t, i in self.special.items()}

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own, which no other word can equal."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return SPLIT.findall(text.lower())
        out, start = [], 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            out += self.split_part(text[start : m.start()])
            out.append(m[0])
            start = m.end()
        return out + self.split_part(text[start:])

    def split_part(self, text: str) -> list[str]:
        if not text:
            return []
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in t).decode() for t, _ in found if t]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as packed int32."""
        raw = [w.encode() for w in words]
        lens = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.inner[flat], np.repeat(np.arange(len(raw)), lens)
        ends = np.cumsum(lens) - 1
        sym[ends] = self.final[flat[ends]]
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            best = np.repeat(best, size)
            live = best < np.iinfo(np.int64).max
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            chosen = live & (rank == best)
            if chosen.any():
                place = np.arange(len(sym))
                run = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), place, 0))
                chosen &= (place - run) % 2 == 0  # of overlapping places, as in aaa, the first wins
                spots = np.flatnonzero(chosen)
                sym = sym.copy()
                sym[spots] = self.made[at[spots]]
                live[spots + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, counts = sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))
        packed, cuts = sym.tobytes(), np.append(0, np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as packed int32."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {t: np.int32(i).tobytes() for t, i in self.special.items()}
        new = list(set().union(*split) - self.cache.keys())
        if new:
            self.cache.update(zip(new, self.merge(new), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    gc.disable()  # millions of small objects without cycles
    return Bpe(path)


@lru_cache(maxsize=4)
def token_table(path: str) -> np.ndarray:
    """The tokens by id, None where there is none; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    found = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([found.get(i) for i in range(max(found) + 1)], object)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with a column of token ids, array<int>, and, if named, one of the text that these ids decode to.

    Columns of those names are replaced; keep_text=False leaves the text out. Decoding in the same pass saves a second set of workers.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in (ids, decoded) and (keep_text or f.name != text)]
    names = [f.name for f in keep]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        table = token_table(tokenizer_path) if decoded else None
        for whole in batches:
            for batch in pieces(whole, text):
                packed = bpe.encode(texts_of(batch, text))
                flat = np.frombuffer(b"".join(packed), np.int32)
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                columns = [batch.column(n) for n in names] + [as_lists(flat, counts, pa.int32())]
                if decoded:
                    columns.append(pa.array([join(table, np.frombuffer(p, np.int32)) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *[f.name for f in made]])

    read = df.select(*[f"`{n}`" for n in dict.fromkeys([*names, text])])
    return read.mapInArrow(run, T.StructType([*keep, *made]))


def join(table: np.ndarray, ids: np.ndarray) -> str:
    """The tokens of ids joined by spaces; ids that have none are left out."""
    ids = ids[(ids >= 0) & (ids < len(table))]
    return " ".join([t for t in table[ids].tolist() if t is not None])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != decoded]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(tokenizer_path)
        for batch in batches:
            out = []
            column = batch.column(ids)
            for i in range(len(column)):
                got = column[i].values
                out.append(join(table, got.to_numpy(zero_copy_only=False)) if got is not None else "")
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.string())], [*names, decoded])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, T.StructType([*keep, T.StructField(decoded, T.StringType())]))
