"""Packing of token sequences by best-fit decreasing.

Overlong documents are cut into full windows first; the rest of each is an item.
Items are taken by decreasing length, each into the open window with the least room
that still holds it, found by a segment tree indexed by remaining capacity. Items are
dealt to groups of bounded size by a hash, so no task sees more than one group.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sentspark.llm.kernels import slices, small_batches
from sentspark.llm.scratch import keep, scratch

LENGTH = 2048
GROUP_ITEMS = 8192      # expected items per group; more groups lose a little room each
CACHED_WORDS = 150_000  # words and units of a generation; a worker remembers two
CALL_UNITS = 2048       # units that a call of the tokenizer's model takes

_encoders: dict[str, WordEncoder] = {}


def _plain(text: str) -> bool:
    """Latin-1 without white space other than ASCII, and no special token."""
    if "<|" in text or "\x85" in text or "\xa0" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Token ids of whole texts, for a tokenizer that lower-cases, drops white space and
    never looks across it: texts are cut at ASCII white space and the ids of words are
    remembered. Latin-1 words are cut into letters, digits and signs as the tokenizer
    does it and go to its model directly; all others go through the whole tokenizer.
    The new words of several texts are learned together, many units a call of the model.
    Memory has two generations: what isn't used while one fills is forgotten."""

    _cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^0-9a-z²³¹¼½¾ªµºß-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)    # the model alone, on units between spaces
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, bool)     # tokens that end a unit
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}     # ids of words and units
        self.older: dict[bytes, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.signs = "".join(signs[b] if b != 32 else " " for b in range(256))      # no unit holds a space

    def _units(self, units: list[bytes]) -> list[bytes]:
        """The model's ids of each unit."""
        text = codecs.charmap_decode(b" ".join(units), "strict", self.signs)[0]
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(units):     # a model that doesn't mark where a unit ends
            return [np.array([t.id for t in self.tokenizer.model.tokenize(u)], "<u4").tobytes() for u in text.split(" ")]
        data, bounds = ids.tobytes(), [0, *(4 * last).tolist()]
        return [data[i:j] for i, j in itertools.pairwise(bounds)]

    def _recall(self, keys: set[bytes]) -> list[bytes]:
        """Those of the keys that neither generation holds; the others are in this one then."""
        lost = keys.difference(self.words)
        for key in lost:
            if key in self.older:
                self.words[key] = self.older[key]
        return list(lost.difference(self.older))

    def _learn(self, words: list[bytes]) -> None:
        """Remembers words that neither generation holds."""
        text = b" ".join(words).decode()
        if not _plain(text):
            for word in (w for w in words if not _plain(w.decode())):
                self.words[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            words = [w for w in words if _plain(w.decode())]
            text = b" ".join(words).decode()
        if words:
            lower = text.lower()
            alone = lower == text       # a word of small letters is a unit itself
            units, cuts = set(), {}
            for word, low in zip(words, lower.split(" ")):
                if alone and low.isalpha():
                    units.add(word)
                else:
                    cuts[word] = [u.encode() for u in self._cut.findall(low)]
            units.update(self._recall(set(itertools.chain.from_iterable(cuts.values()))))
            for some in itertools.batched(units, CALL_UNITS):
                self.words.update(zip(some, self._units(some)))
            for word, cut in cuts.items():
                self.words[word] = b"".join(map(self.words.__getitem__, cut))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        split = pc.ascii_split_whitespace(pa.array([text.lower() if _plain(text) else text for text in texts], pa.string()))
        found = split.values.dictionary_encode()    # Python sees each different word once
        words = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, words))
        if None in known:
            self._learn(self._recall({w for w, ids in zip(words, known) if ids is None}))
            known = [self.words[w] if ids is None else ids for w, ids in zip(words, known)]
        ids = pa.array(known, pa.large_binary()).take(found.indices)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> WordEncoder:
    """One per worker process, whose task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(batches, path: str, end_id: int, length: int):
    """The pieces of each document: full windows, then the rest."""
    ending = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    for batch in small_batches(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
        for first, last, _, _ in slices(texts):
            out = []
            for doc, tokens in zip(ids[first:last], encoder(path).encode_all(texts[first:last].to_pylist())):
                tokens += ending
                total = len(tokens) // 4
                for start in range(0, total, length):
                    piece = tokens[4 * start:4 * (start + length)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.binary()])], names=names)


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and ids (binary, little-endian
    unsigned 32-bit) of every piece. A NULL or empty text is its end token alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_pieces, path=path, end_id=end_id, length=length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class CapacityTree:
    """Open windows by remaining capacity; ``fit`` finds the least capacity >= need."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.leaves)         # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.used[node] += 1
            node >>= 1

    def fit(self, need: int) -> tuple[int, int] | None:
        """Takes out and returns (room, window), or None."""
        node = need + self.leaves
        if not self.used[node]:
            while node > 1 and (node & 1 or not self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.used[node]:
                    node += 1
        room = node - self.leaves
        while node:
            self.used[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Window number and offset of each item; ``lengths`` must be decreasing."""
    tree, windows, offsets, opened = CapacityTree(length), [], [], 0
    for need in lengths:
        found = tree.fit(need)
        if found is None:
            found, opened = (length, opened), opened + 1
        room, window = found
        windows.append(window)
        offsets.append(length - room)
        if room > need:
            tree.add(room - need, window)
    return windows, offsets


def _pack(items: pd.DataFrame, length: int) -> pd.DataFrame:
    items = items.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
    windows, offsets = best_fit(items["length"].tolist(), length)
    items["sequence_id"] = items["bin"].astype("int64") * (1 << 32) + np.array(windows, np.int64)
    items["offset"] = np.array(offsets, np.int64)
    return items[["piece", "sequence_id", "offset"]]


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Sequences hold at most ``length`` tokens; offsets in one have no gaps.

    Texts don't move: pieces are stored as numbers where their text was read, and only
    (piece number, length) of the rests is shuffled. A full window is a sequence of
    its own. NULL or empty text: one piece, the end token. NULL doc_id is handed on;
    repeated rows are packed each. No rows in, no rows out. Other columns are ignored.
    """
    with scratch(docs.sparkSession, "packing") as tmp:
        found = token_pieces(docs, path, end_id, length).drop("ids")
        # The number is stored beside the piece, so it can't change from pass to pass.
        stored = tmp.table(found.withColumn("piece", F.monotonically_increasing_id()))
        items = stored.where(F.col("length") < length)
        bins = max(1, -(-items.count() // GROUP_ITEMS))
        packed = (
            items.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(bins)).alias("bin"))
            .groupBy("bin").applyInPandas(partial(_pack, length=length), "piece long, sequence_id long, offset long")
        )
        full = F.lit(bins).cast("long") * F.lit(1 << 32) + F.col("piece")
        return keep(
            stored.join(packed, "piece", "left")
            .withColumn("sequence_id", F.coalesce("sequence_id", full)).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
            .drop("piece")
        )
