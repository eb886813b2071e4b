"""Packing along a space-filling curve.

A document is tokenized; its token counts, hashed to a fixed number of slots,
damped and normalised, are projected to a few dimensions with random signs.  The
quantised coordinates give a Hilbert key.  Documents are range-sorted by that
key and their token streams laid end to end along the curve, so a sequence holds
neighbours.  The place of a document is a distributed prefix sum of lengths.
The stream is cut every ``length`` tokens; its rest is cut at powers of two, so
nothing is padded.

Defined cases: a null or empty text is the end id alone; documents with equal
keys follow by id (nulls first), then row; very long texts are encoded whole and cut
over as many sequences as they fill; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialise, prefix_sums, read_table, small_batches, text_or_empty

SLOTS, DIMS, BITS = 256, 4, 12
#: entries of a generation of a worker's cache of encoded words
CACHE = 150_000


class _Generations:
    """A bounded dictionary: what is not asked for over a generation is dropped."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """Keys (each once) that are not held; those held move to the present generation."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        absent = [k for k in keys if k not in new]
        kept = {k: old[k] for k in absent if k in old}
        new.update(kept)
        return [k for k in absent if k not in kept]


#: kinds of the lower-case characters of Latin-1, by the tokenizer's own rule for words
_MARK, _LETTER, _DIGIT, _SPACE = range(4)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz", *"ªµº".encode("latin-1"), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KINDS[[*"0123456789²³¹¼½¾".encode("latin-1")]] = _DIGIT
_KINDS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where words begin in lower-case Latin-1 text.

    The rule is ``'s|'t|'re|'ve|'m|'ll|'d``, else a run of letters, a digit or a run of marks.
    """
    kinds = _KINDS[raw]
    first = kinds == _DIGIT
    first[1:] |= kinds[1:] != kinds[:-1]
    first[:1] = True
    at = np.flatnonzero(raw == ord("'"))
    at = at[first[at]]  # one after another mark belongs to that run
    next_two = [np.where(at + k < len(raw), raw[np.minimum(at + k, len(raw) - 1)], 0) for k in (1, 2)]
    short = np.isin(next_two[0], [*b"stmd"])
    long = np.isin(next_two[0].astype(np.int64) << 8 | next_two[1], [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
    for some, size in ((short, 2), (long, 3)):
        first[at[some] + 1] = False
        ends = at[some] + size
        first[ends[ends < len(raw)]] = True
    first[kinds == _SPACE] = False
    return first


class WordEncoder:
    """Encoder of whole texts for a lower-casing word tokenizer.

    Texts of Latin-1 characters are cut into words by the tokenizer's own rule, many at a
    time as one array of bytes; each different word is encoded once per generation of a
    bounded cache.  The ids equal those of the whole text because such a tokenizer never
    merges over the end of a word.  Other texts go to the tokenizer as they are.
    """

    #: characters that are cut at a time, beyond a single text
    GROUP = 1 << 22

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # words are in lower case and cut already: for them the model alone, without normaliser and rule
        self.word_tokenizer = Tokenizer(self.tokenizer.model)
        self.word_tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Generations(CACHE)

    def _encode_words(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 128):
            part = words[at : at + 128]
            (found,) = self.word_tokenizer.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not mark the ends of words")
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                self.words.new[word] = data[begin:end]
                begin = end

    def _plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(s in text for s in self.special)

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-case Latin-1 texts."""
        raw = np.frombuffer("\n".join(texts).encode("latin-1"), np.uint8)
        if not len(raw):
            return [np.zeros(0, self.kind) for _ in texts]
        first, held = word_starts(raw), _KINDS[raw] != _SPACE
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        bounds = np.searchsorted(np.flatnonzero(first), begins)  # the words of each text
        letters = raw[held]
        starts = np.append(np.flatnonzero(first[held]), len(letters))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(letters)])
        words = words.dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._encode_words(self.words.missing(keys))
        found = pa.array(map(self.words.new.__getitem__, keys), pa.large_binary()).take(words.indices)
        at = np.frombuffer(found.buffers()[1], np.int64)[bounds + found.offset] // self.kind.itemsize
        data = np.frombuffer(found.buffers()[2] or b"", self.kind)
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if not self._plain(text):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
                continue
            group.append(k)
            size += len(text)
            if size >= self.GROUP:
                self._fill(out, texts, group)
                group, size = [], 0
        self._fill(out, texts, group)
        return out

    def _fill(self, out: list, texts: list[str], group: list[int]) -> None:
        for k, ids in zip(group, self._encode_plain([texts[k].lower() for k in group]), strict=True):
            out[k] = ids


class TextEncoder:
    """Encoder of whole texts for any other tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for t in texts]


#: the settings of a tokenizer whose words :class:`WordEncoder` cuts by itself
_CUTS_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}


def cuts_words(path: str) -> bool:
    """Whether the tokenizer of a file lower-cases, cuts words and marks their ends as :class:`WordEncoder` needs it."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {k: v for k, v in parts[0].items() if k != "type"}
    return (
        settings.get("normalizer") == _CUTS_WORDS["normalizer"]
        and split == {"pattern": {"Regex": _CUTS_WORDS["split"]}, "behavior": "Removed", "invert": True}
        and len(parts) == 2 and parts[1].get("type") == "ByteLevel" and parts[1].get("add_prefix_space") is False
        and settings["model"].get("end_of_word_suffix") == _CUTS_WORDS["suffix"]
    )


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder | TextEncoder:
    """The fast encoder where the file's settings allow it, the tokenizer itself elsewhere."""
    return WordEncoder(path) if cuts_words(path) else TextEncoder(path)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(11).choice([-1.0, 1.0], (SLOTS, DIMS))


def coordinates(ids: np.ndarray) -> np.ndarray:
    """Cell of a document on the grid of ``2 ** BITS`` steps a dimension."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    counts = np.log1p(np.bincount(hashed, minlength=SLOTS))
    norm = np.linalg.norm(counts)
    spot = counts @ _signs() / norm if norm else np.zeros(DIMS)
    return np.clip((np.arctan(spot) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenize(path: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = encode(part.column(2).to_numpy(zero_copy_only=False).tolist())
                cells = [coordinates(x) for x in got]
                width = np.full(len(got), got[0].dtype.itemsize, np.int32)
                sizes = np.array([len(x) for x in got], np.int64) + 1
                end = got[0].dtype.type(end_id).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hilbert_keys(np.array(cells))), pa.array(sizes), pa.array(width),
                     pa.array([x.tobytes() + end for x in got], pa.binary())],
                    names=["row", "id", "key", "n", "width", "ids"],
                )
            part = got = cells = None
            give_back()

    return work


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the sequences after the last full one begin, and where the last ends."""
    at = total - total % length
    cuts = [at]
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return cuts


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
        del whole
        give_back()


def _cut(length: int, total: int, with_ids: bool):
    tail = tail_cuts(total, length)
    full = tail[0] // length

    def place(at: int) -> tuple[int, int, int]:
        """Sequence of a position of the stream, its begin and its end."""
        if at < tail[0]:
            s = at // length
            return s, s * length, (s + 1) * length
        k = int(np.searchsorted(tail, at, side="right")) - 1
        return full + k, tail[k], tail[k + 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_encoder.cache_clear()  # the same workers have encoded; their words would stay beside the pieces
        give_back()
        for batch in _slices(batches, 256):
            columns = (batch.column(c).to_pylist() for c in ("id", "key", "n", "width", "at"))
            data = batch.column("ids")
            rows = []
            for k, (i, key, n, width, at) in enumerate(zip(*columns, strict=True)):
                buffer = data[k].as_buffer()
                ids = np.frombuffer(buffer, "<u2" if width == 2 else "<u4").astype("<u4")
                start = 0
                while start < n:
                    s, begin, end = place(at + start)
                    size = min(n - start, end - at - start)
                    piece = ids[start : start + size]
                    row = (i, start, size, zlib.crc32(piece), n, s, at + start - begin, key)
                    rows.append((*row, piece.tobytes()) if with_ids else row)
                    start += size
            if rows:
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key", "ids"]
                names, kinds = names[: len(rows[0])], ([pa.int64()] * 8 + [pa.binary()])[: len(rows[0])]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return work


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents and their places in sequences.

    ``tokenizer`` is the path of a tokenizer file on every machine.  ``ids`` holds
    the piece's ids as little-endian unsigned 32-bit numbers; without ``with_ids``
    only their check sum comes back.
    """
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")
    )
    schema = "row long, id long, key long, n long, width int, ids binary"
    with small_batches(docs.sparkSession):
        tokens = materialise(slim.mapInArrow(_tokenize(tokenizer, end_id), schema), "tokens")
    order = prefix_sums(tokens.select("row", "id", "key", "n"), ["key", "id", "row"], "n", "at", merge=True)
    total = tokens.agg(F.sum("n").alias("n")).first()["n"] or 0
    # hashing the slim side leaves the ids unsorted; a sort would hold them in the executors' memory
    placed = tokens.join(order.select("row", "at").hint("shuffle_hash"), "row")
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"
    placed = placed.select("id", "key", "n", "width", "at", "ids")
    return placed.mapInArrow(_cut(length, total, with_ids), schema + (", ids binary" if with_ids else ""))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return pack_documents(read_table(spark, sf_dir, "documents"), path, with_ids=False).withColumnRenamed("id", "doc_id")
