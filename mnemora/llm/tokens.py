"""Token ids of public tokenizers inside tasks; the vocabulary file's path is a parameter."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

# The White_Space characters, and a string that the vocabulary holds as one token.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPECIAL = "<|endoftext|>"

# Splits before a word's leading space and around white space, which the vocabulary's own splitting
# does as well: each chunk can be encoded by itself.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# Bytes that the cached chunks of one worker may take, and the longest chunk that is kept between batches.
CACHE_BYTES, CACHED_LENGTH = 24 * 1024 * 1024, 64
# Texts that are encoded together: a chunk that several of them hold is looked up once. Their chunks take many times
# their bytes in a worker, so both are bounded.
TEXTS, TEXT_BYTES = 512, 1024 * 1024
# What a chunk takes besides its characters and ids: two offsets, and its place in the table of a lookup.
ENTRY_BYTES = 40
# A chunk without a leading blank is kept under this mark; other chunks are kept without their blank.
BARE = "\0"
# White space other than blanks and line feeds, and the mark.
OTHER_SPACES = "\t\v-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space that is not split into single characters needs the pattern.
GROUPED = rf"[{OTHER_SPACES}\x00]|  | \n|\n |\n\n\n|\n\n\z"
# Chunks that are encoded together, a line feed between each two.
TOGETHER = 256
# A vocabulary without such a token merges nothing across a line feed that stands between a word and a blank.
ACROSS = re.compile("[^\u010a]\u010a|\u010a\u0120")
# Letters that have had their class since Unicode 6, below U+0250.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-\u024f"
# Letters only, which the vocabulary's own splitting leaves in one.
WORD = rf"\A[{LATIN}]+\z"
# Signs at a word's end, after a letter or digit: the vocabulary's own splitting parts them there, so a word is encoded
# once whatever stands after it.
SIGNS = r"!-&(-/:-@\[-`{-~"
END = rf"([0-9{LATIN}])([{SIGNS}]+)( |\z)"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``TEXTS`` rows whose texts take ``TEXT_BYTES``; a longer text is a slice by itself.

    What a slice took goes back before the next one, so a worker that waits holds little.
    """
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
    at = 0
    while at < len(batch):
        room = (ends[at - 1] if at else 0) + TEXT_BYTES
        end = min(at + TEXTS, max(at + 1, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def chunk_keys(text: str) -> list[str]:
    """Keys of a text's chunks, in order."""
    return [
        c[1:] if c[0] == " " and not c.isspace() and c[1] != BARE else c if c == "\n" else BARE + c for c in CHUNK.findall(text)
    ]


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == BARE else key if key == "\n" else " " + key


def chunked(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Keys of the chunks of all texts, each distinct key once, and where the keys of each text start and end.

    Texts whose white space is single blanks and line feeds are split in Arrow columns, and signs at a word's end are a
    chunk by themselves there; others are split by the pattern.
    """
    grouped = pc.match_substring_regex(texts, GROUPED)
    fed = pc.replace_substring(texts.filter(pc.invert(grouped)), "\n", f" \n {BARE}")
    signed = pc.replace_substring_regex(fed, END, rf"\1 {BARE}\2\3")
    single = pc.split_pattern(pc.binary_join_element_wise(BARE, signed, ""), " ")
    rows = [chunk_keys(t) for t in texts.filter(grouped).to_pylist()]
    keys = pa.concat_arrays([single.flatten(), pa.array([k for row in rows for k in row], pa.string())])
    sizes = np.concatenate([np.diff(np.asarray(single.offsets)), np.array([len(row) for row in rows], np.int64)])
    # The texts in the order of their keys.
    order = np.argsort(np.asarray(grouped), kind="stable")
    starts, ends = np.empty((2, len(texts)), np.int64)
    ends[order] = np.cumsum(sizes)
    starts[order] = ends[order] - sizes
    return keys.dictionary_encode(), starts, ends


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of an array of ids as binary values; ``ends`` counts ids."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


class Encoder:
    """Ids of texts, with the ids of frequent chunks kept between texts.

    The cache takes chunks that a batch holds more than once, until its bytes are used up; it saves time and changes no
    result. Chunks and their ids stay in Arrow columns.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # Ids of a vocabulary up to 65,536 entries fit two bytes.
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        # Splitting by the vocabulary's pattern, and the same for texts of words with line feeds between them: not split
        # at all if no merge can cross a line feed there, which spares the library most of its work on a word.
        self.pattern = self.tokenizer.pre_tokenizer
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        split = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), level])
        self.feeds = split if any(map(ACROSS.search, self.tokenizer.get_vocab())) else level
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.bytes = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each worker and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @property
    def cache(self) -> dict[str, bytes]:
        """The kept chunks and their ids."""
        return dict(zip(self.known.to_pylist(), self.known_ids.to_pylist(), strict=True))

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _spaced(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks without their leading blank that hold no other white space, many in one text.

        The line feed between two chunks is a token by itself: it is split off, or no merge can cross it.
        """
        cuts = pa.array([*range(0, len(chunks), TOGETHER), len(chunks)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, chunks), "\n ").to_pylist() if len(chunks) else []
        found = self.tokenizer.encode_batch_fast([" " + x for x in joined], add_special_tokens=False)
        ids = np.concatenate([np.array([*x.ids, self.feed], self.dtype) for x in found] or [np.array([], self.dtype)])
        feeds = ids == self.feed
        return _binaries(ids[~feeds], np.flatnonzero(feeds) - np.arange(len(chunks)))

    def _encoded(self, keys: pa.Array) -> pa.Array:
        """Ids of chunks by key: after ``BARE`` the chunk as it is, a line feed, else the chunk without its blank."""
        word = pc.match_substring_regex(keys, WORD)
        raw = pc.or_(pc.is_in(keys, pa.array(["", "\n"])), pc.starts_with(keys, BARE))
        mixed = pc.invert(pc.or_(word, raw))
        self.tokenizer.pre_tokenizer = self.feeds
        try:
            words = self._spaced(keys.filter(word))
        finally:
            self.tokenizer.pre_tokenizer = self.pattern
        other = pa.array(self._raw([chunk_of(k) for k in keys.filter(raw).to_pylist()]), pa.large_binary())
        places = np.concatenate([np.flatnonzero(np.asarray(x)) for x in (word, mixed, raw)])
        return pa.concat_arrays([words, self._spaced(keys.filter(mixed)), other]).take(pa.array(np.argsort(places)))

    def _keep(self, keys: pa.Array, ids: pa.Array) -> None:
        """Take the first of these chunks into the cache, as far as its bytes go."""
        sizes = pc.add(pc.binary_length(keys).cast(pa.int64()), pc.binary_length(ids))
        total = self.bytes + np.cumsum(np.asarray(sizes) + ENTRY_BYTES)
        n = int(np.searchsorted(total, CACHE_BYTES, "right"))
        if n:
            self.known = pa.concat_arrays([self.known, keys[:n]])
            self.known_ids = pa.concat_arrays([self.known_ids, ids[:n]])
            self.bytes = int(total[n - 1])

    def _ids(self, keys: pa.Array, counts: np.ndarray) -> pa.Array:
        """Ids of distinct keys; keys that are counted more than once go to the cache."""
        place = pc.index_in(keys, self.known)
        missing = np.asarray(place.is_null())
        new = keys.filter(pa.array(missing))
        found = self._encoded(new)
        at = np.array(place.fill_null(0), np.int64)
        at[missing] = len(self.known) + np.arange(len(new))
        out = pa.concat_arrays([self.known_ids, found]).take(pa.array(at))
        kept = pa.array((counts[missing] > 1) & (np.asarray(pc.utf8_length(new)) <= CACHED_LENGTH))
        self._keep(new.filter(kept), found.filter(kept))
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``; the texts hold no null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        special = pc.match_substring(texts, SPECIAL)
        keys, starts, ends = chunked(pc.if_else(special, "", texts))
        counts = np.bincount(np.asarray(keys.indices), minlength=len(keys.dictionary))
        ids = self._ids(keys.dictionary, counts).take(keys.indices)
        # Where the ids of each chunk start, and of the last one end.
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        raw = memoryview(ids.buffers()[2] or b"")
        out = [bytes(raw[a:b]) for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True)]
        whole = np.flatnonzero(np.asarray(special)).tolist()
        for i, found in zip(whole, self._raw([texts[i].as_py() for i in whole]), strict=True):
            out[i] = found
        return out
