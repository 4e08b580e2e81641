"""Byte-level BPE by a fold over ranked merges in Spark functions.

A token is written as one character, ``FIRST`` + its rank, so a word's pieces are a string and the order of
characters is the order of ranks. The rank map is a literal: for each pair of tokens the token they
merge to, written into short strings that are sent to a task once. Words that whole corpora share are folded once; other words are folded where they stand.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import let, saved
from mnemora.llm.tokens import SPACES as _SPACES
from mnemora.llm.tokens import WORD, chunk_of, chunked

FIRST = 0x800  # 50,256 ranks from here stay below the surrogates
NONE = "\uffff"  # no merge; also the place of a word that is folded later
BUCKETS = 32_768
# Marks at a word's ends and around a value; neither is a token or a byte.
EDGE, VALUE = "\ue000", "\ue001"
# Frequent words folded once and sent to all tasks; other words are folded in place.
SHARED_WORDS = 400_000
# Longer words are merged by a heap, since a fold copies its state in each step.
FOLDED_BYTES = 256
# Texts that are split together: each of their distinct chunks is looked at once.
TEXTS = 512
# Counted words that a task holds before it hands them on, and rows that go in one batch then.
FLUSH_WORDS, FLUSHED_ROWS = 500_000, 100_000


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _char(rank: int) -> str:
    return chr(FIRST + rank)


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _bucketed(entries: dict[str, str]) -> Column:
    """An array of strings that hold key and value of some entries each, by checksum of the key.

    Each value stands between two marks behind its key, and ``NONE`` so at the start of a string.
    """
    rows = [[VALUE + NONE + VALUE] for _ in range(BUCKETS)]
    for key, value in entries.items():
        rows[zlib.crc32(key.encode()) % BUCKETS].append(key + VALUE + value + VALUE)
    return F.from_json(F.lit(json.dumps(["".join(r) for r in rows])), "array<string>")


class Fold:
    """The literals of one vocabulary, and the fold as a Column expression."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = _bucketed(
            {
                _char(ranks[t[:i]]) + _char(ranks[t[i:]]): _char(r)
                for t, r in ranks.items()
                for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks
            }
        )
        self.tokens = _bucketed({EDGE + t.decode("latin-1") + EDGE: _char(r) for t, r in ranks.items()})
        self.bytes = "".join(chr(b) for b in range(256))
        self.byte_tokens = "".join(_char(ranks[bytes([b])]) for b in range(256))

    @staticmethod
    def _get(literal: Column, key: Column) -> Column:
        """The value of a key, or ``NONE``: the second character of what follows the key, or else of the whole string."""
        bucket = F.get(literal, (F.crc32(key) % BUCKETS).cast("int"))
        return F.substring(F.call_function("substring_index", bucket, key, F.lit(-1)), 2, 1)

    def __call__(self, word: Column) -> Column:
        """The tokens of a word as characters."""
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

        def merged(r: Column, literal: Column) -> Column:
            pieces = F.concat(F.lit(EDGE), F.translate(r, self.bytes, self.byte_tokens), F.lit(EDGE))
            return let(pieces, lambda p: self._merge(p, next_to(p, literal), literal))

        def next_to(pieces: Column, literal: Column) -> Column:
            pairs = F.sequence(F.lit(1), F.length(pieces) - 1)
            return F.array_join(F.transform(pairs, lambda i: self._get(literal, F.substring(pieces, i, F.lit(2)))), "")

        def found(r: Column) -> Column:
            whole = self._get(self.tokens, F.concat(F.lit(EDGE), r, F.lit(EDGE)))
            # The pairs are bound once: a literal is sent with each place that names it.
            return let(whole, lambda t: F.when(t != NONE, t).otherwise(let(self.pairs, lambda pairs: merged(r, pairs))))

        return let(raw, found)

    def each(self, words: Column) -> Column:
        """The tokens of each word of an array of structs of ``pieces`` and ``next``, as ``Starts`` makes them."""
        return let(self.pairs, lambda pairs: F.transform(words, lambda w: self._merge(w["pieces"], w["next"], pairs)))

    def _merge(self, pieces: Column, following: Column, literal: Column) -> Column:
        """The fold over a word's pieces between two marks, with what each two neighbours merge to. The marks merge
        with nothing, so each piece has two neighbours.
        """

        def pair(key: Column) -> Column:
            return self._get(literal, key)

        def step(acc: Column, _: Column) -> Column:
            return let(
                F.array_min(F.split(acc["next"], "")),
                lambda best: F.when(best == NONE, acc).otherwise(
                    let(F.instr(acc["next"], best), lambda i: merge(acc["pieces"], acc["next"], best, i))
                ),
            )

        def merge(pieces: Column, following: Column, best: Column, i: Column) -> Column:
            """Put ``best`` in the place of pieces i and i + 1 and look up its new neighbours."""

            def put(merged: Column) -> Column:
                near = F.concat(pair(F.substring(merged, i - 1, F.lit(2))), pair(F.substring(merged, i, F.lit(2))))
                return F.struct(merged.alias("pieces"), F.overlay(following, near, i - 1, F.lit(3)).alias("next"))

            return let(F.overlay(pieces, best, i, F.lit(2)), put)

        start = F.struct(pieces.alias("pieces"), following.alias("next"))
        merges = F.sequence(F.lit(4), F.greatest(F.length(pieces), F.lit(4)))  # one less than pieces, one at least
        return F.translate(F.aggregate(merges, start, step)["pieces"], EDGE, "")


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> str:
    """The tokens of a long word: a heap of pairs by rank and place, stale ones skipped."""
    parts: list[bytes | None] = [bytes([b]) for b in word]
    right = list(range(1, len(parts) + 1))
    left = list(range(-1, len(parts) - 1))

    def pair(i: int):
        joined = parts[i] + parts[right[i]]
        return (ranks[joined], i, joined) if joined in ranks else None

    heap = [p for p in map(pair, range(len(parts) - 1)) if p]
    heapify(heap)
    while heap:
        _, i, joined = heappop(heap)
        if parts[i] is None or right[i] >= len(parts) or parts[i] + parts[right[i]] != joined:
            continue
        gone = right[i]
        parts[i], parts[gone], right[i] = joined, None, right[gone]
        if right[i] < len(parts):
            left[right[i]] = i
        for j in (left[i], i):
            if j >= 0 and right[j] < len(parts) and (p := pair(j)):
                heappush(heap, p)
    return "".join(_char(ranks[p]) for p in parts if p is not None)


class Starts:
    """Where the fold of a word starts, for many words at once in Arrow columns: its bytes' tokens between two marks,
    and what each two neighbours merge to. All of these are characters of three bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        chars = [_char(ranks[bytes([b])]) for b in range(256)] + [EDGE]
        self.pieces = np.frombuffer("".join(chars).encode(), np.uint8).reshape(257, 3)
        self.next = np.tile(np.frombuffer(NONE.encode(), np.uint8), (257, 257, 1))
        for pair, rank in ranks.items():
            if len(pair) == 2:
                self.next[pair[0], pair[1]] = np.frombuffer(_char(rank).encode(), np.uint8)

    @staticmethod
    def _strings(chars: np.ndarray, cuts: np.ndarray) -> pa.Array:
        ends, raw = (cuts * 3).astype(np.int32), np.ascontiguousarray(chars)
        return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    def __call__(self, words: pa.Array) -> pa.StructArray:
        sizes = np.asarray(pc.binary_length(words), np.int64)
        cuts, one = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(words) + 1)
        edges = np.zeros(cuts[-1] + 2 * len(words), bool)
        edges[(cuts + 2 * one)[:-1]] = edges[(cuts + 2 * one)[1:] - 1] = True
        codes = np.full(len(edges), 256)
        codes[~edges] = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
        # All neighbours but a word's last mark and the next one's first.
        left = np.delete(np.arange(len(codes)), (cuts + 2 * one)[1:] - 1)
        pieces = self._strings(self.pieces[codes], cuts + 2 * one)
        following = self._strings(self.next[codes[left], codes[left + 1]] if len(left) else self.next[0, :0], cuts + one)
        return pa.StructArray.from_arrays([pieces, following], names=["pieces", "next"])


# Word splitting. Texts of the first Unicode blocks take the standard engine with the same classes written out.
_PLAIN = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if regex.match(kind, chr(c)))


_L, _N = _class(r"\p{L}"), _class(r"\p{N}")
_SLOW = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACES}").replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]"))
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACES}{_L}{_N}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def split_words(text: str) -> list[str]:
    plain = text.isascii() or max(text) < chr(_PLAIN)
    return (_FAST if plain else _SLOW).findall(text)


def _parts(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Strings joined between each two cuts, or lists of what lies there."""
    if pa.types.is_list(values.type):
        return pa.ListArray.from_arrays(pa.array(np.asarray(values.offsets)[cuts], pa.int32()), values.values)
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)[cuts]
    return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(at), values.buffers()[2]])


def chunk_words(keys: pa.Array) -> pa.ListArray:
    """The words of each chunk by its key; only chunks that are not of letters alone need the pattern."""
    lettered = pc.match_substring_regex(keys, WORD)
    rows = [split_words(chunk_of(k)) for k in keys.filter(pc.invert(lettered)).to_pylist()]
    single = pc.binary_join_element_wise(" ", keys.filter(lettered), "")
    words = pa.concat_arrays([single, pa.array([w for row in rows for w in row], pa.string())])
    sizes = np.concatenate([np.ones(len(single), np.int64), np.array([len(row) for row in rows], np.int64)])
    cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    order = np.argsort(~np.asarray(lettered), kind="stable")
    return pa.ListArray.from_arrays(cuts, words).take(pa.array(np.argsort(order)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, added up in the tasks before the shuffle; long words are left out.

    A batch's words are counted by its distinct chunks, in Arrow columns.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(pending).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                keys, _, _ = chunked(batch.column("text").slice(at, TEXTS).fill_null(""))
                counts = np.bincount(np.asarray(keys.indices), minlength=len(keys.dictionary))
                words = chunk_words(keys.dictionary)
                counts = np.repeat(counts, np.diff(np.asarray(words.offsets)))
                rows = pa.table({"word": words.flatten(), "n": pa.array(counts, pa.int64())})
                pending.append(rows.filter(pc.less_equal(pc.binary_length(rows["word"]), FOLDED_BYTES)))
                if sum(map(len, pending)) > FLUSH_WORDS:
                    pending[:] = [added()]
                    if len(pending[0]) > FLUSH_WORDS // 2:
                        yield from pending.pop().to_batches(FLUSHED_ROWS)
        if pending:
            yield from added().to_batches(FLUSHED_ROWS)

    rows = docs.select("text").mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def shared_words(docs: DataFrame, fold: Fold, limit: int = SHARED_WORDS) -> pa.Table:
    """The tokens of the most frequent words, at most ``limit`` rows, kept in Arrow columns on the driver.

    The least count is found from the numbers of words in steps of the logarithm of the count, so
    nothing is sorted in one place.
    """
    counts = saved(word_counts(docs), "word-counts")
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > limit:
            break
        least = at
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "t": pa.array([], pa.string())})
    frequent = counts.where(step >= least).select("word")
    wide = frequent.repartition(max(frequent.sparkSession.sparkContext.defaultParallelism * 4, 1))
    return saved(wide.select("word", fold(F.col("word")).alias("t")), "shared-words").toArrow()


def encoded(docs: DataFrame, path: str | None = None, limit: int = SHARED_WORDS) -> DataFrame:
    """doc_id and ``tokens``, the ids of each whole text as characters (``FIRST`` + id).

    Null and empty texts have no tokens. Repeated rows are encoded each; null ids stay; other columns
    are ignored; an empty table gives none.
    """
    ranks = read_ranks(path or default_path())
    fold = Fold(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(shared_words(docs, fold, limit))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word that is a token is that token; the merges need not lead there.
        whole = pa.table({"word": pa.array(list(ranks), pa.binary()), "t": [_char(r) for r in ranks.values()]})
        whole = whole.filter(pa.array([_is_text(t) for t in ranks])).cast(pa.schema({"word": pa.string(), "t": pa.string()}))
        table = pa.concat_tables([shared.value.cast(whole.schema), whole])
        known, tokens = (table[c].combine_chunks() for c in ("word", "t"))
        tokens = pa.concat_arrays([tokens, pa.array([NONE])])
        starts_of = Starts(ranks)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                keys, starts, ends = chunked(part.column("text").fill_null(""))
                words = chunk_words(keys.dictionary)
                cuts, flat = np.asarray(words.offsets), words.flatten()
                place = np.array(pc.index_in(flat, known).fill_null(len(known)), np.int64)
                long = np.flatnonzero((place == len(known)) & (np.asarray(pc.binary_length(flat)) > FOLDED_BYTES))
                merged = [heap_merged(flat[i].as_py().encode(), ranks) for i in long.tolist()]
                place[long] = len(tokens) + np.arange(len(long))
                found = pa.concat_arrays([tokens, pa.array(merged, pa.string())]).take(pa.array(place))
                rare = place == len(known)
                rest = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(rare)])[cuts], pa.int32()), starts_of(flat.filter(pa.array(rare)))
                )
                # From chunks to texts, which stand in the order of their chunks first.
                order = np.argsort(starts)
                bounds = np.concatenate([[0], ends[order]])
                back = pa.array(np.argsort(order))
                columns = [_parts(x.take(keys.indices), bounds).take(back) for x in (_parts(found, cuts), rest)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "tokens", "rare"])

    rows = docs.select("doc_id", "text").mapInArrow(looked_up, "doc_id bigint, tokens string, rare array<struct<pieces:string,next:string>>")
    # Before each rare word stands the text of known words up to its place.
    filled = let(
        F.split("tokens", NONE, -1),
        lambda parts: F.concat(
            F.array_join(F.zip_with(F.slice(parts, 1, F.size("rare")), fold.each(F.col("rare")), lambda p, t: F.concat(p, t)), ""),
            F.element_at(parts, -1),
        ),
    )
    return rows.select("doc_id", F.when(F.size("rare") == 0, F.col("tokens")).otherwise(filled).alias("tokens"))


def token_ids(tokens: Column) -> Column:
    """The ids as an array of int."""
    return F.when(tokens == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(tokens, ""), lambda c: F.ascii(c) - FIRST)
    )


# Texts whose ids are looked up together.
DIGESTED = 128
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def bpe_report(docs: DataFrame, path: str | None = None, limit: int = SHARED_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and the bytes that the ids decode to."""
    ranks = read_ranks(path or default_path())

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(ranks.values()) + 1
        piece = {r: t for t, r in ranks.items()}
        numbers = pa.array([f"{r},".encode() for r in range(size)], pa.binary())
        pieces = pa.array([piece.get(r) for r in range(size)], pa.binary())

        def hashes(values: pa.Array, ids: pa.Array, ends: np.ndarray, cut: int) -> pa.Array:
            """Digests of the values of ids, joined per text; the last ``cut`` bytes of a text are left out."""
            taken = values.take(ids)
            at = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)[ends].tolist()
            joined = memoryview(taken.buffers()[2])
            sums = [hashlib.sha256(joined[a : max(a, b - cut)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            return pa.array(sums, pa.string())

        for batch in batches:
            for start in range(0, len(batch), DIGESTED):
                part = batch.slice(start, DIGESTED)
                tokens = part.column("tokens").to_pylist()
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.array(np.frombuffer("".join(tokens).encode("utf-16-le"), "<u2") - np.uint16(FIRST))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), hashes(numbers, ids, ends, 1), hashes(pieces, ids, ends, 0)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encoded(docs, path, limit).mapInArrow(digested, DIGEST)
