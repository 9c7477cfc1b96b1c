"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is cut into pretokens; the block's distinct, not yet known
pretokens are laid out as one long array of byte tokens. An inverted index from
token pair (named by the rank of the merged token) to positions then lets every
merge be applied to the whole block at once, in rank order; each merge updates
the index only at the touched neighbours. The merged pretokens go to a bounded
cache, and each document is the concatenation of its pretokens' ids.

No shuffle is needed: a block is what one task reads, so a lost executor only
costs the blocks it held. Memory is bounded by ``block_chars`` and
``cache_words``, whatever the size of the corpus.

Defined results: null text counts as empty; an empty text has no ids; repeated
rows give repeated results; a very long text is a block by itself, whole; of equal
pairs in a run ("aaa") the left one is merged; an empty table gives an empty
result; other columns are passed on untouched.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

INF = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (base64 token, blank, rank in each line)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _runs(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The values of each run of equal keys; keys are sorted."""
    if not len(keys):
        return []
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)).tolist()
    return [(int(keys[a]), values[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]


class MergeReplay:
    """Replays all merges of a rank table over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_token = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.size = max(ranks.values()) + 1
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made, dtype=np.int32)[order]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or INF."""
        if not len(self.key):
            return np.full(len(left), INF, dtype=np.int32)
        want = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.made[at], INF)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = int(lengths.sum())
        tok = self.byte_token[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        # neighbours within the word; n stands for none
        nxt = np.arange(1, n + 2, dtype=np.int64)
        prv = np.arange(-1, n, dtype=np.int64)
        nxt[ends[ends > 0] - 1] = n
        prv[(ends - lengths)[lengths > 0]] = n
        alive = np.ones(n, dtype=bool)
        rank = np.full(n + 1, INF, dtype=np.int32)
        inner = np.flatnonzero(nxt[:n] < n)
        rank[inner] = self.ranks_of(tok[inner], tok[inner + 1])
        # the inverted index: positions by rank, later finds in `more`
        order = inner[np.argsort(rank[inner], kind="stable")]
        order = order[rank[order] < INF]
        index = dict(_runs(rank[order], order))
        more: dict[int, list[np.ndarray]] = {}
        heap = list(index)
        heapq.heapify(heap)
        queued = set(heap)
        while heap:
            r = heapq.heappop(heap)
            queued.discard(r)
            at = index.pop(r, None)
            if (late := more.pop(r, None)) is not None:
                at = np.unique(np.concatenate(late if at is None else [at, *late]))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = nxt[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs such as "aaaa": from the left
                keep, taken = [], -1
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, dtype=np.int64)
                right = nxt[at]
            after = nxt[right]
            tok[at] = r
            alive[right] = False
            rank[right] = INF
            nxt[at] = after
            inside = after < n
            prv[after[inside]] = at[inside]
            before = prv[at]
            touched = np.concatenate([at, before[before < n]])
            if len(touched) > 1:
                touched = np.unique(touched)
            follow = nxt[touched]
            has = follow < n
            rank[touched[~has]] = INF
            touched, follow = touched[has], follow[has]
            if not len(touched):
                continue
            new = self.ranks_of(tok[touched], tok[follow])
            rank[touched] = new
            found = new < INF
            if not found.any():
                continue
            touched, new = touched[found], new[found]
            if len(new) == 1 or (new == new[0]).all():
                groups = [(int(new[0]), touched)]
            else:
                by = np.argsort(new, kind="stable")
                groups = _runs(new[by], touched[by])
            for made, where in groups:
                more.setdefault(made, []).append(where)
                if made not in queued:
                    queued.add(made)
                    heapq.heappush(heap, made)
        out = tok[alive].astype("<u4").tobytes()
        counted = np.concatenate([[0], np.cumsum(alive)])
        bounds = counted[np.concatenate([[0], ends])] * 4
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class BlockEncoder:
    """Encodes blocks of texts; knows the ids of up to ``cache_words`` pretokens."""

    def __init__(self, raw_ranks: bytes, pattern: str, cache_words: int):
        self.replay = MergeReplay(parse_ranks(raw_ranks))
        self.find = regex.compile(pattern).findall
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        fresh = set().union(*cut).difference(known) if cut else set()
        if len(known) + len(fresh) > self.cache_words:  # what this block needs stays: frequent pretokens are merged once
            needed = set().union(*cut)
            self.known = known = {w: known[w] for w in needed.intersection(known)}
        words = list(fresh)
        known.update(zip(words, self.replay.encode([w.encode("utf-8") for w in words]), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


_encoders: dict[tuple, BlockEncoder] = {}


def _encoder(raw: bytes, pattern: str, cache_words: int) -> BlockEncoder:
    """One encoder for each worker process and rank table, kept between tasks."""
    key = (hash(raw), pattern, cache_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BlockEncoder(raw, pattern, cache_words)
    return _encoders[key]


def _blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column holds about ``size`` bytes each; a
    single larger value is a slice by itself."""
    kept = batch.column(column)
    whole = pc.binary_length(kept) if pa.types.is_string(kept.type) or pa.types.is_binary(kept.type) else pc.multiply(pc.list_value_length(kept), 4)
    sizes = np.cumsum(pc.fill_null(whole, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _binary_or_list(ids: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(ids, type=pa.binary())
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    packed: bool = False,
    decoded_col: str | None = None,
    drop: tuple[str, ...] = (),
    block_chars: int = 2_000_000,
    cache_words: int = 200_000,
) -> DataFrame:
    """Add the ids of each text: array<int>, or with ``packed`` little-endian
    unsigned 32-bit integers as binary. A column that is there by such a name
    gives way.

    ``decoded_col`` decodes the ids in the same pass; columns in ``drop`` (the
    text, say) are not sent back, which saves memory and time.

    ``block_chars``: texts gathered before a replay (one longer text is a block
    by itself). ``cache_words``: pretokens whose ids a worker keeps.
    """
    new = [c for c in (ids_col, decoded_col) if c]
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in new]
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # under 1 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern, cache_words)
        vocabulary = _vocabulary(shared.value) if decoded_col else {}
        for batch in batches:
            for block in _blocks(batch, text_col, block_chars):
                ids = encoder.encode(block.column(text_col).to_pylist())
                block = _with_column(block.select([f.name for f in kept]), ids_col, _binary_or_list(ids, packed))
                if decoded_col:
                    back = [_joined(np.frombuffer(x, dtype="<u4").tolist(), vocabulary) for x in ids]
                    block = _with_column(block, decoded_col, pa.array(back, type=pa.binary()))
                yield block
            give_back()

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    more = [T.StructField(ids_col, kind)] + [T.StructField(c, T.BinaryType()) for c in new[1:]]
    return df.mapInArrow(run, T.StructType([*kept, *more]))


def _vocabulary(raw: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in parse_ranks(raw).items()}


def _joined(ids: list[int], vocabulary: dict[int, bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded", block_bytes: int = 2_000_000) -> DataFrame:
    """Add the bytes that the ids stand for. ``ids_col`` is array<int> or packed
    binary; null counts as no ids. An id outside the vocabulary raises. A column
    that is there by the name ``bytes_col`` gives way."""
    kept = [f for f in df.schema.fields if f.name != bytes_col]
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for block in _blocks(batch, ids_col, block_bytes):
                out = []
                for x in block.column(ids_col):
                    ids = np.frombuffer(x.as_py() or b"", dtype="<u4").tolist() if packed else x.as_py() or []
                    out.append(_joined(ids, vocabulary))
                yield _with_column(block.select([f.name for f in kept]), bytes_col, pa.array(out, type=pa.binary()))
            give_back()

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(bytes_col, T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    back = encode(docs.select("doc_id", "text"), ranks_path, pattern, packed=True, decoded_col="decoded", drop=("text",))
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
