"""Exact top-k inner products over vectors sorted by length.

Candidates are ordered by descending length (by ranges, not in one task) and
packed into blocks of at most ``BLOCK`` vectors; queries are packed likewise.
The first block of candidates, the longest vectors, gives each query a first
threshold, its k-th best score so far. By Cauchy-Schwarz a block is of no use to
a query where the product of the query's length and the block's greatest length
is below the threshold; as blocks are sorted, a query block needs a prefix of
them only, and query blocks are joined with just those. Within a pair of blocks
both are rotated by the singular vectors of the corpus (from the d x d Gram
matrix); partial products over the first rotated components plus the product of
the residual lengths bound the score, and only candidates that the bound can't
exclude are scored, in whole numbers.

The bound is loosened by more than rounding can amount to, so results are exact.

Defined results: rows with a null id, or whose vector is null or holds a null or
non-finite component, take no part; a candidate with the query's id is the
query's own; shorter vectors count as padded with zeros; an empty vector has
product 0 with all; repeated query rows each get results, repeated candidates
each take a place; ties go to the smaller id; extra columns are ignored, an
empty table gives an empty result. A component whose whole part needs more than
64 bits saturates, and scores of 2^63 or more wrap: keep scale * |x| under 2^26
for vectors of up to 512 components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BLOCK = 4096
QUERY_BLOCK = 1024
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and v (array<bigint>, each component x as floor(scale * x))."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _packed(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """part, no, n, longest, ids, mat: blocks in the order of the rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        ids, mats, size = [], [], 0

        def out(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m.astype(float) ** 2).sum(axis=1).max()))
            cols = {"part": [part], "no": [no], "n": [len(i)], "longest": [longest], "ids": [i.tobytes()], "mat": [m.tobytes()]}
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("part", "no", "n") else None) for k, v in cols.items()})

        for b in batches:
            ids.append(np.array(b.column("id").to_pylist(), dtype=np.int64))
            mats.append(_matrix(b.column("v"), dim))
            size += len(ids[-1])
            if size >= block:
                i, m = np.concatenate(ids), np.concatenate(mats)
                while len(i) >= block:
                    yield out(i[:block], m[:block])
                    no, i, m = no + 1, i[block:], m[block:]
                ids, mats, size = [i], [m], len(i)
        if size:
            yield out(np.concatenate(ids), np.concatenate(mats))

    return rows.mapInArrow(run, "part long, no long, n long, longest double, ids binary, mat binary")


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors, strongest first, from summed Gram matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim).astype(float)
            gram += m.T @ m
        cell = np.arange(dim * dim)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "g": pa.array(gram.ravel())})

    sums = rows.select("v").mapInArrow(run, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()  # dim * dim rows
    gram = np.zeros(dim * dim)
    for r in sums:
        gram[r["cell"]] = r["g"]
    _, vectors = np.linalg.eigh(np.nan_to_num(gram.reshape(dim, dim), posinf=0.0, neginf=0.0))
    return vectors[:, ::-1].copy()


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    return q @ c.T


def best_of(q: np.ndarray, qid: np.ndarray, least: np.ndarray, c: np.ndarray, cid: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of each query in a block,
    without those surely below ``least`` (each query's threshold so far)."""
    head = max(1, q.shape[1] // 4)
    qf, cf = q.astype(float) @ turn, c.astype(float) @ turn
    q_left, c_left = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (qf, cf))
    q_len, c_len = (np.sqrt((x**2).sum(axis=1)) for x in (qf, cf))
    bound = qf[:, :head] @ cf[:, :head].T + np.outer(q_left, c_left)
    bound += 1e-9 * np.outer(q_len, c_len) + 1e-6
    may = (bound >= least[:, None]) & (qid[:, None] != cid[None, :])
    rows, hits, scores = [], [], []
    dense = may.mean() > 0.05
    every = products(q, c) if dense else None
    for i in np.flatnonzero(may.any(axis=1)):
        at = np.flatnonzero(may[i])
        s = every[i, at] if dense else products(q[i : i + 1], c[at])[0]
        keep = s >= least[i]
        at, s = at[keep], s[keep]
        if len(s) > k:
            near = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[near], s[near]
        order = np.lexsort((cid[at], -s))[:k]
        rows.append(np.full(len(order), i))
        hits.append(cid[at[order]])
        scores.append(s[order])
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(rows or empty), np.concatenate(hits or empty), np.concatenate(scores or empty)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs as from ``whole_vectors``."""
    spark = candidates.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = candidates.select("id", "v", norm.alias("norm"))
    dim = candidates.select(F.max(F.size("v"))).union(queries.select(F.max(F.size("v")))).agg(F.max("max(size(v))")).first()[0] or 1
    turn = rotation(candidates, dim)
    parts = max(1, -(-rows.count() // BLOCK))  # full blocks, however many partitions the session asks for
    by_norm = [F.desc("norm"), F.asc("id")]
    sorted_rows = rows.repartitionByRange(parts, *by_norm).coalesce(parts).sortWithinPartitions(*by_norm)
    blocks = checkpointed(_packed(sorted_rows.select("id", "v"), dim, BLOCK))
    # a row for each BLOCK candidates: 24 bytes each
    metas = blocks.select("part", "no", "longest").orderBy("part", "no").collect()
    longest = np.array([m["longest"] for m in metas])
    numbers = spark.createDataFrame([(m["part"], m["no"], i) for i, m in enumerate(metas)], "part long, no long, c_no long")
    blocks = blocks.join(F.broadcast(numbers), ["part", "no"]).select("c_no", "ids", "mat")
    first = blocks.where("c_no = 0").collect()  # one block
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seed_id = np.frombuffer(first[0]["ids"], dtype=np.int64)
    seed = np.frombuffer(first[0]["mat"], dtype=np.int64).reshape(-1, dim)
    shared = spark.sparkContext.broadcast((turn, seed_id, seed, longest))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, seed_id, seed, longest = shared.value
        for b in batches:
            for part, no, ids, mat in zip(*(b.column(x).to_pylist() for x in ("part", "no", "ids", "mat")), strict=True):
                qid, q = np.frombuffer(ids, dtype=np.int64), np.frombuffer(mat, dtype=np.int64).reshape(-1, dim)
                least = np.full(len(qid), -np.inf)
                row, _, score = best_of(q, qid, least, seed, seed_id, turn, k)
                for i in range(len(qid)):
                    own = score[row == i]
                    if len(own) == k:
                        least[i] = own.min()
                length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                # blocks go by descending length: the last one that is of use to any query
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(least <= 1e-6, -np.inf, (least - 1e-6) / (length * (1 + 1e-9)))
                upto = max(0, int(np.searchsorted(-longest, -need.min(initial=np.inf), side="right")) - 1)
                yield pa.RecordBatch.from_pydict({
                    "q_part": pa.array([part], pa.int64()), "q_no": pa.array([no], pa.int64()), "q_ids": pa.array([ids], pa.binary()),
                    "q_mat": pa.array([mat], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()), "upto": pa.array([upto], pa.int64()),
                })

    packed = _packed(queries.select("id", "v"), dim, QUERY_BLOCK)
    asked = packed.mapInArrow(seeded, "q_part long, q_no long, q_ids binary, q_mat binary, least binary, upto long")
    asked = checkpointed(asked)  # thresholds are found once; packing depends on the partitions
    pairs = asked.withColumn("c_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto")))).join(blocks, "c_no")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        names = ("q_part", "q_no", "q_ids", "q_mat", "least", "ids", "mat")
        for b in batches:
            for part, no, q_ids, q_mat, least, ids, mat in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                qid, cid = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                q, c = (np.frombuffer(m, dtype=np.int64).reshape(-1, dim) for m in (q_mat, mat))
                row, hit, score = best_of(q, qid, np.frombuffer(least), c, cid, turn, k)
                yield pa.RecordBatch.from_pydict({
                    "q_part": pa.array(np.full(len(row), part), pa.int64()), "q_no": pa.array(np.full(len(row), no), pa.int64()), "q_row": pa.array(row, pa.int64()),
                    "query_id": pa.array(qid[row], pa.int64()), "vec_id": pa.array(hit, pa.int64()), "score": pa.array(score, pa.int64()),
                })

    found = pairs.mapInArrow(scored, "q_part long, q_no long, q_row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("q_part", "q_no", "q_row").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digests(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``."""
    rows = whole_vectors(embeddings)
    return top_k(rows.where(F.col("id") % every == 0), rows, k)
