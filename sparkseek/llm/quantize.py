"""Nearest neighbours of every vector by additive quantization.

A vector is coded as a sum of full-dimensional codewords, one of each codebook. The first, coarse codebooks double as an inverted index:
a sum of their codewords is the center of a cell. One coarse level serves up to ``level_words`` cells, each further level multiplies that,
so cells stay small however many rows there are, while codebooks, sample and broadcast keep their size. All codebooks are trained residual
by residual on a bounded sample, and the fine ones are fitted again, jointly, to the codes that beam search gives; every row is encoded by
beam search. With the norm of its reconstruction stored, the distance to a query needs only inner products, looked up per codebook:

    |q - x|^2 ~ |q|^2 - 2 (q.c0 + sum_m q.c_m) + |c0 + sum_m c_m|^2

Queries visit their nearest cells, table scores pick candidates, exact distances rank them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.runtime import broadcast_if_small, materialize


@dataclass(frozen=True)
class Settings:
    """Parameters of the index; none depends on the data but the number of cells, which keeps their mean size constant."""

    k: int = 5
    cell_rows: int = 2048  # mean rows of a cell
    level_words: int = 4096  # most codewords of one coarse level
    sample_rows: int = 65_536  # rows the codebooks are trained on
    refit_rows: int = 16_384  # of them, those the fine codebooks are fitted to jointly
    books: int = 6  # residual codebooks
    words: int = 256  # codewords of each
    beam: int = 4
    probes: int = 8  # most cells a query visits
    rerank: int = 64  # candidates of a cell whose distance is computed exactly
    block_rows: int = 4096  # most rows of a cell scored in one task
    block_queries: int = 16_384  # about the most queries of a cell in one task
    seed: int = 11


def valid_vectors(vectors: DataFrame, id_col: str, point_col: str, d: int) -> DataFrame:
    """(vec_id, point) of the vectors with d finite numbers, not all 0; each id once (of different points the smallest)."""
    p = F.col(point_col)
    fine = p.isNotNull() & (F.size(p) == d) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(p, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), p.cast("array<float>").alias("point"))
    return rows.groupBy("vec_id").agg(F.min("point").alias("point"))


def _nearest(x: np.ndarray, centers: np.ndarray, m: int = 1, chunk: int = 8192) -> np.ndarray:
    """Indices of the m nearest centers of each row, nearest first."""
    norms, out = (centers**2).sum(1), []
    for i in range(0, len(x), chunk):
        score = norms - 2 * x[i : i + chunk] @ centers.T
        if m == 1:
            out.append(score.argmin(1)[:, None])
            continue
        best = np.argpartition(score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        out.append(np.take_along_axis(best, np.take_along_axis(score, best, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, m), int)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centers; an empty cluster moves to a random row."""
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)[:, 0]
        n = np.bincount(at, minlength=k)
        order = at.argsort(kind="stable")
        full = np.flatnonzero(n)
        centers[full] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[full])[:-1])), axis=0) / n[full, None]
        empty = np.flatnonzero(n == 0)
        centers[empty] = x[rng.choice(len(x), len(empty))]
    return centers.astype(np.float32)


def level_sizes(cells: int, most: int) -> list[int]:
    """Codewords of each coarse level: as few levels of at most ``most`` words as give that many cells."""
    levels, size = 1, most
    while size < cells:
        levels, size = levels + 1, size * most
    words = max(1, int(np.ceil(cells ** (1 / levels) - 1e-9)))
    return [words] * levels


@dataclass(frozen=True)
class Codebooks:
    coarse: tuple[np.ndarray, ...]  # of each level, words x d
    radius: np.ndarray  # by word of the last level: 99 of 100 sampled members lie within; with fewer than two of them, that of the whole sample
    fine: np.ndarray  # books x words x d

    @classmethod
    def train(cls, sample: np.ndarray, cells: int, s: Settings) -> Codebooks:
        """Residual by residual on the sample; then the fine books are fitted jointly to beam search's codes."""
        rng = np.random.default_rng(s.seed)
        residual, coarse = sample, []
        for size in level_sizes(cells, s.level_words):
            coarse.append(kmeans(residual, size, rng))
            word = _nearest(residual, coarse[-1])[:, 0]
            residual = residual - coarse[-1][word]
        far = np.sqrt((residual.astype(np.float64) ** 2).sum(1))
        radius = np.array([np.quantile(far[word == c], 0.99) if (word == c).sum() > 1 else far.max(initial=0.0) for c in range(len(coarse[-1]))])
        fine, rest = [], residual
        for _ in range(s.books):
            words = np.zeros((s.words, sample.shape[1]), np.float32)
            found = kmeans(rest, s.words, rng, 8)
            words[: len(found)] = found
            words[len(found) :] = found[0]
            fine.append(words)
            rest = rest - words[_nearest(rest, words)[:, 0]]
        return cls(tuple(coarse), radius, np.stack(fine)).refit(residual[: s.refit_rows], s.beam)

    def refit(self, residual: np.ndarray, beam: int) -> Codebooks:
        """The fine codewords that reconstruct the residuals best, given their codes: one least-squares problem over all books, with a slight pull to the words as they are."""
        books, words, d = self.fine.shape
        codes = self.encode(residual, beam)[0].astype(np.int64)
        gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, d))
        for a in range(books):
            rows = slice(a * words, (a + 1) * words)
            right[rows] = np.stack([np.bincount(codes[:, a], residual[:, j], words) for j in range(d)], 1)
            for b in range(books):
                gram[rows, b * words : (b + 1) * words] = np.bincount(codes[:, a] * words + codes[:, b], minlength=words * words).reshape(words, words)
        flat = self.fine.reshape(-1, d).astype(np.float64)
        fitted = np.linalg.solve(gram + np.eye(len(gram)), right + flat)
        return Codebooks(self.coarse, self.radius, fitted.reshape(books, words, d).astype(np.float32))

    def center(self, cell: np.ndarray) -> np.ndarray:
        """Centers of cells: digits of a cell's number are its codewords."""
        out, rest = np.zeros((len(cell), self.coarse[0].shape[1]), np.float32), np.asarray(cell)
        for words in reversed(self.coarse):
            out += words[rest % len(words)]
            rest = rest // len(words)
        return out

    def visits(self, x: np.ndarray, probes: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(cells, wanted): the nearest cells of each row, and which of them are worth a visit.

        Further levels are searched from the 2 * ``probes`` best sums so far. A point in cell j is at least d_j - r_j away. The k nearest in
        the row's own cell are usually within its radius r_1, or within d_1 for a row far out; where the first exceeds that, the cell is
        unlikely to have nearer points.
        """
        total = int(np.prod([len(w) for w in self.coarse]))
        first = _nearest(x, self.coarse[0], min(probes if len(self.coarse) == 1 else 2 * probes, len(self.coarse[0])))
        cells = first.astype(np.int64)
        for level, words in enumerate(self.coarse[1:], 2):
            keep = probes if level == len(self.coarse) else 2 * probes
            norms, out = (words**2).sum(1), []
            for i in range(0, len(x), chunk):
                known = cells[i : i + chunk]
                left = x[i : i + chunk, None, :] - self._partial(known, level - 1)
                cost = ((left**2).sum(2)[:, :, None] + norms - 2 * left @ words.T).reshape(len(left), -1)
                m = min(keep, cost.shape[1])
                best = np.argpartition(cost, m - 1, axis=1)[:, :m]
                best = np.take_along_axis(best, np.take_along_axis(cost, best, 1).argsort(1, kind="stable"), 1)
                out.append(np.take_along_axis(known, best // len(words), 1) * len(words) + best % len(words))
            cells = np.concatenate(out) if out else np.zeros((0, min(keep, total)), np.int64)
        flat = cells.ravel()
        away = np.sqrt(((x[:, None, :] - self.center(flat).reshape(*cells.shape, -1)) ** 2).sum(2))
        radius = self.radius[flat % len(self.coarse[-1])].reshape(cells.shape)
        wanted = away - radius <= np.maximum(away[:, :1], radius[:, :1])
        wanted[:, 0] = True
        return cells, wanted

    def _partial(self, numbers: np.ndarray, levels: int) -> np.ndarray:
        """Sums of the first ``levels`` coarse codewords, for a matrix of their numbers."""
        return Codebooks(self.coarse[:levels], self.radius, self.fine).center(numbers.ravel()).reshape(*numbers.shape, -1)

    def encode(self, residual: np.ndarray, beam: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(codes, reconstruction) of residuals: per codebook, each of the ``beam`` best partial sums is extended by every codeword."""
        codes, sums = [], []
        for i in range(0, len(residual), chunk):
            r = residual[i : i + chunk]
            paths, left = np.zeros((len(r), 1, 0), np.uint8), r[:, None, :]
            for words in self.fine:
                cost = (left**2).sum(2)[:, :, None] - 2 * left @ words.T + (words**2).sum(1)
                flat = cost.reshape(len(r), -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = best // len(words), best % len(words)
                paths = np.concatenate((np.take_along_axis(paths, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)), 2)
                left = np.take_along_axis(left, parent[:, :, None], 1) - words[word]
            winner = (left**2).sum(2).argmin(1)[:, None, None]
            codes.append(np.take_along_axis(paths, winner, 1)[:, 0])
            sums.append(r - np.take_along_axis(left, winner, 1)[:, 0])
        d = residual.shape[1]
        return (np.concatenate(codes), np.concatenate(sums)) if codes else (np.zeros((0, len(self.fine)), np.uint8), np.zeros((0, d), np.float32))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list<float> column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Matrix rows as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _unbytes(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


class Index:
    """All valid vectors, encoded and written once to shared storage: (vec_id, n, x, cell, codes, norm, visit).

    Points that several ids share are indexed once, under the smallest id (``n``: how many share it), since a large group of copies would
    be compared with itself; ``copies`` has (vec_id, first) of all ids in such groups, and results are spread over them at the end.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", point_col: str = "point", d: int = 32, settings: Settings | None = None):
        """``vectors`` may have repeated, null, mis-sized, non-finite and zero points (left out) and any other columns (not read)."""
        self.s, self.d = settings or Settings(), d
        s = self.s
        self.spark = vectors.sparkSession
        every = materialize(valid_vectors(vectors, id_col, point_col, d), "vectors")
        clean = materialize(every.groupBy("point").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "point", "n"), "points")
        self.n = clean.count()
        shared = clean.where("n > 1").select(F.col("vec_id").alias("first"), "point")
        self.copies = None if shared.isEmpty() else materialize(every.join(broadcast_if_small(shared), "point").select("vec_id", "first"), "copies")
        self.cells = max(1, round(self.n / s.cell_rows))
        share = min(1.0, 1.1 * s.sample_rows / max(self.n, 1))
        picked = clean.where(F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(1 << 40)) < int((1 << 40) * share)).limit(s.sample_rows)
        sample = picked.select("point").toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
        if not len(sample):
            sample = np.zeros((1, d), np.float32)
        self.books = self.spark.sparkContext.broadcast(Codebooks.train(sample, self.cells, s))  # bounded by level_words, books and words
        self.rows = materialize(clean.mapInArrow(self._encode(), "vec_id long, n long, x binary, cell long, codes binary, norm float, visit array<long>"), "encoded")

    def _encode(self):
        shared, s, d = self.books, self.s, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), d)
                visit, wanted = b.visits(x, s.probes)
                cell = visit[:, 0]
                center = b.center(cell)
                codes, rest = b.encode(x - center, s.beam)
                norm = ((center + rest) ** 2).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(wanted.sum(1)))).astype(np.int32)), pa.array(visit[wanted]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _bytes(x), pa.array(cell), _bytes(codes), pa.array(norm.astype(np.float32)), lists], ["vec_id", "n", "x", "cell", "codes", "norm", "visit"])

        return run

    def members(self, which: Column | None = None) -> DataFrame:
        """(vec_id, first) of every valid vector, or of those for which the condition on vec_id holds."""
        alone = self.rows.where("n = 1").select("vec_id", F.col("vec_id").alias("first"))
        rows = alone if self.copies is None else alone.unionByName(self.copies)
        return rows if which is None else rows.where(which)

    def vectors(self, which: Column | None = None) -> DataFrame:
        """(vec_id, x) of every valid vector, or of those for which the condition on vec_id holds."""
        if self.copies is None:
            rows = self.rows.select("vec_id", "x")
            return rows if which is None else rows.where(which)
        return self.members(which).join(self.rows.select(F.col("vec_id").alias("first"), "x"), "first").select("vec_id", "x")

    def neighbours(self, which: Column | None = None) -> DataFrame:
        """(vec_id, ids, dists): the k nearest other vectors of every vector, or of those for which the condition on vec_id holds; nearest first, ties by id.

        Of a group of copies only the k + 1 smallest ids can be anyone's neighbours at their distance, so groups are never paired up.
        """
        if self.copies is None:
            return self._points_near(self.rows if which is None else self.rows.where(which))
        k = self.s.k
        asked = self.rows.join(self.members(which).select(F.col("first").alias("vec_id")).distinct(), "vec_id", "left_semi")
        near = self._points_near(asked)
        rank = F.row_number().over(Window.partitionBy("first").orderBy("vec_id"))
        heads = self.copies.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("first").agg(F.sort_array(F.collect_list("vec_id")).alias("heads"))
        pairs = near.select("vec_id", F.explode(F.concat(F.array(F.struct(F.lit(0.0).alias("dist"), F.col("vec_id").alias("first"))), F.zip_with("dists", "ids", lambda a, i: F.struct(a.alias("dist"), i.alias("first"))))).alias("p"))
        spread = pairs.select("vec_id", "p.dist", "p.first").join(broadcast_if_small(heads), "first", "left").select("vec_id", "dist", F.explode(F.coalesce("heads", F.array("first"))).alias("id"))
        best = spread.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "id"))), 1, k + 1).alias("best")).withColumnRenamed("vec_id", "first")
        own = self.members(which).join(best, "first").withColumn("best", F.slice(F.filter("best", lambda b: b.id != F.col("vec_id")), 1, k))
        return own.select("vec_id", F.col("best.id").alias("ids"), F.col("best.dist").alias("dists"))

    def _points_near(self, queries: DataFrame) -> DataFrame:
        """(vec_id, ids, dists): the k nearest other points of some of the index's rows.

        Work is cut into blocks of a cell's rows times parts of its queries, so that no group grows with the data or with one crowded cell:
        the counts per cell say into how many. Rows whose cells hold fewer than k others come out short; these are searched exactly.
        """
        s, d = self.s, self.d
        asked = queries.select(F.col("vec_id").alias("query"), F.col("x").alias("q"), F.explode("visit").alias("cell"))
        members, visits = self.rows.groupBy("cell").agg(F.count("*").alias("n")), asked.groupBy("cell").agg(F.count("*").alias("v"))
        cells = broadcast_if_small(members.join(visits, "cell").select("cell", F.ceil(F.col("n") / s.block_rows).cast("int").alias("blocks"), F.ceil(F.col("v") / s.block_queries).cast("int").alias("parts")))
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        base = self.rows.join(cells, "cell").withColumn("block", spread("vec_id", "blocks")).select("cell", "block", every("parts").alias("part"), "vec_id", "x", "codes", "norm")
        asks = asked.join(cells, "cell").withColumn("part", spread("query", "parts")).select(F.col("cell").alias("q_cell"), every("blocks").alias("q_block"), F.col("part").alias("q_part"), "query", "q")
        found = asks.groupBy("q_cell", "q_block", "q_part").cogroup(base.groupBy("cell", "block", "part")).applyInArrow(_scorer(self.books, s, d), "vec_id long, ids array<long>, dists array<double>")
        hits = F.flatten(F.collect_list(F.transform(F.arrays_zip("dists", "ids"), lambda h: F.struct(h.dists.alias("dist"), h.ids.alias("id")))))
        best = found.groupBy("vec_id").agg(F.slice(F.array_sort(hits), 1, s.k).alias("best"))  # at most k of each visited block
        near = materialize(best.select("vec_id", F.col("best.id").alias("ids"), F.col("best.dist").alias("dists")), "near")
        short = materialize(self.short(queries, near), "short")
        parts = -(-short.count() // 50_000)
        if not parts:
            return near
        near = near.join(broadcast_if_small(short.select("vec_id")), "vec_id", "left_anti")
        for i in range(parts):
            near = near.unionByName(exact_neighbours(self.rows, short.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i), s.k, d))
        return near

    def short(self, queries: DataFrame, near: DataFrame) -> DataFrame:
        """(vec_id, x) of the queries that have fewer than k neighbours in ``near``, though the index has as many other points."""
        least = min(self.s.k, self.n - 1)
        enough = near.where(F.size("ids") >= least).select("vec_id")
        few = materialize(queries.select("vec_id").join(enough, "vec_id", "left_anti"), "few")
        return queries.select("vec_id", "x").join(broadcast_if_small(few), "vec_id", "left_semi")


def _scorer(shared, s: Settings, d: int):
    """Cogrouped function: table scores of one block's rows for one part of the queries, then exact distances of the candidates."""

    def run(key: tuple, asks: pa.Table, base: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))])
        if not asks.num_rows or not base.num_rows:
            return schema.empty_table()
        b = shared.value
        center = b.center(np.array([key[0].as_py()]))[0]
        column = lambda t, c: t.column(c).combine_chunks()
        q, qid = _unbytes(column(asks, "q"), np.float32, d), column(asks, "query").to_numpy()
        x, xid = _unbytes(column(base, "x"), np.float32, d), column(base, "vec_id").to_numpy()
        codes, norm = _unbytes(column(base, "codes"), np.uint8, len(b.fine)), column(base, "norm").to_numpy()
        take, keep = min(s.rerank + 1, len(x)), min(s.k, len(x))
        wide = x.astype(np.float64)
        ids, dists, sizes = [], [], []
        words, at = [-2 * w for w in b.fine], [codes[:, m].astype(np.intp) for m in range(len(b.fine))]
        chunk = max(1, 131_072 // len(x))  # a table of scores stays in the cache
        for i in range(0, len(q), chunk):
            part = q[i : i + chunk]
            score = norm[:, None] - 2 * (part @ center)
            for m, table in enumerate(words):
                score += np.take(table @ part.T, at[m], axis=0)
            score = np.ascontiguousarray(score.T)
            near = np.argpartition(score, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), score.shape)
            away = wide[near] - part.astype(np.float64)[:, None, :]
            exact = np.sqrt(np.einsum("ijk,ijk->ij", away, away))
            names = xid[near]
            exact[names == qid[i : i + chunk, None]] = np.inf
            order = np.lexsort((names, exact), axis=1)[:, :keep]
            exact, names = np.take_along_axis(exact, order, 1), np.take_along_axis(names, order, 1)
            good = np.isfinite(exact)
            ids.append(names[good])
            dists.append(exact[good])
            sizes.append(good.sum(1))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32))
        return pa.table([pa.array(qid), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(dists)))], schema=schema)

    return run


def close_pairs(neighbours: DataFrame, radius: float) -> DataFrame:
    """(vec_id_1, vec_id_2), the smaller first, each once: neighbours at a distance of at most ``radius``."""
    each = neighbours.select("vec_id", F.explode(F.arrays_zip("ids", "dists")).alias("n")).where(F.col("n.dists") <= radius)
    return each.select(F.least("vec_id", "n.ids").alias("vec_id_1"), F.greatest("vec_id", "n.ids").alias("vec_id_2")).distinct()


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int, d: int, most: int = 100_000) -> DataFrame:
    """Brute force for measuring: (vec_id, ids, dists) of a stated set of at most ``most`` queries against all rows.

    The queries go to every task as one matrix of bounded size; each task keeps its k best per query.
    """
    asked = queries.select("vec_id", "x").limit(most + 1).toPandas()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries")
    shared = rows.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), np.frombuffer(b"".join(asked["x"]), np.float32).reshape(-1, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        wide, norms = q.astype(np.float64), (q.astype(np.float64) ** 2).sum(1)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            xid, x = batch.column(0).to_numpy(), _unbytes(batch.column(1), np.float32, d).astype(np.float64)
            for i in range(0, len(q), 512):
                dist = norms[i : i + 512, None] - 2 * wide[i : i + 512] @ x.T + (x**2).sum(1)
                dist[qid[i : i + 512, None] == xid] = np.inf
                m = min(k, len(x))
                near = np.argpartition(dist, m - 1, axis=1)[:, :m]
                exact = np.sqrt(np.maximum(((x[near] - wide[i : i + 512, None, :]) ** 2).sum(2), 0))
                exact[~np.isfinite(np.take_along_axis(dist, near, 1))] = np.inf
                all_d, all_i = np.concatenate((best_d[i : i + 512], exact), 1), np.concatenate((best_i[i : i + 512], xid[near]), 1)
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[i : i + 512], best_i[i : i + 512] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        good = np.isfinite(best_d)
        ends = pa.array(np.concatenate(([0], np.cumsum(good.sum(1)))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(best_i[good], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(best_d[good]))], ["vec_id", "ids", "dists"])

    local = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, ids array<long>, dists array<double>")
    hits = local.select("vec_id", F.explode(F.arrays_zip("dists", "ids")).alias("h"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("h.dists", "h.ids"))
    kept = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.groupBy("vec_id").agg(F.array_sort(F.collect_list("h")).alias("h")).select("vec_id", F.col("h.ids").alias("ids"), F.col("h.dists").alias("dists"))
