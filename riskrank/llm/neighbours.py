"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product. With ``M`` the largest norm, a candidate ``x`` becomes
``(x, sqrt(M^2 - |x|^2)) / M`` and a query ``(q, 0) / |q|``: all have length one, and the
Euclidean order of the images is the order of the inner products. Each of ``TABLES`` hash
tables cuts ``PROJECTIONS`` Gaussian (2-stable) projections into cells of ``WIDTH``. A query
visits ``PROBES`` cells a table: its own and the perturbed ones, in the order of the
estimated chance to hold a neighbour (falling with the squared distance from the query's
projections to the cell), empty cells passed over. Candidates of all visited cells are
merged and ranked by the exact inner product in double precision.

The images have length one, so a projection's values, and with them the cells of a table,
are bounded by the parameters, not by the rows: the cell table may be collected and shipped.
Cells over ``CELL_ROWS`` rows are salted; groups of cells are read by one task each while
the queries stream past. Vectors that are equal are searched once, with the smallest ids
that can be in a result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - binds pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TABLES, PROJECTIONS, WIDTH, PROBES = 3, 4, 1.5, 60
CELL_ROWS, GROUP_ROWS = 2048, 4096
SEED = 5
ROW = "grp int, kind int, tab int, cells array<int>, id long, ids array<long>, vec array<double>"


def usable(vec: Column) -> Column:
    """No null, zero, null or non-finite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Tables:
    """The projections, and after ``learn`` the occupied cells with their rows."""

    def __init__(self, dim: int, largest: float, tables: int = TABLES, k: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, k)) / width
        self.b = rng.uniform(0, 1, (tables, 1, k))
        self.largest, self.cells = largest, [{} for _ in range(tables)]

    def spots(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of the cell width: (tables, rows, k)."""
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit = x / (norm if query else self.largest)
        last = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))
        return np.concatenate([unit, last], axis=1) @ self.a + self.b

    @staticmethod
    def name(cells: np.ndarray) -> np.ndarray:
        """One integer for the cell coordinates (-128 to 127 each, four at most) of a row."""
        out = np.zeros(len(cells), np.int64)
        for j in range(cells.shape[1]):
            out = out * 256 + (np.clip(cells[:, j], -128, 127) + 128).astype(np.int64)
        return (out - (1 << 31)).astype(np.int64)

    def learn(self, rows: list[tuple[int, int, int]], group_rows: int, cell_rows: int) -> int:
        """(table, cell, rows) -> gives every salted cell its group; returns the groups."""
        group = filled = 0
        for tab, cell, n in sorted(rows):
            parts = []
            for _ in range(-(-n // cell_rows)):
                if filled >= group_rows:
                    group, filled = group + 1, 0
                parts.append(group)
                filled += min(n, cell_rows)
            self.cells[tab][cell] = parts
        return group + 1

    def probes(self, x: np.ndarray, count: int):
        """Yields (row, table, cells) with the cells to visit, in order."""
        spots = self.spots(x, query=True)
        for tab, known in enumerate(self.cells):
            names = np.array(sorted(known), np.int64)
            raw = names + (1 << 31)
            at = np.stack([(raw >> (8 * j)) % 256 - 128 for j in reversed(range(spots.shape[2]))], axis=1)
            for i, p in enumerate(spots[tab]):
                gap = np.maximum(np.maximum(at - p, p - at - 1), 0)
                order = np.argsort((gap * gap).sum(axis=1), kind="stable")[:count]
                yield i, tab, names[order]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in the order of the components: equal vectors
    get equal scores wherever they lie."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _best(q: np.ndarray, x: np.ndarray, low: np.ndarray, keep: int) -> tuple:
    """(query, row, score) of each query's ``keep`` best rows, ties to the smaller ``low``."""
    rough = q @ x.T
    if x.shape[0] > keep:
        floor = np.partition(rough, x.shape[0] - keep, axis=1)[:, x.shape[0] - keep]
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        i, j = np.nonzero(rough >= (floor - slack)[:, None])
    else:
        i, j = (v.ravel() for v in np.indices(rough.shape))
    return i, j, exact_scores(q[i], x[j])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for the rows of ``is_query``.

    Rows with a null id and unusable vectors take no part. Vectors of one length are searched
    among themselves: there is no inner product with those of another. Rows repeated with the
    same id and vector count once; of queries that share an id the smallest vector of the most
    frequent length is used (of equal counts, the shorter). An empty table gives an empty
    result; other columns are not read."""
    vec = F.col(vec_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec)) \
                  .select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"),
                          is_query.alias("is_query"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    found = rows.groupBy(F.size("vec").alias("dim")) \
                .agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.max(F.coalesce("is_query", F.lit(False))).alias("asked"))
    lengths = sorted(found.collect(), key=lambda r: (-r["n"], r["dim"]))  # a row a length
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where("is_query")
    if sum(r["asked"] for r in lengths) > 1:
        place = F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(lengths) for v in (r["dim"], i)]), F.size("vec"))
        asked = asked.groupBy("id").agg(F.min(F.struct(place.alias("place"), "vec")).alias("first")).select("id", "first.vec")
    parts = [_nearest(rows.where(F.size("vec") == r["dim"]), asked.where(F.size("vec") == r["dim"]), r["dim"], r["largest"],
                      k, tables, projections, width, probes) for r in lengths if r["asked"] or r is lengths[0]]
    return reduce(DataFrame.union, parts)


def _nearest(rows: DataFrame, asked: DataFrame, dim: int, largest: float, k: int, tables: int, projections: int,
             width: float, probes: int) -> DataFrame:
    """The search among vectors of one length: ``rows`` of ``id, vec``, queries ``asked``."""
    # of equal vectors only the k + 1 smallest ids can be in a result
    same = Window.partitionBy("vec").orderBy("id")
    few = rows.select("id", "vec").distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    base = written(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    queries = written(asked.groupBy("id").agg(F.min("vec").alias("vec")), "ann-queries")
    hashing = Tables(dim, largest, tables, projections, width)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                spots = hashing.spots(_matrix(batch.column(0)), query=False)
                for tab, p in enumerate(spots):
                    found = Tables.name(np.floor(p))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), tab, np.int32)), pa.array(found)], names=["tab", "cell"])
    counts = base.select("vec").mapInArrow(cells, "tab int, cell long").groupBy("tab", "cell").count()
    groups = hashing.learn([tuple(r) for r in counts.collect()], GROUP_ROWS, CELL_ROWS)

    def salt(ids: np.ndarray, parts: int) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts

    def frame(rows):
        names = [f.split()[0] for f in ROW.split(", ")]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def index_rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(0)), batch.column(1).to_pylist()
            low = np.array([i[0] for i in ids])
            for tab, p in enumerate(hashing.spots(x, query=False)):
                found, rows = Tables.name(np.floor(p)).tolist(), []
                for i, cell in enumerate(found):
                    parts = hashing.cells[tab][cell]
                    rows.append((parts[int(salt(low[i:i + 1], len(parts))[0])], 0, tab, [cell], ids[i][0], ids[i], x[i]))
                yield frame(rows)

    def query_rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_pylist(), _matrix(batch.column(1))
            rows = []
            for i, tab, visit in hashing.probes(x, probes):
                by_group: dict[int, list[int]] = {}
                for cell in visit.tolist():
                    for group in set(hashing.cells[tab][cell]):
                        by_group.setdefault(group, []).append(cell)
                rows += [(g, 1, tab, c, ids[i], None, x[i]) for g, c in by_group.items()]
                if len(rows) > 2000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    def visit(batches):
        group, held, cell_rows, x, ids = None, [], {}, None, []

        def search(batch):
            """Candidates of a slice of queries in the group's cells."""
            q, who = _matrix(batch.column(6)), np.asarray(batch.column(4))
            tabs, visits = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            users: dict[tuple, list[int]] = {}
            for i, (tab, cells) in enumerate(zip(tabs, visits)):
                for c in cells:
                    users.setdefault((tab, c), []).append(i)
            found = [[], [], []]
            for key, qs in users.items():
                at = cell_rows.get(key)
                if at is not None:
                    qs = np.array(qs)
                    i, j, s = _best(q[qs], x[at], low[at], k + 1)
                    for out, v in zip(found, (qs[i], at[j], s)):
                        out.append(v)
            if not found[0]:
                return None
            i, j, s = (np.concatenate(v) for v in found)
            order = np.lexsort((low[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.searchsorted(i, i)
            near = np.arange(len(i)) - first <= k
            i, j, s = i[near], j[near], s[near]
            lists = [ids[r] for r in j.tolist()]
            sizes = np.array([len(v) for v in lists])
            row, first = np.unique(i, return_index=True)  # one row a query, with all its finds
            ends = pa.array(np.append(np.add.accumulate(np.append(0, sizes))[first], sizes.sum()).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(who[row]), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))),
                 pa.ListArray.from_arrays(ends, pa.array(np.repeat(s, sizes)))], names=["query_id", "ids", "scores"])

        low = np.zeros(0, np.int64)
        for batch in batches:
            at = 0
            groups_, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            while at < batch.num_rows:
                same = (groups_ == groups_[at]) & (kinds == kinds[at])
                end = at + int(same[at:].argmin()) if not same[at:].all() else batch.num_rows
                part = batch.slice(at, end - at)
                if groups_[at] != group:
                    group, held, cell_rows = groups_[at], [], {}
                if kinds[at] == 0:
                    held.append(part)
                    cell_rows = {}
                elif held:
                    if not cell_rows:
                        x = np.concatenate([_matrix(h.column(6)) for h in held])
                        ids = [v for h in held for v in h.column(5).to_pylist()]
                        low = np.array([v[0] for v in ids])
                        keys = [(t, c[0]) for h in held for t, c in zip(h.column(2).to_pylist(), h.column(3).to_pylist())]
                        by_key: dict[tuple, list[int]] = {}
                        for r, key in enumerate(keys):
                            by_key.setdefault(key, []).append(r)
                        cell_rows = {key: np.array(r) for key, r in by_key.items()}
                    for start in range(0, part.num_rows, 512):
                        out = search(part.slice(start, 512))
                        if out is not None:
                            yield out
                at = end
    row = ROW.replace("array<int>", "array<long>")
    both = base.select("vec", "ids").mapInArrow(index_rows, row).union(queries.select("id", "vec").mapInArrow(query_rows, row))
    dealt = both.repartition(max(1, groups), "grp").sortWithinPartitions("grp", "kind")
    found = dealt.mapInArrow(visit, "query_id long, ids array<long>, scores array<double>")

    def best(q, ids, scores):
        """The ``k`` best of each query; a pair found in several tables counts once."""
        own = ids != q
        q, ids, scores = q[own], ids[own], scores[own]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[new], ids[new], scores[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return [v[rank < k] for v in (q, ids, scores, rank + 1)]

    def merge(batches):
        def rows(q, ids, scores, rank):
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)],
                                              names=["query_id", "rank", "vec_id", "score"])
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column(1)))
            q = np.repeat(np.asarray(batch.column(0)), size)
            parts = (q, np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten()))
            q, ids, scores, rank = best(*(np.concatenate(v) for v in zip(held, parts)))
            done = q < (q[-1] if len(q) else 0)  # the last query may go on: hold its best
            yield rows(*(v[done] for v in (q, ids, scores, rank)))
            held = [v[~done] for v in (q, ids, scores)]
        yield rows(*best(*held))
    return found.repartition("query_id").sortWithinPartitions("query_id") \
                .mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
