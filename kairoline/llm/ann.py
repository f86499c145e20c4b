"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors are one node, so a vector that many rows share is no crowd. The graph gives each node its ``k`` nearest
known nodes. It starts from a few tables, whose buckets are compared within (the nodes nearest to one of some pivots, which are nodes themselves, and
where that leaves buckets too large, on one side of random hyperplanes), and from groups dealt by
hash, which give every node edges, also one that is alone in its buckets. Each round then joins
the graph's edges and reverse edges with the vectors, gathers each node's neighbours, compares these with each other (they
are neighbours of neighbours) where the last round brought one of the two, and lets every node keep its ``k`` best. Rounds end when fewer than ``delta`` of all edges
change. A query is a node of the graph; its search starts from its own edges, the nearest nodes of the cells of the nearest pivots and the nodes of its
group by hash, so that it isn't held in a part of the graph without edges to the rest, and expands, in each hop, the nearest
``beam`` nodes not expanded yet, until none are left (``hops`` only guards against a loop). All tables are shuffled on node ids;
none is collected or broadcast.

Graph and search compare 8-bit codes of the vectors. A code is what is left of a vector beside the nearest of at most 256 centres: a
scale, the centre, and a byte for each component. Centres, a middle and a spread of the components are taken from a sample
of the vectors, bounded by ``SAMPLE`` rows and ``SAMPLE_BYTES``, by medians, so that neither a common offset, nor groups far apart, nor rows of
any size cost the others their digits. The nodes that a search
ends with are ranked anew by the exact distance, in double precision on the original vectors; so are those of the smallest ids, which win where
distances tie. A query left with fewer answers than there are candidates for is compared with all rows.

Recall is measured: ``MEASURED`` queries, chosen by hash, are compared with all rows. Below ``TARGET`` the search goes on with a beam twice as
wide, three times at most; if recall then is below ``LEAST``, all queries are compared with all rows, in blocks.

A bucket of more than ``leaf`` nodes is split by hash: the graph is only started there, so splitting loses no row.
Reverse edges of a node beyond ``k`` are sampled in each round, by another hash each time.

Vectors that are null, empty or zero, or hold a null or non-finite component, take no part, nor do rows without
id. All others must have one length, else an error is raised. Rows with an id that has come with the same vector count
once. With ``k`` nodes or fewer every node is every node's neighbour. Empty tables give empty results.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, sliced

K = 24
TABLES = 10
LEAF = 256
#: Pivots of a table, and bytes of those of all tables.
PIVOTS = 1024
PIVOT_BYTES = 8 << 20
#: Nodes in a group by hash; well above K, so that a group's chance size leaves K others for each node.
DEALT = 64
ROUNDS = 12
DELTA = 0.03
BEAM = 192
HOPS = 64
#: Nodes that a search remembers, as a multiple of the beam.
REMEMBERED = 4
#: Rows, and bytes of them, from which centres are taken.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
CENTRES = 256
MEASURED = 32
TARGET = 0.95
LEAST = 0.9
BLOCK = 512
RERANK = 40
#: Pairs that a node may get from one gathering in a round; those that it misses, others give.
OFFERS = 10
#: Cells of each table that a search starts from, nodes in a part of a cell, and parts of a cell that a query sees.
PROBES = 8
PART = 1024
PARTS = 4
#: Pairs that a node may get from one bucket at the start, where there are several.
FIRST = 12


class Coder:
    """Codes of vectors: eight bytes of scale, one for the centre, and one for each component of what is left beside it. All is in
    units of the components' spread, and bounded, so that no square overflows or vanishes."""

    HEAD = 9
    MOST = 1e120

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        with np.errstate(all="ignore"):
            self.middle = np.median(sample, axis=0)
            off = np.abs(sample - self.middle)
            spread = np.median(off)
            if not 0 < spread < np.inf:
                spread = np.median(off[(off > 0) & (off < np.inf)]) if ((off > 0) & (off < np.inf)).any() else 1.0
        self.spread = float(spread)
        y = self.scaled(sample)
        # half of the centres as the rows fall, half far from those there are
        n = min(CENTRES, max(1, len(y) // 8))
        at = rng.choice(len(y), max(1, n // 2), replace=False).tolist()
        nearest = np.full(len(y), np.inf)
        for k in range(n):
            if k >= len(at):
                if not nearest.sum():
                    break
                at.append(int(rng.choice(len(y), p=nearest / nearest.sum())))
            nearest = np.minimum(nearest, np.sqrt(((y - y[at[k]]) ** 2).sum(axis=1)))
        self.centres = y[at]
        self.squares = (self.centres**2).sum(axis=1)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.clip((v - self.middle) / self.spread, -self.MOST, self.MOST)

    def encode(self, v: np.ndarray) -> np.ndarray:
        y = self.scaled(v)
        centre = np.argmin(self.squares - 2 * (y @ self.centres.T), axis=1)
        rest = y - self.centres[centre]
        scale = np.abs(rest).max(axis=1)
        scale[scale == 0] = 1.0
        parts = (scale / 127).view(np.uint8).reshape(-1, 8), centre.astype(np.uint8)[:, None], np.rint(rest / scale[:, None] * 127).astype(np.int8).view(np.uint8)
        return np.concatenate(parts, axis=1)

    def decode(self, column: pa.Array) -> np.ndarray:
        """The vectors, as rows."""
        rows = column.to_pylist()
        packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        return self.centres[packed[:, 8]] + packed[:, self.HEAD :].view(np.int8) * packed[:, :8].copy().view(np.float64)


def _sample(nodes: DataFrame, n: int, dim: int, seed: int) -> np.ndarray:
    """A sample of the nodes' vectors, chosen by hash."""
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    share = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(1, n))) < most
    rows = nodes.where(share).select("embedding").limit(2 * most).toPandas()["embedding"] if n else []
    if n and not len(rows):
        rows = nodes.select("embedding").limit(most).toPandas()["embedding"]
    return np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((1, max(1, dim)))


def _codes(coder: Coder):
    """id, embedding -> id, code."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                packed = coder.encode(np.array(batch.column(1).to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bytes, packed), pa.binary())], ["id", "code"])

    return scan


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew, so that each holds whole groups; rows come in order of the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if held and g[0] != held[0].column(0)[-1].as_py() or cut:
            whole = [*held, *([batch.slice(0, cut)] if cut else [])]
            yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare(offers: int, coder: Coder):
    """g, id, code, kth, fresh (rows in order of g) -> id, nbr, d: squared distances of pairs within a group, one of which
    at least is fresh, that are below id's kth, each id's nearest ``offers``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches):
            g, ids, kth, fresh = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            vectors = coder.decode(batch.column(2))
            cuts = [0, *(np.nonzero(np.diff(g))[0] + 1).tolist(), len(g)]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                # an id may come as an edge and as a reverse edge: the fresh one counts
                order = np.lexsort((~fresh[a:b], ids[a:b]))
                own, where = np.unique(ids[a:b][order], return_index=True)
                if len(own) < 2:
                    continue
                where = a + order[where]
                v, limit, old = vectors[where], kth[where], ~fresh[where]
                sq = np.einsum("ij,ij->i", v, v)
                d = sq[:, None] + sq - 2 * (v @ v.T)
                better = d < limit[:, None]
                np.fill_diagonal(better, False)
                if old.any():
                    better &= ~(old[:, None] & old)
                count = better.sum(axis=1)
                many = count > offers
                if many.any():
                    # of those only the nearest
                    rest = np.where(better[many], d[many], np.inf)
                    near = np.argpartition(rest, offers - 1, axis=1)[:, :offers]
                    better[many] = False
                    better[np.flatnonzero(many)[:, None], near] = True
                i, j = np.nonzero(better)
                if len(i):
                    found.append((own[i], own[j], np.maximum(d[i, j], 0)))
            if found:
                x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(d.astype(np.float64))], ["id", "nbr", "d"])

    return scan


def _seen(n: int, coder: Coder):
    """g, id, code, asked (rows in order of g) -> q, node, d: of each group the n nodes nearest to each query in it, by squared distances."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches):
            g, ids, asked = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            vectors = coder.decode(batch.column(2))
            square = np.einsum("ij,ij->i", vectors, vectors)
            cuts = [0, *(np.nonzero(np.diff(g))[0] + 1).tolist(), len(g)]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                nodes = a + np.flatnonzero(~asked[a:b])
                for start in range(0, int(asked[a:b].sum()), 1024):
                    queries = (a + np.flatnonzero(asked[a:b]))[start : start + 1024]
                    if not len(nodes):
                        break
                    d = square[queries][:, None] + square[nodes] - 2 * (vectors[queries] @ vectors[nodes].T)
                    d[ids[queries][:, None] == ids[nodes]] = np.inf
                    m = min(n, len(nodes))
                    near = np.argpartition(d, m - 1, axis=1)[:, :m]
                    value = np.take_along_axis(d, near, 1)
                    i, j = np.nonzero(value < np.inf)
                    found.append((ids[queries][i], ids[nodes][near[i, j]], np.maximum(value[i, j], 0)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["q", "node", "d"])

    return scan


def _distances(coder: Coder):
    """q, node, code of q, code of node -> q, node, d."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = ((coder.decode(batch.column(2)) - coder.decode(batch.column(3))) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.astype(np.float64))], ["q", "node", "d"])

    return scan


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


def _distance(x: str, y: str) -> Column:
    """Euclidean, in double precision. Where the squares might overflow, differences are taken as parts of the largest."""
    diff = F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, t: s + t * t))
    largest = F.array_max(diff)
    return F.when((largest > 1e150) | (largest < 1e-150) & (largest > 0), largest * norm(F.transform(diff, lambda t: t / largest))).otherwise(norm(diff))


def _release(spark) -> None:
    """Let Spark drop shuffle files of tables that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Graph:
    """The neighbour graph of the nodes (id, embedding), as tables in the shared folder."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, k: int = K, tables: int = TABLES, leaf: int = LEAF, rounds: int = ROUNDS, delta: float = DELTA, seed: int = 7):
        self.scratch, self.k = scratch, k
        self._went: tuple | None = None
        spark = nodes.sparkSession
        ship(spark)
        size = nodes.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if size["n"] and size["low"] != size["high"]:
            raise ValueError(f"vectors of {size['low']} and of {size['high']} components")
        self.n, dim = size["n"], size["high"] or 0
        self.seed = seed
        sample = _sample(nodes, self.n, dim, seed)
        self.coder = Coder(sample, seed)
        self.codes = scratch.write(nodes.select("id", "embedding").mapInArrow(_codes(self.coder), "id long, code binary"))
        self.edges = scratch.write(self._best(self._start(tables, leaf, self.coder.scaled(sample), seed)))
        for turn in range(rounds):
            new = scratch.write(self._round(turn))
            changed = new.agg(F.sum("new")).first()[0] or 0
            scratch.drop(self.edges)
            self.edges = new
            _release(spark)
            if changed <= delta * k * self.n:
                break

    def _best(self, offers: DataFrame) -> DataFrame:
        """id, nbr, d, new: each id's k nearest of all that it was offered."""
        # one exchange by id serves both steps
        once = offers.repartition("id").groupBy("id", "nbr").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "nbr"))
        return once.withColumn("rank", rank).where(F.col("rank") <= self.k).drop("rank")

    def _cells(self, probes: int = 1, split: bool = True):
        """id, code -> b, id, code: the buckets of each table that hold an id, or ``probes`` of them, the nearest ones; unless split, by pivots alone."""
        coder, pivots, planes = self.coder, self.pivots, self.planes
        tables, bits = len(pivots), planes.shape[1] if split else 0

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 4096):
                if not batch.num_rows:
                    continue
                v = coder.decode(batch.column(1))
                for t in range(tables):
                    far = (pivots[t] ** 2).sum(axis=1) - 2 * (v @ pivots[t].T)
                    nearest = np.argmin(far, axis=1)[:, None] if probes == 1 else np.argpartition(far, probes - 1, axis=1)[:, :probes]
                    side = nearest << bits
                    if bits:
                        side = side + ((v @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)))[:, None]
                    row = pa.array(np.repeat(np.arange(len(v)), probes))
                    yield pa.RecordBatch.from_arrays([pa.array(side.ravel() * tables + t), batch.column(0).take(row), batch.column(1).take(row)], ["b", "id", "code"])

        return scan

    def _start(self, tables: int, leaf: int, sample: np.ndarray, seed: int) -> DataFrame:
        """Pairs within the buckets of tables and within groups by hash."""
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        most = max(1, min(len(sample), PIVOTS, PIVOT_BYTES // (8 * dim * tables)))
        few = min(most, max(1, -(-self.n // leaf)))
        self.pivots = [sample[rng.choice(len(sample), few, replace=False)] for _ in range(tables)]
        bits = max(0, int(np.ceil(np.log2(max(1, self.n / leaf / few)))))
        self.planes = rng.normal(size=(tables, bits, dim))
        dealt = self.codes.mapInArrow(self._cells(), "b long, id long, code binary")
        parts = dealt.groupBy("b").agg(F.ceil(F.count("*") / (1.5 * leaf)).alias("parts"))
        g = F.xxhash64("b", F.pmod(F.xxhash64("id"), F.col("parts")))
        groups = dealt.join(parts, "b").select(g.alias("g"), "id", "code").unionByName(self.codes.select(self._hand().alias("g"), "id", "code"))
        return self._compared(groups.withColumn("kth", F.lit(float("inf"))).withColumn("fresh", F.lit(True)), self.k if few == 1 and not bits else min(self.k, FIRST))

    def _hand(self) -> Column:
        """The group by hash of a node; all are one group where they are few."""
        return F.xxhash64(F.lit(self.seed), F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(max(1, self.n // DEALT))))

    def _compared(self, groups: DataFrame, offers: int) -> DataFrame:
        found = groups.select("g", "id", "code", "kth", "fresh").repartition("g").sortWithinPartitions("g").mapInArrow(_compare(offers, self.coder), "id long, nbr long, d double")
        return found.withColumn("new", F.lit(1))

    def neighbours(self, turn: int = 0) -> DataFrame:
        """id, nbr, fresh: each id's edges, and of the reverse edges as many, those that the last round brought first."""
        rank = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("new"), F.xxhash64("id", F.lit(turn))))
        back = self.edges.select("id", "nbr", "new").withColumn("rank", rank).where(F.col("rank") <= self.k)
        both = self.edges.select("id", "nbr", "new").unionByName(back.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "new"))
        return both.select("id", "nbr", (F.col("new") == 1).alias("fresh"))

    def _round(self, turn: int) -> DataFrame:
        kth = self.edges.groupBy("id").agg(F.when(F.count("*") < self.k, float("inf")).otherwise(F.max("d")).alias("kth"))
        known = self.codes.join(kth, "id", "left").select(F.col("id").alias("nbr"), "code", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
        # where nothing is fresh, all pairs have been compared
        some = F.max("fresh").over(Window.partitionBy("id"))
        around = self.neighbours(turn).withColumn("some", some).where("some").drop("some")
        groups = around.join(known, "nbr").select(F.col("id").alias("g"), F.col("nbr").alias("id"), "code", "kth", "fresh")
        offers = self._compared(groups, OFFERS)
        return self._best(offers.unionByName(self.edges.select("id", "nbr", "d").withColumn("new", F.lit(0))))

    def search(self, starts: DataFrame, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
        """starts: q, nodes of the graph. q, node, d (of codes): the nodes nearest to each that were met, itself left out. Called again for
        the same starts with a wider beam, the search goes on from where it ended."""
        scratch, spark = self.scratch, starts.sparkSession
        if not (self._went and self._went[0] is starts):
            self._went = (starts, *self._begun(starts))
        _, around, asked, state = self._went
        # nodes beyond the beam are remembered, so that they aren't measured again each time that they are met
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
        for _ in range(hops):
            ranked = state.select("q", "node", "d", "done").withColumn("rank", rank)
            ahead = ranked.where((F.col("rank") <= beam) & (F.col("done") == 0)).select("q", F.col("node").alias("at"))
            reached = ahead.join(around, ahead["at"] == around["id"]).select("q", F.col("nbr").alias("node")).where("node <> q").distinct()
            fresh = reached.join(state.select("q", "node"), ["q", "node"], "left_anti")
            coded = fresh.join(self.codes, fresh["node"] == self.codes["id"]).select("q", "node", "code").join(asked, "q")
            measured = coded.select("q", "node", "own", "code").mapInArrow(_distances(self.coder), "q long, node long, d double").withColumn("done", F.lit(0))
            done = F.when(F.col("rank") <= beam, 1).otherwise(F.col("done")).alias("done")
            merged = ranked.select("q", "node", "d", done).unionByName(measured).withColumn("rank", rank)
            new = scratch.write(merged.where(F.col("rank") <= REMEMBERED * beam))
            scratch.drop(state)
            state = new
            self._went = (starts, around, asked, state)
            _release(spark)
            if not state.where(f"done = 0 AND rank <= {beam}").limit(1).count():
                break
        return self._went[3].select("q", "node", "d")

    def _begun(self, starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The graph's neighbours, the queries' codes, and the nodes that searches start from."""
        scratch = self.scratch
        around = scratch.write(self.neighbours().select("id", "nbr"))
        asked = scratch.write(starts.join(self.codes, starts["q"] == self.codes["id"]).select("q", F.col("code").alias("own")))
        edges = starts.join(self.edges, starts["q"] == self.edges["id"]).select("q", F.col("nbr").alias("node"), "d")
        hand = self.codes.select(self._hand().alias("g"), "id", "code")
        dealt = asked.join(hand.select("g", F.col("id").alias("q")), "q").join(hand.select("g", F.col("id").alias("node"), "code"), "g").where("node <> q")
        others = dealt.select("q", "node", "own", "code").mapInArrow(_distances(self.coder), "q long, node long, d double")
        others = others.unionByName(self._probed(asked))
        # a pair may come from several, its distance rounded otherwise
        return around, asked, scratch.write(edges.unionByName(others).groupBy("q", "node").agg(F.min("d").alias("d")).withColumn("done", F.lit(0)))

    def _probed(self, asked: DataFrame) -> DataFrame:
        """q, node, d: the nearest nodes of the cells around each query. A cell is dealt out by hash into parts, of which a query sees a few."""
        # of few cells few, so that a query isn't compared with most of a small table
        probes = max(1, min(PROBES, len(self.pivots[0]) // 25))
        kind = "b long, id long, code binary"
        cells = self.codes.mapInArrow(self._cells(split=False), kind)
        parts = cells.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
        nodes = cells.join(parts, "b").select("b", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "code", F.lit(False).alias("asked"))
        seen = asked.select(F.col("q").alias("id"), F.col("own").alias("code")).mapInArrow(self._cells(probes, split=False), kind).join(parts, "b")
        turn = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.least("parts", F.lit(PARTS))), lambda i: F.pmod(F.xxhash64("id", F.lit(1)) + i, F.col("parts"))))
        groups = nodes.unionByName(seen.select("b", turn.alias("part"), "id", "code", F.lit(True).alias("asked")))
        rows = groups.select(F.xxhash64("b", "part").alias("g"), "id", "code", "asked").repartition("g").sortWithinPartitions("g")
        return rows.mapInArrow(_seen(FIRST, self.coder), "q long, node long, d double")


def nearest(df: DataFrame, is_query: Column, n: int = 10, key: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, beam: int = BEAM, hops: int = HOPS, **graph) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance): the n nearest rows found for each row of df that
    ``is_query`` selects, nearest first, of equals the smaller id."""
    scratch = Scratch(df.sparkSession, "ann")
    rows = df.where(F.col(key).isNotNull() & usable(F.col(embedding))).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("asked"))
    rows = scratch.write(rows)
    nodes = scratch.write(rows.groupBy("embedding").agg(F.min("vec_id").alias("id")))
    named = scratch.write(rows.join(nodes, "embedding").select("id", "vec_id", "asked").distinct())
    # a result names at most n of a node's rows, and a query may be one of them
    rank = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    members = named.select("id", "vec_id").distinct().withColumn("r", rank).where(F.col("r") <= n + 1).select(F.col("id").alias("node"), "vec_id")

    own = Graph(nodes, scratch, **graph)
    starts = scratch.write(named.where("asked").select(F.col("id").alias("q")).distinct())
    queries = named.where("asked").select(F.col("id").alias("q"), F.col("vec_id").alias("query_id")).distinct()
    lowest = nodes.select(F.col("id").alias("node")).orderBy("node").limit(n + 1)
    a, b = nodes.select(F.col("id").alias("q"), F.col("embedding").alias("x")), nodes.select(F.col("id").alias("node"), F.col("embedding").alias("y"))

    def answered(near: DataFrame) -> DataFrame:
        """query_id, vec_id and score of the n best of pairs of query and node."""
        scored = near.join(a, "q").join(b, "node").select("q", "node", _distance("x", "y").alias("score"))
        order = Window.partitionBy("q").orderBy("score", "vec_id")
        answers = scratch.write(scored.join(members, "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n + 1).select("q", "vec_id", "score"))
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        out = queries.join(answers, "q").where("query_id <> vec_id").withColumn("rank", ranked).where(F.col("rank") <= n)
        return scratch.write(out.select("query_id", "vec_id", "score"))

    recall = _Recall(starts, nodes, own.coder, n)
    for wider in (1, 2, 4, 8):
        found = own.search(starts, beam * wider, hops)
        best = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
        near = found.withColumn("r", best).where(F.col("r") <= max(rerank, 2 * n) * wider).select("q", "node")
        got = recall.of(near)
        if got >= TARGET:
            break
    if got >= LEAST:
        others = starts.crossJoin(F.broadcast(lowest))
        out = answered(near.unionByName(starts.select("q", F.col("q").alias("node"))).unionByName(others).distinct())
    else:
        out = answered(scratch.write(_compared_with_all(starts, nodes, own.coder, n + 1, scratch)).unionByName(starts.select("q", F.col("q").alias("node"))).distinct())
    made = out.unionByName(_missed(rows, out, n, scratch))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return made.withColumn("rank", ranked).select("query_id", "rank", "vec_id", "score")


def _nearest_in(ids: np.ndarray, vectors: np.ndarray, coder: Coder, n: int):
    """id, embedding -> q, node, d: of each batch the n nearest to each of some queries, of equals the smaller id."""
    own = coder.scaled(vectors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            nodes, y = batch.column(0).to_numpy(), coder.scaled(np.array(batch.column(1).to_pylist(), np.float64))
            for q, x in zip(ids.tolist(), own, strict=True):
                d = ((y - x) ** 2).sum(axis=1)
                d[nodes == q] = np.inf
                best = np.lexsort((nodes, d))[:n]
                best = best[np.isfinite(d[best])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(nodes[best]), pa.array(d[best])], ["q", "node", "d"])

    return scan


def _true_nearest(block: list, nodes: DataFrame, coder: Coder, n: int) -> DataFrame:
    """q, node, d of the n nearest nodes of a block of queries (id, embedding), which goes to all tasks."""
    ids, vectors = np.array([r["id"] for r in block], np.int64), np.array([np.asarray(r["embedding"], np.float64) for r in block])
    offers = nodes.select("id", "embedding").mapInArrow(_nearest_in(ids, vectors, coder, n), "q long, node long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
    return offers.withColumn("r", rank).where(F.col("r") <= n).drop("r")


class _Recall:
    """How many of the nearest nodes of some queries, chosen by hash, a search has found."""

    def __init__(self, starts: DataFrame, nodes: DataFrame, coder: Coder, n: int):
        chosen = starts.orderBy(F.xxhash64("q", F.lit(11)), "q").limit(MEASURED)
        block = nodes.join(F.broadcast(chosen), nodes["id"] == chosen["q"]).select("id", "embedding").collect()
        self.true = {(r["q"], r["node"]) for r in _true_nearest(block, nodes, coder, n).collect()} if block else set()
        self.queries = sorted({q for q, _ in self.true})

    def of(self, near: DataFrame) -> float:
        if not self.true:
            return 1.0
        got = {(r["q"], r["node"]) for r in near.where(F.col("q").isin(self.queries)).collect()}
        return len(self.true & got) / len(self.true)


def _compared_with_all(starts: DataFrame, nodes: DataFrame, coder: Coder, n: int, scratch: Scratch) -> DataFrame:
    """q, node: the n nearest nodes of every query, found by comparing blocks of ``BLOCK`` queries with all nodes, a pass over
    these for each block."""
    asked = scratch.write(starts.join(nodes, starts["q"] == nodes["id"]).select("id", "embedding"))
    blocks = scratch.write(asked.withColumn("block", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / BLOCK)))
    out = []
    for k in range(-(-asked.count() // BLOCK)):
        out.append(scratch.write(_true_nearest(blocks.where(F.col("block") == k).collect(), nodes, coder, 2 * n).select("q", "node")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _missed(rows: DataFrame, found: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Exact answers, beyond those found, of the queries that have fewer than n and than there are candidates."""
    once = rows.select("vec_id", "embedding").distinct()
    most = min(n, max(0, rows.select("vec_id").distinct().count() - 1))
    got = found.groupBy("query_id").agg(F.count("*").alias("got"), F.collect_set("vec_id").alias("known"))
    asked = rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x")).distinct()
    short = scratch.write(asked.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < most))
    if not short.limit(1).count():
        return found.limit(0)
    # a stated set of queries against all rows
    pairs = short.crossJoin(once.withColumnRenamed("embedding", "y")).where("query_id <> vec_id AND NOT coalesce(array_contains(known, vec_id), false)")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    scored = pairs.select("query_id", "vec_id", "got", _distance("x", "y").alias("score")).withColumn("rank", F.row_number().over(w))
    return scratch.write(scored.where(F.col("rank") + F.coalesce("got", F.lit(0)) <= n).select("query_id", "vec_id", "score"))
