"""Vector compression by product codes, with codebooks refined by Lloyd rounds on cover trees.

Vectors are whole numbers (see ``vectors``) and are cut into equal consecutive parts. Each
part position has a codebook, started from the parts of the rows with the smallest ids.
A round moves every entry to the floored mean of the parts nearest to it.

**Trees.** Each task cuts its rows into blocks and builds one cover tree a part position
over a block: a node holds a run of the block's rows, a centre that is one of them, and the
radius around the centre; its children cover it at half its radius, each centre further
than that from the others, its own centre first. A node's rows are consecutive in the
tree's order, so cumulative sums along that order give any subtree's sum and count by one
subtraction. Trees are built once and written to the shared folder.

**Assignment.** For a node with centre c and radius r, an entry further from c than the
nearest one by more than 2r can't be nearest to anything in it (triangle inequality). Where
one entry is left, the whole subtree is assigned to it; otherwise the children are looked at
with the entries that are left, and leaves compare their rows exactly. Ties go to the lower
index: an entry is only dropped where it is strictly further, and exact comparisons are on
whole squared distances.

On Spark: no row is shuffled for the rounds. Each task sends on one sum and count for each
entry's component that it met, which are added up; codebooks (positions x entries x
components, a fixed size) are all that reaches the driver. The sums of errors by label are
joined back to the rows; labels that hold more than a thousandth of the rows, at most a
thousand of them, are broadcast, the rest are joined by label.

Defined results: unusable vectors are dropped; rows that share an id are rows of their own,
each with its code; null ids count as larger than all others, equal ids are ordered by
vector; fewer rows than entries give smaller codebooks; an empty table gives an empty
result. Vectors of different lengths, or of a length that the parts don't divide, raise a
``ValueError``. Columns of the caller other than the three named aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import small_batches, stored, table
from shelfscope.llm.vectors import vector_rows, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of a block, and rows of a leaf at most (more only where rows are alike).
BLOCK, LEAF = 8_192, 8
#: Labels with more than this share of the rows are broadcast, one over it at most.
HOT = 1_000

NODES = ("start", "end", "centre", "radius2", "child", "children")
TREES = ("ids array<long>, labels array<{label}>, dim int, vectors array<int>, orders array<int>, "
         + ", ".join(f"{c} array<{'long' if c == 'radius2' else 'int'}>" for c in NODES))


class Tree:
    """Cover trees of all part positions over one block, in one set of node arrays.

    ``points`` are the parts of all positions one under the other in the trees' order;
    nodes 0 to ``parts`` - 1 are the roots; a node's children are numbered consecutively.
    """

    def __init__(self, points: np.ndarray, nodes: dict[str, np.ndarray]):
        self.points = points
        self.__dict__.update(nodes)

    @staticmethod
    def grown(x: np.ndarray, parts: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The order of the rows (within each position) and the nodes, for rows of ``x``."""
        n, dim = x.shape
        points = x.reshape(n, parts, dim // parts).swapaxes(0, 1).reshape(parts * n, dim // parts)
        order = np.arange(parts * n)
        start, centre = np.arange(parts) * n, np.arange(parts) * n
        end = start + n
        made: dict[str, list] = {c: [] for c in NODES}
        numbered = 0
        while len(start):
            count = end - start
            rows = _runs(start, count)
            owner = np.repeat(np.arange(len(start)), count)
            at = points[order[rows]]
            d2 = ((at - points[centre][owner]) ** 2).sum(axis=1)
            radius2 = np.maximum.reduceat(d2, np.cumsum(count) - count)
            numbered += len(start)
            inner = (count > LEAF) & (radius2 > 0)
            keep = inner[owner]
            rows, owner, at, d2 = rows[keep], owner[keep], at[keep], d2[keep]
            child, of, centres = _children(order[rows], owner, at, d2, centre, radius2, points)
            by = np.lexsort((child, owner))
            order[rows] = order[rows][by]
            size = np.bincount(child[by], minlength=len(of))
            rank = np.lexsort((np.arange(len(of)), of))
            children = np.bincount(of, minlength=len(start))
            first = numbered + np.cumsum(children) - children
            for name, values in zip(NODES, (start, end, centre, radius2, np.where(inner, first, -1), children), strict=True):
                made[name].append(values)
            size, of = size[rank], of[rank]
            within = np.cumsum(size) - size
            base = np.zeros(len(start), np.int64)
            present, at_first = np.unique(of, return_index=True)
            base[present] = within[at_first]
            start = start[of] + within - base[of]
            end, centre = start + size, centres[rank]
        nodes = {c: np.concatenate(v) for c, v in made.items()}
        nodes["centre"] = nodes["centre"] % max(n, 1)
        return order % max(n, 1), nodes

    @classmethod
    def stored(cls, x: np.ndarray, orders: np.ndarray, nodes: dict[str, np.ndarray], parts: int) -> Tree:
        n, dim = x.shape
        cut = x.reshape(n, parts, dim // parts).swapaxes(0, 1)
        points = np.take_along_axis(cut, orders.reshape(parts, n, 1).astype(np.int64), axis=1).reshape(parts * n, -1)
        part = nodes["start"] // n
        return cls(points, {**nodes, "part": part, "middle": cut[part, nodes["centre"]]})

    def assigned(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, entry) of runs that together hold every row of every position."""
        n_books, entries, _ = books.shape
        runs = []
        nodes = np.arange(n_books)
        left = np.ones((n_books, entries), bool)
        while len(nodes):
            d2 = _squares(self.middle[nodes], books[self.part[nodes]])
            d = np.where(left, np.sqrt(d2), np.inf)
            least = d.min(axis=1)
            reach = least + 2 * np.sqrt(self.radius2[nodes])
            left = d <= (reach * (1 + 1e-9) + 1e-9)[:, None]
            one = left.sum(axis=1) == 1
            runs.append((self.start[nodes[one]], self.end[nodes[one]], left[one].argmax(axis=1)))
            nodes, left = nodes[~one], left[~one]
            leaf = self.child[nodes] < 0
            runs.append(self._exact(nodes[leaf], books))
            nodes, left = nodes[~leaf], left[~leaf]
            n = self.children[nodes]
            nodes, left = _runs(self.child[nodes], n), np.repeat(left, n, axis=0)
        return tuple(np.concatenate(c) for c in zip(*runs, strict=True))

    def _exact(self, nodes: np.ndarray, books: np.ndarray):
        count = self.end[nodes] - self.start[nodes]
        rows = _runs(self.start[nodes], count)
        entry = np.empty(len(rows), np.int64)
        part = np.repeat(self.part[nodes], count)
        for at in range(0, len(rows), 1 << 14):
            some = slice(at, at + (1 << 14))
            entry[some] = _squares(self.points[rows[some]], books[part[some]]).argmin(axis=1)
        return rows, rows + 1, entry

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the rows of each position's entries, by cumulative sums."""
        start, end, entry = self.assigned(books)
        parts, entries, width = books.shape
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(self.points, axis=0)])
        slot = start // (len(self.points) // parts) * entries + entry
        np.add.at(total, slot, running[end] - running[start])
        np.add.at(count, slot, end - start)
        return total.reshape(books.shape), count.reshape(parts, entries)

    def codes(self, books: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entries and squared distance, in the block's own order."""
        parts = len(books)
        n = len(self.points) // parts
        start, end, entry = self.assigned(books)
        code = np.empty(parts * n, np.int64)
        code[_runs(start, end - start)] = np.repeat(entry, end - start)
        code = code.reshape(parts, n)
        away = ((self.points.reshape(parts, n, -1) - books[np.arange(parts)[:, None], code]) ** 2).sum(axis=2)
        out, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
        for p, order in enumerate(orders.reshape(parts, n)):
            out[order, p] = code[p]
            error[order] += away[p]
        return out, error


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at ``start``, one run after the other."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - before, count)


def _squares(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Whole squared distances (n, entries) of each row to the entries of its own book."""
    out = np.zeros(books.shape[:2], np.int64)
    for j in range(x.shape[1]):
        out += (books[:, :, j] - x[:, j, None]) ** 2
    return out


def _children(rows, owner, at, d2, centre, radius2, points):
    """Each row's child, and the owner and centre of each child: every owner's own centre
    takes what lies within half its radius, then its first row left does, until none is."""
    child = np.full(len(rows), -1, np.int64)
    of, centres = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    made, left = 0, np.arange(len(rows))
    owners = np.unique(owner)
    heads = centre[owners]
    while len(left):
        number = np.empty(len(centre), np.int64)
        number[owners] = made + np.arange(len(owners))
        own = owner[left]
        if made:
            head = np.empty(len(centre), np.int64)
            head[owners] = heads
            d2 = ((at[left] - points[head[own]]) ** 2).sum(axis=1)
        near = 4 * d2 <= radius2[own]
        child[left[near]] = number[own[near]]
        of.append(owners)
        centres.append(heads)
        made += len(owners)
        left = left[~near]
        owners, first = np.unique(owner[left], return_index=True)
        heads = rows[left[first]]
    return child, np.concatenate(of), np.concatenate(centres)


def planter(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows with their trees, one row a block."""
    columns = ["ids", "labels", "dim", "vectors", "orders", *NODES]

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while len(b):
                some = b.slice(0, BLOCK - n)
                b = b.slice(len(some))
                held.append(some)
                n += len(some)
                if n == BLOCK:
                    yield block(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks())

    def block(t: pa.Table) -> pa.RecordBatch:
        vectors = t["vector"].combine_chunks()
        dims = set(vectors.value_lengths().to_pylist())
        if len(dims) > 1 or min(dims) % parts or not min(dims):
            raise ValueError(f"vectors of {sorted(dims)} components can't be cut into {parts} equal parts by one rule")
        dim = dims.pop()
        x = whole(vectors, dim)
        order, nodes = Tree.grown(x, parts)
        lists = {"ids": t["vec_id"].combine_chunks(), "labels": t["label"].combine_chunks(),
                 "vectors": pa.array(x.ravel().astype(np.int32)), "orders": pa.array(order.astype(np.int32)),
                 **{c: pa.array(nodes[c].astype(np.int64 if c == "radius2" else np.int32)) for c in NODES}}
        row = {c: pa.ListArray.from_arrays([0, len(v)], v) for c, v in lists.items()} | {"dim": pa.array([dim], pa.int32())}
        return pa.RecordBatch.from_arrays([row[c] for c in columns], names=columns)
    return plant


def trees_of(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """The blocks of ``vec_id``, ``label``, ``vector`` rows with their trees."""
    kind = df.schema["label"].dataType.simpleString()
    return df.select("vec_id", "label", "vector").mapInArrow(planter(parts), TREES.format(label=kind))


def _blocks(batches: Iterable[pa.RecordBatch], parts: int):
    for b in batches:
        for i in range(len(b)):
            row = {c: b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vectors", "orders", *NODES)}
            x = row.pop("vectors").reshape(-1, b.column("dim")[i].as_py())
            orders = row.pop("orders")
            yield Tree.stored(x, orders, row, parts), orders, b, i


def summer(books: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each entry's component that a task met: its sum and its count."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for tree, _, _, _ in _blocks(batches, len(books)):
            t, c = tree.sums(books)
            total += t
            count += c
        place = np.nonzero(np.broadcast_to(count[:, :, None] > 0, books.shape))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(p.astype(np.int32)) for p in place), pa.array(total[place]), pa.array(count[place[0], place[1]])],
            names=["part", "entry", "place", "total", "n"])
    return add


def coder(books: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's code and error."""
    hexes = [f"{i:02x}" for i in range(books.shape[1])]

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, orders, b, i in _blocks(batches, len(books)):
            codes, error = tree.codes(books, orders)
            text = ["".join(map(hexes.__getitem__, c)) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(text), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])
    return code


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the ``entries`` rows with the smallest ids; None where there is no row."""
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    if not len(first):
        return None
    vectors = first["vector"].combine_chunks()
    dims = vectors.value_lengths().unique().to_pylist()
    if len(dims) > 1 or dims[0] % parts or not dims[0]:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts by one rule")
    x = whole(vectors, dims[0])
    return x.reshape(len(x), parts, -1).swapaxes(0, 1).copy()


def refined(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds; an entry that nothing is nearest to stays."""
    for _ in range(rounds):
        got = (trees.select("dim", "vectors", "orders", *NODES)
               .mapInArrow(summer(books), "part int, entry int, place int, total long, n long")
               .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow())
        at = tuple(got[c].to_numpy() for c in ("part", "entry", "place"))
        books = books.copy()
        books[at] = got["total"].to_numpy() // got["n"].to_numpy()
    return books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over the rows of equal label (nulls together)."""
    rows = coded.count()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    hot = sums.where(F.col("__n") * HOT > rows).select(F.col("label").alias("__hot"), F.col("label_error").alias("__hot_error"))
    rest = sums.where(F.col("__n") * HOT <= rows).select(F.col("label").alias("__label"), "label_error")
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("__hot")), "left")
    done = marked.where("__hot_error IS NOT NULL").withColumn("label_error", F.col("__hot_error"))
    others = marked.where("__hot_error IS NULL").join(rest, F.col("label").eqNullSafe(F.col("__label")))
    keep = [*coded.columns, "label_error"]
    return done.select(*keep).unionByName(others.select(*keep))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id",
               vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every usable row, and the codebooks."""
    rows = vector_rows(df, F.col(f"`{label}`").alias("label"), vec_id=vec_id, vector=vector)
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    books = first_books(rows, parts, entries)
    if books is None:
        return df.sparkSession.createDataFrame([], schema), None
    trees = stored(trees_of(rows, parts), "vector-trees")
    books = refined(trees, books, rounds)
    return trees.mapInArrow(coder(books), schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's code, error, label's error and the codebooks' digest."""
    small_batches(spark)
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    digest = "" if books is None else books_sha256(books)
    return (with_label_error(stored(coded, "vector-codes"))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _sql_round(i: int) -> str:
    """The entries nearest to every part by codebook ``i``, and the codebook after it."""
    return f"""
near{i} AS (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d)::BIGINT AS d
  FROM (SELECT p.row, part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) ** 2)) AS d
        FROM parts p JOIN books{i} b USING (part)) GROUP BY row, part),
means{i} AS (
  SELECT part, entry, list(mean ORDER BY place) AS x
  FROM (SELECT part, entry, place, floor(sum(value)::DOUBLE / count(*))::BIGINT AS mean
        FROM (SELECT part, n.entry, unnest(p.x) AS value, generate_subscripts(p.x, 1) AS place
              FROM near{i} n JOIN parts p USING (row, part)) GROUP BY ALL) GROUP BY ALL),
books{i + 1} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM books{i} b LEFT JOIN means{i} m USING (part, entry)),"""


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, part, e[part * (len(e) // {PARTS}) + 1:(part + 1) * (len(e) // {PARTS})] AS x
          FROM kept, (SELECT unnest(range({PARTS})) AS part)),
books0 AS (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {ENTRIES}),{_sql_round(0)}{_sql_round(1)}{_sql_round(2)}
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row) CROSS JOIN digest
"""
