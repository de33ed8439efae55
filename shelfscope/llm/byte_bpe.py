"""Byte-level BPE encoding and decoding with DuckDB queries inside each partition.

Texts are cut by the tokenizer's pattern. The distinct pieces that a worker hasn't met
yet become token-position rows, one for each byte; a recursive query joins neighbouring
rows with the merge table, contracts each piece's leftmost pair of least rank and
goes on until no piece has a pair left. Pieces of more than ``SHORT`` bytes have a
query of their own: where the pair's product can't be half of a pair of a lesser rank
(a fact of the vocabulary, found once), its other places in the piece are contracted
in the same step. That gives the same result in as many steps as a piece has distinct
merges, so a piece of a hundred thousand letters ends too. A piece that is a
token as a whole is that token, as in the public tokenizer library. Decoding joins ids
with the vocabulary and aggregates the bytes in order; ``round_trip`` does so once for
each distinct run of ids that a piece was encoded to, and a text is its runs in order.

Each task works on its own rows; there is no shuffle and nothing is sent but the
tokenizer's path. The vocabulary is read from the installed tokenizer files on each
worker. Memory: one slice of texts (``Bounds.slice_bytes`` or one text), ``Bounds.room``
remembered pieces and half as many runs, and a DuckDB instance under ``MEMORY``.

Defined results: a null or empty text has no tokens and decodes to nothing; a null
``doc_id`` is carried; special tokens' strings are ordinary text; rows alike get like
results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm.common import KEPT, batches_of, doc_bytes, give_back, released, small_batches, table

SHORT = 255
MEMORY = "150MB"


class Bounds(NamedTuple):
    """What a worker holds at once; the results don't depend on it."""

    #: Bytes of the texts that are cut into pieces together.
    slice_bytes: int = 4 << 20
    #: Remembered pieces.
    room: int = 700_000
    #: New pieces of one query.
    new: int = 50_000


#: For workers beside a JVM that long jobs have left little room: smaller slices and queries, and pieces are met anew.
LEAN = Bounds(1 << 18, 100_000, 4_000)


#: start(w, pos, tok) -> the tokens of each piece, for pieces of up to ``SHORT`` bytes: one
#: contraction a step. ``k`` packs piece and place; ``best`` packs the least rank and its leftmost place.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT w::BIGINT << 8 | pos AS k, tok, false AS done FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT k, tok, before, merges.m::BIGINT << 8 | (k & 255) AS pair
     FROM (SELECT k, tok, CASE WHEN ((lead(k) OVER line) >> 8) = (k >> 8) THEN lead(tok) OVER line END AS nxt,
                  coalesce(lag(k) OVER line, -1) AS before
           FROM state WHERE NOT done WINDOW line AS (ORDER BY k)) q
     LEFT JOIN merges ON merges.l = q.tok AND merges.r = q.nxt),
   least AS (SELECT k >> 8 AS w, min(pair) AS best FROM p GROUP BY k >> 8)
   SELECT k, CASE WHEN (best & 255) = (k & 255) THEN (best >> 8)::INTEGER ELSE tok END, best IS NULL
   FROM p JOIN least ON least.w = (k >> 8)
   WHERE best IS NULL OR before <> ((w << 8) | (best & 255))))
SELECT (k >> 8)::INTEGER AS w, tok FROM state WHERE done ORDER BY k
"""

#: The same for longer pieces: all places of a pair whose product is safe go in one step.
#: ``hit`` marks the left half of a pair that is contracted in this step, ``gone`` the right half.
CONTRACT_LONG = """
WITH RECURSIVE state AS (
  SELECT w, pos, tok, false AS done FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN best ELSE tok END, best IS NULL
  FROM (
    SELECT *, coalesce(lag(hit) OVER line, false) AS gone
    FROM (
      SELECT *, coalesce(m = best AND CASE
                  WHEN NOT safe THEN n = min(n) FILTER (m = best) OVER (PARTITION BY w)
                  WHEN tok = nxt THEN (n - max(first_of_run) OVER line) % 2 = 0
                  ELSE true END, false) AS hit
      FROM (
        SELECT *, CASE WHEN m = best AND coalesce(lag(m) OVER line, -1) <> best THEN n END AS first_of_run
        FROM (
          SELECT p.*, merges.m, merges.safe, min(merges.m) OVER (PARTITION BY w) AS best
          FROM (SELECT w, pos, tok, lead(tok) OVER line AS nxt, row_number() OVER line AS n
                FROM state WHERE NOT done WINDOW line AS (PARTITION BY w ORDER BY pos)) p
          LEFT JOIN merges ON merges.l = p.tok AND merges.r = p.nxt)
        WINDOW line AS (PARTITION BY w ORDER BY pos))
      WINDOW line AS (PARTITION BY w ORDER BY pos))
    WINDOW line AS (PARTITION BY w ORDER BY pos))
  WHERE NOT gone)
SELECT w, tok FROM state WHERE done ORDER BY w, pos
"""

#: coded(r, i, tok) -> the bytes of each r in the order of i, a character for each byte.
DECODE = """
SELECT r, string_agg(vocabulary.chars, '' ORDER BY i) AS chars FROM coded JOIN vocabulary ON vocabulary.id = tok GROUP BY r
"""


class Bpe:
    """A tokenizer file of ranks: its vocabulary and merges as DuckDB tables."""

    def __init__(self, path: str, pattern: str, bounds: Bounds = Bounds()):
        self.bounds = bounds
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        #: Pieces of late, and those of the time before; what neither has is encoded anew.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Runs of ids and their bytes.
        self.spelled: dict[bytes, bytes] = {}
        #: The distinct runs of the texts encoded last.
        self.latest: set[bytes] = set()
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))
        left, right, made, unsafe = [], [], [], set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
                    unsafe.update(x for x in (a, b) if rank < x)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.execute("SET allocator_flush_threshold = '8MB'")
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), m=pa.array(made, pa.int32()),
                    safe=pa.array([m not in unsafe for m in made]))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()),
                    chars=pa.array([t.decode("latin-1") for t in self.ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, sql: str, name: str, given: pa.Table) -> pa.Table:
        self.db.register(name, given)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known yet, by one recursive query."""
        whole = [p.encode() for p in pieces]
        short, long = [], []
        for p, b in zip(pieces, whole, strict=True):
            rank = self.ranks.get(b)
            if rank is None:
                (short if len(b) <= SHORT else long).append((p, b))
            else:
                self.known[p] = rank.to_bytes(4, "little")
        for sql, some in ((CONTRACT, short), (CONTRACT_LONG, long)):
            if some:
                self._contract(sql, some)

    def _contract(self, sql: str, pieces: list[tuple[str, bytes]]) -> None:
        size = np.fromiter((len(b) for _, b in pieces), np.int64, len(pieces))
        start = pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), size),
                          "pos": (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32),
                          "tok": self.byte[np.frombuffer(b"".join(b for _, b in pieces), np.uint8)]})
        done = self._ask(sql, "start", start)
        ids = done.column("tok").to_numpy().astype("<u4").tobytes()
        ends = (4 * np.searchsorted(done.column("w").to_numpy(), np.arange(len(pieces) + 1))).tolist()
        self.known.update((p, ids[a:b]) for (p, _), a, b in zip(pieces, ends, ends[1:], strict=False))

    def runs(self, texts: list[bytes]) -> list[list[bytes]]:
        """The ids of each text's pieces as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t.decode("utf-8", "replace")) for t in texts]
        pieces = set().union(*cut)
        if len(self.known) + len(pieces) > self.bounds.room // 2:
            self.older, self.known = self.known, {}
        new = []
        for p in pieces:
            if p in self.known:
                continue
            if p in self.older:
                self.known[p] = self.older[p]
            else:
                new.append(p)
        for s in range(0, len(new), self.bounds.new):
            self.learn(new[s:s + self.bounds.new])
        self.latest = set(map(self.known.__getitem__, pieces))
        return [list(map(self.known.__getitem__, c)) for c in cut]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return list(map(b"".join, self.runs(texts)))

    def spell(self, runs: list[list[bytes]]) -> list[bytes]:
        """The bytes of each list of runs of the texts encoded last; runs that aren't known yet
        are decoded first."""
        distinct = self.latest
        if len(self.spelled) + len(distinct) > self.bounds.room // 2:
            self.spelled.clear()
        new = [r for r in distinct if r not in self.spelled]
        for s, e in _slices([len(r) // 4 for r in new], self.bounds.slice_bytes // 8):
            # one line of ids for all, cut again by the tokens' sizes: an aggregate of few groups
            ids = np.frombuffer(b"".join(new[s:e]), "<u4").astype(np.int32)
            text = self.decode([ids])[0]
            ends = np.cumsum(np.append(0, self.size[ids]))[np.cumsum([0, *(len(r) // 4 for r in new[s:e])])].tolist()
            self.spelled.update((r, text[a:b]) for r, a, b in zip(new[s:e], ends, ends[1:], strict=False))
        return [b"".join(map(self.spelled.__getitem__, r)) for r in runs]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids."""
        size = [len(x) for x in ids]
        coded = pa.table({"r": np.repeat(np.arange(len(ids), dtype=np.int32), size),
                          "i": np.arange(sum(size), dtype=np.int64),
                          "tok": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)})
        out = [b""] * len(ids)
        got = self._ask(DECODE, "coded", coded)
        for r, text in zip(got.column("r").to_pylist(), got.column("chars").to_pylist(), strict=True):
            out[r] = text.encode("latin-1")
        return out


@functools.lru_cache(maxsize=1)
def _loaded(path: str, pattern: str, bounds: Bounds = Bounds()) -> Bpe:
    """One tokenizer for each worker process; a worker's later tasks go on with it."""
    return Bpe(path, pattern, bounds)


#: Tables, texts' pieces and ranks stay only while a worker has tasks of this operator.
KEPT.append(_loaded.cache_clear)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of at most ``most`` in all, or of one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids of the text, ``array<int>``."""
    found = default_tokenizer()
    path, pattern = path or found[0], pattern or found[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            for s, e in _slices([len(t) for t in texts], bpe.bounds.slice_bytes):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts[s:e])]
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s, e - s), pa.ListArray.from_arrays(at, np.concatenate(ids))],
                    names=["doc_id", "ids"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes of an ``encoded`` table."""
    found = default_tokenizer()
    path, pattern = path or found[0], pattern or found[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            for s, e in _slices([len(x) for x in b.column("ids")], bpe.bounds.slice_bytes // 8):
                part = b.slice(s, e - s)
                ids = [x.values.to_numpy(zero_copy_only=False) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"),
                                                  pa.array(bpe.decode(ids), pa.binary())],
                                                 names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: bool = True) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded bytes: ``encoded`` and
    ``decoded`` in one pass, so that a task has one Python worker and no ids travel. Unless
    told to ``keep`` tables and pieces for its next task, an idle worker holds none, and a
    busy one keeps within ``LEAN``."""
    found = default_tokenizer()
    path, pattern = path or found[0], pattern or found[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        bpe = _loaded(path, pattern, Bounds() if keep else LEAN)

        def rows():
            for b in batches:
                texts, doc_ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                for s, e in _slices([len(t) for t in texts], bpe.bounds.slice_bytes):
                    runs = bpe.runs(texts[s:e])
                    for i, (coded, text) in enumerate(zip(map(b"".join, runs), bpe.spell(runs), strict=True), s):
                        yield (doc_ids[i], len(coded) // 4, hashlib.sha256(coded).hexdigest(),
                               hashlib.sha256(text).hexdigest())
                    if not keep:
                        give_back()
            bpe.older.clear()  # what a worker keeps between tasks
            bpe.spelled.clear()
            bpe.latest = set()
            if not keep:
                _loaded.cache_clear()
            give_back()

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                                                 ("decoded_sha256", pa.string())]))

    return doc_bytes(docs).mapInArrow(run if keep else released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(both: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and bytes of a ``decoded`` table."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc_id, ids, text in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("decoded").to_pylist(),
                                             strict=True):
                    ids = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                    yield doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                                                 ("decoded_sha256", pa.string())]))

    return both.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    small_batches(spark)
    return round_trip(table(spark, sf_dir, "documents"))
