"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (an item of
fewer words is one window), every window into shingles of ``SHINGLE`` words (single
words for windows shorter than that). A window can only occur in a document that holds
its rarest shingle, so that shingle is the whole prefix that has to be joined:

1. One pass over all documents counts how often the benchmark's shingles occur in the
   corpus; that is the rarity order.
2. Each window is keyed by its rarest shingle (the *prefix*) and the shingle's offset.
3. A second pass emits, for each occurrence of a prefix shingle, its position and the
   few words around it. Both passes drop other shingles by a bitmap of fixed size; it
   may let a wrong shingle through, which the join then drops, but misses none.
4. Occurrences join the windows on the prefix. Offset and length must fit the
   document (positional and length bounds), and the window's words must be the
   document's words there, compared as text.

Broadcast: two bitmaps of ``2**BITMAP_BITS`` bits (512 KB each) whatever the
benchmark's size; windows and occurrences are joined by a shuffle or, where Spark has
measured the windows to be small, a broadcast. Prefix occurrences are few rows for each
contaminated passage, so a passage that a third of all documents share costs a few rows
a document, and skewed prefixes are split by AQE's skew join.

Defined results: null and empty texts have no words and no hits; items without words or
with a null ``item_id`` are not used; items that share an ``item_id`` are one item of
several texts; repeated documents, also with one ``doc_id``, get a row each (rows of one
id and one text are alike); an empty benchmark leaves every document clean; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import WordHashes, batches_of, doc_bytes, gram_hashes, released, rows_of, small_batches, stored, table

WINDOW, SHINGLE = 10, 5
BITMAP_BITS = 22
#: Lower-cases A-Z and turns every other ASCII character but a-z and 0-9 into a space.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: DataFrame, width: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """item_id, the window's words as text, their number, the shingles with offsets."""
    def cut(batches):
        hashes = WordHashes()

        def rows():
            for item, text in rows_of(batches, "doc_id", "text"):
                words = words_of(text)
                h = hashes.of(words)
                for s in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[s:s + width]
                    grams = gram_hashes(h[s:s + len(part)], k if len(part) >= k else 1)
                    yield item, b" ".join(part).decode(), len(part), grams.view(np.int64).tolist()

        yield from batches_of(rows(), pa.schema([("item_id", pa.int64()), ("win", pa.string()), ("len", pa.int32()),
                                                 ("grams", pa.list_(pa.int64()))]), 500)

    return (doc_bytes(items, doc_id="item_id").where("doc_id is not null")
            .mapInArrow(released(cut), "item_id long, win string, len int, grams array<long>"))


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """The set of hashes as a bitmap of ``2**bits`` bits: built by one aggregate, and at
    most ``2**bits / 32`` rows come to the driver."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    got = (hashes.select(F.shiftright(at, 5).cast("int").alias("at"),
                         F.expr(f"shiftleft(1L, cast({column} & 31L as int))").alias("bit"))
           .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas())
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _lookup(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[(grams & np.uint64(len(bits) - 1)).astype(np.int64)])


def rarity(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Corpus counts of the shingles that the bitmap holds, added up in each task first."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        hashes, seen = WordHashes(), {}
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        for (text,) in rows_of(batches, "text"):
            h = hashes.of(words_of(text))
            for k in sizes:
                grams = gram_hashes(h, k)
                for g in grams[_lookup(sent.value, grams)].view(np.int64).tolist():
                    seen[g] = seen.get(g, 0) + 1
            if len(seen) > 200_000:
                yield from batches_of(seen.items(), schema, 50_000)
                seen = {}
        yield from batches_of(seen.items(), schema, 50_000)

    return (doc_bytes(docs).select("text").mapInArrow(released(count), "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def occurrences(docs: DataFrame, bits: np.ndarray, sizes: list[int], width: int = WINDOW) -> DataFrame:
    """doc_id, a hash of the text, n_words, and where prefix shingles occur, with the
    words from ``width`` before to ``width`` after."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    place = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("near", pa.string())]))

    def find(batches):
        hashes = WordHashes()

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                words = words_of(text)
                h = hashes.of(words)
                found = []
                for k in sizes:
                    grams = gram_hashes(h, k)
                    for p in _lookup(sent.value, grams).tolist():
                        first = max(0, p - width)
                        found.append({"gram": int(grams[p].view(np.int64)), "at": p, "first": first,
                                      "near": b" ".join(words[first:p + width]).decode()})
                yield doc_id, xxhash.xxh3_64_intdigest(text) - (1 << 63), len(words), found

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("version", pa.int64()),
                                                 ("n_words", pa.int64()), ("found", place)]))

    return doc_bytes(docs).mapInArrow(
        released(find), "doc_id long, version long, n_words long, "
              "found array<struct<gram:long,at:int,first:int,near:string>>")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = stored(windows(items, width, k), "bench-windows")
    sizes = sorted({k if r["len"] >= k else 1 for r in wins.select("len").distinct().collect()})
    grams = wins.select(F.explode("grams").alias("gram")).distinct()
    counts = stored(rarity(docs, bitmap(grams, "gram"), sizes), "bench-rarity") if sizes else None
    if not sizes:
        prefixes, bits = None, np.zeros(1 << BITMAP_BITS, bool)
    else:
        one = wins.groupBy("win", "len", "grams").agg(F.count("*").alias("n_items"))
        offs = one.select("win", "len", F.posexplode("grams").alias("off", "gram"))
        prefixes = stored(
            offs.join(counts, "gram").groupBy("win", "len")
            .agg(F.min(F.struct("n", "gram", "off")).alias("best"), F.count("*").alias("present"))
            # a window one of whose shingles never occurs can't occur either
            .where(F.col("present") == F.greatest(F.col("len") - k + 1, F.when(F.col("len") < k, F.col("len")).otherwise(1)))
            .select("win", "len", F.col("best.gram").alias("gram"), F.col("best.off").alias("off")), "bench-prefixes")
        bits = bitmap(prefixes.select("gram"), "gram")
    seen = stored(occurrences(docs, bits, sizes or [k], width), "prefix-occurrences")
    out = seen.select("doc_id", "version", "n_words")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    if prefixes is None:
        return out.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                          empty.alias("items_sha256"), F.lit(False).alias("contaminated"))
    occ = (seen.where(F.size("found") > 0)
           .select("doc_id", "version", "n_words", F.explode("found").alias("f"))
           .select("doc_id", "version", "n_words", "f.*"))
    start = F.col("at") - F.col("off")
    hits = (occ.join(prefixes, "gram")
            .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
            .where(F.array_join(F.slice(F.split("near", " "), start - F.col("first") + 1, F.col("len")), " ") == F.col("win"))
            .select("doc_id", "version", start.alias("start"), "len", "win"))
    hits = stored(hits.distinct(), "bench-hits")
    by_doc = "partition by doc_id, version order by start, until rows between unbounded preceding and 1 preceding"
    spans = (hits.select("doc_id", "version", "start", (F.col("start") + F.col("len")).alias("until")).distinct()
             .withColumn("before", F.expr(f"coalesce(max(until) over ({by_doc}), 0)"))
             .groupBy("doc_id", "version")
             .agg(F.sum(F.greatest(F.lit(0), F.col("until") - F.greatest("start", "before"))).cast("long").alias("n_hit")))
    named = (hits.select("doc_id", "version", "win").distinct()
             .join(wins.select("win", "item_id").distinct(), "win")
             .select("doc_id", "version", "item_id").distinct()
             .groupBy("doc_id", "version")
             .agg(F.count("*").alias("n_items"),
                  F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").cast("binary"),
                         256).alias("items_sha256")))
    found = (spans.alias("s").join(named.alias("n"), F.expr("s.doc_id <=> n.doc_id and s.version = n.version"))
             .select(F.col("s.doc_id").alias("__id"), F.col("s.version").alias("__version"), "n_hit", "n_items", "items_sha256"))
    return (out.join(found, F.expr("doc_id <=> __id and version = __version"), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.coalesce("items_sha256", empty).alias("items_sha256"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """Those rows of ``docs``, with all their columns, without a benchmark window. Rows that
    share a doc_id are one document: one contaminated text takes them all out."""
    found = contamination(docs, items, width, k).where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    small_batches(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
numbered AS (SELECT row_number() OVER () AS r, doc_id, w FROM lower_docs),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM numbered, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item_id FROM places JOIN wins USING (win, n)),
words_hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits))
  GROUP BY r),
items_hit AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""
