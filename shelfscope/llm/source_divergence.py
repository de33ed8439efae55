"""Audit of how far the sources of a language differ in the terms they use.

**Terms** are runs of letters (A to Z in either case, and everything outside ASCII), A to Z
lower-cased. A language keeps the terms that at least ``min_docs`` of its documents hold.
For a group (a language's source, or the whole language) a kept term's weight is
p = 1 + floor(10^9 (c + 1) / (N + V)), with c its count there, N all of the group's and V
the language's kept terms; a group's divergence from another in a term is
f = floor((p - q)^2 / q). All arithmetic is on whole numbers.

**Vectors.** ``document_vectors`` turns the documents of an Arrow batch into exact sparse
vectors (term's number in the batch's vocabulary, count), as a count vectoriser with a
minimum document frequency and no limit on its vocabulary does. A task adds its vectors up
by group, entry by entry, each with the number of documents that it is not zero in, and
sends the sums on whenever it holds ``HELD`` of them. Sums and document frequencies are
finished by one shuffle on language and term, after which terms below ``min_docs`` go. The
vocabulary is the resulting table: no driver or task holds it whole. (``pyspark.ml``'s own
estimator gathers it on the driver; the vectors are held against that one in the tests.)

**Pairs.** With z a group's weight of a term it lacks, the sum of f over all kept terms is
V f(z, z') + the sums over either group's own terms of what they add to that alone, which
need only the number of terms of each count, + the sum over the terms that both hold of
f(p, q) - f(p, z') - f(z, q) + f(z, z'). Only the last one looks at pairs, for each term at
those of the sources that hold it, from rows sorted by term, so many at a time; these are
added up before they are shuffled. All pairs of a language's sources are in the result, so
their number is no more than the result's. This module broadcasts nothing itself, and
collects nothing.

Defined results: a null text, language or source is the empty one; a text without terms
counts as a document without any; each row is a document, whatever its id, so repeated
rows count as often as they occur; a language without kept terms has pairs of value 0; a
language with one source has no pairs; equal values are ordered by the item's UTF-8 bytes;
an empty table gives an empty result. Columns of the caller other than the three named
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import small_batches, stored, table

MIN_DOCS, TOP_TERMS = 3, 200
ONE = 1_000_000_000
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of a term's sources that are evaluated at once; entries of group sums, and terms, that a task holds.
PAIRS, HELD, WORDS = 1 << 20, 1 << 20, 1 << 19

SUMS = pa.schema([("tongue", pa.int64()), ("term", pa.string()), ("group", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())])


def document_vectors(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of some texts, and their vectors' entries that aren't zero: place of the
    text, number of the term, count, ordered by text and term."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BREAK)
    terms, of = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(terms), 0)
    words = terms.filter(there).dictionary_encode()
    size = max(len(words.dictionary), 1)
    entry, count = np.unique(of.filter(there).to_numpy().astype(np.int64) * size + words.indices.to_numpy(), return_counts=True)
    return words.dictionary, entry // size, entry % size, count


class GroupSums:
    """Vectors added up by group, over a vocabulary that grows from batch to batch."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, group: np.ndarray, tongue: np.ndarray, text: pa.Array) -> None:
        words, doc, term, count = document_vectors(text)
        number = np.fromiter((self.words.setdefault(w, len(self.words)) for w in words.to_pylist()), np.int64, len(words))
        rows = _added(np.stack([group[doc], tongue[doc], number[term], count, np.ones_like(count)]))
        self.held.append(rows)
        self.size += rows.shape[1]
        if self.size > HELD:
            self.held = [_added(np.concatenate(self.held, axis=1))]
            self.size = self.held[0].shape[1]

    def full(self) -> bool:
        return self.size > HELD // 2 and len(self.held) == 1 or len(self.words) > WORDS

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows = _added(np.concatenate(self.held, axis=1)) if self.held else np.empty((5, 0), np.int64)
        words = pa.array(list(self.words), pa.string())
        self.__init__()
        for at in range(0, rows.shape[1], 1 << 16):
            group, tongue, term, n, docs = rows[:, at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(tongue), words.take(pa.array(term)), pa.array(group), pa.array(n),
                                              pa.array(docs)], schema=SUMS)


def _added(rows: np.ndarray) -> np.ndarray:
    """Columns that are alike in the first three rows made one, the last two rows added up."""
    order = np.lexsort(rows[2::-1])
    rows = rows[:, order]
    first = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])[:rows.shape[1]])
    return np.concatenate([rows[:3, first], np.add.reduceat(rows[3:], first, axis=1)]) if len(first) else rows


def group_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = GroupSums()
    for b in batches:
        sums.add(b.column("group").to_numpy(), b.column("tongue").to_numpy(), b.column("text"))
        if sums.full():
            yield from sums.taken()
    yield from sums.taken()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """tongue, term, group, n, lang_n: the occurrences of the kept terms in each group and in
    its language, for rows of group, tongue (its language's number), text."""
    w = Window.partitionBy("tongue", "term")
    return (docs.select("group", "tongue", "text")
            .mapInArrow(group_sums, "tongue long, term string, group long, n long, docs long")
            .repartition("tongue", "term").groupBy("tongue", "term", "group").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("lang_n", F.sum("n").over(w)).withColumn("lang_docs", F.sum("docs").over(w))
            .where(F.col("lang_docs") >= min_docs).select("tongue", "term", "group", "n", "lang_n"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def weight(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total) by long division, three decimal digits at a time, so
    that no product leaves 64 bits; 1 where the total is 0."""
    out, rest, by = F.lit(1).cast("long"), n + 1, F.when(total > 0, total)
    for unit in (1_000_000, 1_000, 1):
        out, rest = out + div(rest * 1000, by) * unit, (rest * 1000) % by
    return F.coalesce(out, F.lit(1).cast("long"))


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def common_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by language and term: for each ordered pair of groups, the sum over
    the terms that both hold of f(p, q) - f(p, z') - f(z, q) + f(z, z')."""
    rest = None
    for b in batches:
        b = pa.Table.from_batches([b])
        rows = (b if rest is None else pa.concat_tables([rest, b])).combine_chunks()
        if not len(rows):
            continue
        change = _starts(rows)
        yield from _pairs(rows.slice(0, change[-1]), change[:-1])
        rest = rows.slice(change[-1])
    if rest is not None:
        yield from _pairs(rest.combine_chunks(), np.zeros(1, np.int64))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where each term's rows begin."""
    term, tongue = rows["term"].combine_chunks(), rows["tongue"].to_numpy()
    differs = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], differs | (tongue[1:] != tongue[:-1])]))


def _pairs(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    group, p, z = (rows[c].to_numpy() for c in ("group", "p", "z"))
    size = np.diff(np.append(start, len(group)))
    names, local = np.unique(group, return_inverse=True)
    many, first = np.repeat(size, size), np.repeat(start, size)  # partners of a row, itself included; its term's first row
    ends = np.cumsum(many)
    at = 0
    while at < len(group):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        m = many[at:to]
        a = np.repeat(np.arange(at, to), m)
        c = np.arange(len(a)) - np.repeat(np.cumsum(m) - m - first[at:to], m)
        a, c = a[a != c], c[a != c]
        value = divergences(p[a], p[c]) - divergences(p[a], z[c]) - divergences(z[a], p[c]) + divergences(z[a], z[c])
        pairs, place = np.unique(local[a] * len(names) + local[c], return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, value)
        yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]),
                                          pa.array(total)], names=["group", "other", "value"])
        at = to


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                       for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    names = stored(docs.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()), "divergence-groups")
    names = names.withColumn("tongue", F.min("group").over(Window.partitionBy("lang")))
    counts = stored(term_counts(docs.join(names, ["lang", "source"]), min_docs), "divergence-counts")
    totals = names.join(counts.groupBy("group").agg(F.sum("n").alias("total")), "group", "left").fillna(0, "total")
    kept = counts.groupBy("tongue", "term").agg(F.min("lang_n").alias("lang_n")).groupBy("tongue").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = stored(totals.join(kept, "tongue", "left").fillna(0, ["kept", "lang_total"])
                    .withColumn("z", weight(F.lit(0).cast("long"), F.col("total") + F.col("kept"))), "divergence-totals")
    held = (counts.join(groups.drop("tongue"), "group").withColumn("p", weight(F.col("n"), F.col("total") + F.col("kept")))
            .withColumn("q", weight(F.col("lang_n"), F.col("lang_total") + F.col("kept"))))

    # what each pair has if both hold nothing, what either one's own terms add, what common terms add
    two = groups.select("lang", F.col("group").alias("other"), F.col("z").alias("y"))
    nothing = groups.join(two, "lang").where("group <> other").select(
        "group", "other", (F.col("kept") * divergence(F.col("z"), F.col("y"))).alias("value"))
    own = held.groupBy("lang", "group", "z", "p").agg(F.count("*").alias("k")).join(two, "lang").where("group <> other")
    p, z, y, k = (F.col(c) for c in "pzyk")
    here = own.select("group", "other", (k * (divergence(p, y) - divergence(z, y))).alias("value"))
    there = own.select(F.col("other").alias("group"), F.col("group").alias("other"),
                       (k * (divergence(y, p) - divergence(y, z))).alias("value"))
    common = (held.select("tongue", "term", "group", "p", "z").repartition("tongue", "term").sortWithinPartitions("tongue", "term")
              .mapInArrow(common_terms, "group long, other long, value long"))
    values = nothing.union(here).union(there).union(common).groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = values.join(names.select(F.col("group").alias("other"), F.col("source").alias("item")), "other").select(
        "group", F.lit("pair").alias("part"), "item", "value")

    terms = held.where("p > q").select("group", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       divergence(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("group").orderBy(F.desc("value"), "item")
    ranked = (pairs.withColumn("rank", F.row_number().over(w))
              .unionByName(terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_terms)))
    return ranked.join(names, "group").select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the others of its language, and the terms it uses most above it."""
    small_batches(spark)
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(string_split_regex(text, '{BREAK}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
langs AS (SELECT lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0) AS lang_total
          FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept k USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT d.lang, d.source, coalesce(sum(c.n), 0) AS total
           FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN counts c ON c.lang = d.lang AND c.source = d.source GROUP BY ALL),
weights AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + {ONE}::HUGEINT * (coalesce(c.n, 0) + 1) // (total + v) AS p,
         1 + {ONE}::HUGEINT * (lang_n + 1) // (lang_total + v) AS q
  FROM totals t JOIN langs USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) FROM weights x JOIN weights y USING (lang, term)
          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM weights WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
