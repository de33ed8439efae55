"""Personal data: base spans and information-theoretic sanitisation, in SQL functions.

*Base spans.* E-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, found
by linear-time forms of the stated patterns: a match can only begin where a run of its
characters begins or where the last match ended, so possessive runs behind a look-behind
find the same leftmost matches without trying each place of a long run.

*Disclosure.* For a kind of personal data, lines are the contexts. Over all lines of the corpus, with ``N`` lines, a
kind of personal data in ``n_k`` of them, a term in ``n_t`` and both in ``n_tk``, the
share of the kind's information that the term gives away is
``log(N * n_tk / (n_t * n_k)) / log(N / n_k)``: pointwise mutual information against
the kind's own information, 1 where the term never occurs without the kind. Terms are
words of letters outside base spans that occur with the kind ``SUPPORT`` times at least.
The same share is taken for each protected value (one address, one number), with documents
as the contexts: there ``n_tk`` counts the documents in which the term stands within ``REACH``
characters of the value, on its line or another one, in ``VALUE_SUPPORT`` different texts at
least. Terms that reach ``GENERALISE`` for a kind or a value become a general label, and
those that reach ``REMOVE`` go, wherever they occur outside base spans, also in texts
without personal data; they are the added ``term`` spans.

Everything is DataFrame functions. The text scan needs no shuffle; word counts are
added up in each task before they move; only the texts that hold personal data or a term
are cut into word rows with places, keyed by document and version of its text, so a row's
group is one document. Broadcast by hint are the four kinds' counts and the hash buckets,
``TERM_BUCKETS`` at most, by which the words and texts with a term are chosen before they move.

Defined results: null and empty texts have no spans; a null ``doc_id`` is carried; rows
alike in id and text are counted as often as they occur and get like results; equal starts
can't occur within a kind; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a scan.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}{2,}"
SUPPORT, GENERALISE, REMOVE = 5, 0.8, 0.95
VALUE_SUPPORT, REACH = 2, 120
TERM_BUCKETS = 1 << 18
#: Bytes of texts, in the mean, that a task cuts into word rows and orders: its rows take many times as much.
WORDS_BYTES = 2 << 20


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    backwards = F.reverse(digits)
    doubled = F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(backwards, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.element_at(doubled, d + 1))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))
        return F.forall(F.split(m, "[.]"), small)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """The valid spans of a kind: array of (kind, start, until), in text order. Places are
    summed up from the lengths of the matches and of what lies between them."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    place = "struct<end:int,spans:array<struct<kind:int,start:int,until:int,ok:boolean>>>"
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<kind:int,start:int,until:int,ok:boolean>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["end"] + F.length(x["gap"])
        until = start + F.length(x["m"])
        here = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), until.alias("until"),
                        _valid(kind, x["m"]).alias("ok"))
        return F.struct(until.alias("end"), F.concat(acc["spans"], F.array(here)).alias("spans")).cast(place)

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    spans = F.filter(F.aggregate(pairs, zero.cast(place), step)["spans"], lambda s: s["ok"])
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["until"].alias("until")))
    none = F.array().cast("array<struct<kind:int,start:int,until:int>>")
    return F.when(F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){12}"),
                  spans).otherwise(none)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), the text where it holds personal data, and
    all base spans by kind and start."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (d.select("doc_id", F.xxhash64("text").alias("version"), "text",
                     F.concat(*(kind_spans(F.col("text"), k) for k in KINDS)).alias("spans"))
            .withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))


def line_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, n_t) over all lines, and the one row (n_lines)."""
    lines = (docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "\n")).alias("line"))
             .where(F.col("line").rlike(r"\S")))
    terms = (lines.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("n_t")))
    return terms, lines.agg(F.count("*").alias("n_lines"))


def placed(held: DataFrame, kept: Column | None = None) -> DataFrame:
    """A row for each word of the texts, one of each doc_id and version: the other columns,
    term (or what is ``kept`` of the word), line, start, until."""
    word, gap = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    more = [c for c in held.columns if c not in ("doc_id", "version", "text")]
    rows = held.select("doc_id", "version", *more, F.posexplode(F.arrays_zip(word.alias("word"), gap.alias("gap"))).alias("i", "w"))
    # only lengths move
    rows = rows.select("doc_id", "version", *(more if kept is None else []), "i",
                       (F.lower("w.word") if kept is None else kept).alias("term"), F.length("w.word").alias("size"),
                       (F.length("w.gap") + F.coalesce(F.length("w.word"), F.lit(0))).alias("length"),
                       (F.length("w.gap") - F.length(F.replace(F.col("w.gap"), F.lit("\n"), F.lit("")))).alias("breaks"))
    upto = W.partitionBy("doc_id", "version").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return (rows.withColumn("until", F.sum("length").over(upto).cast("int")).withColumn("line", F.sum("breaks").over(upto).cast("int"))
            .where("size is not null and term is not null").withColumn("start", F.col("until") - F.col("size"))
            .drop("i", "size", "length", "breaks"))


def words_near(found: DataFrame) -> DataFrame:
    """The words outside base spans of the lines that hold base spans, or within ``REACH`` of
    one: doc_id, version, copies (rows alike), line, kinds of the line, values within reach,
    term, start, until."""
    held = found.where(F.size("spans") > 0)
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = (held.repartition(math.ceil(size / WORDS_BYTES) or 1, "doc_id", "version").groupBy("doc_id", "version")
            .agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans")))
    # of each span: the line it begins in, and what it protects
    digits = F.array(*(F.lit(k in ("card", "phone")) for k in KINDS))

    def value(s: Column) -> Column:
        m = F.substr("text", s["start"] + 1, s["until"] - s["start"])
        return F.concat_ws(":", s["kind"].cast("string"), F.when(F.element_at(digits, s["kind"] + 1), _digits(m)).otherwise(F.lower(m)))

    held = held.withColumn("lines", F.transform("spans", lambda s: F.struct(
        (s["start"] - F.length(F.replace(F.substr("text", F.lit(1), s["start"]), F.lit("\n"), F.lit("")))).alias("line"),
        s["kind"].alias("kind"), s["start"].alias("start"), s["until"].alias("until"), F.xxhash64(value(s)).alias("value"))))
    rows = (placed(held.drop("spans"))
            .withColumn("kinds", F.expr("array_distinct(transform(filter(lines, x -> x.line = line), x -> x.kind))"))
            .withColumn("values", F.expr(f"""array_distinct(transform(filter(lines,
                x -> x.start <= until + {REACH} and start <= x.until + {REACH}), x -> x.value))"""))
            .where(((F.size("kinds") > 0) | (F.size("values") > 0)) & ~F.expr("exists(lines, s -> s.start < until and start < s.until)")))
    return rows.select("doc_id", "version", "copies", "line", "kinds", "values", "term", "start", "until")


def disclosure(docs: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """(term, given): how much of a kind's information a term gives away."""
    terms, n_lines = line_terms(docs)
    held = found.where(F.size("spans") > 0)
    n_k = (held.select("doc_id", "version", F.posexplode(F.transform("spans", lambda s: F.struct(
               (s["start"] - F.length(F.replace(F.substr("text", F.lit(1), s["start"]), F.lit("\n"), F.lit("")))).alias("line"),
               s["kind"].alias("kind")))).alias("i", "at"))
           .groupBy("doc_id", "version", F.col("at.line").alias("line"), F.col("at.kind").alias("kind"))
           .agg(F.count(F.when(F.col("i") >= 0, 1)).alias("spans_there"))
           .join(held.groupBy("doc_id", "version").agg(F.count("*").alias("copies"))
                 .select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "copies"),
                 F.expr("doc_id <=> __id and version = __v"))
           .groupBy("kind").agg(F.sum("copies").alias("n_k")))
    n_tk = (near.select("doc_id", "version", "copies", "line", "term", F.explode("kinds").alias("kind")).distinct()
            .groupBy("term", "kind").agg(F.sum("copies").alias("n_tk")).where(F.col("n_tk") >= SUPPORT))
    all_of = n_tk.join(terms, "term").join(F.broadcast(n_k), "kind").crossJoin(F.broadcast(n_lines))
    given = F.log(F.col("n_lines") * F.col("n_tk") / (F.col("n_t") * F.col("n_k"))) / F.log(F.col("n_lines") / F.col("n_k"))
    return (all_of.where("n_k < n_lines").withColumn("given", given)
            .where(F.col("given") >= GENERALISE).select("term", "given"))


def _words(text: str) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _among(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of words whose hash bucket one of the terms has."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")
    return words.withColumn("at", bucket).join(F.broadcast(terms.select(bucket.alias("at")).distinct()), "at", "left_semi").drop("at")


def value_disclosure(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(term, given): how much of one protected value's information a term gives away."""
    at = near.select("doc_id", "version", "copies", "term", F.explode("values").alias("value"))
    # a value near no word at all has no term
    n_v = (at.select("doc_id", "version", "copies", "value").distinct()
           .groupBy("value", "version").agg(F.sum("copies").alias("rows"))
           .groupBy("value").agg(F.sum("rows").alias("n_v"), F.count("*").alias("texts")).where(F.col("texts") >= VALUE_SUPPORT))
    n_tv = (at.join(n_v.select("value"), "value", "left_semi").distinct()
            .groupBy("term", "value", "version").agg(F.sum("copies").alias("rows"))
            .groupBy("term", "value").agg(F.sum("rows").alias("n_tv"), F.count("*").alias("texts"))
            .where(F.col("texts") >= VALUE_SUPPORT).drop("texts"))
    n_tv = stored(n_tv.join(n_v.drop("texts"), "value"), "pii-values")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("text").rlike(r"\S"))
    n = texts.count()
    n_t = (_among(texts.select(F.explode(_words("text")).alias("term")), n_tv)
           .groupBy("term").agg(F.count("*").alias("n_t")))
    given = F.log(F.lit(n) * F.col("n_tv") / (F.col("n_t") * F.col("n_v"))) / F.log(F.lit(n) / F.col("n_v"))
    return (n_tv.where(F.col("n_v") < n).join(n_t, "term").withColumn("given", given)
            .where(F.col("given") >= GENERALISE).select("term", "given"))


def found_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base rows, added rows): the base spans of every row, and for each document and
    version with any, its text and its ``term`` spans with what happens to them."""
    found = stored(base(docs), "pii-base")
    near = stored(words_near(found), "pii-near")
    reveals = stored(disclosure(docs, found, near).union(value_disclosure(docs, near))
                     .groupBy("term").agg(F.max("given").alias("given")), "pii-terms")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("version"), "text")
    hits = stored(_among(d.select("doc_id", "version", F.explode(_words("text")).alias("term")), reveals)
                  .join(reveals, "term").groupBy("doc_id", "version")
                  .agg(F.map_from_entries(F.collect_set(F.struct("term", F.col("given") >= REMOVE))).alias("gone"))
                  .select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "gone"), "pii-hits")
    bucket = F.pmod("version", F.lit(TERM_BUCKETS)).cast("int")
    chosen = hits.select(F.pmod("__v", F.lit(TERM_BUCKETS)).cast("int").alias("at")).distinct()
    texts = (d.withColumn("at", bucket).join(F.broadcast(chosen), "at", "left_semi")
             .join(hits, F.expr("doc_id <=> __id and version = __v")).groupBy("doc_id", "version")
             .agg(F.first("text").alias("text"), F.first("gone").alias("gone")))
    spans = (found.where(F.size("spans") > 0).groupBy("doc_id", "version").agg(F.first("spans").alias("spans"))
             .withColumnsRenamed({"doc_id": "__id", "version": "__v"}))
    texts = stored(texts.join(spans, F.expr("doc_id <=> __id and version = __v"), "left").drop("__id", "__v"), "pii-texts")
    terms = (placed(texts.drop("spans"), F.element_at("gone", F.lower("w.word"))).groupBy("doc_id", "version")
             .agg(F.array_sort(F.collect_list(F.struct("start", "until", F.col("term").alias("gone")))).alias("terms"))
             .select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "terms"))
    outside = F.expr("""if(spans is null, terms,
        filter(terms, t -> not exists(spans, s -> s.start < t.until and t.start < s.until)))""")
    added = (texts.join(terms, F.expr("doc_id <=> __id and version = __v"))
             .select("__id", "__v", F.col("text").alias("__cut"), outside.alias("terms")).where(F.size("terms") > 0))
    return found, added


_NO_TERMS = "array<struct<start:int,until:int,gone:boolean>>"


def _named(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["until"].cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every row."""
    found, added = found_spans(docs)
    d = (found.drop("text").join(added.drop("__cut"), F.expr("doc_id <=> __id and version = __v"), "left")
         .withColumn("terms", F.coalesce("terms", F.array().cast(_NO_TERMS))))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                      s["until"].cast("string")))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)").alias(f"n_{name}")
             for k, name in enumerate(KINDS)]
    return d.select("doc_id", *count, F.sha2(F.array_join(text, ",").cast("binary"), 256).alias("base_sha256"),
                    F.array_join(F.concat(text, _named("terms", "term")), ",").alias("spans"))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced by its kind in brackets, general
    labels for generalised terms and nothing for removed ones. Other columns stay."""
    mine = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, added = found_spans(mine)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["until"].alias("until"),
                                                    F.element_at(names, s["kind"] + 1).alias("put")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["until"].alias("until"),
                                                    F.when(s["gone"], "").otherwise("[TERM]").alias("put")))
    # base spans of two kinds can overlap; the one that begins first (then the longer) covers the other's part
    cuts = (found.where(F.size("spans") > 0).groupBy("doc_id", "version")
            .agg(F.first("text").alias("__text"), F.first("spans").alias("spans"))
            .withColumn("held", F.lit(True))
            .join(added, F.expr("doc_id <=> __id and version = __v"), "full")
            .select(F.when(F.col("held"), F.col("doc_id")).otherwise(F.col("__id")).alias("doc_id"), F.coalesce("version", "__v").alias("version"),
                    F.coalesce("__text", "__cut").alias("__text"),
                    F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"), "terms")
            .withColumn("terms", F.coalesce("terms", F.array().cast(_NO_TERMS)))
            .withColumn("cuts", F.array_sort(F.concat(spans, terms))))
    put = F.expr("""array_join(concat(
        transform(cuts, (c, i) -> concat(
            substr(__text, reach(c, i) + 1, greatest(0, c.start - reach(c, i))), if(c.until > reach(c, i), c.put, ''))),
        array(substr(__text, array_max(transform(cuts, x -> x.until)) + 1))), '')""".replace(
        "reach(c, i)", "if(i = 0, 0, array_max(transform(slice(cuts, 1, i), x -> x.until)))"))
    new = stored(cuts.select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), put.alias("__clean")), "pii-clean")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").alias("i"),
                        F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("v"))
    # rows whose text stays as it is don't move, but for those that share a bucket with one that is cut
    whole = whole.withColumn("at", F.pmod("v", F.lit(TERM_BUCKETS)).cast("int"))
    chosen = F.broadcast(new.select(F.pmod("__v", F.lit(TERM_BUCKETS)).cast("int").alias("at")).distinct())
    kept = whole.join(chosen, "at", "left_anti").withColumn("__clean", F.lit(None).cast("string"))
    cut = whole.join(chosen, "at", "left_semi").join(new, F.expr("i <=> __id and v = __v"), "left")
    return (kept.unionByName(cut.drop("__id", "__v"))
            .select(*((F.coalesce("__clean", f"row.`{c}`") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return digests(table(spark, sf_dir, "documents"))
