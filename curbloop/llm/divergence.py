"""How far the sources of a language differ in their words: smoothed shares of terms, compared source by source.

Identical texts of a language are collapsed first: the group of a text holds how many rows each source has of it, its text is split into
terms once, and counts and document frequencies are added with those weights. Terms are added up inside tasks before they are
shuffled. Sources are then compared on the terms that both have; terms that only one of two sources has
depend on its count alone, so they enter by count, and terms that neither has enter by their number. All arithmetic is in whole
numbers.

Defined results: null text, language and source are ''. Rows count as often as they are repeated. A text without terms
still makes its source occur. A language without kept terms gives value 0 for every pair and no terms. Only the three named columns are
read. An empty table gives no rows.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curbloop.llm.batches import mapped
from curbloop.operators.layout import skew_join
from curbloop.operators.scratch import stage

#: Shares are whole numbers: floor(SCALE * share) + 1.
SCALE, MIN_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
EXACT = "decimal(38,0)"


def _letters() -> bytes:
    """For each byte the one it becomes: ASCII letters in lower case, bytes of other characters as they are, the rest a space."""
    return bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


LETTERS = _letters()


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters of a UTF-8 text; only A to Z are lower-cased."""
    return text.translate(LETTERS).split()


def collapse(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """One row per language and text: (lang, text, sources: array of (source, n)). Texts are told apart by two hashes of their own."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    copies = (rows.select("lang", "source", *[h.alias(c) for c, h in hashes.items()]).groupBy("lang", "h1", "h2", "source").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("lang", "h1", "h2").agg(F.collect_list(F.struct("source", "n")).alias("sources")))
    texts = rows.select("lang", "text", *[h.alias(c) for c, h in hashes.items()]).groupBy("lang", "h1", "h2").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "h1", "h2"]).select("lang", "text", "sources")


def count_terms(collapsed: DataFrame, max_held: int = 400_000) -> DataFrame:
    """(lang, source, term, count, docs), added up inside tasks: a term may come several times. About ``max_held`` counters are held."""

    def count(batches):
        import collections

        import pyarrow as pa
        counts, docs, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), 0

        def rows():
            for (lang, source), found in counts.items():
                items, in_docs = list(found.items()), docs[lang, source]
                for first in range(0, len(items), 50_000):
                    some = items[first:first + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                        pa.array([t for t, _ in some], pa.binary()).cast(pa.string()), pa.array([n for _, n in some], pa.int64()),
                        pa.array([in_docs[t] for t, _ in some], pa.int64())], names=["lang", "source", "term", "count", "docs"])
            counts.clear()
            docs.clear()

        for batch in batches:
            langs, texts, sources = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
            for lang, text, copies in zip(langs, texts, sources):
                words = terms(text.as_py())
                if len(copies) == 1 and copies[0]["n"] == 1:  # a text of its own
                    key = lang, copies[0]["source"]
                    before = len(counts[key])
                    counts[key].update(words)
                    docs[key].update(set(words))
                    held += len(counts[key]) - before
                    continue
                found = collections.Counter(words)
                for copy in copies:
                    key, n = (lang, copy["source"]), copy["n"]
                    before, in_source, in_docs = len(counts[key]), counts[key], docs[key]
                    for word, k in found.items():
                        in_source[word] += n * k
                        in_docs[word] += n
                    held += len(in_source) - before
                    if held > max_held:
                        yield from rows()
                        held = 0
            if held > max_held:
                yield from rows()
                held = 0
        yield from rows()

    return mapped(collapsed.select("lang", "text", "sources"), count, "lang string, source string, term string, count long, docs long")


def share(count, total, n_terms) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + n_terms))."""
    more = F.lit(SCALE).cast("decimal(10,0)") * (F.col(count) + 1).cast("decimal(19,0)")
    return F.expr("1L") + F.call_function("div", more, (F.col(total) + F.col(n_terms)).cast("decimal(19,0)"))


def distance(p, q) -> Column:
    """floor((p - q)^2 / q)."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(entries: DataFrame, max_pairs: int = 1 << 20) -> DataFrame:
    """What the terms that two sources share add to their distance beyond what each adds alone: (lang, source, item, value), added up in
    portions of about ``max_pairs`` pairs. A row of the input has the sources of one term (lang, sources: array of (source, p, p0))."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def add(lang, own, other, values, names, langs):
            size = len(names)
            keys, inverse = np.unique((lang * size + own) * size + other, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, inverse, values)
            return pa.RecordBatch.from_arrays([
                langs.take(pa.array(keys // size // size)), names.take(pa.array(keys // size % size)), names.take(pa.array(keys % size)),
                pa.array(sums)], names=["lang", "source", "item", "value"])

        for batch in batches:
            lists = batch.column(1)
            coded = batch.column(0).dictionary_encode()
            lang, langs = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            offsets = lists.offsets.to_numpy().astype(np.int64)
            fields = lists.values  # not sliced: offsets count from its start
            names = fields.field("source").dictionary_encode()
            source, names = names.indices.to_numpy().astype(np.int64), names.dictionary
            p, p0 = fields.field("p").to_numpy(), fields.field("p0").to_numpy()
            sizes = np.diff(offsets)
            entry = np.arange(offsets[0], offsets[-1])
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes[row])  # pairs up to each entry
            first = 0
            while first < len(entry):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + max_pairs, "right")))
                some = row[first:last]
                a = np.repeat(entry[first:last], sizes[some])
                starts = np.cumsum(sizes[some]) - sizes[some]
                b = np.arange(len(a)) - np.repeat(starts, sizes[some]) + np.repeat(offsets[some], sizes[some])
                a, b, of = (x[a != b] for x in (a, b, np.repeat(lang[some], sizes[some])))
                if len(a):
                    def apart(x, y):
                        return (x - y) ** 2 // y
                    value = apart(p[a], p[b]) - apart(p[a], p0[b]) - apart(p0[a], p[b]) + apart(p0[a], p0[b])
                    yield add(of, source[a], source[b], value, names, langs)
                first = last

    return mapped(entries.select("lang", "sources"), compare, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text="text", lang="lang", source="source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has the distance of each source to each other one of its language, part
    'term' the ``top_terms`` kept terms that a source has more of than its language, by how much."""
    # tasks have added up their rows already, so they are dealt once, by term, for both groupings below
    counted = count_terms(collapse(docs, text, lang, source)).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang"), F.collect_list(F.struct("source", "count")).alias("sources"))
    kept = stage(by_term.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")

    lang_sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("in_lang").alias("lang_total"))
    single = kept.select("lang", "term", "in_lang", F.explode("sources").alias("s")).select("lang", "term", "in_lang", "s.source", "s.count")
    totals = single.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    groups = (occurring.join(lang_sizes, "lang", "left").join(totals, ["lang", "source"], "left")
              .na.fill(0, ["n_terms", "lang_total", "total"]).withColumn("none", F.lit(0).cast("long"))
              .withColumn("p0", F.when(F.col("n_terms") > 0, share("none", "total", "n_terms"))).drop("none"))
    groups = stage(groups, "sources")

    known = skew_join(single, groups, ["lang", "source"], ["term"])
    entries = stage(known.select("lang", "source", "term", share("count", "total", "n_terms").alias("p"), "p0",
                                 share("in_lang", "lang_total", "n_terms").alias("q")), "shares")
    first = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = (entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
           .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top_terms))

    # value = terms in neither + terms in one, by their share + what shared terms add
    other = groups.filter("n_terms > 0").select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    neither = groups.join(other, "lang").filter(apart).select("lang", "source", "item", (F.col("n_terms").cast(EXACT) * distance("p0", "q0")).cast(EXACT).alias("value"))
    shares = entries.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("n"))
    crossed = skew_join(shares, other, ["lang"], ["source", "p"]).filter(apart)

    def alone(one, two, p, q, p0, q0):
        return crossed.select("lang", F.col(one).alias("source"), F.col(two).alias("item"),
                              (F.col("n").cast(EXACT) * (distance(p, q) - distance(p0, q0))).cast(EXACT).alias("value"))

    both = shared_terms(entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("sources")).filter(F.size("sources") > 1))
    parts = [neither, alone("source", "item", "p", "q0", "p0", "q0"), alone("item", "source", "q0", "p", "q0", "p0"),
             both.withColumn("value", F.col("value").cast(EXACT))]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    empty = groups.filter("n_terms = 0")
    without = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").filter(apart).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).unionByName(without)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", "rank")
