"""Certified best-fit packing, whitening and source divergence against plain versions."""
import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curbloop.llm import bestfit, divergence, queries, whitening
from curbloop.llm.tokens import public_path
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.001"


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def fewest(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                at = rooms.index(room)
                place(k + 1, rooms[:at] + [room - lengths[k]] + rooms[at + 1:])
        place(k + 1, rooms + [capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def check_sequences(rows, capacity):
    """Every sequence is filled from 0 without gaps; returns how many there are."""
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r.sequence_id].append((r.offset, r.length))
    for pieces in parts.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(parts)


def test_best_fit_and_bounds():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randint(5, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        assert bestfit.lower_bound(counts, capacity) <= fewest(lengths, capacity)
        more = lengths * rng.randint(1, 30)
        sequence, offset, bins, bound = bestfit.places(more, capacity)
        assert bins == plain_best_fit(more, capacity) >= bound == bestfit.lower_bound(np.bincount(more), capacity)
        row = collections.namedtuple("row", "sequence_id offset length")
        assert check_sequences([row(*r) for r in zip(sequence.tolist(), offset.tolist(), more)], capacity) == bins
    assert bestfit.places([], 8)[2:] == (0, 0)
    # two of three halves and more: only the rounding bounds see it
    assert bestfit.lower_bound(np.bincount([6] * 9, minlength=11), 10) == 9 and bestfit.lower_bound(np.bincount([4] * 9, minlength=12), 11) == 5
    for wrong in ([0], [9], [-1]):
        with pytest.raises(ValueError):
            bestfit.places(wrong, 8)


def test_gaps_are_exchanged(spark):
    """Partitions that waste room alone give up documents; the rest stay as they are certified."""
    rng = random.Random(3)
    lengths = [rng.choice([26, 27, 28, 35, 36, 51, 9, 100]) for _ in range(4000)]
    pieces = spark.createDataFrame([(k, n, "own") for k, n in enumerate(lengths)], "doc_id long, length long, part string")
    alone = bestfit.pack(pieces, 100, part_rows=40, max_rounds=0).collect()
    rows = bestfit.pack(pieces, 100, part_rows=40).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    before, after = check_sequences(alone, 100), check_sequences(rows, 100)
    assert before == sum(b for _, b in {(r.part, r.part_bins) for r in alone})
    assert bestfit.lower_bound(np.bincount(lengths), 100) <= after < before
    by_part = collections.defaultdict(set)
    for r in rows:
        by_part[r.part].add((r.part_bins, r.part_bound))
    assert all(len(v) == 1 and min(v)[0] >= min(v)[1] for v in by_part.values())


def test_best_fit_round_trip(docs, empty, clashing):
    rows = bestfit.pack(bestfit.cut(clashing).withColumn("part_bins", F.lit("own"))).collect()
    check_sequences(rows, 2048)
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert sum(r.piece == 0 for r in rows) == len(ODD) and len(by_doc[8]) == 3
    for doc_id, text, *_ in ODD:
        if doc_id == 8:
            continue
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [0, *itertools.accumulate(r.length for r in parts)][:-1]
        assert all(r.length == 2048 for r in parts[1:])
        assert b"".join(bytes(r.ids) for r in parts) == np.array(want, "<u4").tobytes()
    assert len(by_doc[7]) > 10 and bestfit.pack(bestfit.cut(empty)).count() == 0


def test_best_fit_query(spark):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    rows = queries.op11_best_fit(spark, SF).collect()
    n = check_sequences(rows, 2048)
    assert n <= bestfit.lower_bound(np.bincount([r.length for r in rows])) + 1
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = {(r.doc_id, r.piece): r for r in rows}
    assert len(parts) == len(rows)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        borders = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            r = parts.pop((doc_id, k))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert not parts


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for trial in range(150):
        d = int(rng.integers(1, 12))
        a = rng.normal(size=(d, d))
        a = [a @ a.T, np.zeros((d, d)), np.diag(rng.integers(0, 3, d).astype(float))][trial % 3]  # also poles that coincide
        values, vectors = np.linalg.eigh(a)
        for _ in range(6):
            step = rng.normal(size=d) * 10.0 ** rng.integers(-6, 7)
            step[rng.integers(0, d)] *= rng.random() < 0.7
            want = vectors @ np.diag(values) @ vectors.T + np.outer(step, step)
            values, vectors = whitening.rank_one(values, vectors, step)
            assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-12 * max(np.abs(want).max(), 1e-300)
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11 and (np.diff(values) >= 0).all()


def check_whitened(rows, table, components=32):
    """Rows of ``whiten`` against the eigenvectors that numpy finds, up to their signs."""
    ids, x = [i for i, _ in table], np.array([np.floor(64 * np.array(v, float)) + 1_000_000 for _, v in table]).astype(np.int64)
    n, s = len(x), x.sum(0)
    centred = (x - 1_000_000) - (s - n * 1_000_000) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    kept = [k for k in np.argsort(-values) if values[k] > whitening.LEAST * values.max()][:components]
    want = centred @ vectors[:, kept] / np.sqrt(values[kept])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == n * len(kept) and {r.n for r in rows} == {n}
    for k in range(len(kept)):
        own = np.array([got[i, k + 1].whitened for i in ids])
        assert np.abs(own * np.sign(own @ want[:, k]) - want[:, k]).max() < 1e-8
    for i, row in zip(ids, x):
        assert got[i, 1].deviation == sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s))
        assert abs(got[i, 1].explained / (values.max() / values.sum()) - 1) < 1e-9
    assert max(r.identity_error for r in rows) < 1e-9


def test_whitening_query(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.op12_whitening(spark, SF).collect(), table)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 5]]) for k in range(60)]
    good += [(100, good[0][1]), (101, good[0][1]), (102, [0.0] * 5), (103, [1e4, 0.0, 0.0, 0.0, 0.0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (205, [1.0, 2.0]), (206, [1e300, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, n string, x string, deviation string"
    rows = spark.createDataFrame([(i, v, "own", "own", "own") for i, v in good + bad], schema)
    out = whitening.whiten(rows.repartition(7)).collect()
    check_whitened(out, good)
    few = whitening.whiten(rows.filter("vec_id between 3 and 5")).collect()  # fewer vectors than dimensions
    check_whitened(few, good[3:6])
    for none in (rows.limit(0), rows.filter("vec_id = 3"), rows.filter("vec_id between 100 and 101"), rows.filter("vec_id > 199 and vec_id < 205")):
        assert whitening.whiten(none).collect() == []
    twice = rows.filter("vec_id < 60").selectExpr("if(vec_id = 7, null, vec_id) AS vec_id", "embedding")
    assert whitening.whiten(twice.union(twice)).filter("vec_id is null").count() == 2 * 5


def test_spectra_of_many_tasks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 9)) * 50).astype(np.int64)
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(23)
    found = whitening.incremental(rows, 9, np.zeros(9, np.int64), fan_in=3)
    assert found.n == 700 and np.allclose(found.mean, x.mean(0))
    assert np.allclose(found.values, np.linalg.eigvalsh(700 * np.cov(x.T, bias=True)), rtol=1e-11)


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows):
    words = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        docs = collections.Counter(t for w in own for t in set(w[2]))
        kept = {t for t, n in docs.items() if n >= 3}
        counts = {s: collections.Counter(t for w in own if w[1] == s for t in w[2] if t in kept) for s in {w[1] for w in own}}
        whole = sum(counts.values(), collections.Counter())

        def share(found, t):
            return 1 + 10**9 * (found[t] + 1) // (sum(found.values()) + len(kept))
        for s in counts:
            pairs = [(o, sum((share(counts[s], t) - share(counts[o], t)) ** 2 // share(counts[o], t) for t in kept)) for o in counts if o != s]
            terms = [(t, share(counts[s], t), share(whole, t)) for t in kept if counts[s][t]]
            terms = [(t, (p - q) ** 2 // q) for t, p, q in terms if p > q]
            for part, items in (("pair", pairs), ("term", terms)):
                order = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:200 if part == "term" else None]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)}
    return out


def test_divergence_of_odd_rows(spark, docs, clashing, empty):
    more = [(k, f"{'É Straße' * (k % 3)} Cat {'DOG ' * (k % 4)}x{k % 5}y the\x00end ﬁ İ", ["en", None, "xx"][k % 3], f"s{k % 4}", 1) for k in range(40)]
    more += [(k, "alone here", "one", "s0", 1) for k in range(3)] + [(50, "rare words", "none", s, 1) for s in ("s0", "s1", None)] + [(51, LONG, "en", "s1", 1)] * 3
    rows = [*ODD, *more]
    from tests.llm.conftest import COLUMNS
    table = spark.createDataFrame(rows, COLUMNS).select("*", *[F.lit("own").alias(c) for c in ("term", "count", "h1", "sources", "value", "item")])
    got = [tuple(r) for r in divergence.audit(table).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)
    assert divergence.audit(empty).count() == 0


def test_divergence_in_small_portions(spark):
    rows = [(k, " ".join(f"w{chr(97 + (k * j) % 26)}" for j in range(30)), "en", f"s{k % 6}", 1) for k in range(60)]
    found = divergence.collapse(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    def counted(held):
        return {tuple(r) for r in divergence.count_terms(found, held).groupBy("lang", "source", "term").agg(F.sum("count"), F.sum("docs")).collect()}
    assert counted(1) == counted(10**6)
    entries = spark.createDataFrame([("en", [(f"s{k}", 10 * k + i + 5, 3 + k) for k in range(i % 5 + 1)]) for i in range(20)], "lang string, sources array<struct<source:string,p:long,p0:long>>")
    def summed(size):
        return {tuple(r) for r in divergence.shared_terms(entries, size).groupBy("lang", "source", "item").agg(F.sum("value")).collect()}
    assert summed(1) == summed(10**6) != set()
