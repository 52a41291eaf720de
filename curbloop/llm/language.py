"""Language identification: multinomial naive Bayes over hashed character n-grams.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be learned.
Rows with a null label, a null text or no letter teach nothing. Equal rows get equal answers, ties go to the first label
in alphabetical order, other columns of the input are kept and never read; clashing names are replaced.
"""
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from curbloop.llm.batches import mapped
from curbloop.operators.scratch import stage

UNKNOWN = "und"
BLOCK = 1 << 18  # characters hashed at a time


@dataclass(frozen=True)
class Settings:
    orders: tuple = (1, 2, 3)
    buckets: int = 1 << 16
    smoothing: float = 0.5
    train_rows: int = 4000     # different labelled texts per language that the model is fitted on, about
    matrix_bytes: int = 64 << 20


@dataclass(frozen=True)
class Model:
    """``weights``: (buckets, languages) log-probabilities; at most ``Settings.matrix_bytes`` large."""
    labels: list
    weights: object
    prior: object
    settings: Settings


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def gram_buckets(codes, orders, buckets: int):
    """Bucket of every character n-gram. ``codes``: code points; -1 parts texts. Yields (order, buckets, usable)."""
    import numpy as np
    c = codes.astype(np.uint64)
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, 0x9E3779B97F4A7C15 * n & (2**64 - 1), np.uint64)
        ok = np.ones(len(h), bool)
        for k in range(n):
            part = slice(k, len(c) - n + 1 + k)
            h = (h ^ c[part]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            ok &= codes[part] >= 0
        yield n, (h % np.uint64(buckets)).astype(np.int64), ok


def _blocks(texts, orders):
    """Whole texts as code points, -1 before and after each, in blocks of bounded size that share ``max(orders) - 1``
    characters: (codes, index of the text of each character)."""
    import numpy as np
    edge, held, size = np.array([-1], np.int64), [], 0
    for k, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        for at in range(0, max(len(codes), 1), BLOCK):
            part = codes[max(0, at - max(orders) + 1):at + BLOCK]
            fresh = min(at, max(orders) - 1)
            held.append((np.concatenate([edge, part, edge]), k, fresh))
            size += len(part)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def sum_grams(texts, settings: Settings, weights):
    """Per text the sum of the weights of its n-grams: the product of the sparse count matrix and ``weights``."""
    import numpy as np
    out = np.zeros((len(texts), weights.shape[1]))
    grams = np.zeros(len(texts), np.int64)
    for held in _blocks(texts, settings.orders):
        codes = np.concatenate([h[0] for h in held])
        owner = np.repeat([h[1] for h in held], [len(h[0]) for h in held])
        seen = np.concatenate([_seen(h) for h in held])
        for n, bucket, ok in gram_buckets(codes, settings.orders, settings.buckets):
            ok &= ~seen[n - 1:]  # grams that end in the part shared with the block before were counted there
            bucket, own = bucket[ok], owner[:len(ok)][ok]
            if len(bucket):
                first = np.flatnonzero(np.diff(own, prepend=-1))
                np.add.at(out, own[first], np.add.reduceat(weights[bucket], first, axis=0, dtype=np.float64))
                np.add.at(grams, own[first], np.diff(np.append(first, len(own))))
    return out, grams


def _seen(held):
    import numpy as np
    codes, _, fresh = held
    seen = np.zeros(len(codes), bool)
    seen[1:1 + fresh] = True
    return seen


def _counts(settings: Settings, labels: list):
    """Task of the fit: bucket counts per label of one partition, at most labels x buckets numbers."""
    index = {label: k for k, label in enumerate(labels)}

    def count(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((len(index), settings.buckets), np.int64)
        for batch in batches:
            rows = [(index[lang], text) for text, lang in zip(*(c.to_pylist() for c in batch.columns))
                    if lang in index and has_letter(text)]
            for held in _blocks([t for _, t in rows], settings.orders):
                codes = np.concatenate([h[0] for h in held])
                label = np.repeat([rows[h[1]][0] for h in held], [len(h[0]) for h in held])
                seen = np.concatenate([_seen(h) for h in held])
                for n, bucket, ok in gram_buckets(codes, settings.orders, settings.buckets):
                    ok &= ~seen[n - 1:]
                    flat = label[:len(ok)][ok] * settings.buckets + bucket[ok]
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])],
                                         names=["label", "bucket", "n"])
    return count


def fit(labelled: DataFrame, text="text", lang="lang", settings: Settings = Settings()) -> Model:
    """Learn from (text, lang). About ``train_rows`` different texts per language are drawn by a hash of the text, each counted once; every
    label with a usable text is learned. The result is bounded by ``matrix_bytes`` (fewer buckets for very many labels)."""
    import numpy as np
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    rows = rows.filter(F.col("text").rlike(r"[\p{L}\p{Cn}]")).withColumn("hash", F.xxhash64("text"))  # letters, also those newer than Java's tables
    sizes = stage(rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")), "label-sizes")
    rows_of = {r["lang"]: r["n"] for r in sizes.select("lang", "n").collect()}
    labels = sorted(rows_of)
    if not labels:
        return Model([], np.zeros((settings.buckets, 0), np.float32), np.zeros(0), settings)
    buckets = settings.buckets
    while buckets * len(labels) * 4 > settings.matrix_bytes and buckets > 1:
        buckets //= 2
    settings = replace(settings, buckets=buckets)
    share = F.ceil(F.lit(settings.train_rows * 10**6) / F.col("texts"))
    drawn = (rows.join(F.broadcast(sizes.select("lang", "texts")), "lang").filter(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(10**6)) < share)
             .groupBy("lang", "hash").agg(F.first("text").alias("text")).select("text", "lang"))
    table = (mapped(drawn, _counts(settings, labels), "label int, bucket int, n long")
             .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros((buckets, len(labels)))
    n[table["bucket"].to_numpy(), table["label"].to_numpy()] = table["n"].to_numpy()
    taught = n.sum(0) > 0
    labels, n = [label for label, t in zip(labels, taught) if t], n[:, taught]
    weights = np.log(n + settings.smoothing) - np.log(n.sum(0) + settings.smoothing * buckets)
    rows_per = np.array([rows_of[label] for label in labels], float)
    return Model(labels, weights.astype(np.float32), np.log(rows_per / rows_per.sum()) if len(labels) else rows_per, settings)


def identify(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior of the predicted language, to every row."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import numpy as np
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            known = [k for k, t in enumerate(texts) if has_letter(t)]
            label, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if m.labels and known:
                sums, _ = sum_grams([texts[k] for k in known], m.settings, m.weights)
                sums += m.prior
                top = sums.argmax(1)
                best[known] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for k, t in zip(known, top):
                    label[k] = m.labels[t]
            columns = [batch.column(c) for c in kept] + [pa.array(label, pa.string()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    rows = docs.select(*[F.col(c) for c in kept])
    schema = rows.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return mapped(rows, score, schema)


def held_out(doc_id="doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from the fit; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
