"""Whitening of embeddings by an incremental eigendecomposition.

Tasks keep count, mean and spectrum of the vectors they have seen. Vectors come in blocks: a block's centred rows are turned by an
orthogonal transformation into at most as many rows as there are dimensions, with the same scatter; each such row, and the step from the old mean to the new one,
is a rank-one update of the spectrum. An update solves the secular equation between neighbouring poles by bisection; entries that
vanish and poles that coincide are deflated, and the eigenvectors come from the weights that belong to the roots found (Gu and Eisenstat, 1994), so they stay orthogonal. Spectra of tasks are combined a few
at a time, eigenpair by eigenpair, as rank-one updates again. A last pass over all vectors refines the result by
Rayleigh-Ritz: the covariance is formed in the basis found, where it is nearly diagonal, and diagonalised.

A component c enters as the whole number floor(64 * c) + 1000000. Sums and deviations are exact; products are of values centred at the exact
mean.

Defined results: rows whose vector is null or empty, has a null or non-finite entry, an entry beyond 2^40, or not the most frequent dimension (the larger one on a tie), take no
part. Rows with a null id and repeated rows take part and are returned. Directions without variance are not returned: components whose eigenvalue is
below 1e-12 of the largest. Without any, as with one vector or with equal ones only, there are no rows.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from curbloop.llm.batches import mapped
from curbloop.operators.scratch import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LEAST = 1e-12           # of the largest eigenvalue
BLOCK = 4096            # vectors that are turned together
FAN_IN = 8              # spectra that one task combines
SPECTRUM = "n long, mean array<double>, values array<double>, vectors array<double>"


def rank_one(values, vectors, step):
    """Spectrum of A + step step^T from that of A: eigenvalues ascending, eigenvectors in columns."""
    import numpy as np
    z = vectors.T @ step
    weight = float(z @ z)
    if weight == 0:
        return values, vectors
    tiny = 8 * np.finfo(float).eps * max(float(np.abs(values).max()), weight)
    z, vectors = z.copy(), vectors.copy()
    for i in range(len(values) - 1):  # equal poles: turn the pair so that one entry vanishes
        if values[i + 1] - values[i] <= tiny and z[i] != 0:
            r = float(np.hypot(z[i], z[i + 1]))
            c, s = z[i + 1] / r, z[i] / r
            z[i], z[i + 1] = 0.0, r
            vectors[:, [i, i + 1]] = vectors[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
    live = np.flatnonzero(np.abs(z) * np.sqrt(weight) > tiny)
    if not len(live):
        return values, vectors
    d, z = values[live], z[live]
    roots, gaps = secular(d, z)
    # the weights for which these are the exact roots
    squares = np.empty(len(d))
    for i in range(len(d)):
        others = np.arange(len(d)) != i
        squares[i] = np.prod(gaps[i, others] / (d[i] - d[others])) * -gaps[i, i]
    z = np.copysign(np.sqrt(np.maximum(squares, 0)), z)
    turned = z[:, None] / gaps
    turned /= np.linalg.norm(turned, axis=0)
    new_values, new_vectors = values.copy(), vectors
    new_values[live] = roots
    new_vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def secular(d, z):
    """Roots of 1 + sum z_i^2 / (d_i - x) = 0, one above each of the ascending poles d, and the differences d_i - root_k as (i, k).

    Each root is bisected as a distance from the nearer pole, so the differences keep their relative accuracy."""
    import numpy as np
    squares, size = z * z, len(d)
    upper = np.append(d[1:], d[-1] + squares.sum())
    middle = (upper - d) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + (squares[:, None] / ((d[:, None] - d[None, :]) - middle[None, :])).sum(0)
        near = np.where((at_middle < 0) & (np.arange(size) < size - 1), np.arange(size) + 1, np.arange(size))  # the function rises between poles
        poles = d[:, None] - d[near][None, :]
        own = near == np.arange(size)
        low = np.where(own, 0.0, -middle)
        high = np.where(own, np.where(np.arange(size) == size - 1, upper - d, middle), 0.0)
        for _ in range(1100):
            # halve the exponent while the ends are far apart, then the interval
            small, large = np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))
            split = np.where(small > 0, np.where(large > 4 * small, np.sqrt(small) * np.sqrt(large), (small + large) / 2), large * 1e-8)
            x = np.where(own, split, -split)
            stop = (x <= low) | (x >= high) | (large < 1e-300)
            if stop.all():
                break
            below = 1 + (squares[:, None] / (poles - x[None, :])).sum(0) < 0
            low, high = np.where(~stop & below, x, low), np.where(~stop & ~below, x, high)
        x = np.where(own, high, low)
    x = np.where(x == 0, np.where(own, 1e-300, -1e-300), x)
    return d[near] + x, poles - x[None, :]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter (not divided by the count) of the vectors seen."""

    def __init__(self, n: int, mean, values, vectors):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def of_none(cls, dim: int) -> "Spectrum":
        import numpy as np
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def _moved(self, n: int, mean) -> None:
        """The means differ: their step is one more row of the scatter."""
        import numpy as np
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def update(self, step) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, step)

    def add(self, block) -> None:
        import numpy as np
        mean = block.mean(0)
        rows = block - mean
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.update(row)
        self._moved(len(block), mean)

    def combine(self, other: "Spectrum") -> None:
        import numpy as np
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector * np.sqrt(value))
        self._moved(other.n, other.mean)

    def to_batch(self):
        import pyarrow as pa
        lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (self.mean, self.values, self.vectors)]
        return pa.RecordBatch.from_arrays([pa.array([self.n]), *lists], names=["n", "mean", "values", "vectors"])


def spectrum_of(n, mean, values, vectors) -> Spectrum:
    import numpy as np
    return Spectrum(n, np.array(mean), np.array(values), np.array(vectors).reshape(len(values), len(values)))


def incremental(rows: DataFrame, dim: int, centre, fan_in: int = FAN_IN) -> Spectrum:
    """Spectrum of whole vectors (x: array<long>), less ``centre``: one for each task, then combined ``fan_in`` at a time."""

    def own(batches):
        spectrum = Spectrum.of_none(dim)
        for block in _blocks(batches, dim, centre):
            spectrum.add(block)
        if spectrum.n:
            yield spectrum.to_batch()

    def merged(batches):
        spectrum = Spectrum.of_none(dim)
        for batch in batches:
            for row in batch.to_pylist():
                spectrum.combine(spectrum_of(**row))
        if spectrum.n:
            yield spectrum.to_batch()

    spectra = stage(mapped(rows.select("x"), own, SPECTRUM), "spectra")
    left = spectra.count()
    while left > 1:
        left = -(-left // fan_in)
        spectra = stage(mapped(spectra.repartition(left), merged, SPECTRUM), "spectra")
    return spectrum_of(**spectra.first().asDict())


def _matrix(column, dim: int):
    """Whole vectors of a batch as a matrix."""
    return column.flatten().to_numpy().reshape(-1, dim)


def _blocks(batches, dim: int, centre, size: int = BLOCK):
    import numpy as np
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(_matrix(batch.column(0), dim) - centre)
            n += len(batch)
        if n >= size:
            yield np.concatenate(held).astype(np.float64)
            held, n = [], 0
    if held:
        yield np.concatenate(held).astype(np.float64)


def usable(rows: DataFrame, embedding="embedding", vec_id="vec_id") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    values = F.col(embedding).cast("array<double>")
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 40)), F.lit(False)))
    whole = F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    found = stage(rows.select(F.col(vec_id).alias("vec_id"), values.alias("v")).filter(good).select("vec_id", whole.alias("x")), "vectors")
    dims = found.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(2).collect()
    return found if len(dims) < 2 else found.filter(F.size("x") == dims[0]["dim"])


@dataclass(frozen=True)
class Model:
    """What the fit found: sums are exact, ``vectors`` has a component in each column, by falling eigenvalue."""
    n: int
    sums: list
    values: object
    vectors: object
    trace: float

    @property
    def centre(self):
        """The whole number next to the mean, and what is left of it."""
        import numpy as np
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole)])


def _products(rows: DataFrame, model: Model, basis, scaled=None, middle=None):
    """Sum of y y^T over all rows, y the centred vector in ``basis`` (over ``scaled``, less ``middle``), added up by Spark entry by entry, as a
    matrix of at most the dimension."""
    import numpy as np
    whole, rest = model.centre
    dim, width = basis.shape

    def partial(batches):
        import pyarrow as pa
        total = np.zeros((width, width))
        for block in _blocks(batches, dim, whole):
            y = (block - rest) @ basis
            y = y if scaled is None else y / scaled - middle
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = mapped(rows.select("x"), partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return (out + out.T) / 2


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of usable rows (x); None if there are none."""
    import numpy as np
    sums = (rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
            .orderBy("i").collect())
    if not sums:
        return None
    model = Model(sums[0]["n"], [int(r["s"]) for r in sums], None, None, 0.0)
    found = incremental(rows, len(sums), model.centre[0])
    # Rayleigh-Ritz in the whole basis found, twice: the second time the basis is already right but for rounding
    basis = found.vectors
    for _ in range(2):
        basis = np.linalg.qr(basis)[0]
        covariance = _products(rows, model, basis) / model.n
        values, turn = np.linalg.eigh(covariance)
        basis = basis @ turn
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > LEAST * max(values.max(), 0)][:components]
    return Model(model.n, model.sums, values[order], basis[:, order], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of the whitened rows less the identity."""
    import numpy as np
    width, whole, rest = len(model.values), *model.centre
    scaled = np.sqrt(model.values)

    def total(batches):
        import pyarrow as pa
        out = np.zeros(width)
        for block in _blocks(batches, len(whole), whole):
            out += ((block - rest) @ model.vectors / scaled).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(out)], names=["i", "s"])

    sums = mapped(rows.select("x"), total, "i int, s double").groupBy("i").agg(F.sum("s")).collect()
    middle = np.array([s for _, s in sorted(map(tuple, sums))]) / model.n
    return float(np.abs(_products(rows, model, model.vectors, scaled, middle) / model.n - np.eye(width)).max())


def deviation(x: str, model: Model) -> Column:
    """Sum over the dimensions of (n * x - S)^2, exact."""
    parts = F.zip_with(x, F.array(*[F.lit(s).cast("decimal(28,0)") for s in model.sums]),
                       lambda c, s: (F.lit(model.n).cast("decimal(14,0)") * c.cast("decimal(16,0)") - s).cast("decimal(18,0)"))
    return F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda total, c: (total + c * c).cast("decimal(38,0)"))


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, whitened: array<double>) of usable rows."""
    whole, rest = model.centre
    weights = model.vectors / (model.values ** 0.5)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def project(batches):
        import pyarrow as pa
        for batch in batches:
            y = ((_matrix(batch.column(1), len(whole)) - whole) - rest) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return mapped(rows.select("vec_id", "x", deviation("x", model).alias("deviation")), project, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, components: int = COMPONENTS, embedding="embedding", vec_id="vec_id") -> DataFrame:
    """One row per usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    found = usable(rows, embedding, vec_id)
    model = fit(found, components)
    spark = rows.sparkSession
    if model is None or not len(model.values):
        id_type = found.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(found, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return transform(found, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
