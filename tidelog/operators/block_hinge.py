"""The squared-hinge classifier of ``squared_hinge`` with coefficients of any number: none of them on the driver.

Vector-free L-BFGS. Coefficients, gradient, steps and gradient changes are all sums of training rows, X'a, as the fit starts at
zero: each is kept as its factors ``a``, one number per row and class, and its margins X X'a, and a product of two of them is
a'X X'b. So nothing as long as the vocabulary is stored, moved or held at any step. The two-loop recursion needs only those
products: the driver gets a few hundred numbers a step and sends back the factors by which the vectors make the direction.
Factors and margins lie in one table by block of rows, the training rows in bands of features: a band is one row of some
``BAND`` entries, all that its features have, so a task takes factors to coefficients and on to margins by itself. A step takes

1. one pass over the row blocks for the products,
2. one pass over the row blocks that tries all lengths of the line search at once,
3. one pass over the bands for the margins of the new gradient, which also writes the new table of row blocks.

Tables of row blocks are written to two paths in turn. The numbers that a pass over the bands needs are sent to all tasks up to
``SENT_BYTES``; beyond, they are joined to the cells of bands by shuffle. The coefficients are made from the factors at the end.

The loss, its weights, the line search and the end are those of ``squared_hinge``, so both give the same model.
"""

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.joins import BROADCAST_BYTES
from tidelog.session import dropped, fresh_path, materialize

FEATURE_BLOCK, ROW_BLOCK = 16_384, 4_096
# Entries of a band (a feature is never divided), and bytes of factors that are sent to all tasks.
BAND, SENT_BYTES = 1_000_000, BROADCAST_BYTES
_MEMORY, _HALVINGS = 10, 30
_LISTS = pa.list_(pa.float64())
_INTS = pa.list_(pa.int32())


def _matrix(value, classes: int) -> np.ndarray:
    return np.asarray(value.values if hasattr(value, "values") else value, np.float64).reshape(classes, -1)


def bands_of(rows: DataFrame, feature_block: int, band: int = BAND, bias: int | None = None) -> dict[int, int]:
    """{block of features: number of its bands} of rows (indices); ``bias`` is a feature that every row has."""
    blocks = F.transform(F.col("indices"), lambda i: F.floor(i / feature_block).cast("int"))
    if bias is not None:
        blocks = F.concat(blocks, F.array(F.lit(bias // feature_block)))
    counts = rows.select(F.explode(blocks).alias("fb")).groupBy("fb").agg(F.count("*").alias("n")).collect()
    return {r["fb"]: min(-(-r["n"] // band), feature_block) for r in counts}


def cells_of(rows: DataFrame, bands: dict[int, int], feature_block: int = FEATURE_BLOCK, row_block: int = ROW_BLOCK, bias: int | None = None) -> DataFrame:
    """(fb, sub, rb, n, row, feature, value): rows (y, indices, values) cut into cells of a band and a block of ``n`` rows. The
    feature ``f`` of a block that has ``k`` bands is number ``f // k`` of band ``f % k``. One more cell per block of rows, ``fb`` -1,
    holds their classes in ``row``. ``bias`` is the index of a feature that is one everywhere. The cells are stored."""
    kinds = pa.schema([("fb", pa.int32()), ("sub", pa.int32()), ("rb", pa.int64()), ("n", pa.int32()), ("row", _INTS), ("feature", _INTS), ("value", _LISTS)])

    def cut(batches):
        from pyspark import TaskContext

        many = np.ones(max(bands, default=0) + 1, np.int64)
        for fb, k in bands.items():
            many[fb] = k
        rb = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, row_block):
                part = batch.slice(at, row_block)
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
                sizes = np.array([len(x) for x in part.column(1)], np.int64)
                row, feature, value = np.repeat(np.arange(len(y)), sizes), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                if bias is not None:
                    row, feature = np.append(row, np.arange(len(y))), np.append(feature, np.full(len(y), bias))
                    value = np.append(value, np.ones(len(y)))
                fb, inside = feature // feature_block, feature % feature_block
                sub, number = inside % many[fb], inside // many[fb]
                order = np.lexsort((sub, fb))
                row, number, value, fb, sub = (x[order] for x in (row, number, value, fb, sub))
                edges = np.flatnonzero((np.diff(fb, prepend=-1) != 0) | (np.diff(sub, prepend=-1) != 0))
                out = [(-1, 0, rb, len(y), y, [], [])]
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(fb)]):
                    out.append((int(fb[a]), int(sub[a]), rb, len(y), row[a:b], number[a:b], value[a:b]))
                rb += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    plain = rows.select(F.col("y").cast("int"), F.col("indices").cast("array<int>"), F.col("values").cast("array<double>"))
    return materialize(plain.mapInArrow(cut, "fb int, sub int, rb bigint, n int, row array<int>, feature array<int>, value array<double>"), "cells")


_BANDS = "fb int, sub int, rb array<bigint>, n array<int>, sizes array<int>, row array<int>, feature array<int>, value array<double>"


def _merged(table: pa.Table) -> pa.Table:
    """The cells of a band end to end, one row."""
    lists = [pa.array([table[c].combine_chunks().flatten().to_numpy()], kind) for c, kind in (("row", _INTS), ("feature", _INTS), ("value", _LISTS))]
    names = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("fb", "sub")]
    counts = [pa.array([pc.list_value_length(table["row"]).to_numpy()], _INTS), pa.array([table["n"].to_numpy()], _INTS)]
    return pa.table([*names, pa.array([table["rb"].to_numpy()], pa.list_(pa.int64())), counts[1], counts[0], *lists], names=["fb", "sub", "rb", "n", "sizes", "row", "feature", "value"])


def whole_bands(cells: DataFrame) -> DataFrame:
    """One row per band: its cells end to end, with the ``sizes`` of them; stored."""
    return materialize(cells.filter("fb >= 0").groupBy("fb", "sub").applyInArrow(_merged, _BANDS), "bands")


def _segments(band: dict):
    """(rb, n, from, to) of the cells of a band."""
    ends = np.cumsum(band["sizes"].values.to_numpy()).tolist()
    return zip(band["rb"].values.to_pylist(), band["n"].values.to_pylist(), [0, *ends], ends)


def _rows_of(batch: pa.RecordBatch):
    return (dict(zip(batch.schema.names, values)) for values in zip(*batch.columns))


def _coefficients(band: dict, factors: dict, classes: int) -> np.ndarray:
    """X'a of a band's features, class by class; ``factors`` has those of each block of rows."""
    row, feature, value = (band[c].values.to_numpy() for c in ("row", "feature", "value"))
    heads = np.concatenate([factors[rb][:, row[a:b]] for rb, _, a, b in _segments(band)], axis=1) * value
    width = int(feature.max(initial=0)) + 1
    return np.stack([np.bincount(feature, h, minlength=width) for h in heads])


def _margins(band: dict, coefficients: np.ndarray, held: dict) -> None:
    """Adds what a band's ``coefficients`` give to the margins of its rows."""
    row, feature, value = (band[c].values.to_numpy() for c in ("row", "feature", "value"))
    for rb, n, a, b in _segments(band):
        heads = coefficients[:, feature[a:b]] * value[a:b]
        made = np.stack([np.bincount(row[a:b], h, minlength=n) for h in heads])
        held[rb] = held[rb] + made if rb in held else made


def _listed(held: dict, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.ravel() for m in held.values()], _LISTS)], names=["rb", name])


def _summed(parts: DataFrame, key: str, name: str) -> DataFrame:
    """Arrays of one length added up by ``key``."""
    kind = parts.schema[key].dataType.simpleString()

    def add(table: pa.Table) -> pa.Table:
        rows = table[name].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
        return pa.table({key: table[key].slice(0, 1), name: pa.array([total], _LISTS)})

    return parts.groupBy(key).applyInArrow(add, f"{key} {kind}, {name} array<double>")


def _direction(gram: np.ndarray, n: int) -> np.ndarray:
    """Factors of (coefficients, gradient, ``n`` steps, ``n`` gradient changes) in the L-BFGS direction, from their products."""
    factors = np.zeros(len(gram))
    factors[1] = 1.0
    kept = []
    for k in range(n - 1, -1, -1):
        s, t = 2 + k, 2 + n + k
        a = (gram[s] @ factors) / gram[s, t]
        factors[t] -= a
        kept.append((s, t, a))
    if n:
        factors *= gram[1 + n, 1 + 2 * n] / gram[1 + 2 * n, 1 + 2 * n]
    for s, t, a in reversed(kept):
        factors[s] += a - (gram[t] @ factors) / gram[s, t]
    return -factors


def _pass(bands: DataFrame | None, cells: DataFrame, factors: DataFrame, classes: int, make, kind: str) -> DataFrame:
    """What ``make`` gives for pairs of a band and the factors (rb, a) of its rows: sent to all tasks where ``bands`` are stored
    whole, else joined to the cells of each band."""
    if bands is not None:
        found = factors.toArrow()
        sent = factors.sparkSession.sparkContext.broadcast({rb: _matrix(a, classes) for rb, a in zip(found["rb"].to_pylist(), found["a"])})

        def local(batches):
            yield from make((band, sent.value) for batch in batches for band in _rows_of(batch))

        return bands.mapInArrow(local, kind)

    def group(table: pa.Table) -> pa.Table:
        own = {rb: _matrix(a, classes) for rb, a in zip(table["rb"].to_pylist(), table["a"])}
        merged = _merged(table)
        return pa.Table.from_batches(list(make([({c: merged[c][0] for c in merged.column_names}, own)])))

    return cells.filter("fb >= 0").join(factors, "rb").groupBy("fb", "sub").applyInArrow(group, kind)


def fit(
    rows: DataFrame, n_features: int, n_classes: int, cost: float = 1.0, max_iter: int = 2000, tol: float = 1e-4,
    feature_block: int = FEATURE_BLOCK, row_block: int = ROW_BLOCK, band: int = BAND, sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """(fb, w): coefficients by block, class by class, of rows (y, indices, values); the intercept is the feature after the
    last one."""
    spark = rows.sparkSession
    many = bands_of(rows, feature_block, band, bias=n_features)
    cells = cells_of(rows, many, feature_block, row_block, bias=n_features)
    counts = {r["y"]: r["n"] for r in cells.filter("fb = -1").select(F.explode("row").alias("y")).groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    bands = whole_bands(cells) if 8 * total * n_classes <= sent_bytes else None
    balance = np.array([total / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(n_classes)])
    # Of each vector (coefficients, gradient, steps, gradient changes) its factors a and its margins m.
    kind = "rb bigint, y array<int>, a array<array<double>>, m array<array<double>>"
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), F.size("row") * n_classes), 2)
    state = cells.filter("fb = -1").select("rb", F.col("row").alias("y"), zeros.alias("a"), zeros.alias("m"))
    paths = [fresh_path(spark, f"row-blocks-{k}") for k in (0, 1)]

    def blocks_of(batch: pa.RecordBatch):
        """(rb, y, factors, margins) of the row blocks in a batch, a vector a row."""
        for rb, y, *both in zip(batch.column("rb").to_pylist(), batch.column("y"), batch.column("a"), batch.column("m")):
            yield rb, y.values.to_numpy(), *(v.values.flatten().to_numpy().reshape(len(v.values), -1) for v in both)

    def slack(y: np.ndarray, m: np.ndarray):
        m = m.reshape(n_classes, -1)
        sign = np.where(y[None] == np.arange(n_classes)[:, None], 1.0, -1.0)
        weight = np.where(sign > 0, balance[:, None], 1.0)
        return sign, weight, np.maximum(0.0, 1.0 - sign * m)

    def summed(each) -> np.ndarray:
        """Numbers that ``each`` makes of a row block, added up over all of them."""
        def add(batches):
            found = 0.0
            for batch in batches:
                for _, y, a, m in blocks_of(batch):
                    found = found + each(y, a, m)
            if np.ndim(found):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["k", "x"])

        sums = state.mapInArrow(add, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        return np.array([r["x"] for r in sorted(sums, key=lambda r: r["k"])])

    def losses(lengths: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
        def each(y, a, m):
            d, found = (0.0 if factors is None else factors @ m), []
            for t in lengths:
                _, weight, s = slack(y, m[0] + t * d)
                found.append((weight * s * s).sum())
            return np.array(found)

        return summed(each)

    def products() -> np.ndarray:
        flat = summed(lambda y, a, m: (a @ m.T).ravel())
        gram = flat.reshape(int(round(np.sqrt(len(flat)))), -1)
        return (gram + gram.T) / 2

    def coefficients(of: int) -> DataFrame:
        """(fb, sub, t): the coefficients of a vector, band by band."""
        def make(pairs):
            for one, a in pairs:
                t = _coefficients(one, a, n_classes)
                yield pa.RecordBatch.from_arrays([pa.array([one["fb"].as_py()], pa.int32()), pa.array([one["sub"].as_py()], pa.int32()), pa.array([t.ravel()], _LISTS)], names=["fb", "sub", "t"])

        factors = state.select("rb", F.get("a", F.lit(of)).alias("a"))
        return _pass(bands, cells, factors, n_classes, make, "fb int, sub int, t array<double>")

    def moved(turn: int, length: float, factors: np.ndarray | None) -> DataFrame:
        """The row blocks after a step of ``length`` along the direction of ``factors``, with their gradient; stored."""
        def step(y, a, m):
            """The step, the coefficients and the gradient's factors after it."""
            made = [np.zeros_like(v[0]) if factors is None else length * (factors @ v) for v in (a, m)]
            after = [v[0] + s for v, s in zip((a, m), made)]
            sign, weight, s = slack(y, after[1])
            return made, after, after[0] + (-2.0 * cost * weight * sign * s).ravel()

        def push(batches):
            for batch in batches:
                found = {rb: step(y, a, m)[2] for rb, y, a, m in blocks_of(batch)}
                yield _listed(found, "a")

        def through(pairs):
            held: dict[int, np.ndarray] = {}
            for one, a in pairs:
                _margins(one, _coefficients(one, a, n_classes), held)
            yield _listed(held, "g")

        def update(batches):
            for batch in batches:
                out = []
                for (rb, y, a, m), g in zip(blocks_of(batch), batch.column("g")):
                    made, after, pushed = step(y, a, m)
                    n = len(a) // 2 - 1
                    lists = []
                    for v, s, w, gradient in zip((a, m), made, after, (pushed, g.values.to_numpy())):
                        keep = slice(1 if n == _MEMORY else 0, None)
                        history = [] if factors is None else [*v[2 : 2 + n][keep], s, *v[2 + n :][keep], gradient - v[1]]
                        lists.append([w, gradient, *history])
                    out.append((rb, y, *lists))
                nested = [pa.array([o[k] for o in out], pa.list_(_LISTS)) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], _INTS), *nested], names=["rb", "y", "a", "m"])

        pushed = state.mapInArrow(push, "rb bigint, a array<double>")
        gradient = _summed(_pass(bands, cells, pushed, n_classes, through, "rb bigint, g array<double>"), "rb", "g")
        state.join(gradient, "rb").mapInArrow(update, kind).write.mode("overwrite").parquet(paths[turn % 2])
        return spark.read.schema(kind).parquet(paths[turn % 2])

    state = moved(0, 0.0, None)
    if bands is not None:
        dropped(cells)
    value, first = cost * losses(np.zeros(1)).sum(), None
    for turn in range(1, max_iter + 1 if total else 1):
        gram = products()
        norm = float(np.sqrt(max(gram[1, 1], 0.0)))
        first = norm if first is None else first
        if norm <= tol * max(first, 1e-12):
            break
        n = (len(gram) - 2) // 2
        usable = [k for k in range(n) if gram[2 + k, 2 + n + k] > 1e-12]
        chosen = [0, 1, *[2 + k for k in usable], *[2 + n + k for k in usable]]
        factors = np.zeros(len(gram))
        factors[chosen] = _direction(gram[np.ix_(chosen, chosen)], len(usable))
        slope = float(gram[1] @ factors)
        longest = 1.0
        if not usable:
            absolute = coefficients(1).select(F.aggregate("t", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("x")).agg(F.sum("x")).first()[0]
            longest = min(1.0, 1.0 / max(absolute, 1e-12))
        lengths = longest * 0.5 ** np.arange(_HALVINGS)
        # |w + t p|^2 from the products alone.
        square = gram[0, 0] + 2 * lengths * (gram[0] @ factors) + lengths**2 * (factors @ gram @ factors)
        values = 0.5 * square + cost * losses(lengths, factors)
        fine = np.flatnonzero(values <= value + 1e-4 * lengths * slope)
        if not len(fine):
            break
        length, value = float(lengths[fine[0]]), float(values[fine[0]])
        state = moved(turn, length, factors)
    else:
        if total:
            warnings.warn(f"the fit stopped after {max_iter} steps before its gradient was small", stacklevel=2)

    def whole(table: pa.Table) -> pa.Table:
        fb = table["fb"][0].as_py()
        w = np.zeros((n_classes, feature_block))
        for sub, t in zip(table["sub"].to_pylist(), table["t"]):
            t = _matrix(t, n_classes)
            w[:, sub : sub + many[fb] * t.shape[1] : many[fb]] = t
        return pa.table({"fb": pa.array([fb], pa.int32()), "w": pa.array([w.ravel()], _LISTS)})

    made = coefficients(0).groupBy("fb").applyInArrow(whole, "fb int, w array<double>")
    every = spark.range(-(-(n_features + 1) // feature_block)).select(F.col("id").cast("int").alias("fb"))
    none = F.array_repeat(F.lit(0.0), n_classes * feature_block)
    return materialize(every.join(made, "fb", "left").select("fb", F.coalesce("w", none).alias("w")), "coefficients")


def scores(rows: DataFrame, model: DataFrame, n_features: int, n_classes: int, feature_block: int = FEATURE_BLOCK, row_block: int = ROW_BLOCK, band: int = BAND) -> DataFrame:
    """(y, scores) of rows (y, indices, values): one score per class."""
    many = bands_of(rows, feature_block, band, bias=n_features)
    cells = cells_of(rows, many, feature_block, row_block, bias=n_features)

    def deal(batches):
        for batch in batches:
            for fb, w in zip(batch.column(0).to_pylist(), batch.column(1)):
                w, k = _matrix(w, n_classes), many.get(fb, 0)
                yield pa.RecordBatch.from_arrays([pa.array([fb] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([w[:, sub::k].ravel() for sub in range(k)], _LISTS)], names=["fb", "sub", "t"])

    def multiply(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for one in _rows_of(batch):
                _margins(one, _matrix(one["t"], n_classes), held)
        yield _listed(held, "w")

    dealt = model.select("fb", "w").mapInArrow(deal, "fb int, sub int, t array<double>")
    parts = whole_bands(cells).join(dealt, ["fb", "sub"]).mapInArrow(multiply, "rb bigint, w array<double>")
    found = _summed(parts, "rb", "w")
    n = F.size("row")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("row", i).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.get("w", c * n + i)).alias("scores")))
    return cells.filter("fb = -1").select("rb", "row").join(found, "rb").select(F.inline(each))
