"""M6: the most likely path of states along ordered rows, stretch by stretch.

No task holds a chromosome. A stretch of rows is a product of max-plus matrices: the best score from each state before it
to each state at its end. One row for each stretch carries these over: products applied one after the other give the
scores with which each stretch begins. With them a stretch runs forward and keeps, for each state it may end in, the path
that leads there and the state before it that the path comes from. These choices are composed from the end of the
chromosome backwards, again over one row for each stretch, and every row looks up its state.

Scores are whole multiples of 2^-32, so that sums do not depend on how rows are cut into stretches and equal scores tie
in the same way as in one loop over all rows: of equal predecessors the first state holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .shared import written

SCALE = 2.0**32
#: The score of what cannot be, and what is below half of it cannot be either.
NEVER = -(1 << 61)
#: Units of the order column in one stretch: a few thousand bins of 1 kb.
WIDTH = 1 << 22


def fixed(logs):
    """Logs as whole multiples of 1 / SCALE; null and minus infinity are NEVER."""
    import numpy as np

    x = np.array(logs, dtype=float)
    x[np.isnan(x)] = -np.inf
    out = np.full(x.shape, NEVER, np.int64)
    real = x > NEVER / SCALE
    out[real] = np.rint(x[real] * SCALE)
    return out


def transitions(states: int, trans_prob: float, weights=None, trans_logs=None):
    """Logs of the moves from each state (rows) to each state.

    One probability moves to each other state, what is left stays; weights multiply these before the log. A matrix of
    logs, if given, stands instead.
    """
    import numpy as np

    if trans_logs is not None:
        logs = np.array(trans_logs, dtype=float)
        if logs.shape != (states, states):
            raise ValueError(f"{states} states need a matrix of {states} rows and columns of log probabilities")
        return logs
    p = np.full((states, states), float(trans_prob))
    np.fill_diagonal(p, 1 - trans_prob * (states - 1))
    if weights is not None:
        p = p * np.array(weights, dtype=float)
    if (p < 0).any():
        raise ValueError("a move has a negative probability")
    with np.errstate(divide="ignore"):
        return np.log(p)


def _emissions(table, states: int, forced: str | None):
    """Scores of each row and state, the row's best subtracted; a row without a possible state is free in all."""
    import numpy as np

    lists = table["emissions"].combine_chunks()
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    logs = np.full((len(there), states), -np.inf)
    logs[there] = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, states)
    logs[np.isnan(logs)] = -np.inf
    if forced:
        given = table[forced].combine_chunks()
        known = given.is_valid().to_numpy(zero_copy_only=False)
        logs[known] = -np.inf
        logs[known, given.fill_null(1).to_numpy(zero_copy_only=False).astype(int)[known] - 1] = 0.0
    best = logs.max(1, keepdims=True)
    logs[~np.isfinite(best[:, 0])] = 0.0
    best[~np.isfinite(best)] = 0.0
    return fixed(logs - best)


def _sorted(table, order: str, reverse: bool):
    import pyarrow.compute as pc

    return table.take(pc.sort_indices(table, [(order, "descending" if reverse else "ascending")]))


def _product(keys: list[str], order: str, states: int, move, forced, reverse: bool):
    def run(table):
        import numpy as np
        import pyarrow as pa

        e = _emissions(_sorted(table, order, reverse), states, forced)
        # Rows: from each state before the stretch, and, last, from the start of the chromosome.
        best = np.vstack([np.maximum(move + e[0], NEVER), e[:1]])
        for row in e[1:]:
            best = np.maximum((best[:, :, None] + move).max(1) + row, NEVER)
        one = {k: table[k].slice(0, 1) for k in [*keys, "_stretch"]}
        return pa.table(one | {"_n": pa.array([len(e)], pa.int64()), "_product": pa.array([best.ravel().tolist()], pa.list_(pa.int64()))})

    return run


def _carried(keys: list[str], states: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        table = _sorted(table, "_stretch", False)
        products = table["_product"].combine_chunks().flatten().to_numpy().reshape(-1, states + 1, states)
        before, starts = None, []
        for product in products:
            starts.append(None if before is None else before.tolist())
            after = product[states] if before is None else np.maximum((before[:, None] + product[:states]).max(0), NEVER)
            # A common shift changes no path and keeps scores in range; what cannot be stays so.
            before = np.where(after <= NEVER // 2, NEVER, np.maximum(after - after.max(), NEVER))
        # One row alone is no path; nor is there one if each of them is impossible.
        known = len(products) > 1 or table["_n"][0].as_py() > 1
        last = int(before.argmax()) if known and before.max() > NEVER // 2 else -1
        lasts = [None] * (len(products) - 1) + [last]
        return pa.table({k: table[k] for k in [*keys, "_stretch"]} | {"_start": pa.array(starts, pa.list_(pa.int64())), "_last": pa.array(lasts, pa.int32())})

    return run


def _paths(order: str, states: int, move, forced, reverse: bool):
    def run(table, carried):
        import numpy as np
        import pyarrow as pa

        table = _sorted(table, order, reverse)
        e, start = _emissions(table, states, forced), carried["_start"][0].as_py()
        back = np.zeros(e.shape, np.int32)
        score = None if start is None else np.array(start, np.int64)
        for t, row in enumerate(e):
            if score is None:
                score = row
                continue
            ways = score[:, None] + move
            back[t] = ways.argmax(0)
            score = np.maximum(ways.max(0) + row, NEVER)
        path = np.empty(e.shape, np.int32)
        path[-1] = np.arange(states)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][path[t]]
        came = back[0][path[0]].tolist()
        ends = pa.array(np.arange(0, path.size + 1, states, dtype=np.int32))
        kept = table.drop_columns("emissions")
        kept = kept.append_column("_path", pa.ListArray.from_arrays(ends, pa.array(path.ravel())))
        return kept.append_column("_came", pa.array([came] + [None] * (len(e) - 1), pa.list_(pa.int32()))).append_column("_last", pa.array([carried["_last"][0].as_py()] * len(e), pa.int32()))

    return run


def _ended(keys: list[str]):
    def run(table):
        import pyarrow as pa

        table = _sorted(table, "_stretch", True)
        end, ends = table["_last"][0].as_py(), []
        for came in table["_came"].to_pylist():
            ends.append(end)
            end = came[end] if end >= 0 else -1
        return pa.table({f"_e_{k}": table[k] for k in [*keys, "_stretch"]} | {"_end": pa.array(ends, pa.int32())})

    return run


def viterbi_by_key(rows: DataFrame, keys: list[str], order: str, trans_prob: float = 1e-6, *, weights=None, trans_logs=None, forced: str | None = None, reverse: bool = False, states: int | None = None, width: int = WIDTH) -> DataFrame:
    """M6: rows without `emissions` (log-likelihoods of each state) but with `state`, from 1, of the best path along `order` within keys.

    Null and NaN emissions count as minus infinity; a row whose states are all impossible (or whose array is null) is
    free in all of them. `forced` names a column with the state that a row must have, null for none. reverse: from the
    last row to the first, which decides between equal paths and uses the moves the other way round. A stretch has
    `width` units of `order`. Keys with one row, or without any possible path, have null states; empty tables have none.
    """
    if states is None:
        states = rows.agg(F.max(F.size("emissions"))).first()[0] or 1
    move = fixed(transitions(states, trans_prob, weights, trans_logs))
    slot = F.floor(F.col(order) / width)
    dealt = rows.withColumn("_stretch", -slot if reverse else slot)
    by = [*keys, "_stretch"]
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema}
    key_kinds = ", ".join(kinds[k] for k in by)
    needed = dealt.select(*by, order, "emissions", *([forced] if forced else []))
    products = needed.groupBy(*by).applyInArrow(_product(keys, order, states, move, forced, reverse), f"{key_kinds}, _n long, _product array<long>")
    carried = products.groupBy(*keys).applyInArrow(_carried(keys, states), f"{key_kinds}, _start array<long>, _last int")
    own = ", ".join(v for k, v in kinds.items() if k != "emissions")
    paths = dealt.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(_paths(order, states, move, forced, reverse), f"{own}, _path array<int>, _came array<int>, _last int")
    paths = written(paths, "paths")
    heads = paths.where("_came IS NOT NULL").select(*by, "_came", "_last")
    ends = heads.groupBy(*keys).applyInArrow(_ended(keys), f"{', '.join(f'`_e_{k}` {dealt.schema[k].dataType.simpleString()}' for k in by)}, _end int")
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`_e_{k}`")) for k in by))
    state = F.when(F.col("_end") >= 0, F.get("_path", F.col("_end")) + 1).cast("int").alias("state")
    return paths.join(ends, same).select(*(f"`{c}`" for c in rows.columns if c != "emissions"), state)
