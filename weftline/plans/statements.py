"""SQL of learners, written out step by step from rules: eliminations, descents, trees and boosting rounds."""

from __future__ import annotations


def moment_sums(features: list[str], target: str) -> str:
    """Sums of products, intercept first: x0_0, x0_1, ..., y0, ..., yy."""
    x = ["1.0", *(f"{f}::DOUBLE" for f in features)]
    out = [f"sum({a} * {b}) AS x{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return ", ".join([*out, *(f"sum({a} * {target}) AS y{i}" for i, a in enumerate(x)), f"sum({target}::DOUBLE * {target}) AS yy"])


def names(d: int) -> list[str]:
    return [f"x{i}_{j}" for i in range(d) for j in range(i, d)] + [f"y{i}" for i in range(d)] + ["yy"]


def solved(name: str, source: str, d: int, keys: tuple[str, ...] = (), l2: str = "0.0") -> str:
    """CTEs that solve the d normal equations of ``source`` by elimination; ``name`` has the keys and w0, w1, ..."""
    key = "".join(f"{k}, " for k in keys)
    cell = lambda i, j: f"m{i}_{j}"
    first = [f"x{min(i, j)}_{max(i, j)}{f' + {l2}' if i == j and i else ''} AS {cell(i, j)}" for i in range(d) for j in range(d)]
    out = [f"{name}_e0 AS (SELECT {key}{', '.join(first)}, {', '.join(f'y{i} AS b{i}' for i in range(d))} FROM {source})"]
    for p in range(d - 1):
        cols = [(f"{cell(i, j)} - {cell(i, p)} / {cell(p, p)} * {cell(p, j)}" if i > p else cell(i, j)) + f" AS {cell(i, j)}" for i in range(d) for j in range(d)]
        right = [(f"b{i} - {cell(i, p)} / {cell(p, p)} * b{p}" if i > p else f"b{i}") + f" AS b{i}" for i in range(d)]
        out.append(f"{name}_e{p + 1} AS (SELECT {key}{', '.join(cols + right)} FROM {name}_e{p})")
    before = f"{name}_e{d - 1}"
    for i in range(d - 1, -1, -1):
        value = " - ".join([f"b{i}", *(f"{cell(i, j)} * w{j}" for j in range(i + 1, d))])
        step = name if i == 0 else f"{name}_s{i}"
        out.append(f"{step} AS (SELECT *, ({value}) / {cell(i, i)} AS w{i} FROM {before})")
        before = step
    return ",\n".join(out)


def rss(m: str, w: str, d: int) -> str:
    """Residual sum of squares of weights w under moments m."""
    linear = " - ".join(f"2 * {w}.w{i} * {m}.y{i}" for i in range(d))
    square = " + ".join(f"{'' if i == j else '2 * '}{w}.w{i} * {w}.w{j} * {m}.x{i}_{j}" for i in range(d) for j in range(i, d))
    return f"({m}.yy - {linear} + {square})"


def listed(features: list[str], source: str, d: int, digits: int = 4, more: str = "") -> str:
    """One row for each weight."""
    return " UNION ALL ".join(f"SELECT '{f}' AS name, round(w{i}, {digits}) AS value{more} FROM {source}" for i, f in enumerate(["(intercept)", *features][:d]))


def ridge_descent(d: int, step: str, l2: float, steps: int) -> str:
    """Recursive CTE ``w``: ``steps`` gradient steps from zero on the moments ``m``."""
    x = lambda i, j: f"m.x{min(i, j)}_{max(i, j)}"
    new = [f"w{i} - {step} * (2 * ({' + '.join(f'{x(i, j)} * w{j}' for j in range(d))} - m.y{i}){f' + {2 * l2} * w{i}' if i else ''})" for i in range(d)]
    return f"w(t, {', '.join(f'w{i}' for i in range(d))}) AS (SELECT 0, {', '.join(['0.0::DOUBLE'] * d)} UNION ALL SELECT t + 1, {', '.join(new)} FROM w, m WHERE t < {steps})"


def lasso(name: str, moments: str, penalties: str, d: int, tolerance: float, sweeps: int = 20_000) -> str:
    """Recursive CTE of cyclic coordinate descent on unit-norm columns, a run for each ``l1`` of ``penalties``.

    ``name`` has l1 and w0, w1, ... on the original scale.
    """
    x = lambda i, j: f"n{min(i, j)}_{max(i, j)}"
    norm = [f"x{i}_{j} / sqrt(x{i}_{i} * x{j}_{j}) AS n{i}_{j}" for i in range(d) for j in range(i, d)] + [f"y{i} / sqrt(x{i}_{i}) AS z{i}" for i in range(d)] + [f"sqrt(x{i}_{i}) AS r{i}" for i in range(d)]
    inner = f"SELECT s.*, u.* FROM {name}_r s, {name}_n u WHERE t < {sweeps} AND change >= {tolerance!r}"
    for i in range(d):
        at = lambda j: f"v{j}" if j < i else f"w{j}"  # noqa: B023, E731
        rho = f"z{i} - ({' + '.join(f'{x(i, j)} * {at(j)}' for j in range(d) if j != i)})"
        value = rho if i == 0 else f"sign({rho}) * greatest(abs({rho}) - l1 / 2, 0.0)"
        inner = f"SELECT *, {value} AS v{i} FROM ({inner})"
    change = "greatest(" + ", ".join(f"abs(v{i} - w{i})" for i in range(d)) + ")"
    cols = ", ".join(f"w{i}" for i in range(d))
    run = f"{name}_r(l1, t, change, {cols}) AS (SELECT l1, 0, 1e300::DOUBLE, {', '.join(['0.0::DOUBLE'] * d)} FROM {penalties} UNION ALL SELECT l1, t + 1, {change}, {', '.join(f'v{i}' for i in range(d))} FROM ({inner}))"
    out = f"{name} AS (SELECT l1, {', '.join(f'w{i} / r{i} AS w{i}' for i in range(d))} FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY t DESC) AS last FROM {name}_r), {name}_n WHERE last = 1)"
    return f"{name}_n AS (SELECT {', '.join(norm)} FROM {moments}),\n{run},\n{out}"


def logistic(name: str, rows: str, features: list[str], steps: int, l2s: list[float], rate: str = "2.0 / n") -> str:
    """Recursive CTE of full-gradient steps over the grouped rows (features, y of 0 or 1, c their number).

    ``name`` has l2, t, the weights w after t steps and the log likelihood before the next step.
    """
    x = ["1.0", *(f"g.{f}" for f in features)]
    d = len(x)
    score = " + ".join(f"{a} * s.w[{i + 1}]" for i, a in enumerate(x))
    gradient = [f"sum(g.c * ({a}) * (g.y - 1 / (1 + exp(-({score})))))" for a in x]
    new = [f"any_value(s.w[{i + 1}]) + any_value({rate}) * ({g}{f' - 2 * s.l2 * any_value(s.w[{i + 1}])' if i else ''})" for i, g in enumerate(gradient)]
    starts = " UNION ALL ".join(f"SELECT {l2!r}::DOUBLE AS l2" for l2 in l2s)
    run = f"{name} AS (SELECT l2, 0 AS t, {[0.0] * d}::DOUBLE[] AS w FROM ({starts}) UNION ALL SELECT s.l2, s.t + 1, [{', '.join(new)}] FROM {name} s, {rows} g, {rows}_n WHERE s.t < {steps} GROUP BY s.l2, s.t)"
    return f"{rows}_n AS (SELECT sum(c)::DOUBLE AS n FROM {rows}),\n{run}"


def tree(name: str, rows: str, features: list[str], depth: int, min_size: float = 0, min_reduction: float | None = None) -> str:
    """CTEs that grow a tree level by level on ``rows`` (binary features, y of +1 or -1).

    ``name``: node, depth, feature, left, right, prediction, m (mistakes of a leaf), numbered in order of levels.
    """
    cols = ", ".join(features)
    out = [f"{name}_g0 AS (SELECT {cols}, y, count(*)::DOUBLE AS c, 0 AS node, ''::VARCHAR AS used FROM {rows} GROUP BY ALL)"]
    parts, total = [], "1"
    for level in range(depth + 1):
        sums = ["coalesce(sum(c) FILTER (y = 1), 0) AS p", "coalesce(sum(c) FILTER (y = -1), 0) AS m"]
        for k, f in enumerate(features):
            sums += [f"coalesce(sum(c) FILTER (y = 1 AND {f} = 0), 0) AS p{k}", f"coalesce(sum(c) FILTER (y = -1 AND {f} = 0), 0) AS m{k}"]
        out.append(f"{name}_s{level} AS (SELECT node, used, {', '.join(sums)} FROM {name}_g{level} GROUP BY node, used)")
        errors = [f"CASE WHEN contains(used, '|{f}|') THEN 1e300 ELSE least(p{k}, m{k}) + least(p - p{k}, m - m{k}) END AS e{k}" for k, f in enumerate(features)]
        out.append(f"{name}_t{level} AS (SELECT *, least({', '.join(f'e{k}' for k in range(len(features)))}) AS e FROM (SELECT *, {', '.join(errors)} FROM {name}_s{level}))")
        which = "CASE " + " ".join(f"WHEN e{k} <= e + 1e-12 THEN {k}" for k in range(len(features))) + " END"
        at = lambda v: "CASE k " + " ".join(f"WHEN {k} THEN {v}{k}" for k in range(len(features))) + " END"
        rule = f"least(p, m) > 1e-15 AND {level} < {depth} AND p + m > {min_size} AND e < 1e299 AND l > 1e-12 AND p + m - l > 1e-12"
        if min_reduction is not None:
            rule += f" AND (least(p, m) - e) / (p + m) > {min_reduction}"
        out.append(f"{name}_u{level} AS (SELECT *, {rule} AS split FROM (SELECT *, {at('p')} + {at('m')} AS l FROM (SELECT *, {which} AS k FROM {name}_t{level})))")
        out.append(f"{name}_n{level} AS (SELECT *, CASE WHEN split THEN ({total} + 2 * (sum(split::INT) OVER (ORDER BY node) - 1))::INT END AS child FROM {name}_u{level})")
        label = "CASE k " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(features)) + " END"
        parts.append(f"SELECT node, {level} AS depth, CASE WHEN split THEN {label} END AS feature, child AS \"left\", child + 1 AS \"right\", CASE WHEN NOT split THEN CASE WHEN p > m THEN 1 ELSE -1 END END AS prediction, CASE WHEN NOT split THEN least(p, m) END AS m FROM {name}_n{level}")
        value = "CASE k " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(features)) + " END"
        out.append(f"{name}_g{level + 1} AS (SELECT {', '.join(f'g.{f}' for f in features)}, g.y, g.c, (child + {value})::INT AS node, g.used || '|' || {label} || '|' AS used FROM {name}_g{level} g JOIN {name}_n{level} n ON g.node = n.node WHERE split)")
        total = f"{total} + 2 * (SELECT coalesce(sum(split::INT), 0) FROM {name}_u{level})"
    out.append(f"{name} AS ({' UNION ALL '.join(parts)})")
    return ",\n".join(out)


def boosting(name: str, rows: str, features: list[str], rounds: int) -> str:
    """CTEs of boosting rounds with stumps; ``name``: stage, vote and the error of the first stage stumps together."""
    cols = ", ".join(features)
    out = [f"{name}_0 AS (SELECT {cols}, y, count(*)::DOUBLE AS c, 0.0::DOUBLE AS margin FROM {rows} GROUP BY ALL)"]
    parts = []
    for r in range(1, rounds + 1):
        before = f"{name}_{r - 1}"
        out.append(f"{name}_a{r} AS (SELECT *, c * exp(-margin * y) / (SELECT sum(c * exp(-margin * y)) FROM {before}) AS a FROM {before})")
        sums = ["coalesce(sum(a) FILTER (y = 1), 0) AS p", "coalesce(sum(a) FILTER (y = -1), 0) AS m"]
        for k, f in enumerate(features):
            sums += [f"coalesce(sum(a) FILTER (y = 1 AND {f} = 0), 0) AS p{k}", f"coalesce(sum(a) FILTER (y = -1 AND {f} = 0), 0) AS m{k}"]
        errors = [f"least(p{k}, m{k}) + least(p - p{k}, m - m{k}) AS e{k}" for k in range(len(features))]
        out.append(f"{name}_s{r} AS (SELECT *, least({', '.join(f'e{k}' for k in range(len(features)))}) AS e FROM (SELECT *, {', '.join(errors)} FROM (SELECT {', '.join(sums)} FROM {name}_a{r})))")
        which = "CASE " + " ".join(f"WHEN e{k} <= e + 1e-12 THEN {k}" for k in range(len(features))) + " END"
        at = lambda v: "CASE k " + " ".join(f"WHEN {k} THEN {v}{k}" for k in range(len(features))) + " END"
        out.append(f"{name}_k{r} AS (SELECT *, {at('p')} AS lp, {at('m')} AS lm FROM (SELECT *, {which} AS k FROM {name}_s{r}))")
        # a stump that splits off nothing is one leaf
        whole = "(lp + lm <= 1e-12 OR p + m - lp - lm <= 1e-12 OR least(p, m) <= 1e-15)"
        sign = lambda a, b: f"CASE WHEN {a} >= {b} THEN 1 ELSE -1 END"
        out.append(f"{name}_v{r} AS (SELECT *, 0.5 * ln((1 - err) / err) AS vote FROM (SELECT *, least(greatest(CASE WHEN whole THEN least(p, m) ELSE e END, 1e-12), 1 - 1e-12) AS err, CASE WHEN whole THEN {sign('p', 'm')} ELSE {sign('lp', 'lm')} END AS zero, CASE WHEN whole THEN {sign('p', 'm')} ELSE {sign('p - lp', 'm - lm')} END AS one FROM (SELECT *, {whole} AS whole FROM {name}_k{r})))")
        value = "CASE k " + " ".join(f"WHEN {k} THEN b.{f}" for k, f in enumerate(features)) + " END"
        out.append(f"{name}_{r} AS (SELECT {', '.join(f'b.{f}' for f in features)}, b.y, b.c, b.margin + vote * CASE WHEN {value} = 0 THEN zero ELSE one END AS margin FROM {before} b, {name}_v{r})")
        parts.append(f"SELECT {r} AS stage, (SELECT vote FROM {name}_v{r}) AS vote, (SELECT sum(c) FILTER ((margin > 0) <> (y = 1)) / sum(c) FROM {name}_{r}) AS error")
    out.append(f"{name} AS ({' UNION ALL '.join(parts)})")
    return ",\n".join(out)
