"""Least squares and regression trees in DuckDB's SQL, for comparison with fitted models."""

from __future__ import annotations

from collections.abc import Sequence


def values(features: Sequence[str]) -> str:
    return ", ".join(f"CAST(COALESCE({f}, 0) AS DOUBLE)" for f in features)


def least_squares(name: str, source: str, features: Sequence[str]) -> dict[str, str]:
    """Sub-queries that end in ``name``: one row of ``b``, a coefficient each, and ``intercept``.

    ``source`` has the list ``x`` of inputs, the target ``y`` and ``learn``, true for the rows to
    learn from. The moments are scaled by the deviations and eliminated input by input.
    """
    n = len(features)
    columns = [f"x[{i + 1}]" for i in range(n)] + ["y"]
    moments = ", ".join(
        "[" + ", ".join(f"COVAR_POP({columns[min(i, j)]}, {columns[max(i, j)]})" for j in range(n + 1)) + "]"
        for i in range(n)
    )
    scaled = f"""list_transform(m, lambda row, i: list_transform(row, lambda v, j:
        v / s[i] / CASE WHEN j <= {n} THEN s[j] ELSE 1 END))"""
    return {
        f"{name}_moments": f"""
SELECT [{moments}] AS m, [{", ".join(f"STDDEV_POP({c})" for c in columns[:-1])}] AS s,
       [{", ".join(f"AVG({c})" for c in columns[:-1])}] AS means, AVG(y) AS mean
FROM {source} WHERE learn""",
        f"{name}_steps": f"""
SELECT 1 AS k, {scaled} AS m FROM {name}_moments
UNION ALL
SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
    THEN list_transform(row, lambda v: v / m[k][k])
    ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END)
FROM {name}_steps WHERE k <= {n}""",
        name: f"""
SELECT b, mean - list_dot_product(b, means) AS intercept
FROM (SELECT list_transform(t.m, lambda row, i: row[{n + 1}] / s[i]) AS b, means, mean
      FROM {name}_steps t, {name}_moments WHERE k = {n + 1})""",
    }


def tree(name: str, source: str, depth: int, least_rows: int, least_gain: float) -> dict[str, str]:
    """Sub-queries that end in ``name``: the rows of ``source`` with the ``leaf`` mean of ``goal``.

    ``source`` has ``Store``, ``Date``, the list ``x``, the ``goal`` and ``learn``. Every node is
    split by the input and the midpoint between two of its values that lower the variance most.
    ``<name>_gains`` has what each input's splits gain times the node's rows.
    """
    found = {f"{name}_rows0": f"SELECT *, 1::BIGINT AS node FROM {source}"}
    for level in range(depth):
        rows, split = f"{name}_rows{level}", f"{name}_split{level}"
        found[split] = f"""
SELECT node, n, arg_max(feature, (gain, -feature)) AS feature,
       arg_max(threshold, (gain, -feature)) AS threshold, MAX(gain) AS gain
FROM (
    SELECT node, feature, n, threshold,
           (ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n) / n AS gain, ln
    FROM (
        SELECT node, feature, (value + LEAD(value) OVER up) / 2 AS threshold,
               SUM(k) OVER up AS ln, SUM(part) OVER up AS ls,
               SUM(k) OVER (PARTITION BY node, feature) AS n,
               SUM(part) OVER (PARTITION BY node, feature) AS s
        FROM (
            SELECT node, feature, value, COUNT(*) AS k, SUM(goal) AS part
            FROM (SELECT node, goal, UNNEST(x) AS value, generate_subscripts(x, 1) AS feature
                  FROM {rows} WHERE learn)
            GROUP BY node, feature, value)
        WINDOW up AS (PARTITION BY node, feature ORDER BY value))
    WHERE threshold IS NOT NULL AND ln >= {least_rows} AND n - ln >= {least_rows})
WHERE gain > 0 AND gain >= {least_gain} GROUP BY node, n"""
        found[f"{name}_rows{level + 1}"] = f"""
SELECT r.* REPLACE (CASE WHEN s.node IS NULL THEN r.node
    ELSE 2 * r.node + (r.x[s.feature] > s.threshold)::BIGINT END AS node)
FROM {rows} r LEFT JOIN {split} s ON r.node = s.node"""
    found[f"{name}_gains"] = " UNION ALL ".join(
        f"SELECT node, feature, gain * n AS gained FROM {name}_split{level}" for level in range(depth)
    )
    found[name] = f"""
SELECT r.*, leaf FROM {name}_rows{depth} r JOIN (
    SELECT node, AVG(goal) AS leaf FROM {name}_rows{depth} WHERE learn GROUP BY node) l
ON r.node = l.node"""
    return found


def boosted(
    name: str, source: str, rounds: int, step: float, depth: int, least_rows: int, least_gain: float
) -> dict[str, str]:
    """Sub-queries that end in ``name``: the rows of ``source`` with the boosted ``prediction``.

    ``source`` is as for :func:`tree`, with the target ``y`` in place of the goal. The first tree
    counts in full; each later one learns twice what is left and counts ``step``.
    """
    found, last = {}, None
    for i in range(rounds):
        goal = f"{name}_goal{i}"
        if last is None:
            found[goal] = f"SELECT *, y AS goal, 0.0::DOUBLE AS sofar FROM {source}"
        else:
            weight = 1.0 if i == 1 else step
            found[goal] = f"""
SELECT * EXCLUDE (node, leaf, goal, sofar), sofar + {weight}::DOUBLE * leaf AS sofar,
       2 * (y - (sofar + {weight}::DOUBLE * leaf)) AS goal FROM {last}"""
        last = f"{name}_tree{i}"
        found |= tree(last, goal, depth, least_rows, least_gain)
    weight = 1.0 if rounds == 1 else step
    found[name] = f"SELECT *, sofar + {weight}::DOUBLE * leaf AS prediction FROM {last}"
    return found
