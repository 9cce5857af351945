"""The grid fit as SQL text: the same rounds and valleys as chained CTEs over exploded grid rows."""

from __future__ import annotations

from tidemark.operators.fit import ROUNDS, STEPS, TIE_DIGITS, VALLEYS, Box

KEYS = "class_age, site, campaign"


def _value(b: str, c: str, x: str) -> str:
    return (f"CASE model WHEN 'Logistic' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-{b} * ({x} - {c}))) "
            f"ELSE exp(-exp(-{b} * ({x} - {c}))) END")


def curve_value(x: str, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> str:
    return f"(coalesce({d}, 0) + {a} * {_value(b, c, x)})"


def _clamp(value: str, bounds) -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN greatest({bounds[0]}::DOUBLE, least({bounds[1]}::DOUBLE, {value})) END"


def _asymptotes(box: Box, sums: str) -> str:
    carried = f"{KEYS}, model, s, b, c, n, sf, sff, sy, sfy, syy"
    if box.d is None:
        return f"""SELECT {KEYS}, model, s, b, c, a, 0.0::DOUBLE AS d, greatest(syy - 2 * a * sfy + a * a * sff, 0) AS rss
  FROM (SELECT {carried}, {_clamp('sfy / nullif(sff, 0)', box.a)} AS a FROM {sums}) WHERE a IS NOT NULL"""
    det = "(n * sff - sf * sf)"
    inner_a = f"(n * sfy - sf * sy) / CASE WHEN {det} > n * sff * 1e-12 THEN {det} END"
    options = [f"SELECT {carried}, 0 AS o, a, (sy - a * sf) / n AS d FROM (SELECT {carried}, {inner_a} AS a FROM {sums}) "
               f"WHERE a BETWEEN {box.a[0]} AND {box.a[1]} AND (sy - a * sf) / n BETWEEN {box.d[0]} AND {box.d[1]}"]
    for e in box.a:
        options.append(f"SELECT {carried}, {len(options)}, {e}::DOUBLE, {_clamp(f'(sy - {e} * sf) / n', box.d)} FROM {sums}")
    for e in box.d:
        options.append(f"SELECT {carried}, {len(options)}, {_clamp(f'(sfy - {e} * sf) / nullif(sff, 0)', box.a)}, "
                       f"{e}::DOUBLE FROM {sums}")
    union = " UNION ALL ".join(options)
    rss = "greatest(syy - 2 * a * sfy - 2 * d * sy + a * a * sff + 2 * a * d * sf + n * d * d, 0)"
    return f"""SELECT {KEYS}, model, s, b, c, a, d, rss
  FROM (SELECT *, {rss} AS rss FROM ({union}) WHERE a IS NOT NULL AND d IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY {KEYS}, model, s, b, c ORDER BY rss, o) = 1"""


def fits_sql(source: str, x: str, y: str, box: Box, name: str = "fits", models=("Logistic", "Gompertz"),
             steps: int = STEPS, rounds: int = ROUNDS, top: int = VALLEYS, tie_digits: int = TIE_DIGITS,
             perfect: str = "1e-12") -> str:
    """The box, then ``rounds`` - 1 finer grids around each of the ``top`` lowest valleys; the best of them is the fit."""
    last, p = steps - 1, name
    half_b, half_c = ((hi - lo) / last * 1.5 for lo, hi in (box.b, box.c))
    sums = (f"{KEYS}, model, s, b, c, sum(n) AS n, sum(n * f) AS sf, sum(n * f * f) AS sff, sum(sy) AS sy, "
            f"sum(f * sy) AS sfy, sum(syy) AS syy")
    order = f"ORDER BY round(rss, {tie_digits}), b, c"
    out = f"""{p}_pts AS (
  SELECT {KEYS}, {x}::DOUBLE AS x, count(*)::DOUBLE AS n, sum({y}) AS sy, sum({y} * {y}) AS syy
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
{p}_models(model) AS (VALUES {', '.join(f"('{m}')" for m in models)}),
{p}_steps AS (SELECT i // {steps} AS ib, i % {steps} AS ic FROM range({steps * steps}) r(i)),
{p}_grid0 AS (
  SELECT {box.b[0]}::DOUBLE + ({box.b[1]}::DOUBLE - {box.b[0]}) * ib::DOUBLE / {last} AS b,
         {box.c[0]}::DOUBLE + ({box.c[1]}::DOUBLE - {box.c[0]}) * ic::DOUBLE / {last} AS c, ib * {steps} + ic AS s
  FROM {p}_steps),
{p}_sums0 AS (
  SELECT {sums} FROM (SELECT *, {_value('b', 'c', 'x')} AS f FROM {p}_pts, {p}_models, {p}_grid0) GROUP BY {KEYS}, model, s, b, c),
{p}_cells AS ({_asymptotes(box, p + '_sums0')}),
{p}_beside AS (
  SELECT {KEYS}, model, s + i * {steps} + j AS s, min(rss) AS near
  FROM {p}_cells, (VALUES (-1), (0), (1)) v(i), (VALUES (-1), (0), (1)) w(j)
  WHERE (i <> 0 OR j <> 0) AND s // {steps} + i BETWEEN 0 AND {last} AND s % {steps} + j BETWEEN 0 AND {last} GROUP BY ALL),
{p}_ranked AS (
  SELECT {KEYS}, model, s AS cell, b, c, a, d, rss, coalesce(rss <= near, true) AS low,
         row_number() OVER (PARTITION BY {KEYS}, model {order}) AS place
  FROM {p}_cells LEFT JOIN {p}_beside USING ({KEYS}, model, s)),
{p}_best0 AS (
  SELECT {KEYS}, model, row_number() OVER (PARTITION BY {KEYS}, model ORDER BY place > 1, rss, cell) AS s, b, c, a, d, rss
  FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, model, low ORDER BY rss, cell) AS valley FROM {p}_ranked)
  WHERE place = 1 OR (low AND valley <= {top}) QUALIFY s <= {top})"""
    for r in range(1, rounds):
        out += f""",
{p}_zoom{r} AS (
  SELECT {KEYS}, model, s, b, c, greatest(b - {half_b!r}, {box.b[0]}) AS b0, least(b + {half_b!r}, {box.b[1]}) AS b1,
         greatest(c - {half_c!r}, {box.c[0]}) AS c0, least(c + {half_c!r}, {box.c[1]}) AS c1 FROM {p}_best{r - 1}),
{p}_grid{r} AS (
  SELECT {KEYS}, model, s, b0 + (b1 - b0) * ib::DOUBLE / {last} AS b, c0 + (c1 - c0) * ic::DOUBLE / {last} AS c
  FROM {p}_zoom{r}, {p}_steps UNION SELECT {KEYS}, model, s, b, c FROM {p}_zoom{r}),
{p}_sums{r} AS (
  SELECT {sums} FROM (
    SELECT {KEYS}, model, s, b, c, n, sy, syy, {_value('b', 'c', 'x')} AS f FROM {p}_pts JOIN {p}_grid{r} USING ({KEYS}))
  GROUP BY {KEYS}, model, s, b, c),
{p}_best{r} AS MATERIALIZED (SELECT * FROM ({_asymptotes(box, f'{p}_sums{r}')})
  QUALIFY row_number() OVER (PARTITION BY {KEYS}, model, s {order}) = 1)"""
        half_b, half_c = half_b * 3 / last, half_c * 3 / last
    end = rounds - 1
    return out + f""",
{p}_chosen AS (
  SELECT n.*, o.rss AS before FROM {p}_best{end} n JOIN {p}_best{end - 1} o USING ({KEYS}, model, s)
  QUALIFY row_number() OVER (PARTITION BY {KEYS}, model ORDER BY round(n.rss, {tie_digits}), n.b, n.c) = 1),
{p}_raw AS (
  SELECT {KEYS}, model, a, b, c, d, count(*) AS n, sum(({y} - {curve_value(x)}) ** 2) AS raw, sum({y} * {y}) AS syy
  FROM {source} JOIN {p}_chosen USING ({KEYS}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
{p}_rss AS (SELECT *, CASE WHEN raw > {perfect} * syy THEN raw ELSE 0 END AS rss FROM {p}_raw),
{name} AS (
  SELECT r.class_age, r.site, r.campaign, r.model, r.a, r.b, r.c, {'NULL::DOUBLE' if box.d is None else 'r.d'} AS d, r.n,
         {box.parameters} AS k, r.rss,
         r.n * ((ln(2 * pi()) + 1) - ln(r.n) + ln(nullif(r.rss, 0))) + {2 * (box.parameters + 1)} AS aic,
         coalesce(r.rss = 0 OR (b1.before - b1.rss) <= 1e-3 * b1.rss, false) AS converged
  FROM {p}_rss r JOIN {p}_chosen b1 USING ({KEYS}, model))"""


def lattice_sql(source: str, x: str, y: str, box: Box, slopes: int, midpoints: int, models=("Logistic", "Gompertz"),
                tie_digits: int = TIE_DIGITS, name: str = "lattice") -> str:
    """The best of all points of an evenly spread lattice, every one of them computed."""
    p = name
    return f"""{p}_pts AS (
  SELECT {KEYS}, {x}::DOUBLE AS x, count(*)::DOUBLE AS n, sum({y}) AS sy, sum({y} * {y}) AS syy
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
{p}_models(model) AS (VALUES {', '.join(f"('{m}')" for m in models)}),
{p}_grid AS (
  SELECT i AS s, {box.b[0]}::DOUBLE + ({box.b[1]}::DOUBLE - {box.b[0]}) * (i // {midpoints})::DOUBLE / {slopes - 1} AS b,
         {box.c[0]}::DOUBLE + ({box.c[1]}::DOUBLE - {box.c[0]}) * (i % {midpoints})::DOUBLE / {midpoints - 1} AS c
  FROM range({slopes * midpoints}) r(i)),
{p}_sums AS (
  SELECT {KEYS}, model, s, b, c, sum(n) AS n, sum(n * f) AS sf, sum(n * f * f) AS sff, sum(sy) AS sy, sum(f * sy) AS sfy,
         sum(syy) AS syy
  FROM (SELECT *, {_value('b', 'c', 'x')} AS f FROM {p}_pts, {p}_models, {p}_grid) GROUP BY {KEYS}, model, s, b, c),
{name} AS (
  SELECT {KEYS}, model, a, b, c, {'NULL::DOUBLE' if box.d is None else 'd'} AS d, rss FROM ({_asymptotes(box, p + '_sums')})
  QUALIFY row_number() OVER (PARTITION BY {KEYS}, model ORDER BY round(rss, {tie_digits}), b, c) = 1)"""
