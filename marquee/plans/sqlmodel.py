"""SQL restatements of the model operators for the DuckDB oracle: normal equations of three
features by Cramer's rule, tail probabilities by their series, the keyed permutation."""

from __future__ import annotations

PRIME = 2**31 - 1


def gram3(source: str, y: str = "y", x: tuple[str, str, str] = ("l_quantity", "l_discount", "l_tax"), by: str = "") -> str:
    """One row (a group): n, means m1-3 and my, centred sums s11..s33 and c1-3, syy."""
    s = [f"covar_pop({x[i]}, {x[j]}) * count(*) as s{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)]
    c = [f"covar_pop({x[i]}, {y}) * count(*) as c{i + 1}" for i in range(3)]
    m = [f"avg({x[i]}) as m{i + 1}" for i in range(3)]
    return (f"select {by + ', ' if by else ''}count(*) as n, {', '.join(m)}, avg({y}) as my, var_pop({y}) * count(*) as syy, "
            f"{', '.join(s + c)} from {source}" + (f" group by {by}" if by else ""))


def solve3(g: str, alpha: float = 0.0, keep: str = "n, m1, m2, m3, my, syy, c1, c2, c3") -> str:
    """Weights w1-3 and intercept w0 of the normal equations (S + alpha I) w = c."""
    a = {(i, j): f"s{i}{j}" if i != j else f"(s{i}{i} + {alpha})" for i in (1, 2, 3) for j in range(i, 4)}
    a |= {(j, i): v for (i, j), v in a.items()}

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) "
                f"+ {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    rows = [[a[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)]
    w = [f"{det([[f'c{i + 1}' if j == k else rows[i][j] for j in range(3)] for i in range(3)])} / {det(rows)} as w{k + 1}" for k in range(3)]
    return f"select *, my - w1 * m1 - w2 * m2 - w3 * m3 as w0 from (select {keep}, {', '.join(w)} from {g}) solved"


def lasso3(g: str, alpha: float, sweeps: int = 80) -> str:
    """CTE body: cyclic coordinate descent on the centred sums; the last sweep's weights."""
    def step(k):
        others = " - ".join([f"c{k}", *[f"s{min(k, j)}{max(k, j)} * {'v' if j < k else 'w'}{j}" for j in (1, 2, 3) if j != k]])
        return f"sign({others}) * greatest(abs({others}) - n * {alpha}, 0) / s{k}{k}"
    return (f"(with recursive d as (select 0 as it, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3 union all "
            f"select it + 1, v1, v2, v3 from (select *, {step(3)} as v3 from (select *, {step(2)} as v2 from (select *, {step(1)} as v1 "
            f"from d, {g} where it < {sweeps}) a) b) e) "
            f"select w1, w2, w3, my - w1 * m1 - w2 * m2 - w3 * m3 as w0 from d, {g} where it = {sweeps})")


def chi2_sf(x: str, k: int) -> str:
    """1 - P(k/2, x/2) by the series of the lower incomplete gamma function."""
    a, h = k / 2, f"(({x}) / 2)"
    return (f"(1 - list_sum(list_transform(range(0, 600), lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1)))))")


def f_sf(f: str, d1: int, d2: str) -> str:
    """1 - I_y(d1/2, d2/2) with y = d1 F / (d2 + d1 F), by the series of the incomplete beta function."""
    a, b, y = d1 / 2, f"(({d2}) / 2.0)", f"({d1} * ({f}) / (({d2}) + {d1} * ({f})))"
    head = f"{a} * ln({y}) + {b} * ln(1 - {y}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
    term = f"lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({y})"
    return f"(1 - list_sum(list_transform(range(0, 600), lambda i: exp({head} + {term}))))"


def permuted(i: str, n: str, low: str, high: str, keys: list[str], steps: int = 16) -> str:
    """The keyed bijection of 0..n-1: four Feistel rounds on (low, high) digits, walked back into the range."""
    def mixed(v, k):
        return f"((({v}) + {k}) % {PRIME}) * ((({v}) + {k}) % {PRIME}) % {PRIME}"

    def once(x):
        a, b = f"(({x}) % {low})", f"(({x}) // {low})"
        for j, k in enumerate(keys):
            if j % 2 == 0:
                a = f"(({a} + {mixed(b, k)}) % {low})"
            else:
                b = f"(({b} + {mixed(a, k)}) % {high})"
        return f"({b} * {low} + {a})"
    zeros = ", ".join(["0::bigint"] * steps)
    return f"list_reduce([{once(i)}, {zeros}], lambda x, z: case when x < {n} then x else {once('x')} end)"
