"""Distribution functions as SQL text, for checking p-values and order statistics.

They are computed by other means than in the library: Simpson's rule for the normal and
Student integrals, closed sums for chi-square and F, and the rational normal quantile.
"""

from __future__ import annotations

STEPS = 400


def _simpson(f: str) -> str:
    """Simpson sum over [0, 1] of an expression in ``u``."""
    return (
        f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (case when i = 0 or i = {STEPS} then 1 when i % 2 = 1 then 4 else 2 end) * "
        + f.replace("{u}", f"(i / {STEPS}.0::double)")
        + f")) / {3 * STEPS}.0)"
    )


def phi(z: str) -> str:
    """Standard normal distribution function for |z| up to about 6."""
    return f"(0.5 + ({z}) / sqrt(2 * pi()) * " + _simpson(f"exp(-0.5 * power(({z}) * {{u}}, 2))") + ")"


def student_two_sided(t: str, dof: str) -> str:
    """Two-sided Student p for moderate t."""
    density = f"exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi())"
    body = _simpson(f"power(1 + power(({t}) * {{u}}, 2) / ({dof}), -(({dof}) + 1) / 2.0)")
    return f"(1 - 2 * abs({t}) * {density} * {body})"


def chi2_upper_even(x: str, dof: str) -> str:
    """Upper chi-square tail for an even number of degrees of freedom."""
    return f"(list_sum(list_transform(range(0, cast(({dof}) / 2 as bigint)), lambda k: exp(-({x}) / 2.0 + k * ln(({x}) / 2.0) - lgamma(k + 1)))))"


def f_upper_four(f: str, d2: str) -> str:
    """Upper F tail with four numerator degrees of freedom."""
    x = f"(({d2}) / (({d2}) + 4.0 * ({f})))"
    return f"(power({x}, ({d2}) / 2.0) * (1 + ({d2}) / 2.0 * (1 - {x})))"


def kolmogorov_upper(d: str, n: str) -> str:
    """Limit law with the size correction, for large n."""
    x0 = f"(sqrt({n}) * ({d}))"
    x = f"({x0} + 1 / (6 * sqrt({n})) + ({x0} - 1) / (4.0 * ({n})))"
    return f"least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * {x} * {x})))))"


# Wichura's rational approximation of the normal quantile, highest power first.
CENTRAL = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
     1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
    [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
     687.1870074920579083, 42.313330701600911252, 1.0],
)
OUTER = (
    [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
     5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455,
     1.6763848301838038494, 2.05319162663775882187, 1.0],
)


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def ppf(p: str) -> str:
    """Standard normal quantile for p between 1e-11 and 1 - 1e-11."""
    r = f"(0.180625 - power(({p}) - 0.5, 2))"
    s = f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)"
    middle = f"(({p}) - 0.5) * {_horner(CENTRAL[0], r)} / {_horner(CENTRAL[1], r)}"
    tail = f"(case when ({p}) < 0.5 then -1 else 1 end) * {_horner(OUTER[0], s)} / {_horner(OUTER[1], s)}"
    return f"(case when abs(({p}) - 0.5) <= 0.425 then {middle} else {tail} end)"
