"""DuckDB SQL fragments used by oracle strings (dialect differences)."""


def title(x: str) -> str:
    """``str.strip().str.title()``: a capital after every non-letter."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), "
            f"'\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')")


def nbh_clean(x: str) -> str:
    t = title(x)
    return (f"CASE {t} WHEN 'Delridge Neighborhoods' THEN 'Delridge' "
            f"WHEN 'Magnolia / Queen Anne' THEN 'Magnolia / Queen Anne' ELSE {t} END")


def log1p(x: str) -> str:
    return f"ln(1 + ({x}))"


def expm1(x: str) -> str:
    return f"(exp({x}) - 1)"


def _horner(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


def norm_ppf(p: str) -> str:
    """The same rational approximation as functions.normal.norm_ppf, in SQL."""
    from ..functions.normal import _A, _B, _C, _D, _P_LOW
    qlo = f"sqrt(-2.0 * ln({p}))"
    qhi = f"sqrt(-2.0 * ln(1.0 - {p}))"
    lo = f"({_horner(_C, qlo)} / ({_horner(_D, qlo)} * {qlo} + 1.0))"
    hi = f"(-{_horner(_C, qhi)} / ({_horner(_D, qhi)} * {qhi} + 1.0))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_horner(_A, r)} * {q} / ({_horner(_B, r)} * {r} + 1.0))"
    return (f"(CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {_P_LOW!r} THEN {lo} "
            f"WHEN {p} > {1 - _P_LOW!r} THEN {hi} ELSE {mid} END)")


def norm_cdf(z: str) -> str:
    """The same Zelen-Severo expression as functions.normal.norm_cdf, in SQL."""
    from ..functions.normal import _ZS_B, _ZS_P
    x = f"abs({z})"
    t = f"(1.0 / (1.0 + {_ZS_P!r} * {x}))"
    poly = (f"({t} * ({_ZS_B[0]!r} + {t} * ({_ZS_B[1]!r} + {t} * ({_ZS_B[2]!r} + {t} * ({_ZS_B[3]!r} + {t} * {_ZS_B[4]!r})))))")
    tail = f"(exp(-({x} * {x}) / 2.0) / 2.5066282746310002 * {poly})"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def chi2_sf(x: str, df: str, terms: int = 4000) -> str:
    """Upper tail of chi-square: 1 minus the series of the lower incomplete gamma."""
    a, h = f"({df} / 2.0::DOUBLE)", f"({x} / 2.0::DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - "
            f"list_sum(list_transform(range({terms}), lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1))))) END)")


def t_sf2(t: str, df: str, terms: int = 2000) -> str:
    """Two-sided tail of Student's t: 1 minus the incomplete beta of
    t^2 / (df + t^2) at (1/2, df/2), by its series of positive terms. Far out
    (beyond 20, where the tail is below 1e-50) the series is long and not needed."""
    y, b = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))", f"(({df}) / 2.0::DOUBLE)"
    return (f"(CASE WHEN ({t}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 "
            f"WHEN ({t}) * ({t}) > 400 AND ({df}) > 100 THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range({terms}), lambda i: "
            f"exp((0.5 + i) * ln({y}) + {b} * ln(1 - {y}) + lgamma(0.5 + {b} + i) - lgamma({b}) - lgamma(1.5 + i))))) END)")
