"""Column expressions: predicates, labels, ratios, bit tests, small arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that stand for a missing value.
PLACEHOLDERS = ("", "unknown", "na", "n/a", "nan", "none", "null", "unassigned")
# Alignment flag bits.
PAIRED, UNMAPPED, REVERSE, FIRST_MATE, SECOND_MATE, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x800


def is_placeholder(c: Column) -> Column:
    """True for null and for strings that stand for a missing value."""
    return c.isNull() | F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def real(c: Column) -> Column:
    """``c``, or null where it is a placeholder."""
    return F.when(~is_placeholder(c), c)


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def has_bits(flag: Column, bits: int) -> Column:
    """All of ``bits`` set."""
    return flag.bitwiseAND(F.lit(bits)) == bits


def lacks_bits(flag: Column, bits: int) -> Column:
    """None of ``bits`` set."""
    return flag.bitwiseAND(F.lit(bits)) == 0


def all_of(predicates: Sequence[Column | None]) -> Column:
    """The conjunction of the predicates given; None stands for no condition."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def first_match(value: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first ``(label, regex)`` that matches."""
    chain = None
    for label, pattern in rules:
        hit = value.rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def argmax_label(scores: dict[str, Column], floor: float | None = None, default: str = "none") -> Column:
    """The name of the largest score, the first of equals; ``default`` below ``floor``."""
    values, names = F.array(*scores.values()), F.array(*map(F.lit, scores))
    top = F.array_max(values)
    label = F.element_at(names, F.array_position(values, top).cast("int"))
    return label if floor is None else F.when(top >= floor, label).otherwise(default)


def ranked_scores(scores: dict[str, Column]) -> Column:
    """Array of ``(score, name)``, best first, equal scores in the order given."""
    rows = F.array(*(F.struct((-v).alias("neg"), F.lit(k).alias("turn"), v.alias("score"), F.lit(n).alias("name")) for k, (n, v) in enumerate(scores.items())))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["score"].alias("score"), r["name"].alias("name")))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """``scale * a / b``; null where b is 0."""
    return F.try_divide(a * F.lit(float(scale)), b)


def log2_enrichment(observed: Column, expected: Column, clip: float = 2.0) -> Column:
    """log2 of (observed + 1) / (expected + 1), clipped."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), F.log2((observed + 1.0) / (expected + 1.0))))


def log2_share(row_share: Column, share: Column) -> Column:
    """log2 of a share within the row over the share overall; null where either is 0."""
    return F.when((row_share > 0) & (share > 0), F.log2(row_share / share))


def fold_capped(row_share: Column, share: Column, cap: float = 2.0) -> Column:
    return F.least(F.lit(cap), F.try_divide(row_share, share))


def minus_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def clr(values: Column) -> Column:
    """Centred log ratio of an array: log1p less the mean log1p."""
    logs = F.transform(values, lambda x: F.log1p(x))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(F.array(mean), lambda m: F.transform(logs, lambda x: x - m))[0]


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1, to about 1e-11."""
    y = x.cast("double") + 7.0
    product = reduce(lambda a, b: a * b, (x.cast("double") + float(k) for k in range(7)))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


#: Standard deviations over which the terms of a tail are summed; what lies beyond is less
#: than a double can tell from nothing.
FAR = 40


def _tail(k: Column, low: Column, high: Column, mode: Column, spread: Column, log_of, up, down) -> Column:
    """P(X >= k) from the terms on the far side of ``mode``, each the one before it times
    ``up(i)`` (from i to i + 1) or ``down(i)`` (from i to i - 1): only the first takes
    logarithms, terms fall, and their number grows with the spread and not with the range."""
    most = F.ceil(spread * FAR).cast("long") + 100

    def total(start: Column, room: Column, way: int, ratio) -> Column:
        steps = F.least(room, most)
        nothing = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def add(state: Column, j: Column) -> Column:
            term = state["t"] * ratio((start + way * (j - 1)).cast("double"))
            return F.when(j > steps, state).otherwise(F.struct(term.alias("t"), (state["s"] + term).alias("s")))

        sums = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), nothing, add, lambda x: x["s"])
        return F.exp(log_of(start)) * sums

    above, below = total(k, high - k, 1, up), total(k - 1, k - 1 - low, -1, down)
    inside = F.when(k > mode, F.least(F.lit(1.0), above)).otherwise(F.greatest(F.lit(0.0), 1.0 - below))
    return F.when(k > high, F.lit(0.0)).when(k <= low, F.lit(1.0)).otherwise(inside)


def hypergeom_tail(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) when ``drawn`` of ``population`` hold ``marked`` successes at most."""
    k, m, n, q = (c.cast("long") for c in (k, population, marked, drawn))
    low, high = F.greatest(F.lit(0).cast("long"), q + n - m), F.least(n, q)
    share = F.coalesce(F.try_divide(n, m), F.lit(0.0))
    # Rounding may put the mode one off; terms then rise once before they fall.
    mode = F.floor(F.coalesce(F.try_divide((q + 1).cast("double") * (n + 1), m + 2), F.lit(0.0)))
    return _tail(
        k, low, high, mode, F.sqrt(q * share * (1 - share)),
        lambda i: log_choose(n, i) + log_choose(m - n, q - i) - log_choose(m, q),
        lambda i: (n - i) * (q - i) / ((i + 1) * (m - n - q + i + 1)), lambda i: i * (m - n - q + i) / ((n - i + 1) * (q - i + 1)),
    )


def binom_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of n trials with chance p."""
    k, n = k.cast("long"), n.cast("long")
    odds = F.try_divide(p, 1 - p)
    inside = _tail(
        k, F.lit(0).cast("long"), n, F.floor((n + 1) * p), F.sqrt(n * p * (1 - p)),
        lambda i: log_choose(n, i) + i * F.log(p) + (n - i) * F.log1p(-p),
        lambda i: (n - i) / (i + 1) * odds, lambda i: i / (n - i + 1) / odds,
    )
    return F.when(k <= 0, F.lit(1.0)).when((k > n) | (p <= 0), F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(inside)
