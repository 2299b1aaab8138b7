"""Column functions over validity windows, months and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.registry import OPEN_END


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known_on(as_of, start="realtime_start", end="realtime_end") -> Column:
    """Known on a date: both ends of the window count."""
    return (_col(start) <= _col(as_of)) & (_col(end) >= _col(as_of))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (_col(a_start) <= _col(b_end)) & (_col(b_start) <= _col(a_end))


def is_current(end="realtime_end") -> Column:
    return _col(end) == F.lit(OPEN_END).cast("date")


def month_of(date) -> Column:
    return F.trunc(_col(date), "MM")


def shift_month(date, months) -> Column:
    return F.add_months(month_of(date), months)


def month_number(date) -> Column:
    return 12 * F.year(_col(date)) + F.month(_col(date))


def months_between(later, earlier) -> Column:
    """Whole calendar months, not fractions."""
    return month_number(later) - month_number(earlier)


def month_name(date) -> Column:
    return F.date_format(_col(date), "MMMM yyyy")


def excluded(month, regime: tuple[str, str]) -> Column:
    """In the excluded regime, both ends included."""
    return month_of(month).between(F.lit(regime[0]).cast("date"), F.lit(regime[1]).cast("date"))


def value_of(text) -> Column:
    """A payload's value: blank or "." is null, what else is no number raises."""
    trimmed = F.trim(_col(text))
    return F.when(~trimmed.isin("", "."), trimmed).cast("double")


def even(x, digits: int = 0) -> Column:
    """Rounded half to even; what an engine's last bits add to a sum is rounded off first, so that ties stay ties."""
    return F.bround(F.round(_col(x), 8), digits)


def jobs_phrase(thousands, signed: bool = True) -> Column:
    """An amount of jobs in words, to the even thousand; unsigned: the size alone."""
    k = even(thousands)
    count = F.concat(F.format_number(F.abs(k) * 1000, 0), F.lit(" jobs"))
    said = F.when(k == 0, F.lit("no net change")).when(k > 0, F.concat(F.lit("a gain of "), count)).otherwise(F.concat(F.lit("a loss of "), count))
    return F.when(k.isNull(), F.lit("an unknown number of jobs")).otherwise(said if signed else count)


def article(number) -> Column:
    """The article before a number that is read aloud: eight, eleven, eighteen and what begins with eight take "An"."""
    n = _col(number).cast("string")
    return F.when(n.startswith("8") | n.isin("11", "18"), F.lit("An")).otherwise(F.lit("A"))


def quantity(value, unit) -> Column:
    """A value with its unit: thousands of persons as persons, others to one decimal."""
    v, u = _col(value), _col(unit)
    return F.when(u == "thousands of persons", F.format_number(even(v * 1000), 0)).when(F.coalesce(u, F.lit("")) == "", F.format_number(even(v, 1), 1)).otherwise(F.concat(F.format_number(even(v, 1), 1), F.lit(" "), u))


def direction(contribution) -> Column:
    c = _col(contribution)
    return F.when(c > 0.5, F.lit("raises")).when(c < -0.5, F.lit("lowers")).otherwise(F.lit("neutral"))


def log_gamma(z) -> Column:
    """ln of the gamma function for z > 0: Stirling's series eight steps up, less the logarithms of the steps."""
    z = _col(z).cast("double")
    up = z + 8.0
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    steps = sum((F.log(z + float(k)) for k in range(1, 8)), F.log(z))
    return (up - 0.5) * F.log(up) - up + 0.9189385332046728 + series - steps  # half the logarithm of 2 pi


def incomplete_beta(x, a, b, steps: int = 200) -> Column:
    """The regularised incomplete beta function for x between 0 and 1, by its continued fraction, summed from its far end.

    The fraction converges where x < (a + 1) / (a + b + 2); elsewhere the complement is taken.
    """
    x, a, b = (_col(c).cast("double") for c in (x, a, b))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    near = x < (a + 1) / (a + b + 2)

    def tail(x: Column, a: Column, b: Column) -> Column:
        def term(m: Column) -> Column:
            """The m-th partial numerator, m from 1."""
            k = F.floor(m / 2).cast("double")
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            return F.when(m % 2 == 0, even).otherwise(odd)

        far = F.aggregate(F.sequence(F.lit(steps), F.lit(1)), F.lit(1.0), lambda acc, m: 1.0 + term(m) / acc)
        return front * F.pow(x, a) * F.pow(1 - x, b) / (a * far)

    inner = F.when(near, tail(x, a, b)).otherwise(1.0 - tail(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def two_sided_p_any(statistic, df) -> Column:
    """Two-sided p of Student's t with any positive degrees of freedom."""
    t, n = _col(statistic).cast("double"), _col(df).cast("double")
    return incomplete_beta(n / (n + t * t), n / 2, F.lit(0.5))


def two_sided_p(statistic, df) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite trigonometric series.

    With theta = atan(t / sqrt(df)): for even df the central probability is sin(theta) times a sum of even powers of
    cos(theta), for odd df it is 2 / pi times theta plus sin(theta) times a sum of odd powers.
    """
    t, n = F.abs(_col(statistic)), _col(df).cast("int")
    theta = F.atan(t / F.sqrt(n.cast("double")))
    sin, cos = F.sin(theta), F.cos(theta)
    one = F.lit(1.0)
    terms = lambda first, upto: F.when(upto >= first, F.sequence(F.lit(first), upto, F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda acc, k: F.struct((acc["sum"] + acc["term"] * (k - 1) / k * cos * cos).alias("sum"), (acc["term"] * (k - 1) / k * cos * cos).alias("term"))
    even = F.aggregate(terms(2, n - 2), F.struct(one.alias("sum"), one.alias("term")), step)["sum"] * sin
    odd_sum = F.aggregate(terms(3, n - 2), F.struct(cos.alias("sum"), cos.alias("term")), step)["sum"]
    odd = (theta + F.when(n > 1, sin * odd_sum).otherwise(F.lit(0.0))) * (2 / 3.141592653589793)
    return F.greatest(F.lit(0.0), 1.0 - F.when(n % 2 == 0, even).otherwise(odd))
