"""Tolerant typing: every helper maps a column to a column and never raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.naming import quoted

# The characters text stripping removes, and the accepted number grammar.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
NUMBER_PATTERN = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
MONTH_INITIALS = "janfebmaraprmayjunjulaugsepoctnovdec"

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Stripped text, blank becomes null."""
    return F.nullif(strip(text), F.lit(""))


def clean_dimension(frame: DataFrame, name: str) -> Column:
    """Group label of any column: stripped text, blank becomes null, booleans as True / False."""
    kind = frame.schema[name].dataType
    value = quoted(name).cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(quoted(name)), value)
    return clean_text(value)


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def parse_number(text: Column) -> Column:
    """Number in a text; the grammar guard keeps Java-only forms such as ``1d`` out."""
    stripped = strip(text)
    return F.when(stripped.rlike(NUMBER_PATTERN), stripped.try_cast("double"))


def as_number(frame: DataFrame, name: str) -> Column:
    """Numeric view of a column. Decimals stay decimals, so their sums are exact."""
    kind, value = frame.schema[name].dataType, quoted(name)
    if isinstance(kind, T.DecimalType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return not_nan(value.cast("double"))
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.StringType):
        return parse_number(value)
    return F.lit(None).cast("double")


def parse_timestamp(text: Column) -> Column:
    """Wall-clock time in a text: year first, then month/day/year, day/month/year, month names.

    Each form is rewritten to year-month-day and cast once; nothing depends on the session zone.
    A bare time of day is not a date.
    """
    return parse_stripped_timestamp(strip(text))


# The parser of one stripped text ``t``, in steps that each compute a value once. ``shape`` names digits and letters by
# kind: Y four digits, D eight, d one or two, m a word of three to nine letters, - for the separators / and ., all else
# as it is, so that ``5 Jan 2025 10:30`` is ``d m Y d:d``. It tells the one form a text can have by comparisons of
# prefixes, and only the rewriting of that form runs.
_MAY_BE_DATE = (
    r"^(?i)(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
    r"(?:\d{1,4}[-/. ](?:\d|[a-z]{3,9}[.,]?[ -]\d)|\d{4}$|\d{8}(?:$|T)|[a-z]{3,9}[.]? +\d)"
)
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2})?$"
_WEEKDAY = r"^(?i)(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +(?=[a-z0-9])"
_HALF_DAY = r"^(?i)(.*[ T])(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([ap])\.?m\.?$"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?(|[ T].*)$"
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(|[ T].*)$"
_SHORT_YEAR = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(|[ T].*)$"
_TIME_BETWEEN = r"^(?i)([a-z]{3,9}) +(\d{1,2}) (\d{1,2}:\d{2}(?::\d{2})?) (\d{4})$"
_DAY_MONTH = r"^(?i)(\d{1,2})[ -]([a-z]{3,9})[.,]?[ -](\d{4})(|[ T].*)$"
_MONTH_DAY = r"^(?i)([a-z]{3,9})[.]? (\d{1,2}),? (\d{4})(|[ T].*)$"


def _starts(*heads: str) -> str:
    """The shape is one of these, or goes on with a blank or a T."""
    return "(" + " or ".join(f"x.shape = '{h}' or startswith(x.shape, '{h} ') or startswith(x.shape, '{h}a')" for h in heads) + ")"


def _month(pattern: str, group: int) -> str:
    found = f"instr('{MONTH_INITIALS}', lower(substring(regexp_extract(x.t, r'{pattern}', {group}), 1, 3)))"
    return f"case when {found} % 3 = 1 then cast(cast(({found} + 2) / 3 as int) as string) end"


def _named(pattern: str, year: int, month: int, day: int) -> str:
    part = [f"regexp_extract(x.t, r'{pattern}', {i})" for i in (year, day, 4)]
    return f"concat({part[0]}, '-', {_month(pattern, month)}, '-', {part[1]}, {part[2]})"


def _moment(text: str) -> str:
    return f"try_cast({text} as timestamp_ntz)"


def _rewritten(pattern: str, to: str) -> str:
    return f"regexp_replace(x.t, r'{pattern}', '{to}')"


_CENTURY = f"case when try_cast(regexp_extract(x.t, r'{_SHORT_YEAR}', 3) as int) < 69 then '20' else '19' end"
_FORMS = rf"""x -> case
  when {_starts("Y-d-d")} then {_moment(_rewritten(_YEAR_FIRST, "$1-$2-$3$4"))}
  when {_starts("d-d-Y")} then coalesce({_moment(_rewritten(_YEAR_LAST, "$3-$1-$2$4"))}, {_moment(_rewritten(_YEAR_LAST, "$3-$2-$1$4"))})
  when {_starts("d-d-d")} and x.t rlike r'{_SHORT_YEAR}' then coalesce(
    {_moment(f"concat({_CENTURY}, {_rewritten(_SHORT_YEAR, '$3-$1-$2$4')})")},
    {_moment(f"concat({_CENTURY}, {_rewritten(_SHORT_YEAR, '$3-$2-$1$4')})")})
  when x.shape = 'Y' then {_moment("x.t")}
  when x.shape = 'D' then {_moment(_rewritten(r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))}
  when startswith(x.shape, 'Da') and x.t rlike r'^\d{{8}}T\d{{6}}$' then
    {_moment(_rewritten(r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"))}
  when {_starts("Y-d")} then {_moment("regexp_replace(x.t, '[/.]', '-')")}
  when startswith(x.shape, 'm ') and endswith(x.shape, ' Y') and x.t rlike r'{_TIME_BETWEEN}' then
    {_moment(f"concat_ws('-', regexp_extract(x.t, r'{_TIME_BETWEEN}', 4), {_month(_TIME_BETWEEN, 1)}, {_rewritten(_TIME_BETWEEN, '$2 $3')})")}
  when (startswith(x.shape, 'd m') or startswith(x.shape, 'd-m')) and x.t rlike r'{_DAY_MONTH}' then {_moment(_named(_DAY_MONTH, 3, 2, 1))}
  when startswith(x.shape, 'm') and x.t rlike r'{_MONTH_DAY}' then {_moment(_named(_MONTH_DAY, 3, 1, 2))}
end"""
_LETTERS = "bcdefghijklmnopqrstuvwxyz"
_SHAPE = f"translate(lower(t), '0123456789/.{_LETTERS}', '{'9' * 10}--{'a' * len(_LETTERS)}')"
for _digits, _kind in (("9" * 8, "D"), ("9" * 4, "Y"), ("99", "d"), ("9", "d")):
    _SHAPE = f"replace({_SHAPE}, '{_digits}', '{_kind}')"
_HOUR = f"try_cast(regexp_extract(t, r'{_HALF_DAY}', 2) as int)"
_FULL_DAY = f"""t -> case when lower(right(t, 1)) in ('m', '.') and t rlike r'{_HALF_DAY}' and {_HOUR} between 1 and 12 then concat(
    regexp_extract(t, r'{_HALF_DAY}', 1),
    lpad(cast({_HOUR} % 12 + if(lower(regexp_extract(t, r'{_HALF_DAY}', 4)) = 'p', 12, 0) as string), 2, '0'),
    regexp_extract(t, r'{_HALF_DAY}', 3))
  else t end"""
_NO_WEEKDAY = f"t -> if(lower(left(t, 1)) in ('m', 't', 'w', 'f', 's'), regexp_replace(t, r'{_WEEKDAY}', ''), t)"
_SHAPED = f"t -> named_struct('t', t, 'shape', regexp_replace({_SHAPE}, 'a{{3,9}}', 'm'))"


def parse_stripped_timestamp(text: Column) -> Column:
    """``parse_timestamp`` for text that is stripped already.

    Texts that no date can start with are told apart first, and plain ISO texts are cast at once. Of the others
    the shape names the form. A leading weekday is dropped, AM and PM become 24 hours, and years of two digits
    are those from 1969 to 2068.
    """
    steps = F.array(text)
    for step in (_NO_WEEKDAY, _FULL_DAY, _SHAPED, _FORMS):
        steps = F.call_function("transform", steps, F.expr(step))
    plain = F.when(text.rlike(_PLAIN), text.try_cast("timestamp_ntz"))
    return plain.when((F.length(text) >= 4) & text.rlike(_MAY_BE_DATE), F.get(steps, F.lit(0)))


def epoch_nanos(value: Column) -> Column:
    """A number read as nanoseconds since 1970 (what a numeric date column means)."""
    seconds = (value.cast("double") / 1e9).cast("decimal(18,6)")
    moment = F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.when(F.abs(value.cast("double")) < 9.2e18, moment)


def as_timestamp(frame: DataFrame, name: str) -> Column:
    kind, value = frame.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return parse_timestamp(value)
    if isinstance(kind, T.NumericType):
        return epoch_nanos(value)
    return F.lit(None).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days (not midnights crossed); 0 when a bound is missing."""
    return F.coalesce(F.extract(F.lit("DAY"), end - start).cast("long"), F.lit(0).cast("long"))


def period_start(day: Column, grain: Column) -> Column:
    """First day of the period a date falls in, for a grain column D, W (Monday) or M."""
    return (
        F.when(grain == "M", F.trunc(day, "month"))
        .when(grain == "W", F.trunc(day, "week"))
        .otherwise(day)
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# One rounding step per lambda, so each intermediate is computed once. ``u`` is the power of two
# that makes the number a whole mantissa; ``r`` is the exact remainder that decides the direction.
_ROUND = """
v -> case when abs(v) < 0.002D then 0D else coalesce(signum(v) * get(
  transform(transform(transform(transform(
    array(if(abs(v) between 0.002D and 70368744177664D, abs(v), null)),
    s -> named_struct('s', s, 'u', power(2D, 53 - floor(log2(s))))),
    a -> named_struct('n', cast(a.s * a.u as bigint) * {power}L, 'u', cast(a.u as bigint))),
    b -> named_struct('r', b.n % b.u, 'u', b.u,
                      'w', cast(b.n - b.n % b.u as double) / cast(b.u as double))),
    c -> (c.w + if(c.r > c.u - c.r or (c.r = c.u - c.r and c.w % 2 = 1), 1D, 0D)) / {power}D
  ), 0), v) end
"""


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value to 0, 1 or 2 decimals, halves to even.

    Spark's ``round`` works on the shortest decimal text (2.675 becomes 2.68) although the binary
    number is below 2.675. Here the mantissa is a whole number, so the remainder is exact in 64-bit
    arithmetic. Below 0.002 the answer is 0; above 2^46 a double has too few binary places left
    for decimals to matter. For results and report texts, not for raw rows.
    """
    if digits not in (0, 1, 2):
        raise ValueError("digits must be 0, 1 or 2")
    body = F.expr(_ROUND.format(power=10**digits))
    return F.get(F.call_function("transform", F.array(value.cast("double")), body), F.lit(0))


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percent, 0 when the whole is not positive."""
    return F.when(
        whole > 0, round_exact(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)
    ).otherwise(0.0)


def fixed_text(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits))


def percent_text(rate: Column) -> Column:
    """A rate as whole percent, such as 85%."""
    return F.concat(fixed_text(rate * 100, 0), F.lit("%"))
