"""What to compute: which columns are dimensions, keys, amounts and time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

# Labels that results must carry.
ALL_LABEL = "整体"
UNKNOWN_LABEL = "未知"
UNDEFINED_FUNCTION_LABEL = "未定义功能"

# Texts that stand for a missing key in text sources.
# The first list is compared as written, the second in lower case.
MISSING_KEY_TEXTS = ("", "\\N")
MISSING_KEY_WORDS = ("null",)

# Columns that are never dimensions.
TIME_COLUMNS = ("time_hour", "time_minute", "date_p", "date_minute", "time_minute_10")

PERIODS = ("day", "month", "year")


@dataclass(frozen=True)
class DimLabel:
    """How a missing dimension value is shown. ``label=None`` keeps nulls."""

    label: str | None = UNKNOWN_LABEL
    blank_is_missing: bool = True


DEFAULT_DIM_LABELS: Mapping[str, DimLabel] = {
    "func_name": DimLabel(UNDEFINED_FUNCTION_LABEL, blank_is_missing=False),
}


@dataclass(frozen=True)
class MetricSpec:
    """Column roles of one cumulative report.

    ``sums`` and ``distincts`` map an input column to its output name.
    ``day_col`` names a stored day partition (``DateType`` or ``YYYYMMDD``); without
    it the day comes from ``time_col``. Totals start again with every ``period``.
    ``dim_sizes`` says how many values dimensions have at most, where that is known; it only helps to
    choose a plan, and results do not depend on it.
    """

    dims: Sequence[str] = ()
    sums: Mapping[str, str] = field(default_factory=dict)
    distincts: Mapping[str, str] = field(default_factory=dict)
    time_col: str = "time_minute"
    day_col: str | None = None
    step_minutes: int = 10
    period: str = "day"
    sum_type: str = "double"
    dim_labels: Mapping[str, DimLabel] = field(default_factory=lambda: dict(DEFAULT_DIM_LABELS))
    key_texts: Sequence[str] = MISSING_KEY_TEXTS
    key_words: Sequence[str] = MISSING_KEY_WORDS
    dim_sizes: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "dims", tuple(self.dims))
        object.__setattr__(self, "sums", dict(self.sums))
        object.__setattr__(self, "distincts", dict(self.distincts))
        if not self.sums and not self.distincts:
            raise ValueError("the spec names no metric: give at least one sum or distinct key")
        if self.period not in PERIODS:
            raise ValueError(f"period must be one of {PERIODS}")
        if not (0 < self.step_minutes <= 1440 and 1440 % self.step_minutes == 0):
            raise ValueError("step_minutes must divide a day")
        outputs = list(self.dims) + self.metric_names
        repeated = sorted({c for c in outputs if outputs.count(c) > 1})
        if repeated:
            raise ValueError(f"output columns named twice: {repeated}")

    @property
    def metric_names(self) -> list[str]:
        return [*self.distincts.values(), *self.sums.values()]

    @property
    def input_columns(self) -> list[str]:
        """Input columns in spec order, each once."""
        wanted = [*self.dims, *self.distincts, *self.sums, self.time_col]
        if self.day_col:
            wanted.append(self.day_col)
        return list(dict.fromkeys(wanted))

    def label_of(self, dim: str) -> DimLabel:
        return self.dim_labels.get(dim, DimLabel())


def quote(name: str) -> str:
    """A column name as it stands in an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


Levels = str | Iterable[Sequence[str]]


def kept_sets(dims: Sequence[str], levels: Levels = "cube") -> list[tuple[str, ...]]:
    """The dimension sets to report, each in spec order, finest first.

    ``"leaf"`` keeps all dimensions, ``"cube"`` gives every subset, ``"rollup"`` every
    prefix; anything else is an explicit list of dimension sets.
    """
    dims = tuple(dims)
    if levels == "leaf":
        return [dims]
    if levels == "rollup":
        return [dims[:n] for n in range(len(dims), -1, -1)]
    if levels == "cube":
        return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]
    if isinstance(levels, str):
        raise ValueError("levels must be 'leaf', 'rollup', 'cube' or a list of dimension sets")
    chosen = []
    for wanted in levels:
        unknown = sorted(set(wanted) - set(dims))
        if unknown:
            raise ValueError(f"levels name columns that are not dimensions: {unknown}")
        kept = tuple(d for d in dims if d in set(wanted))
        if kept not in chosen:
            chosen.append(kept)
    if not chosen:
        raise ValueError("no level given")
    return chosen


def level_code(dims: Sequence[str], kept: Sequence[str]) -> int:
    """Bit mask of the rolled-up dimensions; the first dimension is the highest bit."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)
