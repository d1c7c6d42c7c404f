"""Which column plays which role."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


class BindingError(ValueError):
    """A role that must be bound is not; the message is what a user is told."""


@dataclass(frozen=True)
class Roles:
    """Roles of a table's columns.

    keys tell series apart (none: the whole table is one series). A single date or number axis is sorted by; any other
    axis keeps the order of `ordinal`, a column that numbers the rows as delivered.
    """

    axis: tuple[str, ...] = ()
    measure: str | None = None
    target: str | None = None
    sample_size: str | None = None
    spread: str | None = None
    tooltips: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    ordinal: str | None = None

    def over(self, df: DataFrame) -> Roles:
        """These roles for a table: where no value column has any role, the first one is the measure."""
        if self.measure or any((self.target, self.sample_size, self.spread, self.tooltips)):
            return self
        return replace(self, measure=next((c for c in df.columns if c not in {*self.axis, *self.keys, self.ordinal}), None))

    def check(self) -> None:
        missing = [what for what, there in (("an axis field", self.axis), ("a measurement", self.measure)) if not there]
        if missing:  # fixed value: what a user is told
            raise BindingError("SPC Chart\nPick a Chart type in the Format panel,\nthen add " + " and ".join(missing))
