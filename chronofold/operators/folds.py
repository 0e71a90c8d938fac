"""Folds whose next step depends on the outcome of the last: reservations under ceilings, merged reading positions.

No window sum gives these, as a refused request must add nothing to what the next one sees. A key's rows are
dealt to one task in order and folded as they stream by; only the key's state is held. Keys are independent;
a single key's fold is sequential by its nature, and takes time in proportion to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

AMOUNTS = ("input_tokens", "output_tokens", "micro")
CEILINGS = ("max_input", "max_output", "max_micro")


def fold_in_order(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """``step(state, row) -> values`` for each row of each ``key`` in ``order``; ``out`` is the schema of the values,
    which follow the row's own columns. Keys come one after the other in a task."""
    names = [c.split()[0] for c in out.split(", ")]
    kinds = to_arrow_schema(T.StructType.fromDDL(out))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():  # whole numbers and nulls as they are
                if row[key] != last:
                    last, state = row[key], start()
                made.append(step(state, row))
            columns = zip(*made) if made else [()] * len(names)
            arrays = [*batch.columns, *(pa.array(c, kinds.field(n).type) for c, n in zip(columns, names))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(fold, f"{shape}, {out}")


class Budget:
    """A book's ledger and its open reservations."""

    def __init__(self):
        self.spent, self.held, self.open, self.ids = [0, 0, 0], [0, 0, 0], {}, set()

    def ask(self, hold, amounts, ceilings) -> str:
        if hold in self.ids:
            return "repeated"
        for spent, held, amount, ceiling, name in zip(self.spent, self.held, amounts, ceilings, ("input", "output", "usd")):
            if ceiling is not None and spent + held + amount > ceiling:
                return f"refused {name}"
        self.ids.add(hold)
        self.put(hold, amounts)
        return "reserved"

    def put(self, hold, amounts) -> None:
        before = self.open.get(hold, (0, 0, 0))
        self.open[hold] = tuple(amounts)
        self.held = [h - b + a for h, b, a in zip(self.held, before, amounts)]

    def close(self, hold, spend: bool) -> None:
        amounts = self.open.pop(hold)
        self.held = [h - a for h, a in zip(self.held, amounts)]
        if spend:
            self.spent = [s + a for s, a in zip(self.spent, amounts)]


def reservations(log: DataFrame, order: list[str]) -> DataFrame:
    """Each row of ``log`` with its ``outcome`` and, after it, ``spent_micro, held_micro, holds``.

    ``log``: ``book_id, op, hold_id``, the amounts ``input_tokens, output_tokens, micro`` and the ceilings
    ``max_input, max_output, max_micro`` (null: none). ``reserve`` is refused by the first ceiling that ledger, open
    reservations and request together exceed, and then adds nothing; a used hold is ``repeated``. ``actual``
    replaces an open reservation's amounts, ``settle`` moves it to the ledger, ``discard`` drops it; each is
    ``unknown`` where the hold is not open, so a reservation is settled once at most. ``spend`` is a reservation that is
    settled at once. A negative or missing amount is ``invalid``.
    """

    def step(budget: Budget, row: dict) -> tuple:
        amounts = [row[a] for a in AMOUNTS]
        hold, op = row["hold_id"], row["op"]
        if op in ("reserve", "actual", "spend") and (hold is None or any(a is None or a < 0 for a in amounts)):
            outcome = "invalid"
        elif op in ("reserve", "spend"):
            outcome = budget.ask(hold, amounts, [row[c] for c in CEILINGS])
            if op == "spend" and outcome == "reserved":
                budget.close(hold, True)
                outcome = "spent"
        elif hold not in budget.open:
            outcome = "unknown"
        elif op == "actual":
            budget.put(hold, amounts)
            outcome = "noted"
        else:
            budget.close(hold, op == "settle")
            outcome = "settled" if op == "settle" else "discarded"
        return outcome, budget.spent[2], budget.held[2], len(budget.open)

    whole = [F.col(c).cast("long").alias(c) for c in (*AMOUNTS, *CEILINGS, "hold_id")]
    rest = [c for c in log.columns if c not in (*AMOUNTS, *CEILINGS, "hold_id")]
    return fold_in_order(log.select(*rest, *whole), "book_id", order, Budget, step, "outcome string, spent_micro long, held_micro long, holds long")


POSITION = "epoch long, version long, bookmark long, offset long, high_water long, client string, sequence long"


class Position:
    """Where a book's reader is, and who said so last."""

    __slots__ = ("epoch", "version", "bookmark", "offset", "high_water", "client", "sequence")

    def __init__(self, epoch=0, version=0, bookmark=0, offset=0, high_water=0, client="", sequence=0):
        self.epoch, self.version, self.bookmark, self.offset = epoch, version, bookmark, offset
        self.high_water, self.client, self.sequence = high_water, client, sequence

    def values(self) -> tuple:
        return tuple(getattr(self, s) for s in self.__slots__)

    def take(self, *, chapter: int, offset: int, epoch: int, base: int, client: str, sequence: int, last_chapter: int) -> str:
        """The outcome of one device's report: ``stale_epoch``, ``future_version`` or ``beyond_end`` refuse it.

        A report on the current version is ``applied`` as it is. One on an older version is a merge: ``merged_advance`` if
        it goes further than what is known, ``tie_won`` if it is as far and its (client, sequence) is the greater,
        ``stale_behind`` or ``tie_lost`` otherwise, which change nothing.
        """
        if epoch != self.epoch:
            return "stale_epoch"
        if base > self.version:
            return "future_version"
        if chapter > last_chapter:
            return "beyond_end"
        far, known = (chapter, offset), (self.bookmark, self.high_water)
        if base == self.version:
            outcome, self.offset = "applied", offset
        elif chapter > known[0] or offset > known[1]:
            outcome = "merged_advance"
        elif far != known:
            return "stale_behind"
        elif (client, sequence) > (self.client, self.sequence):
            outcome = "tie_won"
        else:
            return "tie_lost"
        self.offset = max(self.offset, offset) if outcome != "applied" else self.offset
        self.bookmark, self.high_water = max(self.bookmark, chapter), max(self.high_water, offset)
        self.version, self.client, self.sequence = self.version + 1, client, sequence
        return outcome


REPORT = ("chapter", "offset", "epoch", "base", "client", "sequence", "last_chapter")


def report_of(row: dict) -> dict:
    return {c: row[c] for c in REPORT}


def merged_positions(reports: DataFrame, order: list[str]) -> DataFrame:
    """Each report with its ``outcome`` and the position after it (``p_epoch`` to ``p_sequence``). ``reports``: ``book_id,
    chapter, offset, epoch, base, client, sequence, last_chapter``, in the ``order`` of their arrival."""

    def step(position: Position, row: dict) -> tuple:
        return position.take(**report_of(row)), *position.values()

    out = "outcome string, " + ", ".join(f"p_{c}" for c in POSITION.split(", "))
    return fold_in_order(reports, "book_id", order, Position, step, out)
