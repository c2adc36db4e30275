"""Model slots: extractors and recognisers that are plugged in as iterator pandas UDFs, one model load for each Python worker.

An item on which a model fails gets an empty result; the others of its batch keep theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_ENTITY = "array<struct<text:string,label:string,start:int,end:int>>"
#: What a token classifier gives for a text, its word pieces already grouped.
TOKENS = "array<struct<word:string,entity_group:string,score:double,start:int,end:int>>"


def each(model: Callable, items: list, empty) -> list:
    """The model's results for all items; if the batch fails, item by item, with ``empty`` where that fails too."""
    try:
        return list(model(items))
    except Exception:
        out = []
        for item in items:
            try:
                out.append(list(model([item]))[0])
            except Exception:
                out.append(empty)
        return out


def of_tokens(tokens: Column) -> Column:
    """A token classifier's groups as entities with their confidence; null gives none."""
    entity = lambda t: F.struct(t["word"].alias("text"), t["entity_group"].alias("label"), t["start"].alias("start"), t["end"].alias("end"), t["score"].alias("confidence"))
    return F.transform(F.coalesce(tokens, F.array().cast(TOKENS)), entity)


@dataclass
class Slot:
    name: str
    load: Callable[[], Callable[[list], list]]
    description: str = ""
    active: bool = True
    metrics: dict[str, float] = field(default_factory=dict)


class Registry:
    """Named extractors with a default; ``column`` gives the entities that one finds. Without a slot of the name the result is an empty array."""

    def __init__(self) -> None:
        self.slots: dict[str, Slot] = {}
        self.default: str | None = None

    def register(self, slot: Slot, default: bool = False) -> None:
        self.slots[slot.name] = slot
        if default or self.default is None:
            self.default = slot.name

    def toggle(self, name: str, active: bool) -> None:
        self.slots[name].active = active

    def active(self) -> list[str]:
        return sorted(n for n, s in self.slots.items() if s.active)

    def record(self, name: str, **metrics: float) -> None:
        self.slots[name].metrics |= metrics

    def _active(self, name: str | None) -> Slot | None:
        slot = self.slots.get(name or self.default or "")
        return slot if slot is not None and slot.active else None

    def read(self, content: Column, name: str | None = None) -> Column:
        """The text that a recogniser (bytes to text, or null) reads from an image or file; null without an active slot of the name."""
        slot = self._active(name)
        if slot is None:
            return F.lit(None).cast("string")
        load = slot.load

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for items in batches:
                known = [x for x in items if x is not None]
                got = iter(each(model, known, None) if known else [])
                yield pd.Series([None if x is None else next(got) for x in items], dtype=object)

        return run(content)

    def prepared(self, content: Column, name: str | None = None) -> Column:
        """An image as a preprocessing slot (bytes to bytes) leaves it; unchanged without an active slot of the name, or where it fails."""
        slot = self._active(name) if name else None
        if slot is None:
            return content
        load = slot.load

        @F.pandas_udf("binary")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for items in batches:
                yield pd.Series([None if x is None else each(model, [x], x)[0] for x in items], dtype=object)

        return run(content)

    def column(self, text: Column, name: str | None = None) -> Column:
        slot = self._active(name)
        if slot is None:
            return F.array().cast(BATCH_ENTITY)
        load = slot.load

        @F.pandas_udf(BATCH_ENTITY)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(each(model, texts.fillna("").tolist(), []), dtype=object)

        return run(text)
