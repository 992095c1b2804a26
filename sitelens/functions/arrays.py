"""Array expressions that stay linear: bindings, folds that collect, masks.

Spark evaluates a lambda's body where it stands, so a value used twice is
computed twice; ``let`` binds a value once.  And a fold copies its whole state,
arrays within arrays included, at every step - all but binary values.  So
``collect_text`` gathers what its steps emit as bytes, in a short buffer that is
now and then appended to a long one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BUFFER = 2_048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (the end of a fold over nothing: ``transform`` would copy what it returns)."""
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def emitting(carry: Column, text: Column | str = "") -> Column:
    """What a step of ``collect_text`` returns: the new carry and the text it emits."""
    return F.struct(carry.alias("carry"), (F.lit(text) if isinstance(text, str) else text).cast("binary").alias("out"))


def collect_text(items: Column, carry: Column, step: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None) -> Column:
    """All text that ``step(carry, item)`` emits (see ``emitting``), in order, then ``end(carry)``.

    The carry should be small, or binary where it is long.
    """
    nothing = F.lit("").cast("binary")
    zero = F.struct(carry.alias("carry"), nothing.alias("buffer"), nothing.alias("done"))

    def merge(state: Column, item: Column) -> Column:
        def put(result: Column) -> Column:
            full = F.octet_length(state["buffer"]) >= BUFFER
            return F.struct(result["carry"].alias("carry"),
                            F.when(full, result["out"]).otherwise(F.concat(state["buffer"], result["out"])).alias("buffer"),
                            F.when(full, F.concat(state["done"], state["buffer"])).otherwise(state["done"]).alias("done"))

        return let(step(state["carry"], item), put)

    def finish(state: Column) -> Column:
        rest = [end(state["carry"]).cast("binary")] if end else []
        return F.concat(state["done"], state["buffer"], *rest).cast("string")

    return F.aggregate(items, zero, merge, finish)


def numbers(text: Column, fields: tuple[str, ...]) -> Column:
    """Structs of whole numbers from text like ``1:5;7:9;``."""
    def one(x: Column) -> Column:
        return let(F.split(x, ":"), lambda parts: F.struct(*(F.get(parts, F.lit(k)).cast("int").alias(f) for k, f in enumerate(fields))))

    return F.transform(F.filter(F.split(text, ";"), lambda x: x != ""), one)


def spread_out(items: Column, place: Callable[[Column], Column], value: Callable[[Column], Column], kind: str) -> Column:
    """An array with ``value(item)`` at index ``place(item)`` and null between; ``items`` have ascending places."""
    def runs(items: Column) -> Column:
        def run(item: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(place(F.get(items, k - 1)))
            return F.concat(F.array_repeat(F.lit(None).cast(kind), (place(item) - before - 1).cast("int")), F.array(value(item)))

        return F.flatten(F.transform(items, run))

    return let(items, runs)


def covered(ranges: Column, size: Column) -> Column:
    """True at each index (of ``size``) that lies in one of the ranges (structs of first and last, sorted by first)."""
    def outer(until: Column, r: Column) -> Column:
        # what begins inside the range before only adds what reaches beyond it
        kept = F.concat(F.greatest(r["first"], until + 1).cast("string"), F.lit(":"), r["last"].cast("string"), F.lit(";"))
        return F.when(r["last"] > until, emitting(r["last"], kept)).otherwise(emitting(until))

    def runs(kept: Column) -> Column:
        def run(r: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(kept, k - 1)["last"])
            return F.concat(F.array_repeat(F.lit(False), r["first"] - before - 1), F.array_repeat(F.lit(True), F.least(r["last"], size - 1) - r["first"] + 1))

        tail = size - 1 - F.coalesce(F.get(kept, F.size(kept) - 1)["last"], F.lit(-1))
        return F.concat(F.flatten(F.transform(kept, run)), F.array_repeat(F.lit(False), tail))

    none = F.size(ranges) == 0
    return F.when(none, F.array_repeat(F.lit(False), size)).otherwise(
        let(numbers(collect_text(ranges, F.lit(-1), outer), ("first", "last")), runs))


def by_index(ranges: Column, kind: str) -> Column:
    """The range (a struct with a and b, of type ``kind``) at each index from a to b, null between; ranges are disjoint and ascending."""
    def runs(ranges: Column) -> Column:
        def run(r: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(ranges, k - 1)["b"])
            return F.concat(F.array_repeat(F.lit(None).cast(kind), r["a"] - before - 1), F.array_repeat(r, r["b"] - r["a"] + 1))

        return F.flatten(F.transform(ranges, run))

    return let(ranges, runs)
