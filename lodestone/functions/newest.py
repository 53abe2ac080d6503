"""The value of the newest row of a group, as an aggregate that needs no sort.

``max(struct(order, value))`` makes Spark sort the rows, because a struct cannot be kept in the buffer of a hash
aggregation.  Two numbers of 32 bits fit one of 64, which can.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, ShortType

_SMALL = (ByteType, ShortType, IntegerType)
_LEAST, _WIDTH = -(2**31), 2**32


@dataclass(frozen=True)
class Newest:
    """``key`` is a column to take the ``max`` of; ``value`` reads the value from that.  The greatest ``order`` wins, of
    several the greatest value; a null order is the least; rows with a null value are left out of the maximum."""

    order_type: DataType
    value_type: DataType

    @property
    def packed(self) -> bool:
        return isinstance(self.order_type, _SMALL) and isinstance(self.value_type, _SMALL)

    def key(self, order: Column, value: Column) -> Column:
        if not self.packed:
            return F.when(value.isNotNull(), F.struct(order.alias("order"), value.alias("value")))
        wide = F.coalesce(order.cast("bigint"), F.lit(_LEAST).cast("bigint"))
        return wide * F.lit(_WIDTH) + (value.cast("bigint") - F.lit(_LEAST))

    def value(self, key: Column) -> Column:
        if not self.packed:
            return key["value"]
        return (F.pmod(key, F.lit(_WIDTH)) + F.lit(_LEAST)).cast(self.value_type)
