"""The class map of annotation masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Original class ids by the class they are counted as, and the ids that mean no data.
TARGETS: dict[int, tuple[int, ...]] = {
    2: (2, 9, 200, 201),
    3: (3, 9003),
    4: (4, 401, 402, 450, 501, 4900, 5007, 5203, 9004, 10001, 10007, 10011, 10092),
    5: (5, 601, 603, 607, 5103, 5114, 6008, 6012, 6015, 6016, 10003, 10004, 10005, 10006, 10008, 10010, 10012, 10013),
    6: (6, 70, 302, 1791, 10050),
    40: (40,),
    301: (301, 7, 303, 10009),
}
NO_DATA = (0, 15, 127, -128, 255, 65535)

ORIGINALS = tuple(o for ids in TARGETS.values() for o in ids)


def target(original: Column) -> Column:
    """The class an original id counts as, 0 for no data, null for ids outside the map."""
    out = F.when(is_no_data(original), 0)
    for t, ids in TARGETS.items():
        out = out.when(original.isin(*ids), t)
    return out


def known_bit(original: Column) -> Column:
    """A whole number with one bit set, its own for each id of the map and of no data; null for others."""
    ids = dict.fromkeys([*ORIGINALS, *NO_DATA])  # 53 of the 63 that fit
    return F.element_at(F.create_map(*[F.lit(x) for i, o in enumerate(ids) for x in (o, 1 << i)]).cast("map<int, bigint>"), original.cast("int"))


def is_no_data(original: Column) -> Column:
    return original.isin(*NO_DATA)

