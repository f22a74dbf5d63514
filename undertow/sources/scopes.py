"""Which catalog records belong to one estate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def accepts(
    urn: Column, path_prefix: str, instance: str | None = None, other_prefixes: tuple[str, ...] = ()
) -> Column:
    """Datasets by the prefix of their path (and instance); other kinds by a list of prefixes.

    A dataset that names a platform instance belongs to that instance alone: without one declared
    it is refused.

    An empty list takes every record that is not a dataset.
    """
    body = F.regexp_extract(urn, r":li:dataset:\((.*)\)$", 1)
    path = F.split_part(body, F.lit(","), F.lit(-2))
    inside = path.startswith(path_prefix) & (F.size(F.split(body, ",")) >= 3)
    embedded = F.regexp_extract(body, r"^urn:li:dataPlatformInstance:\(.*,([^,)]*)\)", 1)
    if instance is None:
        inside = inside & (embedded == "")
    else:
        inside = inside & path.startswith(f"{instance}.")
        inside = inside & ((embedded == "") | (embedded == instance))
    others = F.lit(not other_prefixes)
    others = reduce(lambda a, p: a | urn.startswith(p), other_prefixes, others)
    return F.when(F.instr(urn, ":li:dataset:(") > 0, inside).otherwise(others)
