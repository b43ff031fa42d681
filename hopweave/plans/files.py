"""Parameter files of the interactive and nested queries: what their columns are, and a query for each line."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from hopweave.sources.graph import PropertyGraph
from hopweave.sources.params import read_params

from . import nested, social

#: The columns of each query's file, in their order there. The nested queries take the rest of their arguments from the caller.
FORMATS = {
    "ic1": "start long, first_name string",
    "ic2": "start long, max_date long",
    "ic3": "start long, begin long, end long, country_x string, country_y string",
    "ic4": "start long, begin long, end long",
    "ic5": "start long, min_date long",
    "ic6": "start long, tag_name string",
    "ic7": "start long",
    "ic8": "start long",
    "ic9": "start long, max_date long",
    "ic10": "start long, month long",
    "ic11": "start long, country string, year long",
    "ic12": "start long, tag_class string",
    "cq1": "start long",
    "cq2": "start long",
    "cq3": "start long",
    "cq4": "start long",
    "cq5": "start long",
    "cq6": "start long",
}


def load(spark: SparkSession, path: str, name: str, **others) -> list[Callable[[PropertyGraph], DataFrame]]:
    """A query for each line of the file, in order, for the service or for throughput(). others: arguments that the file doesn't hold.

    The lines come to the driver: they are arguments, of which such a file has some fifty. For very many starts use the batch plans, which keep them in a table.
    """
    if name not in FORMATS:
        raise KeyError(f"no query {name!r}")
    query = getattr(social if name.startswith("ic") else nested, name)
    rows = read_params(spark, path, FORMATS[name]).orderBy("query_id").drop("query_id").collect()
    return [partial(query, **r.asDict(), **others) for r in rows]
