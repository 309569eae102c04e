"""Facts from a stream: each micro-batch is inserted and the program solved again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelog.engine import Engine
from tidelog.operators.relation import Relation
from tidelog.sources.tables import few_sent


def feed(stream: DataFrame, relation: Relation, engine: Engine, checkpoint: str, then: Callable[[int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a query that inserts every micro-batch of ``stream`` into ``relation`` and solves ``engine``, which joins only the new
    facts with what there is. ``available_now``: end once all that is there now has been read.

    Facts are sets, so a micro-batch that is delivered again changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        relation.insert(df)
        with few_sent(df.sparkSession):  # a batch has a session of its own
            engine.solve()
        if then:
            then(number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
