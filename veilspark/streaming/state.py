"""What is known of a document whose pages arrive apart: values first seen, and totals, in keyed state.

State is kept a document and within it by value, in the state store, so a document with many values is no row in memory;
a batch reads and writes only the values that it brings. A document that has been silent for a while is closed by a
timer: its totals are given a last time and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.operators.matchers import Matchers
from veilspark.operators.spans import RUNAWAY, page_spans
from veilspark.sources.rules import RuleBook

OUT = "kind string, value string, label string, page int, start int, n_items long, n_values long, n_refused long"
#: The state store that map state and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def page_findings(pages: DataFrame, book: RuleBook, matchers: Matchers | None = None) -> DataFrame:
    """doc_id, page, rule_line, label, value, start, refused: spans of pages as they arrive, one row a rule that ran away on its page. A projection, for streams and batches."""
    each = page_spans(pages, book, matchers=matchers).select("doc_id", "page", F.explode("sources").alias("s"))
    away = F.size("s.spans") > RUNAWAY
    rows = F.when(away, F.array(F.lit(None).cast("struct<start:int,stop:int,matched_text:string,engine_no:int>"))).otherwise(F.col("s.spans"))
    return each.select("doc_id", "page", "s.rule_line", F.col("s.rule_description").alias("label"), away.alias("refused"), F.explode(rows).alias("m")).select(
        "doc_id", "page", "rule_line", "label", F.col("m.matched_text").alias("value"), F.col("m.start").alias("start"), "refused"
    )


class Documents(StatefulProcessor):
    """Rows of a batch: 'value' where a value of the document is new or was first seen earlier than known, 'total' after each batch, 'closed' at last."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "value string", "page int, rule_line int, start int")
        self.totals = handle.getValueState("totals", "n_items long, n_values long, n_refused long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items, values, refused, timer = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        out = []
        for batch in rows:
            for page, line, label, value, start, away in zip(*(batch[c] for c in ("page", "rule_line", "label", "value", "start", "refused")), strict=True):
                if away:
                    refused += 1
                    continue
                items += 1
                place = (int(page), int(line), int(start))
                known = self.seen.containsKey((value,))
                if known and tuple(self.seen.getValue((value,))) <= place:
                    continue
                values += not known
                self.seen.updateValue((value,), place)
                out.append(("value", value, label, place[0], place[2]))
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        if timer:
            self.handle.registerTimer(timer)
        self.totals.update((items, values, refused, timer))
        yield self._frame(key, [*out, ("total", None, None, None, None)], items, values, refused)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items, values, refused, _ = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        self.totals.clear()
        self.seen.clear()
        yield self._frame(key, [("closed", None, None, None, None)], items, values, refused)

    @staticmethod
    def _frame(key, rows: list[tuple], items: int, values: int, refused: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["kind", "value", "label", "page", "start"])
        out.insert(0, "doc_id", key[0])
        return out.astype({"page": "Int32", "start": "Int32"}).assign(n_items=items, n_values=values, n_refused=refused)

    def close(self) -> None:
        pass


def document_stream(pages: DataFrame, book: RuleBook, idle_ms: int | None = None, matchers: Matchers | None = None) -> DataFrame:
    """doc_id and OUT: updates of what is known of each document. The last 'value' row of a value is where the document has it first, the last 'total' row its totals.

    idle_ms: how long a document may be silent before it is closed; with it the query runs until it is stopped, as its timers ask
    for batches without data. pages: a stream; one with its own watermark on repeated deliveries should drop them first, as each row counts. Needs PROVIDER.
    """
    found = page_findings(pages, book, matchers)
    kind = dict(found.dtypes)["doc_id"]
    return found.groupBy("doc_id").transformWithStateInPandas(Documents(idle_ms), f"doc_id {kind}, {OUT}", "Update", "None" if idle_ms is None else "ProcessingTime")
