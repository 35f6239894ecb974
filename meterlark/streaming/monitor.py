"""Quality checks and health metrics around a micro-batch handler."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.operators import observe, quality
from meterlark.streaming.sinks import BatchTable


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Monitor:
    """Wraps a handler of good rows: bad ones go to quarantine, figures and alerts to their tables.

    All tables are written per batch id, so a retried batch leaves one set of rows.
    """

    layer: str
    root: str
    thresholds: observe.Thresholds | None = None
    as_of: Column | None = None  # the clock; the current time unless given
    formats: bool = True  # also check the text of ids, versions, countries and paths
    history: BatchTable | None = None  # the table whose hourly volume a batch is compared with
    app: str = "meterlark"

    def table(self, name: str) -> BatchTable:
        return BatchTable(f"{self.root}/{name}_{self.layer}")

    def around(self, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            now = F.current_timestamp() if self.as_of is None else self.as_of
            checked = quality.check(batch, self.layer, at=now, formats=self.formats).persist()
            try:
                good, bad = quality.split_checked(checked)
                with observe.timed() as took:
                    handle(good.drop("quality_check_errors", "quality_check_passed", "quality_check_timestamp"), batch_id)
                self.table("quarantine").write(bad.withColumns({"quarantine_date": F.to_date(now), "quarantine_layer": F.lit(self.layer), "reprocessed": F.lit(False)}), batch_id)
                self._record(checked, batch_id, now, max(took["duration_s"], 1e-3))
            finally:
                checked.unpersist()

        return run

    def beside(self, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """Like ``around``, but the handler gets all rows and none are quarantined."""

        def run(batch: DataFrame, batch_id: int) -> None:
            now = F.current_timestamp() if self.as_of is None else self.as_of
            with observe.timed() as took:
                handle(batch, batch_id)
            self._record(quality.check(batch, self.layer, at=now, formats=self.formats), batch_id, now, max(took["duration_s"], 1e-3))

        return run

    def _record(self, checked: DataFrame, batch_id: int, now: Column, duration_s: float) -> None:
        found = quality.quality_metrics(checked, self.layer)
        self.table("quality_metrics").write(found.withColumns({"batch_id": F.lit(batch_id), "metric_timestamp": now}), batch_id)
        self.table("quality_alerts").write(quality.quality_alerts(found, self._anomaly(checked, now)), batch_id)
        figures = observe.batch_metrics(checked, self.layer, batch_id, now, duration_s, self.app)
        self.table("observability_metrics").write(figures, batch_id)
        limits = self.thresholds or observe.LAYERS.get(self.layer)
        raised = observe.threshold_alerts(figures, limits).persist()
        try:
            self.table("observability_alerts").write(raised, batch_id)
            for alert in raised.filter("severity = 'critical'").collect():  # one row for each family at most
                log.critical("%s batch %s: %s", alert.layer, alert.batch_id, alert.message)
        finally:
            raised.unpersist()

    def _anomaly(self, checked: DataFrame, now: Column) -> DataFrame | None:
        past = None if self.history is None else self.history.read(checked.sparkSession)
        time = past and quality.time_column(past.columns)
        if time is None:
            return None
        current = checked.agg(F.count("*")).first()[0]
        return quality.volume_anomaly(past, F.lit(current), now, time)
