"""Scans that arrive as a stream: findings merged once, and waivers that end when their time is over.

Both keep a few bytes for each key, spread over the state store's partitions by key, and need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``). Counts of arriving findings need no state of their own:
``operators.findings.tally`` runs on a stream as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINDING = "artifact_id string, scanner string, ord bigint, id string, title string, severity string, category string, location string, description string"
VIOLATION = "artifact_id string, rule string, severity string, waived boolean, at timestamp"


def merge_arriving(findings: DataFrame) -> DataFrame:
    """``merge_findings`` over a stream of ``origin`` (``parsed`` or ``walked``) and the columns of a finding.

    Parsed rows pass as often as they come; a walked row passes if nothing with its artifact, id and location came before
    it, in earlier batches or as a parsed row or one of smaller ``ord`` in its own. Where parsed rows come no later than
    walked ones, the output is that of the batch form.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names = [f.split()[0] for f in FINDING.split(", ")]

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "seen boolean")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            own = pd.concat(list(rows))
            parsed = own[own["origin"] == "parsed"]
            walked = own[own["origin"] != "parsed"].sort_values("ord", kind="stable")
            known = self.seen.exists() or len(parsed) > 0
            self.seen.update((True,))
            yield pd.concat([parsed, walked.head(0 if known else 1)])[names]

        def close(self):
            pass

    rows = findings.withColumn("location", F.coalesce("location", F.lit(""))).select(*names, "origin")
    return rows.groupBy("artifact_id", "id", "location").transformWithStateInPandas(Seen(), outputStructType=FINDING, outputMode="Append", timeMode="None")


def waive_arriving(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Violations as they are enforced or waived, over a stream of ``artifact_id, rule, kind, severity, expires_at, at``.

    A ``violation`` has a severity; a ``waiver`` lasts to its ``expires_at``, or without end. A row comes out whenever the
    state of a violation changes: when it arrives, when a waiver takes hold of it, and when the watermark passes the end
    of the waiver, which a timer of its key tells. ``delay`` is how late events may come.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Waivers(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.until = handle.getValueState("until", "until bigint")  # milliseconds; below zero without end
            self.severity = handle.getValueState("severity", "severity string")
            self.shown = handle.getValueState("shown", "waived boolean")  # what came out last

        def holds(self, at):
            if not self.until.exists():
                return False
            until = self.until.get()[0]
            return until < 0 or at <= until

        def row(self, key, waived, at):
            import pandas as pd

            self.shown.update((waived,))
            return pd.DataFrame({"artifact_id": [key[0]], "rule": [key[1]], "severity": [self.severity.get()[0]], "waived": [waived], "at": [pd.Timestamp(at, unit="ms")]})

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            own = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
            out = []
            for kind, severity, expires, at in zip(own["kind"], own["severity"], own["expires_at"], own["at"]):
                now = int(at.timestamp() * 1000)
                if kind == "violation":
                    fresh = not self.severity.exists() or self.severity.get()[0] != severity
                    self.severity.update((severity,))
                else:
                    until = -1 if pd.isna(expires) else int(expires.timestamp() * 1000)
                    fresh = False
                    if not self.until.exists() or 0 <= self.until.get()[0] < until or until < 0:
                        self.until.update((until,))
                        if until >= 0:
                            self.handle.registerTimer(until + 1)
                if self.severity.exists() and (fresh or self.holds(now) != self.shown.get()[0]):
                    out.append(self.row(key, self.holds(now), now))
            if out:
                yield pd.concat(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at = expiredTimerInfo.getExpiryTimeInMs()
            if self.shown.exists() and self.shown.get()[0] and self.until.get()[0] + 1 == at:
                yield self.row(key, False, at)

        def close(self):
            pass

    rows = events.withWatermark("at", delay).select("artifact_id", "rule", "kind", "severity", "expires_at", "at")
    return rows.groupBy("artifact_id", "rule").transformWithStateInPandas(Waivers(), outputStructType=VIOLATION, outputMode="Append", timeMode="EventTime")
